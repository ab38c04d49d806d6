"""Deduplicating new batches against all history.

What has been accepted is kept in the shared folder as blocking-key tables: rows by SHA-256, rows by perceptual hash, and the
packed slots of ``hamming``, each bucketed by its key. Beside them lie what later runs need to go on: the plan of the keys
with its crowded blocks, the counts of link patterns, each case's representative, and the roots of merged representatives. A
delivery (one batch or several, taken in order) probes the tables: its own keys are shuffled to their buckets, history is read
as narrow columns and neither shuffled nor compared with itself.

Candidates (an equal SHA-256, or values that meet under a key and lie within REACH bits) are scored by field weights, learned by
EM from how often each pattern of agreement occurs in this and all earlier deliveries. Those that score as a match are links;
the exact check (an equal SHA-256 or at most RADIUS bits) follows. The least score taken is never above that of a pattern the
definition names, so weights learned from few or odd rows lose no case. A row that links to an accepted row before it is a case,
else it is accepted.

Acceptance depends on order. Rows with the same pair of hashes collapse first: all but the first of them are cases, whatever
befalls the first. Most of the rest is settled by the probe or stands alone. What is left (rows that meet others of the
delivery) is settled in rounds: a row that no unsettled row before it meets is accepted, a row that meets an accepted one before
it is a case; each round settles at least the first of every cluster. Once no more than LEFT rows are unsettled, one task settles
them in order, so that a long chain of near copies costs no more rounds.

The best-scored link of a case is its representative. Where one case links several, their clusters are merged: the roots of
these representatives are looked up and joined (by union-find in one task, beyond LEFT edges by Hash-to-Min), and only nodes of the
clusters concerned get new rows. Rows of an
unfinished delivery are never seen: each carries the delivery's number, and the number is committed last.

Defined results: hashes that identify nothing match nothing, so a row without either is accepted; repeated rows are cases
after the first; an empty delivery or history gives no case; rows without batch_no or row_id are no rows; other columns are
ignored.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.functions.normal import phash_of, sha256_bytes
from sievelight.llm import hamming
from sievelight.llm.splits import hash_to_min
from sievelight.operators.skew import hot_buckets, hot_join, salted_join
from sievelight.session import Scratch, materialise, release, remove, shared_dir

SAME, NEAR, ROWS, REPS, ROOTS = "same", "near", "rows", "reps", "roots"
TABLES = {
    SAME: ("sha BINARY, row_id BIGINT, ph BIGINT, v INT", "sha"),
    NEAR: ("slot BIGINT, phs BINARY, v INT", "slot"),
    ROWS: ("ph BIGINT, row_id BIGINT, s64 BIGINT, v INT", "ph"),
    REPS: ("row_id BIGINT, rep BIGINT, links INT, score DOUBLE, v INT", None),
    ROOTS: ("node BIGINT, root BIGINT, v INT", None),
}
#: Distances up to which candidates are scored.
REACH = 2 * hamming.RADIUS
#: Bytes of packed keys in a bucket, about; a history is laid out anew when it holds GROWTH times what its plan was made for.
BUCKET_BYTES, GROWTH = 64 << 20, 32
#: Rows (a signature and a place it looks at) that one task may settle in order, and edges it may merge; what is more is settled in rounds until so few are left, or merged by Hash-to-Min.
LEFT = 200_000
#: Distances within which a pattern is a match by definition, and all levels of distance.
WITHIN = tuple(str(d) for d in range(hamming.RADIUS + 1))
DISTANCES = (*(str(d) for d in range(REACH + 1)), "far", "missing")


class Order:
    """Places in the order (batch_no, row_id) as single numbers."""

    def __init__(self, rows: DataFrame) -> None:
        least = rows.agg(F.min("batch_no"), F.max("batch_no"), F.min("row_id"), F.max("row_id")).first()
        b0, b1, self.r0, r1 = (x or 0 for x in least)
        self.b0, self.bits = b0, max(1, (r1 - self.r0).bit_length())
        self.plain = self.bits + (b1 - b0).bit_length() <= 62

    def place(self) -> Column:
        b, r = F.col("batch_no").cast("bigint") - F.lit(self.b0), F.col("row_id") - F.lit(self.r0)
        if self.plain:
            return F.shiftleft(b, self.bits).bitwiseOR(r)
        return (b.cast("decimal(38,0)") * F.lit(1 << 64).cast("decimal(20,0)") + r.cast("decimal(20,0)")).cast("decimal(38,0)")

    def row(self, place: Column) -> Column:
        if self.plain:
            return place.bitwiseAND(F.lit((1 << self.bits) - 1)) + F.lit(self.r0)
        return (place % F.lit(1 << 64).cast("decimal(20,0)")).cast("bigint") + F.lit(self.r0)


def identified(rows: DataFrame, order: Order) -> DataFrame:
    """row_id, its place in the order as t, SHA-256 as binary, perceptual hash as bigint; rows with neither are left out."""
    rows = rows.where(F.col("batch_no").isNotNull() & F.col("row_id").isNotNull())
    out = rows.select("row_id", order.place().alias("t"), sha256_bytes(F.col("sha256")).alias("sha"), phash_of(F.col("phash")).alias("ph"))
    return out.where(F.col("sha").isNotNull() | F.col("ph").isNotNull())


# Links and their weights.


def _em(counts: dict[tuple[str, str], int], rounds: int = 30) -> tuple[list[dict[str, float]], list[dict[str, float]], float]:
    """What share of matches and of chance agreements shows each level of either field, and the share of matches.

    Fields are independent within a class. Chance distances start as those of random values that agree in a key.
    """
    levels = ({a for a, _ in counts}, {b for _, b in counts})
    start_m = {"same": 0.9, "0": 0.9, "1": 0.5, "2": 0.5}
    start_u = {"same": 0.01, "differs": 0.9, "missing": 0.3, "far": 0.9} | {str(d): math.comb(43, d) / math.comb(43, REACH) for d in range(REACH + 1)}
    m = [{x: start_m.get(x, 0.2 if x in (*WITHIN, "missing", "differs") else 0.01) for x in f} for f in levels]
    u = [{x: start_u.get(x, 0.3) for x in f} for f in levels]
    prior = 0.9
    for _ in range(rounds):
        whole = {"m": 0.0, "u": 0.0}
        sums = [[{x: 0.01 for x in f} for f in levels] for _ in range(2)]
        for (a, b), n in counts.items():
            pm, pu = prior * m[0][a] * m[1][b], (1 - prior) * u[0][a] * u[1][b]
            g = pm / (pm + pu) if pm + pu else 0.5
            whole["m"] += g * n
            whole["u"] += (1 - g) * n
            for k, x in enumerate((a, b)):
                sums[0][k][x] += g * n
                sums[1][k][x] += (1 - g) * n
        n = whole["m"] + whole["u"]
        prior = min(max(whole["m"] / n if n else 0.5, 0.01), 0.99)
        for k in range(2):
            for c, target in ((0, m), (1, u)):
                total = sum(sums[c][k].values())
                target[k] = {x: v / total for x, v in sums[c][k].items()}
    return m, u, prior


def learn_weights(counts: dict[tuple[str, str], int]) -> dict[str, dict[str, float]]:
    """log2 weights by field and level, from how often candidates show (sha level, phash level); that table is tiny whatever the data."""
    m, u, _ = _em(counts)
    return {f: {x: math.log2(m[k][x] / u[k][x]) for x in m[k]} for k, f in enumerate(("sha", "ph"))}


def least_score(counts: dict[tuple[str, str], int], weights: dict[str, dict[str, float]]) -> float:
    """From which score on a candidate is a link: as likely a match as not, but no more than the least of a pattern that the definition names."""
    prior = _em(counts)[2]
    defined = [weights["sha"][a] + weights["ph"][b] for a, b in counts if a == "same" or b in WITHIN]
    return min([math.log2((1 - prior) / prior), *defined])


def _distance(d: Column) -> Column:
    """A distance as a level; null is missing."""
    return F.when(d.isNull(), F.lit("missing")).when(d > REACH, F.lit("far")).otherwise(d.cast("string"))


def _agreement(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), F.lit("missing")).when(a == b, F.lit("same")).otherwise(F.lit("differs"))


def _patterns(links: DataFrame) -> dict[tuple[str, str], int]:
    return {(r["s"], r["d"]): r["n"] for r in links.groupBy("s", "d").agg(F.count("*").alias("n")).collect()}  # at most 3 x 11 rows


def _scored(links: DataFrame, counts: dict[tuple[str, str], int]) -> DataFrame:
    """Candidates that score as a link, with their score, after the exact check."""
    weights = learn_weights(counts)
    score = F.lit(0.0)
    for field, column in (("sha", "s"), ("ph", "d")):
        for x, w in sorted(weights[field].items()):
            score = score + F.when(F.col(column) == x, F.lit(w)).otherwise(F.lit(0.0))
    linked = links.withColumn("score", score).where(F.col("score") >= F.lit(least_score(counts, weights) - 1e-9))
    return linked.where((F.col("s") == "same") | F.col("d").isin(*WITHIN))


# Probing packed slots.


def _emit(found) -> Iterator[pa.RecordBatch]:
    for a, b, d in found:
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(d)], names=["ph", "other", "d"])


PAIR = "ph bigint, other bigint, d int"


def _against(plan: hamming.Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slot, old, new in zip(*(c for c in batch.columns)):
                yield from _emit(hamming.meetings(plan, plan.tag_of(slot.as_py()), hamming.unpacked(new.as_py()), hamming.unpacked([old.as_py()]), REACH))

    return run


def _among(plan: hamming.Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slot, new in zip(*(c for c in batch.columns)):
                values = hamming.unpacked(new.as_py())
                for a, b, d in hamming.meetings(plan, plan.tag_of(slot.as_py()), values, values, REACH):
                    once = a < b
                    yield from _emit([(a[once], b[once], d[once])])

    return run


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The accepted of what is left, settled one after the other: (t, place, own) come in order of t; a signature that looks at a place where an accepted one sits is a case."""
    taken: set[bytes] = set()
    now, looks, own, kind = None, [], [], None
    out = []

    def settle() -> None:
        if now is not None and taken.isdisjoint(looks):
            taken.update(own)
            out.append(now)

    for batch in batches:
        kind = batch.schema.field(0).type
        for t, place, sits in zip(*(c.to_pylist() for c in batch.columns)):
            if t != now:
                settle()
                now, looks, own = t, [], []
            looks.append(place)
            if sits:
                own.append(place)
    settle()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(out, kind)], names=["t"])


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of edges: the least node of what is connected."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    if parent:
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["node", "component"])


class History:
    """The persisted tables of all accepted rows; opening a folder that holds one goes on with it."""

    def __init__(self, spark: SparkSession, path: str | None = None, rows: int = 0, crowded=None, blocks: int | None = None) -> None:
        self.spark = spark
        self.path = path or f"{shared_dir(spark)}/sievelight/history-{uuid.uuid4().hex}"
        self.name = "history_" + uuid.uuid4().hex
        self.version, self.rows, self.counts = 0, 0, {}
        kept = self._latest() if path else None
        if kept:
            self.version, self.rows, self.planned, self.buckets = kept["version"], kept["rows"], kept["planned"], kept["buckets"]
            self.counts = {(a, b): n for a, b, n in kept["counts"]}
            self.plan = hamming.Plan(kept["blocks"], kept["bits"], tuple(map(tuple, kept["crowded"])))
        else:
            self.planned = max(rows, 1)
            self.plan = hamming.plan_for(rows, crowded, blocks)
            size = rows * 8 * len(self.plan.choices)
            self.buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
        for kind, (columns, by) in TABLES.items():
            clustered = f"CLUSTERED BY ({by}) INTO {self.buckets} BUCKETS" if by else ""
            spark.sql(f"CREATE TABLE {self.name}_{kind} ({columns}) USING parquet {clustered} LOCATION '{self.path}/{kind}'")

    def _latest(self) -> dict | None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/state")
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return None
        states = [json.loads(r["value"]) for r in self.spark.read.text(f"{self.path}/state").collect()]  # one line per delivery
        return max(states, key=lambda s: s["version"], default=None)

    def _commit(self) -> None:
        self.version += 1
        state = {
            "version": self.version, "rows": self.rows, "planned": self.planned, "buckets": self.buckets, "counts": [[a, b, n] for (a, b), n in sorted(self.counts.items())],
            "blocks": self.plan.blocks, "bits": self.plan.bits, "crowded": self.plan.crowded,
        }
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("append").text(f"{self.path}/state")

    def table(self, kind: str) -> DataFrame:
        """Rows of all committed deliveries."""
        return self.spark.table(f"{self.name}_{kind}").where(F.col("v") <= self.version).drop("v")

    def _add(self, kind: str, rows: DataFrame) -> None:
        columns = [c.split()[0] for c in TABLES[kind][0].split(", ")]
        by = TABLES[kind][1]
        rows = rows.withColumn("v", F.lit(self.version + 1)).select(*columns)
        (rows.repartition(self.buckets, by) if by else rows).write.insertInto(f"{self.name}_{kind}")

    def accept(self, accepted: DataFrame, copies: bool = False) -> None:
        """Add the keys of accepted rows (row_id, sha, ph): one row per distinct SHA-256 and perceptual hash, and the packed slots.

        Of a delivery's accepted rows no two share a hash; only the rows a history begins with may hold ``copies``.
        """
        s64 = F.when(F.col("sha").isNotNull(), F.xxhash64("sha"))
        shas, hashes = accepted.where(F.col("sha").isNotNull()), accepted.where(F.col("ph").isNotNull())
        if copies:
            shas = shas.groupBy("sha").agg(F.min("row_id").alias("row_id"), F.min_by("ph", "row_id").alias("ph"))
            hashes = hashes.groupBy("ph").agg(F.min("row_id").alias("row_id"), F.min_by(s64, F.when(F.col("sha").isNotNull(), F.col("row_id"))).alias("s64"))
        else:
            hashes = hashes.withColumn("s64", s64)
        self._add(SAME, shas)
        self._add(ROWS, hashes)
        self._add(NEAR, hamming.packed(accepted, "ph", self.plan))

    # A delivery.

    def settle(self, rows: DataFrame, order: Order, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Of a delivery (``identified``): its signatures, those of them that are accepted, and the links of the others (t, to, score)."""
        grouped = rows.groupBy("sha", "ph").agg(F.min("t").alias("t"), F.count("*").alias("n"))
        signatures = scratch.put(grouped.withColumn("row_id", order.row(F.col("t"))), "signatures")
        by_slot = hamming.packed(signatures, "ph", self.plan).repartition(self.buckets, "slot").groupBy("slot")
        early = Scratch(self.spark)
        probe = early.put_bucketed(by_slot.agg(F.collect_list("phs").alias("new")), "probe", "slot", self.buckets)
        links = scratch.put(self._old_links(signatures, probe, scratch), "links")
        counts = _patterns(links)
        self.counts = {k: self.counts.get(k, 0) + counts.get(k, 0) for k in self.counts | counts}
        old = _scored(links, self.counts).select("t", "to", "score")
        fresh = scratch.put(signatures.join(old.select("t").distinct(), "t", "left_anti"), "fresh")
        within = scratch.put(probe.mapInArrow(_among(self.plan), PAIR).where(F.col("d") <= hamming.RADIUS), "within")
        early.drop()
        release(self.spark)
        within = within.unionByName(within.select(F.col("other").alias("ph"), F.col("ph").alias("other"), "d"))
        taken = scratch.put(self._settle_fresh(fresh, within, scratch), "taken")
        missed = fresh.join(taken.select("t"), "t", "left_anti")
        new = scratch.put(links_among(missed, taken, within), "new_links")
        counts = _patterns(new)
        self.counts = {k: self.counts.get(k, 0) + counts.get(k, 0) for k in self.counts | counts}
        return signatures, taken, old.unionByName(_scored(new, self.counts).select("t", "to", "score"))

    def _old_links(self, signatures: DataFrame, probe: DataFrame, scratch: Scratch) -> DataFrame:
        """(t, to, s, d): the candidates of signatures in history; to is an accepted row, s and d how far the fields agree."""
        known = self.table(SAME).select("sha", F.col("row_id").alias("to"), F.col("ph").alias("other"))
        some = signatures.where(F.col("sha").isNotNull()).select("sha", "t", "ph")
        by_sha = some.join(known, "sha").select("t", "to", F.lit("same").alias("s"), _distance(F.bit_count(F.col("ph").bitwiseXOR(F.col("other")))).alias("d"))
        pairs = scratch.put(self.table(NEAR).join(probe, "slot").select("slot", "phs", "new").mapInArrow(_against(self.plan), PAIR), "old_pairs")
        held = self.table(ROWS).select(F.col("ph").alias("other"), F.col("row_id").alias("to"), "s64")
        met = scratch.put(pairs.join(held, "other").select("ph", "to", "s64", "d"), "met")
        hot = hot_buckets(signatures, ["ph"], signatures.count())
        by_ph = salted_join(signatures.where(F.col("ph").isNotNull()).select("ph", "t", F.when(F.col("sha").isNotNull(), F.xxhash64("sha")).alias("own")), met, ["ph"], hot)
        return by_sha.unionByName(by_ph.select("t", "to", _agreement(F.col("own"), F.col("s64")).alias("s"), _distance(F.col("d")).alias("d")))

    @staticmethod
    def _settle_fresh(fresh: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
        """Rounds over the signatures that history doesn't settle; places are the values they sit at or look at."""
        place = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
        own = F.filter(F.array("sha", place("ph")), lambda p: p.isNotNull())
        sits = fresh.select("t", F.explode(own).alias("place"))
        near = salted_join(fresh.select("t", "ph").where(F.col("ph").isNotNull()), pairs.select("ph", "other"), ["ph"], hot_buckets(fresh, ["ph"], fresh.count())).select("t", place("other").alias("place"))
        # alone: no other signature sits at any place that it looks at
        crowd = scratch.put(sits.groupBy("place").agg(F.min("t").alias("first"), F.max("t").alias("last")), "crowd")
        hot = hot_buckets(sits, ["place"], fresh.count())
        several = crowd.where(F.col("first") != F.col("last")).select("place")
        met = salted_join(sits, several, ["place"], hot).select("t").union(salted_join(near, crowd, ["place"], hot).select("t"))
        met = scratch.put(met.distinct(), "met")
        accepted = [fresh.join(met, "t", "left_anti")]
        left = scratch.put(fresh.join(met, "t", "left_semi"), "left")
        sits = scratch.put(left.select("t", F.explode(own).alias("place")), "sits")
        looks = scratch.put(sits.union(near.join(met, "t", "left_semi")), "looks")
        while looks.count() > LEFT:
            first = sits.groupBy("place").agg(F.min("t").alias("first"))
            blocked = salted_join(looks, first, ["place"], hot).where(F.col("first") < F.col("t")).select("t").distinct()
            now = scratch.put(sits.select("t").distinct().join(blocked, "t", "left_anti"), "now")
            accepted.append(left.join(now, "t", "left_semi"))
            taken = sits.join(now, "t", "left_semi").groupBy("place").agg(F.min("t").alias("first"))
            cases = salted_join(looks, taken, ["place"], hot).where(F.col("first") < F.col("t")).select("t")
            settled = scratch.put(cases.union(now).distinct(), "settled")
            sits = scratch.put(sits.join(settled, "t", "left_anti"), "sits")
            looks = scratch.put(looks.join(settled, "t", "left_anti"), "looks")
        rest = looks.join(sits.withColumn("own", F.lit(True)), ["t", "place"], "left").select("t", "place", F.coalesce("own", F.lit(False)).alias("own"))
        kind = dict(rest.dtypes)["t"]
        now = rest.repartition(1).sortWithinPartitions("t").mapInArrow(_in_order, f"t {kind}")
        accepted.append(left.join(now, "t", "left_semi"))
        out = accepted[0]
        for more in accepted[1:]:
            out = out.unionByName(more)
        return out.select("row_id", "t", "sha", "ph")

    # Clusters.

    def represent(self, signatures: DataFrame, links: DataFrame, rows: DataFrame, accepted_first: DataFrame, scratch: Scratch) -> None:
        """Keep the representative of every case, and merge the clusters that one case links.

        An accepted row that links others, as in a history that begins with clusters, represents itself. A copy has the
        representative of the first row with its hashes, or that row if it is accepted.
        """
        firsts = signatures.select("t", "row_id", "n", "sha", "ph")
        own = accepted_first.select("t", F.lit(1).alias("own"))
        best = links.groupBy("t").agg(F.max_by("to", F.struct("score", -F.col("to"))).alias("best"), F.max("score").alias("score"), F.count_distinct("to").cast("int").alias("links"))
        best = best.join(firsts.select("t", "row_id"), "t").join(own, "t", "left").withColumn("rep", F.when(F.col("own") == 1, F.col("row_id")).otherwise(F.col("best")))
        best = scratch.put(best, "best")
        copied = firsts.where("n > 1").join(best.select("t", "rep", "links", "score"), "t", "left").join(own, "t", "left")
        copied = copied.select(F.coalesce("sha", F.lit(b"")).alias("k1"), F.coalesce("ph", F.lit(0)).alias("k2"), F.col("ph").isNull().alias("k3"), "n", F.col("row_id").alias("first"), F.coalesce("rep", "row_id").alias("rep"), (F.coalesce("links", F.lit(0)) + F.coalesce("own", F.lit(0))).cast("int").alias("links"), "score")
        copied = scratch.put(copied, "copied")
        keyed = rows.select("row_id", F.coalesce("sha", F.lit(b"")).alias("k1"), F.coalesce("ph", F.lit(0)).alias("k2"), F.col("ph").isNull().alias("k3"))
        copies = hot_join(keyed, copied, ["k1", "k2", "k3"], "n", rows.count()).where(F.col("row_id") != F.col("first")).select("row_id", "rep", "links", "score")
        self._add(REPS, best.select("row_id", "rep", "links", "score").unionByName(copies))
        several = links.join(best.where("links > 1 OR own = 1").select("t", "rep"), "t").where(F.col("to") != F.col("rep")).select(F.col("rep").alias("a"), F.col("to").alias("b")).distinct()
        edges = scratch.put(several, "edges")
        if not edges.isEmpty():
            self._merge(edges, scratch)

    def roots(self) -> DataFrame:
        """(node, root) of the representatives that were merged; all others are their own roots."""
        rows = self.spark.table(f"{self.name}_{ROOTS}").where(F.col("v") <= self.version)
        return rows.groupBy("node").agg(F.max_by("root", "v").alias("root"))

    def _merge(self, edges: DataFrame, scratch: Scratch) -> None:
        """Join the clusters of each edge's two representatives; only nodes of these clusters get new rows."""
        roots = scratch.put(self.roots(), "roots")
        for side in ("a", "b"):
            edges = edges.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root")), side, "left")
        between = edges.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")).where("a <> b").distinct()
        between = scratch.put(between, "between")
        small = between.count() <= LEFT
        found = scratch.put(between.repartition(1).mapInArrow(_union_find, "node bigint, component bigint") if small else hash_to_min(between), "found")
        changed = found.where("node <> component").select(F.col("node").alias("root"), F.col("component").alias("to"))
        below = roots.join(changed, "root").select("node", F.col("to").alias("root"))
        self._add(ROOTS, below.unionByName(changed.select(F.col("root").alias("node"), F.col("to").alias("root"))))

    def ingest(self, delivery: DataFrame) -> DataFrame:
        """The cases of a delivery (row_id); its accepted rows, representatives and merged clusters enter the tables."""
        scratch = Scratch(self.spark)
        order = Order(delivery)
        rows = scratch.put(identified(delivery, order), "delivery")
        if rows.isEmpty():
            scratch.drop()
            return self.spark.createDataFrame([], "row_id bigint")
        signatures, taken, links = self.settle(rows, order, scratch)
        links = scratch.put(links, "scored")
        release(self.spark)
        self.accept(taken)
        self.represent(signatures, links, rows, taken, scratch)
        cases = materialise(rows.select("row_id").join(taken.select("row_id"), "row_id", "left_anti"), "cases")
        self._close_delivery(taken.count())
        scratch.drop()
        return cases

    def _close_delivery(self, rows: int) -> None:
        self.rows += rows
        self._commit()
        if self.rows > GROWTH * self.planned:
            self._lay_out_anew()

    def _lay_out_anew(self) -> None:
        """Choose keys for what the history has grown to and write its packed slots once more; each row is so written a number of times that grows with the logarithm of history only."""
        values = materialise(self.table(ROWS).select("ph"), "values")
        blocks = hamming.plan_for(self.rows).blocks
        plan = hamming.plan_for(self.rows, hamming.crowded_blocks(values, "ph", blocks), blocks)
        grown = History(self.spark, rows=self.rows, crowded=plan.crowded, blocks=blocks)
        for kind in TABLES:
            source = hamming.packed(values, "ph", plan) if kind == NEAR else self.roots() if kind == ROOTS else self.table(kind)
            grown._add(kind, source)
        grown.rows, grown.counts = self.rows, self.counts
        grown._commit()
        self.close()
        self.path, self.name, self.plan, self.planned, self.buckets, self.version = grown.path, grown.name, grown.plan, grown.planned, grown.buckets, grown.version

    def close(self, delete: bool = False) -> None:
        """Forget the tables' names in this session; their files stay in the history's folder unless they are to go."""
        for kind in TABLES:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{kind}")
        if delete:
            remove(self.spark, self.path)


def links_among(rows: DataFrame, accepted: DataFrame, pairs: DataFrame) -> DataFrame:
    """(t, to, s, d): candidates of ``rows`` among accepted signatures before them, by equal SHA-256 and by pairs of values (ph, other, d)."""
    by_sha = accepted.where(F.col("sha").isNotNull()).groupBy("sha").agg(F.min("t").alias("at"), F.min_by("row_id", "t").alias("to"), F.min_by("ph", "t").alias("other"))
    by_ph = accepted.where(F.col("ph").isNotNull()).groupBy("ph").agg(F.min("t").alias("at"), F.min_by("row_id", "t").alias("to"), F.min_by(F.when(F.col("sha").isNotNull(), F.xxhash64("sha")), "t").alias("s64"))
    before = F.col("at") < F.col("t")
    n = rows.count()
    same = salted_join(rows.select("sha", "t", "ph").where(F.col("sha").isNotNull()), by_sha, ["sha"], hot_buckets(rows, ["sha"], n)).where(before)
    same = same.select("t", "to", F.lit("same").alias("s"), _distance(F.bit_count(F.col("ph").bitwiseXOR(F.col("other")))).alias("d"))
    hashed = rows.where(F.col("ph").isNotNull()).select("ph", "t", F.when(F.col("sha").isNotNull(), F.xxhash64("sha")).alias("own"))
    hot = hot_buckets(hashed, ["ph"], n)
    looks = salted_join(hashed, pairs.select("ph", "other", "d"), ["ph"], hot).select("t", "own", "other", "d").unionByName(hashed.select("t", "own", F.col("ph").alias("other"), F.lit(0).alias("d")))
    near = salted_join(looks, by_ph.withColumnRenamed("ph", "other"), ["other"], hot_buckets(looks, ["other"], n)).where(before)
    return same.unionByName(near.select("t", "to", _agreement(F.col("own"), F.col("s64")).alias("s"), _distance(F.col("d")).alias("d")))


def begin(rows: DataFrame, linked: bool = False, path: str | None = None) -> History:
    """A history of rows that are all accepted. ``linked``: it begins with the clusters among these rows, found once."""
    spark = rows.sparkSession
    scratch = Scratch(spark)
    order = Order(rows)
    known = scratch.put(identified(rows, order), "known")
    n = known.count()
    blocks = hamming.plan_for(n).blocks
    history = History(spark, path, n, hamming.crowded_blocks(known, "ph", blocks), blocks)
    if n:
        history.accept(known, copies=True)
    if linked and n:
        signatures = scratch.put(known.groupBy("sha", "ph").agg(F.min("t").alias("t"), F.count("*").alias("n")).withColumn("row_id", order.row(F.col("t"))), "signatures")
        probe = hamming.packed(signatures, "ph", history.plan).groupBy("slot").agg(F.collect_list("phs").alias("new"))
        within = scratch.put(probe.mapInArrow(_among(history.plan), PAIR).where(F.col("d") <= hamming.RADIUS), "within")
        within = within.unionByName(within.select(F.col("other").alias("ph"), F.col("ph").alias("other"), "d"))
        links = scratch.put(links_among(signatures, signatures, within), "links")
        history.counts = _patterns(links)
        links = scratch.put(_scored(links, history.counts).select("t", "to", "score"), "scored")
        history.represent(signatures, links, known, signatures, scratch)
    history._close_delivery(n)
    scratch.drop()
    release(spark)
    return history


def found(manifest: DataFrame) -> DataFrame:
    """Cases of all later batches, taken as one delivery in order, against batch 0."""
    history = begin(manifest.where("batch_no = 0"))
    cases = history.ingest(manifest.where("batch_no > 0"))
    history.close(delete=True)  # the cases are written
    return cases


def clusters(manifest: DataFrame) -> DataFrame:
    """(row_id, class_id, links): of every identified row its class and how many accepted rows it links before it.

    The class is read off the history's kept representatives and roots: class_id is the smallest row_id of the representatives
    merged into it. A copy has the links of the first row with its hashes and, if that row was accepted, one to it. Rows that
    history holds aren't compared again.
    """
    history = begin(manifest.where("batch_no = 0"), linked=True)
    history.ingest(manifest.where("batch_no > 0"))
    rows = identified(manifest.where("batch_no >= 0"), Order(manifest)).select("row_id")
    own = rows.join(history.table(REPS).select("row_id", "rep", "links"), "row_id", "left")
    own = own.select("row_id", F.coalesce("rep", "row_id").alias("node"), F.coalesce("links", F.lit(0)).alias("links"))
    named = own.join(history.roots(), "node", "left").select("row_id", F.coalesce("root", "node").alias("class_id"), "links")
    out = materialise(named, "clusters")
    history.close(delete=True)
    return out
