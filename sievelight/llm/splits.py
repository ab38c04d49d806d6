"""Splits that keep related records together.

Records that share a key are related, and relation is transitive. ``components`` finds what hangs together by
Hash-to-Min: every node holds a cluster, and in each round sends its cluster to the cluster's minimum and the minimum to
all of its cluster, until nothing changes. Records are first collapsed to their distinct key tuples with a map-side
aggregation, so a tuple that a third of all rows share is one node. ``assign_splits`` then gives each component a split by
weighted rendezvous hashing.

Defined results: a record with a null in every link is related to nothing and forms a component of its own; an empty
table gives empty results; repeated rows count each; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.functions.normal import SPLITS, name_of, split_of
from sievelight.operators.skew import hot_join, uniform
from sievelight.session import materialise

#: Components that hold more than one in HEAVY rows are placed one by one; there are fewer than HEAVY of them.
HEAVY = 10_000
#: Most splits that may be asked for.
MOST_TARGETS = 1000


def hash_to_min(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes in ``edges`` (a, b): component is the least node of what is connected.

    Clusters are kept as (holder, member) rows, never as lists, so the cluster of a minimum may be of any size, and the rows of a
    holder with many are spread. It ends when a round changes no row.
    """
    flagged = lambda rows, name: materialise(rows.groupBy("holder", "member").agg(F.max("new").alias("new"), F.max("old").alias("old")), name)
    both = edges.select("a", "b").union(edges.select("b", "a")).union(edges.select("a", "a")).union(edges.select("b", "b"))
    state = flagged(both.toDF("holder", "member").where(F.col("holder").isNotNull() & F.col("member").isNotNull()).withColumn("new", F.lit(1)).withColumn("old", F.lit(0)), "clusters")
    while True:
        clusters = state.where("new = 1").select("holder", "member")
        least = clusters.groupBy("holder").agg(F.min("member").alias("least"), F.count("*").alias("size"))
        if state.where("new <> old").isEmpty():
            return least.select(F.col("holder").alias("node"), F.col("least").alias("component"))
        sent = hot_join(clusters, least, ["holder"], "size", clusters.count())
        moves = F.explode(F.array(F.struct(F.col("least").alias("holder"), F.col("member").alias("member")), F.struct(F.col("member").alias("holder"), F.col("least").alias("member"))))
        now = sent.select(moves.alias("m")).select("m.*", F.lit(1).alias("new"), F.lit(0).alias("old"))
        state = flagged(now.unionByName(clusters.withColumn("new", F.lit(0)).withColumn("old", F.lit(1))), "clusters")


def components(rows: DataFrame, ident: str, links: list[list[str]], aggregates: list | None = None, compared: dict[str, Callable] | None = None) -> DataFrame:
    """One row per distinct tuple of the link columns: those columns, ``rows`` (how many rows), ``component`` and the given aggregates.

    ``links`` lists the keys: rows that agree in all columns of a key, none of them null, are related; ``compared`` gives the
    normal form in which a column is compared, taken of the tuples only. So spellings of one key are nodes of their own, which
    the exchange puts together. ``component`` is the smallest ``ident`` among all rows of the component.
    """
    columns = list(dict.fromkeys(c for link in links for c in link))
    forms = {c: F.col(c) if c not in (compared or {}) else compared[c](F.col(c)) for c in columns}
    tuples = rows.groupBy(*columns).agg(F.min(ident).alias("node"), F.count("*").alias("rows"), *(aggregates or []))
    tuples = tuples.select("*", *[forms[c].alias(f"_as_{c}") for c in columns])
    linked = reduce(lambda x, y: x | y, [reduce(lambda x, y: x & y, [F.col(f"_as_{c}").isNotNull() for c in link]) for link in links])
    tuples = materialise(tuples.where(linked), "tuples")
    edges = None
    for link in links:
        key = [f"_as_{c}" for c in link]
        keyed = tuples.dropna("any", subset=key)
        star = keyed.groupBy(*key).agg(F.min("node").alias("a"), F.count("*").alias("_n"))
        found = hot_join(keyed.select("node", *key), star, key, "_n", tuples.count()).select("a", F.col("node").alias("b"))
        edges = found if edges is None else edges.union(found)
    return tuples.drop(*[f"_as_{c}" for c in columns]).join(hash_to_min(edges), "node")


def _score(component: int, split: str, weight: float, seed: int) -> float:
    digest = hashlib.blake2b(f"{component}|{split}|{seed}".encode(), digest_size=8).digest()
    u = ((int.from_bytes(digest, "big") >> 12) + 0.5) / (1 << 52)
    return -weight / math.log(u)


def assign_splits(sizes: DataFrame, targets: list[tuple[str, float, float]], seed: int = 17, attempts: int = 12) -> DataFrame:
    """(component, rows, new_split) of ``sizes`` (component, rows), for ``targets`` of (split, share, tolerance).

    Weighted rendezvous hashing: a component goes to the split s with the largest -weight(s) / ln(u(component, s)).
    Heavy components (fewer than HEAVY) choose first, largest first, among the splits that still have room for them; all
    others choose by expression, with the room that is left as weights. If a share misses its tolerance, the next seed is
    tried; the best of all attempts stays. A component never lies in two splits.
    """
    sizes = materialise(sizes, "sizes")
    spark = sizes.sparkSession
    total = sizes.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    whole = sum(share for _, share, _ in targets) or 1.0
    goal = {s: share / whole * total for s, share, _ in targets}
    heavy = sorted(((r["rows"], r["component"]) for r in sizes.where(F.col("rows") * HEAVY > F.lit(total)).collect()), reverse=True)
    light = sizes.where(F.col("rows") * HEAVY <= F.lit(total))
    best = None
    for attempt in range(attempts):
        now, room, placed = seed + attempt, dict(goal), []
        for n, component in heavy:
            order = sorted(goal, key=lambda s: -_score(component, s, max(goal[s], 1e-9), now))
            chosen = next((s for s in order if room[s] >= n), max(room, key=room.get))
            room[chosen] -= n
            placed.append((component, n, chosen))
        scores = F.array(*[F.struct((-F.lit(max(room[s], 1e-9)) / F.log(uniform("component", F.lit(s), seed=now))).alias("score"), F.lit(s).alias("split")) for s in sorted(goal)])
        chosen = F.array_max(scores)["split"]
        given = light.select("component", "rows", chosen.alias("new_split"))
        sums = {r["new_split"]: r["n"] for r in given.groupBy("new_split").agg(F.sum("rows").alias("n")).collect()}
        for _, n, s in placed:
            sums[s] = sums.get(s, 0) + n
        over = max((abs(sums.get(s, 0) - goal[s]) / max(total, 1) - tolerance for s, _, tolerance in targets), default=0)
        if best is None or over < best[0]:
            best = (over, placed, given)
        if over <= 0:
            break
    _, placed, given = best
    fixed = spark.createDataFrame(placed, "component bigint, rows bigint, new_split string")
    return given.unionByName(fixed)


NAMES = {"source": name_of, "generator": name_of}


def torn_groups(manifest: DataFrame) -> DataFrame:
    """Groups of the same source and generator whose rows lie in two or more splits today."""
    bit = F.coalesce(*[F.when(split_of(F.col("split")) == s, F.lit(1 << i)) for i, s in enumerate(SPLITS)], F.lit(0))
    rows = manifest.select("row_id", "source", "generator", bit.alias("bit"))
    groups = components(rows, "row_id", [["source", "generator"]], [F.bit_or("bit").alias("bits")], NAMES)
    torn = groups.groupBy("component").agg(F.bit_or("bits").alias("bits"))
    return torn.where(F.bit_count("bits") >= 2).select(F.col("component").alias("group_row_id"))


def wanted_shares(targets: DataFrame) -> list[tuple[str, float, float]]:
    """(split, share, tolerance); a target without a split or a share is none, one without a tolerance may miss by any amount."""
    found = [tuple(r) for r in targets.select("split", "target_share", "tolerance").dropna(subset=["split", "target_share"]).limit(MOST_TARGETS + 1).collect()]
    if len(found) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} splits")
    return [(s, share, math.inf if tolerance is None else tolerance) for s, share, tolerance in found]


def new_splits(manifest: DataFrame, targets: DataFrame, seed: int = 17) -> DataFrame:
    """(row_id, component, new_split) of every row; rows that miss a name are components of their own."""
    rows = manifest.select("row_id", "source", "generator")
    groups = materialise(components(rows, "row_id", [["source", "generator"]], None, NAMES), "groups")
    single = rows.where(name_of(F.col("source")).isNull() | name_of(F.col("generator")).isNull()).select("row_id")
    sizes = groups.groupBy("component").agg(F.sum("rows").alias("rows")).unionByName(single.select(F.col("row_id").alias("component"), F.lit(1).cast("bigint").alias("rows")))
    given = materialise(assign_splits(sizes, wanted_shares(targets), seed), "given")
    keyed = groups.join(given.select("component", "new_split"), "component")
    total = groups.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    grouped = hot_join(rows, keyed.select("source", "generator", "component", "new_split", "rows"), ["source", "generator"], "rows", total)
    alone = single.join(given.select(F.col("component").alias("row_id"), "new_split"), "row_id")
    return grouped.select("row_id", "component", "new_split").unionByName(alone.select("row_id", F.col("row_id").alias("component"), "new_split"))


def shares(manifest: DataFrame, targets: DataFrame, seed: int = 17) -> DataFrame:
    """Per target split: the rows it was given, their share, whether that lies within the tolerance, and how many groups are torn (none)."""
    given = materialise(new_splits(manifest, targets, seed), "new_splits")
    torn = given.groupBy("component").agg(F.min("new_split").alias("a"), F.max("new_split").alias("b")).where("a <> b").agg(F.count("*").alias("torn"))
    counts = given.groupBy("new_split").agg(F.count("*").alias("rows"))
    total = given.count()
    wanted = targets.select(F.col("split"), "target_share", "tolerance").dropna(subset=["split", "target_share"])
    whole = sum(share for _, share, _ in wanted_shares(targets)) or 1.0
    out = wanted.join(counts.withColumnRenamed("new_split", "split"), "split", "left").crossJoin(F.broadcast(torn))
    share = F.coalesce("rows", F.lit(0)) / F.lit(max(total, 1))
    within = F.coalesce(F.abs(share - F.col("target_share") / whole) <= F.col("tolerance"), F.lit(True))
    return out.select("split", F.coalesce("rows", F.lit(0)).alias("rows"), share.alias("share"), within.alias("within"), "torn")
