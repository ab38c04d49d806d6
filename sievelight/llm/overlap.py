"""Same or near-same records across splits.

Values, not rows, are compared: a hash that a third of all rows share is one word. Evaluation values are put into shards, by the
slots of ``hamming`` (perceptual hashes) or by their first digits (SHA-256), and each shard is held as a compressed full-text
index (``ShardIndex``); the training values that fall into the shard are streamed through backward search. A shard has some ten
thousand words whatever the size of the tables: their number grows, not they.

A SHA-256 is a word of 16 symbols and matches only as a whole. A perceptual hash is a word of its blocks, written so that the
blocks of the shard's key stand last. Searched backward, these must match; from there each match is extended to the first block
that differs, which gives its maximal span, and the rest of the word, read back out of the index, gives the exact distance. A
pair that matches in several shards has a span in each; they are merged into the one of the first key both values share, with
the number of blocks they agree in. Matching values are then joined with their rows.

Defined results: hashes that identify nothing and rows in no split match nothing; a pair that matches by both hashes comes
out once; an empty table gives no pair; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.functions.normal import EVALUATION_SPLITS, name_of, phash_of, sha256_bytes, split_of
from sievelight.llm import hamming
from sievelight.llm.fulltext import ShardIndex
from sievelight.operators.skew import hot_buckets, salted_join
from sievelight.session import Scratch, materialise

#: Microseconds to read a word back out of an index and compare it.
READ_COST = 1.0
SIDES = "slot bigint, e boolean, packed binary"


def compared_rows(manifest: DataFrame) -> DataFrame:
    """row_id, whether the row is one of evaluation (else of training), SHA-256 as binary, perceptual hash as bigint."""
    rows = manifest.select("row_id", split_of(F.col("split")).alias("_split"), sha256_bytes(F.col("sha256")).alias("_sha"), phash_of(F.col("phash")).alias("_ph"))
    rows = rows.where(F.col("_split").isin("train", *EVALUATION_SPLITS) & (F.col("_sha").isNotNull() | F.col("_ph").isNotNull()))
    return rows.select("row_id", (F.col("_split") != "train").alias("e"), F.col("_sha").alias("sha"), F.col("_ph").alias("ph"))


def _fields(plan: hamming.Plan, tag: int) -> list[list[int]]:
    """The bits of each symbol of a shard's words; those of its key stand last."""
    choice = plan.choices[tag % len(plan.choices)]
    blocks = [list(range(low, low + width)) for low, width in plan.ranges]
    held = [blocks[b] for b in choice]
    sub = tag // len(plan.choices) - 1
    if sub < 0:
        return [b for i, b in enumerate(blocks) if i not in choice] + held
    cut = [[b for b in range(64) if int(m) >> b & 1] for m in plan.sub_masks[tag % len(plan.choices)]]
    pair = hamming.SUBS[sub]
    return [b for i, b in enumerate(cut) if i not in pair] + [cut[i] for i in pair] + held


def _symbols(values: np.ndarray, fields: list[list[int]]) -> np.ndarray:
    out = np.zeros((len(values), len(fields)), dtype=np.uint16)
    for c, bits in enumerate(fields):
        if bits[-1] - bits[0] == len(bits) - 1:
            out[:, c] = (values >> np.uint64(bits[0])) & np.uint64((1 << len(bits)) - 1)
        else:
            for k, b in enumerate(bits):
                out[:, c] |= (((values >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)).astype(np.uint16)
    return out


def near_in_shard(plan: hamming.Plan, slot: int, e: np.ndarray, t: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(evaluation value, training value, distance, blocks they agree in) of the pairs that this shard comes first for."""
    tag = plan.tag_of(slot)
    fields = _fields(plan, tag)
    least = plan.blocks - hamming.RADIUS + (2 if tag >= len(plan.choices) else 0)
    index = ShardIndex(_symbols(e, fields), max(map(len, fields)))
    patterns = _symbols(t, fields)
    for pattern, word, span, rest in index.matches(patterns, least):
        # what follows the span's end differs at once, so one whose rest has more than so many symbols unlike is too far
        apart = np.bitwise_count(rest ^ patterns[pattern, : rest.shape[1]]).sum(axis=1, dtype=np.int64)
        keep = np.flatnonzero(apart <= hamming.RADIUS)
        a, b = e[word[keep]], t[pattern[keep]]
        first = plan.first_meeting(tag, a ^ b)
        merged = np.maximum(span[keep], plan.agreeing(a ^ b)) if tag < len(plan.choices) else plan.agreeing(a ^ b)
        if first.any():
            yield a[first], b[first], apart[keep][first], merged[first]


def _near(plan: hamming.Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slot, es, ts in zip(*(c for c in batch.columns)):
                for a, b, d, blocks in near_in_shard(plan, slot.as_py(), hamming.unpacked(es.as_py()), hamming.unpacked(ts.as_py())):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(d.astype(np.int32)), pa.array(blocks.astype(np.int32))], names=["ph", "ph_t", "d", "blocks"])

    return run


def _packed_shas(rows: DataFrame, bits: int) -> DataFrame:
    """(slot, e, packed): distinct SHA-256 values per task, side and shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list] = {True: [], False: []}
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for e, parts in held.items():
                if not parts:
                    continue
                values = np.frombuffer(b"".join(pc.unique(pa.concat_arrays(parts)).to_pylist()), dtype=np.uint8).reshape(-1, 32)
                slots = (np.ascontiguousarray(values[:, :8]).view(">u8").reshape(-1) >> np.uint64(64 - bits)).astype(np.int64)
                order = np.argsort(slots, kind="stable")
                slots = slots[order]
                start = np.flatnonzero(np.r_[True, slots[1:] != slots[:-1]])
                blobs = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer((np.r_[start, len(slots)] * 32).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values[order]))])
                yield pa.RecordBatch.from_arrays([pa.array(slots[start]), pa.array([e] * len(start)), blobs], names=["slot", "e", "packed"])
                held[e] = []

        for batch in batches:
            e = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), dtype=bool)
            for side in (True, False):
                some = batch.column(1).filter(pa.array(e == side)).cast(pa.binary())
                if len(some):
                    held[side].append(some)
                    n += len(some)
            if n >= hamming.HELD:
                yield from flush()
                n = 0
        yield from flush()

    return rows.select("e", "sha").where(F.col("sha").isNotNull()).mapInArrow(run, SIDES)


def _same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for es, ts in zip(batch.column(1), batch.column(2)):
            e, t = (np.frombuffer(b"".join(x.as_py()), dtype=np.uint16).reshape(-1, 16) for x in (es, ts))
            hit, _, _ = ShardIndex(e, 16).search(t, 16)
            if len(hit):
                found = pc.unique(pa.array([t[k].tobytes() for k in hit], pa.binary()))
                yield pa.RecordBatch.from_arrays([found], names=["sha"])


def _by_shard(sides: DataFrame) -> DataFrame:
    """(slot, es, ts): the packed values of either side, of the shards that have both."""
    both = sides.groupBy("slot").agg(F.collect_list(F.when(F.col("e"), F.col("packed"))).alias("es"), F.collect_list(F.when(~F.col("e"), F.col("packed"))).alias("ts"))
    return both.where((F.size("es") > 0) & (F.size("ts") > 0))


def matching_values(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The SHA-256 values found on both sides, and (ph, ph_t, d, blocks): values of evaluation and training within the radius."""
    n = rows.count()
    bits = hamming.plan_for(n).bits
    same = scratch.put(_by_shard(_packed_shas(rows, bits)).mapInArrow(_same, "sha binary"), "same")
    blocks = hamming.plan_for(n, meeting_cost=READ_COST).blocks
    plan = hamming.plan_for(n, hamming.crowded_blocks(rows, "ph", blocks), blocks)
    side = lambda e: hamming.packed(rows.where(F.col("e") == e), "ph", plan).select("slot", F.lit(e).alias("e"), F.col("phs").alias("packed"))
    near = scratch.put(_by_shard(side(True).unionByName(side(False))).mapInArrow(_near(plan), "ph bigint, ph_t bigint, d int, blocks int"), "near")
    return same, near


def overlaps(manifest: DataFrame) -> DataFrame:
    """(row_e, row_t, kind): every matching pair of an evaluation row and a training row, once. kind: same, near or both."""
    scratch = Scratch(manifest.sparkSession)
    rows = scratch.put(compared_rows(manifest), "rows")
    same, near = matching_values(rows, scratch)
    n = rows.count()
    e, t = rows.where("e"), rows.where("NOT e")
    shas, phs = hot_buckets(rows, ["sha"], n), hot_buckets(rows, ["ph"], n)
    of = lambda d, row, sha, ph: d.select(F.col("row_id").alias(row), F.col("sha").alias(sha), F.col("ph").alias(ph))
    half = salted_join(of(e, "row_e", "sha", "pe"), same, ["sha"], shas)
    by_sha = salted_join(of(t, "row_t", "sha", "pt"), half, ["sha"], shas)
    alike = F.bit_count(F.col("pe").bitwiseXOR(F.col("pt"))) <= hamming.RADIUS
    by_sha = by_sha.select("row_e", "row_t", F.when(alike, F.lit("both")).otherwise(F.lit("same")).alias("kind"))
    half = salted_join(of(e, "row_e", "es", "ph"), near.select("ph", "ph_t"), ["ph"], phs)
    by_phash = salted_join(of(t, "row_t", "ts", "ph_t"), half.select("row_e", "es", "ph_t"), ["ph_t"], phs)
    by_phash = by_phash.where(~F.coalesce(F.col("es") == F.col("ts"), F.lit(False))).select("row_e", "row_t", F.lit("near").alias("kind"))
    out = materialise(by_sha.unionByName(by_phash), "pairs")
    scratch.drop()
    return out


def found(manifest: DataFrame) -> DataFrame:
    pairs = overlaps(manifest)
    return pairs.select(F.least("row_e", "row_t").alias("row_id_a"), F.greatest("row_e", "row_t").alias("row_id_b"))


def overlap_report(manifest: DataFrame) -> DataFrame:
    """Per evaluation split and source (as named there): pairs by kind, evaluation rows and training rows concerned."""
    attributes = manifest.select(F.col("row_id").alias("row_e"), split_of(F.col("split")).alias("split"), name_of(F.col("source")).alias("source"))
    joined = overlaps(manifest).join(attributes, "row_e")
    return joined.groupBy("split", "source").agg(
        F.count("*").alias("pairs"),
        F.count_if(F.col("kind") != "near").alias("pairs_same"),
        F.count_if(F.col("kind") != "same").alias("pairs_near"),
        F.count_distinct("row_e").alias("rows_evaluation"),
        F.count_distinct("row_t").alias("rows_training"),
    )
