"""The nearest of a list of 64-bit hashes, within a radius.

Of two hashes within the radius, one of the four 16-bit quarters differs in at most a fourth of it. Shards are a quarter and
the first bits of its value; a row goes to four of them, a listed hash to each within so many flips of those bits. How many bits
that takes follows the counted list, so that a shard's part of it stays below MOST_HASHES, whatever the list's size; rows of a
shard are spread over as many tasks as they need, to each of which goes that part. Within a shard, hashes are found by their
quarter: a row looks up all patterns of so many flips.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.session import materialise

#: Hashes of the list in one shard, about; rows that a task of a shard takes, about; rows packed at once.
MOST_HASHES, TASK_ROWS, HELD = 100_000, 1 << 20, 1 << 17


def patterns(bits: int, flips: int) -> np.ndarray:
    """All numbers of ``bits`` bits with at most ``flips`` ones."""
    return np.array([sum(1 << b for b in ones) for k in range(min(flips, bits) + 1) for ones in combinations(range(bits), k)], dtype=np.int64)


def quarter_of(values: np.ndarray, q: int) -> np.ndarray:
    return ((values >> np.uint64(16 * q)) & np.uint64(0xFFFF)).astype(np.int64)


class HashList:
    """Listed hashes, in order of their ids, found by one quarter."""

    def __init__(self, hashes: np.ndarray, ids: np.ndarray, quarter: int, radius: int = 10) -> None:
        order = np.argsort(ids, kind="stable")
        self.hashes, self.ids, self.quarter, self.radius = hashes[order], ids[order], quarter, radius
        key = quarter_of(self.hashes, quarter)
        self.order = np.argsort(key, kind="stable")
        self.starts = np.searchsorted(key[self.order], np.arange(65537))
        self.patterns = patterns(16, radius // 4)

    def nearest(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distance, place) of each value, nearest first and then of the least id; distance 65 where this quarter finds none."""
        best = np.full(len(values), 65 << 32, dtype=np.int64)
        for at in range(0, len(values), 2048):
            part = values[at : at + 2048]
            probes = (quarter_of(part, self.quarter)[:, None] ^ self.patterns[None, :]).reshape(-1)
            first, sizes = self.starts[probes], self.starts[probes + 1] - self.starts[probes]
            ends = np.cumsum(sizes)
            for lo in range(0, int(ends[-1]), 1 << 21):
                k = np.arange(lo, min(lo + (1 << 21), int(ends[-1])))
                p = np.searchsorted(ends, k, side="right")
                j = self.order[first[p] + k - (ends[p] - sizes[p])]
                i = p // len(self.patterns)
                distance = np.bitwise_count(part[i] ^ self.hashes[j]).astype(np.int64)
                close = distance <= self.radius
                np.minimum.at(best, at + i[close], (distance[close] << 32) | j[close])
        return best >> 32, best & 0xFFFFFFFF


def _sharded(rows: DataFrame, listed: bool, bits: int, flips: int, salts: int) -> DataFrame:
    """(shard, salt, listed, ids, hashes): packed pieces of ``rows`` (row_id, ph) per shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moved = patterns(bits, flips) if listed else np.zeros(1, dtype=np.int64)

        def flush(ids: np.ndarray, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
            for q in range(4):
                top = quarter_of(hashes, q) >> (16 - bits)
                shard = ((top[:, None] ^ moved[None, :]) | (q << bits)).reshape(-1)
                who = np.repeat(np.arange(len(ids)), len(moved))
                order = np.argsort(shard, kind="stable")
                shard, who = shard[order], who[order]
                start = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
                cuts = pa.py_buffer((np.r_[start, len(shard)] * 8).astype(np.int32))
                blob = lambda x: pa.Array.from_buffers(pa.binary(), len(start), [None, cuts, pa.py_buffer(np.ascontiguousarray(x[who]))])
                columns = [pa.array(shard[start]), pa.array(np.zeros(len(start), dtype=np.int64)), pa.array([listed] * len(start)), blob(ids), blob(hashes)]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "salt", "listed", "ids", "hashes"])

        for batch in batches:
            for at in range(0, batch.num_rows, HELD):
                ids, hashes = (np.asarray(c.slice(at, HELD)) for c in batch.columns)
                yield from flush(ids.astype(np.int64), hashes.view(np.uint64))

    out = rows.mapInArrow(run, "shard bigint, salt bigint, listed boolean, ids binary, hashes binary")
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")))
    return out.withColumn("salt", every) if listed else out.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts)))


def _search(bits: int, radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, index = None, [], None
        for batch in batches:
            for shard, salt, listed, ids, hashes in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if (shard, salt) != now:
                    now, held, index = (shard, salt), [], None
                ids, hashes = np.frombuffer(ids, dtype=np.int64), np.frombuffer(hashes, dtype=np.uint64)
                if listed:
                    held.append((ids, hashes))
                    continue
                if not held:
                    continue
                index = index or HashList(np.concatenate([h for _, h in held]), np.concatenate([i for i, _ in held]), shard >> bits, radius)
                values, back = np.unique(hashes, return_inverse=True)  # copies are looked up once
                distance, at = (x[back] for x in index.nearest(values))
                hit = distance <= radius
                if hit.any():
                    yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(distance[hit]), pa.array(index.ids[at[hit]])], names=["row_id", "distance", "match_id"])

    return run


def nearest_hash(rows: DataFrame, listed: DataFrame, radius: int = 10) -> DataFrame:
    """(row_id, distance, match_id): for rows (row_id, ph) the nearest of ``listed`` (row_id, ph; distinct ph), ties by row_id."""
    values = rows.where(F.col("ph").isNotNull()).select("row_id", "ph")
    listed = materialise(listed.where(F.col("ph").isNotNull()).select("row_id", "ph"), "listed")
    n, flips = listed.count(), radius // 4
    bits = next((b for b in range(13) if n * len(patterns(b, flips)) <= MOST_HASHES << b), 13)
    salts = max(1, values.count() // TASK_ROWS >> bits)
    pieces = _sharded(listed, True, bits, flips, salts).unionByName(_sharded(values, False, bits, flips, salts))
    met = pieces.repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.desc("listed"))
    found = met.mapInArrow(_search(bits, radius), "row_id bigint, distance bigint, match_id bigint")
    best = F.min(F.struct("distance", "match_id")).alias("b")
    return found.groupBy("row_id").agg(best).select("row_id", "b.*")


def eval_only_list(rows: DataFrame) -> DataFrame:
    """The distinct perceptual hashes of evaluation-only rows, each under its smallest row_id."""
    return rows.where((F.col("split") == "eval_only") & F.col("ph").isNotNull()).groupBy("ph").agg(F.min("row_id").alias("row_id"))
