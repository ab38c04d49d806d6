"""Blocking keys under which all 64-bit values within Hamming distance 4 meet, packed into slots.

A value falls into ``blocks`` blocks of bits; of two values that differ in at most four bits, ``blocks`` - 4 blocks agree. So
each value has one key per choice of that many blocks: 15 keys of about 21 bits for 6 blocks, 35 of 27 for 7, 70 of 32 for 8,
126 of 35 for 9, 210 of 38 for 10. ``plan_for`` takes what costs least for the counted number of values, so that keys grow longer
as values grow more, and meetings by chance stay few per value. A pair that agrees in more blocks meets under several keys;
it counts under the first only, which needs no distinct over pairs.

Where values crowd in all blocks of a key (say, blank images), that key is replaced by 15 longer ones: the remaining bits fall
into six sub-blocks, of which again two must agree. Nothing is lost and nothing capped. Which blocks are crowded is counted
over all values; that table has at most 10 x 2048 rows.

A key is a mask: two values meet under it if they agree in its bits. Keys of one mask are spread by a hash over 2 ** ``bits``
slots of some ten thousand values. Tasks put values into slots as packed bytes, so what is shuffled, stored and joined is
one row per task and slot, never one per key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import combinations
from math import comb, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RADIUS = 4
#: A block value is crowded if it holds more than one in CROWDED_SHARE values, and at least CROWDED_ROWS.
CROWDED_SHARE, CROWDED_ROWS = 256, 1000
#: Values of a slot, about; values that a task packs at once; meetings that are compared at once.
SLOT, HELD, MOST = 1 << 15, 1 << 18, 1 << 20
#: Microseconds that a key of a value costs.
KEY_COST = 1.0
SUBS = tuple(combinations(range(6), 2))
_FULL = (1 << 64) - 1


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


@dataclass(frozen=True)
class Plan:
    """Which keys values have; ``crowded`` names the crowded values of each block, in place."""

    blocks: int
    bits: int
    crowded: tuple[tuple[int, ...], ...] = ()

    @cached_property
    def ranges(self) -> list[tuple[int, int]]:
        """(lowest bit, width) of each block."""
        cuts = [64 * i // self.blocks for i in range(self.blocks + 1)]
        return [(a, b - a) for a, b in zip(cuts, cuts[1:])]

    @cached_property
    def choices(self) -> list[tuple[int, ...]]:
        return list(combinations(range(self.blocks), self.blocks - RADIUS))

    @cached_property
    def block_masks(self) -> np.ndarray:
        return np.array([_mask(list(range(a, a + w))) for a, w in self.ranges], dtype=np.uint64)

    @cached_property
    def sub_masks(self) -> np.ndarray:
        """By choice, the masks of the six sub-blocks of all other bits."""
        out = []
        for choice in self.choices:
            free = [a + k for b, (a, w) in enumerate(self.ranges) if b not in choice for k in range(w)]
            cut = [len(free) * s // 6 for s in range(7)]
            out.append([_mask(free[cut[s] : cut[s + 1]]) for s in range(6)])
        return np.array(out, dtype=np.uint64)

    @cached_property
    def masks(self) -> np.ndarray:
        """By tag, the bits of its keys. Tag c is choice c; tag (s + 1) x choices + c is c with the s-th pair of sub-blocks."""
        plain = np.array([np.bitwise_or.reduce(self.block_masks[list(c)]) for c in self.choices], dtype=np.uint64)
        longer = [plain | self.sub_masks[:, i] | self.sub_masks[:, j] for i, j in SUBS]
        return np.concatenate([plain, *longer])

    @cached_property
    def _first(self) -> np.ndarray:
        """By which blocks agree (as bits), the choice of the first that do, or -1."""
        k = self.blocks - RADIUS
        number = {c: n for n, c in enumerate(self.choices)}
        agreeing = [tuple(b for b in range(self.blocks) if m >> b & 1)[:k] for m in range(1 << self.blocks)]
        return np.array([number.get(a, -1) for a in agreeing])

    @cached_property
    def _first_sub(self) -> np.ndarray:
        number = {c: n for n, c in enumerate(SUBS)}
        return np.array([number.get(tuple(b for b in range(6) if m >> b & 1)[:2], -1) for m in range(64)])

    @staticmethod
    def _agree(x: np.ndarray, masks: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), dtype=np.int64)
        for i, m in enumerate(masks):
            out |= ((x & m) == 0).astype(np.int64) << i
        return out

    def first_meeting(self, tag: int, x: np.ndarray) -> np.ndarray:
        """Whether ``tag`` is the first under which two values meet; x is a xor b."""
        choice, sub = tag % len(self.choices), tag // len(self.choices) - 1
        ok = self._first[self._agree(x, self.block_masks)] == choice
        if sub >= 0 and ok.any():
            ok &= self._first_sub[self._agree(x, self.sub_masks[choice])] == sub
        return ok

    def agreeing(self, x: np.ndarray) -> np.ndarray:
        """The number of blocks in which two values agree; x is a xor b."""
        return np.bitwise_count(self._agree(x, self.block_masks).astype(np.uint64)).astype(np.int64)

    def tag_of(self, slot: int) -> int:
        return int(slot) >> self.bits

    def slots(self, values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(slots, values) for all keys of uint64 values, a tag at a time."""
        tables = []
        for (_, width), bad in zip(self.ranges, self.crowded):
            table = np.zeros(1 << width, dtype=bool)
            table[list(bad)] = True
            tables.append(table if bad else None)
        for c, choice in enumerate(self.choices):
            rest = values
            if tables and all(tables[b] is not None for b in choice):
                crowd = np.ones(len(values), dtype=bool)
                for b in choice:
                    low, width = self.ranges[b]
                    crowd &= tables[b][((values >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64)]
                some, rest = values[crowd], values[~crowd]
                if len(some):
                    for s in range(len(SUBS)):
                        yield self._slot((s + 1) * len(self.choices) + c, some), some
            if len(rest):
                yield self._slot(c, rest), rest

    def _slot(self, tag: int, values: np.ndarray) -> np.ndarray:
        h = (values & self.masks[tag]) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (tag << self.bits) + (h >> np.uint64(64 - self.bits)).astype(np.int64)


def plan_for(n: int, crowded: tuple[tuple[int, ...], ...] | None = None, blocks: int | None = None, meeting_cost: float = 0.015) -> Plan:
    """The cheapest plan for n values; ``meeting_cost`` is what comparing two values costs, in microseconds."""

    def cost(b: int) -> float:
        keys = comb(b, RADIUS)
        return keys * (KEY_COST + n / 2 ** (64 * (b - RADIUS) / b) * meeting_cost)

    blocks = blocks or min(range(6, 11), key=cost)
    bits = max(2, int(np.ceil(log2(max(n, 1) / SLOT))) if n > SLOT else 2)
    return Plan(blocks, bits, crowded or ())


def _values(column: pa.Array) -> np.ndarray:
    return np.asarray(column.drop_null()).view(np.uint64)


def crowded_blocks(values: DataFrame, column: str, blocks: int) -> tuple[tuple[int, ...], ...]:
    """By block, its crowded values; at most 10 x CROWDED_SHARE numbers in all. ``values`` should hold few copies."""
    ranges = Plan(blocks, 2).ranges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(1 << w, dtype=np.int64) for _, w in ranges]
        for batch in batches:
            v = _values(batch.column(0))
            for table, (low, width) in zip(counts, ranges):
                table += np.bincount(((v >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64), minlength=len(table))
        for b, table in enumerate(counts):
            some = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), b, dtype=np.int32)), pa.array(some.astype(np.int32)), pa.array(table[some])], names=["block", "bits", "n"])

    counts = values.select(column).mapInArrow(run, "block int, bits int, n bigint").groupBy("block", "bits").agg(F.sum("n").alias("n"))
    n = F.sum("n").over(_all_of_block())
    rows = counts.withColumn("total", n).where((F.col("n") > CROWDED_ROWS) & (F.col("n") * CROWDED_SHARE > F.col("total"))).collect()
    found: list[set[int]] = [set() for _ in ranges]
    for r in rows:
        found[r["block"]].add(int(r["bits"]))
    return tuple(tuple(sorted(f)) for f in found)


def _all_of_block():
    from pyspark.sql import Window

    return Window.partitionBy("block")


def packed(values: DataFrame, column: str, plan: Plan) -> DataFrame:
    """(slot, phs): the keys of a bigint column's values, as packed bytes per task and slot; nulls have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            for slots, found in plan.slots(np.unique(np.concatenate(held))):
                order = np.argsort(slots, kind="stable")
                slots = slots[order]
                start = np.flatnonzero(np.r_[True, slots[1:] != slots[:-1]])
                offsets = (np.r_[start, len(slots)] * 8).astype(np.int32)
                data = pa.py_buffer(np.ascontiguousarray(found[order]))
                blobs = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), data])
                yield pa.RecordBatch.from_arrays([pa.array(slots[start]), blobs], names=["slot", "phs"])

        for batch in batches:
            v = _values(batch.column(0))
            if len(v):
                held.append(v)
                n += len(v)
            if n >= HELD:
                yield from flush()
                held, n = [], 0
        if held:
            yield from flush()

    return values.select(column).mapInArrow(run, "slot bigint, phs binary")


def unpacked(blobs) -> np.ndarray:
    """The distinct values of a list of packed bytes."""
    return np.unique(np.frombuffer(b"".join(blobs), dtype=np.uint64))


def meetings(plan: Plan, tag: int, a: np.ndarray, b: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(values of a, values of b, distance) of all pairs that meet under a tag first, at most ``reach`` apart; in pieces."""
    mask = plan.masks[tag]
    key = b & mask
    order = np.argsort(key, kind="stable")
    key, b = key[order], b[order]
    wanted = a & mask
    first = np.searchsorted(key, wanted, side="left")
    sizes = np.searchsorted(key, wanted, side="right") - first
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    for at in range(0, total, MOST):
        k = np.arange(at, min(at + MOST, total))
        p = np.searchsorted(ends, k, side="right")
        q = first[p] + k - (ends[p] - sizes[p])
        x = a[p] ^ b[q]
        d = np.bitwise_count(x)
        keep = np.flatnonzero(d <= reach)
        keep = keep[plan.first_meeting(tag, x[keep])]
        if len(keep):
            yield a[p[keep]], b[q[keep]], d[keep].astype(np.int32)
