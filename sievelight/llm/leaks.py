"""Evaluation texts that leak into training text.

Items are cut into windows, and so are a document's words, at every position. Each window has a SimHash of 64 bits over its
words; as alike windows have near fingerprints, all window pairs within a radius are candidates: the fingerprint falls into
radius + 1 blocks, of which one must be equal, so no pair within the radius is missed. A candidate is verified by the weighted
similarity of its shingles (five words, weighted by their rarity among the items): it is a leak from SIMILAR on.

``near_leaks`` takes windows of the items' sizes: lengths fall into classes a quarter apart, and an item is searched by its
windows of the longest class that it fills. So edited passages are found as well. ``leaks`` takes windows of the shortest
passage that counts (WINDOW words), and of the verified candidates those whose words are the same, in order.

The items, which do not grow, are broadcast in blocks of at most MOST_WINDOWS windows; each block is one pass over the
documents, with no shuffle. So the work follows the documents' length, and a document of any length is one row.

Defined results: words are maximal runs of letters and digits in lower case; null and empty texts, and texts or items shorter
than WINDOW words, match nothing; an item that a document quotes several times comes out once; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, SHINGLE, RADIUS = 12, 5, 3
#: Least similarity of shingles, and the radius within which windows of an item's size are compared.
SIMILAR, NEAR_RADIUS = 0.8, 7
#: Item windows in one broadcast: below 16 MB.
MOST_WINDOWS = 100_000
#: Words of which a task holds bit counts at once.
PIECE = 60_000


def words(text):
    """Hashes (64 bits) of the words of a text, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.xxhash64(F.lower(w)))


def fingerprints(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """SimHash of the window that starts at each position; positions without a whole window have none."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.empty(n, dtype=np.uint64)
    for at in range(0, n, PIECE):
        part = hashes[at : min(at + PIECE, n) + window - 1].view(np.uint64)
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts = np.zeros((len(part) + 1, 64), dtype=np.int32)
        np.cumsum(bits, axis=0, out=counts[1:])
        ones = counts[window:] - counts[:-window]
        out[at : at + len(ones)] = np.packbits(ones * 2 > window, axis=1, bitorder="little").view(np.uint64).reshape(-1)
    return out


class ItemWindows:
    """All windows of one length of a block of items, found by fingerprint."""

    def __init__(self, items: list[tuple[int, np.ndarray]], window: int = WINDOW, radius: int = RADIUS) -> None:
        self.window, self.radius = window, radius
        prints, rows, ids = [np.zeros(0, dtype=np.uint64)], [np.zeros((0, window), dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for ident, hashes in items:
            f = fingerprints(hashes, window)
            if len(f):
                prints.append(f)
                rows.append(np.lib.stride_tricks.sliding_window_view(hashes, window))
                ids.append(np.full(len(f), ident, dtype=np.int64))
        self.prints, self.rows, self.ids = np.concatenate(prints), np.concatenate(rows), np.concatenate(ids)
        self.width = 64 // (radius + 1)
        self.blocks = []
        for b in range(radius + 1):
            key = self._key(self.prints, b)
            order = np.argsort(key, kind="stable")
            self.blocks.append((np.searchsorted(key[order], np.arange((1 << self.width) + 1)), order))
        # rarity of a shingle: the fewer item windows hold it, the heavier
        self.shingles, counts = np.unique(self._shingle(self.rows).reshape(-1), return_counts=True)
        self.weights = 1.0 / counts

    def _key(self, prints: np.ndarray, block: int) -> np.ndarray:
        return ((prints >> np.uint64(block * self.width)) & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def _shingle(self, rows: np.ndarray) -> np.ndarray:
        """Hashes of the shingles of each window; order within a shingle counts."""
        out = np.zeros((len(rows), self.window - SHINGLE + 1), dtype=np.uint64)
        for k in range(SHINGLE):
            with np.errstate(over="ignore"):
                out = out * np.uint64(0x9E3779B97F4A7C15) + rows[:, k : self.window - SHINGLE + 1 + k].view(np.uint64)
                out ^= out >> np.uint64(29)
        return out

    def similarity(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Weighted share of the shingles of a that b holds too, row by row of two lists of windows."""
        x, y = self._shingle(a), self._shingle(b)
        at = np.minimum(np.searchsorted(self.shingles, x), max(len(self.shingles) - 1, 0))
        weight = np.where(self.shingles[at] == x, self.weights[at], 1.0)
        shared = np.zeros(x.shape, dtype=bool)
        for k in range(y.shape[1]):
            shared |= x == y[:, k : k + 1]
        return (weight * shared).sum(axis=1) / weight.sum(axis=1)

    def matches(self, hashes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, window) of all pairs within the radius that are similar. ``ends``: where each of the texts laid end to end ends."""
        none = np.zeros(0, dtype=np.int64)
        prints = fingerprints(hashes, self.window)
        if not len(prints) or not len(self.prints):
            return none, none
        # a window that crosses from one text into the next is none
        own_end = np.repeat(ends, np.diff(ends, prepend=0))[: len(prints)]
        start = np.flatnonzero(np.arange(self.window, self.window + len(prints)) <= own_end)
        prints = prints[start]
        views = np.lib.stride_tricks.sliding_window_view(hashes, self.window)
        positions, windows = [none], [none]
        for b, (starts, order) in enumerate(self.blocks):
            key = self._key(prints, b)
            first, sizes = starts[key], starts[key + 1] - starts[key]
            cum = np.cumsum(sizes)
            total = int(cum[-1]) if len(cum) else 0
            for at in range(0, total, 1 << 20):
                k = np.arange(at, min(at + (1 << 20), total))
                p = np.searchsorted(cum, k, side="right")
                w = order[first[p] + k - (cum[p] - sizes[p])]
                x = prints[p] ^ self.prints[w]
                close = np.flatnonzero(np.bitwise_count(x) <= self.radius)
                x = x[close]
                lead = np.ones(len(close), dtype=bool)  # a pair counts under its first equal block
                for earlier in range(b):
                    lead &= self._key(x, earlier) != 0
                p, w = p[close[lead]], w[close[lead]]
                for lo in range(0, len(p), 1 << 13):
                    i, j = start[p[lo : lo + (1 << 13)]], w[lo : lo + (1 << 13)]
                    alike = self.similarity(self.rows[j], views[i]) >= SIMILAR
                    positions.append(i[alike])
                    windows.append(j[alike])
        return np.concatenate(positions), np.concatenate(windows)


def classes(longest: int) -> list[int]:
    """Window lengths a quarter apart, from WINDOW on."""
    out = [WINDOW]
    while out[-1] * 5 // 4 <= longest:
        out.append(out[-1] * 5 // 4)
    return out


def _blocks(items: DataFrame, ident: str, text: str) -> list[list[tuple[int, np.ndarray]]]:
    """The items' word hashes, a block at a time; the list holds the items, which do not grow, once."""
    blocks, size = [[]], 0
    for r in items.select(ident, words(F.col(text)).alias("w")).where(F.size("w") >= WINDOW).toLocalIterator():
        n = len(r["w"]) - WINDOW + 1
        if blocks[-1] and size + n > MOST_WINDOWS:
            blocks.append([])
            size = 0
        blocks[-1].append((r[ident], np.array(r["w"], dtype=np.int64)))
        size += n
    return blocks


def _search(documents: DataFrame, items: DataFrame, doc: str, item: str, text: str, make, final) -> DataFrame:
    """(doc, item, windows) by the indexes that ``make`` gives of a block of items; ``final`` says of (words, positions, index, windows) which count."""
    spark = documents.sparkSession
    hashed = documents.select(F.col(doc).cast("bigint").alias("d"), words(F.col(text)).alias("w")).where(F.size("w") >= WINDOW)
    out = None
    for block in _blocks(items, item, text):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            indexes = make(shared.value)
            for batch in batches:
                column = batch.column(1)
                flat = np.asarray(column.flatten())
                ends = np.cumsum(np.asarray(column.value_lengths()))
                docs = np.asarray(batch.column(0))
                found = []
                for index in indexes:
                    p, w = index.matches(flat, ends)
                    keep = final(flat, p, index, w)
                    p, w = p[keep], w[keep]
                    found.append(np.stack([docs[np.searchsorted(ends, p, side="right")], index.ids[w], p], axis=1))
                pairs = np.unique(np.concatenate(found), axis=0)
                if len(pairs):
                    which, counts = np.unique(pairs[:, :2], axis=0, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(which[:, 0]), pa.array(which[:, 1]), pa.array(counts.astype(np.int64))], names=["d", "i", "windows"])

        part = hashed.mapInArrow(run, "d bigint, i bigint, windows bigint")
        out = part if out is None else out.unionByName(part)
    return out.select(F.col("d").alias(doc), F.col("i").alias(item), "windows")


def _same_words(flat: np.ndarray, p: np.ndarray, index: ItemWindows, w: np.ndarray) -> np.ndarray:
    if not len(p):
        return np.zeros(0, dtype=bool)
    views = np.lib.stride_tricks.sliding_window_view(flat, index.window)
    return np.concatenate([(views[p[at : at + (1 << 16)]] == index.rows[w[at : at + (1 << 16)]]).all(axis=1) for at in range(0, len(p), 1 << 16)])


def leaks(documents: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """(doc, item, windows): every document that holds WINDOW or more consecutive words of an item; windows counts its matching positions."""
    return _search(documents, items, doc, item, text, lambda block: [ItemWindows(block)], _same_words)


def by_size(block: list[tuple[int, np.ndarray]]) -> list[ItemWindows]:
    """Indexes of a block's items, each under the longest class of windows that it fills."""
    lengths = classes(max((len(h) for _, h in block), default=WINDOW))
    held: dict[int, list] = {}
    for ident, hashes in block:
        held.setdefault(max(n for n in lengths if n <= len(hashes)), []).append((ident, hashes))
    return [ItemWindows(some, n, NEAR_RADIUS) for n, some in sorted(held.items())]


def near_leaks(documents: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """(doc, item, windows): every document with a window of about an item's size that is similar to one of the item's, edited or not."""
    return _search(documents, items, doc, item, text, by_size, lambda flat, p, index, w: np.ones(len(p), dtype=bool))
