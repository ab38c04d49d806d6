"""A compressed full-text index over words of equal length, searched backwards for many patterns at once.

The text is the words, one after the other. As a symbol's place in its word is known, the suffixes that begin at one place are
sorted among themselves, so the Burrows-Wheeler transform falls into one column per place: the symbols that precede the sorted
suffixes of the next place. Each column is kept as a wavelet matrix, that is as bits with counts of ones, ``width`` bits and some
counts per symbol. Nothing else of the text is kept but one sample per word (its number at its first place): words are read
back out of the index by the last-to-first mapping.

A step of backward search is one rank query at either end of each pattern's range. A pattern's maximal matches with each word
are found by following the mapping from every row of its range: the symbols come out one by one and are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class Bits:
    """Bits with the number of ones before each place."""

    def __init__(self, bits: np.ndarray) -> None:
        size = -(-(len(bits) + 1) // 64) * 64
        padded = np.zeros(size, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words)
        self.before = np.zeros(len(ones), dtype=np.uint32)
        np.cumsum(ones[:-1], out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)


class Column:
    """A wavelet matrix over one column of the transform, with the mapping into the sorted suffixes one place before."""

    def __init__(self, symbols: np.ndarray, width: int) -> None:
        self.width, self.levels = width, []
        start = np.r_[0, np.cumsum(np.bincount(symbols, minlength=1 << width))]
        for level in range(width - 1, -1, -1):
            bits = (symbols >> level) & 1
            zeros = len(bits) - int(np.count_nonzero(bits))
            self.levels.append((Bits(bits), zeros))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])
        self.start = start  # rows of smaller symbols
        every = np.arange(1 << width)
        self.shift = start[:-1] - self._down(every, np.zeros(1 << width, dtype=np.int64))

    def _down(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        for k, (bits, zeros) in enumerate(self.levels):
            one = bits.rank(row)
            row = np.where((symbol >> (self.width - 1 - k)) & 1, zeros + one, row - one)
        return row

    def map(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Where the suffixes before ``row`` that this symbol precedes end up: smaller symbols' rows and as many of its own."""
        return self.shift[symbol] + self._down(symbol, row)

    def step(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol that precedes each suffix, and the row of the longer suffix."""
        symbol = np.zeros(len(row), dtype=np.int64)
        for bits, zeros in self.levels:
            bit, one = bits.get(row), bits.rank(row)
            symbol = (symbol << 1) | bit
            row = np.where(bit, zeros + one, row - one)
        return symbol, self.shift[symbol] + row


class ShardIndex:
    def __init__(self, words: np.ndarray, width: int) -> None:
        """``words``: integers below 2 ** width, one row per word."""
        self.size, self.length = words.shape
        order = np.arange(self.size, dtype=np.uint32)
        columns = []
        for c in range(self.length - 1, -1, -1):
            symbols = words[order, c]
            columns.append(Column(symbols.astype(np.int64), width))
            order = order[np.argsort(symbols.astype(np.uint16) if width <= 16 else symbols, kind="stable")]
        self.columns = columns[::-1]
        self.sample = order  # number of each word, by the rank of the word

    def search(self, patterns: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern, first, end): the patterns whose last ``least`` symbols occur at words' ends, and their ranges of suffixes."""
        alive = np.arange(len(patterns))
        first = np.zeros(len(patterns), dtype=np.int64)
        end = np.full(len(patterns), self.size, dtype=np.int64)
        for c in range(self.length - 1, self.length - 1 - least, -1):
            symbol, column = patterns[alive, c].astype(np.int64), self.columns[c]
            if c == self.length - 1:
                first, end = column.start[symbol], column.start[symbol + 1]
            else:
                first, end = column.map(symbol, first), column.map(symbol, end)
            some = end > first
            alive, first, end = alive[some], first[some], end[some]
        return alive, first, end

    def matches(self, patterns: np.ndarray, least: int, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(pattern, word, span, symbols): every pair that agrees in its last ``least`` symbols, how many it agrees in from the end without a break, and the word's other symbols; in pieces of at most ``most``."""
        alive, first, end = self.search(patterns, least)
        sizes = end - first
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        for at in range(0, total, most):
            k = np.arange(at, min(at + most, total))
            which = np.searchsorted(ends, k, side="right")
            row = first[which] + k - (ends[which] - sizes[which])
            pattern = alive[which]
            span = np.full(len(k), least, dtype=np.int64)
            symbols = np.zeros((len(k), self.length - least), dtype=np.int64)
            unbroken = np.ones(len(k), dtype=bool)
            for c in range(self.length - least - 1, -1, -1):
                symbols[:, c], row = self.columns[c].step(row)
                unbroken &= symbols[:, c] == patterns[pattern, c]
                span += unbroken
            yield pattern, self.sample[row], span, symbols
