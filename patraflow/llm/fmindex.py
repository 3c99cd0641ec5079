"""A compressed FM-index over word numbers: a wavelet matrix of packed bit vectors with block ranks, and backward search in batches."""

from __future__ import annotations

import numpy as np

U = np.uint64


class Bits:
    """A packed bit vector with rank."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(U)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))[:-1]])
        self.ones = int(bits.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each i."""
        w = i >> 6
        return self.before[w] + np.bitwise_count(self.words[w] & ((U(1) << (i & 63).astype(U)) - U(1))).astype(np.int64)


class Wavelet:
    """A wavelet matrix; rank of symbols in prefixes."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.bits, self.zeros = [], []
        v = values
        for level in range(self.levels - 1, -1, -1):
            b = (v >> level) & 1
            self.bits.append(Bits(b))
            self.zeros.append(len(v) - int(b.sum()))
            v = np.concatenate([v[b == 0], v[b == 1]])
        self.start = self._walk(np.arange(symbols), np.zeros(symbols, np.int64))

    def _walk(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, (bits, zeros) in enumerate(zip(self.bits, self.zeros, strict=True)):
            one = (c >> (self.levels - 1 - level)) & 1
            r = bits.rank(i)
            i = np.where(one == 1, zeros + r, i - r)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c is among the first i values."""
        return self._walk(c, i) - self.start[c]


class FMIndex:
    """Of texts (word numbers from 1, borders at): suffixes are ordered up to `depth` words, which bounds the patterns searched for."""

    def __init__(self, words: np.ndarray, at: np.ndarray, depth: int):
        count = np.diff(at)
        self.text = np.zeros(len(words) + len(count), np.int64)  # a 0 ends each text
        self.at = at[:-1] + np.arange(len(count))
        self.place = np.arange(len(words)) + np.repeat(np.arange(len(count)), count)
        self.text[self.place] = words
        self.suffix = _sorted_suffixes(self.text, depth)
        self.symbols = int(self.text.max(initial=0)) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.text, minlength=self.symbols))])
        self.last = Wavelet(self.text[self.suffix - 1], self.symbols)

    def extend(self, c: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of the patterns with word c put before them."""
        return self.first[c] + self.last.rank(c, low), self.first[c] + self.last.rank(c, high)

    def matching(self, ends: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Streams the pattern that ends before each text position of `ends` leftwards: its matching statistic (words matched elsewhere too,
        up to the threshold) and its suffix interval. A pattern that occurs once stops."""
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), len(self.text))
        length = np.zeros(len(ends), np.int64)
        live = np.arange(len(ends))
        for t in range(1, threshold + 1):
            c = self.text[ends[live] - t]
            a, b = self.extend(c, low[live], high[live])
            on = b - a >= 2
            live = live[on]
            low[live], high[live], length[live] = a[on], b[on], t
        return length, low, high

    def earliest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The smallest text position in each interval; intervals are equal or disjoint."""
        if not len(low):
            return low
        key, back = np.unique(low, return_inverse=True)
        stop = np.zeros(len(key), np.int64)
        stop[back] = high
        edges = np.stack([key, stop], 1).ravel()
        return np.minimum.reduceat(np.append(self.suffix, len(self.suffix)), edges)[::2][back]


def _sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array by prefix doubling, up to `depth` words; ties in text order."""
    n, size = len(text), 1
    rank = text.copy()
    while size < depth:
        after = np.zeros(n, np.int64)
        after[: max(0, n - size)] = rank[size:] + 1
        pair = rank * (n + 2 + int(rank.max(initial=0))) + after
        _, rank = np.unique(pair, return_inverse=True)
        size *= 2
    return np.argsort(rank, kind="stable")
