"""Whole Arrow batches of texts as NumPy arrays: words, word hashes and n-gram hashes without a Python loop over words.

Work is cut into groups of rows of about LIMIT bytes, so memory follows the longest single text and not the batch. Hashes go through a
mixer at each step (eight bytes of a word; two halves of a sequence), so no algebra of a polynomial makes structured texts collide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import _worker  # noqa: F401

LIMIT = (1 << 20) - 8
U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Longer words are hashed one by one.
_LONG = 512
_held: tuple = (None, None)


def held(key, build):
    """What build() gives, kept in this process until something else is (None: nothing): a worker that serves several operators holds the
    tables of one."""
    global _held
    if _held[0] != key:
        _held = (None, None)
        _held = (key, build())
    return _held[1]


def groups(batch: pa.RecordBatch, column: str, limit: int = LIMIT) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Rows, their UTF-8 bytes, and where each row's bytes begin (one more for the end). A null text has no bytes."""
    texts = batch.column(batch.schema.get_field_index(column))
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
        yield slice(i, j), raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, at: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte positions of the words' starts and ends, and for each row the number of its first word (one more for the end)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(at), np.int64)
    inside = ~space[data]
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    before[at[:-1][at[:-1] < len(data)]] = False
    after[at[1:][at[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the bytes [start, end) of each word."""
    size = ends - starts
    eight = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    h = mix(mix(size.astype(U) + U(0x9E3779B97F4A7C15)) ^ (eight[starts] & _MASK[np.minimum(size, 8)]))
    more = np.flatnonzero((size > 8) & (size <= _LONG))
    k = 8
    while len(more):
        h[more] = mix(h[more] * U(0xD6E8FEB86659FD93) ^ (eight[starts[more] + k] & _MASK[np.minimum(size[more] - k, 8)]))
        k += 8
        more = more[size[more] > k]
    for i in np.flatnonzero(size > _LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return h


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of a sequence from those of its two halves."""
    return mix(a * U(0xA0761D6478BD642F) + b)


def spans(h: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the word sequences [begin, end), none of them empty: of the first and the last 2**level words, which cover it, and the length."""
    size = end - begin
    level = np.frexp(size.astype(float))[1] - 1
    out = np.zeros(len(begin), U)
    table, width = h, 1
    for k in range(int(level.max(initial=0)) + 1):
        at = slice(None) if len(level) and level.min() == level.max() == k else np.flatnonzero(level == k)
        out[at] = joined(joined(table[begin[at]], table[end[at] - width]), size[at].astype(U))
        table = joined(table[:-width], table[width:])
        width *= 2
    return out


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each shingle of k words; a row with 1 to k - 1 words has one, its whole sequence."""
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    row = np.repeat(np.arange(len(n)), count)
    begin = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[:-1][row]
    return row, spans(h, begin, np.minimum(begin + k, first[1:][row]))


def distinct(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash) pairs, sorted by row, then hash."""
    order = np.argsort(h)
    order = order[np.argsort(row[order].astype(np.uint16 if len(row) and row[-1] < 65536 else np.int64), kind="stable")]
    row, h = row[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[keep], h[keep]
