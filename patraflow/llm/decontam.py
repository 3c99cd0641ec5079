"""Benchmark decontamination by spaced-seed hashing.

Words are runs of letters and digits with A-Z in lower case. A seed is a window of words of which a fixed mask ignores some, so a substituted
word costs only the masks that look at it. The masks hit every stretch that counts as a leak: its last min(MIN_MATCH, 80 %) equal words end
in suffixes of a positive sum only, which leaves fewer than 2,000 patterns, and each holds one of the masks (tests/llm goes through all).

1. The benchmark's seeds are a table (key, item, position). Its keys, in blocks of at most `block_keys` of them, filter the seeds of all
   texts; one block, so one pass over the documents, holds some 700,000 words of benchmark.
2. Seeds that pass are joined with the table by key. Each pair names a diagonal (document position minus item position).
3. On each distinct diagonal the best stretches (+1 for an equal word, -2 for another) are verified on the words of both.

An item leaks into a document if one of them has at least min(MIN_MATCH, 80 % of the item's words) equal words. Items of fewer than SHORT
words are too common to tell a leak and are ignored. Only the words of documents with a seed in common are moved.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._store import drop, save

MIN_MATCH, SHORT = 13, 8
#: A cover, found greedily, of the patterns above by masks of weight 6.
MASKS = ("10110111", "10010001111", "10100010111", "1110111", "110001111", "1101111")
_SPACE = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
U = np.uint64
_STEP = [U(pow(0x8CB92BA72F3D8DD7, j + 1, 1 << 64)) for j in range(max(map(len, MASKS)))]


def _hashes(batch, column):
    for rows, data, at in X.groups(batch, column):
        data = X.lower(data)
        starts, ends, first = X.words(data, at, _SPACE)
        yield rows, X.word_hashes(data, starts, ends), first


def seeds(h: np.ndarray, mask: str) -> np.ndarray:
    """The hash of the mask's seed at each word (as if all words were one row)."""
    n = len(h) - len(mask) + 1
    if n < 1:
        return np.zeros(0, U)
    return X.mix(sum((h[j : j + n] * _STEP[j] for j in range(len(mask)) if mask[j] == "1"), U(MASKS.index(mask) + 1) * np.ones(n, U)))


def all_seeds(h: np.ndarray, first: np.ndarray):
    """Keys of all masks' seeds, their rows and their positions in the rows."""
    keys, rows, at = [np.zeros(0, U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for mask in MASKS:
        key = seeds(h, mask)
        begin = np.arange(len(key))
        row = np.searchsorted(first, begin, "right") - 1
        inside = begin + len(mask) <= first[row + 1]
        keys.append(key[inside])
        rows.append(row[inside])
        at.append((begin - first[:-1][row])[inside])
    return np.concatenate(keys), np.concatenate(rows), np.concatenate(at)


def stretch(own: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int, int] | None:
    """Equal words, words, first word in the document and in the item of the leak with the most equal words on a diagonal, if there is one.
    The diagonal falls into parts where the sum from the part's begin would turn negative; each part has its best stretch."""
    low, high = max(0, -diagonal), min(len(item), len(own) - diagonal)
    need = min(MIN_MATCH, math.ceil(0.8 * len(item)))
    equal = own[low + diagonal : high + diagonal] == item[low:high]
    sums = np.concatenate([[0], np.cumsum(np.where(equal, 1, -2))])
    least = np.minimum.accumulate(sums)
    parts = np.flatnonzero(np.concatenate([[True], least[1:] < least[:-1], [True]]))
    best = None
    for begin, stop in zip(parts[:-1].tolist(), parts[1:].tolist(), strict=True):
        if stop - begin > need:
            end = begin + int(sums[begin:stop].argmax())
            matched = int(equal[begin:end].sum())
            if matched >= need and (best is None or matched > best[0]):
                best = matched, end - begin, low + begin + diagonal, low + begin
    return best


def _items(batches):
    for batch in batches:
        for rows, h, first in _hashes(batch, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0)[rows], batch.column(1)[rows], pa.ListArray.from_arrays(first.astype(np.int32), pa.array(h.view(np.int64)))], ["item", "id", "words"])


def _item_seeds(batches):
    for batch in batches:
        words = batch.column(1)
        first = words.offsets.to_numpy().astype(np.int64)
        key, row, at = all_seeds(words.values.to_numpy(zero_copy_only=False).view(U)[first[0] : first[-1]], first - first[0])
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0).take(pa.array(row)), pa.array(at)], ["key", "item", "at"])


def benchmark_items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Stored (item, id, words): items of SHORT words or more with a number of their own; null ids and repeated items are kept."""
    texts = benchmark.select(F.expr("uuid()").alias("item"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return save(texts.mapInArrow(_items, "item string, id long, words array<long>").where(f"size(words) >= {SHORT}"), "items")


def _passing(keys: np.ndarray):
    """Of each document with a seed among the keys: its words and these seeds."""
    may = np.zeros(1 << 22, bool)
    may[keys >> U(42)] = True
    none = len(keys) == 0

    def run(batches):
        for batch in batches:
            for rows, h, first in _hashes(batch, "text"):
                key, row, at = all_seeds(h, first) if not none else (keys, np.zeros(0, np.int64), np.zeros(0, np.int64))
                hit = np.flatnonzero(may[key >> U(42)])
                hit = hit[keys[np.minimum(np.searchsorted(keys, key[hit]), len(keys) - 1)] == key[hit]] if len(hit) else hit
                hit = hit[np.argsort(row[hit], kind="stable")]
                some, count = np.unique(row[hit], return_counts=True)
                size = np.diff(first)[some]
                flat = h[np.repeat(first[:-1][some] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
                lists = [pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), v) for n, v in ((size, pa.array(flat.view(np.int64))), (count, pa.array(key[hit].view(np.int64))), (count, pa.array(at[hit])))]
                kept = [batch.column(c)[rows].take(pa.array(some)) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*kept, *lists], ["doc_id", "tid", "words", "keys", "places"])

    return run


def _verified(batches):
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            own, item = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (3, 4))
            if found := stretch(own, item, batch.column(5)[i].as_py()):
                out.append((i, *found))
        cols = [np.array(c, np.int64) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(cols[0])) for c in range(3)), *map(pa.array, cols[1:])], _FOUND)


_FOUND = ["doc_id", "tid", "item_id", "n_match", "n_words", "doc_start", "item_start"]


def _leaks(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, block_keys: int) -> DataFrame:
    """Verified stretches with _FOUND's columns, of each (doc_id, tid) and item the best. tid is a hash of the text."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("tid"), text.alias("text"))
    items = benchmark_items(benchmark)
    table = save(items.select("item", "words").mapInArrow(_item_seeds, "key long, item string, at long"), "seeds")
    n = max(1, -(-table.count() // block_keys))
    hits = None
    for b in range(n):
        keys = table.where(F.pmod("key", F.lit(n)) == b).select("key").distinct().toArrow()["key"].to_numpy()  # about block_keys
        found = rows.mapInArrow(_passing(np.sort(keys.view(U))), "doc_id long, tid long, words array<long>, keys array<long>, places array<long>")
        hits = found if hits is None else hits.unionByName(found)
    hits = save(hits, "hits")
    seeds_ = hits.select("doc_id", "tid", F.explode(F.arrays_zip("keys", "places")).alias("x")).select("doc_id", "tid", F.col("x.keys").alias("key"), F.col("x.places").alias("place"))
    met = seeds_.join(table, "key").select("doc_id", "tid", "item", (F.col("place") - F.col("at")).alias("diagonal")).distinct()
    words = hits.select(F.col("doc_id").alias("d"), F.col("tid").alias("t"), F.col("words").alias("own")).dropDuplicates(["d", "t"])
    both = met.join(words, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tid") == F.col("t"))).join(items, "item")
    schema = ", ".join(f"{c} long" for c in _FOUND)
    found = both.select("doc_id", "tid", "id", "own", "words", "diagonal").mapInArrow(_verified, schema)
    best = found.groupBy("doc_id", "tid", "item_id").agg(F.max(F.struct("n_match", F.struct((-F.col("doc_start")).alias("d"), (-F.col("item_start")).alias("i"), "n_words").alias("x"))).alias("m"))
    out = save(best.select("doc_id", "tid", "item_id", "m.n_match", "m.x.n_words", (-F.col("m.x.d")).alias("doc_start"), (-F.col("m.x.i")).alias("item_start")), "leaks")
    drop(items, table, hits)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_keys: int = 1 << 22) -> DataFrame:
    """One row per document (doc_id and text) and item that leaks into it: doc_id, item_id, n_match, n_words, doc_start, item_start (words
    from 0) of the stretch with the most equal words, the first of equals. Null, empty and clean texts give no row; repeated rows give one,
    and so do items that share an id. Null ids, of documents and of items, are values like others.
    """
    return _leaks(docs, benchmark, id_col, text_col, block_keys).drop("tid")


#: Leaking rows up to this number are sent to all tasks; more are joined.
SENT = 1 << 20


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_keys: int = 1 << 22) -> DataFrame:
    """The rows of docs, all columns as they are, into which no item leaks. Null texts and null ids stay."""
    found = save(_leaks(docs, benchmark, id_col, text_col, block_keys).select(F.col("doc_id").alias("_leak_id"), F.col("tid").alias("_leak_tid")).distinct(), "leaking")
    found = F.broadcast(found) if found.count() <= SENT else found
    same = F.col(id_col).cast("long").eqNullSafe(F.col("_leak_id")) & (F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) == F.col("_leak_tid"))
    return docs.join(found, same, "left_anti")
