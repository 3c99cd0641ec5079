"""Substring deduplication with FM-indexes over shards.

A window is WINDOW consecutive words. Of the GRAM-word grams in a window the one with the smallest hash, the first of equals, is its anchor,
so equal windows have equal anchors. A segment is a run of windows with one anchor occurrence: at most WINDOW - GRAM + 1 windows.

1. Segments, one row a document and content, are dealt by anchor once and ordered by (anchor, content, document). Anchors that occur
   once are done: nothing repeats there. Of equal segments all windows but those of the smallest document are repeated. Equal means equal
   anchor and equal content, two 64-bit hashes of the words. What is left is written as a table, so that this exchange is made once.
2. Anchors with several contents are sharded by anchor. A shard's distinct segments, ordered as in the corpus, form an FM-index; backward
   search streams every window through it, and intervals of length WINDOW with an earlier position mark a window as repeated.
3. Anchors with more than CONTENTS contents (a passage in very many surroundings) do not go to one shard: their windows are counted by
   window hash, spread over all tasks, which gives the same answer.
4. Each document takes the marks of its segments and drops the covered words.

Anchors that occur in a share of at least HOT of the documents are dealt by content and part of the documents as well, and the parts' first
documents are compared afterwards, so that no task gets all rows of one. They count as anchors of more than CONTENTS contents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text as X
from ._bitmap import bitmap, may_contain
from ._store import drop, release, save
from .fmindex import FMIndex

WINDOW, GRAM, CONTENTS = 20, 8, 256
#: A hot anchor's share of the documents; the part of the documents that shows hot anchors (it steers only how rows are dealt) and their
#: least number there; and the parts among which the rows of one content are dealt.
HOT, SHOWN, LEAST, PARTS = 0.01, 32, 8, 64
#: Words of one FM-index, so a shard's memory.
SHARD_WORDS = 300_000
U = np.uint64


def _first_min(g: np.ndarray, width: int) -> np.ndarray:
    """Index of the first smallest of g[i : i + width] for each i."""
    best, size = np.arange(len(g)), 1
    while size < width:
        step = min(size, width - size)
        a, b = best[:-step], best[step:]
        best = np.where(g[b] < g[a], b, a)
        size += step
    return best


def segments(h: np.ndarray, first: np.ndarray):
    """Row, first window, number of windows, anchor and content hash of each segment."""
    none = np.zeros(0, np.int64)
    if len(h) < WINDOW:
        return none, none, none, none.astype(U), none.astype(U)
    i = np.arange(len(h) - GRAM + 1)
    g = X.spans(h, i, i + GRAM)
    at = _first_min(g, WINDOW - GRAM + 1)
    n = np.maximum(np.diff(first) - WINDOW + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    start = first[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    if not len(start):
        return none, none, none, none.astype(U), none.astype(U)
    anchor = at[start]
    head = np.ones(len(start), bool)
    head[1:] = (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1])
    begin = np.flatnonzero(head)
    windows = np.diff(np.append(begin, len(start)))
    s = start[begin]
    return row[begin], s, windows, g[anchor[begin]], X.spans(h, s, s + windows + WINDOW - 1)


def _firsts(row: np.ndarray, content: np.ndarray) -> np.ndarray:
    """Whether a segment is the first of its content in its row."""
    order = np.lexsort((np.arange(len(row)), content, row))
    new = np.ones(len(row), bool)
    new[1:] = (row[order][1:] != row[order][:-1]) | (content[order][1:] != content[order][:-1])
    out = np.zeros(len(row), bool)
    out[order] = new
    return out


def _words(batch, text):
    for rows, data, at in X.groups(batch, text):
        starts, ends, first = X.words(data, at)
        yield rows, data, starts, ends, first, X.word_hashes(data, starts, ends)


def _anchored(batches):
    for batch in batches:
        for rows, _, _, _, first, h in _words(batch, "text"):
            row, _, _, anchor, content = segments(h, first)
            keep = _firsts(row, content)
            ids = batch.column(0)[rows].take(pa.array(row[keep]))
            yield pa.RecordBatch.from_arrays([pa.array(anchor[keep].view(np.int64)), pa.array(content[keep].view(np.int64)), ids], ["a", "c", "doc_id"])


_PIECE = "a long, c long, doc_id long, start long, large boolean, words array<long>, windows array<long>"


def _pieces(batches):
    """The wanted segments of a document: their words, or for large anchors their windows' hashes."""
    for batch in batches:
        wanted = batch.column(2)
        edge = wanted.offsets.to_numpy()
        inner = wanted.values
        contents, large = (inner.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        for rows, _, _, _, first, h in _words(batch, "text"):
            row, start, windows, anchor, content = segments(h, first)
            keep = _firsts(row, content)
            row, start, windows, anchor, content = row[keep], start[keep], windows[keep], anchor[keep], content[keep]
            found, which = _lookup(row, content, rows, edge, contents)
            row, start, windows, anchor, content = row[found], start[found], windows[found], anchor[found], content[found]
            big = large[which].astype(bool)
            size = np.where(big, 0, windows + WINDOW - 1)
            count = np.where(big, windows, 0)
            flat = h[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            w = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())
            lists = [pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), pa.array(v.view(np.int64))) for n, v in ((size, flat), (count, X.spans(h, w, w + WINDOW)))]
            ids = batch.column(0)[rows].take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), ids, pa.array(start - first[:-1][row]), pa.array(big), *lists], ["a", "c", "doc_id", "start", "large", "words", "windows"])


def _lookup(row, content, rows, edge, contents):
    """Which segments are in their row's list of contents, and where in the lists."""
    span = slice(edge[rows.start], edge[rows.stop])
    owner = np.repeat(np.arange(rows.stop - rows.start), np.diff(edge[rows.start : rows.stop + 1]))
    key = X.mix(contents[span].astype(np.int64).view(U)) + owner.astype(U) * U(0x9E3779B97F4A7C15)
    order = np.argsort(key)
    key = key[order]
    mine = X.mix(content) + row.astype(U) * U(0x9E3779B97F4A7C15)
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(key, mine), len(key) - 1)
    found = np.flatnonzero(key[at] == mine)
    return found, edge[rows.start] + order[at[found]]


def _shard(batches):
    """Marks of the windows of a partition's segments, sorted by anchor; an FM-index for each run of anchors of bounded size."""
    held: list = []
    size = 0
    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        lists = batch.column(4)
        edge, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).view(U)
        for i in range(batch.num_rows):
            if size > SHARD_WORDS and held[-1][0] != cols[0][i]:
                yield _marks(held)
                held, size = [], 0
            held.append((cols[0][i], cols[1][i], cols[2][i], cols[3][i], flat[edge[i] : edge[i + 1]]))
            size += edge[i + 1] - edge[i]
    if held:
        yield _marks(held)


def _marks(held: list) -> pa.RecordBatch:
    held.sort(key=lambda x: (x[2], x[3]))  # text positions follow the corpus
    count = np.array([len(x[4]) for x in held])
    _, words = np.unique(np.concatenate([x[4] for x in held]), return_inverse=True)
    index = FMIndex(words + 1, np.concatenate([[0], np.cumsum(count)]), WINDOW)
    windows = count - WINDOW + 1
    owner = np.repeat(np.arange(len(held)), windows)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    begin = index.at[owner] + nth
    length, low, high = index.matching(begin + WINDOW, WINDOW)
    hit = np.flatnonzero(length == WINDOW)
    late = hit[index.earliest(low[hit], high[hit]) < begin[hit]]
    mask = np.zeros(len(held), np.int64)
    np.bitwise_or.at(mask, owner[late], 1 << nth[late])
    some = np.flatnonzero(mask)
    return pa.RecordBatch.from_arrays([pa.array([held[i][2] for i in some], pa.int64()), pa.array([held[i][1] for i in some], pa.int64()), pa.array(mask[some])], ["doc_id", "c", "mask"])


_OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def _kept(texts: bool):
    def run(batches):
        for batch in batches:
            marks = batch.column(2)
            if marks.null_count:
                marks = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(marks.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int32), marks.flatten())
            edge, inner = marks.offsets.to_numpy(), marks.values
            contents, masks = (inner.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for rows, data, starts, ends, first, h in _words(batch, "text"):
                row, start, windows, _, content = segments(h, first)
                mask = np.where(_firsts(row, content), 0, -1)
                found, which = _lookup(row, content, rows, edge, contents)
                mask[found] |= masks[which].astype(np.int64)
                some = np.flatnonzero(mask)
                nth = np.arange(WINDOW - GRAM + 1)
                seg, j = np.nonzero(((mask[some, None] >> nth) & 1).astype(bool) & (nth < windows[some, None]))
                w = start[some[seg]] + j
                cover = np.zeros(len(h) + 1, np.int64)
                np.add.at(cover, w, 1)
                np.add.at(cover, np.minimum(w + WINDOW, len(h)), -1)
                gone = np.cumsum(cover[:-1]) > 0
                stay = np.flatnonzero(~gone)
                size = ends[stay] - starts[stay] + 1
                stop = np.cumsum(size)
                flat = np.full(stop[-1] if len(stop) else 0, 0x20, np.uint8)
                inside = np.repeat(starts[stay] - (stop - size), size) + np.arange(len(flat))
                blank = np.zeros(len(flat), bool)
                blank[stop - 1] = True
                flat[~blank] = data[inside[~blank]]
                raw = flat.tobytes()
                edges = np.concatenate([[0], stop])[np.searchsorted(stay, first)].tolist()
                kept = [raw[a : max(a, b - 1)] for a, b in zip(edges[:-1], edges[1:], strict=True)]
                total = np.concatenate([[0], np.cumsum(gone)])
                out = [batch.column(0)[rows], pa.array(np.diff(first)), pa.array(np.diff(total[first])), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
                yield pa.RecordBatch.from_arrays([*out, pa.array([k.decode() for k in kept], pa.string()) if texts else pa.nulls(len(kept), pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def _segments(rows: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Segments (a, c, doc_id, late, contents) that repeat or whose anchor has several contents: late where a smaller document has the same
    segment, one row that isn't late for each content. Also the stored tables that they come from."""
    found = rows.mapInArrow(_anchored, "a long, c long, doc_id long")
    part = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(SHOWN)) == 0)
    least = max(LEAST, int(HOT * part.count()))
    hot = save(part.mapInArrow(_anchored, "a long, c long, doc_id long").groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= least).select(F.col("a").alias("hot")), "hot")
    # the shown part's rows divided by `least` bound the hot anchors
    found = found.join(F.broadcast(hot), F.col("a") == F.col("hot"), "left")
    key = F.when(F.col("hot").isNotNull(), F.xxhash64("a", "c", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)))).otherwise(F.col("a"))
    dealt = found.withColumn("key", key).repartition("key")
    content = Window.partitionBy("key", "a", "c").orderBy("doc_id")
    ranked = dealt.withColumns({"d": F.first("doc_id").over(content), "k": F.row_number().over(content)})
    many = F.when(F.col("hot").isNotNull(), F.lit(CONTENTS + 1)).otherwise(F.sum(F.when(F.col("k") == 1, 1).otherwise(0)).over(Window.partitionBy("key", "a")))
    kept = ranked.withColumn("contents", many).withColumn("late", F.col("doc_id") > F.col("d")).where("late or (contents > 1 and k = 1)")
    kept = save(kept.select("a", "c", "doc_id", "late", F.col("contents").cast("long").alias("contents"), F.col("hot").isNotNull().alias("hot")), "parts")
    # the first documents of the parts of a hot anchor's content, at most PARTS rows a content
    firsts = kept.where("hot and not late").groupBy("a", "c").agg(F.array_sort(F.collect_list("doc_id")).alias("ids"))
    firsts = firsts.select("a", "c", F.posexplode("ids").alias("k", "doc_id"), F.element_at("ids", 1).alias("d"))
    firsts = firsts.where("k = 0 or doc_id > d").select("a", "c", "doc_id", (F.col("doc_id") > F.col("d")).alias("late"), F.lit(CONTENTS + 1).cast("long").alias("contents"))
    return kept.where("late or not hot").drop("hot").unionByName(firsts), [kept, hot]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256 and, with texts, kept (the words left, joined by one space).

    A word goes if a window over it also starts earlier: in a smaller id, or before in the same text. Windows are those of the input. Null,
    empty and blank texts have no words. Rows that repeat an id do not count as earlier than each other; a null id is taken as the smallest
    long. Further columns are not read.
    """
    spark = docs.sparkSession
    low = -(1 << 63)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(low)).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known, stored = _segments(rows)
    release(spark)
    want = known.where("not late and contents > 1").groupBy("doc_id").agg(F.collect_list(F.struct("c", (F.col("contents") > CONTENTS).alias("large"))).alias("want"))
    want = save(want, "wanted")
    pieces = may_contain(rows, "doc_id", bitmap(want, "doc_id")).join(want, "doc_id").select("doc_id", "text", "want").mapInArrow(_pieces, _PIECE)
    pieces = save(pieces.dropDuplicates(["a", "c", "doc_id"]), "pieces")
    drop(want)
    small = pieces.where("not large").select("a", "c", "doc_id", "start", "words")
    marks = small.repartition(F.col("a")).sortWithinPartitions("a").mapInArrow(_shard, "doc_id long, c long, mask long")
    window = pieces.where("large").select("c", "doc_id", "start", F.posexplode("windows").alias("j", "w"))
    window = window.select("c", "doc_id", (F.col("start") + F.col("j")).alias("at"), "j", "w")
    earliest = window.groupBy("w").agg(F.min(F.struct("doc_id", "at")).alias("e"), F.count("*").alias("n")).where("n > 1").select("w", "e")
    late = window.join(earliest, "w").where(F.struct("doc_id", "at") > F.col("e"))
    marks = marks.unionByName(late.groupBy("doc_id", "c").agg(F.bit_or(F.expr("shiftleft(1L, j)")).alias("mask")))
    other = known.where("late").select("doc_id", "c", F.lit(-1).cast("long").alias("mask"))
    per_doc = other.unionByName(marks).groupBy("doc_id").agg(F.collect_list(F.struct("c", "mask")).alias("marks"))
    per_doc = save(per_doc, "marks")
    drop(pieces, *stored)
    # only texts that may have marks are moved to them
    bits = bitmap(per_doc, "doc_id")
    marked = may_contain(rows, "doc_id", bits).join(per_doc, "doc_id", "left").select("doc_id", "text", "marks")
    plain = may_contain(rows, "doc_id", bits, False).withColumn("marks", F.lit(None).cast(per_doc.schema["marks"].dataType))
    out = marked.unionByName(plain).mapInArrow(_kept(texts), _OUT)
    out = out.withColumn("doc_id", F.nullif("doc_id", F.lit(low)))
    return out if texts else out.drop("kept")
