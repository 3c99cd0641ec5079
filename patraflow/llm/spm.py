"""SentencePiece encoding and decoding over a lattice of pieces.

Texts split into units that no piece crosses: between two characters that stand side by side in no piece. One pass counts the units of all
documents; those that occur most, at most DICTIONARY of them, go through the relational lattice: their substrings of bounded length are
exploded and joined with the piece table by equality, the edges are grouped by unit, and a fold from left to right with Spark's higher-order
`aggregate` keeps for each node its best path. Their ids meet the documents' units by equality again.

The public vocabulary is a BPE model. Adding up piece scores does not give its segmentation, so the fold's step is BPE's own order: an edge
extends a node only if no merge over their border precedes the merges that made the two pieces. Pairs of edges that meet in a unit are
joined, their distinct pieces are tested once, and each edge carries the pieces that may stand before it; one edge then enters each node.
`fold_scores` is the same fold with additive scores, for unigram piece tables.

Units outside the dictionary (rare ones, whose occurrences would be moved twice by a join) run through the same lattice, edges and test on
Arrow batches, in `encode_units`. Which units are in the dictionary changes the speed, not the ids.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._store import drop, save

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
U = np.uint64
#: Units of the dictionary at most, and bytes of one: together the bound of what is collected and sent to the workers.
DICTIONARY, UNIT_BYTES = 1 << 17, 32


class Table:
    """Values (from 0) of 64-bit hashes, by open addressing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(6, int(3 * len(keys)).bit_length())
        self.shift, self.mask = U(64 - bits), (1 << bits) - 1
        self.key, self.value = np.zeros(1 << bits, U), np.full(1 << bits, -1, np.int32)
        left, slot = np.arange(len(keys)), (keys >> self.shift).astype(np.int64)
        while len(left):
            free = self.value[slot] < 0
            own, first = np.unique(slot[free], return_index=True)
            put = left[free][first]
            self.key[own], self.value[own] = keys[put], values[put]
            stay = ~np.isin(left, put)
            left, slot = left[stay], (slot[stay] + 1) & self.mask

    def get(self, h: np.ndarray) -> np.ndarray:
        """The hashes' values; -1 where there is none."""
        slot = (h >> self.shift).astype(np.int64)
        out = self.value[slot].astype(np.int64)
        other = np.flatnonzero((out >= 0) & (self.key[slot] != h))
        while len(other):
            slot = (slot if len(slot) == len(other) else slot[other]) + 1 & self.mask
            out[other] = self.value[slot]
            on = (out[other] >= 0) & (self.key[slot] != h[other])
            other, slot = other[on], slot[on]
        return out


class Pieces:
    """The piece table: bytes (with a space for the space sign), merge order and, for each piece, its last merge."""

    def __init__(self, rows: list[tuple[int, str, float, str]]):
        """rows: id, piece, score, kind (normal, byte, control or unknown)."""
        self.size = len(rows)
        self.byte = np.zeros(256, np.int64)
        self.unknown = next((i for i, _, _, k in rows if k == "unknown"), 0)
        self.text = [b""] * self.size
        self.control = np.zeros(self.size, bool)
        for i, piece, _, kind in rows:
            if kind == "byte":
                self.byte[int(piece[3:5], 16)] = i
                self.text[i] = bytes([int(piece[3:5], 16)])
            elif kind == "normal":
                self.text[i] = piece.replace(SPACE, " ").encode()
            else:
                self.control[i] = True
        self.has_bytes = any(k == "byte" for *_, k in rows)
        normal = {p.replace(SPACE, " "): (i, s) for i, p, s, k in rows if k == "normal"}
        order = {p: n for n, (p, _) in enumerate(sorted(normal.items(), key=lambda x: (-x[1][1], x[1][0])))}
        # a merge happens as soon as both sides stand, so its time is at least that of its sides
        self.rank = np.full(self.size + 1, -1, np.int64)
        self.left, self.right = np.arange(self.size + 1), np.arange(self.size + 1)
        pairs: dict[tuple[int, int], int] = {}
        self.valid = np.zeros(self.size + 1, bool)
        for p, (i, _) in normal.items():
            if len(p) == 1:
                self.valid[i] = True
                continue
            self.rank[i] = order[p]
            for c in range(1, len(p)):
                if (a := normal.get(p[:c])) and (b := normal.get(p[c:])):
                    pairs[a[0], b[0]] = i
            if (cut := _last_merge(p, order)) is not None:
                self.left[i], self.right[i] = normal[p[:cut]][0], normal[p[cut:]][0]
                self.valid[i] = True
        keys = np.array([a * (self.size + 1) + b for a, b in pairs], np.int64)
        self.merged = Table(X.mix(keys.view(U)), np.array(list(pairs.values()), np.int64))
        encoded = [(p.encode(), i) for p, (i, _) in normal.items() if self.valid[i]]
        self.longest = max((len(p) for p in normal), default=1)
        self.normal = [(p, i) for p, (i, _) in normal.items() if self.valid[i]]
        # one table for pieces and beginnings of pieces: twice the id (of none: the number of ids), and 1 more for what begins a longer piece
        begins = {p[:c].encode() for p in normal for c in range(1, len(p))}
        self.known = _index([p for p, _ in encoded] + (more := sorted(begins - {p for p, _ in encoded})), [2 * i + (p in begins) for p, i in encoded] + [2 * self.size + 1] * len(more))
        # bytes that stand side by side, in two characters of a piece
        self.side = np.zeros((256, 256), bool)
        for p in normal:
            for x, y in zip(p, p[1:], strict=False):
                self.side[x.encode()[-1], y.encode()[0]] = True
        lengths = np.array([len(t) for t in self.text], np.int64)
        self.begin, self.length = np.cumsum(lengths) - lengths, lengths
        self.flat = np.frombuffer(b"".join(self.text) or b"\0", np.uint8)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces a and b, side by side, are what merging their characters gives."""
        a, b = a.copy(), b.copy()
        out = np.ones(len(a), bool)
        live = np.flatnonzero((a < self.size) & (b < self.size))
        limit = np.full(len(a), 1 << 40)
        while len(live):
            x, y = a[live], b[live]
            over = self.merged.get(X.mix((x * (self.size + 1) + y).view(U)))
            bad = (over >= 0) & (self.rank[over] < limit[live])
            out[live[bad]] = False
            live, x, y = live[~bad], x[~bad], y[~bad]
            rx, ry = self.rank[x], self.rank[y]
            more = (rx >= 0) | (ry >= 0)
            live, x, y, rx, ry = live[more], x[more], y[more], rx[more], ry[more]
            first = rx > ry
            limit[live] = np.where(first, rx, ry + 1)
            a[live] = np.where(first, self.right[x], x)
            b[live] = np.where(first, y, self.left[y])
        return out


def _last_merge(piece: str, order: dict[str, int]) -> int | None:
    """Where the last merge of the piece's own characters joins; None if merging does not make the piece."""
    parts = list(piece)
    while len(parts) > 2:
        best = min(((order[s], i) for i in range(len(parts) - 1) if (s := parts[i] + parts[i + 1]) in order), default=None)
        if best is None:
            return None
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return len(parts[0]) if len(parts) == 2 and all(len(p) == 1 or p in order for p in parts) and all(p in order for p in parts) else None


def _index(texts: list[bytes], values: list[int]) -> Table:
    at = np.cumsum([0, *(len(t) for t in texts)])
    return Table(X.word_hashes(np.frombuffer(b"".join(texts) or b"\0", np.uint8), at[:-1], at[1:]), np.array(values, np.int64))


@lru_cache(1)
def load(path: str = MODEL) -> Pieces:
    return Pieces(piece_rows(path))


def _pieces(path: str) -> Pieces:
    """In a worker."""
    return X.held(("pieces", path), lambda: Pieces(piece_rows(path)))


def piece_rows(path: str = MODEL) -> list[tuple[int, str, float, str]]:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: "byte" if sp.is_byte(i) else "unknown" if sp.is_unknown(i) else "control" if sp.is_control(i) or sp.is_unused(i) else "normal"
    return [(i, sp.id_to_piece(i), sp.get_score(i), kind(i)) for i in range(sp.get_piece_size())]


def _ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices begin[i] ... begin[i] + size[i] - 1 of every i, one after the other."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


def encode_units(data: np.ndarray, at: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all units (bytes data, borders at), and how many each has."""
    chars = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    first = np.searchsorted(chars, at)
    count = np.diff(first)
    end = np.repeat(first[1:], count)
    edges = np.full((pieces.longest + 1, len(chars)), -1, np.int32)
    live = np.arange(len(chars) - 1)
    for size in range(1, pieces.longest + 1):
        live = live[live + size <= end[live]]
        if not len(live):
            break
        found = pieces.known.get(X.word_hashes(data, chars[live], chars[live + size]))
        ok = (found >= 0) & (found >> 1 < pieces.size)
        edges[size, live[ok]] = found[ok] >> 1
        if size == 1:
            edges[1, live[~ok]] = pieces.size
        live = live[(found >= 0) & (found & 1 == 1)]
    order = np.argsort(-count, kind="stable")
    begin, size = first[:-1][order], count[order]
    node = begin + order  # a unit has one node more than characters
    last, step = np.full(len(chars) + len(count), pieces.size, np.int64), np.zeros(len(chars) + len(count), np.int32)
    for t in range(1, (int(size[0]) if len(size) else 0) + 1):
        k = int(np.searchsorted(-size, -t, "right"))
        lanes, prevs, ids, sizes = [], [], [], []
        for n in range(1, min(t, pieces.longest) + 1):
            e = edges[n, begin[:k] + t - n]
            lane = np.flatnonzero(e >= 0)
            if len(lane):
                lanes.append(lane)
                ids.append(e[lane].astype(np.int64))
                prevs.append(last[node[lane] + t - n] if n < t else np.full(len(lane), pieces.size))
                sizes.append(np.full(len(lane), n))
        lane, prev, new, n = (np.concatenate(x) for x in (lanes, prevs, ids, sizes))
        ok = pieces.compatible(prev, new)
        last[node[lane[ok]] + t] = new[ok]
        step[node[lane[ok]] + t] = n[ok]
    # backwards from the last nodes, all units in step
    out = []
    lane, t = np.arange(len(order)), size.copy()
    while len(lane := lane[t[lane] > 0]):
        back = step[node[lane] + t[lane]]
        if not back.all():
            raise ValueError("a node of the lattice has no path")
        t[lane] -= back
        out.append((lane, t[lane], last[node[lane] + t[lane] + back]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(len(count), np.int64)
    lane, t, ids = (np.concatenate(x) for x in zip(*out, strict=True))
    unit = order[lane]
    sort = np.lexsort((t, unit))
    unit, char, ids = unit[sort], (begin[lane] + t)[sort], ids[sort]
    width = np.where(ids == pieces.size, chars[char + 1] - chars[char] if pieces.has_bytes else 1, 1)
    full = np.repeat(ids, width)
    if (ids == pieces.size).any():
        raw = _ragged(chars[char], width)
        full = np.where(full == pieces.size, pieces.byte[data[np.minimum(raw, len(data) - 1)]] if pieces.has_bytes else pieces.unknown, full)
    return full, np.bincount(np.repeat(unit, width), minlength=len(count))


class Dictionary:
    """Pieces of units: their bytes, and ids in one array."""

    def __init__(self, data: np.ndarray, at: np.ndarray, ids: np.ndarray, count: np.ndarray):
        self.data, self.at, self.ids, self.count = data, at, ids, count
        self.begin = np.cumsum(count) - count
        self.table = Table(X.word_hashes(data, at[:-1], at[1:]), np.arange(len(count)))

    def __reduce__(self):
        return Dictionary, (self.data, self.at, self.ids, self.count)

    def find(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Numbers of the units [begin, end) with hashes h, -1 where there is none; a hit has the same bytes."""
        out = self.table.get(h)
        hit = np.flatnonzero(out >= 0)
        n = out[hit]
        same = _equal(data, begin[hit], end[hit], self.data, self.at[n], self.at[n + 1])
        out[hit[~same]] = -1
        return out


def _equal(data, begin, end, other, start, stop) -> np.ndarray:
    """Whether the bytes [begin, end) of data are those of [start, stop) of other, eight at a time."""
    size = end - begin
    same = size == stop - start
    a, b = (np.ndarray(len(x) + 1, "<u8", np.concatenate([x, np.zeros(8, np.uint8)]), strides=(1,)) for x in (data, other))
    live, k = np.flatnonzero(same & (size > 0)), 0
    while len(live):
        differ = ((a[begin[live] + k] ^ b[start[live] + k]) & X._MASK[np.minimum(size[live] - k, 8)]) != 0
        same[live[differ]] = False
        k += 8
        live = live[~differ]
        live = live[size[live] > k]
    return same


EMPTY = Dictionary(np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))


def split_units(data: np.ndarray, at: np.ndarray, pieces: Pieces):
    """The texts' bytes with the dummy prefix (a space before each text that isn't empty), the borders of texts and the begins of units."""
    some = np.diff(at) > 0
    at2 = at + np.concatenate([[0], np.cumsum(some)])
    full = np.full(at2[-1], 0x20, np.uint8)
    full[_ragged((at2[:-1] + some), np.diff(at))] = data
    start = np.zeros(len(full), bool)
    start[1:] = ((full[1:] & 0xC0) != 0x80) & ~pieces.side[full[:-1], full[1:]]
    start[at2[:-1][some]] = True
    return full, at2, np.flatnonzero(start)


def distinct_units(full: np.ndarray, begin: np.ndarray):
    """The units' ends, for distinct units their hashes and where they are, and each unit's number among them. Equal means equal bytes."""
    end = np.append(begin[1:], len(full))[: len(begin)]
    h = X.word_hashes(full, begin, end)
    key, where, back = np.unique(h, return_index=True, return_inverse=True)
    odd = np.flatnonzero(~_equal(full, begin, end, full, begin[where[back]], end[where[back]]))
    back[odd] = len(key) + np.arange(len(odd))
    return end, np.concatenate([key, h[odd]]), np.concatenate([where, odd]), back


def encode_texts(data: np.ndarray, at: np.ndarray, pieces: Pieces, words: Dictionary = EMPTY) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts (bytes with spaces for space signs, borders at), and how many each has. words: pieces of units."""
    full, at2, begin = split_units(data, at, pieces)
    if not len(full):
        return np.zeros(0, np.int64), np.zeros(len(at) - 1, np.int64)
    end, key, where, back = distinct_units(full, begin)
    found = words.find(full, begin[where], end[where], key)
    new, hit = np.flatnonzero(found < 0), found >= 0
    b, e = begin[where[new]], end[where[new]]
    ids, count = encode_units(full[_ragged(b, e - b)], np.concatenate([[0], np.cumsum(e - b)]), pieces)
    # the pieces of the dictionary's units, then those of the others
    flat = np.concatenate([words.ids, ids])
    first, n = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    first[hit], n[hit] = words.begin[found[hit]], words.count[found[hit]]
    first[new], n[new] = len(words.ids) + np.cumsum(count) - count, count
    n = n[back]
    out = flat[_ragged(first[back], n)]
    unit = np.searchsorted(begin, at2)
    return out, np.diff(np.concatenate([[0], np.cumsum(n)])[unit])


def decode_ids(ids: np.ndarray, count: np.ndarray, pieces: Pieces) -> list[str]:
    """Texts of the id lists; control pieces are silent, ill-formed bytes become U+FFFD."""
    n = pieces.length[ids]
    flat = pieces.flat[_ragged(pieces.begin[ids], n)].tobytes()
    edge = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(count)])].tolist()
    return [flat[a + (flat[a : a + 1] == b" ") : b].decode("utf-8", "replace") if b > a else "" for a, b in zip(edge[:-1], edge[1:], strict=True)]


def _plain(batch: pa.RecordBatch, column: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pc.replace_substring(batch.column(column).cast(pa.large_string()), SPACE, " ")], ["t"])


def _encode(model: str, text: str, keep: list[int], check: bool, words: Dictionary):
    def run(batches):
        pieces = _pieces(model)
        for batch in batches:
            i = batch.schema.get_field_index(text)
            for rows, data, at in X.groups(_plain(batch, i), "t"):
                ids, count = encode_texts(data, at, pieces, words)
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(count)]).astype(np.int32), pa.array(ids.astype(np.int32)))
                cols = [batch.column(c)[rows] for c in keep] + [lists, pa.array(count)]
                names = [batch.schema.names[c] for c in keep] + ["ids", "n_pieces"]
                if check:
                    back = pa.array(decode_ids(ids, count, pieces), pa.large_string())
                    cols.append(pc.equal(back, pc.fill_null(batch.column(i)[rows].cast(pa.large_string()), "")))
                    names.append("round_trip")
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def unit_counts(docs: DataFrame, text_col: str = "text", model: str = MODEL) -> DataFrame:
    """(unit, n) over all documents, of units of UNIT_BYTES at most that occur twice or more among some neighbouring texts."""

    def run(batches):
        pieces = _pieces(model)
        for batch in batches:
            for _, data, at in X.groups(_plain(batch, 0), "t"):
                full, _, begin = split_units(data, at, pieces)
                end, _, where, back = distinct_units(full, begin)
                n = np.bincount(back, minlength=len(where))
                some = np.flatnonzero((n > 1) & (end[where] - begin[where] <= UNIT_BYTES))
                b, size = begin[where[some]], (end - begin)[where[some]]
                edge = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                units = pa.StringArray.from_buffers(len(some), pa.py_buffer(edge), pa.py_buffer(full[_ragged(b, size)]))
                yield pa.RecordBatch.from_arrays([units, pa.array(n[some])], ["unit", "n"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def dictionary(docs: DataFrame, text_col: str = "text", model: str = MODEL, most: int = DICTIONARY) -> Dictionary:
    """Pieces of the units that occur most in docs, at most `most`, by the relational lattice. All units with one count stay or go together."""
    counts = save(unit_counts(docs, text_col, model), "units")
    step = F.floor(F.log2("n") * 8).cast("int")
    total, least = 0, None
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("units")).collect(), reverse=True):  # 512 rows at most
        total += r["units"]
        if total > most:
            break
        least = r["step"]
    if least is None:
        return EMPTY
    pieces = load(model)
    table = docs.sparkSession.createDataFrame([(p, i, 0.0) for p, i in pieces.normal], "piece string, id int, score double")
    edges = lattice(counts.where(step >= least).repartition(32, "unit"), F.broadcast(table), "unit", pieces.longest)  # the piece table is a fixed file
    found = fold_merges(edges, model).toArrow().sort_by("word")
    drop(counts)
    texts = [x.encode() for x in found["word"].to_pylist()]
    ids = pc.list_flatten(found["ids"]).to_numpy().astype(np.int32)
    return Dictionary(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), ids, pc.list_value_length(found["ids"]).to_numpy().astype(np.int64))


def encode(docs: DataFrame, text_col: str = "text", model: str = MODEL, check: bool = False, words: Dictionary | None = None) -> DataFrame:
    """docs with ids (array of int) and n_pieces instead of clashing columns of these names; with check, round_trip says whether decoding
    gives the text again (it can't where a text holds U+2581 itself). Null and empty texts have no pieces; a text is worked whole, however
    long. Without `words` a first pass over docs makes the dictionary at once. The model's path must be readable by the executors.
    """
    words = dictionary(docs, text_col, model) if words is None else words
    new = ["ids", "n_pieces"] + ["round_trip"] * check
    keep = [i for i, c in enumerate(docs.columns) if c not in new]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in new)
    return docs.mapInArrow(_encode(model, text_col, keep, check, words), schema + ", ids array<int>, n_pieces long" + ", round_trip boolean" * check)


def decode(encoded: DataFrame, ids_col: str = "ids", out_col: str = "text", model: str = MODEL) -> DataFrame:
    """encoded with the texts of its id lists in out_col, instead of any column of that name. A null list gives a null text; ids outside
    the table raise an error.
    """
    keep = [i for i, c in enumerate(encoded.columns) if c != out_col]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name != out_col)

    def run(batches):
        pieces = _pieces(model)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids_col))
            count = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            texts = decode_ids(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), count, pieces)
            texts = pa.array([t if ok else None for t, ok in zip(texts, lists.is_valid().to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), texts], [*(batch.schema.names[c] for c in keep), out_col])

    return encoded.mapInArrow(run, schema + f", `{out_col}` string")


def lattice(words: DataFrame, table: DataFrame, word_col: str = "word", longest: int = 16) -> DataFrame:
    """Edges (word, start, size, id, score) of distinct words: bounded substrings joined with table (piece, id, score). Distinct words only,
    so that a frequent word is worked once."""
    distinct = words.select(F.col(word_col).alias("word")).where("word <> ''").distinct()
    at = distinct.select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("start"))
    at = at.select("word", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("word") - F.col("start") + 1))).alias("size"))
    subs = at.withColumn("piece", F.substring("word", F.col("start"), F.col("size")))
    return subs.join(table.select("piece", "id", F.col("score").cast("double")), "piece").select("word", "start", "size", "id", "score")


def fold_merges(edges: DataFrame, model: str = MODEL) -> DataFrame:
    """BPE's segmentation (word, ids) by a fold over each word's edges, ordered by end: an edge extends the path to its start if the path's
    last piece may stand before it. Words with a character that is no piece are left out."""
    e = F.struct((F.col("start") + F.col("size")).alias("stop"), "start", "id")
    grouped = save(edges.groupBy("word").agg(F.collect_list(e).alias("es")).where("size(filter(es, x -> x.stop = x.start + 1)) = length(word)"), "lattice")
    # pieces that meet: each edge with those that end where it starts
    met = grouped.select("word", F.explode("es").alias("x"), "es").select("word", "x", F.expr("transform(filter(es, y -> y.stop = x.start), y -> y.id)").alias("ids"))
    pairs = met.select("word", "x", F.explode_outer("ids").alias("a"))

    def test(batches):
        pieces = _pieces(model)
        for batch in batches:
            a, b = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns)
            yield batch.filter(pa.array(pieces.compatible(a, b)))

    may = pairs.where("a is not null").select("a", F.col("x.id").alias("b")).distinct().mapInArrow(test, "a int, b int")
    allowed = may.select(F.col("a").alias("before_a"), F.col("b").alias("before_b"))
    before = pairs.join(allowed, (F.col("a") == F.col("before_a")) & (F.col("x.id") == F.col("before_b")), "left")
    before = before.groupBy("word", "x").agg(F.collect_list("before_a").alias("before"))
    edge = F.struct("x.stop", "x.start", "x.id", "before")
    node = "struct<last:int,ids:array<int>>"
    zero = F.expr(f"cast(array(named_struct('last', -1, 'ids', array())) as array<{node}>)")

    def step(nodes, x):
        prev = F.element_at(nodes, x["start"])
        new = F.struct(x["id"].alias("last"), F.concat(prev["ids"], F.array(x["id"])).alias("ids"))
        fits = (F.size(nodes) == x["stop"] - 1) & ((x["start"] == 1) | F.array_contains(x["before"], prev["last"]))
        return F.when(fits, F.concat(nodes, F.array(new).cast(f"array<{node}>"))).otherwise(nodes)

    best = F.aggregate(F.array_sort("es"), zero, step)
    folded = before.groupBy("word").agg(F.collect_list(edge).alias("es")).select("word", best.alias("nodes"))
    return folded.where("size(nodes) = length(word) + 1").select("word", F.element_at("nodes", -1)["ids"].alias("ids"))


def fold_scores(edges: DataFrame, unknown: float = -1e6) -> DataFrame:
    """Viterbi with additive scores: (word, ids, score) by a fold over each word's edges, ordered by end, then start. Characters without an
    edge cost `unknown` and have id -1. Of equal scores the longest last piece wins."""
    e = F.struct((F.col("start") + F.col("size")).alias("stop"), "start", "id", F.col("score").alias("s"))
    lone = edges.select("word").distinct().select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("start")).select("word", F.struct((F.col("start") + 1).alias("stop"), "start", F.lit(-1).alias("id"), F.lit(unknown).alias("s")).alias("e"))
    grouped = edges.select("word", e.alias("e")).unionByName(lone).groupBy("word").agg(F.array_sort(F.collect_list("e")).alias("es"))
    node = "struct<score:double,ids:array<int>>"
    zero = F.array(F.struct(F.lit(0.0).alias("score"), F.array().cast("array<int>").alias("ids"))).cast(f"array<{node}>")

    def step(nodes, x):
        prev = F.element_at(nodes, x["start"])
        new = F.struct((prev["score"] + x["s"]).alias("score"), F.concat(prev["ids"], F.array(x["id"].cast("int"))).alias("ids")).cast(node)
        here = F.try_element_at(nodes, x["stop"])
        grown = F.when(F.size(nodes) < x["stop"], F.concat(nodes, F.array(new)))
        better = F.when(here["score"] < new["score"], F.concat(F.slice(nodes, F.lit(1), x["stop"] - 1), F.array(new))).otherwise(nodes)
        return F.coalesce(grown, better)

    best = F.element_at(F.aggregate("es", zero, step), -1)
    return grouped.select("word", best.alias("b")).select("word", "b.ids", "b.score")
