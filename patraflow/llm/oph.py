"""Document fingerprints by one-permutation MinHash.

Each distinct shingle of 5 words (A-Z in lower case; fewer words: the whole sequence) is hashed once; the hash's top bits choose one of
BINS bins, which keeps its smallest rest. An empty bin copies the bin that a hash of (bin, attempt) names, tried until one is filled
(optimal densification). A fingerprint packs the low BITS bits of all bins as hexadecimal. Two fingerprints agree by chance in 2**-BITS of
the bins, which the estimate of the Jaccard similarity takes off. A text without words has the fingerprint of dashes: likeness 1 to its
like, 0 to any other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X

BINS, BITS, SHINGLE = 256, 8, 5
#: Ranges of ids at most: the bound of the cuts that go to the workers.
RANGES = 10_000
U = np.uint64
_NONE = U(0xFFFFFFFFFFFFFFFF)


def _attempt(a: int) -> np.ndarray:
    """The bin that each bin looks into at its attempt a."""
    return (X.mix(np.arange(BINS, dtype=np.uint64) * U(0x9E3779B97F4A7C15) + U(a * 0xD1B54A32D192ED03 % 2**64)) >> U(56)).astype(np.int64)


def sketches(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Low bits of the bins (rows by BINS, uint8), and which rows have words."""
    data = X.lower(data)
    starts, ends, first = X.words(data, at)
    row, h = X.shingles(X.word_hashes(data, starts, ends), first, SHINGLE)
    n = len(at) - 1
    cell = row * BINS + (h >> U(56)).astype(np.int64)
    order = np.lexsort((h, cell))
    cell, h = cell[order], h[order]
    head = np.ones(len(cell), bool)
    head[1:] = cell[1:] != cell[:-1]
    bins = np.full(n * BINS, _NONE)
    bins[cell[head]] = X.mix(h[head] & U((1 << 56) - 1))
    filled = np.zeros(n * BINS, bool)
    filled[cell[head]] = True
    bins, filled = bins.reshape(n, BINS), filled.reshape(n, BINS)
    some = filled.any(1)
    single = filled.sum(1) == 1  # all attempts end in the one filled bin
    bins[single] = bins[single, filled[single].argmax(1)][:, None]
    r, c = np.nonzero(~filled & (some & ~single)[:, None])
    attempt = 0
    while len(r):
        attempt += 1
        jump = _attempt(attempt)[c]
        ok = filled[r, jump]
        bins[r[ok], c[ok]] = bins[r[ok], jump[ok]]
        r, c = r[~ok], c[~ok]
    # low bits of a hash of bin and value, so that bins that share a value by densification agree by chance independently
    bins = X.mix(bins + np.arange(BINS, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
    return (bins & U((1 << BITS) - 1)).astype(np.uint8), some


def likeness(a: np.ndarray, some_a: np.ndarray, b: np.ndarray, some_b: np.ndarray) -> np.ndarray:
    chance = 2.0**-BITS
    share = (a == b).mean(1)
    return np.where(some_a & some_b, np.clip((share - chance) / (1 - chance), 0, 1), (some_a == some_b).astype(float))


def _hex(bits: np.ndarray, some: np.ndarray) -> list[str]:
    text, width = bits.tobytes().hex(), 2 * BINS
    return [text[i * width : (i + 1) * width] if s else "-" * width for i, s in enumerate(some.tolist())]


def _of(texts: list[str]):
    """Sketches of texts, in groups of bounded bytes."""
    batch = pa.record_batch([pa.array(texts, pa.large_string())], ["t"])
    got = [sketches(data, at) for _, data, at in X.groups(batch, "t")]
    return tuple(np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros((0, BINS), np.uint8), np.zeros(0, bool))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' ids and fingerprints: doc_id, fingerprint. Null texts count as empty."""

    def run(batches):
        for batch in batches:
            bits, some = _of([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_hex(bits, some), pa.string())], ["doc_id", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"doc_id {kind}, fingerprint string")


def compare(a: str, b: str) -> float:
    """Likeness of two fingerprints."""
    if "-" in (a[0], b[0]):
        return float(a == b)
    x, y = (np.frombuffer(bytes.fromhex(t), np.uint8)[None] for t in (a, b))
    return float(likeness(x, np.array([True]), y, np.array([True]))[0])


def edited(text: str, following: str) -> str:
    """The text whose last floor(n/2) code points are replaced by the first as many of the following one."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pairs(batches):
    """Rows (part, doc_id, text, guard), sorted: each row but a guard meets the row that follows it in its part."""
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    last = None
    for batch in batches:
        rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
        if not rows:
            continue
        if last is not None:
            rows = [last, *rows]
        last = rows[-1]
        for i in range(0, len(rows) - 1, 256):
            group = rows[i : min(i + 257, len(rows))]
            use = [k for k in range(len(group) - 1) if group[k][0] == group[k + 1][0] and not group[k][3]]
            if not use:
                continue
            texts = [t for _, _, t, _ in group]
            own, own_some = _of(texts)
            new = [edited(texts[k], texts[k + 1]) for k in use]
            ed, ed_some = _of(new)
            at, after = np.array(use), np.array(use) + 1
            print_ = _hex(own, own_some)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([group[k][1] for k in use], pa.int64()),
                    pa.array([len(texts[k]) for k in use], pa.int64()),
                    pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new], pa.string()),
                    pa.array([print_[k] for k in use], pa.string()),
                    pa.array(_hex(ed, ed_some), pa.string()),
                    pa.array(likeness(own[at], own_some[at], ed, ed_some)),
                    pa.array(likeness(own[at], own_some[at], own[after], own_some[after])),
                ],
                names,
            )


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_a_part: int = 2000) -> DataFrame:
    """One row per row of docs with the columns of _SCHEMA: the fingerprints of the text and of its edited text, and their likeness.

    Rows are ordered by id, equal ids by text, null ids first; the last is followed by the first. Null texts count as empty. Ranges of ids
    of about rows_a_part rows, or of more where that would be over RANGES ranges, are worked apart, each as a stream; the first row of each
    range goes to the range before it too, as a guard. All rows of one id are in one range.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    ids = rows.select("doc_id")
    n, low = ids.agg(F.count(F.lit(1)), F.min("doc_id")).first()
    parts = max(1, min(RANGES, n // rows_a_part))
    cuts = sorted({int(c) for c in ids.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 1 / (4 * parts))} - {low}) if parts > 1 and low is not None else []
    # a range is [cut, next cut); its number is that of the cuts up to an id
    ranged = rows.withColumn("part", _range(F.col("doc_id"), cuts))
    firsts = ids.withColumn("part", _range(F.col("doc_id"), cuts)).groupBy("part").agg(F.min(F.struct(F.col("doc_id"))).alias("m"), F.count("*")).select("part", F.col("m.doc_id").alias("first"))
    firsts = sorted((r["part"], r["first"]) for r in firsts.collect())  # one row a range
    ends = {firsts[i][0]: firsts[(i + 1) % len(firsts)] for i in range(len(firsts))} if firsts else {}
    guards = rows.where("false").select(F.lit(0).alias("part"), "doc_id", "text", F.lit(True).alias("guard"))
    if ends:
        wanted = docs.sparkSession.createDataFrame([(to[1], part) for part, to in ends.items()], "first long, part int")
        guards = rows.join(F.broadcast(wanted), F.col("doc_id").eqNullSafe(F.col("first"))).groupBy("part", "doc_id").agg(F.min("text").alias("text")).select("part", "doc_id", "text", F.lit(True).alias("guard"))
    every = ranged.select("part", "doc_id", "text", F.lit(False).alias("guard")).unionByName(guards)
    dealt = every.repartition(F.col("part")).sortWithinPartitions("part", "guard", "doc_id", "text")
    return dealt.mapInArrow(_pairs, _SCHEMA)


def _range(column, cuts: list[int]):
    """The number of cuts that are at most the value; 0 for null."""
    if not cuts:
        return F.lit(0)
    edges = np.array(cuts, np.int64)

    @F.arrow_udf("int")
    def number(ids: pa.Array) -> pa.Array:
        at = np.searchsorted(edges, ids.fill_null(cuts[0] - 1).to_numpy(zero_copy_only=False), "right")
        return pa.array(at.astype(np.int32))

    return number(column)
