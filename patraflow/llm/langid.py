"""Language identification by cross-parsing.

A bounded sample of labelled text per language becomes a suffix automaton. A text is parsed greedily into the longest matches against each
automaton; a phrase costs log2(sample length) bits. The language with the fewest bits per byte, so the fewest normalised phrases, wins.

The model's bound: `slots` sampled passages of `passage` characters a language, drawn by hash from all passages of all labelled texts.
Predictions read whole texts, however long: these are parsed in segments of SEGMENT bytes, all segments of a batch in step, so a phrase
never spans two segments.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X

SEGMENT = 1024
#: Digits, punctuation and controls of ASCII are one byte, a space.
_FOLD = np.array([c if c >= 128 or chr(c).isalpha() else 32 for c in range(256)], np.uint8)


@dataclass(frozen=True)
class LanguageModel:
    """Sampled text by language, in the order of the languages' names."""

    languages: tuple[str, ...]
    samples: tuple[bytes, ...]


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", slots: int = 32, passage: int = 1024) -> LanguageModel:
    """Learns from rows whose text and label aren't null and whose text has a letter. The sample follows hashes of ids and passages; of rows
    that share both, the smaller passage is taken."""
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col).cast("string")).alias("id"), F.lower(F.col(text_col)).alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    parts = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / passage).cast("int")))).withColumn("key", F.xxhash64("id", "i"))
    picked = parts.groupBy("lang", F.pmod("key", F.lit(slots)).alias("slot")).agg(F.min("key").alias("key")).select("lang", "key")
    parts = parts.join(F.broadcast(picked), ["lang", "key"])  # slots rows a language
    found = parts.select("lang", "key", F.substring("text", F.col("i") * passage + 1, F.lit(passage)).alias("text")).groupBy("lang", "key").agg(F.min("text").alias("text")).collect()
    texts: dict[str, list[bytes]] = {}
    for r in sorted(found):
        texts.setdefault(r["lang"], []).append(re.sub(b" +", b" ", _FOLD[np.frombuffer(r["text"].encode(), np.uint8)].tobytes()))
    return LanguageModel(tuple(sorted(texts)), tuple(b" ".join(texts[k]) for k in sorted(texts)))


def suffix_automaton(text: bytes, code: np.ndarray, width: int) -> np.ndarray:
    """States by codes: twice the next state, plus 1 where a new phrase begins. State 0 is the root; unknown bytes lead to it."""
    flat = np.full((2 * len(text) + 2) * width, -1, np.int32)
    edge = memoryview(flat)
    link, length = [-1], [0]
    last = 0
    for c in code[np.frombuffer(text, np.uint8)].tolist():
        new = len(link)
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and edge[p * width + c] < 0:
            edge[p * width + c] = new
            p = link[p]
        if p >= 0:
            q = edge[p * width + c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(link)
                link.append(link[q])
                length.append(length[p] + 1)
                flat[twin * width : (twin + 1) * width] = flat[q * width : (q + 1) * width]
                while p >= 0 and edge[p * width + c] == q:
                    edge[p * width + c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    table = flat.reshape(-1, width)[: len(link)]
    root = np.maximum(table[0], 0)
    out = np.where(table < 0, 2 * root + 1, 2 * table)
    out[0] = 2 * root + 1
    return out.astype(np.int32, copy=False)


def _tables(model: LanguageModel):
    return X.held(model, lambda: _build(model))


def _build(model: LanguageModel):
    used = np.unique(np.frombuffer(b"".join(model.samples), np.uint8))
    width = len(used) + 1
    code = np.full(256, len(used), np.int64)
    code[used] = np.arange(len(used))
    parts = [suffix_automaton(s, code, width) for s in model.samples]
    base = np.cumsum([0, *(len(p) for p in parts)])
    flat = np.concatenate([p + np.int32(2 * b) for p, b in zip(parts, base, strict=False)]) if parts else np.zeros((1, width), np.int32)
    bits = np.log2([max(2, len(s)) for s in model.samples])
    return flat.ravel(), code, width, base[: len(parts)], bits


def phrases(data: np.ndarray, at: np.ndarray, model: LanguageModel) -> np.ndarray:
    """Phrases of each text (rows) against each language (columns); data holds lower-case UTF-8."""
    flat, code, width, base, _ = _tables(model)
    langs = len(base)
    codes = code[_FOLD[data]]
    pieces = -(-np.diff(at) // SEGMENT)
    row = np.repeat(np.arange(len(pieces)), pieces)
    begin = at[:-1][row] + SEGMENT * (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    size = np.minimum(SEGMENT, at[1:][row] - begin)
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    live = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), side="left")
    state = np.repeat(base[:, None], len(begin), 1)
    count = np.zeros((langs, len(begin)), np.int32)
    for t, k in enumerate(live.tolist()):
        v = flat[state[:, :k] * width + codes[begin[:k] + t]]
        count[:, :k] += v & 1
        state[:, :k] = v >> 1
    total = np.zeros((len(pieces), langs))
    np.add.at(total, row[order], count.T)
    return total


def _predict(model: LanguageModel):
    def run(batches):
        for batch in batches:
            letters = np.asarray(batch.column(2).to_numpy(zero_copy_only=False), bool)
            for rows, data, at in X.groups(batch, "text", 2 * X.LIMIT):
                n = np.maximum(np.diff(at), 1)
                known = letters[rows] & bool(model.languages)
                lang, score = np.full(len(n), "und", object), np.zeros(len(n))
                if known.any():
                    cost = phrases(data, at, model) * _tables(model)[4] / n[:, None]
                    best = cost.argmin(1)
                    like = np.exp2(-(cost - cost.min(1)[:, None]) * np.minimum(n, 64)[:, None])
                    lang = np.where(known, np.array(model.languages, object)[best], "und")
                    score = np.where(known, 1 / like.sum(1), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0)[rows], pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])
        X.held(None, lambda: None)

    return run


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, lang_pred, score) per row of docs. Null texts and texts without a letter are `und` with score 0; with equal costs
    the first name wins. score: the language's share of the likelihood of up to 64 bytes at the text's mean cost.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.lower(text).alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(_predict(model), f"doc_id {kind}, lang_pred string, score double")


def held_out(id_col: str = "doc_id"):
    """Rows kept from training: crc32 of the id as text, modulo 4, is 2. A null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Fits on the labelled rows of docs (text, lang) that are not held out, and predicts every row."""
    model = fit(docs.where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
