"""Micro-chunks and their bounded merge into chunks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import quality as Q
from ..functions import text as T
from ..functions.rules import is_split
from .segment import segment

#: (left, right) -> similarity, for scorers that read the growing text.
Scorer = Callable[[str, str], float]


@dataclass(frozen=True)
class ChunkConfig:
    similarity_threshold: float = 0.2
    max_words: int = 300
    level: str = "sentence"
    respect_table_rows: bool = True

    def __post_init__(self):
        if not -1 <= self.similarity_threshold <= 1:
            raise ValueError("similarity_threshold is not between -1 and 1")
        if self.max_words < 1:
            raise ValueError("max_words is below 1")
        if self.level not in ("sentence", "clause"):
            raise ValueError("level is neither sentence nor clause")


def micro_chunks(segments: DataFrame, level: str = "sentence", keys: tuple[str, ...] = ("doc_id", "seg_no")) -> DataFrame:
    """(*keys, mc, text, words): each text cut after every word that the rules split at. Blank texts have none."""
    rows = segments.select(*keys, F.posexplode(T.tokens(F.col("text"))).alias("pos", "word"))
    w = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("split", is_split("word", level)).withColumn("mc", F.coalesce(F.sum(F.col("split").cast("int")).over(w), F.lit(0)).cast("int"))
    return rows.groupBy(*keys, "mc").agg(F.expr("listagg(word, ' ') WITHIN GROUP (ORDER BY pos)").alias("text"), F.count("*").cast("int").alias("words"))


def pools(segments: DataFrame, level: str = "sentence") -> DataFrame:
    """(doc_id, pool, n, text, words, gap): micro-chunks of consecutive prose, numbered in their pool; gap says that the next one comes
    from another segment. segments: doc_id, seg_no, text, kind."""
    w = Window.partitionBy("doc_id").orderBy("seg_no")
    at = segments.repartition("doc_id").withColumn("pool", F.sum((F.col("kind") != "prose").cast("int")).over(w).cast("int")).where("kind = 'prose'")
    rows = micro_chunks(at, level, ("doc_id", "pool", "seg_no"))
    o = Window.partitionBy("doc_id", "pool").orderBy("seg_no", "mc")
    rows = rows.withColumn("n", F.row_number().over(o) - 1).withColumn("gap", F.coalesce(F.lead("seg_no").over(o) != F.col("seg_no"), F.lit(False)))
    return rows.select("doc_id", "pool", "n", "text", "words", "gap")


_PIECE = "struct<parts:array<string>,words:int,merged_from:int,boundaries:array<string>>"


def _fold(micro: Column, config: ChunkConfig, joins: bool) -> Column:
    """Pieces of one pool, its micro-chunks in order, under a scorer that always or never joins."""
    level = F.lit(config.level)

    def new(m):
        return F.struct(F.array(m["text"]).alias("parts"), m["words"].alias("words"), F.lit(1).alias("merged_from"), F.array().cast("array<string>").alias("boundaries")).cast(_PIECE)

    def close(cur, why):
        return F.struct(cur["parts"].alias("parts"), cur["words"].alias("words"), cur["merged_from"].alias("merged_from"), F.concat(cur["boundaries"], F.array(F.lit(why))).alias("boundaries")).cast(_PIECE)

    zero = F.struct(F.array().cast(f"array<{_PIECE}>").alias("done"), F.lit(None).cast(_PIECE).alias("cur"), F.lit(False).alias("gap"))

    def step(s, m):
        cur = s["cur"]
        over = cur["words"] + m["words"] > config.max_words
        mark = F.when(s["gap"], F.lit("segment")).otherwise(level)
        joined = F.struct(F.concat(cur["parts"], F.array(m["text"])).alias("parts"), (cur["words"] + m["words"]).alias("words"), (cur["merged_from"] + 1).alias("merged_from"), F.concat(cur["boundaries"], F.array(mark)).alias("boundaries")).cast(_PIECE)
        first = F.struct(s["done"].alias("done"), new(m).alias("cur"), m["gap"].alias("gap"))
        emit = lambda why: F.struct(F.concat(s["done"], F.array(close(cur, why))).alias("done"), new(m).alias("cur"), m["gap"].alias("gap"))
        go_on = F.struct(s["done"].alias("done"), joined.alias("cur"), m["gap"].alias("gap")) if joins else emit("coherence")
        return F.when(cur.isNull(), first).when(over, emit("guardrail")).otherwise(go_on)

    def finish(s):
        return F.when(s["cur"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["cur"])))

    return F.when(F.size(micro) == 1, F.transform(micro, lambda m: F.struct(F.array(m["text"]).alias("parts"), m["words"].alias("words"), F.lit(1).alias("merged_from"), F.array(level).alias("boundaries")).cast(_PIECE))).otherwise(F.aggregate(micro, zero, step, finish))


def merge(micro: DataFrame, config: ChunkConfig = ChunkConfig(), scorer: float | Scorer = 1.0) -> DataFrame:
    """(doc_id, pool, piece, text, words, merged_from, boundaries) of pools(): greedy merge of neighbours under max_words and the scorer.

    A number as scorer is a constant similarity and folds natively; a function reads the text gathered so far and runs on Arrow groups.
    """
    if callable(scorer):
        return _merge_scored(micro, config, scorer)
    grouped = micro.groupBy("doc_id", "pool").agg(F.array_sort(F.collect_list(F.struct("n", "text", "words", "gap"))).alias("m"))
    out = grouped.select("doc_id", "pool", F.posexplode(_fold(F.col("m"), config, scorer >= config.similarity_threshold)).alias("piece", "p"))
    return out.select("doc_id", "pool", "piece", F.array_join("p.parts", " ").alias("text"), "p.words", "p.merged_from", "p.boundaries")


def _merge_scored(micro: DataFrame, config: ChunkConfig, scorer: Scorer) -> DataFrame:
    def run(key, table):
        rows = table.sort_by("n").to_pylist()
        done, cur = [], None
        for i, m in enumerate(rows):
            if cur is None:
                cur = [m["text"], m["words"], 1, []]
                continue
            why = None
            if cur[1] + m["words"] > config.max_words:
                why = "guardrail"
            elif scorer(cur[0], m["text"]) >= config.similarity_threshold:
                cur = [f"{cur[0]} {m['text']}", cur[1] + m["words"], cur[2] + 1, [*cur[3], "segment" if rows[i - 1]["gap"] else config.level]]
            else:
                why = "coherence"
            if why:
                done.append([*cur[:3], [*cur[3], why]])
                cur = [m["text"], m["words"], 1, []]
        done.append(cur if len(rows) > 1 else [*cur[:3], [config.level]])
        n = len(done)
        text, words, merged, bounds = zip(*done, strict=True)
        return pa.table({"doc_id": [key[0].as_py()] * n, "pool": pa.array([key[1].as_py()] * n, pa.int32()), "piece": pa.array(range(n), pa.int32()), "text": text, "words": pa.array(words, pa.int32()), "merged_from": pa.array(merged, pa.int32()), "boundaries": pa.array(bounds, pa.list_(pa.string()))})

    kind = micro.schema["doc_id"].dataType.simpleString()
    return micro.groupBy("doc_id", "pool").applyInArrow(run, f"doc_id {kind}, pool int, piece int, text string, words int, merged_from int, boundaries array<string>")


def chunk_id(document: Column, index: Column, text: Column) -> Column:
    whole = F.concat_ws("|", F.coalesce(document.cast("string"), F.lit("")), index.cast("string"), text)
    return F.concat(F.lit("chunk-"), F.format_string("%05d", index), F.lit("-"), F.substring(F.sha2(whole, 256), 1, 12))


def chunk_text(docs: DataFrame, config: ChunkConfig = ChunkConfig(), scorer: float | Scorer = 1.0) -> DataFrame:
    """Chunks of docs (doc_id, text, optional source_format and source_document): doc_id, index, chunk_id, text, word_count, segment_kind,
    quality, boundaries, merged_from, source_document, source_format, and page_range and bounding_boxes, which stay unknown."""
    names = [f.name for f in docs.schema]
    for extra in ("source_format", "source_document"):
        if extra not in names:
            docs = docs.withColumn(extra, F.lit(None).cast("string"))
    segments = segment(docs.select("doc_id", "source_format", "text"), config.respect_table_rows)
    prose = merge(pools(segments, config.level), config, scorer)
    w = Window.partitionBy("doc_id").orderBy("seg_no")
    atoms = segments.repartition("doc_id").withColumn("pool", F.sum((F.col("kind") != "prose").cast("int")).over(w).cast("int")).where("kind <> 'prose'")
    # an atomic segment stands before the prose of its own pool number
    both = prose.select("doc_id", "pool", F.col("piece").alias("place"), "text", F.lit("prose").alias("segment_kind"), "merged_from", "boundaries").unionByName(
        atoms.select("doc_id", "pool", F.lit(-1).alias("place"), "text", F.col("kind").alias("segment_kind"), F.lit(1).alias("merged_from"), F.array(F.lit("table_row")).alias("boundaries"))
    )
    both = both.withColumn("index", F.row_number().over(Window.partitionBy("doc_id").orderBy("pool", "place")) - 1)
    both = both.join(docs.select("doc_id", "source_document", "source_format"), "doc_id")
    return both.select(
        "doc_id",
        "index",
        chunk_id(F.col("source_document"), F.col("index"), F.col("text")).alias("chunk_id"),
        "text",
        T.word_count(F.col("text")).alias("word_count"),
        "segment_kind",
        Q.score(F.col("text"), with_tokens=False).alias("quality"),
        "boundaries",
        "merged_from",
        "source_document",
        "source_format",
        F.lit(None).cast("array<int>").alias("page_range"),
        F.array().cast("array<map<string,double>>").alias("bounding_boxes"),
    )


def document_counts(docs: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """(doc_id, segments, micro_chunks)."""
    segments = segment(docs, config.respect_table_rows)
    micro = micro_chunks(segments.where("kind = 'prose'"), config.level).groupBy("doc_id").agg(F.count("*").alias("micro_chunks"))
    return segments.groupBy("doc_id").agg(F.count("*").alias("segments")).join(micro, "doc_id", "left").na.fill(0, ["micro_chunks"])


def pick(chunks: DataFrame, start: int | None = None, stop: int | None = None) -> DataFrame:
    """Chunks [start, stop) of each document; negative bounds count from its end."""
    n = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))

    def at(bound, default):
        if bound is None:
            return default
        return F.lit(bound) if bound >= 0 else F.greatest(n + bound, F.lit(0))

    return chunks.withColumn("_low", at(start, F.lit(0))).withColumn("_high", at(stop, n)).where("index >= _low and index < _high").drop("_low", "_high")


def token_cosine(left: str, right: str) -> float:
    """Cosine of the word counts; 0 for a blank text."""
    from collections import Counter
    from math import sqrt

    a, b = Counter(left.split()), Counter(right.split())
    norm = sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
    return sum(v * b[k] for k, v in a.items()) / norm if norm else 0.0


class EncoderScorer:
    """Cosine of a sentence encoder's vectors; the model loads on first use in each worker, and the last texts' vectors are kept."""

    def __init__(self, model: str, kept: int = 4096):
        self.model, self.kept, self._vectors, self._encoder = model, kept, {}, None

    def __getstate__(self):
        return {"model": self.model, "kept": self.kept, "_vectors": {}, "_encoder": None}

    def embed(self, text: str):
        if text not in self._vectors:
            if self._encoder is None:
                from sentence_transformers import SentenceTransformer

                self._encoder = SentenceTransformer(self.model)
            if len(self._vectors) >= self.kept:
                self._vectors.clear()
            vector = self._encoder.encode(text)
            norm = float((vector * vector).sum()) ** 0.5
            self._vectors[text] = vector / norm if norm else vector * 0
        return self._vectors[text]

    def __call__(self, left: str, right: str) -> float:
        if not left.strip() or not right.strip():
            return 0.0
        return float((self.embed(left) * self.embed(right)).sum())


def config_dict(config: ChunkConfig) -> dict:
    return asdict(config)
