"""Chunks as JSON: one object a chunk or a document, with nulls written out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.chunk import ChunkConfig, config_dict

_KEEP_NULLS = {"ignoreNullFields": "false"}


def to_rows(chunks: DataFrame) -> DataFrame:
    """Each chunk as one struct."""
    return chunks.select("doc_id", "index", F.struct(*[c for c in chunks.columns if c != "doc_id"]).alias("chunk"))


def to_jsonl(chunks: DataFrame) -> DataFrame:
    """(doc_id, index, line): one object a chunk."""
    return to_rows(chunks).select("doc_id", "index", F.to_json("chunk", _KEEP_NULLS).alias("line"))


def to_json(chunks: DataFrame, config: ChunkConfig = ChunkConfig(), documents: DataFrame | None = None) -> DataFrame:
    """(doc_id, json): a document's chunks in order, with the configuration and, from documents (doc_id and any columns), what else is known
    of it, under their names."""
    settings = F.struct(*(F.lit(v).alias(k) for k, v in config_dict(config).items()))
    rows = to_rows(chunks).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("index", F.to_json("chunk", _KEEP_NULLS).alias("j")))), lambda x: x["j"]).alias("parts"))
    head = F.concat(F.lit('{"chunks":['), F.array_join("parts", ","), F.lit('],"config":'), F.to_json(settings))
    if documents is None:
        return rows.select("doc_id", F.concat(head, F.lit("}")).alias("json"))
    known = documents.select("doc_id", F.to_json(F.struct(*[c for c in documents.columns if c != "doc_id"]), _KEEP_NULLS).alias("known"))
    return rows.join(known, "doc_id", "left").select("doc_id", F.concat(head, F.lit(',"document":'), F.coalesce("known", F.lit("null")), F.lit("}")).alias("json"))


def write_jsonl(chunks: DataFrame, path: str) -> None:
    to_jsonl(chunks).select("line").write.text(path)


def write_texts(documents: DataFrame, path: str) -> None:
    """Extracted documents as JSON lines: path, text or error."""
    documents.write.option("ignoreNullFields", "false").json(path)


def write_text_files(documents: DataFrame, path: str) -> None:
    """A folder for each document that has a text, named after its id, with the text in one file."""
    some = documents.where("text <> ''").select("doc_id", "text")
    some.repartition("doc_id").write.partitionBy("doc_id").option("lineSep", "\n").text(path)


def outcome(text, error_type):
    """fail for an error, skip for a document without text, else ok."""
    return F.when(error_type.isNotNull(), "fail").when(F.coalesce(F.trim(text), F.lit("")) == "", "skip").otherwise("ok")


def status_counts(documents: DataFrame) -> DataFrame:
    """(status, count) of documents (text, error_type), by outcome()."""
    return documents.groupBy(outcome(F.col("text"), F.col("error_type")).alias("status")).count()
