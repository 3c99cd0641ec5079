"""The race of extraction backends: attempts, scored candidates, and the choice by an ordered fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quality as Q

# The backends in order, with their costs.
PDF_BACKENDS = (("pypdf", 1), ("pymupdf", 2), ("pdfplumber", 3), ("pdfminer", 4))
SPAN_BACKEND, SPAN_COST = "pymupdf+spans", 2
ERROR_CHARS = 500


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, i, c) for i, (n, c) in enumerate(PDF_BACKENDS)], "backend_id string, ordinal int, cost int")


def attempts(results: DataFrame) -> DataFrame:
    """(doc_id, attempts, usable): the audit history of each document in registry order, whatever order the results (doc_id, ordinal,
    backend_id, text, error_type, error_message) came in."""
    ok = F.col("error_type").isNull()
    one = F.struct("ordinal", "backend_id", ok.alias("succeeded"), F.when(ok, Q.score(F.col("text"), False)).alias("quality"), "error_type", F.left("error_message", F.lit(ERROR_CHARS)).alias("error_message"))
    return results.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("attempts"), F.count_if(ok).alias("usable"))


def scored(results: DataFrame, span_texts: DataFrame | None = None) -> DataFrame:
    """Candidates (doc_id, ordinal, backend_id, cost, text, quality); span_texts (doc_id, text) adds the converted-span candidate."""
    rows = results.where("error_type is null").select("doc_id", "ordinal", "backend_id", "cost", "text")
    if span_texts is not None:
        rows = rows.unionByName(span_texts.select("doc_id", F.lit(len(PDF_BACKENDS)).alias("ordinal"), F.lit(SPAN_BACKEND).alias("backend_id"), F.lit(SPAN_COST).alias("cost"), "text"))
    return rows.withColumn("quality", Q.score(F.col("text"), False))


def select(candidates: DataFrame) -> DataFrame:
    """(doc_id, winner struct, raw_winner, summary): of the viable candidates, or of all where none is, the best by a fold in registry
    order. A later one wins if better, or if alike and cheaper. raw_winner is the fold without the span candidate."""
    item = F.struct("ordinal", "backend_id", "cost", F.col("quality.raw_length").alias("raw_length"), F.col("quality.sinhala_ratio").alias("sinhala_ratio"), F.col("quality.orphan_vowel_rate").alias("orphan_vowel_rate"))
    rows = candidates.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("all"))

    def best(items):
        some = F.filter(items, lambda c: c["raw_length"] >= Q.MIN_CHARS)
        pool = F.when(F.size(some) > 0, some).otherwise(items)

        def step(held, c):
            better = Q.compare(c, held)
            return F.when(held.isNull() | (better > 0) | ((better == 0) & (c["cost"] < held["cost"])), c).otherwise(held)

        return F.aggregate(F.slice(pool, 2, 1 << 20), F.try_element_at(pool, F.lit(1)), step)

    raw = F.filter("all", lambda c: c["ordinal"] < len(PDF_BACKENDS))
    summary = F.map_from_entries(F.transform("all", lambda c: F.struct(c["backend_id"], F.round(c["sinhala_ratio"], 4))))
    return rows.select("doc_id", best(F.col("all")).alias("winner"), best(raw)["backend_id"].alias("raw_winner"), summary.alias("summary"))
