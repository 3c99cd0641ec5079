"""A corpus pipeline: identify languages, drop near copies, drop benchmark leaks, redact personal data, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs. All but the
last return the columns of `documents`. Empty and null texts: language identification rejects texts without a letter, so later stages see
none, but each of them defines a result for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patraflow.llm._bitmap import bitmap, may_contain
from patraflow.llm._store import folder, save
from patraflow.llm.decontam import clean
from patraflow.llm.jaccard import jaccard_components
from patraflow.llm.langid import fit, held_out, predict
from patraflow.llm.pii import redact
from patraflow.llm.spm import encode
from patraflow.session import prepare


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows that are not held out; lang becomes the prediction. Texts that are null or hold no letter are rejected."""
    prepare(spark)
    return predict_rows(docs, fit(docs.where(~held_out())), docs.columns.index("lang"))


def predict_rows(docs: DataFrame, model, i: int) -> DataFrame:
    """docs with column i replaced by the predicted language, without the rows that are `und`. Rows stay together: no join."""
    packed = docs.select(F.struct(*docs.columns).alias("row"), "text")
    named = predict(packed, model, "row", "text")
    columns = [F.col("lang_pred").alias(c) if k == i else F.col(f"doc_id.{c}").alias(c) for k, c in enumerate(docs.columns)]
    return named.where("lang_pred <> 'und'").select(*columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of rows that are linked by a Jaccard similarity of 0.8 or more, exact copies among them, one stays: the one with the
    smallest id, a null id coming last. Rows that share id and text count as one row, of which the smallest by all columns stays. A text
    without a word links with nothing: its rows all stay, repeated ones too."""
    prepare(spark)
    keyed = docs.withColumn("_row", F.xxhash64("doc_id", "text"))
    found = jaccard_components(keyed, "_row").groupBy(F.col("doc_id").alias("_row")).agg(F.max("n_shingles").alias("n"), F.min("component_id").alias("c"), F.count("*").alias("times"))
    found = found.join(keyed.select(F.col("_row").alias("r"), "doc_id").distinct(), F.col("_row") == F.col("r"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row", "times")).alias("x")
    best = found.where("n > 0").groupBy("c").agg(first).select("x._row", "x.times")
    best = save(best.unionByName(found.where("n = 0").select("_row", F.lit(1).cast("long").alias("times"))), "kept")
    out = keyed.join(best.where("times = 1"), "_row", "left_semi").select(*docs.columns)
    twice = best.where("times > 1").select("_row")
    if twice.limit(1).count():
        # repeated rows are brought together before they meet the key, so that one row a task is left of each
        rows = may_contain(keyed, "_row", bitmap(twice, "_row")).groupBy("_row").agg(F.min(F.struct(*docs.columns)).alias("x"))
        out = out.unionByName(rows.join(twice, "_row", "left_semi").select("x.*"))
    return out


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which a benchmark item leaks go."""
    benchmark = prepare(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    return clean(docs, benchmark)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts become the names of their kinds; n_chars follows. All documents stay."""
    prepare(spark)
    return redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the text's piece ids and their number."""
    prepare(spark)
    return encode(docs).select("doc_id", "lang", "source", "n_pieces", "ids")


STAGES = [
    ("language_id", identify_languages),
    ("jaccard_join", drop_near_copies),
    ("decontaminate", drop_benchmark_leaks),
    ("personal_data", redact_personal_data),
    ("sentencepiece", encode_pieces),
]

#: SQL can't express the learned stages; tests/llm compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole table of documents, each written in the session's shared folder."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
