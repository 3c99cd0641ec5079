"""The queries of this subpackage, each with its production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patraflow.session import prepare

Query = Callable[[SparkSession, str], DataFrame]


#: Byte limit of a shard in op3.
SHARD_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), texts=False)


def op3_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shards

    return shards(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spm import encode

    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"), check=True).select("doc_id", "n_pieces", "ids", "round_trip")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archived

    return archived(table(spark, sf_dir, "pages"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .nbsvm import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .oph import fingerprint_edits

    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import detect, spans_string

    found = detect(table(spark, sf_dir, "documents"))
    counts = ["n_email", "n_ip", "n_card", "n_phone"]
    every = spans_string(F.concat("base", "extra"))
    return found.select("doc_id", *counts, F.sha2(spans_string(F.col("base")), 256).alias("base_sha256"), every.alias("spans"), F.size("extra").cast("long").alias("n_learned"))


def queries() -> dict[str, Query]:
    return {k: v for k, v in globals().items() if re.match(r"op\d+_", k) and callable(v)}


_WORDS = "regexp_extract_all(coalesce({}, ''), '[^\\x20\\x09-\\x0D]+')"

_OP2 = f"""
WITH l AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, w FROM l),
x AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i <= len(w) - 19 THEN array_to_string(w[i:i + 19], ' ') END AS k FROM p),
r AS (SELECT *, k IS NOT NULL AND row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1 AS late FROM x),
g AS (SELECT *, coalesce(max(CASE WHEN late THEN i END) OVER (PARTITION BY doc_id ORDER BY i) > i - 20, false) AS gone FROM r),
d AS (SELECT doc_id, count(*) AS n_words, count_if(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM g GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN d USING (doc_id)"""

_OP6 = f"""
WITH RECURSIVE l AS (SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, CASE WHEN len(w) > 0 THEN 1 ELSE 0 END) + 1)) AS i FROM l),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * k >= 80 * (x.n + y.n - k)),
t(a, b) AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a)
SELECT documents.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, least(documents.doc_id, coalesce(min(t.b), documents.doc_id)) AS component_id
FROM documents LEFT JOIN n ON n.doc_id = documents.doc_id LEFT JOIN t ON t.a = documents.doc_id GROUP BY documents.doc_id"""

_OP7 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f"""


def oracle_sql() -> dict[str, str]:
    from .sharding import oracle

    return {"op2_substring_dedup": _OP2, "op3_extendible_sharding": oracle(SHARD_BYTES), "op6_jaccard_join": _OP6, "op7_warc": _OP7}
