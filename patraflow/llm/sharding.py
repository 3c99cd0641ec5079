"""Sharding by extendible hashing, with DataFrame operations only.

A row's hash is that of its id. A bucket is a prefix of hash bits; one that holds more than `limit` bytes splits on its next bit, and only
such a bucket does, until each fits. The work goes by rounds of BITS bits: byte sums of the cells of a round (prefixes of full length, so
few rows whatever the table's size) give the sums of all shorter prefixes, and the shallowest prefix that fits is the bucket. Cells whose
full prefix is still too large go on to the next round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import save

#: Bits of the hash, and of one round.
WIDTH, BITS = 60, 12


def hash60(column):
    """The first 60 bits of the MD5 of the value as text; null counts as an empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(column.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def directory(cells: DataFrame, limit: int) -> DataFrame:
    """Buckets (depth, prefix, shard_bytes, shard_docs) of the cells (h, bytes, docs): disjoint prefixes that cover all cells."""
    left, done, top = cells, None, 0
    while True:
        depth = min(top + BITS, WIDTH)
        full = save(left.groupBy(F.shiftright("h", WIDTH - depth).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs")), "cells")
        levels = full.select(F.explode(F.sequence(F.lit(top), F.lit(depth))).alias("depth"), "cell", "bytes", "docs")
        levels = levels.select("depth", F.expr(f"shiftright(cell, {depth} - depth)").alias("prefix"), "bytes", "docs")
        sums = levels.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"))
        fits = (F.col("shard_bytes") <= limit) | (F.col("depth") == WIDTH)
        # a prefix is a bucket if it fits and the prefix above it does not; that of this round's top does not, or is the first of all
        above = sums.where(~fits).select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
        first = sums.where(fits & (F.col("depth") == 0)) if top == 0 else sums.where("false")
        found = sums.where(fits).join(above, ["depth", "prefix"], "left_semi").unionByName(first)
        done = found if done is None else done.unionByName(found)
        if depth == WIDTH:
            return done
        heavy = sums.where(~fits & (F.col("depth") == depth)).select(F.col("prefix").alias("cell"))
        if not heavy.limit(1).count():
            return done
        left = save(left.join(heavy, F.shiftright("h", WIDTH - depth) == F.col("cell"), "left_semi"), "heavy")
        top = depth


def shards(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, shard (its prefix as a string of bits; empty if one shard holds all), depth, shard_bytes,
    shard_docs, oversized.

    Null texts have 0 bytes. Rows of one id have one hash and stay together; a bucket of a single hash may exceed the limit, and is then
    `oversized`. An empty table gives no rows. Other columns are not read.
    """
    rows = save(docs.select(F.col(id_col).alias("doc_id"), hash60(F.col(id_col)).alias("h"), F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long").alias("n_bytes")), "rows")
    cells = save(rows.groupBy("h").agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("docs")), "hashes")
    buckets = save(directory(cells, limit), "directory")
    # the hash's bucket is the longest of its prefixes that is one; a directory by full hash keeps this an equi-join
    depths = [r[0] for r in buckets.select("depth").distinct().collect()]  # at most WIDTH + 1
    at = cells.select("h", F.explode(F.array(*map(F.lit, depths)) if depths else F.array().cast("array<int>")).alias("depth"))
    at = at.withColumn("prefix", F.expr(f"shiftright(h, {WIDTH} - depth)")).join(buckets, ["depth", "prefix"])
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
    placed = at.select("h", bits.alias("shard"), "depth", "shard_bytes", "shard_docs")
    return rows.join(placed, "h").select("doc_id", "n_bytes", "shard", "depth", "shard_bytes", "shard_docs", (F.col("shard_bytes") > limit).alias("oversized"))


def oracle(limit: int, table: str = "documents") -> str:
    """DuckDB SQL for shards()."""
    return f"""
WITH r AS (
  SELECT doc_id, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h, coalesce(strlen(text), 0)::BIGINT AS n_bytes FROM {table}
), p AS (
  SELECT r.*, d::INT AS depth, r.h >> ({WIDTH} - d)::INT AS prefix FROM r, range(0, {WIDTH} + 1) AS t(d)
), s AS (
  SELECT *, sum(n_bytes) OVER (PARTITION BY depth, prefix) AS shard_bytes, count(*) OVER (PARTITION BY depth, prefix) AS shard_docs FROM p
), b AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, h, n_bytes ORDER BY depth) AS k FROM s WHERE shard_bytes <= {limit} OR depth = {WIDTH}
)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE substr(right(repeat('0', {WIDTH}) || bin(h), {WIDTH}), 1, depth) END AS shard,
  depth, CAST(shard_bytes AS BIGINT) AS shard_bytes, shard_docs, shard_bytes > {limit} AS oversized
FROM b WHERE k = 1"""
