"""Segmentation: prose paragraphs, table rows and sheet headings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# The break between paragraphs, and a sheet's banner line.
PARAGRAPH_BREAK = f"\n[{T.SPACE}]*\n"
SHEET_HEADING = f"\\A[{T.SPACE}]*={{3}}[{T.SPACE}]*.+?[{T.SPACE}]*={{3}}[{T.SPACE}]*\\z"


def segment(docs: DataFrame, respect_table_rows: bool = True) -> DataFrame:
    """(doc_id, seg_no, text, kind) of docs (doc_id, text, optional source_format), numbered from 0 in reading order.

    xlsx: each line that isn't blank is a heading or a row. Else: lines with a tab are rows, the lines between them up to a paragraph break
    are prose, joined by spaces. Without respect_table_rows a text is one prose segment. Blank and null texts have none.
    """
    if "source_format" not in docs.columns:
        docs = docs.withColumn("source_format", F.lit(None).cast("string"))
    c = F.col("text")
    some = docs.where(T.strip(c) != "").select("doc_id", "source_format", "text")
    if not respect_table_rows:
        return some.select("doc_id", F.lit(0).alias("seg_no"), T.strip(c).alias("text"), F.lit("prose").alias("kind"))
    sheet = F.coalesce(F.col("source_format") == "xlsx", F.lit(False))
    blocks = F.when(sheet, F.array(c)).otherwise(F.split(c, PARAGRAPH_BREAK, -1))
    rows = some.select("doc_id", sheet.alias("sheet"), F.posexplode(blocks).alias("block", "text"))
    rows = rows.select("doc_id", "sheet", "block", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).repartition("doc_id")
    rows = rows.withColumn("text", T.strip(F.col("line"))).where("text <> ''")
    atomic = F.col("sheet") | F.col("line").contains("\t")
    kind = F.when(F.col("sheet") & F.col("text").rlike(SHEET_HEADING), "sheet_heading").when(atomic, "table_row").otherwise("prose")
    rows = rows.withColumn("kind", kind)
    w = Window.partitionBy("doc_id").orderBy("block", "pos")
    starts = (F.col("kind") != "prose") | (F.lag("kind").over(w) != "prose") | (F.lag("block").over(w) != F.col("block")) | F.lag("block").over(w).isNull()
    rows = rows.withColumn("starts", starts).withColumn("seg_no", (F.sum(F.col("starts").cast("int")).over(w) - 1).cast("int"))
    return rows.groupBy("doc_id", "seg_no").agg(F.expr("listagg(text, ' ') WITHIN GROUP (ORDER BY block, pos)").alias("text"), F.first("kind").alias("kind"))
