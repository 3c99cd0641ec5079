"""Text cleaning: composition, control and zero-width characters, layout noise, wrapped lines, whitespace.

Character steps are row expressions. Line steps explode lines once, dealt by document, and share that distribution.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T
from ..functions.rules import is_sentence_end

# Layout noise.
PAGE_NUMBER = f"\\A[{T.SPACE}]*[\\p{{Nd}}ivxlcdmIVXLCDM]{{1,7}}[{T.SPACE}]*\\z"
DOT_LEADER, FURNITURE_REPEATS, FURNITURE_WORDS = 8, 3, 12


@dataclass(frozen=True)
class PreprocessConfig:
    normalise_unicode: bool = True
    strip_zero_width: bool = True
    drop_noise_lines: bool = True
    dewrap_lines: bool = True
    collapse_whitespace: bool = True


@F.pandas_udf(StringType())
def normalise_unicode(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def strip_controls(c: Column) -> Column:
    return F.regexp_replace(c, f"[{T.CONTROLS}]", "")


def strip_zwj(c: Column) -> Column:
    """Joiners go but for those between hal kirima and ya or ra."""
    return F.regexp_replace(c, f"(?<!{T.HAL}){T.ZWJ}|{T.ZWJ}(?![{T.YA}{T.RA}])", "")


def strip_zwnj(c: Column) -> Column:
    return F.replace(c, F.lit(T.ZWNJ), F.lit(""))


def collapse_whitespace(c: Column) -> Column:
    c = F.regexp_replace(c, f"[{T.INLINE_SPACE}]+", " ")
    c = F.regexp_replace(c, " *\n *", "\n")
    return T.strip(F.regexp_replace(c, "\n{3,}", "\n\n"))


def is_noise_line(stripped: Column) -> Column:
    return (stripped != "") & (stripped.rlike(PAGE_NUMBER) | (T.count_of(stripped, "[.]") >= DOT_LEADER))


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pos, line, stripped) of all lines, dealt by document."""
    out = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n", -1)).alias("pos", "line"))
    return out.repartition("doc_id").withColumn("stripped", T.strip(F.col("line")))


def mark_noise(rows: DataFrame) -> DataFrame:
    """Lines with noise (page numbers, dot leaders) and furniture (short lines that recur and don't end a sentence)."""
    short = T.word_count(F.col("stripped")) <= FURNITURE_WORDS
    n = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "stripped"))
    rows = rows.withColumns({"last": T.last_word(F.col("stripped")), "noise": is_noise_line(F.col("stripped")), "n": n})
    return rows.withColumn("furniture", (F.col("stripped") != "") & short & (F.col("n") >= FURNITURE_REPEATS) & ~is_sentence_end("last")).drop("n", "last")


def mark_joins(rows: DataFrame) -> DataFrame:
    """Lines with joined (goes on the line before) and island (the number of the line that it becomes part of)."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    rows = rows.withColumn("before", F.lag("stripped").over(w)).withColumn("before_word", T.last_word(F.col("before")))
    joined = (F.col("stripped") != "") & ~F.col("line").contains("\t") & (F.coalesce("before", F.lit("")) != "") & ~F.col("before").contains("\t") & ~is_sentence_end("before_word")
    rows = rows.withColumn("joined", joined)
    return rows.withColumn("island", F.sum(F.when(F.col("joined"), 0).otherwise(1)).over(w)).drop("before", "before_word")


def texts(rows: DataFrame, column: str = "stripped") -> DataFrame:
    """(doc_id, text, joins) of lines with islands."""
    part = rows.groupBy("doc_id", "island").agg(F.expr(f"listagg({column}, ' ') WITHIN GROUP (ORDER BY pos)").alias("line"), F.count_if("joined").alias("joins"))
    return part.groupBy("doc_id").agg(F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY island)").alias("text"), F.sum("joins").alias("joins"))


def drop_noise_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text, dropped)."""
    rows = mark_noise(lines(docs)).withColumn("gone", F.col("noise") | F.col("furniture"))
    return rows.groupBy("doc_id").agg(F.coalesce(F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY pos) FILTER (WHERE NOT gone)"), F.lit("")).alias("text"), F.count_if("gone").alias("dropped"))


def dewrap(docs: DataFrame) -> DataFrame:
    """(doc_id, text, joins)."""
    return texts(mark_joins(lines(docs)))


def clean(docs: DataFrame, config: PreprocessConfig = PreprocessConfig()) -> DataFrame:
    """doc_id, text, original_length, removed_characters and a counter of each stage (null where a stage is off).

    docs has unique ids. Null texts stay null. Line stages go through one exchange by document, in which a line that only
    carries the document's own values stands before the text's lines.
    """
    c = F.col("text")
    rows = docs.select("doc_id", c, F.length(c).alias("original_length"))
    if config.normalise_unicode:
        rows = rows.withColumn("raw", c).withColumn("text", normalise_unicode(c)).withColumn("nfc_changed", (c != F.col("raw")).cast("int")).drop("raw")
    else:
        rows = rows.withColumn("nfc_changed", F.lit(None).cast("int"))
    counters = [("controls_removed", strip_controls), ("zwj_removed", strip_zwj), ("zwnj_removed", strip_zwnj)]
    for name, step in counters:
        if config.strip_zero_width:
            rows = rows.withColumn("new", step(c)).withColumn(name, F.length(c) - F.length("new")).withColumn("text", F.col("new")).drop("new")
        else:
            rows = rows.withColumn(name, F.lit(None).cast("int"))
    if config.drop_noise_lines or config.dewrap_lines:
        carried = ["original_length", "nfc_changed", *(n for n, _ in counters)]
        null_text = F.array(F.lit(None).cast("string"))
        own = F.when(c.isNull(), null_text).otherwise(F.concat(null_text, F.split(c, "\n", -1)))
        at = rows.select("doc_id", F.struct(*carried).alias("own"), F.posexplode(own).alias("pos", "line")).repartition("doc_id")
        at = at.withColumn("own", F.when(F.col("pos") == 0, F.col("own"))).withColumn("stripped", F.coalesce(T.strip(F.col("line")), F.lit("")))
        at = mark_noise(at) if config.drop_noise_lines else at.withColumns({"noise": F.lit(False), "furniture": F.lit(False)})
        at = at.withColumn("gone", F.col("noise") | F.col("furniture"))
        dropped = F.count_if("gone").over(Window.partitionBy("doc_id"))
        at = at.withColumn("dropped", dropped).where("not gone")
        if config.dewrap_lines:
            at, kept = mark_joins(at), "IF(line IS NULL, NULL, stripped)"
        else:
            at, kept = at.withColumns({"joined": F.lit(False), "island": F.col("pos")}), "line"
        part = at.groupBy("doc_id", "island").agg(F.expr(f"listagg({kept}, ' ') WITHIN GROUP (ORDER BY pos)").alias("line"), F.count_if("joined").alias("joins"), F.max("own").alias("own"), F.max("dropped").alias("dropped"))
        done = part.groupBy("doc_id").agg(F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY island)").alias("text"), F.sum("joins").alias("joins"), F.max("own").alias("own"), F.max("dropped").alias("dropped"))
        text = F.when(F.col("own.original_length").isNotNull(), F.coalesce("text", F.lit("")))
        rows = done.select("doc_id", text.alias("text"), "own.*", F.when(F.lit(config.drop_noise_lines), F.col("dropped").cast("int")).alias("noise_lines_dropped"), F.when(F.lit(config.dewrap_lines), F.col("joins").cast("int")).alias("lines_joined"))
    else:
        rows = rows.withColumns({n: F.lit(None).cast("int") for n in ("noise_lines_dropped", "lines_joined")})
    if config.collapse_whitespace:
        rows = rows.withColumn("new", collapse_whitespace(c)).withColumn("whitespace_collapsed", F.length(c) - F.length("new")).withColumn("text", F.col("new")).drop("new")
    else:
        rows = rows.withColumn("whitespace_collapsed", F.lit(None).cast("int"))
    return rows.withColumn("removed_characters", F.col("original_length") - F.length("text"))
