"""Legacy-font conversion of spans and of whole texts, by a conversion table that the caller supplies.

A table is a mapping of legacy strings to Unicode strings, applied longest first at each place. None is shipped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import fonts as N

Tables = Mapping[str, Mapping[str, str]]


def available_mappings(tables: Tables) -> list[str]:
    return sorted(tables) or [N.DEFAULT_MAPPING]


def converter(tables: Tables):
    """A column function (text, table's name) -> converted text. Empty texts stay; an unknown table is an error."""
    plain = {k: dict(v) for k, v in tables.items()}

    @F.pandas_udf(StringType())
    def convert(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        ready = {k: re.compile("|".join(re.escape(x) for x in sorted(v, key=len, reverse=True))) for k, v in plain.items() if v}

        def one(text, name):
            if not text or name is None:
                return text
            if name not in plain:
                raise ValueError(f"no conversion table is called {name}")
            return ready[name].sub(lambda m: plain[name][m[0]], text) if name in ready else text

        for texts, names in parts:
            yield pd.Series([one(t, n) for t, n in zip(texts, names, strict=True)])

    return convert


def _real() -> Column:
    return ~F.coalesce(F.col("synthetic"), F.lit(False))


def font_table(spans: DataFrame) -> DataFrame:
    """(font, name, class, table) of the distinct fonts of real spans: each name is classified once, however many spans have it."""
    fonts = spans.where(_real() & F.col("font").isNotNull()).select("font").distinct()
    return fonts.select("font", N.normalise_font_name(F.col("font")).alias("name"), N.classify_font(F.col("font")).alias("class"), N.mapping_of(F.col("font")).alias("table"))


def with_fonts(spans: DataFrame) -> DataFrame:
    """spans with name, class and table; null for separators."""
    table = font_table(spans).withColumnRenamed("font", "_font")
    return spans.join(table, _real() & (F.col("font") == F.col("_font")), "left").drop("_font")


def normalise_spans(spans: DataFrame, tables: Tables) -> DataFrame:
    """(doc_id, text, method, converted_fonts, unmapped_fonts) of spans (doc_id, pos, text, font, synthetic).

    Separators and fonts that can't be mapped stay as they are. Spans without a mapping skip the conversion.
    """
    rows = with_fonts(spans).withColumn("class", F.when(_real(), F.coalesce("class", F.lit("unknown"))))
    rows = rows.where("table is null").withColumn("out", F.col("text")).unionByName(rows.where("table is not null").withColumn("out", converter(tables)("text", "table")))
    names = lambda kind: F.sort_array(F.collect_set(F.when(F.col("class") == kind, F.col("name"))))
    done = rows.groupBy("doc_id").agg(
        F.coalesce(F.expr("listagg(out, '') WITHIN GROUP (ORDER BY pos)"), F.lit("")).alias("text"), names("legacy_mappable").alias("converted_fonts"), names("legacy_unmappable").alias("unmapped_fonts")
    )
    return done.withColumn("method", F.when(F.size("converted_fonts") > 0, "font_name").otherwise("none"))


def normalise(docs: DataFrame, tables: Tables, allow_ratio_fallback: bool = True) -> DataFrame:
    """docs (text, fonts array) with text converted as a whole, and method, converted_fonts, unmapped_fonts. The first mappable font in
    order names the table; else the ratio heuristic may apply the default table."""
    named = F.array_sort(F.array_distinct(F.transform(F.filter("fonts", lambda f: f != ""), N.normalise_font_name)))
    rows = docs.withColumn("_names", named)
    of = lambda kind: F.filter("_names", lambda f: N.classify_font(f) == kind)
    rows = rows.withColumns({"_good": of("legacy_mappable"), "unmapped_fonts": of("legacy_unmappable")})
    fires = F.lit(allow_ratio_fallback) & N.ratio_heuristic(F.col("text"), F.col("_names"))
    method = F.when(F.size("_good") > 0, "font_name").when(fires, "character_ratio").otherwise("none")
    rows = rows.withColumn("method", method)
    table = F.when(F.col("method") == "font_name", N.mapping_of(F.col("_good")[0])).when(F.col("method") == "character_ratio", F.lit(N.DEFAULT_MAPPING))
    rows = rows.withColumn("_table", table).withColumn("converted_fonts", F.when(F.col("method") == "font_name", F.col("_good")).otherwise(F.array().cast("array<string>")))
    done = rows.where("_table is null").unionByName(rows.where("_table is not null").withColumn("text", converter(tables)("text", "_table")))
    return done.drop("_names", "_good", "_table")


def fonts_by_class(spans: DataFrame, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*by, class, fonts): sorted distinct font names of each class."""
    return with_fonts(spans.where("not coalesce(synthetic, false) and font <> ''")).groupBy(*by, "class").agg(F.sort_array(F.collect_set("name")).alias("fonts"))


def any_legacy(spans: DataFrame) -> DataFrame:
    """Documents with a mappable span."""
    return with_fonts(spans).where("class = 'legacy_mappable'").select("doc_id").distinct()


def normalise_legacy(docs: DataFrame, tables: Tables) -> DataFrame:
    """Only text, method and converted_fonts of normalise()."""
    done = normalise(docs, tables)
    return done.select(*(c for c in docs.columns if c not in ("text", "fonts")), "text", "method", "converted_fonts")


def page_texts(spans: DataFrame, tables: Tables) -> DataFrame:
    """(doc_id, page, text): spans with pages (sources.ingest.page_of_spans), normalised page by page."""
    keyed = spans.withColumn("doc_id", F.struct("doc_id", "page"))
    return normalise_spans(keyed, tables).select("doc_id.doc_id", "doc_id.page", "text")
