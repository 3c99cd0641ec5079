"""Facades: files or texts in, documents and chunks out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import ExtractionFailedError
from .functions import quality as Q
from .operators import candidates as C
from .operators.chunk import ChunkConfig, Scorer, chunk_text
from .operators.clean import PreprocessConfig, clean
from .operators.normalise import Tables, normalise_spans, with_fonts
from .operators.repair import MultimodalConfig, repair, repaired_documents
from .session import prepare
from .sources import ingest as I
from .steps import stored


_ERRORS = "error_type", "error_message"


def route(spark: SparkSession, path: str, tables: Tables | None = None, pages: DataFrame | None = None, ocr=None, transcriber=None, multimodal: MultimodalConfig | None = None) -> DataFrame:
    """Documents of the files below path: doc_id (the path), source_format, backend_id, text, method, converted_fonts, unmapped_fonts,
    pages_ocred, pages_multimodal, quality, status, error_type, error_message. A file that fails is a row with its error.

    PDFs go through all backends once, and through the span candidate where the tables convert a font of theirs; the best text wins. pages
    (doc_id, page, text, rect, images and optionally image) with a reader for ocr or a transcriber repairs pages, as operators.repair does.
    """
    found = I.detect_formats(I.files(prepare(spark), path))
    spans = stored(I.parse_spans(found).withColumnRenamed("path", "doc_id"), "spans")
    kinds = found.select(F.col("path").alias("doc_id"), F.col("format").alias("source_format"), F.col("error_type").alias("_e"))
    good = spans.where("error_type is null")
    flat = stored(normalise_spans(good, tables) if tables else _plain(good), "texts")
    converted = flat.where("size(converted_fonts) > 0").join(kinds.where("source_format = 'pdf'").select("doc_id"), "doc_id", "left_semi")
    swept = stored(I.sweep_pdfs(found), "sweep")
    ready = stored(C.scored(swept, converted), "candidates")
    won = C.select(ready).select("doc_id", F.col("winner.backend_id").alias("backend_id")).join(ready.select("doc_id", "backend_id", "text"), ["doc_id", "backend_id"])
    pdf = won.join(flat.select("doc_id", "converted_fonts", "unmapped_fonts"), "doc_id", "left").withColumn("converted_fonts", F.when(F.col("backend_id") == C.SPAN_BACKEND, F.col("converted_fonts")))
    office = flat.join(kinds.where("source_format <> 'pdf'").select("doc_id"), "doc_id", "left_semi").select("doc_id", F.lit("spans").alias("backend_id"), "text", "converted_fonts", "unmapped_fonts")
    done = office.unionByName(pdf)
    if pages is not None:
        done = repaired_documents(done, repair(pages, ocr, transcriber, multimodal))
    else:
        done = done.withColumns({c: F.array().cast("array<int>") for c in ("pages_ocred", "pages_multimodal")})
    null = F.lit(None).cast("string")
    message = F.array_join(F.transform("attempts", lambda a: F.concat(a["backend_id"], F.lit(": "), a["error_type"])), "; ")
    failed = C.attempts(swept).join(converted.select("doc_id"), "doc_id", "left_anti").where("usable = 0").select("doc_id", F.lit(ExtractionFailedError.__name__).alias("error_type"), message.alias("error_message"))
    broken = spans.where("error_type is not null").join(kinds.where("source_format <> 'pdf'").select("doc_id"), "doc_id", "left_semi").select("doc_id", *_ERRORS)
    unknown = kinds.where("_e is not null").select("doc_id", F.col("_e").alias("error_type"), null.alias("error_message"))
    errors = failed.unionByName(broken).unionByName(unknown)
    out = kinds.drop("_e").join(done.drop("quality"), "doc_id", "left").join(errors, "doc_id", "left")
    none, text = F.array().cast("array<string>"), F.when(F.col("error_type").isNull(), F.coalesce("text", F.lit("")))
    method = F.when(F.size(F.coalesce("converted_fonts", none)) > 0, "font_name").otherwise("none")
    return out.select(
        "doc_id",
        "source_format",
        "backend_id",
        text.alias("text"),
        method.alias("method"),
        F.coalesce("converted_fonts", none).alias("converted_fonts"),
        F.coalesce("unmapped_fonts", none).alias("unmapped_fonts"),
        F.coalesce("pages_ocred", F.array().cast("array<int>")).alias("pages_ocred"),
        F.coalesce("pages_multimodal", F.array().cast("array<int>")).alias("pages_multimodal"),
        Q.score(text).alias("quality"),
        F.when(F.col("error_type").isNull(), "ok").otherwise("error").alias("status"),
        *_ERRORS,
    )


def _plain(spans: DataFrame) -> DataFrame:
    """Spans without a conversion table: mappable fonts are reported as unmapped."""
    names = F.sort_array(F.collect_set(F.when(F.col("class").isin("legacy_mappable", "legacy_unmappable"), F.col("name"))))
    return with_fonts(spans).groupBy("doc_id").agg(F.expr("listagg(text, '') WITHIN GROUP (ORDER BY pos)").alias("text"), names.alias("unmapped_fonts")).withColumns({"method": F.lit("none"), "converted_fonts": F.array().cast("array<string>")})


def clean_and_chunk(docs: DataFrame, config: ChunkConfig = ChunkConfig(), scorer: float | Scorer = 1.0, cleaning: PreprocessConfig = PreprocessConfig()) -> DataFrame:
    """Chunks of the cleaned texts of docs (doc_id, text, optional source_format and source_document)."""
    kept = [c for c in ("source_format", "source_document") if c in docs.columns]
    cleaned = clean(docs.select("doc_id", "text"), cleaning).select("doc_id", "text")
    return chunk_text(cleaned.join(docs.select("doc_id", *kept), "doc_id") if kept else cleaned, config, scorer)
