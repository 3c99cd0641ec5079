"""Page repair: which pages must be read again, by OCR and then by a transcriber, and the document's text afterwards."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import BudgetExceededError
from ..functions import quality as Q
from ..functions import text as T
from ..steps import stored

# Page decisions.
MIN_CHARS, MIN_IMAGE_COVERAGE = 20, 0.5
PAGE_BREAK = "\n\n"

#: (doc_id, page, image bytes or None) -> text; may raise, which counts as no text.
Reader = Callable[[object, int, bytes | None], str]


@dataclass(frozen=True)
class MultimodalConfig:
    provider: str
    model: str | None = None
    max_pages: int = 20
    dpi: int = 200

    def __post_init__(self):
        if self.provider not in ("gemini", "openai", "claude"):
            raise ValueError(f"unknown provider {self.provider}")
        if self.max_pages < 1 or self.dpi < 72:
            raise ValueError("max_pages is below 1 or dpi below 72")


def resolve_model(config: MultimodalConfig, model: str | None = None, defaults: dict[str, str] | None = None) -> str | None:
    """The call's model, else the configuration's, else the provider's default."""
    return model or config.model or (defaults or {}).get(config.provider)


def _area(r: Column) -> Column:
    return F.greatest(r["x1"] - r["x0"], F.lit(0.0)) * F.greatest(r["y1"] - r["y0"], F.lit(0.0))


def image_coverage(rect: Column, images: Column) -> Column:
    """The largest share of the page that one image covers; 0 without a page area or an image."""
    page = _area(rect)

    def share(i):
        w = F.least(i["x1"], rect["x1"]) - F.greatest(i["x0"], rect["x0"])
        h = F.least(i["y1"], rect["y1"]) - F.greatest(i["y0"], rect["y0"])
        return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0)) / page

    return F.when(page > 0, F.coalesce(F.array_max(F.transform(F.filter(images, lambda i: i.isNotNull()), share)), F.lit(0.0))).otherwise(0.0)


def needs_ocr(text: Column, coverage: Column, repair_malformed: bool = True) -> Column:
    """Malformed text first, then enough text, then image coverage."""
    out = F.when(Q.is_malformed(text), F.lit(True)) if repair_malformed else F.when(F.lit(False), F.lit(True))
    return out.when(F.length(T.strip(text)) >= MIN_CHARS, F.lit(False)).otherwise(coverage >= MIN_IMAGE_COVERAGE)


def still_bad(text: Column) -> Column:
    return (F.length(T.strip(F.coalesce(text, F.lit("")))) < MIN_CHARS) | F.coalesce(Q.is_malformed(text), F.lit(False))


def read_pages(pages: DataFrame, reader: Reader) -> DataFrame:
    """(doc_id, page, new): pages (doc_id, page, optional image) read anew; pages whose reading fails give no row."""
    if "image" not in pages.columns:
        pages = pages.withColumn("image", F.lit(None).cast("binary"))

    def run(parts):
        for part in parts:
            out = []
            for d, p, image in part[["doc_id", "page", "image"]].itertuples(index=False):
                try:
                    out.append((d, p, reader(d, p, image) or ""))
                except Exception:  # one page's failure must not lose the document
                    continue
            yield pd.DataFrame(out, columns=["doc_id", "page", "new"])

    kind = pages.schema["doc_id"].dataType.simpleString()
    return pages.select("doc_id", "page", "image").repartition("doc_id", "page").mapInPandas(run, f"doc_id {kind}, page int, new string")


def over_budget(pages: DataFrame, max_pages: int) -> DataFrame:
    """(doc_id, needed) of documents with more pages to transcribe than allowed."""
    return pages.groupBy("doc_id").agg(F.count("*").alias("needed")).where(F.col("needed") > max_pages)


def repair(pages: DataFrame, ocr: DataFrame | Reader | None = None, transcriber: DataFrame | Reader | None = None, config: MultimodalConfig | None = None) -> DataFrame:
    """(doc_id, page, text, source) of pages (doc_id, page, text, rect, images): source is layer, ocr or multimodal.

    Pages that need it are read by OCR; those that are still bad go to the transcriber, if config allows it. Readings are given
    as (doc_id, page, new) or as a function, whose readings are stored, so that no page is read twice. A document over budget is an error
    before the transcriber's first call; that check is an action of this function.
    """
    coverage = image_coverage(F.col("rect"), F.col("images"))
    marked = stored(pages.withColumn("need", needs_ocr(F.col("text"), coverage)), "pages")
    out = marked.select("doc_id", "page", "text", "need")
    wanted = marked.where("need")

    def readings(rows, by, name):
        if by is None:
            return None
        got = by if isinstance(by, DataFrame) else stored(read_pages(rows, by), name)
        return got.join(rows.select("doc_id", "page"), ["doc_id", "page"], "left_semi").withColumnRenamed("new", name)

    first = readings(wanted, ocr, "ocr")
    out = out.withColumn("ocr", F.lit(None).cast("string")) if first is None else out.join(first, ["doc_id", "page"], "left")
    if config is not None and transcriber is not None:
        bad = out.where(F.col("need") & still_bad(F.coalesce("ocr", "text"))).select("doc_id", "page")
        bad = bad.join(marked, ["doc_id", "page"]) if "image" in pages.columns else bad
        if worst := over_budget(bad, config.max_pages).orderBy(F.desc("needed")).first():
            raise BudgetExceededError(worst["needed"], config.max_pages)
        second = readings(bad, transcriber, "vlm")
        out = out.join(second, ["doc_id", "page"], "left")
    else:
        out = out.withColumn("vlm", F.lit(None).cast("string"))
    source = F.when(F.col("vlm").isNotNull(), "multimodal").when(F.col("ocr").isNotNull(), "ocr").otherwise("layer")
    return out.select("doc_id", "page", F.coalesce("vlm", "ocr", "text").alias("text"), source.alias("source"))


def repaired_documents(winners: DataFrame, pages: DataFrame) -> DataFrame:
    """winners (doc_id, backend_id, text) with the text of repaired pages, where any page was: the pages joined by blank lines, while
    backend_id still names the race's winner. Adds pages_ocred, pages_multimodal and quality."""
    numbers = lambda kind: F.sort_array(F.collect_list(F.when(F.col("source") == kind, F.col("page"))))
    per = pages.groupBy("doc_id").agg(F.expr(f"listagg(text, '{PAGE_BREAK}') WITHIN GROUP (ORDER BY page)").alias("joined"), numbers("ocr").alias("pages_ocred"), numbers("multimodal").alias("pages_multimodal"))
    both = winners.join(per, "doc_id", "left")
    fixed = F.coalesce(F.size("pages_ocred") + F.size("pages_multimodal"), F.lit(0)) > 0
    none = F.array().cast("array<int>")
    both = both.withColumn("text", F.when(fixed, F.col("joined")).otherwise(F.col("text"))).withColumns({c: F.coalesce(c, none) for c in ("pages_ocred", "pages_multimodal")})
    return both.drop("joined").withColumn("quality", Q.score(F.col("text")))
