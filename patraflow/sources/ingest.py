"""Files to spans: format detection, DOCX and XLSX by the standard library, PDF by optional backends.

Each file is one row of a binaryFile scan; a fault of a file is a row with an error, never a failed job.
"""

from __future__ import annotations

import importlib
import io
import re
import threading
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..errors import AdapterUnavailableError, UnsupportedFormatError
from ..operators.candidates import ERROR_CHARS, PDF_BACKENDS

# What tells formats, and seconds that a backend may take for a file.
BACKEND_SECONDS = 120.0
PDF_MAGIC, PDF_WINDOW = b"%PDF", 1024
ZIP_MARKERS = (("word/document.xml", "docx"), ("xl/workbook.xml", "xlsx"))
EXTENSIONS = {"pdf": "pdf", "docx": "docx", "xlsx": "xlsx"}
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_P = "{http://schemas.openxmlformats.org/package/2006/relationships}"
Span = tuple[str, str, str, bool]  # text, font, location, synthetic


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def format_of(content: bytes | None) -> tuple[str | None, str | None]:
    """(format, warning); structure decides, a PDF header first."""
    content = content or b""
    at = content[:PDF_WINDOW].find(PDF_MAGIC)
    if at >= 0:
        return "pdf", f"the PDF header is at {at}" if at else None
    try:
        members = set(zipfile.ZipFile(io.BytesIO(content)).namelist())
    except zipfile.BadZipFile:
        return None, None
    found = [kind for marker, kind in ZIP_MARKERS if marker in members]
    return (found[0], "several OOXML formats: " + ", ".join(found) if len(found) > 1 else None) if found else (None, None)


@F.pandas_udf(StructType([StructField("format", StringType()), StructField("warning", StringType())]))
def _detect(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([format_of(c) for c in content], columns=["format", "warning"])


def detect_formats(scanned: DataFrame) -> DataFrame:
    """scanned (path, content) with format, warning, status and error_type. An extension that disagrees only warns."""
    rows = scanned.withColumn("_d", _detect("content"))
    hint = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    wrong = hint.isin(*EXTENSIONS) & (hint != F.col("_d.format"))
    warning = F.coalesce("_d.warning", F.when(wrong, F.concat(F.lit("the extension is "), hint)))
    bad = F.col("_d.format").isNull()
    return rows.select(*scanned.columns, F.col("_d.format").alias("format"), warning.alias("warning"), F.when(bad, "error").otherwise("ok").alias("status"), F.when(bad, UnsupportedFormatError.__name__).alias("error_type"))


def _font(properties, styles: dict[str, str]) -> str | None:
    if properties is None:
        return None
    fonts = properties.find(f"{_W}rFonts")
    direct = next((fonts.get(f"{_W}{a}") for a in ("ascii", "hAnsi") if fonts.get(f"{_W}{a}")), None) if fonts is not None else None
    style = properties.find(f"{_W}rStyle")
    return direct or (styles.get(style.get(f"{_W}val")) if style is not None else None)


def docx_spans(content: bytes) -> Iterator[Span]:
    """One span per run with text, in body order; tabs between cells, line feeds after rows and blocks. The font is the run's, else its
    style's, else that of the Normal style."""
    archive = zipfile.ZipFile(io.BytesIO(content))
    styles: dict[str, str] = {}
    normal = ""
    if "word/styles.xml" in archive.namelist():
        for style in ElementTree.fromstring(archive.read("word/styles.xml")).iter(f"{_W}style"):
            if font := _font(style.find(f"{_W}rPr"), {}):
                styles[style.get(f"{_W}styleId")] = font
                name = style.find(f"{_W}name")
                if name is not None and name.get(f"{_W}val") == "Normal":
                    normal = font

    def text_of(run) -> str:
        marks = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n", f"{_W}noBreakHyphen": "-"}
        return "".join(x.text or "" if x.tag == f"{_W}t" else marks.get(x.tag, "") for x in run)

    def paragraph(p) -> Iterator[Span]:
        for run in p.iter(f"{_W}r"):
            if text := text_of(run):
                yield text, _font(run.find(f"{_W}rPr"), styles) or normal, "", False

    def table(t) -> Iterator[Span]:
        for row in t.findall(f"{_W}tr"):
            for i, cell in enumerate(row.findall(f"{_W}tc")):
                if i:
                    yield "\t", "", "", True
                yield from blocks(cell, False)
            yield "\n", "", "", True

    def blocks(parent, breaks: bool) -> Iterator[Span]:
        for child in parent:
            if child.tag in (f"{_W}p", f"{_W}tbl"):
                yield from (paragraph if child.tag == f"{_W}p" else table)(child)
                if breaks:
                    yield "\n", "", "", True

    body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_W}body")
    if body is not None:
        yield from blocks(body, True)


def _value(cell, shared: list[str]):
    kind, v = cell.get("t", "n"), cell.find(f"{_S}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_S}t"))
    if v is None or v.text is None:
        return None
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return "True" if v.text == "1" else "False"
    if kind == "n":
        number = float(v.text)
        return str(int(number)) if re.fullmatch(r"[-+]?\d+", v.text) else str(number)
    return v.text


def xlsx_spans(content: bytes) -> Iterator[Span]:
    """A banner line per sheet, one span per cell with a value (formulas by their cached value), tabs between cells, line feeds after
    rows, a blank line between sheets."""
    archive = zipfile.ZipFile(io.BytesIO(content))
    read = lambda name: ElementTree.fromstring(archive.read(name)) if name in archive.namelist() else None
    strings = read("xl/sharedStrings.xml")
    shared = [] if strings is None else ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in strings.findall(f"{_S}si")]
    sheet_styles = read("xl/styles.xml")
    cell_fonts: list[str] = []
    if sheet_styles is not None:
        names = [next((n.get("val", "") for n in f.iter(f"{_S}name")), "") for f in sheet_styles.findall(f"{_S}fonts/{_S}font")]
        cell_fonts = [names[int(x.get("fontId", 0))] if names else "" for x in sheet_styles.findall(f"{_S}cellXfs/{_S}xf")]
    relations = read("xl/_rels/workbook.xml.rels")
    targets = {} if relations is None else {r.get("Id"): r.get("Target") for r in relations.iter(f"{_P}Relationship")}
    for i, sheet in enumerate(read("xl/workbook.xml").iter(f"{_S}sheet")):
        if i:
            yield "\n", "", "", True
        title = sheet.get("name")
        yield f"=== {title} ===\n", "", "", True
        target = targets.get(sheet.get(f"{_R}id"), "")
        data = read(target.lstrip("/") if target.startswith("/") else f"xl/{target}")
        for row in () if data is None else data.iter(f"{_S}row"):
            some = [(c, v) for c in row.findall(f"{_S}c") if (v := _value(c, shared)) is not None]
            for k, (cell, value) in enumerate(some):
                if k:
                    yield "\t", "", "", True
                style = int(cell.get("s", 0))
                yield value, cell_fonts[style] if style < len(cell_fonts) else "", f"{title}!{cell.get('r', '')}", False
            if some:
                yield "\n", "", "", True


def pdf_pages(backend: str, content: bytes) -> list[str]:
    """Texts of the pages by an optional backend."""
    stream = io.BytesIO(content)
    try:
        if backend == "pypdf":
            from pypdf import PdfReader

            return [p.extract_text() or "" for p in PdfReader(stream).pages]
        if backend == "pymupdf":
            return [p.get_text() for p in _pymupdf().open(stream=content, filetype="pdf")]
        if backend == "pdfplumber":
            import pdfplumber

            return [p.extract_text() or "" for p in pdfplumber.open(stream).pages]
        if backend == "pdfminer":
            from pdfminer.high_level import extract_text

            pages = extract_text(stream).split("\f")
            return pages[:-1] if len(pages) > 1 and not pages[-1].strip() else pages
    except ImportError as e:
        raise AdapterUnavailableError(f"{backend} is not installed") from e
    raise ValueError(f"unknown backend {backend}")


def _pymupdf():
    """The module, under its present or its former name."""
    for name in ("pymupdf", "fitz"):
        try:
            return importlib.import_module(name)
        except ImportError:
            continue
    raise AdapterUnavailableError("pymupdf is not installed")


def pdf_page_count(content: bytes) -> int:
    return _pymupdf().open(stream=content, filetype="pdf").page_count


def pdf_spans(content: bytes, first: int | None = None, last: int | None = None) -> Iterator[Span]:
    """Spans with fonts of the pages from first to last (from 0, both included), by PyMuPDF: a line feed after lines and blocks, a form feed
    between pages."""
    document = _pymupdf().open(stream=content, filetype="pdf")
    begin = 0 if first is None else first
    for n in range(begin, (document.page_count - 1 if last is None else last) + 1):
        page = document[n]
        if n > begin:
            yield "\f", "", f"page:{n}", True
        for block in page.get_text("dict")["blocks"]:
            for line in block.get("lines", []):
                yield from ((s["text"], s["font"], f"page:{n}", False) for s in line["spans"] if s["text"])
                yield "\n", "", f"page:{n}", True
            yield "\n", "", f"page:{n}", True


_PARSERS = {"docx": docx_spans, "xlsx": xlsx_spans, "pdf": pdf_spans}
_SPANS = "path string, pos int, text string, font string, location string, synthetic boolean, error_type string, error_message string"


def parse_spans(detected: DataFrame) -> DataFrame:
    """(path, pos, text, font, location, synthetic) of files of known format; a file that fails has one row with its error."""

    def run(parts):
        for part in parts:
            out = []
            for path, content, kind in part.itertuples(index=False):
                try:
                    out += [(path, i, *s, None, None) for i, s in enumerate(_PARSERS[kind](content))]
                except Exception as e:  # a broken file is a row
                    out.append((path, None, None, None, None, None, type(e).__name__, str(e)[:ERROR_CHARS]))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in _SPANS.split(", ")])

    return detected.where("format is not null").select("path", "content", "format").mapInPandas(run, _SPANS)


def within(seconds: float, work: Callable):
    """work()'s result; a TimeoutError once the time is over. What hangs goes on in a thread that ends with the worker."""
    out: list = []

    def run():
        try:
            out.append((work(), None))
        except Exception as e:
            out.append((None, e))

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    if not out:
        raise TimeoutError(f"no result after {seconds:g} seconds")
    if out[0][1] is not None:
        raise out[0][1]
    return out[0][0]


def sweep_pdfs(detected: DataFrame, backends=PDF_BACKENDS, seconds: float = BACKEND_SECONDS) -> DataFrame:
    """Each PDF by each backend: (doc_id, ordinal, backend_id, cost, text, error_type, error_message); doc_id is the path. A file goes to its
    worker once; a backend that takes longer than `seconds` for it has failed."""
    schema = "doc_id string, ordinal int, backend_id string, cost int, text string, error_type string, error_message string"

    def run(parts):
        for part in parts:
            out = []
            for path, content in part.itertuples(index=False):
                for ordinal, (name, cost) in enumerate(backends):
                    try:
                        out.append((path, ordinal, name, cost, "\n\n".join(within(seconds, lambda: pdf_pages(name, content))), None, None))
                    except Exception as e:
                        out.append((path, ordinal, name, cost, None, type(e).__name__, str(e)[:ERROR_CHARS]))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    return detected.where("format = 'pdf'").select("path", "content").mapInPandas(run, schema)


def run_counts(spans: DataFrame) -> DataFrame:
    """(path, runs): spans that are no separators, of each file that has any span."""
    return spans.where("error_type is null").groupBy("path").agg(F.count_if(~F.coalesce("synthetic", F.lit(False))).alias("runs"))


def page_of_spans(spans: DataFrame) -> DataFrame:
    """spans with page: that of the location, for separators without one that of the span before."""
    from pyspark.sql import Window

    own = F.regexp_extract("location", r"page:([0-9]+)", 1).try_cast("int")
    return spans.withColumn("page", F.last(own, True).over(Window.partitionBy("path").orderBy("pos")))


def has_fonts(spans: DataFrame) -> DataFrame:
    """(path, fonts): distinct fonts of real spans."""
    return spans.where("not synthetic and font is not null").groupBy("path").agg(F.sort_array(F.collect_set("font")).alias("fonts"))
