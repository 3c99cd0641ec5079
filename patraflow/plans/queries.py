"""Queries over the test tables, one or more for each operator."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fonts as N
from ..functions import quality as Q
from ..functions import rules
from ..functions import text as T
from ..operators import candidates as C
from ..operators import chunk as K
from ..operators import clean as L
from ..operators import normalise as O
from ..operators import repair as R
from ..operators.segment import segment
from ..session import prepare
from ..sources import ingest as I
from ..sources import sinks
from . import inject

Query = Callable[[SparkSession, str], DataFrame]
# Font names whose class the tests know, with unknown and blank ones.
FONTS = (
    "FMAbhaya", "FM Abhaya", "CZMRSJ+FMAbhayax", "FMAbhaya-Bold", "FMAbabldBold", "FMEmaneex", "FMUnseen", "Chamodi", "sandaru-n", "K-Plain",
    "Tharmini-Plain", "TAM-Tamil155", "SHREE-TAM-0800", "shree-tam-1", "Iskoola Pota", "IskoolaPota-Bold", "IskoolaPotaRegular", "NirmalaUI",
    "NotoSansSinhala-Regular", "UNAbhaya", "TimesNewRomanPSMT", "ABCDEF+Arial-BoldMT", "Calibri,Italic", "Helvetica", "MinionPro-Regular", "Wingdings",
    "Comic Sans", "", "  ", "Bold", "fmabhaya",
)


def docs(spark: SparkSession, sf_dir: str, text: str = "text") -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.expr(text).alias("text"))


def digest(c: str = "text"):
    return F.md5(c).alias("text_md5")


def q_script_ratio(spark, sf_dir):
    return docs(spark, sf_dir, inject.sinhala()).select("doc_id", Q.sinhala_ratio(F.col("text")).alias("sinhala_ratio"))


def q_orphan_rate(spark, sf_dir):
    return docs(spark, sf_dir, inject.sinhala()).select("doc_id", Q.orphan_vowel_rate(F.col("text")).alias("orphan_vowel_rate"))


def q_score(spark, sf_dir):
    d = docs(spark, sf_dir, inject.sinhala()).select("doc_id", Q.score(F.col("text")).alias("q"))
    return d.select("doc_id", "q.raw_length", "q.sinhala_ratio", "q.orphan_vowel_rate", F.array_join("q.sample_tokens", "|").alias("sample_tokens"))


def q_viable(spark, sf_dir):
    d = docs(spark, sf_dir, inject.sinhala()).withColumn("q", Q.score(F.col("text"), False))
    return d.select("doc_id", Q.is_viable(F.col("q"), 400).alias("viable"), Q.is_well_formed(F.col("q")).alias("well_formed"), Q.is_malformed(F.col("text")).alias("malformed"))


BACKEND_TEXTS = (
    f"substr({inject.sinhala()}, 1, greatest(length(text) - 20 * CAST(doc_id % 5 AS INT), 0))",
    f"replace({inject.sinhala()}, chr(10), '')",
    f"substr({inject.sinhala()}, 1, CASE WHEN doc_id % 7 = 0 THEN 10 ELSE 100000 END)",
    f"CASE WHEN doc_id % 3 = 0 THEN text ELSE replace({inject.sinhala()}, 'ා', '') END",
)


def _results(spark, sf_dir):
    base = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    fails = F.col("doc_id") % 4 == F.col("ordinal")
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("ordinal"), F.lit(n).alias("backend_id"), F.lit(c).alias("cost"), F.expr(t).alias("text")) for i, ((n, c), t) in enumerate(zip(C.PDF_BACKENDS, BACKEND_TEXTS, strict=True)))))
    rows = base.select("doc_id", each.alias("x")).select("doc_id", "x.*")
    return rows.select("doc_id", "ordinal", "backend_id", "cost", F.when(~fails, F.col("text")).alias("text"), F.when(fails, "ExtractionFailedError").alias("error_type"), F.when(fails, F.repeat(F.lit("x"), 600)).alias("error_message"))


def q_candidate_select(spark, sf_dir):
    d = C.select(C.scored(_results(spark, sf_dir)))
    return d.select("doc_id", "winner.backend_id", "winner.raw_length", "winner.cost", "raw_winner", F.size(F.map_keys("summary")).alias("candidates"))


def q_attempts_history(spark, sf_dir):
    d = C.attempts(_results(spark, sf_dir))
    one = lambda a: F.concat_ws(":", a["backend_id"], a["succeeded"].cast("string"), F.coalesce(a["error_type"], F.lit("-")), F.coalesce(F.length(a["error_message"]), F.lit(0)).cast("string"))
    return d.select("doc_id", F.array_join(F.transform("attempts", one), ",").alias("history"), "usable")


def q_nfc(spark, sf_dir):
    return docs(spark, sf_dir, inject.marked()).withColumn("new", L.normalise_unicode("text")).select("doc_id", digest("new"), (F.col("new") != F.col("text")).alias("changed"))


def q_strip_controls(spark, sf_dir):
    d = docs(spark, sf_dir, inject.marked()).withColumn("new", L.strip_controls(F.col("text")))
    return d.select("doc_id", digest("new"), (F.length("text") - F.length("new")).alias("removed"))


def q_zero_width(spark, sf_dir):
    d = docs(spark, sf_dir, inject.marked()).withColumn("a", L.strip_zwj(F.col("text"))).withColumn("b", L.strip_zwnj(F.col("a")))
    return d.select("doc_id", digest("b"), (F.length("text") - F.length("a")).alias("zwj"), (F.length("a") - F.length("b")).alias("zwnj"))


def q_collapse_ws(spark, sf_dir):
    d = docs(spark, sf_dir, inject.marked()).withColumn("new", L.collapse_whitespace(F.col("text")))
    return d.select("doc_id", digest("new"), (F.length("text") - F.length("new")).alias("removed"))


def q_noise_lines(spark, sf_dir):
    return L.mark_noise(L.lines(docs(spark, sf_dir, inject.noisy()))).groupBy("doc_id").agg(F.count_if("noise").alias("noise"))


def q_furniture(spark, sf_dir):
    return L.mark_noise(L.lines(docs(spark, sf_dir, inject.noisy()))).groupBy("doc_id").agg(F.count_if("furniture").alias("furniture"))


def q_drop_noise(spark, sf_dir):
    return L.drop_noise_lines(docs(spark, sf_dir, inject.noisy())).select("doc_id", digest(), "dropped")


def q_dewrap(spark, sf_dir):
    return L.dewrap(docs(spark, sf_dir, inject.noisy(inject.sinhala()))).select("doc_id", digest(), "joins")


def q_clean(spark, sf_dir):
    return L.clean(docs(spark, sf_dir, inject.marked())).select("doc_id", digest(), F.length("text").alias("length"))


def q_clean_stages(spark, sf_dir):
    return L.clean(docs(spark, sf_dir, inject.marked())).drop("text")


def _segments(d):
    return d.select("doc_id", "seg_no", "kind", digest())


def q_segment_prose(spark, sf_dir):
    return _segments(segment(docs(spark, sf_dir, inject.tabular())))


def q_segment_sheet(spark, sf_dir):
    return _segments(segment(docs(spark, sf_dir, inject.sheet()).withColumn("source_format", F.lit("xlsx"))))


def q_boundary_rules(spark, sf_dir):
    words = docs(spark, sf_dir, inject.sinhala()).select(F.explode(T.tokens(F.col("text"))).alias("word"))
    r = rules.Rules("word")
    return words.groupBy("word").agg(F.count("*").alias("n")).select("word", "n", F.expr(r.sentence).alias("sentence_end"), F.expr(r.clause).alias("clause_end"), F.expr(r.quotative).alias("quotative"), F.expr(r.never).alias("never_split"))


def _micro(spark, sf_dir, level):
    d = docs(spark, sf_dir, inject.sinhala()).withColumn("seg_no", F.lit(0))
    return K.micro_chunks(d, level).select("doc_id", "mc", "words", digest())


def q_micro_sentence(spark, sf_dir):
    return _micro(spark, sf_dir, "sentence")


def q_micro_clause(spark, sf_dir):
    return _micro(spark, sf_dir, "clause")


def _merged(spark, sf_dir, scorer, words=300):
    s = segment(docs(spark, sf_dir, inject.tabular()))
    d = K.merge(K.pools(s), K.ChunkConfig(max_words=words), scorer)
    return d.select("doc_id", "pool", "piece", "words", "merged_from", F.array_join("boundaries", ",").alias("boundaries"), digest())


def q_merge_never(spark, sf_dir):
    return _merged(spark, sf_dir, 0.0)


def q_merge_always(spark, sf_dir):
    return _merged(spark, sf_dir, 1.0)


def q_merge_guardrail(spark, sf_dir):
    return _merged(spark, sf_dir, 1.0, 60)


def q_merge_token_cosine(spark, sf_dir):
    s = segment(docs(spark, sf_dir, inject.tabular()))
    d = K.merge(K.pools(s), K.ChunkConfig(max_words=60), K.token_cosine)
    return d.select("doc_id", "pool", "piece", "words", "merged_from", F.array_join("boundaries", ",").alias("boundaries"), digest())


def q_pooling_gaps(spark, sf_dir):
    c = prepare(spark).read.parquet(f"{sf_dir}/conversations.parquet")
    d = c.groupBy(F.col("conv_id").alias("doc_id")).agg(F.expr("listagg(text, chr(10) || chr(10)) WITHIN GROUP (ORDER BY turn, text)").alias("text"))
    return K.pools(segment(d)).select("doc_id", "pool", "n", "words", "gap", digest())


def _chunks(spark, sf_dir):
    d = docs(spark, sf_dir, inject.tabular()).withColumn("source_document", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")))
    return K.chunk_text(d, K.ChunkConfig(max_words=60))


def q_chunks(spark, sf_dir):
    d = _chunks(spark, sf_dir)
    return d.select("doc_id", "index", "chunk_id", "word_count", "segment_kind", "merged_from", F.array_join("boundaries", ",").alias("boundaries"), F.col("quality.raw_length").alias("raw_length"))


def q_chunk_slice(spark, sf_dir):
    return K.pick(_chunks(spark, sf_dir), -3, -1).select("doc_id", "index", "chunk_id")


def q_document_counts(spark, sf_dir):
    return K.document_counts(docs(spark, sf_dir, inject.tabular()))


def q_chunk_jsonl(spark, sf_dir):
    d = _chunks(spark, sf_dir).select("doc_id", "index", "chunk_id", "text", "word_count", "segment_kind", "merged_from", "source_format")
    return sinks.to_jsonl(d)


def q_chunk_json(spark, sf_dir):
    d = _chunks(spark, sf_dir).select("doc_id", "index", "chunk_id", "word_count")
    return sinks.to_json(d)


def _fonts(spark):
    return prepare(spark).createDataFrame([(i, f) for i, f in enumerate(FONTS)], "id int, font string")


def q_font_class(spark, sf_dir):
    return _fonts(spark).select("id", N.classify_font(F.col("font")).alias("class"), N.classify_font(F.col("font"), True).alias("class_fm"), N.mapping_of(F.col("font")).alias("mapping"), N.is_legacy(F.col("font")).alias("legacy"))


def q_font_name(spark, sf_dir):
    n = N.normalise_font_name(F.col("font"))
    return _fonts(spark).select("id", n.alias("name"), N.family_name(n).alias("family"))


#: A stand-in table: no real one is public here.
TABLES = {"fm_abhaya": {"the": "THE", "a": "α", "th": "θ", "e": "ε"}}


def _spans(spark, sf_dir):
    d = docs(spark, sf_dir)
    rows = d.select("doc_id", F.posexplode(F.split("text", " ", -1)).alias("pos", "text"))
    font = F.element_at(F.array(*map(F.lit, FONTS)), ((F.col("doc_id") + F.col("pos")) % len(FONTS) + 1).cast("int"))
    return rows.select("doc_id", "pos", "text", font.alias("font"), (F.col("pos") % 9 == 8).alias("synthetic"))


def q_normalise_spans(spark, sf_dir):
    d = O.normalise_spans(_spans(spark, sf_dir), TABLES)
    return d.select("doc_id", digest(), "method", F.array_join("converted_fonts", "|").alias("converted"), F.array_join("unmapped_fonts", "|").alias("unmapped"))


def q_fonts_by_class(spark, sf_dir):
    return O.fonts_by_class(_spans(spark, sf_dir), ()).select("class", F.array_join("fonts", "|").alias("fonts"))


def q_ratio_heuristic(spark, sf_dir):
    d = docs(spark, sf_dir)
    font = F.array(F.element_at(F.array(*map(F.lit, FONTS)), (F.col("doc_id") % len(FONTS) + 1).cast("int")))
    return d.select("doc_id", N.ratio_heuristic(F.col("text"), font).alias("fires"))


def q_normalise(spark, sf_dir):
    d = docs(spark, sf_dir).withColumn("fonts", F.array(F.element_at(F.array(*map(F.lit, FONTS)), (F.col("doc_id") % len(FONTS) + 1).cast("int"))))
    return O.normalise(d, TABLES).select("doc_id", digest(), "method", F.array_join("converted_fonts", "|").alias("converted"), F.array_join("unmapped_fonts", "|").alias("unmapped"))


def _pages(spark, sf_dir):
    d = docs(spark, sf_dir, inject.sinhala())
    box = lambda x0, y0, x1, y1: F.struct(*(F.expr(f"CAST({v} AS DOUBLE)").alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), (x0, y0, x1, y1), strict=True)))
    rows = d.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("page", "text"))
    images = F.array(box("-10", "-10", "doc_id % 100", "page * 30"), box("20", "20", "60 + doc_id % 40", "90"))
    text = F.when((F.col("doc_id") + F.col("page")) % 3 == 0, F.substring("text", 1, 15)).otherwise(F.col("text"))
    return rows.select("doc_id", "page", text.alias("text"), box("0", "0", "CASE WHEN doc_id % 50 = 0 THEN 0 ELSE 100 END", "100").alias("rect"), F.when(F.col("doc_id") % 11 != 0, images).otherwise(F.slice(images, 1, 0)).alias("images"))


def q_image_coverage(spark, sf_dir):
    return _pages(spark, sf_dir).select("doc_id", "page", F.round(R.image_coverage(F.col("rect"), F.col("images")), 9).alias("coverage"))


def q_needs_ocr(spark, sf_dir):
    p = _pages(spark, sf_dir)
    c = R.image_coverage(F.col("rect"), F.col("images"))
    return p.select("doc_id", "page", R.needs_ocr(F.col("text"), c).alias("needs"), R.needs_ocr(F.col("text"), c, False).alias("needs_without_repair"))


def _readings(p, kind, modulus):
    return p.where(F.col("doc_id") % modulus != 0).select("doc_id", "page", F.concat(F.lit(f"{kind} of page "), F.col("page").cast("string"), F.when(F.col("page") % 2 == 0, F.lit(" of a document, read")).otherwise(F.lit(""))).alias("new"))


def _repaired(spark, sf_dir):
    p = _pages(spark, sf_dir)
    return R.repair(p, _readings(p, "ocr", 5), _readings(p, "vlm", 3), R.MultimodalConfig("gemini", max_pages=1 << 20))


def q_repair_pages(spark, sf_dir):
    return _repaired(spark, sf_dir).select("doc_id", "page", "source", digest())


def q_repair_documents(spark, sf_dir):
    winners = docs(spark, sf_dir).withColumn("backend_id", F.lit("pdfminer"))
    d = R.repaired_documents(winners, _repaired(spark, sf_dir))
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return d.select("doc_id", "backend_id", digest(), join("pages_ocred"), join("pages_multimodal"), F.col("quality.raw_length").alias("raw_length"))


def q_vlm_budget(spark, sf_dir):
    p = _pages(spark, sf_dir)
    need = p.where(R.needs_ocr(F.col("text"), R.image_coverage(F.col("rect"), F.col("images"))))
    return R.over_budget(need, 2)


def q_adjacent_cosine(spark, sf_dir):
    e = prepare(spark).read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(dot("v", "v")) * F.sqrt(dot("w", "w"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(F.when(norm > 0, dot("v", "w") / norm).otherwise(0.0), 6).alias("cosine"))


def _file(kind: str, text: str) -> bytes:
    if kind == "pdf":
        return b"\n%PDF-1.4 " + text.encode()[:50]
    if kind == "txt":
        return text.encode()[:50]
    out = io.BytesIO()
    esc = "".join(c for c in text if c.isalnum() or c == " ")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        if kind == "docx":
            w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
            run = lambda t, f: f'<w:r><w:rPr><w:rFonts w:ascii="{f}"/></w:rPr><w:t>{t}</w:t></w:r>'
            cells = "".join(f"<w:tc><w:p>{run(c, 'Arial')}</w:p></w:tc>" for c in esc.split()[:2])
            z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p>{run(esc[:30], 'FMAbhaya')}{run(esc[30:60], 'Arial')}</w:p><w:tbl><w:tr>{cells}</w:tr></w:tbl></w:body></w:document>")
        else:
            s, r = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
            z.writestr("xl/workbook.xml", f'<workbook {s} {r}><sheets><sheet name="One" sheetId="1" r:id="rId1"/></sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
            cells = "".join(f'<c r="{c}1" t="inlineStr"><is><t>{t}</t></is></c>' for c, t in zip("ABC", esc.split(), strict=False))
            z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {s}><sheetData><row r="1">{cells}<c r="D1"/></row><row r="2"><c r="A2"><v>12</v></c></row></sheetData></worksheet>')
    return out.getvalue()


def _whole_file(kind: str, text: str) -> bytes:
    """The whole text as a file: in DOCX a paragraph of two runs and then a table row of two cells for each line, in XLSX a row of up to
    three cells for each line. Only characters that XML can't hold are left out of these two."""
    if kind == "pdf":
        return b"\n%PDF-1.4 " + text.encode()
    if kind == "txt":
        return text.encode()
    out = io.BytesIO()
    esc = lambda t: escape(re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]", "", t), {"\r": "&#13;"})
    lines = text.split("\n")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        if kind == "docx":
            w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
            run = lambda t, f: f'<w:r><w:rPr><w:rFonts w:ascii="{f}"/></w:rPr><w:t>{esc(t)}</w:t></w:r>'
            paragraphs = "".join(f"<w:p>{run(t[: len(t) // 2], 'FMAbhaya')}{run(t[len(t) // 2 :], 'Arial')}</w:p>" for t in lines)
            rows = "".join("<w:tr>" + "".join(f"<w:tc><w:p>{run(c, 'Arial')}</w:p></w:tc>" for c in t.split(" ", 1)) + "</w:tr>" for t in lines)
            z.writestr("word/document.xml", f"<w:document {w}><w:body>{paragraphs}<w:tbl>{rows}</w:tbl></w:body></w:document>")
        else:
            s, r = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
            z.writestr("xl/workbook.xml", f'<workbook {s} {r}><sheets><sheet name="One" sheetId="1" r:id="rId1"/></sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
            row = lambda i, t: f'<row r="{i}">' + "".join(f'<c r="{c}{i}" t="inlineStr"><is><t>{esc(v)}</t></is></c>' for c, v in zip("ABC", t.split(" ", 2), strict=False)) + f'<c r="D{i}"/></row>'
            rows = "".join(row(i, t) for i, t in enumerate(lines, 1))
            z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {s}><sheetData>{rows}<row r="{len(lines) + 1}"><c r="A{len(lines) + 1}"><v>12</v></c></row></sheetData></worksheet>')
    return out.getvalue()


def _files(spark, sf_dir):
    """Generated files, one a document with its whole text, in the shape of a binaryFile scan."""
    make = F.udf(lambda k, t: bytearray(_whole_file(k, t or "")), "binary")
    kind = F.element_at(F.array(*map(F.lit, ("pdf", "docx", "xlsx", "txt"))), (F.col("doc_id") % 4 + 1).cast("int"))
    d = docs(spark, sf_dir).withColumn("kind", kind)
    return d.select(F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit("."), F.when(F.col("doc_id") % 8 == 1, "pdf").otherwise(F.col("kind"))).alias("path"), make("kind", "text").alias("content"))


def q_detect_format(spark, sf_dir):
    return I.detect_formats(_files(spark, sf_dir)).drop("content")


def q_office_spans(spark, sf_dir):
    found = I.detect_formats(_files(spark, sf_dir)).where("format in ('docx', 'xlsx')")
    return I.parse_spans(found)


def q_office_documents(spark, sf_dir):
    found = I.detect_formats(_files(spark, sf_dir)).where("format in ('docx', 'xlsx')")
    spans = I.parse_spans(found).withColumnRenamed("path", "doc_id")
    return O.normalise_spans(spans, TABLES)


def queries() -> dict[str, Query]:
    return {k: v for k, v in globals().items() if k.startswith("q_")}
