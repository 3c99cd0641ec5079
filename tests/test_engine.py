"""Rules, cleaning, merging, fonts, pages and files on small cases, against sequential models."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from patraflow.functions import fonts, quality, rules
from patraflow.operators import candidates, chunk, clean, normalise, repair
from patraflow.operators.segment import segment
from patraflow.plans.queries import _file
from patraflow.sources import ingest, sinks

# Words of a printed grammar with the sentence and clause decisions.
GRAMMAR = [
    *((w, True, True) for w in "කරමි කළෙමි යමු ගියෙමු කරයි වැටෙයි යති කරති කළහ වූහ සේක ය වටී මැනවි ගියේ. කොයිද?".split()),
    *((w, False, True) for w in "කරලා බලමින් ගොස් පැමිණියොත් උගන්වද්දී යතත් නම් නමුත් එබැවින්".split()),
    *((w, False, False) for w in "සහ සමඟ හා කැටුව ද හෝ නොහොත් එතියි දෙසතියි කීහයි ගනිමියි මු හ ති".split()),
]


def test_grammar(spark):
    d = spark.createDataFrame([(w,) for w, _, _ in GRAMMAR], "word string")
    got = {r.word: (r.s, r.c) for r in d.select("word", rules.is_sentence_end("word").alias("s"), rules.is_clause_end("word").alias("c")).collect()}
    assert got == {w: (s, c) for w, s, c in GRAMMAR}


def test_clause_boundaries_contain_sentence_boundaries(spark):
    r = random.Random(1)
    words = [w for w, _, _ in GRAMMAR] + ["පොත", "a.", "b"]
    d = spark.createDataFrame([(i, 0, " ".join(r.choice(words) for _ in range(30))) for i in range(20)], "doc_id long, seg_no int, text string")
    texts = {x.doc_id: x.text for x in d.collect()}
    for level in ("sentence", "clause"):
        rows = chunk.micro_chunks(d, level).orderBy("doc_id", "mc").collect()
        for i, t in texts.items():
            assert " ".join(x.text for x in rows if x.doc_id == i) == t
    many, few = (chunk.micro_chunks(d, x).count() for x in ("clause", "sentence"))
    assert many > few


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text")).alias("x")).first().x


def test_quality(spark):
    good = "සිංහල භාෂාව ලියන අකුරු නිවැරදි ය මෙය පරීක්ෂා කිරීම සඳහා ලියන ලද වාක්‍යයකි"
    assert one(spark, good, quality.orphan_vowel_rate) == 0
    assert one(spark, " " + " ".join("ා" + c for c in "කගචජටඩතදපබමයරලවසහළණනකගචජ"), quality.orphan_vowel_rate) > 0.5
    assert one(spark, "", quality.sinhala_ratio) == 0
    assert list(one(spark, " a  b\tc ", quality.sample_tokens)) == ["a", "b", "c"] and list(one(spark, "   ", quality.sample_tokens)) == []


def test_choice_depends_on_order(spark):
    def row(i, ratio, cost=1, n=1000):
        sinhala = round(ratio * n)
        return (1, i, f"b{i}", cost, "ක" * sinhala + "x" * (n - sinhala))

    schema = "doc_id long, ordinal int, backend_id string, cost int, text string"
    ready = lambda rows: spark.createDataFrame(rows, schema).withColumn("quality", quality.score(F.col("text"), False))
    win = lambda rows: candidates.select(ready(rows)).first().winner.backend_id
    assert win([row(0, 0.700), row(1, 0.708), row(2, 0.716)]) == "b2"
    assert win([row(0, 0.708), row(1, 0.700), row(2, 0.716)]) == "b0"
    assert win([row(0, 0.7, 3), row(1, 0.7, 1)]) == "b1"
    assert win([row(0, 1.0, 1, 10), row(1, 0.5, 1, 100)]) == "b1" and win([row(0, 1.0, 1, 10), row(1, 0.5, 1, 20)]) == "b0"


def test_zero_width(spark):
    keep = "ක්‍ය ක්‍ර"
    assert one(spark, keep + "න‍‌", lambda c: clean.strip_zwnj(clean.strip_zwj(c))) == keep + "න"


def sequential_dewrap(text, ends):
    out, joins = [], 0
    for line in text.split("\n"):
        s = line.strip()
        before = out[-1] if out else None
        if s and "\t" not in line and before and before.strip() and "\t" not in before and not ends(before.split()[-1]):
            out[-1] = f"{before} {s}"
            joins += 1
        else:
            out.append(s)
    return "\n".join(out), joins


def test_dewrap_is_the_sequential_form(spark):
    r = random.Random(2)
    ends = lambda w: w.endswith((".", "?", "!", "|"))
    line = lambda: r.choice(["", "  ", "a\tb", "end.", "x y", " z ", "what?"])
    texts = {i: "\n".join(line() for _ in range(r.randint(1, 12))) for i in range(200)}
    got = {x.doc_id: (x.text, x.joins) for x in clean.dewrap(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {i: sequential_dewrap(t, ends) for i, t in texts.items()}


def test_clean(spark):
    text = "Head\n12\nfirst line of\nthe text.  Next\x07 one\nHead\n\n\n\nHead\nxiv\ncafé ....... ........\nend"
    d = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "7\n8")], "doc_id long, text string")
    got = {r.doc_id: r for r in clean.clean(d).collect()}
    assert got[1].text == "first line of the text. Next one\n\nend" and got[1].noise_lines_dropped == 6 and got[1].controls_removed == 1 and got[1].nfc_changed == 1
    assert got[2].text is None and got[3].text == "" and got[4].text == "" and got[4].noise_lines_dropped == 2
    off = clean.clean(d, clean.PreprocessConfig(False, False, False, False, False)).collect()
    assert {r.doc_id: r.text for r in off} == {1: text, 2: None, 3: "", 4: "7\n8"} and all(r.lines_joined is None for r in off)
    again = clean.clean(clean.clean(d).select("doc_id", "text"))
    assert {r.doc_id: r.text for r in again.collect()} == {i: r.text for i, r in got.items()}
    assert one(spark, "é", clean.normalise_unicode) == unicodedata.normalize("NFC", "é")


def test_segments(spark):
    text = "One line\nanother\n \nA\tB\n C\tD \ntail\n\n\nlast"
    d = spark.createDataFrame([(1, text, None), (2, "=== S ===\nx\ty\n\n5", "xlsx"), (3, " \n", None), (4, None, None)], "doc_id long, text string, source_format string")
    got = [tuple(r) for r in segment(d).orderBy("doc_id", "seg_no").collect()]
    assert got == [
        (1, 0, "One line another", "prose"), (1, 1, "A\tB", "table_row"), (1, 2, "C\tD", "table_row"), (1, 3, "tail", "prose"), (1, 4, "last", "prose"),
        (2, 0, "=== S ===", "sheet_heading"), (2, 1, "x\ty", "table_row"), (2, 2, "5", "table_row"),
    ]
    assert segment(d, False).count() == 2


def sequential_merge(micro, gaps, most, score, threshold, level="sentence"):
    if len(micro) == 1:
        return [(micro[0], 1, [level])]
    out, cur, n, bounds = [], micro[0], 1, []
    for i, nxt in enumerate(micro[1:]):
        if len(cur.split()) + len(nxt.split()) > most:
            out.append((cur, n, [*bounds, "guardrail"]))
            cur, n, bounds = nxt, 1, []
        elif score(cur, nxt) >= threshold:
            cur, n, bounds = f"{cur} {nxt}", n + 1, [*bounds, "segment" if i in gaps else level]
        else:
            out.append((cur, n, [*bounds, "coherence"]))
            cur, n, bounds = nxt, 1, []
    return [*out, (cur, n, bounds)]


@pytest.mark.parametrize("scorer", [0.0, 1.0, chunk.token_cosine])
def test_merge_is_the_sequential_form(spark, scorer):
    r = random.Random(3)
    pools = {(i, 0): [" ".join(r.choice("abcde") for _ in range(r.randint(1, 5))) for _ in range(r.randint(1, 9))] for i in range(40)}
    gaps = {k: {i for i in range(len(v) - 1) if r.random() < 0.3} for k, v in pools.items()}
    rows = [(d, p, n, t, len(t.split()), n in gaps[d, p]) for (d, p), v in pools.items() for n, t in enumerate(v)]
    d = spark.createDataFrame(rows, "doc_id long, pool int, n int, text string, words int, gap boolean").repartition(3)
    config = chunk.ChunkConfig(max_words=9, similarity_threshold=0.5)
    got = chunk.merge(d, config, scorer).orderBy("doc_id", "pool", "piece").collect()
    score = scorer if callable(scorer) else lambda a, b: scorer
    want = [(*k, i, t, n, b) for k, v in pools.items() for i, (t, n, b) in enumerate(sequential_merge(v, gaps[k], 9, score, 0.5))]
    assert [(x.doc_id, x.pool, x.piece, x.text, x.merged_from, list(x.boundaries)) for x in got] == want


def test_chunks(spark):
    text = "First one. Second two.\n\nThird three.\n\na\tb\n\nTail end."
    d = spark.createDataFrame([(1, text, "doc", "docx"), (2, "", None, None)], "doc_id long, text string, source_document string, source_format string")
    got = chunk.chunk_text(d).orderBy("index").collect()
    assert [(r.text, r.segment_kind, r.merged_from, list(r.boundaries)) for r in got] == [
        ("First one. Second two. Third three.", "prose", 3, ["sentence", "segment"]),
        ("a\tb", "table_row", 1, ["table_row"]),
        ("Tail end.", "prose", 1, ["sentence"]),
    ]
    assert got[0].chunk_id.startswith("chunk-00000-") and len(got[0].chunk_id) == 24
    lines = sinks.to_jsonl(chunk.chunk_text(d)).orderBy("index").collect()
    assert '"page_range":null' in lines[0].line and '"segment_kind":"table_row"' in lines[1].line
    assert [r["index"] for r in chunk.pick(chunk.chunk_text(d), -1).collect()] == [2]
    with pytest.raises(ValueError):
        chunk.ChunkConfig(max_words=0)


def test_fonts(spark):
    kinds = {"FM Abhaya": "legacy_mappable", "CZMRSJ+FMAbhayax": "legacy_mappable", "FMAbabldBold": "legacy_mappable", "K-Plain": "legacy_unmappable", "SHREE-TAM-0800": "legacy_unmappable", "Iskoola Pota": "unicode_sinhala", "IskoolaPota-Bold": "unicode_sinhala", "TimesNewRomanPSMT": "non_sinhala", "FMUnseen": "unknown", "": "unknown"}
    d = spark.createDataFrame([(f,) for f in kinds], "font string")
    assert {r.font: r.c for r in d.select("font", fonts.classify_font(F.col("font")).alias("c")).collect()} == kinds
    spans = spark.createDataFrame([(1, 0, "ab", "FMAbhaya", False), (1, 1, "\n", "", True), (1, 2, "ab", "Arial", False), (1, 3, "ab", "K-Plain", False)], "doc_id long, pos int, text string, font string, synthetic boolean")
    r = normalise.normalise_spans(spans, {"fm_abhaya": {"a": "1", "ab": "2"}}).first()
    assert (r.text, r.method, r.converted_fonts, r.unmapped_fonts) == ("2\nabab", "font_name", ["FMAbhaya"], ["K-Plain"])


def test_page_repair(spark):
    box = lambda *v: dict(zip(("x0", "y0", "x1", "y1"), map(float, v)))
    b = "struct<x0:double,y0:double,x1:double,y1:double>"
    page = box(0, 0, 100, 100)
    rows = [(1, 0, "long enough text to keep it", page, []), (1, 1, "short", page, [box(-50, -50, 100, 60)]), (1, 2, "", page, [box(0, 0, 10, 10), None]), (1, 3, "", page, [box(0, 0, 100, 50)])]
    d = spark.createDataFrame(rows, f"doc_id long, page int, text string, rect {b}, images array<{b}>")

    def ocr(doc, number, image):
        if number == 3:
            raise RuntimeError
        return "read"

    got = {r.page: (r.text, r.source) for r in repair.repair(d, ocr).collect()}
    assert got == {0: (rows[0][2], "layer"), 1: ("read", "ocr"), 2: ("", "layer"), 3: ("", "layer")}
    both = {r.page: r.source for r in repair.repair(d, ocr, lambda *a: "seen", repair.MultimodalConfig("claude")).collect()}
    assert both == {0: "layer", 1: "multimodal", 2: "layer", 3: "multimodal"}
    with pytest.raises(Exception, match="2 pages need transcription"):
        repair.repair(d, ocr, lambda *a: "seen", repair.MultimodalConfig("claude", max_pages=1)).collect()
    winners = spark.createDataFrame([(1, "pdfminer", "old")], "doc_id long, backend_id string, text string")
    r = repair.repaired_documents(winners, repair.repair(d, ocr)).first()
    assert r.text == f"{rows[0][2]}\n\nread\n\n\n\n" and r.backend_id == "pdfminer" and r.pages_ocred == [1]


def test_files(spark, tmp_path):
    for kind, name in (("docx", "a.docx"), ("xlsx", "b.pdf"), ("pdf", "c.pdf"), ("txt", "d.docx")):
        (tmp_path / name).write_bytes(_file(kind, "some words in a file for the test of formats and fonts"))
    found = ingest.detect_formats(ingest.files(spark, str(tmp_path)))
    got = {r.path.rsplit("/")[-1]: (r.format, r.status) for r in found.collect()}
    assert got == {"a.docx": ("docx", "ok"), "b.pdf": ("xlsx", "ok"), "c.pdf": ("pdf", "ok"), "d.docx": (None, "error")}
    from patraflow.engine import route

    docs = {r.doc_id.rsplit("/")[-1]: r for r in route(spark, str(tmp_path)).collect()}
    assert docs["a.docx"].text == "some words in a file for the test of formats and fonts\nsome\twords\n\n" and docs["a.docx"].unmapped_fonts == ["FMAbhaya"]
    assert docs["b.pdf"].text == "=== One ===\nsome\twords\tin\n12\n" and docs["d.docx"].status == "error"
    assert docs["c.pdf"].error_type == "ExtractionFailedError"


def test_generated_files_hold_whole_texts(spark):
    from patraflow.plans.queries import _files

    texts = {str(r.doc_id): r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert max(map(len, texts.values())) > 200
    for r in _files(spark, "/root/testdata/sf0.001").collect():
        key, content = r.path.rsplit("/")[-1].split(".")[0], bytes(r.content)
        lines = texts[key].split("\n")
        kind = ("pdf", "docx", "xlsx", "txt")[int(key) % 4]
        if kind == "docx":
            table = "".join(t.replace(" ", "\t", 1) + "\n" for t in lines)
            assert "".join(x[0] for x in ingest.docx_spans(content)) == "".join(t + "\n" for t in lines) + table + "\n"
        elif kind == "xlsx":
            assert "".join(x[0] for x in ingest.xlsx_spans(content)) == "=== One ===\n" + "".join(t.replace(" ", "\t", 2) + "\n" for t in [*lines, "12"])
        else:
            assert content == (b"\n%PDF-1.4 " if kind == "pdf" else b"") + texts[key].encode()


def test_stream(spark, tmp_path):
    from patraflow.streaming.stream import chunk_stream

    spark.createDataFrame([(1, "One two. Three.")], "doc_id long, text string").write.parquet(f"{tmp_path}/in")
    chunk_stream(spark, f"{tmp_path}/in", "doc_id long, text string", f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert [r.text for r in spark.read.parquet(f"{tmp_path}/out").collect()] == ["One two. Three."]


def test_readers(spark, monkeypatch):
    from patraflow.errors import MultimodalUnavailableError
    from patraflow.sources import readers

    monkeypatch.delenv("OPENAI_API_KEY", raising=False)
    assert readers.api_key("openai") is None and readers.describe_availability()["openai"]
    monkeypatch.setenv("OPENAI_API_KEY", "k")
    assert readers.api_key("openai") == "k"
    config = repair.MultimodalConfig("openai", model="m")
    read = readers.transcriber_reader(config, {"openai": lambda model: lambda png: f"{model}:{png.decode()}"})
    assert read(1, 0, b"png") == "m:png" and readers.png_to_base64(b"a") == "YQ=="
    with pytest.raises(MultimodalUnavailableError):
        readers.transcriber_reader(config, {})
    with pytest.raises(NotImplementedError):
        readers.analyse_layout("x")
    assert repair.resolve_model(config, "call") == "call" and repair.resolve_model(repair.MultimodalConfig("claude"), None, {"claude": "d"}) == "d"


def test_page_texts(spark):
    spans = spark.createDataFrame([("a", 0, "ab", "FMAbhaya", "page:0", False), ("a", 1, "\n", "", "", True), ("a", 2, "c", "Arial", "page:1", False)], "path string, pos int, text string, font string, location string, synthetic boolean")
    paged = ingest.page_of_spans(spans).withColumnRenamed("path", "doc_id")
    got = {r.page: r.text for r in normalise.page_texts(paged, {"fm_abhaya": {"a": "1"}}).collect()}
    assert got == {0: "1b\n", 1: "c"}
    docs = spark.createDataFrame([(1, "ab", ["FMAbhaya"]), (2, "ab", ["Arial"])], "doc_id long, text string, fonts array<string>")
    assert {r.doc_id: (r.text, r.method) for r in normalise.normalise_legacy(docs, {"fm_abhaya": {"a": "1"}}).collect()} == {1: ("1b", "font_name"), 2: ("ab", "none")}


def test_a_backend_that_hangs_or_fails(spark):
    import time

    from patraflow.sources import ingest as I

    assert I.within(5, lambda: 3) == 3
    with pytest.raises(TimeoutError):
        I.within(0.05, lambda: time.sleep(2))
    with pytest.raises(KeyError):
        I.within(5, lambda: {}["x"])
    d = spark.createDataFrame([("a.pdf", bytearray(b"%PDF-1.4"), "pdf")], "path string, content binary, format string")
    rows = I.sweep_pdfs(d, seconds=30).collect()
    assert [r.ordinal for r in sorted(rows, key=lambda r: r.ordinal)] == [0, 1, 2, 3] and all(r.error_type for r in rows)


def test_sinks_keep_documents_and_outcomes(spark, tmp_path):
    from patraflow.sources import sinks

    d = spark.createDataFrame([("a", "some text", None), ("b", " ", None), ("c", None, "E"), ("d", "two\nlines", None)], "doc_id string, text string, error_type string")
    assert {r.status: r["count"] for r in sinks.status_counts(d).collect()} == {"ok": 2, "skip": 1, "fail": 1}
    sinks.write_text_files(d.where("doc_id in ('a', 'd')"), str(tmp_path / "out"))
    (file,) = (tmp_path / "out" / "doc_id=d").glob("part-*")
    assert file.read_text() == "two\nlines\n"
    chunks = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y")], "doc_id string, index int, text string")
    known = spark.createDataFrame([("a", "pdf", 3)], "doc_id string, source_format string, pages int")
    (row,) = sinks.to_json(chunks, documents=known).collect()
    import json

    got = json.loads(row.json)
    assert got["document"] == {"source_format": "pdf", "pages": 3} and [c["text"] for c in got["chunks"]] == ["x", "y"]


def test_readings_are_made_once(spark, tmp_path):
    """Each page that needs it is read once by OCR, though its reading is used three times."""
    from patraflow.operators import repair as R

    calls = str(tmp_path / "calls")

    def ocr(doc, page, image):
        with open(calls, "a") as f:
            f.write(f"{doc}:{page}\n")
        return "" if page else "a whole page of text, read by a machine"

    box = "named_struct('x0', 0D, 'y0', 0D, 'x1', 100D, 'y1', 100D)"
    pages = spark.range(3).selectExpr("id as doc_id", "explode(array(0, 1)) as page", "'' as text", f"{box} as rect", f"array({box}) as images")
    out = R.repair(pages, ocr, lambda d, p, i: "transcribed by a model, at some length", R.MultimodalConfig("gemini"))
    got = sorted((r.doc_id, r.page, r.source) for r in out.collect())
    assert got == [(d, p, "multimodal" if p else "ocr") for d in range(3) for p in range(2)]
    assert sorted(open(calls).read().split()) == sorted(f"{d}:{p}" for d in range(3) for p in range(2))


def test_fonts_are_classified_once_a_name(spark):
    from patraflow.operators import normalise as N

    d = spark.createDataFrame([(1, "x", "FMAbhaya", False), (1, "y", "FMAbhaya", False), (1, "z", None, False), (1, "-", "Arial", True), (2, "w", "Arial", False)], "doc_id int, text string, font string, synthetic boolean")
    assert sorted(r.font for r in N.font_table(d).collect()) == ["Arial", "FMAbhaya"]
    got = sorted((r.text, r["class"], r.table) for r in N.with_fonts(d).collect())
    assert got == [("-", None, None), ("w", "non_sinhala", None), ("x", "legacy_mappable", "fm_abhaya"), ("y", "legacy_mappable", "fm_abhaya"), ("z", None, None)]
    assert [r.doc_id for r in N.any_legacy(d).collect()] == [1]
