"""The pipeline against its parts on a small corpus."""

import random
import re

import pytest

from test_llm import components

pytest.importorskip("corpus_pipeline")


def test_pipeline_equals_brute_force(spark, tmp_path):
    import sentencepiece

    import corpus_pipeline
    from patraflow.llm import pii, spm

    r = random.Random(3)
    words = {"en": [f"stone{c}{d}" for c in "abcdefgh" for d in "klmnop"], "de": [f"straße{c}{d}" for c in "abcdefgh" for d in "klmnop"]}
    text = lambda k, n: " ".join(r.choice(words[k]) for _ in range(n))
    item = text("en", 25)
    rows = [(i, text(k, 40) + ". Mail me at x@y.org.", k) for i, k in enumerate(["en", "de"] * 30)]
    rows += [(100, rows[4][1], "en"), (101, rows[4][1] + " more", "en"), (102, f"{text('de', 20)} {item} {text('de', 3)}", "de"), (103, None, "en"), (104, "12 34", None), (105, "", "de")]
    d = [(i, t, k, "s", len(t) if t is not None else None) for i, t, k in rows]
    spark.createDataFrame(d, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    left = [(i, t, k) for i, t, k in rows if t and re.search(r"[^\W\d_]", t)]
    keep = components([t for _, t, _ in left])
    left = [x for n, x in enumerate(left) if keep[n][1] == n and x[0] != 102]
    assert sorted(got) == sorted(i for i, _, _ in left) and 100 not in got and 101 not in got
    sp = sentencepiece.SentencePieceProcessor(model_file=spm.MODEL)
    for i, t, k in left:
        assert got[i].lang == k and got[i].ids == sp.encode(pii._replaced(t, [{"k": a, "s": b, "e": c} for a, b, c in pii.base_spans(t)]))


def test_near_copies_with_null_and_repeated_ids(spark):
    import corpus_pipeline

    text = lambda k: " ".join(f"{k}{i}" for i in range(30))
    rows = [(None, text("a"), "x"), (None, text("b"), "x"), (None, text("b") + " more", "x"), (None, text("c"), "x"), (8, text("c"), "y")]
    rows += [(3, text("d"), "y"), (3, text("d"), "x"), (3, text("d"), None), (5, text("d") + " more", "x"), (5, text("e"), "x"), (None, text("f"), "x"), (None, text("f"), "x")]
    rows += [(None, None, "x"), (7, "", "x"), (7, "", "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = corpus_pipeline.drop_near_copies(spark, d, "")
    assert got.columns == d.columns
    got = [tuple(x) for x in got.collect()]
    b = [x for x in got if x[1] and x[1].startswith("b0 ")]
    assert len(b) == 1 and b[0] in rows
    want = [(None, text("a"), "x"), (8, text("c"), "y"), (3, text("d"), None), (5, text("e"), "x"), (None, text("f"), "x"), (None, None, "x"), (7, "", "x"), (7, "", "x")]
    assert sorted(map(repr, got)) == sorted(map(repr, [*want, *b]))
