"""The operators of patraflow.llm against brute force on small fixtures, with nulls, empty and long texts, ties, repeated rows, empty tables
and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from patraflow.llm import _text as X
from patraflow.llm import decontam, fmindex, jaccard, langid, nbsvm, oph, pii, sharding, spm, substring, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, n long, key string, h int, label int, rows string, ids string, score double"


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def shingles(t):
    w = WORD.findall(low(t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def corpus(seed=3, n=60):
    """Random texts with exact and near copies, a passage that many share, and odd cases."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(300)]
    text = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    passage = text(34)
    out = []
    for i in range(n):
        words = text(r.choice([1, 3, 5, 9, 21, 60, 150])).split()
        if out and r.random() < 0.5:
            words = WORD.findall(out[r.randrange(len(out))])
            for _ in range(r.choice([0, 0, 1, 2, len(words) // 12])):
                if words:
                    words[r.randrange(len(words))] = r.choice(vocab)
        if r.random() < 0.4:
            k = r.randrange(len(words) + 1)
            words[k:k] = passage.split()
        out.append(r.choice([" ", "\n", "  \t"]).join(words))
    return out


def frame(spark, texts, first=0):
    rows = [(first + i, t, ["en", "fr"][i % 2], 1, "k", 2, 3, "r", "x", 0.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


ODD = [None, "", "   \n\t", "one", "A b C d e", "a b c d e", "Ünïcode ☃ words here now again", "a " * 3000]


def components(texts):
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def test_words_and_hashes():
    import pyarrow as pa

    batch = pa.record_batch([pa.array([None, "", "ab  cd\nab", "x"])], ["t"])
    (rows, data, at), *_ = X.groups(batch, "t")
    s, e, first = X.words(data, at)
    assert [bytes(data[a:b]) for a, b in zip(s, e)] == [b"ab", b"cd", b"ab", b"x"]
    assert first.tolist() == [0, 0, 0, 3, 4]
    h = X.word_hashes(data, s, e)
    assert h[0] == h[2] and len(set(h.tolist())) == 3


@pytest.mark.parametrize("seed", [3, 11])
def test_jaccard_components(spark, seed):
    texts = corpus(seed) + ODD
    got = {r[0]: (r[1], r[2]) for r in jaccard.jaccard_components(frame(spark, texts)).collect()}
    assert got == components(texts)


def test_jaccard_large_group_of_near_copies(spark):
    r = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(150):
        words = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 4])):
            words[r.randrange(120)] = f"z{r.randrange(10**6)}"
        texts.append(" ".join(words))
    got = {x[0]: (x[1], x[2]) for x in jaccard.jaccard_components(frame(spark, texts)).collect()}
    assert got == components(texts)


def test_jaccard_empty_and_repeated(spark):
    assert jaccard.jaccard_components(frame(spark, [])).collect() == []
    d = frame(spark, ["a b c d e f", None])
    got = sorted(map(tuple, jaccard.jaccard_components(d.union(d)).collect()))
    assert got == [(0, 2, 0)] * 2 + [(1, 0, 1)] * 2


def test_linked_sets_share_a_key():
    r = np.random.default_rng(1)
    for n in range(4, 60):
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        for lost in range(n // 9 + 1):
            b = np.unique(np.concatenate([a[lost:], r.integers(0, 2**63, lost).astype(np.uint64)]))
            if len(np.intersect1d(a, b)) < 0.8 * len(np.union1d(a, b)):
                continue
            keys = []
            for s in (a, b):
                keys.append(set(jaccard.set_keys(s).tolist()))
            assert keys[0] & keys[1] or set(a.tolist()) == set(b.tolist())


@pytest.mark.parametrize("n, more", [(4, 1), (5, 1), (7, 1), (12, 2), (16, 4)])
def test_sets_on_both_sides_of_the_block_limit_share_a_key(n, more):
    r = np.random.default_rng(n)
    for _ in range(20_000):
        b = r.integers(0, 2**63, n + more).astype(np.uint64)
        keys = []
        for s in (np.sort(b[:n]), np.sort(b)):
            keys.append(set(jaccard.set_keys(s).tolist()))
        assert keys[0] & keys[1]


def test_a_link_between_sizes_14_and_12(spark):
    """A pair whose keys once were disjoint."""
    words = "w8922 w786654 w728691 w240015 w924150 w992536 w482616 w801532 w845102 w894890 w363462 w161150 w289713 w558128 w954546 w874241 w37315 w594361".split()
    rows = jaccard.jaccard_components(frame(spark, [" ".join(words), " ".join(words[:16])])).collect()
    assert sorted(map(tuple, rows)) == [(0, 14, 0), (1, 12, 0)]


def windows(texts):
    seen, out = set(), []
    for t in texts:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for j in range(len(w) - 19):
            k = tuple(w[j : j + 20])
            if k in seen:
                gone[j : j + 20] = [True] * 20
            seen.add(k)
        kept = " ".join(a for a, b in zip(w, gone) if not b)
        out.append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return dict(enumerate(out))


@pytest.mark.parametrize("contents, hot", [(256, 0.01), (1, 0.01), (256, 0.0)])
def test_substring_dedup(spark, monkeypatch, contents, hot):
    monkeypatch.setattr(substring, "CONTENTS", contents)
    if not hot:  # each anchor that two documents have is hot
        for name, value in (("SHOWN", 1), ("LEAST", 2), ("HOT", 0.0)):
            monkeypatch.setattr(substring, name, value)
    texts = corpus(7) + ODD
    got = {r[0]: tuple(r)[1:] for r in substring.remove_repeats(frame(spark, texts)).collect()}
    assert got == windows(texts)
    if contents == 1:
        assert substring.remove_repeats(frame(spark, [])).collect() == []


def test_fm_index():
    r = random.Random(2)
    texts = [[r.randint(1, 4) for _ in range(r.randint(1, 30))] for _ in range(20)]
    index = fmindex.FMIndex(np.array(sum(texts, [])), np.cumsum([0, *map(len, texts)]), 8)
    flat = index.text.tolist()
    for size in (1, 2, 3, 5):
        pattern = texts[3][:size] if len(texts[3]) >= size else texts[4][:size]
        low_, high = np.array([0]), np.array([len(flat)])
        for c in reversed(pattern):
            low_, high = index.extend(np.array([c]), low_, high)
        places = sorted(index.suffix[low_[0] : high[0]].tolist())
        assert places == [i for i in range(len(flat)) if flat[i : i + len(pattern)] == pattern]


def _shards(rows, limit):
    h = {i: int(hashlib.md5(str(i if i is not None else "").encode()).hexdigest()[:15], 16) for i, _ in rows}
    size = Counter()
    for i, t in rows:
        size[h[i]] += len((t or "").encode())
    out = {}

    def split(prefix, depth, members):
        total = sum(size[x] for x in members)
        if total <= limit or depth == 60:
            out.update({x: (bin(prefix)[2:].zfill(depth) if depth else "", total) for x in members})
            return
        for bit in (0, 1):
            if some := [x for x in members if (x >> (59 - depth)) & 1 == bit]:
                split(prefix * 2 + bit, depth + 1, some)

    split(0, 0, list(size))
    return {i: out[h[i]] for i, _ in rows}


def test_sharding(spark):
    texts = corpus(4, 200) + ODD
    d = frame(spark, texts)
    for limit in (500, 7000, 10**9):
        got = {r.doc_id: (r.shard, r.shard_bytes) for r in sharding.shards(d, limit).collect()}
        assert got == _shards(list(enumerate(texts)), limit)
    assert sharding.shards(frame(spark, []), 10).collect() == []
    twice = sharding.shards(d.union(d), 10**9).collect()
    assert len(twice) == 2 * len(texts) and {r.shard for r in twice} == {""}
    assert any(r.oversized for r in sharding.shards(d, 100).collect())


def test_sentencepiece_equals_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=spm.MODEL)
    texts = corpus(8) + [t for t in ODD if t] + ["  two  spaces ", "tab\tand\nlines\r\n", "emoji 😀 𝔘 中文字符", "don't Stop-believing, THE internationalization"]
    rows = spm.encode(frame(spark, texts), check=True)
    assert set(rows.columns) >= {"ids", "n_pieces", "round_trip", "rows", "lang"}
    for r in rows.collect():
        assert r.ids == sp.encode(texts[r.doc_id]) and r.round_trip and r.n_pieces == len(r.ids)
    back = {r.doc_id: r.text for r in spm.decode(rows).collect()}
    assert back == dict(enumerate(texts))


def test_sentencepiece_dictionary_and_rare_units(spark):
    """The relational lattice, the Arrow lattice and the library give the same ids, whatever the dictionary holds."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=spm.MODEL)
    texts = [t for t in corpus(21, 40) if t] + ["stone water, houses! " * 9, "naïve\n\nnaïve naïve 😀😀", "  a  b  a  b", "the internationalization the internationalization"]
    d = frame(spark, texts)
    words = spm.dictionary(d)
    assert len(words.count) > 20
    few = spm.dictionary(d, most=10)
    assert 0 < len(few.count) <= 10
    for w in (words, few, spm.EMPTY):
        assert all(r.ids == sp.encode(texts[r.doc_id]) for r in spm.encode(d, words=w).collect())
    for i in range(len(words.count)):
        data, at = words.data[words.at[i] : words.at[i + 1]], np.array([0, words.at[i + 1] - words.at[i]])
        assert words.ids[words.begin[i] : words.begin[i] + words.count[i]].tolist() == spm.encode_units(data, at, spm.load())[0].tolist()


def thue_morse(size, a="a", b="b"):
    out = a
    while len(out) < size:
        out += out.translate(str.maketrans(a + b, b + a))
    return out[:size]


def test_structured_words_do_not_collide(spark):
    """Thue-Morse words make any polynomial hash modulo a power of two collide."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=spm.MODEL)
    x, y = thue_morse(2048), thue_morse(2048, "b", "a")
    noise = [f"w{i}" for i in range(19)]
    texts = [" ".join([*noise, x]), " ".join([*noise, y]), f"{x} {y}"]
    assert {r[0]: tuple(r)[1:] for r in substring.remove_repeats(frame(spark, texts)).collect()} == windows(texts)
    assert {r[0]: (r[1], r[2]) for r in jaccard.jaccard_components(frame(spark, texts)).collect()} == components(texts)
    assert all(r.ids == sp.encode(texts[r.doc_id]) for r in spm.encode(frame(spark, texts)).collect())
    for size in (256, 512, 1024, 4096):
        data = np.frombuffer((thue_morse(size) + thue_morse(size, "b", "a")).encode(), np.uint8)
        h = X.word_hashes(data, np.array([0, size]), np.array([size, 2 * size]))
        assert h[0] != h[1]


def test_spans_hash_sequences():
    r = np.random.default_rng(5)
    h = r.integers(0, 4, 300).astype(np.uint64)
    seen = {}
    for n in range(1, 40):
        begin = np.arange(300 - n)
        for i, g in zip(begin.tolist(), X.spans(h, begin, begin + n).tolist(), strict=True):
            assert seen.setdefault(g, tuple(h[i : i + n].tolist())) == tuple(h[i : i + n].tolist())


def test_sentencepiece_odd(spark):
    got = {r.doc_id: r for r in spm.encode(frame(spark, [None, "", "a▁b"]), check=True).collect()}
    assert got[0].ids == [] and got[1].ids == [] and got[0].round_trip and not got[2].round_trip
    assert spm.encode(frame(spark, [])).collect() == []
    assert spm.decode(spark.createDataFrame([(None,)], "ids array<int>")).collect()[0].text is None


def test_relational_lattice_is_viterbi(spark):
    table = [("a", 0, -1.0), ("b", 1, -1.5), ("ab", 2, -2.0), ("ba", 3, -1.0), ("abb", 4, -2.7)]
    words = ["abab", "abba", "bab", "a", "cab", "abab"]
    edges = spm.lattice(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame(table, "piece string, id int, score double"))
    got = {r.word: (list(r.ids), r.score) for r in spm.fold_scores(edges).collect()}

    def best(w):
        if not w:
            return 0.0
        return max([s + best(w[len(p) :]) for p, _, s in table if w.startswith(p)] + [-1e6 + best(w[1:])])

    assert {w: s for w, (_, s) in got.items()} == pytest.approx({w: best(w) for w in set(words)})


def test_decontamination(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    items = [" ".join(word() for _ in range(k)) for k in (30, 18, 12, 9, 3)] + [None, ""]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    noise = lambda k: " ".join(word() for _ in range(k))

    def changed(t, every):
        w = t.split()
        return " ".join(word() if i % every == every - 1 else x.upper() + "," for i, x in enumerate(w))

    texts = [f"{noise(40)} {items[0]} {noise(5)}", f"{noise(9)} {changed(items[0], 8)}", f"{items[1]}", f"x {items[2]} y", items[3], items[4], noise(200), None, "", f"{noise(20)} {' '.join(items[0].split()[:6])} {noise(30)}"]
    d = frame(spark, texts)
    found = {(x.doc_id, x.item_id) for x in decontam.leaks(d, bench).collect()}
    assert found == {(0, 0), (1, 0), (2, 1), (3, 2), (4, 3)}
    assert {(x.doc_id, x.item_id) for x in decontam.leaks(d, bench, block_keys=50).collect()} == found
    kept = decontam.clean(d, bench)
    assert kept.columns == d.columns and sorted(x.doc_id for x in kept.collect()) == [5, 6, 7, 8, 9]
    assert decontam.leaks(d.union(d), bench).count() == 5
    assert decontam.leaks(frame(spark, []), bench).collect() == [] and decontam.clean(d, bench.where("false")).count() == len(texts)


def test_masks_hit_every_pattern_of_a_leak():
    """All patterns of equal (1) and other words that end in positive suffixes only and start at the equal word that makes a leak."""
    patterns, stack = set(), [(k, "1", 1) for k in range(8, 20)]
    while stack:
        words, p, total = stack.pop()
        if p[0] == "1" and p.count("1") == min(13, -(-4 * words // 5)):
            patterns.add(p)
        elif len(p) < words or words == 19:
            stack.append((words, "1" + p, total + 1))
            if total > 2:
                stack.append((words, "0" + p, total - 2))
    assert len(patterns) > 1000
    for p in patterns:
        assert any(all(p[i + j] == "1" for j, c in enumerate(m) if c == "1") for m in decontam.MASKS for i in range(len(p) - len(m) + 1)), p


def leaking(own, item):
    """Whether an item leaks into a text, over all diagonals; with the number of equal words."""
    most = 0
    for diagonal in range(1 - len(item), len(own)):
        best = total = count = 0
        for j in range(max(0, -diagonal), min(len(item), len(own) - diagonal)):
            if total < 0:
                best = total = count = 0
            same = own[j + diagonal] == item[j]
            total, count = total + (1 if same else -2), count + same
            if total > best:
                best = total
                most = max(most, count)
    return most if len(item) >= 8 and most >= min(13, -(-4 * len(item) // 5)) else 0


def test_leaks_equal_brute_force(spark):
    """Whole texts with items whose words are substituted at 5 to 30 %, at edges and at each n-th place: every leak of the rule is found."""
    r = random.Random(2)
    word = lambda: f"w{r.randrange(10**6)}"
    items = [[word() for _ in range(n)] for n in (7, 8, 9, 10, 12, 12, 14, 15, 16, 20, 20, 30, 59)]
    texts = []
    for item in items:
        n = len(item)
        masks = [[i % every == phase for i in range(n)] for every in (3, 4, 5, 6) for phase in range(every)] + [[i == edge for i in range(n)] for edge in (0, n - 1)]
        masks += [[r.random() < share for _ in range(n)] for share in (0.05, 0.1, 0.2, 0.3) for _ in range(25)]
        texts += [[word() for _ in range(r.randrange(6))] + [word() if o else w for o, w in zip(m, item)] + [word() for _ in range(r.randrange(6))] for m in masks]
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    want = {(i, j): n for i, t in enumerate(texts) for j, item in enumerate(items) if set(t) & set(item) and (n := leaking(t, item))}
    got = {(x.doc_id, x.item_id): x.n_match for x in decontam.leaks(docs, bench).collect()}
    assert len(want) > 300 and got == want


def test_leaks_with_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(20))
    bench = spark.createDataFrame([(None, text), (3, text), (3, text)], "item_id long, text string")
    docs = spark.createDataFrame([(None, text), (None, "clean"), (5, text), (5, "other"), (5, text)], "doc_id long, text string")
    got = sorted(((x.doc_id, x.item_id, x.n_match) for x in decontam.leaks(docs, bench).collect()), key=str)
    assert got == [(5, 3, 20), (5, None, 20), (None, 3, 20), (None, None, 20)]
    for sent in (decontam.SENT, 0):
        old, decontam.SENT = decontam.SENT, sent
        assert sorted(map(tuple, decontam.clean(docs, bench).collect()), key=str) == [(5, "other"), (None, "clean")]
        decontam.SENT = old


def test_suffix_automaton_parses_like_brute_force():
    r = random.Random(1)
    sample = bytes(r.choice(b"ab c") for _ in range(200))
    model = langid.LanguageModel(("x",), (sample,))
    for n in (1, 7, 60, 1500):
        t = bytes(r.choice(b"abz c") for _ in range(n))
        count = 0
        for s in range(0, n, langid.SEGMENT):
            part, i = t[s : s + langid.SEGMENT], 0
            while i < len(part):
                k = i + 1
                while k < len(part) and part[i : k + 1] in sample:
                    k += 1
                i, count = k, count + 1
        got = langid.phrases(np.frombuffer(t, np.uint8), np.array([0, n]), model)
        assert got[0, 0] == count


def test_language_id(spark):
    r = random.Random(4)
    words = {"en": "the of and house green water stone".split(), "de": "der und die haus grün wasser stein".split()}
    rows = [(i, " ".join(r.choice(words[k]) for _ in range(40)), k, "x", 0.1) for i, k in enumerate(["en", "de"] * 60)]
    rows += [(1000, None, "en", "x", 0.1), (1001, "123 !!", "de", "x", 0.1), (1002, "", None, "x", 0.1), (1003, "das wasser und der stein", None, "x", 0.1), (1003, "das wasser und der stein", None, "x", 0.1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, key string, score double")
    got = langid.identify(d).collect()
    assert len(got) == len(rows)
    by = {x.doc_id: x for x in got}
    assert all(by[i].lang_pred == k for i, _, k, _, _ in rows[:120])
    assert [by[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "de"]
    assert all(0 <= x.score <= 1 and x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in got)
    assert langid.identify(d.where("false")).collect() == []
    assert {x.lang_pred for x in langid.identify(d.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_warc(spark, tmp_path):
    big, small = "<p>é" + "x" * 200, "<p>tiny"
    rows = [(3, "u3", big), (1, "u1", big), (2, None, small), (5, "u\r\n5", small), (7, "u7", None), (8, "u8", "y" * 100), (9, "u9", "y" * 100), (1, "u1", big), (10, "u", "z\r\n\r\nWARC/1.1" * 20)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "'a' as payload", "'b' as header")
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archived(d).collect())
    size = lambda t: len((t or "").encode())
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    first = {3: 1, 9: 8}
    want = sorted((i, size(t), sha(t), "revisit" if i in first else "response", first.get(i)) for i, _, t in rows)
    assert got == want
    path = str(tmp_path / "archive")
    warc.write(d, path)
    assert spark.read.parquet(f"{path}/blobs").count() == len({sha(t) for _, _, t in rows})
    records = warc.read(spark, path).collect()
    assert len(records) == len(rows) and sum(len(r.block) for r in records) == sum(size(t) for i, _, t in rows if i not in first)
    warc.export(spark, path, str(tmp_path / "out"), 3)
    back = warc.read_warc(spark, str(tmp_path / "out")).collect()
    key = lambda r: (bytes(r.header), bytes(r.block))
    assert sorted(map(key, back)) == sorted(map(key, records))
    assert len({re.search(rb"WARC-Record-ID: (.*)\r", bytes(r.header))[1] for r in back}) == len(rows)
    assert sorted(bytes(r.header) for r in back) == sorted(bytes(r.header) for r in spark.read.parquet(f"{path}/records").collect())
    with pytest.raises(Exception, match="not the payload"):
        warc.records_of(spark.createDataFrame([(bytes(r.header), bytes(r.block) + b"!", "0" * 64) for r in back], "header binary, block binary, block_digest string")).collect()
    assert warc.archived(d.where("false")).collect() == []


def test_quality(spark):
    r = random.Random(6)
    good = lambda: " ".join(r.choice("the water of stone house green and".split()) for _ in range(50))
    bad = lambda: " ".join(r.choice("the water of stone house".split()) + r.choice(["%%%", "###"]) for _ in range(50))
    texts = [good() if i % 3 else bad() for i in range(240)] + [None, "", "x " * 4000]
    d = frame(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(240)] + [(240, 1), (None, 1), (9999, None)], "doc_id long, quality int")
    got = {x.doc_id: x for x in nbsvm.classify(d, labels).collect()}
    assert len(got) == len(texts) and all(0 <= x.score <= 1 for x in got.values())
    held = [i for i in range(240) if got[i].held_out]
    assert held and all((got[i].score >= 0.7) == (i % 3 > 0) == bool(got[i].predicted) for i in held)
    assert {x.score for x in nbsvm.classify(d, labels.where("quality = 1")).collect()} == {0.5}
    assert nbsvm.classify(frame(spark, []), labels).collect() == []


def test_dual_descent_finds_the_optimum():
    r = np.random.default_rng(0)
    sets = [np.unique(r.integers(0, 12, 5)) for _ in range(60)]
    y = np.where([3 in s for s in sets], 1, -1)
    ratios = nbsvm.log_ratios(sets, y)
    w, b = nbsvm.dual_descent(sets, ratios, y, 1.0, epochs=3000)

    def loss(w, b):
        m = np.array([w[s] @ ratios[s] + b for s in sets])
        return 0.5 * (w @ w + b * b) + np.maximum(0, 1 - y * m).sum()

    best = loss(w, b)
    for _ in range(300):
        step = np.zeros_like(w)
        step[:12] = r.normal(0, 0.02, 12)
        assert loss(w + step, b + r.normal(0, 0.02)) >= best - 1e-3


def test_fingerprints(spark):
    texts = corpus(12, 50) + ODD + [corpus(12, 50)[0]]
    d = frame(spark, texts)
    for part in (5, 1000):
        got = sorted(oph.fingerprint_edits(d, rows_a_part=part).collect(), key=lambda x: x.doc_id)
        assert [x.doc_id for x in got] == list(range(len(texts)))
        for i, x in enumerate(got):
            a, b = texts[i] or "", texts[(i + 1) % len(texts)] or ""
            e = oph.edited(a, b)
            assert x.n_chars == len(a) and x.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
            for t, estimate in ((e, x.near_edited), (b, x.near_next)):
                s, u = shingles(a), shingles(t)
                true = len(s & u) / len(s | u) if s | u else 1.0
                assert abs(true - estimate) < 0.25
            assert abs(oph.compare(x.fingerprint, x.edited_fingerprint) - x.near_edited) < 1e-9
        prints = defaultdict(set)
        for i, x in enumerate(got):
            prints[texts[i] or ""].add(x.fingerprint)
        assert all(len(v) == 1 for v in prints.values())
    assert oph.fingerprint_edits(frame(spark, [])).collect() == []
    one = oph.fingerprint_edits(frame(spark, ["a b c d e f"])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    d2 = d.union(d)
    assert oph.fingerprint_edits(d2, rows_a_part=7).count() == 2 * len(texts)


def base(t):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and pii.luhn(digits):
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.findall("[0-9]", m[0])) <= 15]
    return out


def test_base_spans_match_the_patterns():
    r = random.Random(0)
    parts = ["a@b.c", "@", "x.y@z", "..@a-b.c.d@e.f", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "00001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+12", "++44 20 7946 0958", "é", " ", "\n", "word", "9", "-", ".", "4111111111111111"]
    for _ in range(3000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 9)))
        assert pii.base_spans(t) == base(t), t


def hexes(r, n=40):
    return "a1" + "".join(r.choice("0123456789abcdef") for _ in range(n - 2))


def test_learned_identifiers(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    mails = [f"{word()} please write to me: user{i}@mail{i}.example.org today {word()}" for i in range(12)]
    secrets = [f'{word()} token = "{hexes(r)}" {word()}' for _ in range(12)]
    calls = [f"{word()} phone={f'+1 (555) 555-01{i:02}'} {word()}" for i in range(12)]
    hidden = ["please write to me: anna(at)mail7 today", "nothing 123456 here", f'{word()} token = "Zq81-xx-77k" {word()}', f"{word()} {hexes(r)} alone", "x phone=555-0123 y", None, ""]
    d = frame(spark, mails + secrets + calls + hidden)
    spans = lambda x, t: [(pii.KINDS[y.k], t[y.s : y.e]) for y in x.extra]
    want = {36: [("email", "anna(at)mail7")], 38: [("secret", "Zq81-xx-77k")], 40: [("phone", "555-0123")]}
    texts = mails + secrets + calls + hidden
    for most in (pii.PATTERNS, 0):
        old, pii.PATTERNS = pii.PATTERNS, most
        try:
            got = {x.doc_id: x for x in pii.detect(d).collect()}
            clean = {x.doc_id: x.text for x in pii.redact(d).collect()}
        finally:
            pii.PATTERNS = old
        assert len(got) == len(texts) and all(got[i].n_email == 1 and not got[i].extra for i in range(12))
        assert all([k for k, _ in spans(got[i], texts[i])] == ["secret"] for i in range(12, 24))
        assert all(got[i].n_phone == 1 and not got[i].extra for i in range(24, 36))
        assert {i: spans(got[i], texts[i] or "") for i in range(36, 43)} == {i: want.get(i, []) for i in range(36, 43)}
        assert clean[36] == "please write to me: <email> today" and clean[37] == hidden[1] and clean[41] is None and clean[42] == ""
        assert clean[12] == re.sub('"[^"]*"', '"<secret>"', secrets[0])
    assert pii.redact(d).columns == d.columns
    assert pii.detect(frame(spark, [])).collect() == [] and pii.redact(frame(spark, [])).collect() == []
    assert pii.detect(d.union(d)).count() == 2 * len(texts)


def test_copies_of_a_text_support_no_pattern(spark):
    one = 'x token = "a1b2c3d4e5f6a1b2c3d4e5f6a1b2c3d4e5f6" y'
    assert all(not x.extra for x in pii.detect(frame(spark, [one] * 30 + ['u token = "Zq81-xx-77k" v'])).collect())


def test_graph_scores_equal_brute_force(spark):
    """Three rounds over the pattern-instance graph, done again with dictionaries."""
    r = random.Random(8)
    names = ["user", "mail", "token", "ip", "code"]
    value = [lambda: f"u{r.randrange(30)}@m{r.randrange(9)}.org", lambda: f"10.0.{r.randrange(9)}.{r.randrange(9)}", lambda: hexes(r, 34), lambda: f"id-{r.randrange(20)}x{r.randrange(9)}"]
    pick = lambda: j if r.random() < 0.97 else r.randrange(4)
    texts = []
    for _ in range(600):
        j = r.randrange(4)
        texts.append(f"{r.choice('abcd')} {names[j]}: {value[pick()]()} {r.choice('pqr')}")
    got = {(x.p, x.kind): x.score for x in pii.learned_patterns(frame(spark, texts)).collect()}
    seen = {(p, t[s:e].lower(), -1 if k is None else k, t) for t in texts for s, e, k, own in pii.entities(t, pii.base_spans(t)) for p in own}
    support = Counter(p for p, _ in {(p, t) for p, _, _, t in seen})
    edges = {(p, i, k) for p, i, k, _ in seen if support[p] >= pii.SUPPORT}
    size = Counter(p for p, _, _ in edges)
    seeds = {(i, k): 1.0 for _, i, k in edges if k >= 0}
    known = dict(seeds)
    for _ in range(pii.ROUNDS):
        scores = defaultdict(float)
        for p, i, k in edges:
            for kind in range(5):
                if k in (-1, kind):
                    scores[p, kind] += known.get((i, kind), 0.0)
        best = {}
        for (p, kind), v in scores.items():
            if v > 0:
                best[p] = max(best.get(p, (-1, 0)), (v / (size[p] + pii.SMOOTH), -kind))
        accepted = {(p, -k): v for p, (v, k) in best.items() if v >= pii.ACCEPT}
        known = dict(seeds)
        for p, i, k in edges:
            if k == -1:
                for (q, kind), v in accepted.items():
                    if q == p:
                        known[i, kind] = max(known.get((i, kind), 0.0), v)
    assert got and got == pytest.approx(accepted)
