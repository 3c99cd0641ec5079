"""Personal data: fixed base patterns, then bootstrapped contextual extraction.

Entities are base spans (email, ip, card, phone) and candidates: the cores, without quotes and punctuation at both ends, of other
whitespace-free tokens with a digit or an @ and MIN_TOKEN characters or more. Seeds are the base spans and, for the kind `secret`, candidates
of 32 or more hexadecimal digits with a letter and a digit among them.

1. Each occurrence of an entity induces lexical patterns, with A-Z in lower case, digits as 0 and long words by hash: what stands before it
   (two words and the signs up to it, or one word and the signs), what stands after it (the signs and a word), both, and in an assignment the
   name and its sign.
2. The pattern-instance graph has an edge for each pattern and instance (hash of its text), counted over distinct texts, so that copies of a
   document support nothing. Spark scores it in ROUNDS rounds for each kind: a pattern by the mean score of its distinct instances, with
   SMOOTH unseen ones of score 0; an instance that is no seed by its best pattern among the accepted; a seed counts 1 for its own kind.
3. A pattern is accepted with a score of ACCEPT or more and SUPPORT or more distinct texts. Candidates that an accepted pattern surrounds
   become spans of its kind: identifiers that no base pattern matches.

Accepted patterns are few; up to PATTERNS of them go to the workers, and beyond that the occurrences are joined with them.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import _worker  # noqa: F401
from ._store import drop, save

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS, SECRET = 4, 4
#: Fixed patterns of the contract, with possessive forms where giving back can't help.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_MAY_IP = re.compile(r"[0-9]\.[0-9]")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_HEX = re.compile(r"(?=[0-9A-Fa-f]*[0-9])(?=[0-9A-Fa-f]*[A-Fa-f])[0-9A-Fa-f]{32,}")
#: Signs that are no part of a candidate, at its begin and at its end.
_OPEN, _CLOSE = "\"'`([{<*_~|", "\"'`)]}>*_~|,;:.!?#%&$"
_ASSIGN = re.compile(r"([^=:]+)([=:]+)")
MIN_TOKEN, ROUNDS, ACCEPT, SUPPORT, SMOOTH = 6, 3, 0.8, 8, 1.0
#: Patterns that go to the workers at most; words of a context up to this size, longer ones by hash.
PATTERNS, WORD = 50_000, 40


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str):
    p, end = text.find("@"), 0
    while p >= 0:
        begin = p
        while begin > end and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < p and (m := _DOMAIN.match(text, p + 1)):
            end = m.end()
            yield begin, end
        p = text.find("@", p + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end) in code points, in the order of kinds, then starts."""
    out = [(0, *s) for s in _emails(text)]
    if not _DIGIT.search(text):
        return out
    if _MAY_IP.search(text):
        out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def _low(word: str) -> str:
    low = _DIGIT.sub("0", "".join(c.lower() if "A" <= c <= "Z" else c for c in word))
    return low if len(low) <= WORD else hashlib.md5(low.encode("utf-8", "surrogatepass")).hexdigest()


def _core(text: str, s: int, e: int) -> tuple[int, int]:
    while s < e and text[s] in _OPEN:
        s += 1
    while e > s and text[e - 1] in _CLOSE:
        e -= 1
    return s, e


def entities(text: str, base) -> list[tuple[int, int, int | None, list[str]]]:
    """(start, end, seed's kind or None, patterns) of base spans and candidates, by start."""
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    found = [(s, e, k) for k, s, e in base]
    taken = sorted((s, e) for s, e, _ in found)
    i = 0
    for s, e in tokens:
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        if e - s < MIN_TOKEN or (i < len(taken) and taken[i][0] < e) or not (_DIGIT.search(text, s, e) or "@" in text[s:e]):
            continue
        if m := _ASSIGN.match(text, s, e):
            s = m.end()
        s, e = _core(text, s, e)
        if e - s >= MIN_TOKEN and (_DIGIT.search(text, s, e) or "@" in text[s:e]):
            found.append((s, e, SECRET if _HEX.fullmatch(text, s, e) else None))
    starts = [s for s, _ in tokens]
    out = []
    for s, e, kind in sorted(found, key=lambda x: x[:2]):
        n = bisect_right(starts, s) - 1  # the token that the entity begins in
        last = bisect_left(starts, e) - 1
        before = [_low(text[a:b]) for a, b in tokens[max(0, n - 2) : n]]
        after = [_low(text[a:b]) for a, b in tokens[last + 1 : last + 2]]
        head, tail = _low(text[tokens[n][0] : s]), _low(text[e : tokens[last][1]])
        left = " ".join([*before[-1:], head])
        patterns = [f"L2:{' '.join([*before, head])}"] * (len(before) == 2) + [f"L1:{left}"] * bool(before) + [f"R1:{' '.join([tail, *after])}"] * bool(after)
        patterns += [f"LR:{left}>{' '.join([tail, *after])}"] * bool(before and after)
        patterns += [f"IN:{head}"] * bool(_ASSIGN.match(head))
        out.append((s, e, kind, patterns))
    return out


_SEEN = "p string, inst long, kind int, tid long"
_SPANS = "array<struct<k:int,s:int,e:int>>"
_OCCURRENCES = "array<struct<s:int,e:int,p:string>>"
_SPAN_TYPE = pa.list_(pa.struct([("k", pa.int32()), ("s", pa.int32()), ("e", pa.int32())]))


def _may(texts: pa.Array) -> list[int]:
    """The rows whose text has a digit or an @; no other holds an entity."""
    return pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(texts, "[0-9@]"), False)).to_pylist()


def _key(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _graph(batches):
    """Edges of the pattern-instance graph, one row a pattern, instance and text."""
    for batch in batches:
        rows = set()
        texts = batch.column(0)
        for i in _may(texts):
            text = texts[i].as_py()
            found = entities(text, base_spans(text))
            tid = _key(text) if found else 0
            for s, e, kind, patterns in found:
                inst = _key(text[s:e].lower())
                rows.update((p, inst, -1 if kind is None else kind, tid) for p in patterns)
        cols = list(zip(*sorted(rows), strict=True)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["p", "inst", "kind", "tid"])


def learned_patterns(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Accepted (p, kind, score), stored, from all texts of docs."""
    seen = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_graph, _SEEN)
    seen = save(seen.distinct(), "seen")  # copies of a text count once
    texts = seen.groupBy("p", "tid").agg(F.count("*").alias("rows")).groupBy("p").agg(F.count("*").alias("texts")).where(F.col("texts") >= SUPPORT)
    edges = save(seen.join(texts, "p").groupBy("p", "inst", F.col("kind").alias("seed")).agg(F.max("texts").alias("texts")), "graph")
    drop(seen)
    size = edges.groupBy("p").agg(F.count("*").alias("size"))
    known = edges.where("seed >= 0").select("inst", F.col("seed").alias("kind"), F.lit(1.0).alias("s")).distinct()
    stored = []
    for _ in range(ROUNDS):
        hit = edges.join(known, "inst").where("seed = kind or seed = -1").groupBy("p", "kind").agg(F.sum("s").alias("got"))
        scored = hit.join(size, "p").select("p", "kind", (F.col("got") / (F.col("size") + SMOOTH)).alias("score"))
        best = scored.groupBy("p").agg(F.max(F.struct("score", (-F.col("kind")).alias("k"))).alias("m"))
        accepted = save(best.select("p", (-F.col("m.k")).alias("kind"), F.col("m.score").alias("score")).where(F.col("score") >= ACCEPT), "patterns")
        stored.append(accepted)
        new = edges.where("seed = -1").join(accepted, "p").groupBy("inst", "kind").agg(F.max("score").alias("s"))
        known = edges.where("seed >= 0").select("inst", F.col("seed").alias("kind"), F.lit(1.0).alias("s")).distinct().unionByName(new)
    drop(edges, *stored[:-1])
    return stored[-1]


def extra_spans(text: str, base, patterns: dict[str, tuple[float, int]]) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the candidates that accepted patterns surround; the highest score decides, then the kind listed first."""
    out = []
    for s, e, kind, own in entities(text, base):
        if (kind is None or kind >= BASE_KINDS) and (hits := [patterns[p] for p in own if p in patterns]):
            out.append((-max(hits)[1], s, e))
    return out


def _collected(patterns: DataFrame) -> dict[str, tuple[float, int]] | None:
    """Accepted patterns as p: (score, minus the kind), or None if they are more than PATTERNS."""
    rows = patterns.limit(PATTERNS + 1).collect()
    return {r["p"]: (r["score"], -r["kind"]) for r in rows} if len(rows) <= PATTERNS else None


def _spans(patterns: dict[str, tuple[float, int]] | None, keep: int):
    """Base spans, their numbers and the extra spans of the last column's texts; without patterns the candidates with their patterns."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            base: list = [[] for _ in range(n)]
            extra: list = [[] for _ in range(n)]
            texts = batch.column(keep)
            for i in _may(texts):
                text = texts[i].as_py()
                spans = base_spans(text)
                base[i] = [{"k": k, "s": s, "e": e} for k, s, e in spans]
                if patterns is None:
                    extra[i] = [{"s": s, "e": e, "p": p} for s, e, kind, own in entities(text, spans) if kind is None or kind >= BASE_KINDS for p in own]
                elif patterns:
                    extra[i] = [{"k": k, "s": s, "e": e} for k, s, e in extra_spans(text, spans, patterns)]
            more = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("p", pa.string())])) if patterns is None else _SPAN_TYPE
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], pa.array(base, _SPAN_TYPE), pa.array(extra, more)], [*batch.schema.names[:keep], "base", "extra"])

    return run


def _with_spans(rows: DataFrame, text_col: str) -> DataFrame:
    """rows, whose last column is the text, with base and extra in its place; no row moves unless the patterns are more than PATTERNS."""
    accepted = learned_patterns(rows, text_col)
    patterns = _collected(accepted)
    n = len(rows.columns) - 1
    schema = lambda extra: StructType([*rows.schema.fields[:n], *_parse(f"base {_SPANS}, extra {extra}")])
    if patterns is not None:
        drop(accepted)
        return rows.mapInArrow(_spans(patterns, n), schema(_SPANS))
    found = save(rows.mapInArrow(_spans(None, n), schema(_OCCURRENCES)).withColumn("_row", F.expr("uuid()")), "found")
    spans = found.select("_row", F.explode("extra").alias("x")).select("_row", "x.*").join(accepted, "p").groupBy("_row", "s", "e").agg(F.max(F.struct("score", (-F.col("kind")).alias("k"))).alias("m"))
    # at most one span a token of one text, so a row's spans are no larger than its text
    spans = spans.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct((-F.col("m.k")).cast("int").alias("k"), "s", "e"))).alias("spans"))
    none = F.array().cast(_SPANS)
    return found.join(spans, "_row", "left").select(*rows.columns[:n], "base", F.coalesce("spans", none).alias("extra"))


def _parse(ddl: str) -> list:
    return StructType.fromDDL(ddl).fields


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone (base spans), base, extra (arrays of structs k, s, e: the number of
    the kind, start, end in code points). Null texts count as empty. extra holds learned spans, which touch no base span; where patterns
    differ, the highest score decides, then the kind listed first. Repeated rows stay, null ids too. Texts are worked whole. Patterns are
    learned at once, in a pass of its own.
    """
    found = _with_spans(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), "text")
    counts = [F.expr(f"cast(size(filter(base, x -> x.k = {k})) as long)").alias(f"n_{name}") for k, name in enumerate(KINDS[:BASE_KINDS])]
    return found.select("doc_id", *counts, "base", "extra")


def spans_string(spans):
    """kind:start:end, comma-joined, of an array of spans by kind, then start."""
    names = F.array(*map(F.lit, KINDS))
    ordered = F.array_sort(spans)
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def digest_of(text: str) -> str:
    return hashlib.sha256(joined(base_spans(text)).encode()).hexdigest()


def _replaced(text: str, spans) -> str:
    out, at = [], 0
    for s, e, k in sorted((x["s"], -x["e"], x["k"]) for x in spans):
        if s >= at:
            out += [text[at:s], f"<{KINDS[k]}>"]
            at = -e
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, with each base or learned span of the text replaced by its kind in angle brackets.

    Patterns are learned on all rows first. Of spans that overlap, the first stays, of equal starts the longest. Null texts stay null.
    """
    names = docs.columns
    i = names.index(text_col)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = _with_spans(rows, "text")

    def run(batches):
        for batch in batches:
            cols = batch.column(0).flatten()
            base, extra = batch.column(1), batch.column(2)
            texts = cols[i].to_pylist()
            for k in pc.indices_nonzero(pc.greater(pc.add(pc.list_value_length(base), pc.list_value_length(extra)), 0)).to_pylist():
                texts[k] = _replaced(texts[k], base[k].as_py() + extra[k].as_py())
            cols[i] = pa.array(texts, cols[i].type)
            yield pa.RecordBatch.from_arrays(cols, names)

    return found.mapInArrow(run, docs.schema)
