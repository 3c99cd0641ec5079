"""The queries of plans.queries as DuckDB SQL."""

from __future__ import annotations

from ..functions import fonts as N
from ..functions import quality as Q
from ..functions import text as T
from ..functions.rules import duck
from ..operators import candidates as C
from ..operators.clean import DOT_LEADER, FURNITURE_REPEATS, FURNITURE_WORDS
from . import inject
from . import queries as P

S = T.SPACE


def docs(text: str = "text") -> str:
    return f"d AS (SELECT doc_id, {text} AS text FROM documents)"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{S}]+|[{S}]+$', '', 'g')"


def tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[{S}]+'), lambda w: w <> '')"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def ratio(x: str, pattern: str = f"[{T.SINHALA}]") -> str:
    return f"({count(x, pattern)}::DOUBLE / greatest(length({x}), 1))"


def orphan(x: str) -> str:
    carriers = f"{T.CONSONANTS}{T.HAL}{T.ZWJ}{T.VOWEL_SIGNS}"
    c = count(x, f"[{T.CONSONANTS}]")
    return f"(CASE WHEN {c} < {Q.MIN_CONSONANTS} THEN 0.0::DOUBLE ELSE {count(x, f'(?:^|[^{carriers}])[{T.VOWEL_SIGNS}]')}::DOUBLE / {c} END)"


MARKED = inject.marked()
NO_CONTROLS = lambda x: f"regexp_replace({x}, '[{T.CONTROLS}]', '', 'g')"


def no_zwj(x: str) -> str:
    for c in (T.YA, T.RA):
        x = f"replace({x}, '{T.HAL}{T.ZWJ}{c}', '{T.HAL}{chr(0xE000)}{c}')"
    return f"replace(replace({x}, '{T.ZWJ}', ''), '{chr(0xE000)}', '{T.ZWJ}')"


def no_zwnj(x: str) -> str:
    return f"replace({x}, '{T.ZWNJ}', '')"


def collapse(x: str) -> str:
    x = f"regexp_replace({x}, '[{T.INLINE_SPACE}]+', ' ', 'g')"
    return strip(f"regexp_replace(regexp_replace({x}, ' *\\n *', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")


LINES = f"""l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
l AS (SELECT *, {strip("line")} AS stripped FROM l0)"""
WORD = f"coalesce(list_extract({tokens('{}')}, -1), '')"
MARKS = f"""m0 AS (SELECT *, {WORD.format("stripped")} AS last, count(*) OVER (PARTITION BY doc_id, stripped) AS n FROM l),
m AS (SELECT *, stripped <> '' AND (regexp_matches(stripped, '^[\\p{{Nd}}ivxlcdmIVXLCDM]{{1,7}}$') OR {count("stripped", "[.]")} >= {DOT_LEADER}) AS noise,
  stripped <> '' AND len({tokens("stripped")}) <= {FURNITURE_WORDS} AND n >= {FURNITURE_REPEATS} AND NOT {duck("last").sentence} AS furniture FROM m0)"""


def joins(source: str) -> str:
    return f"""j0 AS (SELECT *, lag(stripped) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM {source}),
j1 AS (SELECT *, {WORD.format("coalesce(before, '')")} AS w FROM j0),
j2 AS (SELECT *, stripped <> '' AND NOT contains(line, chr(9)) AND coalesce(before, '') <> '' AND NOT contains(coalesce(before, ''), chr(9)) AND NOT {duck("w").sentence} AS joined FROM j1),
j3 AS (SELECT *, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM j2),
j4 AS (SELECT doc_id, island, string_agg(stripped, ' ' ORDER BY pos) AS line, sum(joined::INT) AS joins FROM j3 GROUP BY ALL),
j AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY island) AS text, sum(joins)::BIGINT AS joins FROM j4 GROUP BY ALL)"""


CLEAN = f"""WITH r AS (SELECT doc_id, {MARKED} AS text FROM documents),
a AS (SELECT doc_id, length(text) AS original_length, nfc_normalize(text) AS t, (nfc_normalize(text) <> text)::INT AS nfc_changed FROM r),
b AS (SELECT *, {NO_CONTROLS("t")} AS t2 FROM a), c AS (SELECT *, {no_zwj("t2")} AS t3 FROM b), e AS (SELECT *, {no_zwnj("t3")} AS t4 FROM c),
d AS (SELECT doc_id, t4 AS text FROM e), {LINES}, {MARKS}, k AS (SELECT * FROM m WHERE NOT (noise OR furniture)), {joins("k")},
g AS (SELECT doc_id, count_if(noise OR furniture) AS dropped FROM m GROUP BY ALL),
z AS (SELECT e.*, coalesce(j.text, '') AS t5, coalesce(j.joins, 0) AS joins, g.dropped, {collapse("coalesce(j.text, '')")} AS t6 FROM e JOIN g USING (doc_id) LEFT JOIN j USING (doc_id))"""

SEGMENTS = f"""p AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\n[{S}]*\\n')) AS part, generate_subscripts(regexp_split_to_array(text, '\\n[{S}]*\\n'), 1) AS block FROM d),
s0 AS (SELECT doc_id, block, unnest(string_split(part, chr(10))) AS line, generate_subscripts(string_split(part, chr(10)), 1) AS pos FROM p),
s1 AS (SELECT *, {strip("line")} AS t, CASE WHEN contains(line, chr(9)) THEN 'table_row' ELSE 'prose' END AS kind FROM s0 WHERE {strip("line")} <> ''),
s2 AS (SELECT *, lag(kind) OVER w AS pk, lag(block) OVER w AS pb FROM s1 WINDOW w AS (PARTITION BY doc_id ORDER BY block, pos)),
s3 AS (SELECT *, (sum(CASE WHEN kind <> 'prose' OR pk <> 'prose' OR pb <> block OR pb IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY block, pos) - 1)::INT AS seg_no FROM s2),
s AS (SELECT doc_id, seg_no, string_agg(t, ' ' ORDER BY block, pos) AS text, any_value(kind) AS kind FROM s3 GROUP BY doc_id, seg_no)"""


def micro(source: str, keys: str, level: str = "sentence") -> str:
    return f"""w0 AS (SELECT {keys}, unnest({tokens("text")}) AS word, generate_subscripts({tokens("text")}, 1) AS pos FROM {source}),
w1 AS (SELECT *, coalesce(sum(({getattr(duck("word"), level)})::INT) OVER (PARTITION BY {keys} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS mc FROM w0),
mi AS (SELECT {keys}, mc, string_agg(word, ' ' ORDER BY pos) AS text, count(*)::INT AS words FROM w1 GROUP BY {keys}, mc)"""


POOLS = f"""{SEGMENTS},
sp AS (SELECT *, sum((kind <> 'prose')::INT) OVER (PARTITION BY doc_id ORDER BY seg_no)::INT AS pool FROM s),
pr AS (SELECT * FROM sp WHERE kind = 'prose'), {micro("pr", "doc_id, pool, seg_no")},
x AS (SELECT doc_id, pool, (row_number() OVER w - 1)::INT AS n, text, words, coalesce(lead(seg_no) OVER w <> seg_no, false) AS gap FROM mi WINDOW w AS (PARTITION BY doc_id, pool ORDER BY seg_no, mc))"""


def merged(max_words: int, join: bool) -> str:
    over = f"(r.acc + x.words > {max_words} OR NOT {join})"
    return f"""{POOLS},
r(doc_id, pool, n, piece, acc) AS (
  SELECT doc_id, pool, n, 0, words FROM x WHERE n = 0
  UNION ALL
  SELECT x.doc_id, x.pool, x.n, CASE WHEN {over} THEN r.piece + 1 ELSE r.piece END, CASE WHEN {over} THEN x.words ELSE r.acc + x.words END
  FROM r JOIN x ON x.doc_id = r.doc_id AND x.pool = r.pool AND x.n = r.n + 1
),
y AS (SELECT x.*, r.piece, r.acc, lag(gap) OVER w AS pg, lag(r.piece) OVER w AS pp, lead(x.words) OVER w AS nw, lead(r.piece) OVER w AS np, count(*) OVER (PARTITION BY doc_id, pool) AS size
  FROM x JOIN r USING (doc_id, pool, n) WINDOW w AS (PARTITION BY doc_id, pool ORDER BY n)),
q AS (SELECT doc_id, pool, piece::INT AS piece, string_agg(text, ' ' ORDER BY n) AS text, sum(words)::INT AS words, count(*)::INT AS merged_from,
  concat_ws(',', string_agg(CASE WHEN pp = piece THEN CASE WHEN pg THEN 'segment' ELSE 'sentence' END END, ',' ORDER BY n),
    max(CASE WHEN np > piece THEN CASE WHEN acc + nw > {max_words} THEN 'guardrail' ELSE 'coherence' END WHEN size = 1 THEN 'sentence' END)) AS boundaries
  FROM y GROUP BY doc_id, pool, piece)"""


def chunks() -> str:
    return f"""WITH RECURSIVE {docs(inject.tabular())}, {merged(60, True)},
u AS (SELECT doc_id, pool, piece AS place, text, 'prose' AS segment_kind, merged_from, boundaries FROM q
  UNION ALL SELECT doc_id, pool, -1, text, kind, 1, 'table_row' FROM sp WHERE kind <> 'prose'),
v AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY pool, place) - 1)::INT AS index, 'doc-' || doc_id::VARCHAR AS name FROM u),
c AS (SELECT *, 'chunk-' || printf('%05d', index) || '-' || substr(sha256(name || '|' || index::VARCHAR || '|' || text), 1, 12) AS chunk_id, len({tokens("text")})::INT AS word_count FROM v)"""


def _list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


NAME = f"replace(regexp_replace({strip('font')}, '^[A-Z]{{6}}[+]', ''), ' ', '')"


def family(name: str) -> str:
    return f"coalesce(nullif(regexp_replace({name}, '(?i)(?:[-,[:space:]]?(?:{'|'.join(N.STYLES)}))+$', ''), ''), {name})"


def font_class(name: str, fm: bool = False) -> str:
    f = family(name)
    either = lambda v: f"({name} IN {_list(v)} OR {f} IN {_list(v)})"
    return f"""(CASE WHEN {name} = '' THEN 'unknown' WHEN {either(N.UNICODE_SINHALA)} THEN 'unicode_sinhala'
  WHEN {either(N.UNMAPPABLE)} OR regexp_matches({name}, '(?i)^({"|".join(N.UNMAPPABLE_PREFIXES)})') THEN 'legacy_unmappable'
  WHEN {either(N.LEGACY_MAPPINGS)} THEN 'legacy_mappable' {f"WHEN regexp_matches({name}, '^FM[A-Za-z]') THEN 'legacy_mappable'" if fm else ""}
  WHEN regexp_matches({f}, '^({"|".join(N.NON_SINHALA_PREFIXES)})') THEN 'non_sinhala' ELSE 'unknown' END)"""


FONTS = "f AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{f}')" for i, f in enumerate(P.FONTS)) + ") AS t(id, font))"
FONT_OF = "[" + ", ".join(f"'{f}'" for f in P.FONTS) + "]"
N_FONTS = len(P.FONTS)
SPANS = f"""{docs("text")},
s0 AS (SELECT doc_id, unnest(string_split(text, ' ')) AS text, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM d),
s1 AS (SELECT *, {FONT_OF}[(doc_id + pos) % {N_FONTS} + 1] AS font, pos % 9 = 8 AS synthetic FROM s0),
s2 AS (SELECT *, {NAME} AS name FROM s1), sc AS (SELECT *, CASE WHEN NOT synthetic THEN {font_class("name")} END AS class FROM s2)"""
#: The stand-in table, longest first: with these entries single passes over marks give the same.
CONVERT = "replace(replace(replace(replace(replace({}, 'the', '<1>'), 'th', '<2>'), 'a', 'α'), 'e', 'ε'), '<1>', 'THE')"
CONVERT = f"replace({CONVERT}, '<2>', 'θ')"

RESULTS = ", ".join(f"({i}, '{n}', {c})" for i, (n, c) in enumerate(C.PDF_BACKENDS))
CASES = " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(P.BACKEND_TEXTS))
CANDIDATES = f"""b AS (SELECT * FROM (VALUES {RESULTS}) AS t(ordinal, backend_id, cost)),
r AS (SELECT doc_id, ordinal, backend_id, cost, CASE ordinal {CASES} END AS text, doc_id % 4 = ordinal AS failed FROM documents, b)"""
BETTER = f"""CASE WHEN abs(b.ratio - a.ratio) > {Q.RATIO_TOLERANCE} THEN sign(b.ratio - a.ratio) WHEN abs(a.orphan - b.orphan) > {Q.ORPHAN_TOLERANCE} THEN sign(a.orphan - b.orphan)
  WHEN abs((b.n - a.n)::DOUBLE / greatest(a.n, b.n, 1)) > {Q.LENGTH_TOLERANCE} THEN sign(b.n - a.n) ELSE 0 END"""

SIN = inject.sinhala()
PAGE_BOX = """least(i.x1, r.x1) - greatest(i.x0, r.x0)"""
PAGES = f"""{docs(SIN)},
p0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS page FROM d),
p1 AS (SELECT doc_id, page::INT AS page, CASE WHEN (doc_id + page) % 3 = 0 THEN substr(line, 1, 15) ELSE line END AS text, CASE WHEN doc_id % 50 = 0 THEN 0 ELSE 100 END AS w,
  greatest(least(doc_id % 100, CASE WHEN doc_id % 50 = 0 THEN 0 ELSE 100 END), 0) * greatest(least(page * 30, 100), 0) AS a1,
  greatest(least(60 + doc_id % 40, CASE WHEN doc_id % 50 = 0 THEN 0 ELSE 100 END) - 20, 0) * 70 AS a2 FROM p0),
p AS (SELECT *, CASE WHEN w = 0 OR doc_id % 11 = 0 THEN 0.0::DOUBLE ELSE greatest(a1, a2)::DOUBLE / (w * 100) END AS coverage FROM p1),
o AS (SELECT *, {orphan("text")} > {Q.MAX_ORPHAN_RATE} AS malformed, length({strip("text")}) AS size FROM p),
nd AS (SELECT *, CASE WHEN malformed THEN true WHEN size >= 20 THEN false ELSE coverage >= 0.5 END AS needs, CASE WHEN size >= 20 THEN false ELSE coverage >= 0.5 END AS needs_without_repair FROM o)"""
READ = "'{} of page ' || page::VARCHAR || CASE WHEN page % 2 = 0 THEN ' of a document, read' ELSE '' END"
REPAIRED = f"""{PAGES},
r1 AS (SELECT *, CASE WHEN needs AND doc_id % 5 <> 0 THEN {READ.format("ocr")} END AS ocr FROM nd),
r2 AS (SELECT *, coalesce(ocr, text) AS now FROM r1),
r3 AS (SELECT *, CASE WHEN needs AND (length({strip("now")}) < 20 OR {orphan("now")} > {Q.MAX_ORPHAN_RATE}) AND doc_id % 3 <> 0 THEN {READ.format("vlm")} END AS vlm FROM r2),
rp AS (SELECT doc_id, page, coalesce(vlm, ocr, text) AS text, CASE WHEN vlm IS NOT NULL THEN 'multimodal' WHEN ocr IS NOT NULL THEN 'ocr' ELSE 'layer' END AS source FROM r3)"""


def oracle_sql() -> dict[str, str]:
    md5 = "md5(text) AS text_md5"
    merged_cols = f"SELECT doc_id, pool, piece, words, merged_from, boundaries, {md5} FROM q"
    return {
        "q_script_ratio": f"WITH {docs(SIN)} SELECT doc_id, {ratio('text')} AS sinhala_ratio FROM d",
        "q_orphan_rate": f"WITH {docs(SIN)} SELECT doc_id, {orphan('text')} AS orphan_vowel_rate FROM d",
        "q_score": f"WITH {docs(SIN)} SELECT doc_id, length(text)::INT AS raw_length, {ratio('text')} AS sinhala_ratio, {orphan('text')} AS orphan_vowel_rate, array_to_string({tokens('substr(text, 1, 2000)')}[1:50], '|') AS sample_tokens FROM d",
        "q_viable": f"WITH {docs(SIN)} SELECT doc_id, length(text) >= 400 AS viable, {orphan('text')} <= {Q.MAX_ORPHAN_RATE} AS well_formed, {orphan('text')} > {Q.MAX_ORPHAN_RATE} AS malformed FROM d",
        "q_candidate_select": f"""WITH {CANDIDATES},
c AS (SELECT doc_id, list({{'o': ordinal, 'id': backend_id, 'cost': cost, 'n': length(text), 'ratio': {ratio("text")}, 'orphan': {orphan("text")}}} ORDER BY ordinal) AS l FROM r WHERE NOT failed GROUP BY doc_id),
v AS (SELECT doc_id, l, list_filter(l, lambda y: y.n >= {Q.MIN_CHARS}) AS g FROM c),
w AS (SELECT doc_id, len(l) AS k, list_reduce(CASE WHEN len(g) > 0 THEN g ELSE l END, lambda a, b: CASE WHEN ({BETTER}) > 0 OR (({BETTER}) = 0 AND b.cost < a.cost) THEN b ELSE a END) AS x FROM v)
SELECT doc_id, x.id AS backend_id, x.n::INT AS raw_length, x.cost::INT AS cost, x.id AS raw_winner, k::INT AS candidates FROM w""",
        "q_attempts_history": f"""WITH {CANDIDATES} SELECT doc_id, string_agg(backend_id || CASE WHEN failed THEN ':false:ExtractionFailedError:500' ELSE ':true:-:0' END, ',' ORDER BY ordinal) AS history, count_if(NOT failed)::BIGINT AS usable FROM r GROUP BY doc_id""",
        "q_nfc": f"WITH {docs(MARKED)} SELECT doc_id, md5(nfc_normalize(text)) AS text_md5, nfc_normalize(text) <> text AS changed FROM d",
        "q_strip_controls": f"WITH {docs(MARKED)}, e AS (SELECT *, {NO_CONTROLS('text')} AS new FROM d) SELECT doc_id, md5(new) AS text_md5, (length(text) - length(new))::INT AS removed FROM e",
        "q_zero_width": f"WITH {docs(MARKED)}, e AS (SELECT *, {no_zwj('text')} AS a FROM d), f AS (SELECT *, {no_zwnj('a')} AS b FROM e) SELECT doc_id, md5(b) AS text_md5, (length(text) - length(a))::INT AS zwj, (length(a) - length(b))::INT AS zwnj FROM f",
        "q_collapse_ws": f"WITH {docs(MARKED)}, e AS (SELECT *, {collapse('text')} AS new FROM d) SELECT doc_id, md5(new) AS text_md5, (length(text) - length(new))::INT AS removed FROM e",
        "q_noise_lines": f"WITH {docs(inject.noisy())}, {LINES}, {MARKS} SELECT doc_id, count_if(noise)::BIGINT AS noise FROM m GROUP BY doc_id",
        "q_furniture": f"WITH {docs(inject.noisy())}, {LINES}, {MARKS} SELECT doc_id, count_if(furniture)::BIGINT AS furniture FROM m GROUP BY doc_id",
        "q_drop_noise": f"WITH {docs(inject.noisy())}, {LINES}, {MARKS} SELECT doc_id, md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT (noise OR furniture)), '')) AS text_md5, count_if(noise OR furniture)::BIGINT AS dropped FROM m GROUP BY doc_id",
        "q_dewrap": f"WITH {docs(inject.noisy(SIN))}, {LINES}, {joins('l')} SELECT doc_id, {md5}, joins FROM j",
        "q_clean": f"{CLEAN} SELECT doc_id, md5(t6) AS text_md5, length(t6)::INT AS length FROM z",
        "q_clean_stages": f"""{CLEAN} SELECT doc_id, original_length::INT AS original_length, nfc_changed, (length(t) - length(t2))::INT AS controls_removed, (length(t2) - length(t3))::INT AS zwj_removed, (length(t3) - length(t4))::INT AS zwnj_removed,
  dropped::INT AS noise_lines_dropped, joins::INT AS lines_joined, (length(t5) - length(t6))::INT AS whitespace_collapsed, (original_length - length(t6))::INT AS removed_characters FROM z""",
        "q_segment_prose": f"WITH {docs(inject.tabular())}, {SEGMENTS} SELECT doc_id, seg_no, kind, {md5} FROM s",
        "q_segment_sheet": f"""WITH {docs(inject.sheet())}, {LINES} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INT AS seg_no,
  CASE WHEN regexp_matches(stripped, '^={{3}}[{S}]*.+?[{S}]*={{3}}$') THEN 'sheet_heading' ELSE 'table_row' END AS kind, md5(stripped) AS text_md5 FROM l WHERE stripped <> ''""",
        "q_boundary_rules": f"""WITH {docs(SIN)}, w AS (SELECT unnest({tokens("text")}) AS word FROM d)
SELECT word, count(*)::BIGINT AS n, {duck("word").sentence} AS sentence_end, {duck("word").clause} AS clause_end, {duck("word").quotative} AS quotative, {duck("word").never} AS never_split FROM w GROUP BY word""",
        "q_micro_sentence": f"WITH {docs(SIN)}, {micro('d', 'doc_id')} SELECT doc_id, mc, words, {md5} FROM mi",
        "q_micro_clause": f"WITH {docs(SIN)}, {micro('d', 'doc_id', 'clause')} SELECT doc_id, mc, words, {md5} FROM mi",
        "q_merge_never": f"WITH RECURSIVE {docs(inject.tabular())}, {merged(300, False)} {merged_cols}",
        "q_merge_always": f"WITH RECURSIVE {docs(inject.tabular())}, {merged(300, True)} {merged_cols}",
        "q_merge_guardrail": f"WITH RECURSIVE {docs(inject.tabular())}, {merged(60, True)} {merged_cols}",
        "q_pooling_gaps": f"WITH d AS (SELECT conv_id AS doc_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id), {POOLS} SELECT doc_id, pool, n, words, gap, {md5} FROM x",
        "q_chunks": f"{chunks()} SELECT doc_id, index, chunk_id, word_count, segment_kind, merged_from, boundaries, length(text)::INT AS raw_length FROM c",
        "q_chunk_slice": f"{chunks()}, k AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS k FROM c) SELECT doc_id, index, chunk_id FROM k WHERE index >= greatest(k - 3, 0) AND index < k - 1",
        "q_document_counts": f"WITH {docs(inject.tabular())}, {POOLS}, a AS (SELECT doc_id, count(*) AS segments FROM s GROUP BY doc_id), b AS (SELECT doc_id, count(*) AS micro_chunks FROM mi GROUP BY doc_id) SELECT doc_id, segments, coalesce(micro_chunks, 0) AS micro_chunks FROM a LEFT JOIN b USING (doc_id)",
        "q_chunk_json": f"""{chunks()} SELECT doc_id, '{{"chunks":[' || string_agg('{{"index":' || index || ',"chunk_id":"' || chunk_id || '","word_count":' || word_count || '}}', ',' ORDER BY index) || '],"config":{{"similarity_threshold":0.2,"max_words":300,"level":"sentence","respect_table_rows":true}}}}' AS json FROM c GROUP BY doc_id""",
        "q_font_class": f"WITH {FONTS}, n AS (SELECT id, {NAME} AS name FROM f) SELECT id, {font_class('name')} AS class, {font_class('name', True)} AS class_fm, CASE WHEN {font_class('name')} = 'legacy_mappable' THEN 'fm_abhaya' END AS mapping, {font_class('name')} IN ('legacy_mappable', 'legacy_unmappable') AS legacy FROM n",
        "q_font_name": f"WITH {FONTS}, n AS (SELECT id, {NAME} AS name FROM f) SELECT id, name, {family('name')} AS family FROM n",
        "q_normalise_spans": f"""WITH {SPANS} SELECT doc_id, md5(string_agg(CASE WHEN class = 'legacy_mappable' THEN {CONVERT.format("text")} ELSE text END, '' ORDER BY pos)) AS text_md5,
  CASE WHEN count_if(class = 'legacy_mappable') > 0 THEN 'font_name' ELSE 'none' END AS method,
  coalesce(array_to_string(list_sort(list_distinct(list(name) FILTER (WHERE class = 'legacy_mappable'))), '|'), '') AS converted,
  coalesce(array_to_string(list_sort(list_distinct(list(name) FILTER (WHERE class = 'legacy_unmappable'))), '|'), '') AS unmapped FROM sc GROUP BY doc_id""",
        "q_fonts_by_class": f"WITH {SPANS} SELECT class, array_to_string(list_sort(list_distinct(list(name))), '|') AS fonts FROM sc WHERE NOT synthetic AND font <> '' GROUP BY class",
        "q_ratio_heuristic": f"""WITH d AS (SELECT doc_id, text, {FONT_OF}[doc_id % {N_FONTS} + 1] AS font FROM documents), n AS (SELECT *, {NAME} AS name FROM d)
SELECT doc_id, {strip("text")} <> '' AND {ratio("text")} < {N.RATIO_THRESHOLD} AND {font_class("name")} NOT IN ('unicode_sinhala', 'non_sinhala', 'legacy_unmappable') AND {ratio("text", f"[{T.HIGH_LATIN}]")} >= {N.HIGH_BIT_FLOOR} AS fires FROM n""",
        "q_normalise": f"""WITH d AS (SELECT doc_id, text, {FONT_OF}[doc_id % {N_FONTS} + 1] AS font FROM documents), n AS (SELECT *, {NAME} AS name FROM d), c AS (SELECT *, {font_class("name")} AS class FROM n),
m AS (SELECT *, CASE WHEN class = 'legacy_mappable' THEN 'font_name' WHEN {strip("text")} <> '' AND {ratio("text")} < {N.RATIO_THRESHOLD} AND class = 'unknown' AND {ratio("text", f"[{T.HIGH_LATIN}]")} >= {N.HIGH_BIT_FLOOR} THEN 'character_ratio' ELSE 'none' END AS method FROM c)
SELECT doc_id, md5(CASE WHEN method = 'none' THEN text ELSE {CONVERT.format("text")} END) AS text_md5, method, CASE WHEN class = 'legacy_mappable' THEN name ELSE '' END AS converted, CASE WHEN class = 'legacy_unmappable' THEN name ELSE '' END AS unmapped FROM m""",
        "q_image_coverage": f"WITH {PAGES} SELECT doc_id, page, round(coverage, 9) AS coverage FROM p",
        "q_needs_ocr": f"WITH {PAGES} SELECT doc_id, page, needs, needs_without_repair FROM nd",
        "q_repair_pages": f"WITH {REPAIRED} SELECT doc_id, page, source, {md5} FROM rp",
        "q_repair_documents": f"""WITH {REPAIRED}, g AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page) AS t, coalesce(string_agg(page::VARCHAR, ',' ORDER BY page) FILTER (WHERE source = 'ocr'), '') AS pages_ocred, coalesce(string_agg(page::VARCHAR, ',' ORDER BY page) FILTER (WHERE source = 'multimodal'), '') AS pages_multimodal FROM rp GROUP BY doc_id),
h AS (SELECT doc_id, CASE WHEN pages_ocred || pages_multimodal <> '' THEN t ELSE documents.text END AS text, pages_ocred, pages_multimodal FROM documents JOIN g USING (doc_id))
SELECT doc_id, 'pdfminer' AS backend_id, {md5}, pages_ocred, pages_multimodal, length(text)::INT AS raw_length FROM h""",
        "q_vlm_budget": f"WITH {PAGES} SELECT doc_id, count(*)::BIGINT AS needed FROM nd WHERE needs GROUP BY doc_id HAVING count(*) > 2",
        "q_adjacent_cosine": "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    }
