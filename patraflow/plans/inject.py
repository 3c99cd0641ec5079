"""Deterministic features for tables that lack them, as SQL that Spark and DuckDB read alike.

Letters become Sinhala consonants and vowel signs, frequent words become entries of the lexicons, and lines, noise, joiners and tabs
are put in. Every text stays a pure function of its row.
"""

from __future__ import annotations

_LATIN = "bcdfghjklmnpqrstvwxyz" + "aeiou"
_SINHALA = "".join(chr(0x0D9A + i) for i in range(21)) + "".join(chr(0x0DCF + i) for i in range(5))
_MAP = str.maketrans(_LATIN, _SINHALA)
_WORDS = {"the": "ඔහු", "of": "කරයි", "and": "සහ", "to": "නමුත්", "de": "යති", "la": "ගොස්", "que": "පැමිණියොත්", "und": "වූහ", "die": "එතියි", "in": "නම්"}


def _replace(sql: str, old: str, new: str) -> str:
    return f"replace({sql}, '{old}', '{new}')"


def sinhala(column: str = "text") -> str:
    out = f"translate({column}, '{_LATIN}', '{_SINHALA}')"
    for latin, word in _WORDS.items():
        out = _replace(out, f" {latin.translate(_MAP)} ", f" {word} ")
    return out


def broken(column: str = "text") -> str:
    """Line feeds in the middle of sentences."""
    out = column
    for word in ("the", "de", "und", "la"):
        out = f"replace({out}, ' {word} ', ' {word}' || chr(10))"
    return out


def noisy(column: str = "text") -> str:
    """Page numbers, a running head, a dot leader and blank lines."""
    parts = ["'Running head'", broken(column), "CAST(doc_id % 300 AS STRING)", "'Running head '", "'Contents .......... 4'", "''", "'Running head'", "'xiv'"]
    return " || chr(10) || ".join(parts)


def marked(column: str = "text") -> str:
    """Joiners in and out of place, controls, no-break spaces and decomposed accents, in noisy Sinhala."""
    out = noisy(sinhala(column))
    out = _replace(out, " නම් ", " ක්‍ය‍‌ න‌‍ම් ")
    out = _replace(out, "කරයි ", "ක්‍රයි\x07­  ")
    out = _replace(out, "é", "é")
    return _replace(out, "ó", "ó﻿")


def tabular(column: str = "text") -> str:
    """Paragraphs with rows of cells between lines."""
    out = f"replace({broken(column)}, chr(10), chr(10) || chr(10))"
    out = f"replace({out}, ' en ', chr(10) || 'cell' || chr(9) || 'en' || chr(10))"
    return f"replace({out}, ' for ', chr(10) || ' for' || chr(9) || 'row ' || chr(10) || ' ' || chr(10))"


def sheet(column: str = "text") -> str:
    return f"'=== Sheet ' || CAST(doc_id AS STRING) || ' ===' || chr(10) || replace(replace({column}, '. ', chr(10) || chr(10)), ', ', chr(9))"
