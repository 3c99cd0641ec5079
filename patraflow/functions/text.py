"""Character classes and whitespace, as Unicode-aware column expressions.

Patterns hold the characters themselves, so the same pattern serves Java's and RE2's syntax.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points of the Sinhala block and of what cleaning removes.
SINHALA = "඀-෿"
CONSONANTS = "ක-ෆ"
VOWEL_SIGNS = "ා-ෟෲෳ"
HAL, ZWJ, ZWNJ = "්", "‍", "‌"
YA, RA = "ය", "ර"
HIGH_LATIN = " -ÿ"
CONTROLS = "\x00-\x08\x0b\x0c\x0e-\x1f\x7f­﻿"
#: Unicode whitespace with the four separators U+001C to U+001F.
SPACE = "\t-\r\x1c-\x20\x85\xa0  -     　"
#: The same without tab and line feed.
INLINE_SPACE = "\x0b-\r\x1c-\x20\x85\xa0  -     　"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"\\A[{SPACE}]+|[{SPACE}]+\\z", "")


def tokens(c: Column) -> Column:
    """Words between whitespace; none for a blank text."""
    return F.filter(F.split(c, f"[{SPACE}]+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(tokens(c))


def last_word(c: Column) -> Column:
    """The last word; an empty string where there is none."""
    return F.coalesce(F.try_element_at(tokens(c), F.lit(-1)), F.lit(""))


def count_of(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def ratio_of(c: Column, pattern: str) -> Column:
    return count_of(c, pattern) / F.greatest(F.length(c), F.lit(1))
