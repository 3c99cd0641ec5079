"""Quality of Sinhala text: script ratio, orphan vowel signs, and an ordering of candidates with tolerances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Thresholds of the quality score.
MAX_ORPHAN_RATE, MIN_CONSONANTS, MIN_CHARS = 0.01, 20, 32
RATIO_TOLERANCE, ORPHAN_TOLERANCE, LENGTH_TOLERANCE = 0.01, 0.005, 0.02
PREFIX_CHARS, TOKEN_LIMIT = 2000, 50


def sinhala_ratio(c: Column) -> Column:
    """Characters of the Sinhala block over all, 0 for an empty text."""
    return T.ratio_of(c, f"[{T.SINHALA}]")


def orphan_vowel_rate(c: Column) -> Column:
    """Dependent vowel signs that follow nothing they could belong to, over consonants; 0 below MIN_CONSONANTS consonants."""
    carriers = f"{T.CONSONANTS}{T.HAL}{T.ZWJ}{T.VOWEL_SIGNS}"
    consonants = T.count_of(c, f"[{T.CONSONANTS}]")
    orphans = T.count_of(c, f"(?:\\A|[^{carriers}])[{T.VOWEL_SIGNS}]")
    return F.when(consonants < MIN_CONSONANTS, F.lit(0.0)).otherwise(orphans / consonants)


def sample_tokens(c: Column, limit: int = TOKEN_LIMIT, prefix: int = PREFIX_CHARS) -> Column:
    return F.slice(T.tokens(F.substring(c, 1, prefix)), 1, limit)


def score(c: Column, with_tokens: bool = True) -> Column:
    """The quality struct; region_coverage is never known."""
    sample = sample_tokens(c) if with_tokens else F.array().cast("array<string>")
    return F.struct(
        F.length(c).alias("raw_length"),
        sinhala_ratio(c).alias("sinhala_ratio"),
        F.lit(None).cast("double").alias("region_coverage"),
        sample.alias("sample_tokens"),
        orphan_vowel_rate(c).alias("orphan_vowel_rate"),
    )


def is_well_formed(quality: Column, most: float = MAX_ORPHAN_RATE) -> Column:
    return quality["orphan_vowel_rate"] <= most


def is_viable(quality: Column, least: int = MIN_CHARS) -> Column:
    return quality["raw_length"] >= least


def is_malformed(c: Column, most: float = MAX_ORPHAN_RATE) -> Column:
    return orphan_vowel_rate(c) > most


def compare(a: Column, b: Column) -> Column:
    """1, 0 or -1 as a is better, like or worse than b: by ratio, then fewer orphans, then length, each beyond its tolerance."""
    ratio = a["sinhala_ratio"] - b["sinhala_ratio"]
    orphan = b["orphan_vowel_rate"] - a["orphan_vowel_rate"]
    length = (a["raw_length"] - b["raw_length"]) / F.greatest(a["raw_length"], b["raw_length"], F.lit(1))
    by = [(ratio, RATIO_TOLERANCE), (orphan, ORPHAN_TOLERANCE), (length, LENGTH_TOLERANCE)]
    out = F.when(F.abs(by[0][0]) > by[0][1], F.signum(by[0][0]))
    for gap, tolerance in by[1:]:
        out = out.when(F.abs(gap) > tolerance, F.signum(gap))
    return out.otherwise(0).cast("int")
