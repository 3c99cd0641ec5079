"""Boundary rules of Sinhala as predicates over words.

The lexicons are data; the predicates are one SQL text for any column name, so Spark and an oracle can share them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The grammar's word lists.
FINITE_ENDINGS = ("මි", "මු", "හි", "හු", "යි", "ති", "හ")
SENTENCE_WORDS = ("ය", "සේක", "වටී", "යුතු", "යෙහෙකි", "මැනවි", "හොබී")
PUNCTUATION = (".", "?", "!", "|", "||")
CLAUSE_ENDINGS = ("ලා", "මින්", "ගොස්", "ොත්", "තොත්", "ද්දී", "ද්දි", "තත්")
CLAUSE_WORDS = ("නම්", "විට", "පසු", "ගොස්")
CONNECTIVES = ("නමුත්", "එහෙත්", "එබැවින්", "එමනිසා", "නිසා", "එනිසා", "එසේහෙයින්", "එහෙයින්")
NEVER_SPLIT = ("සහ", "සමඟ", "සමග", "හා", "කැටුව", "ද", "හෝ", "නොහොත්", "නො", "නොව")
PRONOUNS = (
    "මම", "මා", "අපි", "අප", "තෝ", "තා", "තී", "ඔබ", "නුඹ", "නුඹලා", "තොපි", "තෙපි", "තොප", "තෙප",
    "යුෂ්මතා", "යුෂ්මතී", "යුෂ්මත්හු", "යුෂ්මතුන්", "හේ", "ඕ", "ඈ", "හෙතෙම", "තෙමේ", "තොමෝ", "මෑ", "මෝ",
    "ඔහු", "ඇය", "මැය", "ඔවුහු", "මොවුහු", "තුමූ", "ඔවුන්", "මොවුන්", "මෙවුන්",
    "ඇතැමෙක්", "කෙනෙක්", "අයෙක්", "ඇතැම්හු", "ඇතැම්මු",
    "කවුරු", "ඇතැමෙකු", "කෙනෙකු", "අයෙකු", "ඇතැමුන්", "කවුරුන්",
)
INDECLINABLES = ("එහි", "මෙහි", "කොහි")
QUOTATIVE_MARKS, QUOTATIVE = ("'යි", "’යි"), "යි"


def _text(value: str, backslash: bool) -> str:
    """A SQL string; Spark reads a quote as \\' where DuckDB doubles it."""
    return "'" + value.replace("'", "\\'" if backslash else "''") + "'"


class Rules:
    """SQL conditions on the word in column w. ends is the engine's name for a suffix test."""

    def __init__(self, w: str, ends: str = "endswith", backslash: bool = True):
        s = lambda v: _text(v, backslash)
        any_end = lambda suffixes: "(" + " OR ".join(f"{ends}({w}, {s(e)})" for e in suffixes) + ")"
        longer = lambda suffixes: "(" + " OR ".join(f"({ends}({w}, {s(e)}) AND length({w}) > {len(e)})" for e in suffixes) + ")"
        among = lambda words: f"{w} IN ({', '.join(map(s, words))})"
        #: The quotative follows a form that is finite already.
        self.quotative = any_end((*QUOTATIVE_MARKS, *(e + QUOTATIVE for e in FINITE_ENDINGS)))
        self.never = f"({among(NEVER_SPLIT + PRONOUNS + INDECLINABLES)} OR {self.quotative})"
        self.sentence = f"(NOT {self.never} AND ({any_end(PUNCTUATION)} OR {among(SENTENCE_WORDS)} OR {longer(FINITE_ENDINGS)}))"
        self.clause = f"({self.sentence} OR (NOT {self.never} AND ({among(CLAUSE_WORDS + CONNECTIVES)} OR {longer(CLAUSE_ENDINGS)})))"


def duck(w: str) -> Rules:
    return Rules(w, "suffix", False)


def is_sentence_end(column: str) -> Column:
    return F.expr(Rules(column).sentence)


def is_clause_end(column: str) -> Column:
    return F.expr(Rules(column).clause)


def is_split(column: str, level: str) -> Column:
    """clause for the clause level, else sentence."""
    return is_clause_end(column) if level == "clause" else is_sentence_end(column)
