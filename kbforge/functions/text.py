"""Column expressions shared by several operators.

All of them are native Spark expressions (regex, split, array functions), so
they run inside whole-stage codegen and need no Python worker.

Regex dialects: Spark uses java.util.regex.  The oracle SQL in
``kbforge.plans`` runs the same patterns on RE2, so patterns here avoid the
constructs the two disagree on (lookaround, ``(?U)``, back-references in
patterns) and the accent mapping below fixes ``\\b`` next to accented letters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (our own choices, documented in README):
# a "token" is a run of non-whitespace; a "term" is a run of Unicode letters
# or digits after lower-casing.
WS_TOKEN_SPLIT = r"\s+"
TERM_PATTERN = r"[\p{L}\p{N}]+"
# What stands between two terms.
NO_TERM_PATTERN = r"[^\p{L}\p{N}]+"
# Latin-1 supplement and Latin Extended-A/B letters.  Java treats them as
# word characters for \b and RE2 does not; mapping them to "_" (a word
# character outside [A-Za-z]) gives both engines the same boundaries.
ACCENTED_LETTERS = "[À-ÖØ-öø-ɏ]"


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(c, fn) -> Column:
    """``fn`` of a column that is computed once, however often ``fn`` uses it
    (an expression used twice is otherwise computed twice, nested ones more)."""
    return F.get(F.transform(F.array(col_of(c)), fn), F.lit(0))


# White space as Python's ``str.strip`` and ``\s`` have it (Java's and RE2's
# ``\s`` are ASCII only): for trimming, and as a regex class for both.
WS_CODES = (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
WS_CHARS = "".join(map(chr, WS_CODES))
WS_CLASS = "[" + "".join(f"\\x{{{c:x}}}" for c in WS_CODES) + "]"


def strip_ws(c) -> Column:
    """Python ``str.strip()``: removes white space at both ends, without a
    regex scan."""
    return F.btrim(col_of(c), F.lit(WS_CHARS))


def ws_tokens(c) -> Column:
    """Whitespace tokens; an all-blank text gives an empty array."""
    s = strip_ws(c)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(
        F.split(s, WS_TOKEN_SPLIT)
    )


def term_set(c) -> Column:
    """Distinct lower-cased letter/digit terms of a text."""
    return F.array_distinct(
        F.regexp_extract_all(F.lower(col_of(c)), F.lit(TERM_PATTERN), 0)
    )


def map_accents(c) -> Column:
    return F.regexp_replace(col_of(c), ACCENTED_LETTERS, "_")


def extract_all(c, pattern: str) -> Column:
    """All whole matches (group 0) of ``pattern`` in text order."""
    return F.regexp_extract_all(col_of(c), F.lit(pattern), 0)
