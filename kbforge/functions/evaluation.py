"""Column expressions of the answer-scoring metrics.

All are native array/regex expressions evaluated row by row inside codegen;
the two texts being compared are columns of the same row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kbforge.functions.text import WS_CLASS, col_of, extract_all, map_accents

# Fixed values that must equal the reference's scoring for equal results:
# number pattern, capitalised-term pattern, the 13 domain keywords and the
# metric weights (numbers 0.5, keywords 0.3, terms 0.2).
NUMBER_PATTERN = r"[\d,]+(?:\.\d+)?"
# (with ``\s`` spelled out as Unicode white space, as Python has it)
CAPITAL_TERM_PATTERN = rf"\b[A-Z][a-z]+(?:{WS_CLASS}+[A-Z][a-z]+)*\b"
SCHEME_KEYWORDS = (
    "First Home Scheme",
    "Help to Buy",
    "Local Authority",
    "HAP",
    "RAS",
    "Cost Rental",
    "Vacant Property",
    "Affordable Purchase",
    "Enhanced",
    "Dublin",
    "Cork",
    "Galway",
    "fresh start",
)
WEIGHT_NUMBERS, WEIGHT_KEYWORDS, WEIGHT_TERMS = 0.5, 0.3, 0.2


def number_set(c) -> Column:
    """Distinct numbers after removing every comma (``30,000`` -> ``30000``)."""
    return F.array_distinct(extract_all(F.replace(col_of(c), F.lit(","), F.lit("")), NUMBER_PATTERN))


def capital_term_set(c) -> Column:
    """Distinct runs of capitalised words (joined across any whitespace).

    Accented letters are mapped to ``_`` first so that ``\\b`` agrees between
    Java and RE2; matches only ever contain ASCII letters and whitespace, so
    the mapping never changes a returned term.
    """
    return F.array_distinct(extract_all(map_accents(c), CAPITAL_TERM_PATTERN))


def keyword_set(c, keywords=SCHEME_KEYWORDS) -> Column:
    """The keywords occurring as case-insensitive substrings."""
    low = F.lower(col_of(c))
    kws = F.array(*[F.lit(k) for k in keywords])
    return F.filter(kws, lambda k: F.contains(low, F.lower(k)))


def recall(response_set: Column, truth_set: Column) -> Column:
    """|R ∩ T| / max(|T|, 1): an empty truth set scores 0."""
    return F.size(F.array_intersect(response_set, truth_set)) / F.greatest(
        F.size(truth_set), F.lit(1)
    )


def factual_accuracy(response, truth) -> Column:
    """0.5 * number recall + 0.3 * keyword recall + 0.2 * term recall."""
    r, t = col_of(response), col_of(truth)
    return (
        F.lit(WEIGHT_NUMBERS) * recall(number_set(r), number_set(t))
        + F.lit(WEIGHT_KEYWORDS) * recall(keyword_set(r), keyword_set(t))
        + F.lit(WEIGHT_TERMS) * recall(capital_term_set(r), capital_term_set(t))
    )


def factual_from_sets(r_num, r_kw, r_term, t_num, t_kw, t_term) -> Column:
    """E4 over precomputed sets (compute each text's sets once, then join)."""
    return (
        F.lit(WEIGHT_NUMBERS) * recall(col_of(r_num), col_of(t_num))
        + F.lit(WEIGHT_KEYWORDS) * recall(col_of(r_kw), col_of(t_kw))
        + F.lit(WEIGHT_TERMS) * recall(col_of(r_term), col_of(t_term))
    )


def cosine(a, b) -> Column:
    """E5: cosine of two dense vectors (cast to DOUBLE); 0.0 when either norm
    is zero, a length differs or a side is null."""
    a = col_of(a).cast("array<double>")
    b = col_of(b).cast("array<double>")
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    na = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v))
    nb = F.sqrt(F.aggregate(b, F.lit(0.0), lambda s, v: s + v * v))
    ok = (F.size(a) == F.size(b)) & (na > 0) & (nb > 0)
    return F.coalesce(F.when(ok, dot / (na * nb)), F.lit(0.0))


def average_score(fa, rel, bleu) -> Column:
    """Plain mean of the three metrics."""
    return (col_of(fa) + col_of(rel) + col_of(bleu)) / F.lit(3.0)
