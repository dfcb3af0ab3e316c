"""Answer and context shaping (A1-A6) as native column expressions.

Two display styles exist and differ; ``style="web"`` and ``style="ui"``
select them.  Java regexes get ``(?d)`` (only ``\\n`` ends a line, as in
Python) and ``(?u)`` (Unicode case folding, as Python's IGNORECASE).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kbforge.functions.text import col_of, strip_ws

# Fixed values of the two styles.
BULLET_PATTERN = r"(?dm)^[•·\-*]\s+"
WEB_BULLET, UI_BULLET = "• ", "- "
WEB_BOLD_TERMS = ("Cost Rental", "Housing Agency", "Local Authority", "Dublin", "Ireland", "Government", "Citizen")
UI_BOLD_TERMS = ("Cost Rental", "Housing Agency", "Local Authority", "Dublin", "Ireland")
SENTENCES_PER_PARAGRAPH = 3
NO_CONTEXT = "No context data available"
CONTEXT_LIMIT = 1000
TRUNCATED = "... (truncated)"


def _bullets_and_spacing(c, bullet: str) -> Column:
    s = F.regexp_replace(strip_ws(c), BULLET_PATTERN, bullet)
    return F.regexp_replace(s, r"\n\n+", "\n\n")


def bold_terms_web(c) -> Column:
    """Each term in list order, case-insensitive, rewritten to its
    canonical spelling in bold."""
    out = col_of(c)
    for term in WEB_BOLD_TERMS:
        out = F.regexp_replace(out, rf"(?iu)\b({term})\b", f"**{term}**")
    return out


def bold_terms_ui(c) -> Column:
    """The five terms, case-sensitive, matched text kept, in bold."""
    alt = "|".join(UI_BOLD_TERMS)
    return F.regexp_replace(col_of(c), rf"\b({alt})\b", "**$1**")


def regroup_paragraphs(c) -> Column:
    """A4: split on '. '; with 4 or more pieces, groups of three pieces form
    paragraphs; a full group gets a closing '.', the last partial group does
    not; paragraphs are separated by a blank line."""
    return regroup_parts(split_sentences(c), c)


def split_sentences(c) -> Column:
    return F.split(col_of(c), r"\. ", -1)


def regroup_parts(parts, original) -> Column:
    """A4 over already split pieces (pass a column reference for ``parts``
    so the lambda does not re-split the text for every paragraph)."""
    parts = col_of(parts)
    n = F.size(parts)
    starts = F.sequence(F.lit(0), n - 1, F.lit(SENTENCES_PER_PARAGRAPH))

    def para(i):
        group = F.slice(parts, i + 1, SENTENCES_PER_PARAGRAPH)
        joined = F.array_join(group, ". ")
        return F.when(F.size(group) == SENTENCES_PER_PARAGRAPH, F.concat(joined, F.lit("."))).otherwise(joined)

    return F.when(n > 3, F.array_join(F.transform(starts, para), "\n\n")).otherwise(col_of(original))


def format_answer(c, style: str = "web") -> Column:
    """A1 + A2 + A3 (+ A4 for the UI style).  NULL and empty stay as given.

    For the UI style prefer ``format_answers`` on a DataFrame: A4's lambda
    then reads a materialised column instead of re-running the shaping."""
    c = col_of(c)
    if style == "web":
        shaped = bold_terms_web(_bullets_and_spacing(c, WEB_BULLET))
    elif style == "ui":
        shaped = regroup_paragraphs(bold_terms_ui(_bullets_and_spacing(c, UI_BULLET)))
    else:
        raise ValueError("style must be 'web' or 'ui'")
    return F.when(c.isNull() | (c == ""), c).otherwise(shaped)


def format_answers(df, text_col: str, style: str = "web", out_col: str = "formatted"):
    """DataFrame form of ``format_answer``."""
    c = F.col(text_col)
    if style == "web":
        return df.withColumn(out_col, format_answer(c, "web"))
    if style != "ui":
        raise ValueError("style must be 'web' or 'ui'")
    tmp = df.withColumn("_shaped", bold_terms_ui(_bullets_and_spacing(c, UI_BULLET)))
    tmp = tmp.withColumn("_parts", split_sentences("_shaped"))
    return tmp.withColumn(
        out_col, F.when(c.isNull() | (c == ""), c).otherwise(regroup_parts("_parts", "_shaped"))
    ).drop("_shaped", "_parts")


def truncate_context(c) -> Column:
    """A5: blank -> the no-context message; longer than 1000 characters ->
    the first 1000 plus a truncation mark; otherwise unchanged."""
    c = col_of(c)
    blank = c.isNull() | (strip_ws(c) == "")
    return (
        F.when(blank, F.lit(NO_CONTEXT))
        .when(F.length(c) > CONTEXT_LIMIT, F.concat(F.substring(c, 1, CONTEXT_LIMIT), F.lit(TRUNCATED)))
        .otherwise(c)
    )


def fence_context(c) -> Column:
    """Empty -> the no-context message; text that starts with '[' or '{'
    and parses as JSON -> a ```json fence (the JSON text kept as given);
    anything else -> a plain ``` fence."""
    c = col_of(c)
    looks_json = c.startswith("[") | c.startswith("{")
    is_json = looks_json & F.try_parse_json(c).isNotNull()
    return (
        F.when(c.isNull() | (c == ""), F.lit(NO_CONTEXT))
        .when(is_json, F.concat(F.lit("```json\n"), c, F.lit("\n```")))
        .otherwise(F.concat(F.lit("```\n"), c, F.lit("\n```")))
    )
