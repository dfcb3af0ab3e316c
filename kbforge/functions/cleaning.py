"""Ordered regex clean-ups of scraped text.

Each rule is one native ``regexp_replace``; the order is part of the
semantics.  Java needs ``(?d)`` so that ``.`` and ``$`` treat only ``\\n`` as a
line end, as Python does; the DuckDB oracle uses the same patterns without it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kbforge.functions.text import col_of, once, strip_ws

# Structured-page clean rules, applied in this order, then strip.
STRUCTURED_RULES = (
    (r"(?is)### Cookies used by Google Analytics.*?Close\s*", ""),
    (r"(?is)## Cookies on.*?Manage my preferences\s*", ""),
    (r"(?i)(accept all cookies|manage cookies|cookie preferences).*?\n", ""),
    (r"(?i)(skip to main content|skip navigation).*?\n", ""),
    (r"(?is)Allow analytics cookies.*?Close\s*", ""),
    (r"(?s)\[Share to Facebook\].*?\[Print This Page\].*?\n", ""),
    (r"\[Back to top\].*?\n", ""),
    (r"(?m)\n\d+\.\d+\s*$", ""),
    (r"(?s)## Manage\s*\nManage preferences\s*$", ""),
    (r"\[\s*\n#", "# "),
    (r"\n\s*\n\s*\n", "\n\n"),
    (r"[ \t]+", " "),
)

# Markdown clean rules, applied in this order, then strip.  The
# first one is the lookahead-free form of "remove from the start up to the
# first 'Service'".  The third can never fire after the second; kept as is.
MARKDOWN_RULES = (
    (r"(?s)^A notice about cookies.*?Service", "Service"),
    (r"(?s)Manage cookie preferences.*$", ""),
    (r"(?s)### Manage cookie preferences.*$", ""),
    (r"(?s)Cookie preferences.*?Close\s*$", ""),
    (r"\n\s*\n\s*\n", "\n\n"),
)


def java_pattern(p: str) -> str:
    """Add UNIX_LINES so Java's ``.`` and ``$`` match Python's and RE2's."""
    if p.startswith("(?"):
        return "(?d" + p[2:]
    return "(?d)" + p


def _apply(c, rules) -> Column:
    out = col_of(c)
    for pattern, repl in rules:
        out = F.regexp_replace(out, java_pattern(pattern), repl)
    return strip_ws(out)


def clean_structured(c) -> Column:
    """Clean text of a structured page (NULL/empty stays empty)."""
    return once(c, lambda t: F.when(F.coalesce(t, F.lit("")) == "", F.lit("")).otherwise(_apply(t, STRUCTURED_RULES)))


def clean_markdown(c) -> Column:
    """Clean scraped markdown."""
    return _apply(c, MARKDOWN_RULES)
