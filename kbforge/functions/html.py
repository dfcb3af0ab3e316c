"""Native column expressions over raw HTML.

The page is processed as text with regular expressions inside the JVM, so a
page table of any size streams through whole-stage codegen without a Python
worker.  The regex form covers the markup of ordinary pages: comments,
script/style/nav/footer/header blocks, a region tag that may be unclosed,
inline tags and character entities.  Table cells need real parsing; that is
done in ``kbforge.operators.html_tables``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kbforge.functions.text import col_of, once, strip_ws

# The blocks the main-text extraction drops, the region tags in
# priority order, the entity table (``&amp;`` last so "&amp;lt;" stays "&lt;"),
# and the title filter terms with its length exception.
DROPPED_BLOCKS = ("script", "style", "nav", "footer", "header")
REGION_TAGS = ("main", "article", "body")
ENTITIES = (
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&copy;", "©"),
    ("&middot;", "·"),
    ("&amp;", "&"),
)
UNWANTED_TITLE_TERMS = ("cookies", "analytics", "citizensinformation.ie", "home")
TITLE_LONG_ENOUGH = 20
NO_TITLE = "No title"


def decode_entities(c) -> Column:
    out = col_of(c)
    for ent, ch in ENTITIES:
        out = F.replace(out, F.lit(ent), F.lit(ch))
    return out


def drop_blocks(html) -> Column:
    """Remove comments and the dropped blocks with their content."""
    out = F.regexp_replace(col_of(html), r"(?s)<!--.*?-->", "")
    for tag in DROPPED_BLOCKS:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    return out


def region(html) -> Column:
    """Content of the first ``main``, else ``article``, else ``body`` element
    (an unclosed one runs to the end), else the whole page."""

    def chosen(h):
        out = h
        for tag in reversed(REGION_TAGS):
            inner = F.regexp_extract(h, rf"(?is)<{tag}\b[^>]*>(.*?)(?:</{tag}\s*>|$)", 1)
            out = F.when(h.rlike(rf"(?i)<{tag}\b"), inner).otherwise(out)
        return out

    return once(html, chosen)


# A tag, in which ``>`` may stand inside quotes; one whose quotes don't close
# ends at its first ``>``.
TAG_PATTERN = r"""<(?:[^>"']++|"[^"]*+"|'[^']*+')*+>|<[^>]*+>"""
# Stands where a tag was: a text piece keeps its own line breaks.
PIECE_BREAK = "\u0001"


def text_lines(fragment, sep: str) -> Column:
    """Text of an HTML fragment: every tag ends a text piece, entities are
    decoded, pieces are stripped, empty ones dropped, the rest joined."""
    marked = F.regexp_replace(F.translate(col_of(fragment), PIECE_BREAK, ""), TAG_PATTERN, PIECE_BREAK)
    stripped = F.transform(F.split(decode_entities(marked), PIECE_BREAK), strip_ws)
    return F.array_join(F.filter(stripped, lambda p: p != ""), sep)


def main_text(html) -> Column:
    """Boilerplate-free main text, one text piece per line."""
    return text_lines(region(drop_blocks(html)), "\n")


def first_element_text(html, tag: str) -> Column:
    """Stripped text of the first ``<tag>`` element, pieces joined without a
    separator; NULL when the page has no such element."""
    h = col_of(html)
    inner = F.regexp_extract(h, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1)
    return F.when(h.rlike(rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>"), text_lines(inner, ""))


def page_title(html) -> Column:
    """P5: ``<title>`` then ``<h1>``; the first candidate without an unwanted
    term, or longer than 20 characters, wins; else the first non-empty
    candidate; else ``No title``."""
    return choose_title(first_element_text(html, "title"), first_element_text(html, "h1"))


def choose_title(title: Column, heading: Column) -> Column:
    """P5 over the texts of the title and the first heading."""
    terms = F.array(*[F.lit(t) for t in UNWANTED_TITLE_TERMS])

    def acceptable(t):
        clean = ~F.exists(terms, lambda u: F.contains(F.lower(t), u))
        return t.isNotNull() & (F.length(t) > 0) & (clean | (F.length(t) > TITLE_LONG_ENOUGH))

    def first(cands):
        good = F.filter(cands, acceptable)
        non_empty = F.filter(cands, lambda t: t.isNotNull() & (F.length(strip_ws(t)) > 0))
        return F.coalesce(F.get(good, 0), F.get(non_empty, 0), F.lit(NO_TITLE))

    return once(F.array(title, heading), first)


def meta_description(html) -> Column:
    """``content`` of ``<meta name="description">``; ``''`` when absent."""
    tag = F.regexp_extract(col_of(html), r"""(?is)(<meta\b[^>]*\bname\s*=\s*["']description["'][^>]*>)""", 1)
    content = F.regexp_extract(tag, r"""(?is)\bcontent\s*=\s*["']([^"']*)["']""", 1)
    return decode_entities(content)
