"""Pages parsed once: main text, title, description and tables.

``kbforge.functions.html`` reads ordinary markup with patterns, inside the JVM.
Here each page goes through one tokenizer that keeps a stack of open elements:
all character references are decoded, nested blocks end at their own end tag,
attribute values may hold any quoted sign, unclosed elements end with their
parent.  What is found about a page, its tables included, stays in the page's
row, so the sections of its tables need no shuffle.

Pages pass in Arrow batches whose bytes are bounded; a task holds one batch and
the tree of one page.

Defined results: a null or empty page has no title, no heading, an empty text
and no tables; an element that occurs several times counts once, the first in
the document; further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbforge.functions.cleaning import clean_structured
from kbforge.functions.html import DROPPED_BLOCKS, REGION_TAGS, choose_title
from kbforge.operators.html_tables import element_text, page_tree, section_text, tables_of, walk
from kbforge.operators.ingest import doc_key, split_failed
from kbforge.session import bounded_batches

_TABLE = pa.struct(
    [
        ("table_index", pa.int32()),
        ("context", pa.string()),
        ("columns", pa.list_(pa.string())),
        ("rows", pa.list_(pa.list_(pa.string()))),
    ]
)
_FOUND = {
    "title_text": pa.string(),
    "heading_text": pa.string(),
    "description": pa.string(),
    "main_text": pa.string(),
    "n_tables": pa.int32(),
    "tables": pa.list_(_TABLE),
}
_FOUND_DDL = (
    "title_text string, heading_text string, description string, main_text string, n_tables int, "
    "tables array<struct<table_index: int, context: string, columns: array<string>, rows: array<array<string>>>>"
)


def parse_page(html: str | None) -> dict:
    """What one page holds, by the names of the parsed columns."""
    page = page_tree(html or "")
    first: dict = {}
    description = None
    for e in page.elements:
        if e.tag in ("title", "h1"):
            first.setdefault(e.tag, e)
        elif e.tag == "meta" and description is None and e.attrs.get("name") == "description":
            description = e.attrs.get("content") or ""
    # The region is looked for outside the dropped blocks.
    regions: dict = {}
    for e in walk(page.root, DROPPED_BLOCKS):
        if not isinstance(e, str) and e.tag in REGION_TAGS:
            regions.setdefault(e.tag, e)
    region = next((regions[tag] for tag in REGION_TAGS if tag in regions), page.root)
    n_tables, tables = tables_of(page)
    return {
        "title_text": element_text(first["title"]) if "title" in first else None,
        "heading_text": element_text(first["h1"]) if "h1" in first else None,
        "description": description or "",
        "main_text": element_text(region, "\n", DROPPED_BLOCKS),
        "n_tables": n_tables,
        "tables": [dict(zip(("table_index", "context", "columns", "rows"), t, strict=True)) for t in tables],
    }


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [parse_page(html) for html in batch.column("html").to_pylist()]
        columns = [batch.column("page_id"), batch.column("url")]
        columns += [pa.array([f[name] for f in found], kind) for name, kind in _FOUND.items()]
        yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", *_FOUND])


def parse_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url`` and the parsed columns of ``pages(page_id, url, html)``,
    one row a page.  ``n_tables`` counts all table elements, ``tables`` holds
    those that have rows."""
    bounded_batches(pages.sparkSession)
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_parse_batches, f"page_id {kind}, url string, {_FOUND_DDL}")


def sections_of(tables: Column) -> Column:
    """The joined sections of a page's tables; NULL without tables."""
    sections = F.transform(tables, lambda t, i: section_text(i + 1, t["context"], t["columns"], t["rows"]))
    return F.when(F.size(tables) > 0, F.array_join(sections, "\n"))


def scrape_parsed(pages: DataFrame) -> DataFrame:
    """P2-P9 in one pass: ``page_id, url, doc_id, main_content, metadata,
    tables, tables_text`` of every page that has any HTML, in the form that
    ``compose_document`` takes."""
    parsed = parse_pages(split_failed(pages)[0])
    parsed = parsed.withColumn("main_content", clean_structured(F.col("main_text")))
    meta = F.struct(
        F.col("url"),
        choose_title(F.col("title_text"), F.col("heading_text")).alias("title"),
        F.col("description"),
        F.size("tables").alias("num_tables"),
        F.length("main_content").cast("int").alias("content_length"),
    )
    return parsed.select(
        "page_id",
        "url",
        doc_key("url").alias("doc_id"),
        "main_content",
        meta.alias("metadata"),
        "tables",
        sections_of(F.col("tables")).alias("tables_text"),
    )
