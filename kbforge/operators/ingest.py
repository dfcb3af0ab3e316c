"""Page ingestion: pages -> cleaned documents with metadata (P1-P7, P13, P14,
S5, S10).

Everything except table-cell parsing is a native column expression, so the
whole page table is processed in one narrow scan stage; the only shuffles are
the per-page gather of extracted tables (pages that have tables only) and
the latest-wins reduction of S5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbforge.functions.cleaning import clean_structured
from kbforge.functions.html import main_text, meta_description, page_title
from kbforge.functions.text import col_of, strip_ws


def doc_key(url) -> Column:
    """Document id = first 12 hex digits of md5(url)."""
    return F.substring(F.md5(col_of(url)), 1, 12)


def is_failed(html) -> Column:
    """A page without any HTML yields no document."""
    return F.coalesce(strip_ws(col_of(html)), F.lit("")) == ""


def split_failed(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages to ingest, rejected pages with a reason)."""
    bad = is_failed("html")
    return pages.where(~bad), pages.where(bad).select("page_id", "url", F.lit("empty html").alias("reason"))


def scrape(pages: DataFrame, table_counts: DataFrame | None = None) -> DataFrame:
    """P2-P7 for every page: ``page_id, url, doc_id, main_content, metadata``.

    ``metadata`` is ``struct(url, title, description, num_tables,
    content_length)``; ``content_length`` counts characters of the cleaned
    text.  ``table_counts`` (``page_id, num_tables``) comes from the table
    extraction; pages absent from it have no table.
    """
    ok, _ = split_failed(pages)
    out = ok.select(
        "page_id",
        "url",
        doc_key("url").alias("doc_id"),
        clean_structured(main_text("html")).alias("main_content"),
        page_title("html").alias("title"),
        meta_description("html").alias("description"),
    )
    if table_counts is not None:
        out = out.join(table_counts, "page_id", "left")
    else:
        out = out.withColumn("num_tables", F.lit(None).cast("int"))
    out = out.withColumn("num_tables", F.coalesce(F.col("num_tables").cast("int"), F.lit(0)))
    meta = F.struct(
        F.col("url"),
        F.col("title"),
        F.col("description"),
        F.col("num_tables"),
        F.length("main_content").cast("int").alias("content_length"),
    )
    return out.select("page_id", "url", "doc_id", "main_content", meta.alias("metadata"))


def compose_document(scraped: DataFrame, table_sections: DataFrame | None = None, carry=()) -> DataFrame:
    """One text per page: header, source, optional description, main
    content and (when present) the per-table sections, joined by newlines.

    ``table_sections`` holds ``page_id, tables_text`` (already joined
    sections, see ``kbforge.operators.html_tables.table_sections``); pages of
    ``scrape_parsed`` carry that column themselves.  Columns named in ``carry``
    stay beside the text.
    """
    df = scraped
    if table_sections is not None:
        df = df.join(table_sections, "page_id", "left")
    elif "tables_text" not in df.columns:
        df = df.withColumn("tables_text", F.lit(None).cast("string"))
    m = F.col("metadata")
    header = F.concat_ws(
        "\n",
        F.concat(F.lit("# "), m["title"]),
        F.concat(F.lit("Source: "), m["url"]),
        F.when(m["description"] != "", F.concat(F.lit("Description: "), m["description"])),
        F.lit(""),
    )
    body = F.when(
        F.col("main_content") != "",
        F.concat(F.lit("\n## Main Content\n"), F.col("main_content"), F.lit("\n")),
    ).otherwise(F.lit(""))
    tables = F.when(
        F.col("tables_text").isNotNull(),
        F.concat(F.lit("\n## Structured Data (Tables)\n\n"), F.col("tables_text")),
    ).otherwise(F.lit(""))
    return df.select("page_id", "doc_id", "url", F.concat(header, body, tables).alias("text"), *carry)


def host_catalog(pages: DataFrame) -> DataFrame:
    """S10 over pages: per host, number of pages and of distinct URLs.

    ``count_distinct`` is planned as a two-level aggregate (host, url) then
    host, both with map-side partial steps, so a host with a third of all
    pages is reduced before the shuffle.
    """
    host = F.parse_url(F.col("url"), F.lit("HOST"))
    return pages.select(host.alias("host"), "url").groupBy("host").agg(
        F.count(F.lit(1)).alias("n_pages"), F.countDistinct("url").alias("n_urls")
    )


def source_catalog(spark, entries) -> DataFrame:
    """S10 literal form: a dimension table ``(category, title, url)`` built
    from user-supplied entries (small by construction)."""
    return spark.createDataFrame(list(entries), "category string, title string, url string")
