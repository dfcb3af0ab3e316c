"""Registered queries: page ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F

from kbforge.functions.cleaning import clean_markdown, clean_structured
from kbforge.functions.html import choose_title, main_text, page_title
from kbforge.operators.html_tables import extract_tables, table_sections
from kbforge.operators.ingest import compose_document, doc_key, host_catalog, scrape, split_failed
from kbforge.operators.page_parse import parse_pages, scrape_parsed
from kbforge.plans import sqlparts as S
from kbforge.plans.registry import register, table
from kbforge.sources.writers import latest_by_key


@register("doc_id", "SELECT page_id, url, substring(md5(url), 1, 12) AS doc_id FROM pages")
def q_doc_id(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url", doc_key("url").alias("doc_id"))


@register("main_text", f"SELECT page_id, {S.main_text('html')} AS main_text FROM pages")
def q_main_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", main_text("html").alias("main_text"))


# The driver documents hold no boilerplate, so both clean-up queries first
# wrap every text in lines that the rules remove (same wrapping in the SQL).
STRUCTURED_HEAD = "Skip to main content\nAccept all cookies to continue\n[\n# Heading\n"
STRUCTURED_TAIL = "\n\n\n\n[Back to top] of page\n3.14\n## Manage  \nManage preferences\n"
MARKDOWN_HEAD = "A notice about cookies\nWe use them.\n"
MARKDOWN_TAIL = "\n\n\n\nManage cookie preferences\nAll of them\n"


def _sql_str(s: str) -> str:
    """A Python string (no quotes inside) as a DuckDB expression."""
    return " || chr(10) || ".join(f"'{part}'" for part in s.split("\n"))


@register(
    "clean_text",
    f"SELECT doc_id, {S.clean_structured(f'({_sql_str(STRUCTURED_HEAD)} || text || {_sql_str(STRUCTURED_TAIL)})')} AS clean_text FROM documents",
)
def q_clean_text(spark, sf_dir):
    wrapped = F.concat(F.lit(STRUCTURED_HEAD), F.col("text"), F.lit(STRUCTURED_TAIL))
    return table(spark, sf_dir, "documents").select("doc_id", clean_structured(wrapped).alias("clean_text"))


@register(
    "clean_markdown",
    f"SELECT doc_id, {S.clean_markdown(f'({_sql_str(MARKDOWN_HEAD)} || ' + chr(39) + 'Service' + chr(39) + f' || text || {_sql_str(MARKDOWN_TAIL)})')} AS clean_markdown FROM documents",
)
def q_clean_markdown(spark, sf_dir):
    wrapped = F.concat(F.lit(MARKDOWN_HEAD), F.lit("Service"), F.col("text"), F.lit(MARKDOWN_TAIL))
    return table(spark, sf_dir, "documents").select("doc_id", clean_markdown(wrapped).alias("clean_markdown"))


@register("page_title", f"SELECT page_id, {S.page_title('html')} AS title FROM pages")
def q_page_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", page_title("html").alias("title"))


def _scraped(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    tables = extract_tables(pages)
    sections = table_sections(tables)
    return scrape(pages, sections.select("page_id", "num_tables")), sections


_SCRAPED_SQL = rf"""WITH ok AS (SELECT * FROM pages WHERE coalesce(regexp_replace(html, '^\s+|\s+$', '', 'g'), '') <> ''),
sc AS (SELECT page_id, url, substring(md5(url), 1, 12) AS doc_id,
              {S.clean_structured(S.main_text('html'))} AS main_content,
              {S.page_title('html')} AS title, {S.meta_description('html')} AS description,
              CAST(0 AS INTEGER) AS num_tables FROM ok)"""


@register(
    "page_metadata",
    _SCRAPED_SQL
    + "\nSELECT page_id, url, title, description, num_tables, CAST(length(main_content) AS INTEGER) AS content_length FROM sc",
)
def q_page_metadata(spark, sf_dir):
    """P7 (flattened)."""
    sc, _ = _scraped(spark, sf_dir)
    return sc.select("page_id", "metadata.*")


@register(
    "compose_document",
    _SCRAPED_SQL
    + """
SELECT page_id, doc_id, url,
       '# ' || title || chr(10) || 'Source: ' || url || chr(10)
       || CASE WHEN description <> '' THEN 'Description: ' || description || chr(10) ELSE '' END
       || CASE WHEN main_content <> '' THEN chr(10) || '## Main Content' || chr(10) || main_content || chr(10) ELSE '' END AS text
FROM sc""",
)
def q_compose_document(spark, sf_dir):
    """P13 (+ P8-P12 for pages with tables)."""
    sc, sections = _scraped(spark, sf_dir)
    return compose_document(sc, sections.select("page_id", "tables_text"))


@register(
    "latest_document",
    _SCRAPED_SQL
    + """,
docs AS (SELECT doc_id, page_id, url, length(main_content) AS n_chars FROM sc),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_id DESC) AS rn FROM docs)
SELECT doc_id, page_id, url, CAST(n_chars AS INTEGER) AS n_chars FROM r WHERE rn = 1""",
)
def q_latest_document(spark, sf_dir):
    """One document per key, the latest page version wins."""
    sc, _ = _scraped(spark, sf_dir)
    docs = sc.select("doc_id", "page_id", "url", F.length("main_content").cast("int").alias("n_chars"))
    return latest_by_key(docs, "doc_id", "page_id")


@register(
    "failed_pages",
    r"""SELECT page_id, url, 'empty html' AS reason FROM pages
WHERE coalesce(regexp_replace(html, '^\s+|\s+$', '', 'g'), '') = ''""",
)
def q_failed_pages(spark, sf_dir):
    """Pages that yield no document."""
    _, rejected = split_failed(table(spark, sf_dir, "pages"))
    return rejected


@register(
    "host_catalog",
    """SELECT regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1) AS host, count(*) AS n_pages,
       count(DISTINCT url) AS n_urls FROM pages GROUP BY 1""",
)
def q_host_catalog(spark, sf_dir):
    return host_catalog(table(spark, sf_dir, "pages"))


# ---- P10-P12 re-aimed as profiles of driver tables -----------------------------
# (table, key) pairs profiled by the three queries.
PROFILED = (("region", "r_regionkey"), ("nation", "n_nationkey"), ("customer", "c_custkey"), ("part", "p_partkey"))
_COLS = {
    "region": (["r_regionkey", "r_name"], ["r_regionkey"]),
    "nation": (["n_nationkey", "n_name", "n_regionkey"], ["n_nationkey", "n_regionkey"]),
    "customer": (["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], ["c_custkey", "c_nationkey", "c_acctbal"]),
    "part": (["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"], ["p_partkey", "p_size", "p_retailprice"]),
}


def _union(frames):
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@register("table_profile", "\nUNION ALL\n".join(S.profile_sql(t, *_COLS[t], k) for t, k in PROFILED))
def q_table_profile(spark, sf_dir):
    """P10 re-aimed: summary text of whole driver tables."""
    from kbforge.operators.profile import table_profile

    return _union([table_profile(table(spark, sf_dir, t).select(*_COLS[t][0]), k, t) for t, k in PROFILED])


@register("row_narrative", "\nUNION ALL\n".join(S.narrative_sql(t, _COLS[t][0], k) for t, k in PROFILED))
def q_row_narrative(spark, sf_dir):
    """P11 re-aimed: first-10-rows narrative of whole driver tables."""
    from kbforge.operators.profile import row_narrative

    return _union([row_narrative(table(spark, sf_dir, t).select(*_COLS[t][0]), k, t) for t, k in PROFILED])


@register("markdown_table", "\nUNION ALL\n".join(S.markdown_sql(t, _COLS[t][0], k) for t, k in PROFILED))
def q_markdown_table(spark, sf_dir):
    """P12 re-aimed: markdown of tables with at most 20 rows, else the size line."""
    from kbforge.operators.profile import markdown_table

    return _union([markdown_table(table(spark, sf_dir, t).select(*_COLS[t][0]), k, t) for t, k in PROFILED])


@register("extracted_tables")
def q_extracted_tables(spark, sf_dir):
    """P8-P10 + S6 records for every table of every page (the driver pages
    hold no <table>, so this is empty there; fixtures cover the rules)."""
    from kbforge.operators.html_tables import table_records

    pages = table(spark, sf_dir, "pages")
    return table_records(extract_tables(pages), pages)


# ---- pages parsed once -----------------------------------------------------------
# The driver pages hold plain markup and no table.  These queries put each one
# between markup that needs a parser: references by name and number, quoted
# signs in attributes, nested dropped blocks, unclosed elements, a table with
# left-out end tags and a span.
WRAP_HEAD = (
    '<head><meta name="description" content="It\'s 5 &gt; 3 &amp; caf&eacute;s &mdash; <b>open</b>">'
    "<title>Guide &#8211; &euro;&nbsp;rates &#x26; caf&eacute;s</title></head>"
    "<main><nav>menu <nav>inner</nav> rest of it</nav><p>R&eacute;sum&eacute; &hellip; 3 < 4 &frac12;<p>A <b>bold<i> and</b> open"
)
WRAP_TABLE = "<h2>Where it is</h2><table><caption>All&nbsp;sites</caption><tr><th>Page<th>Address<tr><td>"
WRAP_TAIL = (
    "<tr><td>0<td>&mdash;<tr><td colspan=2>7</table>"
    "<header>old <header>head</header> gone</header>last &quot;words&quot;</main><footer>x</footer>"
)


def wrapped_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    address = F.replace(F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    html = F.concat(
        F.lit(WRAP_HEAD), F.col("html"), F.lit(WRAP_TABLE), F.col("page_id").cast("string"), F.lit("<td>"), address, F.lit(WRAP_TAIL)
    )
    return pages.select("page_id", "url", html.alias("html"))


_INNER_SQL = S.text_lines(S.drop_blocks("html"), S.NL)
_PARSED_SQL = f"""WITH wp AS (SELECT page_id, url, {_INNER_SQL} AS inner_text, CAST(page_id AS VARCHAR) AS pid,
  {S.strip('url')} AS address FROM pages),
pp AS (SELECT *, 'Guide – €' || chr(160) || 'rates & cafés' AS title, 'It''s 5 > 3 & cafés — <b>open</b>' AS description,
  'All' || chr(160) || 'sites' AS caption,
  array_to_string(['Résumé … 3 < 4 ½', 'A', 'bold', 'and', 'open'], chr(10)) || chr(10)
  || CASE WHEN inner_text = '' THEN '' ELSE inner_text || chr(10) END
  || array_to_string(['Where it is', 'All' || chr(160) || 'sites', 'Page', 'Address', pid, address, '0', '—', '7', 'last "words"'], chr(10)) AS main_text
  FROM wp)"""
_SECTION_SQL = """'### Table 1: Section: Where it is | Caption: ' || caption || chr(10)
  || '**Summary**: Table with 3 rows and 2 columns. Columns: Page, Address. Numeric data in: Page. Example row - Page: '
  || pid || ', Address: ' || address || chr(10) || chr(10) || '**Table Data Analysis:**' || chr(10)
  || 'Entry 1: Page is ' || pid || ', Address is ' || address || '. Entry 2: Page is 0, Address is —. Entry 3: Page is 7, Address is 7. '
  || chr(10) || 'This table shows relationships between: Page, Address' || chr(10) || chr(10) || '**Formatted Table:**' || chr(10)
  || '| Page | Address |' || chr(10) || '|---|---|' || chr(10) || '| ' || pid || ' | ' || address || ' |' || chr(10)
  || '| 0 | — |' || chr(10) || '| 7 | 7 |' || chr(10)"""


@register(
    "parsed_pages",
    _PARSED_SQL + "\nSELECT page_id, url, title, description, main_text, CAST(1 AS INTEGER) AS n_tables FROM pp",
)
def q_parsed_pages(spark, sf_dir):
    """P2, P5, P6, P8 of wrapped pages, each parsed once."""
    return parse_pages(wrapped_pages(spark, sf_dir)).select(
        "page_id", "url", choose_title(F.col("title_text"), F.col("heading_text")).alias("title"), "description", "main_text", "n_tables"
    )


@register(
    "parsed_tables",
    _PARSED_SQL
    + """
SELECT page_id, t.row_no, 'Section: Where it is | Caption: ' || caption AS context, t.cells FROM (
  SELECT page_id, caption, unnest([{'row_no': 0, 'cells': 'Page | Address'}, {'row_no': 1, 'cells': pid || ' | ' || address},
         {'row_no': 2, 'cells': '0 | —'}, {'row_no': 3, 'cells': '7 | 7'}]) AS t FROM pp)""",
)
def q_parsed_tables(spark, sf_dir):
    """The tables of wrapped pages, one row per line of a table (the
    column names are line 0)."""
    tables = parse_pages(wrapped_pages(spark, sf_dir)).select("page_id", F.explode("tables").alias("t"))
    lines = F.transform(F.concat(F.array("t.columns"), F.col("t.rows")), lambda r: F.array_join(r, " | "))
    return tables.select("page_id", F.col("t.context").alias("context"), F.posexplode(lines).alias("row_no", "cells"))


@register(
    "parsed_documents",
    _PARSED_SQL
    + f""",
cl AS (SELECT *, {S.clean_structured('main_text')} AS main_content FROM pp)
SELECT page_id, substring(md5(url), 1, 12) AS doc_id, url,
       '# ' || title || chr(10) || 'Source: ' || url || chr(10) || 'Description: ' || description || chr(10)
       || chr(10) || '## Main Content' || chr(10) || main_content || chr(10)
       || chr(10) || '## Structured Data (Tables)' || chr(10) || chr(10) || {_SECTION_SQL} AS text FROM cl""",
)
def q_parsed_documents(spark, sf_dir):
    """P2-P13 of wrapped pages in one pass, tables included, without a shuffle."""
    return compose_document(scrape_parsed(wrapped_pages(spark, sf_dir)))
