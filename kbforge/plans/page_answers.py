"""Registered query: pages to answers (P1-P13, G1, R6-R8, A1-A6 in a chain)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kbforge.functions.answers import WEB_BOLD_TERMS
from kbforge.operators.answers import answer_requests
from kbforge.operators.postings import postings_topk
from kbforge.plans import sqlparts as S
from kbforge.plans.index_build import page_index_for
from kbforge.plans.ingest_queries import _SCRAPED_SQL
from kbforge.plans.registry import register, table

_ANSWERS_SQL = (
    _SCRAPED_SQL
    + """,
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_id DESC) AS rn FROM sc) WHERE rn = 1),
pdocs AS (SELECT page_id, doc_id, url, title, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1) AS category,
       '# ' || title || chr(10) || 'Source: ' || url || chr(10)
       || CASE WHEN description <> '' THEN 'Description: ' || description || chr(10) ELSE '' END
       || CASE WHEN main_content <> '' THEN chr(10) || '## Main Content' || chr(10) || main_content || chr(10) ELSE '' END AS text
FROM latest),"""
    + S.units_cte(source="pdocs")
    + S.lexical_cte(3)
    + f""",
ev AS (SELECT lex.*, u.n_tokens, u.doc_id, u.text FROM lex JOIN units u USING (unit_id)),
cut AS (SELECT *, sum(greatest(n_tokens, 1)) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM ev),
src AS (SELECT query_id, doc_id, min(rank) AS r FROM cut WHERE used <= 8000 GROUP BY ALL),
sources AS (SELECT query_id, count(*) AS n_sources, string_agg(title || ' (' || url || ', ' || category || ')', chr(10) ORDER BY r) AS sources
            FROM src JOIN pdocs USING (doc_id) GROUP BY query_id),
resp AS (SELECT query_id, count(*) AS n_units, sum(n_tokens) AS n_tokens, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS response
         FROM cut WHERE used <= 8000 GROUP BY query_id),
shown AS (SELECT *, CASE WHEN length(response) > 1000 THEN left(response, 1000) || '... (truncated)' ELSE response END AS short FROM resp)
SELECT query_id, CAST(n_units AS INTEGER) AS n_units, CAST(n_sources AS INTEGER) AS n_sources, CAST(n_tokens AS BIGINT) AS n_tokens,
       {S.bold_web(S.bullets_spacing('response', '• '), WEB_BOLD_TERMS)} AS formatted,
       '```' || chr(10) || short || chr(10) || '```' AS context, sources
FROM shown JOIN sources USING (query_id)"""
)


@register("answer_requests", _ANSWERS_SQL)
def q_answer_requests(spark, sf_dir):
    """Every benchmark question answered from the pages: pages are parsed,
    composed, chunked and indexed; the three best units are packed into 8,000
    tokens, attributed to address, title and host, and shaped for display."""
    index, units, documents = page_index_for(spark, sf_dir)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    hits = postings_topk(asked, index, k=3, carry=("doc_id", "n_tokens"))
    out = answer_requests(hits, units, documents, budget=8000)
    line = F.transform("sources", lambda s: F.concat(s["title"], F.lit(" ("), s["url"], F.lit(", "), s["category"], F.lit(")")))
    return out.withColumn("sources", F.array_join(line, "\n"))
