"""Registered queries: chunking and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from kbforge.operators.chunking import chunk_documents
from kbforge.operators.postings import postings_topk
from kbforge.operators.retrieval import attribute_sources, pack_context, phrase_search
from kbforge.plans import sqlparts as S
from kbforge.plans.registry import register, table


def units_of(spark, sf_dir):
    return chunk_documents(table(spark, sf_dir, "documents"))


@register("chunk_documents", "WITH" + S.units_cte() + "\nSELECT * FROM units")
def q_chunk_documents(spark, sf_dir):
    return units_of(spark, sf_dir)


def lexical(queries, spark, sf_dir, k, carry=()):
    """Basic search (R6) over the stored postings of the units."""
    from kbforge.plans.index_build import postings_for

    return postings_topk(queries, postings_for(spark, sf_dir), k=k, carry=carry)


def _benchmark_questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")
    )


@register(
    "lexical_topk",
    "WITH" + S.units_cte() + S.lexical_cte(3) + "\nSELECT * FROM lex",
)
def q_lexical_topk(spark, sf_dir):
    return lexical(_benchmark_questions(spark, sf_dir), spark, sf_dir, k=3)


@register(
    "phrase_search",
    "WITH"
    + S.units_cte()
    + r""",
us AS (SELECT unit_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), ' ') || ' ' AS u FROM units),
qs AS (SELECT item_id AS query_id, array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), ' ') AS q FROM benchmark)
SELECT query_id, unit_id FROM qs JOIN us ON contains(u, ' ' || q || ' ') WHERE q <> ''""",
)
def q_phrase_search(spark, sf_dir):
    """Units that hold a whole benchmark question."""
    return phrase_search(_benchmark_questions(spark, sf_dir), units_of(spark, sf_dir))


def search_evidence(spark, sf_dir, k: int = 10, budget: int = 8000):
    """Flagship: lexical top-k units per benchmark question, packed into an
    8000-token context and attributed to their source."""
    # attributes come from the index: no pass over the units' text
    hits = lexical(_benchmark_questions(spark, sf_dir), spark, sf_dir, k, carry=("n_tokens", "doc_id"))
    packed = pack_context(hits, budget=budget)
    return packed.join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")


_CONTEXT_PACK_SQL = (
    "WITH"
    + S.units_cte()
    + S.lexical_cte(10)
    + """,
ev AS (SELECT lex.*, units.n_tokens, units.doc_id FROM lex JOIN units USING (unit_id)),
cut AS (SELECT *, CAST(greatest(n_tokens, 1) AS BIGINT) AS cost,
               CAST(sum(CAST(greatest(n_tokens, 1) AS BIGINT)) OVER (PARTITION BY query_id ORDER BY matched DESC, unit_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum_tokens FROM ev)
SELECT cut.doc_id, unit_id, query_id, matched, score, rank, n_tokens, cost, cum_tokens, d.source
FROM cut JOIN documents d ON d.doc_id = cut.doc_id
WHERE cum_tokens <= 8000"""
)


@register("context_pack", _CONTEXT_PACK_SQL)
def q_context_pack(spark, sf_dir):
    return search_evidence(spark, sf_dir, k=10, budget=8000)


# ---- requests from the conversation log --------------------------------------
# User turns are the questions.  The log has no search type, so one is
# derived from the ids, cycling through valid, mis-cased, padded, missing
# and unknown values to exercise every validation branch.
TYPE_CYCLE = ("global", "local", "basic", " local", "LOCAL", None, "drift")
_TYPE_CYCLE_SQL = "['global', 'local', 'basic', ' local', 'LOCAL', NULL, 'drift']"


def requests_of(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    types = F.array(*[F.lit(t) for t in TYPE_CYCLE])
    return conv.where(F.col("role") == "user").select(
        (F.col("conv_id") * 100000 + F.col("turn")).alias("request_id"),
        F.col("text").alias("query"),
        F.get(types, F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(TYPE_CYCLE))).cast("int")).alias("search_type"),
    )


_REQUESTS_SQL = f"""req AS (SELECT conv_id * 100000 + turn AS request_id, text AS query,
       {_TYPE_CYCLE_SQL}[((conv_id + turn) % 7) + 1] AS search_type FROM conversations WHERE role = 'user')"""


@register(
    "validate_requests",
    "WITH "
    + _REQUESTS_SQL
    + rf""",
v AS (SELECT request_id, {S.strip("coalesce(query, '')")} AS query, lower(coalesce(search_type, 'global')) AS search_type FROM req)
SELECT request_id, query, search_type,
       CASE WHEN query = '' THEN 'Query cannot be empty'
            WHEN search_type NOT IN ('global', 'local', 'basic') THEN 'Invalid search type. Must be: global, local, or basic'
       END AS error FROM v""",
)
def q_validate_requests(spark, sf_dir):
    """R1 over the user turns."""
    from kbforge.operators.retrieval import validate_requests

    return validate_requests(requests_of(spark, sf_dir))


def _index(spark, sf_dir):
    from kbforge.plans.index_build import index_for

    return index_for(spark, sf_dir)


def _basic(spark, sf_dir):
    def run(q):
        return lexical(q, spark, sf_dir, k=3).select(
            "query_id", F.lit("unit").alias("kind"), F.col("unit_id").alias("item_id"), "score"
        )

    return run


def _global(ix):
    from kbforge.operators.retrieval import global_search

    def run(q):
        return global_search(q, ix["community_reports"]).select(
            "query_id", F.lit("report").alias("kind"), F.col("report_id").alias("item_id"), "score"
        )

    return run


def _local(ix):
    from kbforge.operators.retrieval import local_search

    def run(q):
        return local_search(
            q, ix["entities"], ix["relationships"],
            ix["mentions"].withColumnRenamed("entity_id", "name"), ix["text_units"],
            ix["communities"], ix["community_reports"],
        ).select("query_id", "kind", "item_id", "score")

    return run


@register("route_requests")
def q_route_requests(spark, sf_dir):
    """R2: valid requests routed to global / local / basic search."""
    from kbforge.operators.retrieval import route, validate_requests

    ix = _index(spark, sf_dir)
    valid = validate_requests(requests_of(spark, sf_dir))
    return route(valid, {"global": _global(ix), "local": _local(ix), "basic": _basic(spark, sf_dir)})


def _benchmark_q(spark, sf_dir):
    return _benchmark_questions(spark, sf_dir)


@register("global_search")
def q_global_search(spark, sf_dir):
    """Benchmark questions against community reports (level <= 2)."""
    from kbforge.operators.retrieval import global_search

    ix = _index(spark, sf_dir)
    return global_search(_benchmark_q(spark, sf_dir), ix["community_reports"])


@register("local_search")
def q_local_search(spark, sf_dir):
    """Benchmark questions against entities, relationships, units and reports."""
    ix = _index(spark, sf_dir)
    from kbforge.operators.retrieval import local_search

    return local_search(
        _benchmark_q(spark, sf_dir), ix["entities"], ix["relationships"],
        ix["mentions"].withColumnRenamed("entity_id", "name"), ix["text_units"],
        ix["communities"], ix["community_reports"],
    )


@register(
    "vector_topk",
    """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
x AS (SELECT label, unnest(v) AS x, unnest(range(len(v))) AS i FROM e),
c AS (SELECT label, list(ax ORDER BY i) AS centroid FROM (SELECT label, i, avg(x) AS ax FROM x GROUP BY ALL) GROUP BY label),
s AS (SELECT c.label AS query_id, e.vec_id,
             list_sum(list_transform(range(1, len(e.v) + 1), lambda k: e.v[k] * c.centroid[k]))
             / (sqrt(list_sum(list_transform(e.v, lambda a: a * a))) * sqrt(list_sum(list_transform(c.centroid, lambda a: a * a)))) AS score
      FROM c, e),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rn FROM s)
SELECT query_id, vec_id, round(score, 6) AS score, CAST(rn AS INTEGER) AS rank FROM r WHERE rn <= 10""",
)
def q_vector_topk(spark, sf_dir):
    """The 10 nearest vectors (cosine) to each label centroid."""
    from kbforge.operators.retrieval import vector_topk

    emb = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    per_dim = emb.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("ax"))
    centroid = per_dim.groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "ax"))), lambda s: s["ax"]).alias("vector")
    )
    return vector_topk(centroid.withColumnRenamed("label", "query_id"), emb, k=10, item_vec="v")


@register(
    "source_attribution",
    "WITH"
    + S.units_cte()
    + S.lexical_cte(3)
    + """
SELECT lex.query_id, lex.unit_id, lex.rank, u.doc_id, d.source, d.lang
FROM lex JOIN units u USING (unit_id) JOIN documents d ON d.doc_id = u.doc_id""",
)
def q_source_attribution(spark, sf_dir):
    """Each hit attributed to its document's source and language."""
    hits = lexical(_benchmark_questions(spark, sf_dir), spark, sf_dir, k=3, carry=("doc_id",))
    return attribute_sources(
        hits.select("query_id", "unit_id", "rank", "doc_id"), None, table(spark, sf_dir, "documents"), doc_cols=("source", "lang")
    )


@register(
    "dedupe_requests",
    "WITH "
    + _REQUESTS_SQL
    + ","
    + S.units_cte()[1:]
    + f""",
allreq AS (SELECT request_id, query, search_type FROM req UNION ALL SELECT request_id + 50000, query, search_type FROM req),
kq AS (SELECT *, lower(regexp_replace(query, '\\s+', ' ', 'g')) AS query_norm FROM allreq),
dq AS (SELECT query_norm, search_type, min(request_id) AS query_id, min(query) AS query FROM kq GROUP BY query_norm, search_type)"""
    + S.lexical_cte(3, queries="dq", qid="query_id", qtext="query")
    + """
SELECT kq.request_id, lex.query_id, lex.unit_id, lex.rank FROM kq
JOIN dq ON dq.query_norm = kq.query_norm AND dq.search_type IS NOT DISTINCT FROM kq.search_type
JOIN lex ON lex.query_id = dq.query_id""",
)
def q_dedupe_requests(spark, sf_dir):
    """Every request answered, each distinct (query, type) searched once."""
    from kbforge.operators.retrieval import dedupe_requests

    req = requests_of(spark, sf_dir)
    both = req.unionByName(req.withColumn("request_id", F.col("request_id") + 50000))
    distinct, mapping = dedupe_requests(both)
    hits = lexical(distinct.select("query_id", "query"), spark, sf_dir, k=3)
    return mapping.join(hits, "query_id").select("request_id", "query_id", "unit_id", "rank")


# ---- G2 / R5 over text units ---------------------------------------------------


@register(
    "tfidf_weights",
    "WITH"
    + S.units_cte()
    + """,
tf AS (SELECT unit_id AS owner_id, term, count(*) AS tf FROM (
         SELECT unit_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM units) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
n AS (SELECT count(*) AS n FROM units)
SELECT owner_id, term, tf, df, round(ln((1 + n) / (1 + df)) + 1.0, 6) AS idf, round(tf * (ln((1 + n) / (1 + df)) + 1.0), 6) AS weight
FROM tf JOIN df USING (term), n""",
)
def q_tfidf_weights(spark, sf_dir):
    """TF-IDF weight of every (unit, term)."""
    from kbforge.operators.common import rounded
    from kbforge.operators.vectors import term_weights

    w = term_weights(units_of(spark, sf_dir))
    return w.select("owner_id", "term", "tf", "df", rounded("idf").alias("idf"), rounded("weight").alias("weight"))


_VECTOR_SEARCH_SQL = (
    "WITH"
    + S.units_cte()
    + """,
tf AS (SELECT unit_id AS owner_id, term, count(*) AS tf FROM (
         SELECT unit_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM units) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
n AS (SELECT count(*) AS n FROM units),
idf AS (SELECT term, ln((1 + n) / (1 + df)) + 1.0 AS idf FROM df, n),
qtf AS (SELECT item_id AS owner_id, term, count(*) AS tf FROM (
          SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM benchmark) GROUP BY ALL),
ub AS (SELECT owner_id, ('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS b, sum(tf * idf) AS w FROM tf JOIN idf USING (term) GROUP BY ALL),
qb AS (SELECT owner_id, ('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS b, sum(tf * idf) AS w FROM qtf JOIN idf USING (term) GROUP BY ALL),
un AS (SELECT owner_id, sqrt(sum(w * w)) AS nrm FROM ub GROUP BY owner_id),
qn AS (SELECT owner_id, sqrt(sum(w * w)) AS nrm FROM qb GROUP BY owner_id),
dt AS (SELECT q.owner_id AS query_id, u.owner_id AS unit_id, sum(q.w * u.w) AS d FROM qb q JOIN ub u USING (b) GROUP BY ALL),
sc AS (SELECT query_id, unit_id, d / (qn.nrm * un.nrm) AS score FROM dt
       JOIN qn ON qn.owner_id = dt.query_id JOIN un ON un.owner_id = dt.unit_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, unit_id) AS rn FROM sc)
SELECT query_id, unit_id, round(score, 6) AS score, CAST(rn AS INTEGER) AS rank FROM r WHERE rn <= 10"""
)


@register("vector_search", _VECTOR_SEARCH_SQL)
def q_vector_search(spark, sf_dir):
    """R5 (vector form) over text units: benchmark questions embedded with
    the corpus IDF, 10 nearest units each by cosine of hashed TF-IDF."""
    from kbforge.operators.retrieval import vector_topk
    from kbforge.operators.vectors import embed_with_idf, unit_vectors

    vecs, idf = unit_vectors(units_of(spark, sf_dir))
    q = embed_with_idf(_benchmark_questions(spark, sf_dir), idf)
    return vector_topk(
        q.withColumnRenamed("owner_id", "query_id"), vecs.withColumnRenamed("owner_id", "unit_id"),
        k=10, item_id="unit_id", item_vec="vector",
    )


@register("vector_search_approx")
def q_vector_search_approx(spark, sf_dir):
    """The questions of ``vector_search`` answered from the stored hash
    index (approximate; recall is measured when the index is written)."""
    from kbforge.operators.vector_index import search
    from kbforge.operators.vectors import embed_with_idf
    from kbforge.plans.index_build import vector_index_for

    index, idf = vector_index_for(spark, sf_dir)
    asked = embed_with_idf(_benchmark_questions(spark, sf_dir), idf).withColumnRenamed("owner_id", "query_id")
    return search(asked, index, k=10).withColumnRenamed("item_id", "unit_id")


@register("knowledge_counts")
def q_knowledge_counts(spark, sf_dir):
    """The knowledge tables loaded (explicit schemas) and counted."""
    from kbforge.sources.readers import table_counts

    ix = _index(spark, sf_dir)
    return table_counts({n: ix[n] for n in ("entities", "communities", "community_reports", "text_units", "relationships")})
