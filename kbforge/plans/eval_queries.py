"""Registered queries: answer scoring and evaluation runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from kbforge.functions.evaluation import capital_term_set, cosine, factual_accuracy, keyword_set, number_set
from kbforge.operators.answers import evidence_responses
from kbforge.operators.chunking import chunk_documents
from kbforge.operators.common import rounded
from kbforge.operators.evaluation import (
    bleu_scores,
    case_type_product,
    eval_means,
    run_report,
    score_results,
    shared_shingle_pairs,
    top_bottom,
)
from kbforge.operators.postings import MAX_BROADCAST_PAIRS
from kbforge.operators.retrieval import SEARCH_TYPES, route
from kbforge.plans import sqlparts as S
from kbforge.plans.registry import register, table
from kbforge.plans.search_queries import lexical
from kbforge.session import broadcast_if_small, materialize

RUN_TIMESTAMP = "2024-01-01T00:00:00"


@register(
    "number_terms",
    f"""SELECT doc_id, CAST(len(s) AS INTEGER) AS n_numbers, array_to_string(list_sort(s), ' ') AS numbers
FROM (SELECT doc_id, {S.number_set('text')} AS s FROM documents)""",
)
def q_number_terms(spark, sf_dir):
    s = F.array_sort(number_set("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(s).cast("int").alias("n_numbers"), F.array_join(s, " ").alias("numbers")
    )


@register(
    "capital_terms",
    f"""SELECT doc_id, CAST(len(s) AS INTEGER) AS n_terms, array_to_string(list_sort(s), '|') AS terms
FROM (SELECT doc_id, {S.capital_term_set('text')} AS s FROM documents)""",
)
def q_capital_terms(spark, sf_dir):
    s = F.array_sort(capital_term_set("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(s).cast("int").alias("n_terms"), F.array_join(s, "|").alias("terms")
    )


@register(
    "keyword_hits",
    f"""SELECT doc_id, CAST(len(s) AS INTEGER) AS n_keywords, array_to_string(s, '|') AS keywords
FROM (SELECT doc_id, {S.keyword_set('text')} AS s FROM documents)""",
)
def q_keyword_hits(spark, sf_dir):
    s = keyword_set("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(s).cast("int").alias("n_keywords"), F.array_join(s, "|").alias("keywords")
    )


def _doc_vs_source_first(spark, sf_dir):
    """Each document (as response) against the first document of its source
    (as truth).  One equi-join on ``source``; the per-source first id comes
    from a partial-aggregated ``min``."""
    docs = table(spark, sf_dir, "documents")
    first = docs.groupBy("source").agg(F.min("doc_id").alias("truth_id"))
    truth = docs.select(F.col("doc_id").alias("truth_id"), F.col("text").alias("ground_truth"))
    return (
        docs.select("doc_id", "source", F.col("text").alias("response"))
        .join(first, "source")
        .join(truth, "truth_id")
    )


@register(
    "factual_accuracy",
    f"""WITH f AS (SELECT source, min(doc_id) AS truth_id FROM documents GROUP BY source),
p AS (SELECT d.doc_id, d.text AS response, t.doc_id AS truth_id, t.text AS ground_truth
      FROM documents d JOIN f USING (source) JOIN documents t ON t.doc_id = f.truth_id)
SELECT doc_id, truth_id, round({S.factual('response', 'ground_truth')}, 6) AS factual_accuracy FROM p""",
)
def q_factual_accuracy(spark, sf_dir):
    """E4, each document against the first document of its source.  The
    three sets of every document are extracted once; only the sets are
    joined, never the texts."""
    from kbforge.functions.evaluation import factual_from_sets

    docs = table(spark, sf_dir, "documents")
    sets = docs.select(
        "doc_id", "source",
        number_set("text").alias("num"), keyword_set("text").alias("kw"), capital_term_set("text").alias("term"),
    )
    first = docs.groupBy("source").agg(F.min("doc_id").alias("truth_id"))
    truth = sets.select(
        F.col("doc_id").alias("truth_id"), F.col("num").alias("t_num"), F.col("kw").alias("t_kw"), F.col("term").alias("t_term")
    )
    p = sets.join(first, "source").join(truth, "truth_id")
    fa = factual_from_sets("num", "kw", "term", "t_num", "t_kw", "t_term")
    return p.select("doc_id", "truth_id", rounded(fa).alias("factual_accuracy"))


@register(
    "cosine_relevance",
    """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
x AS (SELECT label, unnest(v) AS x, unnest(range(len(v))) AS i FROM e),
c AS (SELECT label, list(ax ORDER BY i) AS centroid FROM (SELECT label, i, avg(x) AS ax FROM x GROUP BY ALL) GROUP BY label),
j AS (SELECT vec_id, e.label, v, centroid FROM e JOIN c USING (label)),
d AS (SELECT vec_id, label, list_sum(list_transform(range(1, len(v) + 1), lambda k: v[k] * centroid[k])) AS dot,
             sqrt(list_sum(list_transform(v, lambda a: a * a))) AS na,
             sqrt(list_sum(list_transform(centroid, lambda a: a * a))) AS nb FROM j)
SELECT vec_id, label, round(CASE WHEN na > 0 AND nb > 0 THEN dot / (na * nb) ELSE 0.0 END, 6) AS relevance FROM d""",
)
def q_cosine_relevance(spark, sf_dir):
    """E5 on the vector table: each vector against the centroid of its label."""
    emb = table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("v")
    )
    per_dim = emb.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(
        F.avg("x").alias("ax")
    )
    # At most dimension-many rows per label reach this collect.
    centroid = per_dim.groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "ax"))), lambda s: s["ax"]).alias("centroid")
    )
    return emb.join(centroid, "label").select("vec_id", "label", rounded(cosine("v", "centroid")).alias("relevance"))


_BLEU_SQL = (
    f"""WITH ds AS (SELECT doc_id, unnest({S.shingles('t')}) AS g FROM (SELECT doc_id, {S.ws_tokens('text')} AS t FROM documents)),
bs AS (SELECT item_id, unnest({S.shingles('t')}) AS g FROM (SELECT item_id, {S.ws_tokens('text')} AS t FROM benchmark)),
pr AS (SELECT DISTINCT doc_id, item_id FROM ds JOIN bs USING (g)),
pairs AS (SELECT doc_id, item_id, doc_id || ':' || item_id AS result_id, d.text AS response, b.text AS ground_truth
          FROM pr JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id))"""
    + S.bleu_ctes("pairs", "result_id", "response", "ground_truth")
    + """
SELECT doc_id, item_id, round(bleu_score, 6) AS bleu_score FROM pairs JOIN bleu ON bleu.pid = pairs.result_id"""
)


@register("bleu", _BLEU_SQL)
def q_bleu(spark, sf_dir):
    """E6 over documents x benchmark passages that share an 8-word shingle."""
    docs = table(spark, sf_dir, "documents")
    bench = table(spark, sf_dir, "benchmark")
    pairs = shared_shingle_pairs(docs, bench, "doc_id", "item_id")
    p = (
        pairs.join(docs.select("doc_id", F.col("text").alias("response")), "doc_id")
        .join(bench.select("item_id", F.col("text").alias("ground_truth")), "item_id")
        .withColumn("result_id", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("item_id").cast("string")))
    )
    p = materialize(p)  # read by the length, n-gram and output branches
    b = bleu_scores(p)
    return p.join(b, "result_id").select("doc_id", "item_id", rounded("bleu_score").alias("bleu_score"))


# ---- one evaluation run over the driver data --------------------------------
# Cases are the benchmark passages (question = ground truth = passage); the
# basic (lexical) search answers each with the text of its best unit.


def scored_results(spark, sf_dir, types=("basic",)):
    bench = table(spark, sf_dir, "benchmark")
    cases = bench.select(
        F.col("item_id").cast("string").alias("id"),
        F.col("item_id").alias("case_order"),
        F.col("text").alias("question"),
        F.col("text").alias("ground_truth"),
    )
    runs = case_type_product(cases, types)
    questions = runs.select(
        F.concat_ws("/", "id", "search_type").alias("query_id"), F.col("question").alias("query")
    )
    best = broadcast_if_small(materialize(lexical(questions, spark, sf_dir, k=1, carry=("doc_id",)).select("query_id", "unit_id", "doc_id")), MAX_BROADCAST_PAIRS)
    # Only documents of the best units are cut again; no text is shuffled.
    docs = table(spark, sf_dir, "documents").join(best.select("doc_id"), "doc_id", "left_semi")
    best = chunk_documents(docs).select("unit_id", F.col("text").alias("response")).join(best.drop("doc_id"), "unit_id")
    results = runs.withColumn("result_id", F.concat_ws("/", "id", "search_type")).join(
        best.select(F.col("query_id").alias("result_id"), "response"), "result_id", "left"
    ).withColumn("response", F.coalesce("response", F.lit("")))
    # every metric re-reads the results: compute the search once
    return score_results(materialize(results))


_RESULTS_CTES = (
    "WITH"
    + S.units_cte()
    + S.lexical_cte(1, queries="(SELECT item_id || '/basic' AS qid, text FROM benchmark)", qid="qid")
    + """,
res AS (SELECT CAST(b.item_id AS VARCHAR) AS id, b.item_id AS case_order, b.text AS question, b.text AS ground_truth,
               'basic' AS search_type, 0 AS type_order, b.item_id || '/basic' AS result_id,
               coalesce(u.text, '') AS response
        FROM benchmark b LEFT JOIN lex ON lex.query_id = b.item_id || '/basic'
        LEFT JOIN units u ON u.unit_id = lex.unit_id)"""
    + S.bleu_ctes("res", "result_id", "response", "ground_truth")
    + S.term_cosine_ctes("res", "result_id", "response", "ground_truth")
    + f""",
scored AS (SELECT res.*, round({S.factual('response', 'ground_truth')}, 6) AS factual_accuracy,
                  round(coalesce(rel.relevance, 0.0), 6) AS relevance, round(coalesce(bleu.bleu_score, 0.0), 6) AS bleu_score
           FROM res LEFT JOIN rel ON rel.pid = res.result_id LEFT JOIN bleu ON bleu.pid = res.result_id)"""
)


@register(
    "eval_results",
    _RESULTS_CTES
    + """
SELECT id, question, ground_truth, response, search_type, factual_accuracy, relevance, bleu_score FROM scored""",
)
def q_eval_results(spark, sf_dir):
    """The case records (metrics flattened for comparison)."""
    return scored_results(spark, sf_dir).select(
        "id", "question", "ground_truth", "response", "search_type",
        "metrics.factual_accuracy", "metrics.relevance", "metrics.bleu_score",
    )


@register(
    "eval_means",
    _RESULTS_CTES
    + """
SELECT round(avg(factual_accuracy), 6) AS factual_accuracy, round(avg(relevance), 6) AS relevance,
       round(avg(bleu_score), 6) AS bleu_score, count(*) AS n_results FROM scored""",
)
def q_eval_means(spark, sf_dir):
    return eval_means(scored_results(spark, sf_dir))


@register(
    "eval_top_bottom",
    _RESULTS_CTES
    + """,
s AS (SELECT *, round((factual_accuracy + relevance + bleu_score) / 3.0, 6) AS avg_score FROM scored),
t AS (SELECT 'top' AS kind, CAST(row_number() OVER (ORDER BY avg_score DESC, case_order, type_order) AS INTEGER) AS position, * FROM s),
b AS (SELECT 'bottom' AS kind, CAST(row_number() OVER (ORDER BY avg_score ASC, case_order, type_order) AS INTEGER) AS position, * FROM s)
SELECT kind, position, id, search_type, avg_score, left(question, 80) || '...' AS question_shown FROM t WHERE position <= 3
UNION ALL
SELECT kind, position, id, search_type, avg_score, left(question, 80) || '...' AS question_shown FROM b WHERE position <= 3""",
)
def q_eval_top_bottom(spark, sf_dir):
    return top_bottom(scored_results(spark, sf_dir), k=3)


@register(
    "eval_report",
    _RESULTS_CTES
    + f"""
SELECT '{RUN_TIMESTAMP}' AS timestamp, count(DISTINCT id) AS total_cases,
       array_to_string(list_sort(list(DISTINCT search_type)), ',') AS search_types,
       round(avg(factual_accuracy), 6) AS factual_accuracy, round(avg(relevance), 6) AS relevance,
       round(avg(bleu_score), 6) AS bleu_score FROM scored""",
)
def q_eval_report(spark, sf_dir):
    return run_report(scored_results(spark, sf_dir), RUN_TIMESTAMP)


# ---- the same run with every search type ------------------------------------


def evidence_texts(ix):
    """The text behind every kind of evidence of an index."""
    reports = ix["community_reports"].select(
        F.lit("report").alias("kind"), F.concat_ws("#", F.col("level").cast("string"), "community").alias("item_id"), F.col("report").alias("text")
    )
    rels = ix["relationships"].select(
        F.lit("relationship").alias("kind"), F.concat_ws(" -- ", "src", "dst").alias("item_id"), F.col("description").alias("text")
    )
    entities = ix["entities"].select(F.lit("entity").alias("kind"), F.col("entity_id").alias("item_id"), F.col("description").alias("text"))
    units = ix["text_units"].select(F.lit("unit").alias("kind"), F.col("unit_id").alias("item_id"), "text")
    return units.unionByName(reports).unionByName(entities).unionByName(rels)


def scored_by_type(spark, sf_dir, types=SEARCH_TYPES):
    """Every benchmark case under every search type, answered by that search
    and scored."""
    from kbforge.plans.index_build import index_for
    from kbforge.plans.search_queries import _basic, _global, _local

    ix = index_for(spark, sf_dir)
    cases = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("string").alias("id"),
        F.col("item_id").alias("case_order"),
        F.col("text").alias("question"),
        F.col("text").alias("ground_truth"),
    )
    runs = case_type_product(cases, types).withColumn("result_id", F.concat_ws("/", "id", "search_type"))
    asked = runs.select(
        F.col("result_id").alias("request_id"), F.col("question").alias("query"), "search_type", F.lit(None).cast("string").alias("error")
    )
    evidence = materialize(route(asked, {"global": _global(ix), "local": _local(ix), "basic": _basic(spark, sf_dir)}))
    found = evidence_responses(evidence, evidence_texts(ix)).withColumnRenamed("query_id", "result_id")
    results = runs.join(found, "result_id", "left").withColumn("response", F.coalesce("response", F.lit("")))
    return score_results(materialize(results))


@register("eval_results_types")
def q_eval_results_types(spark, sf_dir):
    """The case records of all three search types; the response is the
    text of the three best rows of evidence."""
    return scored_by_type(spark, sf_dir).select(
        "id", "question", "ground_truth", "response", "search_type",
        "metrics.factual_accuracy", "metrics.relevance", "metrics.bleu_score",
    )


@register("eval_report_types")
def q_eval_report_types(spark, sf_dir):
    """E11 of the run over all three search types."""
    return run_report(scored_by_type(spark, sf_dir), RUN_TIMESTAMP)
