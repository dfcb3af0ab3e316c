"""Retrieval: request validation, routing, global / local / vector / lexical
search, context packing and source attribution (R1-R8, C3).

Every search runs for a whole batch of questions at once.  Questions are the
small side: their terms are broadcast behind a row-count check; the corpus
side (units, reports, entities) is only scanned and never shuffled whole.
No search builds the question x corpus cross product: candidates come from
equi-joins on shared terms, and ranking keeps ``k`` rows per question with a
partial top-k before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbforge.functions.text import TERM_PATTERN, extract_all, term_set
from kbforge.operators.common import rounded, top_k_per_group, within_budget
from kbforge.session import broadcast_if_small

# Largest number of (question, term) rows we broadcast; beyond it the join
# shuffles on ``term`` instead.
MAX_BROADCAST_TERMS = 5_000_000


def question_terms(queries: DataFrame, query_id: str, query_text: str) -> DataFrame:
    """One row per distinct (question, term) plus the question's term count."""
    return queries.select(
        F.col(query_id).alias("query_id"), term_set(query_text).alias("_terms")
    ).select(
        "query_id",
        F.size("_terms").cast("long").alias("n_query_terms"),
        F.explode("_terms").alias("term"),
    )


def term_matches(
    queries: DataFrame,
    corpus: DataFrame,
    query_id: str = "query_id",
    query_text: str = "query",
    item_id: str = "unit_id",
    item_text: str = "text",
    carry=(),
    item_terms: str | None = None,
) -> DataFrame:
    """``(query_id, item_id, *carry, matched, n_query_terms)`` for every corpus
    item sharing at least one distinct term with a question.

    ``item_terms`` names an already extracted distinct-term array column of
    the corpus (then ``item_text`` is not read).

    ``carry`` names item attributes (functionally dependent on the item id)
    to keep with the match, so callers need not join back to the corpus.

    Plan: the corpus is exploded into its distinct terms inside the scan
    stage and probes a broadcast hash table of question terms, so the corpus
    never moves; only (question, item) counts, already reduced by the
    map-side partial aggregate, are shuffled.
    """
    qt = question_terms(queries, query_id, query_text)
    terms = F.col(item_terms) if item_terms else term_set(item_text)
    it = corpus.select(F.col(item_id).alias("item_id"), *carry, F.explode(terms).alias("term"))
    joined = it.join(broadcast_if_small(qt, MAX_BROADCAST_TERMS), "term")
    return joined.groupBy("query_id", "item_id", *carry).agg(
        F.count(F.lit(1)).alias("matched"), F.max("n_query_terms").alias("n_query_terms")
    )


# Number of most frequent corpus terms treated as "common" by the pruned
# lexical search (a bounded, broadcast set).
N_COMMON_TERMS = 128


def lexical_topk(
    queries: DataFrame,
    units: DataFrame,
    k: int = 3,
    query_id: str = "query_id",
    query_text: str = "query",
    unit_id: str = "unit_id",
    unit_text: str = "text",
    carry=(),
    n_common: int = N_COMMON_TERMS,
) -> DataFrame:
    """R6, lexical basic search: top-``k`` units per question by the number of
    distinct question terms they contain; ties by ``unit_id``.

    Output ``(query_id, unit_id, *carry, matched, score, rank)``; ``score`` is
    the matched share of the question's terms (0-1).

    Exact pruning (``n_common > 0``): joining on very frequent terms pairs
    almost every question with almost every unit.  So the ``n_common`` most
    frequent corpus terms are set apart: candidates are the units sharing a
    *rare* term with the question, and each candidate's full score adds its
    common-term overlap from two bounded arrays.  A unit that shares no rare
    term scores at most the question's number of common terms ``c``; when the
    k-th candidate scores more than ``c`` the candidate top-k is the exact
    top-k.  The few questions without that proof are answered by the full
    term join.  Same result as ``n_common=0``, far fewer join rows.

    The plan is the same for every batch size.
    """
    if n_common <= 0:
        return _lexical_full(queries, units, k, query_id, query_text, unit_id, unit_text, carry)
    from kbforge.session import materialize

    terms_u = materialize(units.select(F.col(unit_id).alias("unit_id"), *carry, term_set(unit_text).alias("terms")))
    ut = terms_u.select("unit_id", F.explode("terms").alias("term"))
    df = ut.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # at most n_common rows: computed once, then broadcast to every use
    common = F.broadcast(materialize(df.orderBy(F.desc("df"), F.asc("term")).limit(n_common).select("term")))
    qt = question_terms(queries, query_id, query_text)
    q_rare = qt.join(common, "term", "left_anti")
    q_common = qt.join(common, "term", "left_semi").groupBy("query_id").agg(F.collect_set("term").alias("cq"))
    nq = qt.select("query_id", "n_query_terms").distinct()
    u_common = ut.join(common, "term", "left_semi").groupBy("unit_id").agg(F.collect_set("term").alias("cu"))
    cand = (
        ut.join(common, "term", "left_anti")
        .join(broadcast_if_small(q_rare, MAX_BROADCAST_TERMS), "term")
        .groupBy("query_id", "unit_id")
        .agg(F.count(F.lit(1)).alias("r"))
    )
    empty = F.array().cast("array<string>")
    full = (
        cand.join(u_common, "unit_id", "left")
        .join(q_common, "query_id", "left")
        .select(
            "query_id",
            "unit_id",
            (F.col("r") + F.size(F.array_intersect(F.coalesce("cq", empty), F.coalesce("cu", empty)))).alias("matched"),
        )
    )
    # k rows per question: computed once, read by the proof and the answer
    top = materialize(top_k_per_group(full, ["query_id"], [F.desc("matched"), F.asc("unit_id")], k))
    proof = (
        top.groupBy("query_id")
        .agg(F.count(F.lit(1)).alias("n_top"), F.min("matched").alias("theta"))
        .join(q_common.select("query_id", F.size("cq").alias("c")), "query_id", "left")
        .where((F.col("n_top") >= k) & (F.col("theta") > F.coalesce("c", F.lit(0))))
        .select("query_id")
    )
    exact = top.join(proof, "query_id", "left_semi").join(nq, "query_id")
    exact = exact.join(terms_u.select("unit_id", *carry), "unit_id").select(
        "query_id", "unit_id", *carry, "matched",
        rounded(F.col("matched") / F.col("n_query_terms")).alias("score"), "rank",
    )
    rest_q = queries.join(proof.withColumnRenamed("query_id", query_id), query_id, "left_anti")
    if rest_q.limit(1).count() == 0:
        return exact
    rest = _lexical_full(rest_q, terms_u, k, query_id, query_text, "unit_id", None, carry, item_terms="terms")
    return exact.unionByName(rest)


# Terms of a phrase that the join looks for.
PHRASE_KEY_TERMS = 8
# Units that hold a key, with the phrases to compare, that we broadcast.
MAX_BROADCAST_PHRASES = 50_000


def phrase_search(
    queries: DataFrame,
    units: DataFrame,
    query_id: str = "query_id",
    query_text: str = "query",
    unit_id: str = "unit_id",
    unit_text: str = "text",
) -> DataFrame:
    """R6, exact form of basic search: ``(query_id, unit_id)`` of the units that
    hold a question's terms one after the other, in its order.  A question
    without terms matches nothing.

    The first terms of a question (eight, or all of a shorter one) are an
    equi-join key with the units' runs of that length; units are cut into runs
    only of lengths that occur among the questions.  Runs meet the questions
    without the text of their unit; the whole phrase is then compared in the
    units that hold a key.
    """
    from kbforge.session import materialize

    q = queries.select(F.col(query_id).alias("query_id"), extract_all(F.lower(query_text), TERM_PATTERN).alias("_q"))
    q = q.where(F.size("_q") > 0).withColumn("_n", F.least(F.size("_q"), F.lit(PHRASE_KEY_TERMS)))
    # Terms hold no space, so equal keys have the same length.
    q = q.select("query_id", "_n", F.array_join(F.slice("_q", 1, F.col("_n")), " ").alias("_key"), F.array_join("_q", " ").alias("_phrase"))
    lengths = sorted(r["_n"] for r in q.select("_n").distinct().collect())  # eight at most
    u = units.select(F.col(unit_id).alias("unit_id"), extract_all(F.lower(unit_text), TERM_PATTERN).alias("_u"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("_u"), F.lit(1)))

    def runs_of(n: int):
        fits = F.filter(starts, lambda i: i + n - 1 <= F.size("_u"))
        return F.transform(fits, lambda i: F.array_join(F.slice("_u", i, n), " "))

    # Distinct strings are found by hashing, distinct structs pair by pair.
    runs = F.array_distinct(F.concat(*[runs_of(n) for n in lengths])) if lengths else F.array().cast("array<string>")
    keyed = u.select("unit_id", F.explode(runs).alias("_key"))
    hits = materialize(keyed.join(broadcast_if_small(q.drop("_n"), MAX_BROADCAST_TERMS), "_key").select("query_id", "unit_id", "_phrase"))
    held = broadcast_if_small(hits, MAX_BROADCAST_PHRASES)
    texts = u.select("unit_id", F.array_join("_u", " ").alias("_text")).join(held, "unit_id")
    whole = F.contains(F.concat(F.lit(" "), "_text", F.lit(" ")), F.concat(F.lit(" "), "_phrase", F.lit(" ")))
    return texts.where(whole).select("query_id", "unit_id")


def _lexical_full(
    queries: DataFrame,
    units: DataFrame,
    k: int,
    query_id: str,
    query_text: str,
    unit_id: str,
    unit_text: str | None,
    carry,
    item_terms: str | None = None,
) -> DataFrame:
    """Lexical top-k by a join on every shared term (no pruning)."""
    m = term_matches(queries, units, query_id, query_text, unit_id, unit_text, carry, item_terms)
    scored = m.select(
        "query_id",
        F.col("item_id").alias("unit_id"),
        *carry,
        "matched",
        rounded(F.col("matched") / F.col("n_query_terms")).alias("score"),
    )
    return top_k_per_group(
        scored, ["query_id"], [F.desc("matched"), F.asc("unit_id")], k
    )


def pack_context(
    evidence: DataFrame,
    budget: int = 8000,
    group_col: str = "query_id",
    order_cols=None,
    cost_col: str = "n_tokens",
) -> DataFrame:
    """Keep each question's best evidence while the running token total
    stays within ``budget``.

    Every item costs at least one token.  The cut runs in two stages (see
    ``within_budget``), so the candidates of one question are never sorted in
    one task.  Adds ``cost`` and ``cum_tokens``.
    """
    order_cols = order_cols or [F.desc("score"), F.asc("unit_id")]
    cost = F.greatest(F.col(cost_col).cast("long"), F.lit(1).cast("long"))
    return within_budget(evidence.withColumn("cost", cost), [group_col], order_cols, F.col("cost"), budget, "cum_tokens")


def attribute_sources(
    hits: DataFrame,
    units: DataFrame,
    docs: DataFrame,
    doc_cols=("source",),
    catalog: DataFrame | None = None,
    catalog_key: str = "url",
) -> DataFrame:
    """Hit -> text unit -> document -> (optional) source catalogue.

    Equi-joins on ``unit_id`` and ``doc_id``; only the key and attribute
    columns of the corpus tables are read, never their text.
    """
    d = docs.select("doc_id", *doc_cols)
    if units is not None and "doc_id" not in hits.columns:
        hits = hits.join(units.select("unit_id", "doc_id"), "unit_id")
    out = hits.join(d, "doc_id")
    if catalog is not None:
        out = out.join(catalog, catalog_key, "left")
    return out


# ---- R1 / R2: request validation and routing ---------------------------------

SEARCH_TYPES = ("global", "local", "basic")
EMPTY_QUERY = "Query cannot be empty"
BAD_TYPE = "Invalid search type. Must be: global, local, or basic"


def validate_requests(requests: DataFrame) -> DataFrame:
    """``request_id, query, search_type, error``.

    The query is stripped (not lower-cased); a missing type means
    ``global``; the type is lower-cased but not stripped.  An empty query is
    reported before an unknown type.  ``error`` is NULL for valid rows.
    """
    from kbforge.functions.text import strip_ws

    q = strip_ws(F.coalesce(F.col("query"), F.lit("")))
    t = F.lower(F.coalesce(F.col("search_type"), F.lit("global")))
    err = F.when(q == "", F.lit(EMPTY_QUERY)).when(~t.isin(*SEARCH_TYPES), F.lit(BAD_TYPE))
    return requests.select("request_id", q.alias("query"), t.alias("search_type"), err.alias("error"))


def route(valid: DataFrame, searches: dict, unknown: str = "reject") -> DataFrame:
    """R2: run each search on its own requests and union the results.

    ``searches`` maps a type to a function ``DataFrame -> DataFrame`` that
    takes ``(query_id, query)`` rows and returns ranked evidence with a
    ``query_id`` column; types without a function use ``basic``.
    ``unknown="reject"`` (the API) leaves requests with an unknown type
    out; ``unknown="basic"`` (the UI and the evaluator) sends them to the
    basic search.  Empty queries are never searched.
    """
    routed_type = F.col("search_type")
    if unknown == "basic":
        routed_type = F.when(F.col("error") == BAD_TYPE, F.lit("basic")).otherwise(routed_type)
        ok = F.col("error").isNull() | (F.col("error") == BAD_TYPE)
    elif unknown == "reject":
        ok = F.col("error").isNull()
    else:
        raise ValueError("unknown must be 'reject' or 'basic'")
    out = None
    for typ in SEARCH_TYPES:
        fn = searches.get(typ) or searches["basic"]
        part = valid.where((routed_type == typ) & ok).select(
            F.col("request_id").alias("query_id"), "query"
        )
        res = fn(part).withColumn("search_type", F.lit(typ))
        out = res if out is None else out.unionByName(res, allowMissingColumns=True)
    return out


# ---- R3: global search over community reports --------------------------------

def global_search(
    queries: DataFrame,
    reports: DataFrame,
    level: int = 2,
    budget: int = 8000,
    query_id: str = "query_id",
    query_text: str = "query",
) -> DataFrame:
    """Reports scored 0-100 by the share of distinct question terms they
    contain; zero scores dropped; ranked by score then community; packed to
    ``budget`` tokens.

    A community that is carried down unchanged has a report on each level; only
    its deepest one with ``level <= 2`` is read.  The level filter reaches the
    reports scan; the scoring is the term equi-join of ``term_matches``.
    """
    from kbforge.functions.text import ws_tokens

    deepest = reports.where(F.col("level") <= level).groupBy("community").agg(F.max("level").alias("level"))
    r = reports.where(F.col("level") <= level).join(deepest, ["community", "level"]).select(
        F.concat_ws("#", F.col("level").cast("string"), "community").alias("report_id"),
        "level",
        "community",
        F.concat_ws("\n", "title", "report").alias("text"),
    )
    m = term_matches(queries, r, query_id, query_text, "report_id", "text")
    scored = m.select(
        "query_id",
        F.col("item_id").alias("report_id"),
        rounded(F.lit(100.0) * F.col("matched") / F.col("n_query_terms")).alias("score"),
    ).where(F.col("score") > 0)
    cost = r.select("report_id", F.size(ws_tokens("text")).alias("n_tokens"))
    ev = scored.join(cost, "report_id")
    return pack_context(ev, budget=budget, order_cols=[F.desc("score"), F.asc("report_id")])


# ---- R4: local search over entities, relationships, units, reports -----------

def local_search(
    queries: DataFrame,
    entities: DataFrame,
    rels: DataFrame,
    mentions_df: DataFrame,
    units: DataFrame,
    communities: DataFrame,
    reports: DataFrame,
    seeds: int = 10,
    level: int = 2,
    budget: int = 8000,
    query_id: str = "query_id",
    query_text: str = "query",
) -> DataFrame:
    """``query_id, kind, item_id, score, cost, cum_tokens``.

    Seeds: the ``seeds`` entities whose names share the most distinct terms
    with the question.  Context rows, each scored by its seed's score:
    the seed entities, their relationships (1 hop), the units that mention
    them, and the report of each seed's community at the deepest level
    ``<= level``.  All rows of a question are packed together into
    ``budget`` tokens (score, then kind, then id).
    """
    from kbforge.functions.text import ws_tokens

    ent_text = entities.select("entity_id", F.concat_ws(" ", "name").alias("text"))
    m = term_matches(queries, ent_text, query_id, query_text, "entity_id", "text")
    seed = top_k_per_group(
        m.select("query_id", F.col("item_id").alias("entity_id"), "matched"),
        ["query_id"],
        [F.desc("matched"), F.asc("entity_id")],
        seeds,
        rank_col="seed_rank",
    ).withColumn("score", F.col("matched").cast("double"))

    ent_rows = seed.join(entities.select("entity_id", "description"), "entity_id").select(
        "query_id", F.lit("entity").alias("kind"), F.col("entity_id").alias("item_id"), "score",
        F.size(ws_tokens(F.concat_ws(" ", "entity_id", "description"))).alias("n_tokens"),
    )
    ends = rels.select(F.col("src").alias("entity_id"), "src", "dst", "weight").unionByName(
        rels.select(F.col("dst").alias("entity_id"), "src", "dst", "weight")
    )
    rel_rows = seed.join(ends, "entity_id").groupBy("query_id", "src", "dst").agg(
        F.max("score").alias("score")
    ).select(
        "query_id", F.lit("relationship").alias("kind"), F.concat_ws(" -- ", "src", "dst").alias("item_id"),
        "score", F.size(ws_tokens(F.concat_ws(" -- ", "src", "dst"))).alias("n_tokens"),
    )
    unit_hits = seed.join(mentions_df.select(F.col("name").alias("entity_id"), "unit_id"), "entity_id")
    unit_rows = unit_hits.groupBy("query_id", "unit_id").agg(F.sum("score").alias("score")).join(
        units.select("unit_id", "n_tokens"), "unit_id"
    ).select("query_id", F.lit("unit").alias("kind"), F.col("unit_id").alias("item_id"), "score", "n_tokens")
    deepest = communities.where(F.col("level") <= level).groupBy("entity_id").agg(
        F.max_by(F.struct("level", "community"), "level").alias("c")
    ).select("entity_id", F.col("c.level").alias("level"), F.col("c.community").alias("community"))
    rep = reports.select("level", "community", F.size(ws_tokens("report")).alias("n_tokens"))
    rep_rows = seed.join(deepest, "entity_id").join(rep, ["level", "community"]).groupBy(
        "query_id", "level", "community", "n_tokens"
    ).agg(F.sum("score").alias("score")).select(
        "query_id", F.lit("report").alias("kind"),
        F.concat_ws("#", F.col("level").cast("string"), "community").alias("item_id"), "score", "n_tokens",
    )
    ev = ent_rows.unionByName(rel_rows).unionByName(unit_rows).unionByName(rep_rows)
    kind_order = F.when(F.col("kind") == "entity", 0).when(F.col("kind") == "relationship", 1).when(
        F.col("kind") == "report", 2).otherwise(3)
    ev = ev.withColumn("kind_order", kind_order)
    return pack_context(
        ev, budget=budget, order_cols=[F.desc("score"), F.asc("kind_order"), F.asc("item_id")]
    ).drop("kind_order")


# ---- R5: exact vector top-k --------------------------------------------------

MAX_QUERY_VECTORS = 50_000
RANK_DECIMALS = 9
#: Most scores that a task holds at once.
SCORES_AT_ONCE = 2_000_000


def vector_topk(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = 10,
    query_id: str = "query_id",
    query_vec: str = "vector",
    item_id: str = "vec_id",
    item_vec: str = "embedding",
    exclude_self: bool = False,
) -> DataFrame:
    """The ``k`` most cosine-similar vectors per query, exact.

    The query batch is the small side: it is checked against
    ``MAX_QUERY_VECTORS`` and shipped to every task as one broadcast numpy
    matrix.  Each task scores its slice of the vector table with one matrix
    product per Arrow batch and keeps only its own best ``k`` per query, so
    at most ``k x tasks`` rows per query are shuffled to the final
    ``row_number() <= k``.  No query x vector rows are ever materialised.
    Scores are ranked at 9 decimals; ties break on the smaller item id.
    """
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    from kbforge.session import bounded_batches

    spark = vectors.sparkSession
    q = queries.select(F.col(query_id).alias("qid"), F.col(query_vec).cast("array<double>").alias("v"))
    n_q = q.limit(MAX_QUERY_VECTORS + 1).count()
    if n_q > MAX_QUERY_VECTORS:
        raise ValueError(f"more than {MAX_QUERY_VECTORS} query vectors: split the batch")
    qpdf = q.toPandas()
    qmat = np.array([np.asarray(v, dtype=np.float64) for v in qpdf["v"]]) if len(qpdf) else np.zeros((0, 1))
    qn = np.linalg.norm(qmat, axis=1) if len(qpdf) else np.zeros(0)
    bc = spark.sparkContext.broadcast((qpdf["qid"].tolist(), qmat, qn))
    qid_type = q.schema["qid"].dataType.simpleString()
    iid_type = vectors.schema[item_id].dataType.simpleString()
    schema = f"query_id {qid_type}, {item_id} {iid_type}, score double"
    types = [to_arrow_type(q.schema["qid"].dataType), to_arrow_type(vectors.schema[item_id].dataType), pa.float64()]

    def score_partition(batches):
        qids, Q, QN = bc.value
        best_s = [np.empty(0)] * len(qids)
        best_i = [np.empty(0, dtype=object)] * len(qids)
        floor = np.full(len(qids), -np.inf)  # the k-th best score so far
        own = np.array([[qid] for qid in qids], dtype=object) if exclude_self else None
        for batch in batches:
            if len(batch) == 0 or len(qids) == 0:
                continue
            X = batch["v"].flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            ids = batch["iid"].to_numpy(zero_copy_only=False)
            xn = np.linalg.norm(X, axis=1)
            for first in range(0, len(qids), step := max(1, SCORES_AT_ONCE // len(batch))):
                part = slice(first, first + step)
                denom = np.outer(QN[part], xn)
                with np.errstate(divide="ignore", invalid="ignore"):
                    S = np.where(denom > 0, (Q[part] @ X.T) / denom, 0.0)
                # rank on 9 decimals so that vectors equal up to summation order tie
                S = np.round(S, RANK_DECIMALS)
                # what ties with the k-th best stays in, and so does what is not a number
                may = ~(S < floor[part, None])
                if exclude_self:
                    may &= ids != own[part]
                if k < len(batch):
                    kth = np.partition(np.where(may & (S == S), S, -np.inf), -k, axis=1)[:, -k]
                    may &= ~(S < kth[:, None])
                for j in np.flatnonzero(may.any(axis=1)):
                    s = np.concatenate([best_s[first + j], S[j][may[j]]])
                    cand_i = np.concatenate([best_i[first + j], ids[may[j]]])
                    if len(s) >= k:
                        order = np.lexsort((cand_i, -s))[:k]
                        s, cand_i = s[order], cand_i[order]
                        floor[first + j] = s[-1]
                    best_s[first + j], best_i[first + j] = s, cand_i
        names = ["query_id", item_id, "score"]
        for first in range(0, len(qids), 1_000):
            rows = [(qids[j], best_i[j][t], float(best_s[j][t])) for j in range(first, min(first + 1_000, len(qids))) for t in range(len(best_s[j]))]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], types[c]) for c in range(3)], names=names)

    vec = vectors.select(F.col(item_id).alias("iid"), F.col(item_vec).cast("array<double>").alias("v"))
    bounded_batches(spark)
    local = vec.mapInArrow(score_partition, schema)
    return top_k_per_group(local, ["query_id"], [F.desc("score"), F.asc(item_id)], k).withColumn(
        "score", rounded("score")
    )


# ---- C3: answer repeated requests once ---------------------------------------

def dedupe_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(distinct, mapping)``.  ``distinct`` has one row per
    (normalised query, type) with ``query_id``; ``mapping`` maps every
    ``request_id`` to its ``query_id``.  Search ``distinct`` once and join
    the results back through ``mapping``.
    """
    norm = F.lower(F.regexp_replace(F.col("query"), r"\s+", " "))
    keyed = requests.withColumn("query_norm", norm)
    distinct = keyed.groupBy("query_norm", "search_type").agg(
        F.min("request_id").alias("query_id"), F.min("query").alias("query")
    )
    d = distinct.select(F.col("query_norm").alias("_n"), F.col("search_type").alias("_t"), "query_id")
    # null-safe on the type: a missing type is a valid (default) type
    cond = (keyed["query_norm"] == d["_n"]) & keyed["search_type"].eqNullSafe(d["_t"])
    mapping = keyed.join(d, cond).select("request_id", "query_id")
    return distinct, mapping
