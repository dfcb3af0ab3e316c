"""Scoring metrics (E1-E12) on hand-made cases and against brute force."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from kbforge.functions.evaluation import capital_term_set, factual_accuracy, keyword_set, number_set
from kbforge.operators.evaluation import (
    bleu_scores,
    case_type_product,
    eval_means,
    run_report,
    score_results,
    shared_shingle_pairs,
    term_cosine,
    top_bottom,
)
from tests.conftest import SMOKE_DIR


def test_term_sets(spark):
    df = spark.createDataFrame([("Pay 30,000 or 10.5. The First Home Scheme in Dublin, éCork and Cork happen",)], "t string")
    r = df.select(
        F.array_sort(number_set("t")).alias("n"),
        F.array_sort(capital_term_set("t")).alias("c"),
        keyword_set("t").alias("k"),
    ).collect()[0]
    assert r["n"] == ["10.5", "30000"]
    assert r["c"] == ["Cork", "Dublin", "Pay", "The First Home Scheme"]
    assert r["k"] == ["First Home Scheme", "HAP", "Dublin", "Cork"]


def test_factual_accuracy(spark):
    truth_num = "The First Home Scheme gives €30,000 to buyers in Dublin."
    truth_plain = "Rents are set by the Housing Agency in Galway."
    rows = [
        (1, truth_num, truth_num, 1.0),
        (2, truth_plain, truth_plain, 0.5),  # no number in the truth: at most 0.5
        (3, "it will happen", "HAP payments", 0.3),  # keyword substring
        (4, "nothing", truth_num, 0.0),
        (5, "30000 in Dublin", truth_num, 0.5 + 0.3 * 0.5 + 0.2 * 0.5),
    ]
    df = spark.createDataFrame(rows, "i int, r string, t string, want double")
    for row in df.select("i", "want", factual_accuracy("r", "t").alias("got")).collect():
        assert abs(row["got"] - row["want"]) < 1e-9, row


def _tok(s):
    return re.findall(r"[^\W_]+|[^\s\w]|_", s.lower())


def _bleu(hyp, ref, eps=0.1):
    """Brute force from Papineni et al. with smoothing method 1."""
    if not hyp:
        return 0.0
    ps = []
    for n in range(1, 5):
        h = Counter(tuple(hyp[i : i + n]) for i in range(len(hyp) - n + 1))
        r = Counter(tuple(ref[i : i + n]) for i in range(len(ref) - n + 1))
        m = sum(min(c, r[g]) for g, c in h.items())
        d = max(1, sum(h.values()))
        if n == 1 and m == 0:
            return 0.0
        ps.append(m / d if m else eps / d)
    bp = 1.0 if len(hyp) > len(ref) else math.exp(1 - len(ref) / len(hyp))
    return bp * math.exp(sum(math.log(p) / 4 for p in ps))


def test_bleu_matches_brute_force(spark):
    rng = random.Random(7)
    words = "the cat sat on a mat dog ran far , . !".split()
    pairs = []
    for i in range(60):
        h = " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))
        r = " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))
        pairs.append((str(i), h, r))
    pairs.append(("same", "the cat sat on the mat", "the cat sat on the mat"))
    df = spark.createDataFrame(pairs, "result_id string, response string, ground_truth string")
    got = {r["result_id"]: r["bleu_score"] for r in bleu_scores(df).collect()}
    for rid, h, r in pairs:
        assert abs(got[rid] - _bleu(_tok(h), _tok(r))) < 1e-9, (h, r)
    assert abs(got["same"] - 1.0) < 1e-12


def test_term_cosine(spark):
    df = spark.createDataFrame(
        [("a", "x y y", "x y y"), ("b", "x", "z"), ("c", "", "x")], "result_id string, response string, ground_truth string"
    )
    got = {r["result_id"]: r["relevance"] for r in term_cosine(df).collect()}
    assert abs(got["a"] - 1.0) < 1e-12 and got["b"] == 0.0 and got["c"] == 0.0


def test_shingle_pairs(spark):
    left = spark.createDataFrame([(1, "a b c d e f g h i"), (2, "z z z z z z z z"), (3, "b c d e f g h i j")], "id long, text string")
    right = spark.createDataFrame([(10, "x a b c d e f g h y")], "item long, text string")
    got = sorted(tuple(r) for r in shared_shingle_pairs(left, right, "id", "item").collect())
    assert got == [(1, 10)]


def _results(spark):
    cases = spark.createDataFrame(
        [(0, "c0", "q0", "Dublin has 5 homes"), (1, "c1", "q1", "Cork"), (2, "c2", "q2", "Galway 7")],
        "case_order long, id string, question string, ground_truth string",
    )
    runs = case_type_product(cases, ["global", "basic"])
    answers = {"c0": "Dublin has 5 homes", "c1": "Cork", "c2": "nothing"}
    ans = spark.createDataFrame(list(answers.items()), "id string, response string")
    res = runs.join(ans, "id").withColumn("result_id", F.concat_ws("/", "id", "search_type"))
    return score_results(res)


def test_case_product_means_top_bottom_report(spark):
    scored = _results(spark)
    assert scored.count() == 6
    m = eval_means(scored).collect()[0]
    assert m["n_results"] == 6
    tb = top_bottom(scored, 3).collect()
    top = [(r["position"], r["id"], r["search_type"]) for r in tb if r["kind"] == "top"]
    bottom = [(r["position"], r["id"], r["search_type"]) for r in tb if r["kind"] == "bottom"]
    # ties keep input order: case order, then type order
    assert top[0][1:] == ("c0", "global") and top[1][1:] == ("c0", "basic")
    assert bottom[0][1:] == ("c2", "global") and bottom[1][1:] == ("c2", "basic")
    rep = run_report(scored, "2024-01-01T00:00:00").collect()[0]
    assert rep["total_cases"] == 3 and rep["search_types"] == "basic,global"
    assert all(r["question_shown"].endswith("...") for r in tb)


def test_answers_cut_only_the_documents_of_the_best_units(spark, monkeypatch):
    from kbforge.plans import eval_queries

    seen = []
    real = eval_queries.chunk_documents
    monkeypatch.setattr(eval_queries, "chunk_documents", lambda docs: seen.append(docs) or real(docs))
    scored = eval_queries.scored_results(spark, SMOKE_DIR)
    cases = spark.read.parquet(f"{SMOKE_DIR}/benchmark.parquet").count()
    assert scored.count() == cases and 0 < seen[0].count() <= cases
