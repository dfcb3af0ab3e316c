"""Vectors of units summed inside their row, and the exact top-k over them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kbforge.operators.retrieval import vector_topk
from kbforge.operators.vectors import hashed_vectors, term_weights, unit_vectors


@pytest.fixture(scope="module")
def units(spark):
    rng = random.Random(8)
    words = ["Ann", "bo", "c1", "É", "dé", "中文", "x_y", "𝟘", *(f"w{i}" for i in range(60))]
    texts = [None, "", " .. ", *(rng.choice([" ", ", ", "-\n"]).join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(60)), "once only"]
    return spark.createDataFrame([(f"u{i}", t) for i, t in enumerate(texts)], "unit_id string, text string").repartition(3)


@pytest.mark.parametrize("most", [2_000_000, 50, 20, 0])
def test_vectors_whatever_is_sent(units, most):
    want = {r["owner_id"]: r["vector"] for r in hashed_vectors(term_weights(units)).collect()}
    vectors, idf = unit_vectors(units, max_sent=most)
    rows = vectors.collect()
    got = {r["owner_id"]: r["vector"] for r in rows}
    assert len(rows) == len(got) == len(want) == 61 and set(got) == set(want)
    assert all(np.allclose(got[k], want[k], atol=1e-12) for k in want)
    weights = term_weights(units).select("term", F.round("idf", 12).alias("idf")).distinct()
    assert {tuple(r) for r in idf.select("term", F.round("idf", 12)).collect()} == {tuple(r) for r in weights.collect()}


def test_no_term_is_shuffled_or_joined_for_the_vectors(units):
    plan = unit_vectors(units)[0]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


@pytest.mark.parametrize("exclude", [False, True])
def test_topk_over_many_batches(spark, exclude):
    rng = np.random.default_rng(9)
    X = rng.integers(-2, 3, size=(2_500, 3)).astype(float)  # many ties, some zero vectors
    vecs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "vec_id long, embedding array<double>").repartition(2)
    asked = vecs.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    got = vector_topk(asked, vecs, k=7, exclude_self=exclude).collect()
    norm = np.linalg.norm(X, axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        S = np.round(np.where(np.outer(norm, norm) > 0, X @ X.T / np.outer(norm, norm), 0.0), 9)
    for q in range(0, 2_500, 100):
        order = sorted((i for i in range(2_500) if not (exclude and i == q)), key=lambda i: (-S[q, i], i))[:7]
        assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == order
    few = vector_topk(asked, vecs.where("vec_id < 3"), k=7, exclude_self=exclude)
    assert few.count() == 25 * 3 - (1 if exclude else 0)
