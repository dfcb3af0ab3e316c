"""Tables of nodes are sent to the edges up to a size; both ways give the same."""

import pytest
from pyspark.sql import functions as F

from kbforge import session
from kbforge.operators import modularity
from kbforge.session import materialize, sent_if_small
from tests.test_modularity import frames, partition, plain_merge, random_graph


@pytest.fixture
def no_own_broadcast(spark):
    """Spark sends nothing that it is not told to."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_a_bounded_table_is_sent(spark, monkeypatch, no_own_broadcast):
    small = spark.createDataFrame([("é" * 20, 1), (None, 2)], "node string, n long")
    other = spark.createDataFrame([("a", 1)], "node string, m long")
    monkeypatch.setattr(session, "MAX_SENT_BYTES", 2 * 16 + 40)
    assert "BroadcastHashJoin" in _plan(other.join(sent_if_small(small), "node"))
    monkeypatch.setattr(session, "MAX_SENT_BYTES", 2 * 16 + 39)
    assert "BroadcastHashJoin" not in _plan(other.join(sent_if_small(small), "node"))
    assert sent_if_small(small.limit(0)).count() == 0


@pytest.mark.parametrize("summed", [False, True])
def test_edges_inside_clusters_are_shuffled_for_sums_only(spark, no_own_broadcast, summed):
    nodes, edges = random_graph(4, 30, 3)
    assign, e = frames(spark, nodes, edges)
    inside = modularity.inner_edges(assign, materialize(e), summed=summed)
    assert _plan(inside).count("Exchange hashpartitioning") == (not summed)
    assert {tuple(r) for r in inside.collect()} == {("c", *x) for x in edges}
    assert inside.dtypes == [("cluster", "string"), ("a", "string"), ("b", "string"), ("w", "bigint")]


@pytest.mark.parametrize("sent", [0, session.MAX_SENT_BYTES])
@pytest.mark.parametrize("factor", [1, 10**7])
def test_merging_sent_or_shuffled_in_longs_or_decimals(spark, monkeypatch, sent, factor):
    monkeypatch.setattr(session, "MAX_SENT_BYTES", sent)
    nodes, edges = random_graph(4, 60, 5)
    edges = [(a, b, w * factor) for a, b, w in edges]
    assert (2 * sum(w for _, _, w in edges) < modularity._LONG_TOTAL) == (factor == 1)
    assign, e = frames(spark, nodes, edges)
    inside = materialize(modularity.inner_edges(assign, e, summed=True))
    made, contract = [], modularity.contract
    monkeypatch.setattr(modularity, "contract", lambda *a: made.append(1) or contract(*a))
    start = materialize(assign.select("node", "cluster", F.col("node").alias("label")))
    out = modularity.merge_all(start, inside, materialize(modularity.totals_of(inside)), 3)
    assert partition({r["node"]: r["label"] for r in out.collect()}) == partition(plain_merge(nodes, edges, 3))
    # neither for single nodes nor after the last round
    assert len(made) == 2
    assert inside.count() == len(edges)  # the caller's table is kept


def test_round_moves_no_edge_for_the_weights_of_its_ends(spark, monkeypatch, no_own_broadcast):
    nodes, edges = random_graph(4, 60, 5)
    assign, e = frames(spark, nodes, edges)
    inside = materialize(modularity.inner_edges(assign, e, summed=True))
    plans = []
    monkeypatch.setattr(modularity, "materialize", lambda df: plans.append(_plan(df)) or materialize(df))
    modularity.merge_round(inside, sent_if_small(modularity.totals_of(inside)), "long").collect()
    best = next(p for p in plans if "gain" in p)
    assert best.count("BroadcastHashJoin") == 5 and "SortMergeJoin" not in best
