"""Every registered query against its DuckDB restatement on the smallest
driver tables (the driver repeats this at sf0.01)."""

import pytest

from kbforge.plans import ORACLE, QUERIES
from tests.conftest import SMOKE_DIR
from tools.oracle_check import rows_of


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_duckdb(spark, duck, name):
    got = QUERIES[name](spark, SMOKE_DIR).toPandas()
    want = duck.execute(ORACLE[name]).df()
    gc, gr = rows_of(got)
    wc, wr = rows_of(want)
    assert gc == wc
    assert len(gr) == len(wr)
    assert gr == wr


def test_every_query_has_a_docstring_or_oracle():
    for name, fn in QUERIES.items():
        assert name in ORACLE or fn.__doc__, name


def test_entry_runs(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_no_query_plans_a_cross_join(spark):
    """Every registered query pairs rows through equi-joins only (no
    Cartesian product or nested-loop join in any physical plan) and uses no
    row-at-a-time Python UDF (Python runs only Arrow-batched)."""
    bad = []
    for name, fn in QUERIES.items():
        plan = fn(spark, SMOKE_DIR)._jdf.queryExecution().executedPlan().toString()
        bad += [
            (name, op) for op in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython") if op in plan
        ]
    assert bad == []
