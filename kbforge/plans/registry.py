"""Named queries over a driver data directory, with their DuckDB oracles.

Each query is a callable ``(spark, sf_dir) -> DataFrame`` that reads the whole
driver tables it needs; the matching oracle SQL (when the operator is SQL
expressible) restates the same definition for DuckDB.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


# Tables whose rows carry long texts: spread over the cores when scanned
# into too few splits (see ``kbforge.session.spread``).
TEXT_TABLES = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from kbforge.session import spread
    from kbforge.sources.readers import read_table

    df = read_table(spark, sf_dir, name)
    return spread(df) if name in TEXT_TABLES else df
