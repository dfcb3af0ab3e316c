"""Small DataFrame building blocks used across operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k_per_group(
    df: DataFrame,
    group_cols: Sequence[str],
    order_cols: Sequence[Column],
    k: int,
    rank_col: str = "rank",
) -> DataFrame:
    """Keep the first ``k`` rows of each group under a total order.

    ``row_number() <= k`` is planned as a ``WindowGroupLimit``: a partial
    limit runs on every mapper before the shuffle, so a group that holds a
    third of all rows sends at most ``k`` rows per map partition to the
    reducer.  ``order_cols`` must end in a unique key so ranks are stable.
    """
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    return (
        df.withColumn(rank_col, F.row_number().over(w))
        .where(F.col(rank_col) <= k)
        .withColumn(rank_col, F.col(rank_col).cast("int"))
    )


def within_budget(
    df: DataFrame,
    group_cols: Sequence[str],
    order_cols: Sequence[Column],
    cost: Column,
    budget: int,
    cum_col: str = "cum",
    pos_col: str | None = None,
    parts: int = 32,
) -> DataFrame:
    """Keep each group's first rows while the running sum of ``cost`` (at least
    1 per row) stays within ``budget``.

    Two stages, so that no task sees all rows of a large group.  A group is
    dealt over ``parts`` by a hash; each part keeps its rows up to and with the
    one that passes the budget.  A row of the result is within the budget in
    its part too, and a row that passes it in a part stands in the result's
    order before all that the part dropped, so the second, small window gives
    exactly the rows and sums of one window over everything.
    """
    part, spent = "_part", "_spent"
    salted = df.withColumn(part, F.pmod(F.xxhash64(*df.columns), F.lit(parts))).withColumn(spent, cost.cast("long"))
    first = Window.partitionBy(*group_cols, part).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    salted = salted.withColumn(cum_col, F.sum(spent).over(first)).where(F.col(cum_col) - F.col(spent) <= budget)
    last = Window.partitionBy(*group_cols).orderBy(*order_cols)
    out = salted.withColumn(cum_col, F.sum(spent).over(last.rowsBetween(Window.unboundedPreceding, 0)))
    if pos_col:
        out = out.withColumn(pos_col, F.row_number().over(last))
    return out.where(F.col(cum_col) <= budget).drop(part, spent)


def rounded(c, places: int = 6) -> Column:
    """Round a DOUBLE for engine-independent comparison of float results."""
    return F.round(F.col(c) if isinstance(c, str) else c, places).cast("double")
