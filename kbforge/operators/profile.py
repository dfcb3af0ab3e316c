"""P10-P12 re-aimed: summary, row narrative and markdown of any DataFrame.

The reference writes these texts for small HTML tables held in pandas.  For
a DataFrame of any size the same texts are built from bounded pieces:

* "categories" (columns with at most 5 distinct values and more than 3
  rows): the first 3 values in key order.  Whether a column has so few values
  is a bounded aggregate: a task keeps up to five values of each column with
  their least key, gives a column up at the sixth, and returns that state; the
  states are merged, so a wide table shuffles a few rows a column and task
  whatever its columns hold;
* the example row, the first 10 narrative rows and the at most 20 markdown
  rows from ``orderBy(key).limit(n)`` (take-ordered: each task keeps n).

"First" means first by ``key``; NULL values sort last and print as ``nan``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbforge.operators.common import top_k_per_group

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
FEW_VALUES = 5
NARRATIVE_ROWS = 10
MARKDOWN_ROWS = 20


def _as_text(df: DataFrame) -> list:
    return [F.col(c).cast("string").alias(c) for c in df.columns]


def _few_values(n_columns: int, most: int):
    """The bounded state of a task: ``(ci, v, first_k, many)`` with up to
    ``most`` values of each column, or one row with ``many``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict | None] = [{} for _ in range(n_columns)]
        kind = None
        for batch in batches:
            keys = batch.column(0)
            kind = keys.type
            for i, values in enumerate(held):
                if values is None:
                    continue
                column = batch.column(i + 1)
                found = column.unique().to_pylist()
                if len({*values, *found} - {None}) > most:
                    held[i] = None
                    continue
                for v in found:
                    at = keys.filter(pc.is_null(column) if v is None else pc.fill_null(pc.equal(column, v), False))
                    seen = [k for k in (values.get(v), pc.min_max(at)["min"].as_py()) if k is not None]
                    values[v] = min(seen, default=None)
        if kind is not None:
            rows = [(i, v, k, False) for i, values in enumerate(held) if values is not None for v, k in values.items()]
            rows += [(i, None, None, True) for i, values in enumerate(held) if values is None]
            ci, v, k, many = zip(*rows, strict=True)
            columns = [pa.array(ci, pa.int32()), pa.array(v, pa.string()), pa.array(k, kind), pa.array(many, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["ci", "v", "first_k", "many"])

    return run


def few_values(df: DataFrame, key: str, most: int = FEW_VALUES) -> DataFrame:
    """``(ci, v, first_k)``: the values, as text, of the columns that have at
    most ``most`` of them (null not counted), with the least key of each."""
    texts = df.select(F.col(key).alias("_k"), *[F.col(c).cast("string").alias(f"_{i}") for i, c in enumerate(df.columns)])
    kind = df.schema[key].dataType.simpleString()
    states = texts.mapInArrow(_few_values(len(df.columns), most), f"ci int, v string, first_k {kind}, many boolean")
    merged = states.groupBy("ci", "v", "many").agg(F.min("first_k").alias("first_k"))
    width = merged.groupBy("ci").agg(F.count("v").alias("values"), F.max("many").alias("many"))
    few = width.where(~F.col("many") & (F.col("values") <= most)).select("ci")
    return merged.join(few, "ci", "left_semi").select("ci", "v", "first_k")


def table_profile(df: DataFrame, key: str, name: str) -> DataFrame:
    """One row ``(table, summary)``."""
    cols = df.columns
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]
    n = df.agg(F.count(F.lit(1)).alias("n"))
    per_value = few_values(df, key)
    nunique = per_value.groupBy("ci").agg(F.count("v").alias("nunique"))
    first3 = top_k_per_group(
        per_value, ["ci"], [F.col("v").isNull().asc(), F.asc("first_k")], 3, rank_col="r"
    )
    cats = first3.groupBy("ci").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("r", F.coalesce("v", F.lit("nan")).alias("v")))), lambda s: s["v"]),
            ", ",
        ).alias("vals")
    )
    names = F.array(*[F.lit(c) for c in cols])
    cat_lines = nunique.join(cats, "ci").select(
        "ci",
        F.concat(F.get(names, F.col("ci")), F.lit(" categories: "), F.col("vals")).alias("line"),
        "nunique",
    )
    # One-row results enter as scalar subqueries, never as keyless joins.
    n_rows = df.select(F.count(F.lit(1))).scalar()
    cat_ok = cat_lines.where((F.when(n_rows > 1, F.col("nunique")).otherwise(F.lit(1)) <= 5) & (n_rows > 3))
    cats_text = cat_ok.agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ci", "line"))), lambda s: s["line"]), ". ")
    ).scalar()
    first = df.orderBy(key).limit(1).select(*_as_text(df))
    sample = F.filter(
        F.array(*[F.when(F.trim(F.col(c)) != "", F.concat(F.lit(f"{c}: "), F.col(c))) for c in cols]),
        lambda s: s.isNotNull(),
    )
    example = first.select(F.array_join(F.slice(sample, 1, 3), ", ")).scalar()
    head = F.concat(
        F.lit("Table with "), F.col("n").cast("string"), F.lit(f" rows and {len(cols)} columns. Columns: {', '.join(cols)}")
    )
    num_part = [F.lit(f"Numeric data in: {', '.join(numeric)}")] if numeric else []
    parts = [head, *num_part, F.when(cats_text != "", cats_text), F.when(example != "", F.concat(F.lit("Example row - "), example))]
    summary = F.when(F.col("n") == 0, F.lit("Empty table")).otherwise(F.concat_ws(". ", *parts))
    return n.select(F.lit(name).alias("table"), summary.alias("summary"))


def row_narrative(df: DataFrame, key: str, name: str) -> DataFrame:
    """One row ``(table, narrative)``: ``Entry i: col is val, ...`` for the
    first 10 rows by key, ``... and N more entries``, and the column sentence."""
    cols = df.columns
    first = df.orderBy(key).limit(NARRATIVE_ROWS).select(F.col(key).alias("_k"), *_as_text(df))
    cells = F.filter(
        F.array(*[F.when(F.trim(F.col(c)) != "", F.concat(F.lit(f"{c} is "), F.col(c))) for c in cols]),
        lambda s: s.isNotNull(),
    )
    lines = first.select("_k", F.array_join(cells, ", ").alias("cells"))
    gathered = lines.agg(
        F.filter(
            F.transform(
                F.array_sort(F.collect_list(F.struct("_k", "cells"))),
                lambda s, i: F.when(s["cells"] != "", F.concat(F.lit("Entry "), (i + 1).cast("string"), F.lit(": "), s["cells"])),
            ),
            lambda e: e.isNotNull(),
        ).alias("entries")
    )
    n = df.select(F.count(F.lit(1))).scalar()
    more = F.when(n > NARRATIVE_ROWS, F.array(F.concat(F.lit("... and "), (n - NARRATIVE_ROWS).cast("string"), F.lit(" more entries"))))
    rel = f"\nThis table shows relationships between: {', '.join(cols)}" if len(cols) > 1 else None
    parts = F.concat(
        F.col("entries"),
        F.coalesce(more, F.array().cast("array<string>")),
        F.array(F.lit(rel)) if rel else F.array().cast("array<string>"),
    )
    text = F.when(n == 0, F.lit("No data available in this table.")).otherwise(F.array_join(parts, ". "))
    return gathered.select(F.lit(name).alias("table"), text.alias("narrative"))


def markdown_table(df: DataFrame, key: str, name: str) -> DataFrame:
    """One row ``(table, markdown)``: a pipe table of all rows when there are
    1 to 20, else ``Large table (N rows) - see summary above``."""
    cols = df.columns
    first = df.orderBy(key).limit(MARKDOWN_ROWS + 1).select(F.col(key).alias("_k"), *_as_text(df))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c), F.lit("nan")) for c in cols]), F.lit(" |"))
    body = first.select("_k", line.alias("line")).agg(
        F.count(F.lit(1)).alias("m"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "line"))), lambda s: s["line"]), "\n").alias("body"),
    )
    n = df.select(F.count(F.lit(1))).scalar()
    header = "| " + " | ".join(cols) + " |\n|" + "|".join("---" for _ in cols) + "|\n"
    text = F.when((n > 0) & (n <= MARKDOWN_ROWS), F.concat(F.lit(header), F.col("body"))).otherwise(
        F.concat(F.lit("Large table ("), n.cast("string"), F.lit(" rows) - see summary above"))
    )
    return body.select(F.lit(name).alias("table"), text.alias("markdown"))
