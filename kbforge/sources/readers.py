"""Scans: driver tables, knowledge tables, text corpora, pages, eval cases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Knowledge-table schemas (our design; the reference never names a column).
KNOWLEDGE_SCHEMAS: dict[str, T.StructType] = {
    "documents": T.StructType(
        [
            T.StructField("doc_id", T.StringType()),
            T.StructField("url", T.StringType()),
            T.StructField("host", T.StringType()),
            T.StructField("title", T.StringType()),
            T.StructField("text", T.StringType()),
        ]
    ),
    "text_units": T.StructType(
        [
            T.StructField("unit_id", T.StringType()),
            T.StructField("doc_id", T.StringType()),
            T.StructField("chunk_no", T.IntegerType()),
            T.StructField("start_tok", T.IntegerType()),
            T.StructField("n_tokens", T.IntegerType()),
            T.StructField("text", T.StringType()),
        ]
    ),
    "entities": T.StructType(
        [
            T.StructField("entity_id", T.StringType()),
            T.StructField("name", T.StringType()),
            T.StructField("type", T.StringType()),
            T.StructField("description", T.StringType()),
            T.StructField("frequency", T.LongType()),
            T.StructField("degree", T.LongType()),
        ]
    ),
    "mentions": T.StructType(
        [
            T.StructField("entity_id", T.StringType()),
            T.StructField("unit_id", T.StringType()),
            T.StructField("n", T.LongType()),
        ]
    ),
    "relationships": T.StructType(
        [
            T.StructField("src", T.StringType()),
            T.StructField("dst", T.StringType()),
            T.StructField("weight", T.LongType()),
            T.StructField("description", T.StringType()),
        ]
    ),
    "communities": T.StructType(
        [
            T.StructField("level", T.IntegerType()),
            T.StructField("community", T.StringType()),
            T.StructField("parent", T.StringType()),
            T.StructField("entity_id", T.StringType()),
            T.StructField("oversized", T.BooleanType()),
        ]
    ),
    "community_reports": T.StructType(
        [
            T.StructField("level", T.IntegerType()),
            T.StructField("community", T.StringType()),
            T.StructField("size", T.LongType()),
            T.StructField("title", T.StringType()),
            T.StructField("report", T.StringType()),
            T.StructField("rank", T.DoubleType()),
        ]
    ),
}

# The five tables every search entry point loads.
SEARCH_TABLES = (
    "entities",
    "communities",
    "community_reports",
    "text_units",
    "relationships",
)


def read_table(spark: SparkSession, base_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory (``{base_dir}/{name}.parquet``)."""
    return spark.read.parquet(f"{base_dir.rstrip('/')}/{name}.parquet")


def load_knowledge_tables(
    spark: SparkSession, base_dir: str, names=SEARCH_TABLES
) -> dict[str, DataFrame]:
    """The knowledge tables as lazily scanned DataFrames.

    Schemas are given, not inferred, so a missing or renamed column fails at
    analysis time and no footer of a large table has to be read up front.
    Nothing is read until a query uses the frame; column pruning and
    predicate pushdown (e.g. ``level <= 2``) then reach the parquet scan.
    """
    return {
        n: spark.read.schema(KNOWLEDGE_SCHEMAS[n]).parquet(f"{base_dir.rstrip('/')}/{n}")
        for n in names
    }


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table as one DataFrame (``table``, ``rows``)."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("table"), F.col("rows")
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def read_text_corpus(
    spark: SparkSession, path: str, file_type: str = "text"
) -> DataFrame:
    """An input corpus as ``(doc_id, title, text)``.

    ``text``: one document per file (``wholetext``), keyed by file name.
    ``csv`` / ``json``: one document per record with ``id`` and ``text``
    columns (``title`` optional).
    """
    if file_type == "text":
        df = spark.read.text(path, wholetext=True)
        return df.select(
            F.col("_metadata.file_name").alias("doc_id"),
            F.col("_metadata.file_name").alias("title"),
            F.col("value").alias("text"),
        )
    if file_type == "csv":
        df = spark.read.option("header", True).option("multiLine", True).csv(path)
    elif file_type == "json":
        df = spark.read.json(path)
    else:
        raise ValueError(f"unknown file_type {file_type!r}")
    title = F.col("title") if "title" in df.columns else F.col("id")
    return df.select(
        F.col("id").cast("string").alias("doc_id"),
        title.cast("string").alias("title"),
        F.col("text").cast("string").alias("text"),
    )


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """S3: raw pages ``(page_id, url, html)``; replaces fetching one URL at a time."""
    return spark.read.parquet(path).select("page_id", "url", "html")


EVAL_CASE_SCHEMA = T.StructType(
    [
        T.StructField(
            "test_cases",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("id", T.StringType()),
                        T.StructField("question", T.StringType()),
                        T.StructField("ground_truth", T.StringType()),
                    ]
                )
            ),
        )
    ]
)


def read_eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """Golden cases from a nested JSON file, one row per case.

    ``case_order`` keeps the position in the file, which ranking ties use.
    """
    raw = spark.read.schema(EVAL_CASE_SCHEMA).option("multiLine", True).json(path)
    return raw.select(F.posexplode("test_cases").alias("case_order", "c")).select(
        "case_order",
        F.col("c.id").alias("id"),
        F.col("c.question").alias("question"),
        F.col("c.ground_truth").alias("ground_truth"),
    )
