"""A training-corpus pipeline: quality rules, near-duplicate removal, PII
redaction, source mixing, byte-level BPE."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbforge.llm import bpe, mixing, ngram_join, pii, quality
from kbforge.llm.common import load, prepare, whole_text
from kbforge.llm.queries import tokenizer
from kbforge.session import ensure_checkpoint_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule."""
    prepare(spark)
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates (five-word shingles,
    similarity 0.8)."""
    prepare(spark)
    return ngram_join.keep_one(docs, width=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by the mark of its kind."""
    prepare(spark)
    return pii.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, and the words of those that it
    takes a part of."""
    prepare(spark)
    return mixing.materialise_mix(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids and the digest of the decoded bytes."""
    prepare(spark)
    rank_file, pattern = tokenizer()
    decoded = bpe.decode(bpe.encode(docs, rank_file, pattern), rank_file, pattern)
    return decoded.withColumn("decoded_sha256", F.sha2("decoded", 256)).drop("decoded")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("byte_bpe", byte_bpe),
]

# Regular expressions with repair, hashing of sets and BPE have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in turn; each stage's rows are written as Parquet in
    the shared checkpoint folder and read again as the next one's input.  The
    decoded bytes are compared with the texts, so the rows come without their
    digest; a text that does not come back is an error."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    changed = docs.where(F.col("decoded_sha256") != F.sha2(whole_text().cast("binary"), 256)).count()
    if changed:
        raise ValueError(f"{changed} texts differ from the bytes that their token ids decode to")
    return docs.drop("decoded_sha256")
