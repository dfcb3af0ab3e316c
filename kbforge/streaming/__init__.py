"""Incremental ingestion of a growing page directory (S3 -> P* -> S5).

The reference fetches one URL at a time and overwrites ``{doc_id}.txt``; the
streaming form reads new page files as they land, turns every micro-batch
into documents with the same native column rules as the batch path, and
appends them as document versions:

* each epoch is written to its own ``epoch=<id>`` partition with dynamic
  partition overwrite, so a replayed epoch (after a driver or executor
  failure) replaces its own output instead of duplicating it;
* the current documents are the latest-wins reduction (S5) over all
  versions, computed when read; no file is rewritten in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbforge.operators.ingest import compose_document, scrape
from kbforge.sources.writers import latest_by_key

PAGES_SCHEMA = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)


def page_stream(spark: SparkSession, source_dir: str, max_files_per_trigger: int = 64) -> DataFrame:
    return (
        spark.readStream.schema(PAGES_SCHEMA)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .parquet(source_dir)
    )


def _write_epoch(target_dir: str):
    def write(batch: DataFrame, epoch_id: int) -> None:
        docs = compose_document(scrape(batch)).select("doc_id", "page_id", "url", "text")
        (
            docs.withColumn("epoch", F.lit(epoch_id).cast("long"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("epoch")
            .parquet(f"{target_dir}/versions")
        )

    return write


def start_ingest(
    spark: SparkSession,
    source_dir: str,
    target_dir: str,
    checkpoint_location: str,
    available_now: bool = True,
):
    """Start the ingest query; ``available_now`` processes what is there and
    stops (batch-like scheduling), otherwise it keeps polling."""
    writer = (
        page_stream(spark, source_dir)
        .writeStream.foreachBatch(_write_epoch(target_dir))
        .option("checkpointLocation", checkpoint_location)
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def current_documents(spark: SparkSession, target_dir: str) -> DataFrame:
    """S5 over all stored versions: one document per ``doc_id``, the latest
    page version (then the latest epoch) wins."""
    versions = spark.read.parquet(f"{target_dir}/versions")
    ranked = versions.select(
        "doc_id", F.struct("page_id", "epoch").alias("_v"), "url", "text"
    )
    return latest_by_key(ranked, "doc_id", "_v").select(
        "doc_id", F.col("_v.page_id").alias("page_id"), "url", "text"
    )
