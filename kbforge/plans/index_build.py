"""Index build: documents -> knowledge tables, written as parquet.

Stages: chunk (G1) -> deduplicate units -> mentions (G4) -> entities with
descriptions and degrees (G5, G9) -> relationships (G6) -> hierarchical
communities (G7) -> community reports (G8) -> term vectors (G2) -> postings
(R6).

Tables are written to ``{root}/{name}`` and read back, so later searches
scan stored, column-pruned parquet instead of replaying the build; the
written tables also cut the lineage of the iterative community step.
``root`` defaults to a folder under the session's reliable checkpoint
directory (shared storage on a cluster).
"""

from __future__ import annotations

import hashlib
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbforge.operators.chunking import chunk_documents
from kbforge.operators.communities import community_reports, hierarchical_communities
from kbforge.operators.graph import (
    NAME_FILTER,
    admitted_mentions,
    copies_of,
    entity_table,
    mentions_of,
    named_and_said,
    named_stats,
    names_held,
    number_pairs,
    numbered,
    said_descriptions,
    with_names,
)
from kbforge.operators.ingest import compose_document
from kbforge.operators.page_parse import scrape_parsed
from kbforge.operators.postings import load_postings, write_postings
from kbforge.operators.vector_index import load_vector_index, write_vector_index
from kbforge.operators.vectors import unit_vectors
from kbforge.session import bounded_batches, ensure_checkpoint_dir, materialize, spread
from kbforge.sources.writers import latest_by_key, write_vectors
from kbforge.sources.readers import KNOWLEDGE_SCHEMAS, read_table

INDEX_TABLES = (
    "text_units", "mentions", "entities", "relationships", "communities", "community_reports", "embeddings", "idf",
)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def _files(spark: SparkSession, folder: str) -> list[str]:
    """Name, size and time of change of the files in a folder (or of a file)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in fs.listStatus(p))


def default_root(spark: SparkSession, sf_dir: str, source: str = "documents") -> str:
    """Folder of the index of a data directory's documents (or pages) as they
    are now: changed input gets another folder, never a stale index."""
    seen = _files(spark, f"{sf_dir.rstrip('/')}/{source}.parquet")
    key = hashlib.md5("\n".join([sf_dir.rstrip("/"), *seen]).encode()).hexdigest()[:12]
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/kbforge-index/{key}"


def _unmark(spark: SparkSession, root: str) -> None:
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/_built")
    marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(marker, True)


def build_index(spark: SparkSession, docs: DataFrame, root: str, keep_postings: bool = False, name_filter: dict = NAME_FILTER) -> dict[str, DataFrame]:
    """Compute and write every knowledge table under ``root``.  The marker that
    ``index_for`` looks for goes first and comes back last, so a build that
    was broken off is never read.  ``name_filter={}`` indexes every name;
    ``keep_postings`` leaves postings of the
    same documents that are already there."""
    _unmark(spark, root)
    units = chunk_documents(docs).withColumn("doc_id", F.col("doc_id").cast("string"))
    units.write.mode("overwrite").parquet(f"{root}/text_units")
    units = spark.read.parquet(f"{root}/text_units")

    named, said = named_and_said(units)
    ents = materialize(named_stats(named, **name_filter))
    adm = admitted_mentions(mentions_of(named), ents)
    # Found once per text, kept for every unit that holds the text.
    per_text = adm.groupBy(F.col("name").alias("entity_id"), F.col("unit_id").alias("first_id")).agg(
        F.count(F.lit(1)).alias("n")
    )
    per_text.join(copies_of(units), "first_id").select("entity_id", "unit_id", "n").write.mode("overwrite").parquet(
        f"{root}/mentions"
    )

    ids = numbered(ents)
    rels = with_names(number_pairs(names_held(named), ids), ids, "src", "dst")
    rels.withColumn("description", F.concat_ws(" -- ", "src", "dst")).write.mode("overwrite").parquet(
        f"{root}/relationships"
    )
    rels = spark.read.parquet(f"{root}/relationships")

    entity_table(ents, said_descriptions(ents, said), rels).write.mode("overwrite").parquet(f"{root}/entities")
    entities = spark.read.parquet(f"{root}/entities")

    def vectors_and_postings() -> None:
        # G2 + S8: unit vectors (full overwrite, as the vector store config asks)
        vecs, idf = unit_vectors(units)
        idf.write.mode("overwrite").parquet(f"{root}/idf")
        write_vectors(vecs.select(F.col("owner_id"), F.lit("text_unit").alias("kind"), "vector"), f"{root}/embeddings")
        if not (keep_postings and _exists(spark, f"{root}/postings/_built")):
            own_id = F.col("doc_id").cast(docs.schema["doc_id"].dataType)
            _build_postings(spark, units.withColumn("doc_id", own_id), f"{root}/postings")

    # Both need the units only; the many small steps of the hierarchy leave cores free.
    bounded_batches(spark)
    with ThreadPoolExecutor(1) as beside:
        written = beside.submit(inheritable_thread_target(spark)(vectors_and_postings))
        hierarchical_communities(entities, rels).write.mode("overwrite").partitionBy("level").parquet(
            f"{root}/communities"
        )
        comms = spark.read.parquet(f"{root}/communities")
        community_reports(comms, entities, rels).write.mode("overwrite").parquet(f"{root}/community_reports")
        written.result()
    _mark(spark, root)
    return load_index(spark, root)


def _mark(spark: SparkSession, root: str) -> None:
    spark.createDataFrame([("ok",)], "status string").write.mode("overwrite").json(f"{root}/_built")


def _build_postings(spark: SparkSession, units: DataFrame, root: str) -> None:
    _unmark(spark, root)
    write_postings(units, root)
    _mark(spark, root)


def postings_for(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The inverted index of a driver data directory's text units, built once
    per checkpoint folder and reused by every lexical search."""
    root = f"{default_root(spark, sf_dir)}/postings"
    if not _exists(spark, f"{root}/_built"):
        _build_postings(spark, chunk_documents(spread(read_table(spark, sf_dir, "documents"))), root)
    return load_postings(spark, root)


def page_index_for(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """Pages made searchable: ``(postings, text_units, documents)``, built once
    per checkpoint folder.  Each page is parsed once and composed into a
    document; of pages with the same document id the latest stays.
    ``documents`` has the id, address, title, category (the address's host) and
    description of each, without its text."""
    root = default_root(spark, sf_dir, "pages")
    if not _exists(spark, f"{root}/_built"):
        _unmark(spark, root)
        scraped = scrape_parsed(spread(read_table(spark, sf_dir, "pages")))
        composed = compose_document(scraped.withColumn("found", F.struct("metadata.title", "metadata.description")), carry=("found",))
        composed.write.mode("overwrite").parquet(f"{root}/composed")
        latest = latest_by_key(spark.read.parquet(f"{root}/composed"), "doc_id", "page_id")
        host = F.parse_url(F.col("url"), F.lit("HOST"))
        latest.select("doc_id", "page_id", "url", "found.*", host.alias("category")).write.mode("overwrite").parquet(f"{root}/documents")
        chunk_documents(latest).write.mode("overwrite").parquet(f"{root}/text_units")
        write_postings(spark.read.parquet(f"{root}/text_units"), f"{root}/postings")
        _mark(spark, root)
    return load_postings(spark, f"{root}/postings"), spark.read.parquet(f"{root}/text_units"), spark.read.parquet(f"{root}/documents")


def load_index(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    out = {}
    for name in INDEX_TABLES:
        df = spark.read.parquet(f"{root}/{name}")
        if name in KNOWLEDGE_SCHEMAS:
            df = df.select(*[F.col(f.name).cast(f.dataType) for f in KNOWLEDGE_SCHEMAS[name].fields])
        out[name] = df
    return out


def index_for(spark: SparkSession, sf_dir: str, rebuild: bool = False) -> dict[str, DataFrame]:
    """The knowledge tables of a driver data directory, built once per
    checkpoint folder and reused afterwards."""
    root = default_root(spark, sf_dir)
    if not rebuild and _exists(spark, f"{root}/_built"):
        return load_index(spark, root)
    return build_index(spark, spread(read_table(spark, sf_dir, "documents")), root, keep_postings=not rebuild)


def vector_index_for(spark: SparkSession, sf_dir: str) -> tuple[dict, DataFrame]:
    """The approximate index over the unit vectors of a driver data directory
    and the corpus IDF, built once per checkpoint folder."""
    root = f"{default_root(spark, sf_dir)}/vector-index"
    if not _exists(spark, f"{root}/_built"):
        _unmark(spark, root)
        vectors, idf = unit_vectors(chunk_documents(spread(read_table(spark, sf_dir, "documents"))))
        idf.write.mode("overwrite").parquet(f"{root}/idf")
        write_vector_index(vectors, root, item_id="owner_id")
        _mark(spark, root)
    return load_vector_index(spark, root), spark.read.parquet(f"{root}/idf")
