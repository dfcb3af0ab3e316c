"""Session construction and cluster-safe housekeeping."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job in this library is written against.  AQE re-plans joins
# from runtime sizes (sort-merge -> broadcast when a side turns out small),
# splits skewed shuffle partitions and coalesces tiny ones.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(
    master: str | None = None,
    app_name: str = "kbforge",
    shuffle_partitions: int | None = None,
    extra_conf: dict | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the library defaults.

    On a cluster pass ``master=None`` and let spark-submit decide; the
    shuffle partition count should then be sized to the data (roughly
    input bytes / 128 MB), not to the core count.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory of this session.

    The cluster names a shared folder in ``spark.checkpoint.dir``; we use it
    as given.  Only a local-mode session without one (tests, laptops) gets a
    fresh private folder.  A cluster session without a shared folder is an
    error: a machine-local folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if sc.master.startswith("local"):
        path = tempfile.mkdtemp(prefix="kbforge-ckpt-")
        sc.setCheckpointDir(path)
        return sc.getCheckpointDir()
    raise RuntimeError(
        "spark.checkpoint.dir is not set: iterative operators need a shared "
        "(HDFS/S3/ABFS) checkpoint folder on a cluster"
    )


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast ``df`` only when it provably holds at most ``max_rows`` rows.

    The check is a bounded action (``limit(max_rows + 1).count()``), so it
    never scans more than ``max_rows + 1`` rows of output.  Beyond the bound
    the frame is returned as it is and the planner shuffles (AQE may still
    turn the join into a broadcast from runtime statistics).
    """
    from pyspark.sql import functions as F

    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


#: Most bytes of a table that is sent to every executor for a join (a hash table
#: of it takes some five times as many).
MAX_SENT_BYTES = 32 << 20


def sent_if_small(df: DataFrame) -> DataFrame:
    """Broadcast a table of numbers and strings only if its values take at most
    ``MAX_SENT_BYTES``, so that a much larger one it is joined to isn't
    shuffled.  One aggregate over ``df`` tells; a larger one is returned as it is.
    """
    from pyspark.sql import functions as F

    texts = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    size = F.lit(8 * len(df.columns)).cast("long")
    for c in texts:
        size = size + F.coalesce(F.octet_length(c), F.lit(0))
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= MAX_SENT_BYTES else df


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage: write it as parquet into the
    session's reliable checkpoint folder and read it back.

    Used for intermediates that several branches of a plan read (Spark would
    otherwise recompute them per branch) and for every round of an
    iteration.  The folder is shared storage on a cluster, so a lost
    executor never forces upstream stages to run again.  A written table is
    used instead of ``Dataset.checkpoint``: one job instead of two (an
    unpersisted RDD checkpoint recomputes its input to write it), columnar
    and compressed, and later reads prune columns.  Never
    ``localCheckpoint``.
    """
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{root}/kbforge-tables/{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    return spark.read.parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the table behind a frame that ``materialize`` returned, once
    nothing reads it any more.  Other files are left alone."""
    spark = df.sparkSession
    conf = spark._jsc.hadoopConfiguration()
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if path.rsplit("/", 2)[-2] == "kbforge-tables":
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


#: Most rows and bytes of an Arrow batch of whole texts.
BATCH_ROWS = 1_000
BATCH_BYTES = 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Set these bounds on the session's Arrow batches; the default of 10,000
    rows of any size would need gigabytes in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def spread(df: DataFrame) -> DataFrame:
    """Give a text-heavy scan at least one partition per core.

    Regex and tokenising work is per row and CPU bound, so a small table
    read as fewer splits than the cluster has cores would leave cores idle.
    Only then is it round-robin repartitioned; a large input (many files and
    row groups) is left exactly as scanned, with no extra shuffle.
    """
    target = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df

