"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kbforge.session import ensure_checkpoint_dir, materialize
from kbforge.sources.readers import read_table

#: Rows and bytes of one Arrow batch handed to Python.  Texts can be long, so
#: the default of 10,000 rows would need gigabytes in a worker.
BATCH_ROWS = 512
BATCH_BYTES = 2 * 1024 * 1024

#: The ASCII white space of the word definition ``[^\x20\x09-\x0D]+``.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> None:
    """Checkpoint folder and Arrow batch limits of the session."""
    ensure_checkpoint_dir(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table; a table of fewer files than cores is dealt over the cores."""
    prepare(spark)
    df = read_table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def quoted(name: str) -> str:
    """A column's name as it is, whatever signs it holds."""
    return "`" + name.replace("`", "``") + "`"


def whole_row(df: DataFrame) -> Column:
    return F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("row")


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def text_key(c: Column) -> Column:
    """128 bits that stand for a text.  Rows are matched back to their results
    by content, never by a row number, so that a task which is run again after
    an executor was lost gives the same keys."""
    return F.struct(F.xxhash64(c).alias("a"), F.xxhash64(F.lit("second"), c).alias("b"))


def words(c: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in order."""
    trimmed = F.btrim(c, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared checkpoint folder and read it back."""
    return materialize(df)


def drop_stored(df: DataFrame) -> None:
    """Delete a table that ``stored`` wrote, once nothing reads it any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/kbforge-tables/" in path:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
