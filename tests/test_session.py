"""Session helpers the scale design relies on."""

from kbforge.session import broadcast_if_small, ensure_checkpoint_dir, materialize, spread


def _is_broadcast_hinted(df):
    return "broadcast" in df._jdf.queryExecution().logical().toString().lower()


def test_broadcast_only_within_bound(spark):
    small = spark.range(10)
    assert _is_broadcast_hinted(broadcast_if_small(small, 10))
    assert not _is_broadcast_hinted(broadcast_if_small(small, 9))


def test_materialize_writes_into_checkpoint_folder(spark):
    df = spark.range(100).selectExpr("id", "id * 2 AS twice")
    out = materialize(df)
    from urllib.parse import urlparse

    root = urlparse(ensure_checkpoint_dir(spark)).path.rstrip("/")
    files = [urlparse(f).path for f in out.inputFiles()]
    assert files and all(f.startswith(root + "/kbforge-tables/") for f in files)
    assert out.count() == 100 and out.agg({"twice": "sum"}).collect()[0][0] == 9900


def test_spread_only_small_scans(spark):
    target = spark.sparkContext.defaultParallelism
    one = spark.range(0, 1000, numPartitions=1)
    assert spread(one).rdd.getNumPartitions() == target
    many = spark.range(0, 1000, numPartitions=target + 3)
    assert spread(many).rdd.getNumPartitions() == target + 3
