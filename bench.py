"""Benchmark the headline queries.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, default all headline queries).

Each query is run to completion through the ``noop`` sink (every row is
computed, nothing is collected) and timed by wall clock, after one untimed
warm-up query on the sf0.001 tables.  The index build
(chunk -> graph -> communities -> reports, written as parquet) is timed on
its own before the searches that read it.  Prints one JSON line on stdout.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "chunk_documents",
    "lexical_topk",
    "context_pack",
    "main_text",
    "compose_document",
    "host_catalog",
    "factual_accuracy",
    "bleu",
    "eval_report",
    "entities_nlp",
    "relationships",
    "merge_descriptions",
    "components",
    "tfidf_weights",
    "vector_topk",
    "vector_search",
    "format_answer_ui",
    "pair_turns",
    "dedupe_requests",
    "index_build",
    "global_search",
    "local_search",
    "route_requests",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]

    from kbforge.plans import QUERIES
    from kbforge.plans.index_build import build_index, default_root
    from kbforge.session import build_session, spread
    from kbforge.sources.readers import read_table

    scratch = tempfile.mkdtemp(prefix="kbforge-bench-")
    spark = build_session(
        f"local[{cpus}]",
        shuffle_partitions=cpus * 2,
        extra_conf={
            "spark.driver.memory": "16g",
            "spark.local.dir": scratch,
            "spark.sql.files.maxPartitionBytes": str(32 * 1024 * 1024),
        },
    )
    spark.sparkContext.setCheckpointDir(f"{scratch}/checkpoints")
    # Untimed warm-up on the smallest tables: JVM start-up and JIT of the
    # text expressions would otherwise be charged to the first query.
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir):
        QUERIES["context_pack"](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        t0 = time.time()
        if name == "index_build":
            build_index(spark, spread(read_table(spark, sf_dir, "documents")), default_root(spark, sf_dir))
        else:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr)
    spark.stop()
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(
        json.dumps(
            {
                "metric": "total_query_wall_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf,
                "cpus": cpus,
                "warmup": "context_pack on sf0.001, untimed",
            }
        )
    )


if __name__ == "__main__":
    main()
