"""Connected components of a link table by alternating star operations.

Each round points the neighbours of a node at its smallest neighbour, first
the larger ones, then the smaller ones with the node itself; the table never
grows, and rounds go as the logarithm of the longest path.  A round's table is
written to the shared checkpoint folder, so nothing is computed twice and a
lost executor costs one round at most; the round before last is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbforge.llm.common import drop_stored, stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m"))
    return both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # Every edge points from the larger node to the smaller one here.
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _print(edges: DataFrame) -> tuple:
    """Count and order-free checksum of an edge table."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.pmod(h, F.lit(1 << 31))), F.bit_xor(h)).first())


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(u, v)`` but the roots
    themselves; ``root`` is the smallest node of the component.  Nodes can be
    of any type that has an order.  Loops and repeated links do no harm."""
    edges = stored(
        edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    before = _print(edges)
    while True:
        new = stored(_small_star(_large_star(edges)))
        after = _print(new)
        drop_stored(edges)
        edges = new
        if after == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after
