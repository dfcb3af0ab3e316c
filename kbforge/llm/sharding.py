"""Operator 5: shard placement by a permutation-filled lookup table.

Every shard has its own order of the slots of a prime-sized table: it starts
at one hash of its name and steps by another.  Shards take turns, each
claiming the next free slot of its order, until the table is full; a row
belongs to the shard that owns the slot its key hashes to.  Shards own equally
many slots (within one), and when a shard is added or lost few other slots
change hands.

The table has a fixed number of entries (a parameter), whatever the data, so
it is broadcast; placing a row takes one hash and one lookup and no shuffle.

Defined results: a row whose key is null is placed by its whole text instead
(null text: empty), so that rows without a key spread; equal rows go to the
same shard; other columns pass through, columns named like the outputs are
replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Slots: a prime at least a hundred times the number of shards.
TABLE_SIZE = 65_537
MAX_TABLE_SIZE = 1_000_003


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _hash(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{salt}:{name}".encode()).digest()[:8], "big")


def lookup_table(shards: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """For each slot the index of the shard that owns it.

    Turns go by index; the order of slots of a shard depends on its name only.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be given and differ")
    if not _is_prime(size) or not len(shards) <= size <= MAX_TABLE_SIZE:
        raise ValueError("the table size must be a prime between the number of shards and MAX_TABLE_SIZE")
    at = [_hash(s, "offset") % size for s in shards]
    step = [_hash(s, "skip") % (size - 1) + 1 for s in shards]
    owner = [-1] * size
    free = size
    while free:
        for k in range(len(shards)):
            while owner[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % size
            owner[at[k]] = k
            free -= 1
            if not free:
                break
    return owner


def place(df: DataFrame, shards: Sequence[str], key_col: str = "doc_id", text_col: str = "text", size: int = TABLE_SIZE) -> DataFrame:
    """``df`` with ``slot`` (int) and ``shard`` (name)."""
    spark = df.sparkSession
    table = pd.DataFrame({"slot": range(size), "shard": [shards[k] for k in lookup_table(shards, size)]})
    schema = T.StructType([T.StructField("slot", T.IntegerType()), T.StructField("shard", T.StringType())])
    owners = spark.createDataFrame(table, schema)
    key = F.when(F.col(key_col).isNotNull(), F.xxhash64(F.lit("key"), F.col(key_col).cast("string"))).otherwise(
        F.xxhash64(F.lit("text"), F.coalesce(F.col(text_col), F.lit("")))
    )
    rows = df.drop("slot", "shard").withColumn("slot", F.pmod(key, F.lit(size)).cast("int"))
    return rows.join(F.broadcast(owners), "slot").select(*[f"`{c}`" for c in df.columns if c not in ("slot", "shard")], "slot", "shard")


def write_shards(placed: DataFrame, path: str, files_per_shard: int = 1) -> None:
    """Write placed rows as ``path/shard=.../part-*.parquet``; a shard's rows
    are dealt over ``files_per_shard`` tasks by their slot."""
    n = F.pmod(F.xxhash64("slot"), F.lit(files_per_shard))
    placed.repartition("shard", n).write.mode("error").partitionBy("shard").parquet(path)
