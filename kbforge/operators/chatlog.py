"""Conversation log operators.

The log is append-only per conversation; turn numbers rise but can have gaps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def turn_log(turns: DataFrame) -> DataFrame:
    """The log in arrival order (a range-partitioned global sort).

    Errors never reach the log, so every row is a user, assistant or
    system turn."""
    return turns.select("conv_id", "turn", "role", F.length("text").alias("n_chars")).orderBy("conv_id", "turn")


# Turns of a conversation that are looked at in one task.
TURN_BLOCK = 1024


def pair_turns(turns: DataFrame) -> DataFrame:
    """Each user turn with the next logged turn of its conversation, if
    that is an assistant turn; ``answered`` is false otherwise (a failed
    query).

    The next turn is found inside blocks of ``TURN_BLOCK`` turn numbers, so a
    conversation with a third of all turns is spread over many tasks; the last
    turn of a block looks at the first turn of the conversation's next block,
    through a table of one row per block.
    """
    t = turns.select("conv_id", "turn", "role", "text", F.floor(F.col("turn") / TURN_BLOCK).alias("_b"))
    first = t.groupBy("conv_id", "_b").agg(F.min_by(F.struct("role", "text"), "turn").alias("_first"))
    w = Window.partitionBy("conv_id").orderBy("_b")
    after = first.select("conv_id", "_b", F.lead("_first").over(w).alias("_after"))
    inside = Window.partitionBy("conv_id", "_b").orderBy("turn")
    users = t.withColumn("_next", F.lead(F.struct("role", "text")).over(inside)).where(F.col("role") == "user")
    nxt = F.coalesce("_next", "_after")
    answer = F.when(nxt["role"] == "assistant", nxt["text"])
    return users.join(after, ["conv_id", "_b"], "left").select(
        "conv_id", "turn", F.col("text").alias("query"), answer.alias("answer"), answer.isNotNull().alias("answered")
    )


def usage_counts(turns: DataFrame) -> DataFrame:
    """C4: turns and mean length per role (map-side partial aggregates)."""
    return turns.groupBy("role").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.round(F.avg(F.length("text")), 6).alias("avg_chars"),
        F.countDistinct("conv_id").alias("n_conversations"),
    )
