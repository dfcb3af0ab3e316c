"""Operator 10: mixing sources to target weights by Sainte-Lague apportionment.

1. Sizes are word counts.  Sources in code-point order (null last) weigh 3, 1,
   2, repeating, and share 150 % of all words; a target stops at twice its
   source's size and the excess is shared again by weight.
2. Targets are cut into blocks of equal numbers of words, and sources get whole
   numbers of blocks by the highest quotients target / (2 * blocks + 1).
3. A source's documents are dealt over shards of bounded size by a seeded hash,
   and the source's blocks are apportioned to its shards in the same way.
4. A shard lays its words in a seeded order of documents and takes its quota of
   consecutive blocks, around the end if need be, from a seeded block on.

Only one row per source is ever in one task (step 2), and one row per shard of
a source (step 3); documents meet only inside a shard.

Defined results: a null text has no words and nothing is taken of it; a null
source is a source of its own, the last; documents of the same id are separate
rows; a document's words are taken at most twice each; an empty table gives an empty table.
The same rows give the same result, in any order and partitioning.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbforge.llm.common import SPACE_RUN, SPACES, stored, whole_text, words

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_PASSES = 2
SHARD_WORDS = 250_000
#: Blocks: the smallest target is cut into about this many.
BLOCKS_OF_SMALLEST = 1_024
MAX_BLOCK_WORDS = 4_096


def word_count(c: Column) -> Column:
    return F.size(words(c)).cast("long")


def sainte_lague(votes: np.ndarray, seats: int, caps: np.ndarray) -> np.ndarray:
    """Seats by highest quotients votes / (2 * seats + 1), at most ``caps``
    each; ties go to the first.  Fewer are given if the caps leave no room."""
    votes, caps = np.asarray(votes, float), np.asarray(caps, np.int64)
    total = votes.sum()
    if seats <= 0 or total <= 0:
        return np.zeros(len(votes), np.int64)
    # The rounded shares differ from the result by few seats; the quotients
    # decide those.
    got = np.minimum(np.floor(votes * (seats / total) + 0.5).astype(np.int64), caps)
    spare = seats - int(got.sum())
    if spare > 0:
        heap = [(-votes[i] / (2 * got[i] + 1), i) for i in range(len(votes)) if got[i] < caps[i] and votes[i] > 0]
        heapq.heapify(heap)
        while spare and heap:
            _, i = heapq.heappop(heap)
            got[i] += 1
            spare -= 1
            if got[i] < caps[i]:
                heapq.heappush(heap, (-votes[i] / (2 * got[i] + 1), i))
    elif spare < 0:
        heap = [(votes[i] / (2 * got[i] - 1), -i) for i in range(len(votes)) if got[i] > 0]
        heapq.heapify(heap)
        while spare:
            _, i = heapq.heappop(heap)
            got[-i] -= 1
            spare += 1
            if got[-i] > 0:
                heapq.heappush(heap, (votes[-i] / (2 * got[-i] - 1), i))
    return got


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MAX_PASSES) -> DataFrame:
    """``(source, source_size, weight, target)`` of a table of one row per source.

    Sources are filled to their limit in order of limit / weight; the first
    that stays below it fixes the level for itself and all after it.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.select("source", "source_size", w.alias("weight")).withColumn("limit", F.col("source_size") * most)
    by_fill = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    after = by_fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) * share - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    level = left / F.sum("weight").over(after)
    rows = rows.withColumn("level", level).withColumn("fits", F.col("limit") > F.col("level") * F.col("weight"))
    final = F.first(F.when(F.col("fits"), F.col("level")), ignorenulls=True).over(by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(F.col("limit"), F.coalesce(final * F.col("weight"), F.col("limit")))
    return rows.select("source", "source_size", "weight", target.cast("double").alias("target"))


def _source_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["rank"])
    positive = pdf.target[pdf.target >= 1]
    block = int(min(max(positive.min() // BLOCKS_OF_SMALLEST, 1), MAX_BLOCK_WORDS)) if len(positive) else 1
    caps = (MAX_PASSES * pdf.source_size.to_numpy()) // block
    blocks = sainte_lague(pdf.target.to_numpy(), int(round(pdf.target.sum() / block)), caps)
    return pdf.assign(block=block, blocks=blocks)[["rank", "source", "source_size", "target", "block", "blocks"]]


def _shard_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("shard")
    size = pdf.shard_size.to_numpy()
    quota = sainte_lague(size, int(pdf.blocks.iloc[0]), (MAX_PASSES * size) // pdf.block.to_numpy())
    return pdf.assign(quota=quota)[["rank", "shard", "shard_size", "block", "quota", "source_size", "target"]]


def _laid(df: DataFrame, seed: int, id_col: str, text_col: str, source_col: str, shard_words: int) -> DataFrame:
    """Rows with the whole passes over their shard (``full``) and the further
    word ranges taken of them (``ranges``, ends exclusive, maybe empty)."""
    base = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
        F.col(id_col).cast("string").alias("id"),
        F.col(source_col).alias("source"),
        word_count(whole_text(text_col)).alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.col(text_col)).alias("order"),
    )
    # Words are counted once for the totals, and once more with the rows.
    sizes = targets(base.groupBy("source").agg(F.sum("size").alias("source_size")))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    sources = stored(
        sizes.withColumn("rank", rank)
        .groupBy(F.lit(1).alias("all"))
        .applyInPandas(_source_blocks, "rank long, source string, source_size long, target double, block long, blocks long")
    )
    n_shards = F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1))
    # One row per source; names are matched null-safely.
    rows = base.join(sources.select("rank", F.col("source").alias("name"), n_shards.alias("n_shards")), F.col("source").eqNullSafe(F.col("name")))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "order"), F.col("n_shards"))).drop("name", "n_shards", "source")
    shards = rows.groupBy("rank", "shard").agg(F.sum("size").alias("shard_size"))
    quotas = stored(
        shards.join(sources.drop("source"), "rank")
        .groupBy("rank")
        .applyInPandas(_shard_blocks, "rank long, shard long, shard_size long, block long, quota long, source_size long, target double")
    )
    place = Window.partitionBy("rank", "shard").orderBy("order", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = rows.withColumn("start", F.coalesce(F.sum("size").over(place), F.lit(0).cast("long"))).join(quotas, ["rank", "shard"])
    total = F.col("quota") * F.col("block")
    full = F.when(F.col("shard_size") > 0, F.floor(total / F.col("shard_size"))).otherwise(F.lit(0)).cast("long")
    laid = laid.withColumn("full", full).withColumn("rest", total - F.col("full") * F.col("shard_size"))
    blocks = F.greatest(F.floor(F.col("shard_size") / F.col("block")), F.lit(1))
    laid = laid.withColumn("from", F.pmod(F.xxhash64(F.lit(seed), F.lit("from"), "rank", "shard"), blocks) * F.col("block"))
    end, to = F.col("start") + F.col("size"), F.col("from") + F.col("rest")
    zero = F.lit(0).cast("long")

    def overlap(a: Column, b: Column) -> Column:
        first = F.greatest(F.col("start"), a)
        return F.struct((first - F.col("start")).alias("a"), (F.greatest(F.least(end, b), first) - F.col("start")).alias("b"))

    ranges = F.array(overlap(F.col("from"), F.least(to, F.col("shard_size"))), overlap(zero, to - F.col("shard_size")))
    return laid.select("row", "size", "source_size", "target", "full", ranges.alias("ranges"))


def mix(df: DataFrame, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shard_words: int = SHARD_WORDS) -> DataFrame:
    """``(row, size, source_size, target, taken)``; ``row`` holds the columns of ``df``."""
    taken = F.col("full") * F.col("size")
    for k in range(2):
        taken = taken + F.col("ranges")[k]["b"] - F.col("ranges")[k]["a"]
    return _laid(df, seed, id_col, text_col, source_col, shard_words).select("row", "size", "source_size", "target", taken.cast("long").alias("taken"))


def word_range(c: Column, a: Column, b: Column) -> Column:
    """The words from place ``a`` to before place ``b`` of a text, with the
    white space between them as it is."""
    a, b = a.cast("int"), b.cast("int")
    rest = F.get(F.split(F.btrim(c, F.lit(SPACES)), SPACE_RUN, a + 1), a)
    after = F.coalesce(F.get(F.split(rest, SPACE_RUN, b - a + 1), b - a), F.lit(""))
    return F.rtrim(F.substring(rest, F.lit(1), F.char_length(rest) - F.char_length(after)), F.lit(SPACES))


def materialise_mix(
    df: DataFrame, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shard_words: int = SHARD_WORDS
) -> DataFrame:
    """The mixed rows themselves: a document as often as it is taken whole, and
    a row with the words taken for each range that is a part of it, so the
    words of a source add up to those that the mix takes (a document without
    words stays; the other columns of a part are those of its document)."""
    size = F.col("size")
    whole = F.struct(F.lit(0).cast("long").alias("a"), size.alias("b"))
    some = F.concat(F.array_repeat(whole, F.col("full").cast("int")), F.filter("ranges", lambda r: r["b"] > r["a"]))
    laid = _laid(df, seed, id_col, text_col, source_col, shard_words)
    parts = laid.select("row", "size", F.explode(F.when(size == 0, F.array(whole)).otherwise(some)).alias("part"))
    text, a, b = F.col("row")[text_col], F.col("part.a"), F.col("part.b")
    cut = F.when(b - a == size, text).otherwise(word_range(text, a, b))
    return parts.select(*[cut.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in df.columns])
