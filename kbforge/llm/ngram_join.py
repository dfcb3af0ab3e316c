"""Operator 8: n-gram Jaccard self-join over a token-group matrix.

1. Texts become sets of hashed word shingles; equal sets are one class.
2. Classes are partitioned into groups of similar ones: equal min-hash, and a
   bounded number of shingles, beyond which a group is split by a hash.
3. The token-group matrix holds which groups a shingle occurs in: of each set
   the first few in one order of all shingles, so many that similar sets share
   some of them.  Frequent shingles come last in the order, so that passages
   many documents share hardly meet.
4. The rows of the matrix that two groups share bound the overlap of any two of
   their sets; only pairs of groups that can qualify are brought together.
   There, for each set of the one, the overlap with the other's union of
   shingles is counted in full; only groups that still qualify are opened, and
   the overlaps with all their members are counted exactly.
5. A group pair returns links that join its members' components; the
   components of all links are found by star operations.  Groups are compared
   in two steps, first within themselves and by one set each, so that groups of
   near-copies that are joined by then need not be opened for each other.
   In both steps groups that are candidates of one hub, the smallest group
   that they are paired with, travel together as one pack of bounded size, so a
   set is sent once to each pack and not once to each group of a large cluster.

No pair is lost: the order is the same for all sets whichever shingles are
held to be frequent, and groups are compared member by member.

Defined results: a text without words (null, empty) has no shingles and links
with nothing; a text of fewer words than a shingle is one shingle; repeated
rows and rows of equal sets are linked; null ids count as larger than all
others and are returned as null; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbforge.llm.common import stored, whole_row, whole_text
from kbforge.llm.components import components
from kbforge.llm.shingles import mix, shingle_sets
from kbforge.session import broadcast_if_small

WIDTH = 4
PERCENT = 85
#: Salts of the min-hashes that sets of a group have in common.
MIN_HASHES = (0x5DEECE66D, 0x2545F4914F6CDD1D)
#: A group holds about so many shingles at most, unless one set has more.
GROUP_SHINGLES = 150_000
#: The most frequent shingles, this many at most (16 MB), have levels by the
#: logarithm of their counts; the order of shingles goes by level, then hash.
FREQUENT, FREQUENT_LEAST = 1 << 20, 8
#: A task counts so many shingles at a time, and returns those it has met in
#: two different sets at least.
LOCAL_SHINGLES, LOCAL_LEAST = 4_000_000, 2

#: Classes whose texts are fetched: their keys are broadcast up to this many
#: rows of 40 bytes.
BROADCAST_ROWS = 100_000

KEY = "struct<a:long,b:long>"


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def set_key(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    a = mix(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    b = mix(tokens + np.uint64(0x0123456789ABCDEF)).sum(dtype=np.uint64)
    pair = mix(np.array([a ^ np.uint64(len(tokens)), b], np.uint64)).view(np.int64)
    return int(pair[0]), int(pair[1])


def _similar(s: np.ndarray) -> int:
    """Equal for sets that are probably similar: a few min-hashes and the size,
    in steps of a sixth."""
    if not len(s):
        return 0
    x = np.uint64(int(np.log(len(s)) * 6))
    for salt in MIN_HASHES:
        x = mix(mix(s ^ np.uint64(salt)).min(keepdims=True) + x)
    return int(_signed(x)[0])


def least_overlap(n: int, percent: int) -> int:
    """Shared shingles that a set of ``n`` needs with any partner."""
    return -(-percent * n // 100)


def _frequent(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the most frequent shingles, sorted, and their levels.  The
    counts need not be exact: any order that all sets share will do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}  # equal sets count once
        size = 0

        def counted() -> pa.RecordBatch:
            token, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held.values()]), return_counts=True)
            often = n >= LOCAL_LEAST
            return pa.RecordBatch.from_arrays([pa.array(_signed(token[often])), pa.array(n[often].astype(np.int64))], ["token", "n"])

        for batch in batches:
            for s in shingle_sets(batch.column(0), width):
                key = set_key(s)
                if key not in held:
                    held[key] = s
                    size += len(s)
            if size >= LOCAL_SHINGLES:
                yield counted()
                held, size = {}, 0
        yield counted()

    counts = docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    often = counts.where(F.col("n") > FREQUENT_LEAST).orderBy(F.desc("n"), "token").limit(FREQUENT).toPandas()
    token = often.token.to_numpy(np.int64).view(np.uint64)
    by_hash = np.argsort(token)
    return token[by_hash], np.log2(often.n.to_numpy(float)).astype(np.int8)[by_hash]


def _ordered_prefix(tokens: np.ndarray, n: int, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first ``n`` of a set sorted by hash, by level and then by hash."""
    table, levels = frequent

    def level(x: np.ndarray) -> np.ndarray:
        if not len(table):
            return np.zeros(len(x), np.int8)
        at = np.minimum(np.searchsorted(table, x), len(table) - 1)
        return np.where(table[at] == x, levels[at], 0)

    look = min(len(tokens), 2 * n + 8)
    of = level(tokens[:look])
    if look < len(tokens) and np.count_nonzero(of == 0) < n:
        of = level(tokens)
    return tokens[: len(of)][np.argsort(of, kind="stable")[:n]]


def sets(docs: DataFrame, frequent, width: int, percent: int) -> DataFrame:
    """``(doc_id, t, key, n, similar, prefix)`` of ``docs(doc_id, text)``:
    a hash of the text, the set's key, size, min-hash and first shingles."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = frequent.value
        for batch in batches:
            keys, n, similar, prefix = [], [], [], []
            for s in shingle_sets(batch.column(1), width):
                keys.append(dict(zip("ab", set_key(s), strict=True)))
                n.append(len(s))
                similar.append(_similar(s))
                prefix.append(_signed(_ordered_prefix(s, len(s) - least_overlap(len(s), percent) + 1, often)) if len(s) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array(keys, pa.struct([("a", pa.int64()), ("b", pa.int64())])),
                    pa.array(n, pa.int64()),
                    pa.array(similar, pa.int64()),
                    pa.array(prefix, pa.list_(pa.int64())),
                ],
                ["doc_id", "t", "key", "n", "similar", "prefix"],
            )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("t")).mapInArrow(run, f"doc_id {kind}, t long, key {KEY}, n long, similar long, prefix array<long>")


class _Links:
    """Union-find that keeps the links which joined something."""

    def __init__(self, n: int):
        self.up, self.kept = list(range(n)), []

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def add(self, x: int, y: int) -> None:
        a, b = self.find(x), self.find(y)
        if a != b:
            self.up[a] = b
            self.kept.append((x, y))


def compare_groups(queries: list[np.ndarray], members: list[np.ndarray], same: bool, percent: int) -> list[tuple[int, int]]:
    """Links between sets of two groups (or inside one), as (place, place)
    with members after queries; of those that join the same sets, some."""
    off = 0 if same else len(queries)
    links = _Links(off + len(members))
    sizes = np.array([len(x) for x in members], np.int64)
    flat = np.concatenate(members)
    who = np.repeat(np.arange(len(members)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, who = flat[order], who[order]
    union, first = np.unique(flat, return_index=True)
    ends = np.append(first[1:], len(flat))
    for i, s in enumerate(queries):
        at = np.searchsorted(union, s)
        at[at == len(union)] = 0
        at = at[union[at] == s]
        if len(at) * 100 < percent * len(s):
            continue  # the union shares too little: no member can qualify
        lo, n = first[at], ends[at] - first[at]
        total = int(n.sum())
        place = np.arange(total) + np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        shared = np.bincount(who[place], minlength=len(members))
        for j in np.flatnonzero(shared * (100 + percent) >= percent * (len(s) + sizes)).tolist():
            if not (same and j <= i):
                links.add(i, off + j)
    return links.kept


def _open(percent: int, width: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = shingle_sets(pa.array(pdf.text.tolist(), pa.string()), width)
        keys = list(zip(pdf.a.tolist(), pdf.b.tolist(), strict=True))
        mine = pdf.group.to_numpy() == pdf.low.to_numpy()
        left, right = np.flatnonzero(mine), np.flatnonzero(~mine)
        same = not len(right)
        a = [found[i] for i in left]
        b = a if same else [found[i] for i in right]
        both = left if same else np.concatenate([left, right])
        links = compare_groups(a, b, same, percent) if len(a) and len(b) else []
        rows = [(*keys[both[x]], *keys[both[y]]) for x, y in links]
        return pd.DataFrame(rows, columns=["a1", "b1", "a2", "b2"]).astype("int64")

    return run


def _packed(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """Pairs of packs for the pairs of groups ``pairs(low, high)``: rows
    ``(low, high, pack, group)`` of the groups that take part in a pair of
    packs.  ``weights(group, shingles)`` bounds a pack."""
    turned = pairs.select(F.col("high").alias("low"), F.col("low").alias("high"))
    hub = pairs.unionByName(turned).groupBy(F.col("low").alias("group")).agg(F.min("high").alias("other"))
    hub = hub.select("group", F.least("group", "other").alias("hub")).join(weights, "group")
    parts = hub.groupBy("hub").agg(F.ceil(F.sum("shingles") / GROUP_SHINGLES).alias("parts"))
    packs = stored(hub.join(parts, "hub").select("group", F.xxhash64("hub", F.pmod(F.xxhash64("group"), F.col("parts"))).alias("pack")))
    one, two = (packs.select(F.col("group").alias(g), F.col("pack").alias(f"pack{k}")) for k, g in enumerate(("low", "high")))
    both = pairs.join(one, "low").join(two, "high")
    end = F.explode(F.array(F.struct(F.col("pack0").alias("pack"), F.col("low").alias("group")), F.struct(F.col("pack1").alias("pack"), F.col("high").alias("group"))))
    return both.select(F.least("pack0", "pack1").alias("low"), F.greatest("pack0", "pack1").alias("high"), end.alias("end")).select("low", "high", "end.*").distinct()


def _links(docs: DataFrame, classes: DataFrame, needed: DataFrame, width: int, percent: int) -> DataFrame:
    """Links ``(u, v)`` between the sets that meet in a pair of groups
    (``needed(low, high, group, key)``).

    Texts are fetched once for the classes that take part, one row for each,
    and their sets are built again from them.
    """
    needed = stored(needed)
    wanted = classes.join(needed.select("key").distinct(), "key").select("key", F.col("one.doc_id").alias("one_id"), F.col("one.t").alias("t"))
    wanted = broadcast_if_small(stored(wanted), BROADCAST_ROWS)
    texts = docs.withColumn("t", F.xxhash64("text")).join(wanted, "t").where(F.col("doc_id").eqNullSafe(F.col("one_id")))
    texts = texts.dropDuplicates(["key"]).select("key", "text")
    opened = needed.join(texts, "key").select("low", "high", "group", F.col("key.a").alias("a"), F.col("key.b").alias("b"), "text")
    links = opened.groupBy("low", "high").applyInPandas(_open(percent, width), "a1 long, b1 long, a2 long, b2 long")
    end = lambda k: F.struct(F.col(f"a{k}").alias("a"), F.col(f"b{k}").alias("b"))
    return links.select(end(1).alias("u"), end(2).alias("v"))


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, t, n_shingles, root, component_id)`` of every row: ``t`` is a
    hash of its text, ``root`` the key of its component (null without words),
    ``component_id`` the smallest id in it."""
    spark = df.sparkSession
    docs = df.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    frequent = spark.sparkContext.broadcast(_frequent(docs, width))
    rows = stored(sets(docs, frequent, width, percent))
    # Groups that hold too many shingles are split; there are few, and they are
    # found before the sets' shingles move.
    some = rows.where("n > 0")
    large = some.select("key", "similar", "n").distinct().groupBy("similar").agg(F.ceil(F.sum("n") / GROUP_SHINGLES).alias("parts")).where("parts > 1")
    large = broadcast_if_small(stored(large), BROADCAST_ROWS)
    part = F.pmod(F.xxhash64("key.a"), F.coalesce("parts", F.lit(1)))
    grouped = some.join(large, "similar", "left").withColumn("group", F.xxhash64("similar", part))
    classes = stored(
        grouped.groupBy("key").agg(
            F.max("n").alias("n"), F.max("group").alias("group"), F.min("doc_id").alias("doc_id"), F.min(F.struct("doc_id", "t")).alias("one")
        )
    )
    sizes = classes.groupBy("group").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles"))
    matrix = grouped.select("group", F.explode("prefix").alias("token")).repartition("token").distinct()
    other = matrix.select("token", F.col("group").alias("other"))
    shared = matrix.join(other, "token").where(F.col("group") < F.col("other")).groupBy("group", "other").agg(F.count(F.lit(1)).alias("shared"))
    # Of two prefixes, one ends first; its set shares with the other what the
    # prefixes share, and at most all that follows it.
    one, two = (sizes.select(F.col("group").alias(g), F.col("low").alias(f"low{k}"), F.col("high").alias(f"high{k}")) for k, g in enumerate(("group", "other")))
    rest = F.floor((F.greatest("high0", "high1") * percent + 99) / 100) - 1
    needed_shared = F.ceil((F.col("low0") + F.col("low1")) * percent / (100 + percent)) - rest
    fits = (F.col("shared") >= needed_shared) & (F.col("low0") * percent <= F.col("high1") * 100) & (F.col("low1") * percent <= F.col("high0") * 100)
    between = shared.join(one, "group").join(two, "other").where(fits).select(F.col("group").alias("low"), F.col("other").alias("high"))
    between = stored(between)
    # First inside the groups, and one set of each group of a pair.
    first = classes.groupBy("group").agg(F.min("key").alias("key"))
    inside = classes.join(sizes.where("members > 1").select("group"), "group").select(F.col("group").alias("low"), F.col("group").alias("high"), "group", "key")
    firsts = _packed(between, sizes.select("group", F.col("high").alias("shingles"))).join(first, "group").select("low", "high", F.col("pack").alias("group"), "key")
    links = stored(_links(docs, classes, inside.unionByName(firsts), width, percent))
    roots = components(links)
    # A pair is settled if each group had one set, or all sets of both are in
    # one component by now; all sets of the others are compared.
    rooted = classes.join(roots.withColumnRenamed("node", "key"), "key", "left").groupBy("group").agg(
        F.min(F.coalesce("root", "key")).alias("least"), F.max(F.coalesce("root", "key")).alias("most"), F.count(F.lit(1)).alias("members")
    )
    one, two = (rooted.select(F.col("group").alias(g), F.col("least").alias(f"least{k}"), F.col("most").alias(f"most{k}"), F.col("members").alias(f"members{k}")) for k, g in enumerate(("low", "high")))
    settled = (F.col("members0") + F.col("members1") == 2) | ((F.col("least0") == F.col("most1")) & (F.col("least1") == F.col("most0")))
    rest = stored(between.join(one, "low").join(two, "high").where(~settled).select("low", "high"))
    if not rest.isEmpty():
        packs = _packed(rest, sizes.select("group", "shingles"))
        needed = packs.join(classes.select("group", "key"), "group").select("low", "high", F.col("pack").alias("group"), "key")
        more = _links(docs, classes, needed, width, percent)
        roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more))
    named = classes.select("key", "doc_id").join(roots.withColumnRenamed("node", "key"), "key", "left").select("key", "doc_id", F.coalesce("root", "key").alias("root"))
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    ids = named.join(smallest, "root").select("key", "root", "component_id")
    out = rows.select("doc_id", "t", "key", F.col("n").alias("n_shingles")).join(ids, "key", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "t", "n_shingles", "root", component.alias("component_id"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of ``df`` without near-duplicates: of each component the row of
    the smallest id (null last; then any of equal rows), and every text without
    words."""
    joined = stored(join(df, id_col, text_col, width, percent))
    member = joined.where("n_shingles > 0").select("root", F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), "t").alias("who"))
    best = member.groupBy("root").agg(F.min("who").alias("best"))
    lost = stored(member.join(best, "root").where(F.col("who") != F.col("best")).select("who").distinct())
    twice = stored(member.groupBy("who").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("who"))
    row = whole_row(df)
    who = F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id"), F.xxhash64(whole_text(text_col)).alias("t")).alias("who")
    rows = df.select(row, who).join(broadcast_if_small(lost, BROADCAST_ROWS), "who", "left_anti")
    if twice.isEmpty():
        return rows.select("row.*")
    twice = broadcast_if_small(twice, BROADCAST_ROWS)
    has_words = F.col(f"row.`{text_col}`").rlike(r"[^\x20\x09-\x0D]")
    again = rows.where(has_words).join(twice, "who", "left_semi").dropDuplicates(["who"])
    once = rows.where(~F.coalesce(has_words, F.lit(False))).unionByName(rows.where(has_words).join(twice, "who", "left_anti"))
    return once.unionByName(again).select("row.*")
