"""Operator 9: embedding near-duplicates by a robust-pruned flat graph.

1. Equal vectors are one class; only classes are compared.
2. Centroids are fitted on a bounded sample.  Every class is indexed, in the
   shards of its nearest few centroids, so shards overlap; a shard of many
   classes is split into blocks by a hash.
3. In every block each class gets the neighbours that robust pruning leaves of
   its nearest ones: a candidate falls to a kept neighbour that is closer to it
   by a factor.  The adjacency lists of a class from all its blocks are united.
4. In every pair of blocks of a shard all classes are queries: a greedy search
   starts at the medoid (and at the query's own node), and the range is then
   expanded through every neighbour that is near it.
5. Every link is verified by its cosine in double precision.  A pair is counted
   in one shard only, the first that both classes are in.  A block pair returns
   counts, and links that join components; never all pairs.

The graph is approximate, so every run audits itself: the classes of the
vectors whose id is divisible by ``AUDITED`` (by its hash, if ids are not
integers) are compared with all classes by brute force, in blocks, and if less
than ``MIN_RECALL`` of their links were found, overlap and beam are doubled and
the search runs again; after ``WIDENINGS`` times it raises.  ``recall`` measures
a result in the same way.  A verified link is never wrong.

Defined results: a vector that is null, empty, zero or holds null or
non-finite components links with nothing, as do vectors of different lengths
with each other; repeated rows link; an empty table gives an empty table;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbforge.llm.common import stored
from kbforge.llm.components import components

THRESHOLD = 0.95
#: Classes that centroids are fitted on at most, classes for each centroid,
#: and centroids at most (a table of this size is sent to every task).
SAMPLE, PER_CENTROID, MAX_CENTROIDS = 20_000, 1_500, 1_024
#: Shards that a class is in.
OVERLAP = 3
#: Classes in a block, nearest candidates, neighbours kept, pruning factor.
BLOCK, CANDIDATES, DEGREE, ALPHA = 2_000, 48, 16, 1.2
#: Beam of the greedy search, and slack under the threshold inside which the
#: range is still expanded.
BEAM, SLACK = 16, 0.05
#: Queries that a task searches for at a time, and numbers of vectors that it
#: compares at a time (32 MB of each side).
QUERIES_AT_ONCE, NUMBERS_AT_ONCE = 256, 1 << 22

#: One in so many vectors is audited; the least share of their links that must
#: be found; how often overlap and beam are doubled to reach it.
AUDITED, MIN_RECALL, WIDENINGS = 100, 0.9, 3

KEY = "struct<a:long,b:long>"


def _unit(vectors) -> np.ndarray:
    v = np.stack([np.asarray(x, np.float64) for x in vectors])
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def fit_centroids(units: np.ndarray, k: int, rounds: int = 6, seed: int = 0) -> np.ndarray:
    """Spherical k-means on a sample."""
    pick = np.random.default_rng(seed).choice(len(units), min(k, len(units)), replace=False)
    centroids = units[np.sort(pick)]
    for _ in range(rounds):
        near = (units @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, units)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norm > 0, sums / np.maximum(norm, 1e-300), centroids)
    return centroids


def robust_prune(sims: np.ndarray, degree: int = DEGREE, candidates: int = CANDIDATES, alpha: float = ALPHA) -> np.ndarray:
    """Neighbours of every node (n x degree, -1 where there is none) from all
    similarities: the nearest candidate is kept, and drops those to which it
    is nearer than the node is, by the factor alpha; then the next."""
    n = len(sims)
    c = min(candidates, n - 1)
    if c < 1:
        return np.full((n, degree), -1)
    own = sims.copy()
    np.fill_diagonal(own, -np.inf)
    near = np.argpartition(-own, c - 1, axis=1)[:, :c]
    order = np.argsort(-np.take_along_axis(own, near, 1), axis=1, kind="stable")
    near = np.take_along_axis(near, order, 1)
    far = np.sqrt(np.maximum(2 - 2 * np.take_along_axis(sims, near, 1), 0))  # distances
    alive = np.ones((n, c), bool)
    out = np.full((n, degree), -1)
    rows = np.arange(n)
    for k in range(min(degree, c)):
        pick = alive.argmax(axis=1)
        some = alive[rows, pick]
        out[some, k] = near[rows[some], pick[some]]
        kept = near[rows, pick]
        between = np.sqrt(np.maximum(2 - 2 * sims[kept[:, None], near], 0))
        alive &= ~(some[:, None] & (alpha * between <= far))
        alive[rows[some], pick[some]] = False
    return out


def range_search(units: np.ndarray, adjacency: tuple[np.ndarray, np.ndarray], queries: np.ndarray, own: np.ndarray, threshold: float, beam: int = BEAM, slack: float = SLACK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(queries, nodes)`` index arrays of verified links, from a greedy
    search for some queries at a time that starts at the medoid and, if the
    query is a node itself (``own``, else -1), there.  ``adjacency`` is where
    each node's list starts (and the last one ends) and the lists."""
    medoid = int((units @ units.mean(axis=0)).argmax())
    for first in range(0, len(queries), QUERIES_AT_ONCE):
        part = slice(first, first + QUERIES_AT_ONCE)
        for q, nodes in _range_search(units, adjacency, queries[part], own[part], medoid, threshold, beam, slack):
            yield q + first, nodes


def _lists(adjacency: tuple[np.ndarray, np.ndarray], nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes' lists one after the other, and the place of the node of each."""
    starts, flat = adjacency
    count = starts[nodes + 1] - starts[nodes]
    at = np.arange(count.sum()) + np.repeat(starts[nodes] - (np.cumsum(count) - count), count)
    return np.repeat(np.arange(len(nodes)), count), flat[at]


def _range_search(units, adjacency, queries, own, medoid: int, threshold: float, beam: int, slack: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    n, m = len(units), len(queries)
    at_once = max(1, NUMBERS_AT_ONCE // units.shape[1])
    seen = np.zeros((m, n), bool)
    seen[:, medoid] = True
    ids = np.full((m, beam), -1)
    sims = np.full((m, beam), -np.inf)
    done = np.ones((m, beam), bool)
    ids[:, 0], sims[:, 0], done[:, 0] = medoid, queries @ units[medoid], False
    mine = np.flatnonzero(own >= 0)
    seen[mine, own[mine]] = True
    ids[mine, 1], sims[mine, 1], done[mine, 1] = own[mine], 1.0, False
    hit, close = np.flatnonzero(sims[:, 0] >= threshold), np.flatnonzero(sims[:, 0] >= threshold - slack)
    found = [(hit, np.full(len(hit), medoid))]
    frontier = [(close, np.full(len(close), medoid)), (mine, own[mine])]

    def visit(q: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The unseen neighbours of (query, node) pairs, with similarities."""
        out = []
        # as many pairs at a time as have ``at_once`` neighbours (one at least)
        ends = np.cumsum(adjacency[0][nodes + 1] - adjacency[0][nodes])
        at = 0
        while at < len(q):
            till = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + at_once, "right")))
            row, near = _lists(adjacency, nodes[at:till])
            who = q[at:till][row]
            at = till
            new = ~seen[who, near]
            flat = np.unique(who[new] * n + near[new])
            who, near = flat // n, flat % n
            seen[who, near] = True
            s = np.concatenate([np.einsum("ij,ij->i", queries[who[i : i + at_once]], units[near[i : i + at_once]]) for i in range(0, max(1, len(who)), at_once)])
            hit = s >= threshold
            found.append((who[hit], near[hit]))
            close = s >= threshold - slack
            frontier.append((who[close], near[close]))
            out.append((who, near, s))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    while True:
        open_sims = np.where(done, -np.inf, sims)
        best = open_sims.argmax(axis=1)
        q = np.flatnonzero(open_sims[np.arange(m), best] > -np.inf)
        if not len(q):
            break
        done[q, best[q]] = True
        who, near, s = visit(q, ids[q, best[q]])
        if len(who):
            # Merge the new nodes into the beams.
            order = np.argsort(who, kind="stable")
            who, near, s = who[order], near[order], s[order]
            count = np.bincount(who, minlength=m)
            place = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)[: len(who)]
            wide = int(count.max())
            more_i, more_s = np.full((m, wide), -1), np.full((m, wide), -np.inf)
            more_i[who, place], more_s[who, place] = near, s
            all_s = np.concatenate([sims, more_s], axis=1)
            keep = np.argsort(-all_s, axis=1, kind="stable")[:, :beam]
            ids = np.take_along_axis(np.concatenate([ids, more_i], axis=1), keep, 1)
            done = np.take_along_axis(np.concatenate([done, more_s == -np.inf], axis=1), keep, 1)
            sims = np.take_along_axis(all_s, keep, 1)
    # Expand the range: from all nodes near it, until nothing new is near.
    at = 0
    while at < len(frontier):
        q, nodes = frontier[at]
        frontier[at] = None
        at += 1
        if len(q):
            visit(q, nodes)
    for q, nodes in found:
        if len(q):
            yield q, nodes


def _shards(centroids, overlap: int = OVERLAP):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            table = centroids.value
            near = np.zeros((len(pdf), 0), int)
            by_length = pdf.v.map(len)
            lists: list = [None] * len(pdf)
            for length in by_length.unique():
                rows = np.flatnonzero((by_length == length).to_numpy())
                if length in table:
                    sims = _unit(pdf.v.iloc[rows]) @ table[length].T
                    near = np.argsort(-sims, axis=1, kind="stable")[:, :overlap]
                else:
                    near = np.zeros((len(rows), 1), int)
                for r, x in zip(rows, near, strict=True):
                    lists[r] = sorted(int(length) * 1_000_000 + int(c) for c in x)
            yield pd.DataFrame({"a": pdf.a, "b": pdf.b, "m": pdf.m, "v": pdf.v, "shards": lists})

    return run


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    units = _unit(pdf.v)
    near = robust_prune(units @ units.T)
    a, b = pdf.a.to_numpy(), pdf.b.to_numpy()
    src, col = np.nonzero(near >= 0)
    dst = near[src, col]
    # Both directions, so that every node can be reached.
    one, two = np.concatenate([src, dst]), np.concatenate([dst, src])
    return pd.DataFrame({"a": a[one], "b": b[one], "na": a[two], "nb": b[two]})


def _adjacency(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """United adjacency lists as places in this table: where each one starts,
    and all of them one after the other."""
    place = {k: i for i, k in enumerate(zip(pdf.a.tolist(), pdf.b.tolist(), strict=True))}
    starts, flat = [0], []
    for na, nb in zip(pdf.na, pdf.nb, strict=True):
        if na is not None:
            flat += [p for x in zip(na.tolist(), nb.tolist(), strict=True) if (p := place.get(x)) is not None]
        starts.append(len(flat))
    return np.array(starts), np.array(flat, np.int64)


def _among(adjacency: tuple[np.ndarray, np.ndarray], nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The adjacency lists between some of the nodes, as places among them."""
    back = np.full(len(adjacency[0]) - 1, -1)
    back[nodes] = np.arange(len(nodes))
    row, near = _lists(adjacency, nodes)
    near = back[near]
    row, near = row[near >= 0], near[near >= 0]
    return np.append(0, np.cumsum(np.bincount(row, minlength=len(nodes)))), near


def _tree(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links that join each component of a symmetric matrix."""
    new, out = np.ones(len(linked), bool), []
    for start in range(len(linked)):
        if not new[start]:
            continue
        new[start] = False
        todo = [start]
        while todo:
            i = todo.pop()
            found = np.flatnonzero(linked[i] & new)
            new[found] = False
            out += [(i, j) for j in found.tolist()]
            todo += found.tolist()
    return out


def _search(threshold: float, beam: int = BEAM):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shard, one, two = int(pdf.shard.iloc[0]), int(pdf.one.iloc[0]), int(pdf.two.iloc[0])
        pdf = pdf.reset_index(drop=True)
        units, m = _unit(pdf.v), pdf.m.to_numpy()
        in_one = (pdf.block == one).to_numpy()
        # Only the first shard that both are in counts a pair.
        lists = pdf.shards.map(lambda x: [c for c in x if c < shard])
        before = {c: i for i, c in enumerate(sorted({c for x in lists for c in x}))}
        member = np.zeros((len(pdf), max(1, len(before))), bool)
        for i, x in enumerate(lists):
            member[i, [before[c] for c in x]] = True
        adjacency = _adjacency(pdf)
        n = len(pdf)
        linked = np.zeros((n, n), bool)
        sides = [(in_one, in_one)] if one == two else [(in_one, ~in_one), (~in_one, in_one)]
        for asks, answers in sides:
            q, t = np.flatnonzero(asks), np.flatnonzero(answers)
            if not len(q) or not len(t):
                continue
            back = np.full(n, -1)
            back[t] = np.arange(len(t))
            for x, y in range_search(units[t], _among(adjacency, t), units[q], back[q], threshold, beam):
                linked[q[x], t[y]] = True
        linked |= linked.T
        np.fill_diagonal(linked, False)
        # Links of some rows at a time: all of a dense block would take gigabytes.
        counted, earlier, weight = np.zeros(n, np.int64), member.astype(np.float32), m.astype(np.float64)
        for i in range(0, n, QUERIES_AT_ONCE):
            part = slice(i, i + QUERIES_AT_ONCE)
            first = linked[part] & (earlier[part] @ earlier.T == 0)
            counted[part] = first.astype(np.float64) @ weight
        joins = _tree(linked)
        a, b = pdf.a.to_numpy(), pdf.b.to_numpy()
        some = np.flatnonzero(counted)
        i, j = np.array(joins, int).reshape(-1, 2).T
        return pd.DataFrame(
            {
                "a": np.concatenate([a[some], a[i]]),
                "b": np.concatenate([b[some], b[i]]),
                "n": np.concatenate([counted[some], np.zeros(len(i), np.int64)]),
                "a2": np.concatenate([a[some], a[j]]),
                "b2": np.concatenate([b[some], b[j]]),
            }
        )

    return run


def usable(vector: str):
    """Whether a vector can be compared: finite components, not all zero."""
    c = F.col(vector)
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return c.isNotNull() & (F.size(c) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(c, lambda x: x != 0)


def _search_links(classes: DataFrame, sent, threshold: float, overlap: int, beam: int) -> DataFrame:
    """Links of the classes by the graph: ``(a, b, n, a2, b2)``, rows with
    ``n`` count a class's links, the others join two classes."""
    flat = classes.select("key.a", "key.b", "m", "v")
    indexed = flat.mapInPandas(_shards(sent, overlap), "a long, b long, m long, v array<double>, shards array<long>")
    spread = indexed.select("*", F.explode("shards").alias("shard"))
    blocks = spread.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    placed = stored(spread.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks"))))
    near = (
        placed.groupBy("shard", "block")
        .applyInPandas(_build, "a long, b long, na long, nb long")
        .groupBy("a", "b")
        .agg(F.collect_set(F.struct("na", "nb")).alias("near"))
        # arrays of numbers: structs would be a dictionary each in Python
        .select("a", "b", "near.na", "near.nb")
    )
    others = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    searched = (
        placed.join(near, ["a", "b"], "left")
        .withColumn("other", F.explode(others))
        .withColumn("one", F.least("block", "other"))
        .withColumn("two", F.greatest("block", "other"))
        .groupBy("shard", "one", "two")
        .applyInPandas(_search(threshold, beam), "a long, b long, n long, a2 long, b2 long")
    )
    return stored(searched)


def _brute_links(classes: DataFrame, asked: DataFrame, threshold: float, block: int = 2_000) -> DataFrame | None:
    """``(a, b, n)``: links of the ``asked`` classes by comparison with all
    ``classes(a, b, m, v)``, each weighted by its rows.  The asked ones are
    sent to the tasks in blocks of about ``block``."""
    spark = classes.sparkSession
    parts = -(-asked.count() // block)
    out = None
    for k in range(parts):
        pdf = asked.where(F.pmod(F.col("b"), F.lit(parts)) == k).toPandas()
        if not len(pdf):
            continue
        by_length = {n: (own.a.to_numpy(), own.b.to_numpy(), _unit(own.v)) for n, own in pdf.groupby(pdf.v.map(len))}
        sent = spark.sparkContext.broadcast(by_length)

        def count(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for length, own in pdf.groupby(pdf.v.map(len)):
                    if length in sent.value:
                        a, b, units = sent.value[length]
                        same = (a[:, None] == own.a.to_numpy()) & (b[:, None] == own.b.to_numpy())
                        hit = (units @ _unit(own.v).T >= threshold) & ~same
                        n = hit @ own.m.to_numpy()
                        yield pd.DataFrame({"a": a[n > 0], "b": b[n > 0], "n": n[n > 0]})

        part = classes.mapInPandas(count, "a long, b long, n long")
        out = part if out is None else out.unionByName(part)
    return None if out is None else out.groupBy("a", "b").agg(F.sum("n").alias("true"))


def audit(classes: DataFrame, searched: DataFrame, threshold: float = THRESHOLD) -> float:
    """The share of the audited classes' links that ``searched`` holds; 1 if
    they have none."""
    flat = classes.select("key.a", "key.b", "m", "v", "audited")
    true = _brute_links(flat.drop("audited"), flat.where("audited").drop("audited"), threshold)
    if true is None:
        return 1.0
    found = searched.where("n > 0").groupBy("a", "b").agg(F.sum("n").alias("n"))
    both = true.join(found, ["a", "b"], "left").agg(F.sum(F.least("true", F.coalesce("n", F.lit(0)))).alias("n"), F.sum("true").alias("true")).first()
    return both["n"] / both["true"] if both["true"] else 1.0


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    good = F.coalesce(usable("v"), F.lit(False))
    rows = rows.withColumn("key", F.when(good, F.struct(F.xxhash64("v").alias("a"), F.xxhash64(F.lit("second"), "v").alias("b"))))
    whole = rows.schema["vec_id"].dataType.typeName() in ("byte", "short", "integer", "long")
    number = F.col("vec_id") if whole else F.xxhash64("vec_id")
    audited = F.coalesce(F.max(F.pmod(number, F.lit(AUDITED)) == 0), F.lit(False))
    classes = stored(
        rows.where("key is not null")
        .groupBy("key")
        .agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("m"), F.min("vec_id").alias("vec_id"), audited.alias("audited"))
    )
    n = classes.count()
    # Centroids: a sample by hash order, at most SAMPLE rows.
    share = min(1.0, SAMPLE / max(n, 1) * 0.9)
    sample = classes.where(F.pmod("key.b", F.lit(1_000_000)) < int(share * 1_000_000)).select("key", "v").limit(SAMPLE).toPandas()
    tables = {}
    for length, part in sample.groupby(sample.v.map(len)) if len(sample) else ():
        k = min(MAX_CENTROIDS, -(-n // PER_CENTROID), len(part))
        part = part.assign(o=[(x["a"], x["b"]) for x in part.key]).sort_values("o")
        tables[int(length)] = fit_centroids(_unit(part.v), k)
    sent = spark.sparkContext.broadcast(tables)
    for wide in range(WIDENINGS + 1):
        searched = _search_links(classes, sent, threshold, OVERLAP << wide, BEAM << wide)
        found = audit(classes, searched, threshold)
        if found >= MIN_RECALL:
            break
    else:
        raise RuntimeError(f"recall of links is {found:.3f} after {WIDENINGS} widenings, below {MIN_RECALL}")
    counts = searched.where("n > 0").groupBy("a", "b").agg(F.sum("n").alias("n"))
    links = searched.where("n = 0").select(F.struct("a", "b").alias("u"), F.struct(F.col("a2").alias("a"), F.col("b2").alias("b")).alias("v"))
    roots = components(links)
    named = classes.select("key", "m", "vec_id").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    smallest = named.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    full = (
        named.join(smallest, "root")
        .join(counts.select(F.struct("a", "b").alias("key"), "n"), "key", "left")
        .select("key", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    )
    out = rows.select("vec_id", "key").join(full, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id"))
    )


def recall(df: DataFrame, found: DataFrame, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, block: int = 2_000) -> DataFrame:
    """One row: links of the vectors whose id is divisible by ``every`` as
    found and by brute force, and their ratio.

    The queries are compared with all rows in blocks of ``block`` queries that
    are sent to the tasks in turn, each task counting for its own rows.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.coalesce(usable("v"), F.lit(False)))
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    parts = max(1, -(-queries.count() // block))
    true = None
    for k in range(parts):
        pdf = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == k).toPandas()
        if not len(pdf):
            continue
        by_length = {n: (own.vec_id.to_numpy(), _unit(own.v)) for n, own in pdf.groupby(pdf.v.map(len))}
        sent = spark.sparkContext.broadcast(by_length)

        def count(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            units = sent.value
            for pdf in batches:
                for length, own in pdf.groupby(pdf.v.map(len)):
                    if length in units:
                        ids, asked = units[length]
                        hit = (asked @ _unit(own.v).T >= threshold) & (ids[:, None] != own.vec_id.to_numpy()[None])
                        yield pd.DataFrame({"vec_id": ids, "n": hit.sum(axis=1)})

        part = rows.mapInPandas(count, "vec_id long, n long")
        true = part if true is None else true.unionByName(part)
    if true is None:
        return found.limit(0).agg(F.lit(0).alias("found"), F.lit(0).alias("true"), F.lit(1.0).alias("recall"))
    true = true.groupBy("vec_id").agg(F.sum("n").alias("n"))
    both = true.join(found.select("vec_id", "n_links"), "vec_id").agg(F.sum(F.least("n", "n_links")).alias("found"), F.sum("n").alias("true"))
    return both.select("found", "true", F.when(F.col("true") > 0, F.col("found") / F.col("true")).otherwise(1.0).alias("recall"))
