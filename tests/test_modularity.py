"""Modularity clustering: rounds against plain Python, invariants."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from kbforge.operators import communities, modularity
from kbforge.session import materialize


def plain_merge(nodes, edges, rounds=None):
    """Labels after the merging rounds of one cluster."""
    label = {n: n for n in nodes}
    total = 2 * sum(w for _, _, w in edges)
    while rounds is None or rounds > 0:
        k, between = Counter(), Counter()
        for a, b, w in edges:
            x, y = sorted((label[a], label[b]))
            k[x] += w
            k[y] += w
            if x != y:
                between[x, y] += w
        best = {}
        for (x, y), w in between.items():
            gain = total * w - k[x] * k[y]
            if gain > 0:
                for node, to in ((x, y), (y, x)):
                    best[node] = min(best.get(node, ((1,),)), ((-gain, x, y), to, w))
        heads = {n: t for n, (_, t, _) in best.items() if best[t][1] == n and n < t}
        load = Counter()
        for n, (_, t, _) in best.items():
            load[t] += k[n]
        joins = {n: t for n, (_, t, w) in best.items() if t in heads and (heads[t] == n or total * w > k[n] * (k[t] + load[t] - k[n]))}
        if not joins:
            break
        label = {n: joins.get(s, s) for n, s in label.items()}
        rounds = None if rounds is None else rounds - 1
    return label


def plain_q(label, edges):
    total = 2 * sum(w for _, _, w in edges)
    k, within = Counter(), 0
    for a, b, w in edges:
        k[label[a]] += w
        k[label[b]] += w
        within += 2 * w * (label[a] == label[b])
    return within / total - sum(x * x for x in k.values()) / total**2


def partition(label):
    parts = defaultdict(set)
    for n, s in label.items():
        parts[s].add(n)
    return {frozenset(p) for p in parts.values()}


def random_graph(seed, n, groups, inside=0.5, across=0.03):
    rng = random.Random(seed)
    nodes = [f"n{i:03d}" for i in range(n)]
    edges = []
    for i in range(n):
        for j in range(i + 1, n):
            if rng.random() < (inside if i % groups == j % groups else across):
                edges.append((nodes[i], nodes[j], rng.randint(1, 4)))
    return nodes, edges


def frames(spark, nodes, edges, cluster="c"):
    return (
        spark.createDataFrame([(n, cluster) for n in nodes], "node string, cluster string"),
        spark.createDataFrame(edges, "src string, dst string, weight long"),
    )


@pytest.mark.parametrize("rounds", [1, 3, None])
def test_merging_equals_plain_rounds(spark, rounds):
    nodes, edges = random_graph(4, 60, 5)
    assign, e = frames(spark, nodes + ["alone"], [(b, a, w) if k % 2 else (a, b, w) for k, (a, b, w) in enumerate(edges)])
    inside = materialize(modularity.inner_edges(assign, e))
    start = materialize(assign.select("node", "cluster", F.col("node").alias("label")))
    out = modularity.merge_all(start, inside, materialize(modularity.totals_of(inside)), rounds)
    got = {r["node"]: r["label"] for r in out.collect()}
    assert partition(got) == partition(plain_merge(nodes + ["alone"], edges, rounds))


def connected(part, edges):
    part, seen, todo = set(part), set(), [next(iter(part))]
    near = defaultdict(set)
    for a, b, _ in edges:
        near[a].add(b)
        near[b].add(a)
    while todo:
        n = todo.pop()
        if n not in seen:
            seen.add(n)
            todo += near[n] & part
    return seen == part


def test_parts_are_connected_and_beat_propagation(spark):
    first, second = random_graph(7, 48, 4, 0.4, 0.05), random_graph(9, 40, 3, 0.35, 0.06)
    other = ([f"x{n}" for n in second[0]], [(f"x{a}", f"x{b}", w) for a, b, w in second[1]])
    assign = frames(spark, first[0], first[1], "one")[0].unionByName(frames(spark, other[0], other[1], "two")[0])
    edges = frames(spark, [], first[1] + other[1] + [(first[0][0], other[0][0], 9), (first[0][1], first[0][1], 5)])[1]
    labels = modularity.modularity_clusters(assign, edges)
    got = {r["node"]: r["label"] for r in labels.collect()}
    far = modularity.modularity_clusters(assign, edges, local_edges=0)
    assert {r["node"]: r["label"] for r in far.collect()} == got
    q = {r["cluster"]: r["modularity"] for r in modularity.modularity(labels, edges).collect()}
    adj = communities._both_ways(edges.where("src != dst"))
    spread = communities._split_oversized(assign, adj, communities.LPA_ROUNDS).select("node", "cluster", "label")
    plain = {r["cluster"]: r["modularity"] for r in modularity.modularity(spread, edges).collect()}
    for name, (nodes, e) in (("one", first), ("two", other)):
        mine = {n: got[n] for n in nodes}
        assert all(connected(p, e) for p in partition(mine))
        assert all(min(p) == mine[n] for p in partition(mine) for n in p)
        assert abs(q[name] - plain_q(mine, e)) < 1e-9
        assert q[name] >= plain[name] and q[name] >= plain_q(plain_merge(nodes, e), e) - 1e-12


def test_small_graphs_reach_the_best_partition(spark):
    """Every partition of seven nodes is tried."""

    def partitions(items):
        if not items:
            yield []
            return
        for rest in partitions(items[1:]):
            yield [[items[0]], *rest]
            for k in range(len(rest)):
                yield [*rest[:k], [items[0], *rest[k]], *rest[k + 1 :]]

    edges = [("a", "b", 3), ("b", "c", 3), ("a", "c", 2), ("c", "d", 1), ("d", "e", 2), ("e", "f", 3), ("d", "f", 2), ("f", "g", 2)]
    nodes = list("abcdefg")
    best = max(plain_q({n: k for k, p in enumerate(parts) for n in p}, edges) for parts in partitions(nodes))
    labels = modularity.modularity_clusters(*frames(spark, nodes, edges))
    assert abs(plain_q({r["node"]: r["label"] for r in labels.collect()}, edges) - best) < 1e-12


def test_moves_raise_modularity(spark):
    nodes, edges = random_graph(2, 40, 4, 0.4, 0.05)
    assign, e = frames(spark, nodes, edges)
    inside = materialize(modularity.inner_edges(assign, e))
    totals = materialize(modularity.totals_of(inside))
    label = {n: f"n{int(n[1:]) // 10 * 10:03d}" for n in nodes}  # cuts across the groups
    labels = spark.createDataFrame([(n, "c", s) for n, s in label.items()], "node string, cluster string, label string")
    made = modularity.move_round(labels, inside, totals).collect()
    touched = [s for r in made for s in (label[r["node"]], r["head"])]
    assert made and len(touched) == len(set(touched))
    after = label | {r["node"]: r["head"] for r in made}
    gains = sum(plain_q(label | {r["node"]: r["head"]}, edges) - plain_q(label, edges) for r in made)
    assert plain_q(after, edges) > plain_q(label, edges) and abs(plain_q(after, edges) - plain_q(label, edges) - gains) < 1e-12


def hub_graph():
    """Leaves that point at one hub and join it a few in a round."""
    edges = [("hub", f"n{i:02d}", 40 - i) for i in range(20)]
    return [n for _, n, _ in edges] + ["hub"], edges + [(f"n{i:02d}", f"n{j:02d}", 1) for i in range(20) for j in range(i + 1, 20, 7)]


@pytest.mark.parametrize("graph", [random_graph(4, 60, 5), hub_graph()])
def test_rounds_ended_in_one_task_are_the_distributed_ones(spark, monkeypatch, graph):
    assign, e = frames(spark, *graph)
    inside = materialize(modularity.inner_edges(assign, e))
    totals = materialize(modularity.totals_of(inside))
    calls, one_round = [], modularity.merge_round
    monkeypatch.setattr(modularity, "merge_round", lambda *a: calls.append(1) or one_round(*a))

    def merged(**how):
        start = materialize(assign.select("node", "cluster", F.col("node").alias("label")))
        return {r["node"]: r["label"] for r in modularity.merge_all(start, inside, totals, **how).collect()}

    far = merged(finish_edges=0)
    assert len(calls) > 1
    calls.clear()
    assert merged() == far and not calls  # no job a round once the graph is small


def test_weights_beyond_int64_products():
    nodes, edges = random_graph(3, 30, 3)
    big = [(a, b, w * 10**10) for a, b, w in edges]
    plain = modularity._merge_rounds({n: n for n in nodes}, edges)
    assert modularity._merge_rounds({n: n for n in nodes}, big) == plain


def test_no_edges_and_no_nodes(spark):
    assign, edges = frames(spark, ["a", "b"], [])
    assert {tuple(r) for r in modularity.modularity_clusters(assign, edges).collect()} == {("a", "c", "a"), ("b", "c", "b")}
    assert modularity.modularity_clusters(assign.limit(0), edges).count() == 0
