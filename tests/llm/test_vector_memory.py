"""A block of the vector graph in which everything is linked."""

import tracemalloc

import numpy as np
import pandas as pd

from kbforge.llm import vector_graph


def test_links_of_a_dense_block_are_not_held_at_once():
    n, rng = 1500, np.random.default_rng(3)
    units = rng.normal(size=8) + rng.normal(size=(n, 8)) * 0.01
    pdf = pd.DataFrame({"a": np.arange(n) * 3, "b": np.arange(n), "m": rng.integers(1, 4, n), "v": list(units), "block": np.arange(n) % 2})
    pdf["shards"] = [sorted({int(x) for x in rng.integers(0, 300, 2)} | {300}) for _ in range(n)]
    near = {}
    for block in (0, 1):
        for r in vector_graph._build(pdf[pdf.block == block].reset_index(drop=True)).itertuples():
            near.setdefault(r.b, set()).add((r.na, r.nb))
    pdf["na"], pdf["nb"] = ([np.array([x[k] for x in near[i]]) for i in range(n)] for k in (0, 1))
    pdf["near"] = [[{"a": x, "b": y} for x, y in near[i]] for i in range(n)]
    tracemalloc.start()
    got = vector_graph._search(0.95)(pdf.assign(shard=300, one=0, two=1))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    block = pdf.block.to_numpy()
    linked = block[:, None] != block
    sims = vector_graph._unit(pdf.v) @ vector_graph._unit(pdf.v).T
    earlier = np.array([[s in x for s in range(300)] for x in pdf.shards], int)
    first = linked & (sims >= 0.95) & (earlier @ earlier.T == 0)
    links = got[got.n > 0].groupby("b").n.sum()
    assert links.to_dict() == {i: x for i, x in enumerate((first @ pdf.m.to_numpy()).tolist()) if x}
    assert len(got[got.n == 0]) == n - 1  # a tree
    assert peak < 64 << 20  # 1,125,000 links: 16 bytes each in one array of pairs, hundreds in lists
