"""The bounded distinct aggregate of table profiles."""

import random
from collections import defaultdict

from kbforge.operators.profile import few_values


def test_few_values_equal_exact_distinct(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice("abcde"), rng.choice(["x", None]), str(rng.randint(0, 5)), i % 7, None, rng.choice([1.5, 2.5])) for i in range(500)]
    rows[::50] = [(i, "a", None, "0", 0, None, 1.5) for i in range(1000, 1010)]
    df = spark.createDataFrame(rows, "k long, five string, two string, six string, seven int, none string, num double").repartition(7)
    want = {}
    for ci, name in enumerate(df.columns):
        first = defaultdict(list)
        for r in df.collect():
            first[None if r[name] is None else str(r[name])].append(r["k"])
        if len(set(first) - {None}) <= 5:
            want |= {(ci, v): min(k) for v, k in first.items()}
    assert {(r["ci"], r["v"]): r["first_k"] for r in few_values(df, "k").collect()} == want
    # The tasks' states agree on too many values only once they are merged.
    split = spark.createDataFrame([(i, str(i)) for i in range(8)], "k long, v string").repartitionByRange(4, "k")
    assert few_values(split, "k").count() == 0
    assert few_values(df.limit(0), "k").count() == 0
