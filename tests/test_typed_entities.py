"""Dictionary entities: the word automaton against plain search."""

import random
from collections import Counter

import pytest

from kbforge.operators.graph import dictionary_mentions, typed_mentions
from kbforge.operators.word_automaton import WordAutomaton


def _brute(phrases, words):
    return Counter(k for k, p in enumerate(phrases) if p for i in range(len(words)) if words[i : i + len(p)] == p)


def test_automaton_finds_every_occurrence():
    rng = random.Random(5)
    for _ in range(300):
        letters = "abc"[: rng.randint(1, 3)]
        phrases = [rng.choices(letters, k=rng.randint(0, 5)) for _ in range(rng.randint(0, 12))]
        words = rng.choices(letters + "z", k=rng.randint(0, 60))
        assert Counter(WordAutomaton(phrases).find(words)) == _brute(phrases, words)


def test_long_runs_take_linear_time():
    phrases = [["a"] * n for n in (1, 2_000)]
    found = Counter(WordAutomaton(phrases).find(["a"] * 100_000 + ["b"]))
    assert found == {0: 100_000, 1: 98_001}


def test_both_ways_give_the_same_rows(spark):
    rng = random.Random(6)
    vocabulary = ["ann", "Bo", "c1", "é", "dé"]
    texts = [None, "", "  ..", *(rng.choice([" ", ", ", "-"]).join(rng.choices(vocabulary, k=rng.randint(1, 80))) for _ in range(40))]
    units = spark.createDataFrame([(str(i), t, "x") for i, t in enumerate([*texts, texts[5]])], "unit_id string, text string, name string")
    entries = [("LOCATION", " ".join(rng.choices(vocabulary, k=k))) for k in (1, 1, 2, 2, 3, 7)]
    entries += [entries[0], ("ORGANISATION", entries[0][1].upper()), ("LOCATION", "?!"), ("LOCATION", None), ("LOCATION", "ann " * 30)]
    dictionary = spark.createDataFrame(entries, "type string, name string")
    one = Counter(map(tuple, dictionary_mentions(units, dictionary).collect()))
    two = Counter(map(tuple, dictionary_mentions(units, dictionary, max_bytes=1).collect()))
    assert one == two and sum(one.values()) > 100
    assert dictionary_mentions(units, dictionary.limit(0)).count() == 0
    assert dictionary_mentions(units.limit(0), dictionary).count() == 0
    assert dictionary_mentions(units, dictionary.limit(0), max_bytes=0).count() == 0


def test_no_runs_are_exploded_and_types_are_checked(spark):
    units = spark.createDataFrame([(1, "Zed lives in Zed")], "unit_id long, text string")
    dictionary = spark.createDataFrame([("LOCATION", "zed")], "type string, name string")
    found = dictionary_mentions(units, dictionary)
    assert [tuple(r) for r in found.collect()] == [(1, "LOCATION", "zed")] * 2
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    for wrong in ("PLACE", None):
        with pytest.raises(ValueError):
            typed_mentions(units, spark.createDataFrame([(wrong, "zed")], "type string, name string"))
