"""Chunking invariants, relationships and community fixtures."""

import random

from pyspark.sql import functions as F

from kbforge.operators.chunking import chunk_documents
from kbforge.operators.communities import community_reports, connected_components, hierarchical_communities
from kbforge.operators.graph import relationships


def test_chunks_cover_and_overlap(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(f"w{i}_{j}" for j in range(n))) for i, n in enumerate([1, 1199, 1200, 1201, 2300, 2301, 5000])]
    docs.append((99, "   \n  "))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    units = chunk_documents(df, size=1200, overlap=100).collect()
    by_doc = {}
    for u in units:
        by_doc.setdefault(u["doc_id"], []).append(u)
    assert 99 not in by_doc
    for doc_id, text in docs[:-1]:
        toks = text.split()
        n = len(toks)
        us = sorted(by_doc[doc_id], key=lambda u: u["chunk_no"])
        want = 1 if n <= 1200 else -(-(n - 100) // 1100)
        assert len(us) == want
        covered = set()
        for u in us:
            piece = u["text"].split()
            assert piece == toks[u["start_tok"] : u["start_tok"] + 1200]
            assert u["n_tokens"] == len(piece) <= 1200
            covered.update(range(u["start_tok"], u["start_tok"] + len(piece)))
        assert covered == set(range(n))
        for a, b in zip(us, us[1:]):
            assert b["start_tok"] - a["start_tok"] == 1100


def test_relationships_pair_all_names_of_a_unit(spark):
    names = ["Alpha", "Bravo", "Charlie", "Delta", "Echo", "Foxtrot", "Golf"]
    adm = spark.createDataFrame(
        [("u1", i, n) for i, n in enumerate(names)] + [("u1", 9, "Alpha"), ("u2", 0, "Bravo"), ("u2", 70, "Alpha"), ("u3", 0, "Golf")],
        "unit_id string, ord int, name string",
    )
    got = {(r["src"], r["dst"]): r["weight"] for r in relationships(adm).collect()}
    want = {(a, b): 1 for i, a in enumerate(names) for b in names[i + 1 :]}
    want["Alpha", "Bravo"] = 2
    assert got == want


def test_long_dictionary_entries_match(spark):
    from kbforge.operators.graph import typed_mentions

    entry = "one two three four five six seven eight"
    units = spark.createDataFrame([("u", f"See {entry.title()}, or seven eight.")], "unit_id string, text string")
    names = spark.createDataFrame([("LOCATION", entry), ("LOCATION", "seven eight")], "type string, name string")
    got = sorted(r["name"] for r in typed_mentions(units, names).collect())
    assert got == sorted([entry, "seven eight", "seven eight"])


def test_names_are_kept_unless_filtered(spark):
    from kbforge.operators.graph import entity_stats

    ments = spark.createDataFrame([("u", 0, 0, "Cork"), ("u", 1, 0, "A B C D E F G")], "unit_id string, ord int, sent_no int, name string")
    assert entity_stats(ments).count() == 2
    assert entity_stats(ments, min_chars=6, max_words=5).count() == 0


def test_every_copy_of_a_unit_is_known(spark):
    from kbforge.operators.graph import copies_of

    units = spark.createDataFrame([("u2", "x"), ("u1", "x"), ("u3", "y")], "unit_id string, text string")
    assert sorted(map(tuple, copies_of(units).collect())) == [("u1", "u1"), ("u2", "u1"), ("u3", "u3")]


def _graph(spark):
    edges = []
    edges += [("t1a", "t1b"), ("t1b", "t1c"), ("t1a", "t1c")]
    edges += [("t2a", "t2b"), ("t2b", "t2c"), ("t2a", "t2c")]
    chain = [f"ch{i:02d}" for i in range(11)]
    edges += list(zip(chain, chain[1:]))
    a = [f"a{i}" for i in range(6)]
    b = [f"b{i}" for i in range(6)]
    for grp in (a, b):
        edges += [(x, y) for i, x in enumerate(grp) for y in grp[i + 1 :]]
    edges.append(("a5", "b0"))
    rels = spark.createDataFrame([(min(x, y), max(x, y), 2) for x, y in edges], "src string, dst string, weight long")
    nodes = sorted({n for e in edges for n in e} | {"lonely"})
    ents = spark.createDataFrame([(n, n, 1) for n in nodes], "entity_id string, name string, degree long").withColumn(
        "description", F.lit("")
    )
    return ents, rels


def test_components(spark):
    ents, rels = _graph(spark)
    nodes = ents.select(F.col("entity_id").alias("node"))
    comp = {r["node"]: r["component"] for r in connected_components(nodes, rels).collect()}
    assert comp["t1c"] == "t1a" and comp["t2b"] == "t2a" and comp["ch10"] == "ch00"
    assert comp["b5"] == "a0" and comp["lonely"] == "lonely"


def test_hierarchy_invariants(spark):
    ents, rels = _graph(spark)
    com = hierarchical_communities(ents, rels, max_size=10).collect()
    levels = sorted({r["level"] for r in com})
    assert levels[0] == 0 and len(levels) >= 2
    for lv in levels:
        rows = [r for r in com if r["level"] == lv]
        ids = [r["entity_id"] for r in rows]
        assert len(ids) == len(set(ids))  # one community per entity and level
        sizes = {}
        for r in rows:
            sizes[r["community"]] = sizes.get(r["community"], 0) + 1
        for r in rows:
            assert (sizes[r["community"]] <= 10) != r["oversized"]
    last = {r["entity_id"]: r["community"] for r in com if r["level"] == levels[-1]}
    assert len({last[f"a{i}"] for i in range(6)}) == 1
    assert len({last[f"b{i}"] for i in range(6)}) == 1
    assert last["a0"] != last["b0"]
    assert last["lonely"] == "lonely"  # no edge: a community of its own
    reps = community_reports(hierarchical_communities(ents, rels), ents, rels).collect()
    assert all(len(r["report"]) <= 2000 for r in reps)
    assert {(r["level"], r["community"]) for r in reps} == {(r["level"], r["community"]) for r in com}


def test_hierarchy_invariants_on_driver_data(spark):
    from kbforge.plans import QUERIES
    from tests.conftest import SMOKE_DIR

    com = QUERIES["communities"](spark, SMOKE_DIR).collect()
    by_level = {}
    for r in com:
        by_level.setdefault(r["level"], []).append(r)
    assert 0 in by_level
    entities0 = {r["entity_id"] for r in by_level[0]}
    for lv, rows in by_level.items():
        ids = [r["entity_id"] for r in rows]
        assert len(ids) == len(set(ids)) and set(ids) == entities0  # every level covers every entity once
        sizes = {}
        for r in rows:
            sizes[r["community"]] = sizes.get(r["community"], 0) + 1
        assert all((sizes[r["community"]] > 10) == r["oversized"] for r in rows)
        if lv > 0:
            parents = {r["community"] for r in by_level[lv - 1]}
            assert all(r["parent"] in parents for r in rows)
    reps = QUERIES["community_reports"](spark, SMOKE_DIR).collect()
    assert {(r["level"], r["community"]) for r in reps} == {(r["level"], r["community"]) for r in com}
    assert all(len(r["report"]) <= 2000 and r["size"] >= 1 for r in reps)


def test_descriptions_picked_in_the_row_equal_the_join(spark):
    import random

    from kbforge.operators.graph import admitted_mentions, descriptions, entity_descriptions, entity_stats, mentions

    rng = random.Random(8)
    words = ["Ann", "Bo  Lee", "Cork", "and", "x", "Élan", "U.S.", "!", "Ann", "\n", "Old Town"]
    texts = [None, "", " . ! ", *(" ".join(rng.choices(words, k=rng.randint(1, 60))) + rng.choice([".", ""]) for _ in range(30))]
    units = spark.createDataFrame([(str(i), t, "x") for i, t in enumerate([*texts, texts[4]])], "unit_id string, text string, name string")
    ments = mentions(units)
    ents = entity_stats(ments, min_chars=4)
    for most in (500, 12):
        want = descriptions(admitted_mentions(ments, ents), units, most)
        got = entity_descriptions(ents, units, most)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert want.count() >= 3
    assert entity_descriptions(ents, units.limit(0)).count() == entity_descriptions(ents.limit(0), units).count() == 0
