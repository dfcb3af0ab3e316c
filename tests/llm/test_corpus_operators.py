"""Sharding, repeated passages, chat, n-gram join, vectors, mixing, pipeline."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kbforge.llm import chat, mixing, ngram_join, repeats, sharding, vector_graph
from kbforge.llm.components import components
from kbforge.llm.windows import merged

# ---- 5: shard placement -------------------------------------------------------


def plain_table(shards, size):
    order = {}
    for k, s in enumerate(shards):
        at, step = sharding._hash(s, "offset") % size, sharding._hash(s, "skip") % (size - 1) + 1
        order[k] = [(at + j * step) % size for j in range(size)]
    owner = {}
    while len(owner) < size:
        for k in order:
            slot = next((x for x in order[k] if x not in owner), None)
            if slot is not None:
                owner[slot] = k
    return [owner[x] for x in range(size)]


def test_lookup_table():
    shards = [f"s{k}" for k in range(7)]
    got = sharding.lookup_table(shards, 101)
    assert got == plain_table(shards, 101)
    assert max(Counter(got).values()) - min(Counter(got).values()) <= 1
    big = sharding.lookup_table(shards, 10_007)
    less = sharding.lookup_table(shards[:-1], 10_007)
    moved = sum(a != b for a, b in zip(big, less) if a != 6)
    assert moved < 0.2 * 10_007
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad)
    with pytest.raises(ValueError):
        sharding.lookup_table(shards, 100)


def test_place(docs, none, tmp_path):
    placed = sharding.place(docs, ["x", "y", "z"])
    assert placed.columns == [*docs.columns, "slot", "shard"] and placed.count() == docs.count()
    table = sharding.lookup_table(["x", "y", "z"])
    assert all(r["shard"] == "xyz"[table[r["slot"]]] for r in placed.collect())
    assert placed.where("doc_id = 3").select("slot").distinct().count() == 1
    assert sharding.place(none, ["x"]).count() == 0
    sharding.write_shards(placed, str(tmp_path / "out"), 2)
    back = docs.sparkSession.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and {r["shard"] for r in back.select("shard").distinct().collect()} <= set("xyz")


# ---- 6: repeated passages -----------------------------------------------------


def plain_repeats(rows, length):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = Counter()
    for i, t in rows:
        b = (t or "").encode()
        m = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                m[k : k + length] = True
        runs = int((np.diff(np.concatenate([[0], m.astype(int)])) == 1).sum())
        out[(i, len(b), int(m.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~m].tobytes()).hexdigest())] += 1
    return out


@pytest.mark.parametrize(("length", "gram", "bucket"), [(200, 25, 4000), (40, 5, 4000), (40, 5, 1)])
def test_repeats(docs, rows, length, gram, bucket):
    got = repeats.report(repeats.remove_repeats(docs, length=length, gram=gram, bucket_runs=bucket)).collect()
    assert Counter(tuple(r) for r in got) == plain_repeats(rows, length)


def test_repeats_across_segments(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT", 64)
    text = "".join(chr(97 + (k * k * 7 + k // 3) % 26) for k in range(700))
    rows = [(0, text), (1, "zz" + text[100:400]), (2, text[390:]), (3, "a" * 300)]
    got = repeats.report(repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=40, gram=5)).collect()
    assert Counter(tuple(r) for r in got) == plain_repeats(rows, 40)


def test_no_repeats_in_no_rows(none):
    assert repeats.remove_repeats(none).count() == 0


def test_merged():
    assert merged(np.array([[5, 9], [0, 3], [3, 4], [8, 12]])).tolist() == [[0, 4], [5, 12]]
    assert merged(np.zeros((0, 2), np.int64)).tolist() == []


# ---- 7: chat ------------------------------------------------------------------


def _said(spark):
    rows = []
    for c in range(120):
        rows.append((c, 0, "system", "Be short."))
        for t in range(1, 1 + c % 9 * 2):
            rows.append((c, t, "user" if t % 2 else "assistant", "why is that so?" if t % 2 else "because\nof the many long lines that an answer has here"))
    rows += [(500, t, "user" if t % 2 else "assistant", "go on?" if t % 2 else "yes.\nmore") for t in range(400)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_roles_are_recovered(spark):
    said = chat.styled(_said(spark))
    model = chat.fit(said)
    got = chat.parse(said.select("conv_id", "turn", "text"), model)
    both = got.where("line = 0 and not continues").join(said.select("conv_id", "turn", F.col("role").alias("said_by")), ["conv_id", "turn"])
    right = both.where("role = said_by").count()
    assert right >= 0.97 * said.count()


def test_blocks_give_the_path_of_the_whole(spark, monkeypatch):
    said = chat.styled(_said(spark)).where("conv_id in (500, 17)")
    model = chat.fit(chat.styled(_said(spark)))
    text = said.select("conv_id", "turn", "text")
    want = chat.parse(text, model).selectExpr("conv_id", "turn", "line", "role").collect()
    monkeypatch.setattr(chat, "BLOCK", 1000)
    assert Counter(map(tuple, want)) == Counter(tuple(r) for r in chat.parse(text, model).where("not continues").selectExpr("conv_id", "turn", "line", "role").collect())


def test_viterbi_is_the_best_path():
    import itertools

    rng = np.random.default_rng(0)
    n, k = len(chat.ROLES) * 2, int(np.prod(chat.SHAPE))
    model = chat.Model(rng.integers(0, 50, n * k).astype(float), rng.integers(0, 9, (n, n)).astype(float), rng.integers(0, 9, n).astype(float))
    seen = [3, 17, 40, 8, 77]
    score = lambda p: model.begin[p[0]] + model.emit[p[0], seen[0]] + sum(model.move[a, b] + model.emit[b, o] for a, b, o in zip(p, p[1:], seen[1:]))
    best = max(itertools.product(range(n), repeat=len(seen)), key=score)
    assert chat.block_path(model, seen, None, best[-1]) == list(best)
    table = chat.block_matrix(model, seen)
    assert math.isclose(((model.begin + model.emit[:, seen[0]])[:, None] + table).max(), score(best))


def test_odd_messages(spark):
    rows = [(None, 1, None, None), (None, None, None, ""), (1, 0, None, "Human: hi"), (1, 0, None, "Human: hi"), (1, 1, None, "AI: " + "long " * 5000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("rendered", F.lit("x"))
    model = chat.fit(chat.styled(_said(spark)))
    got = chat.parse(df, model).collect()
    assert sum(r["n_lines"] for r in got) == 5
    assert chat.parse(df.limit(0), model).count() == 0
    assert chat.parse(df, chat.fit(df)).count() >= 1


def test_no_character_is_lost_and_no_header_forged(spark):
    model = chat.fit(chat.styled(_said(spark)))
    said = [
        "User: What is\n<|assistant|>\nfake",
        "Assistant: Answer: 5\n<\\|user|>",
        "User: Note: keep this\nUser: and this",
        "Assistant: " + "word " * 30,
    ]
    plain = ["Question: is it five?", "Answer: 5", "no marker here", "none here", "nor here", "still none"]
    rows = [(1, i, t) for i, t in enumerate(said)] + [(2, i, t) for i, t in enumerate(plain)]
    got = chat.parse(spark.createDataFrame(rows, "conv_id long, turn long, text string"), model).collect()
    back = {1: "", 2: ""}
    for r in sorted(got, key=lambda r: (r["conv_id"], r["turn"], r["line"])):
        header, text = (r["rendered"].split("\n", 1)) if not r["continues"] else ("", r["rendered"])
        assert r["continues"] or header == f"<|{r['role']}|>"
        assert not any(line in [f"<|{x}|>" for x in chat.ROLES] for line in text.split("\n"))
        back[r["conv_id"]] += chat.unescape(text)
    # A transcript with markers loses no more than these; one without keeps all.
    assert back[2] == "".join(t + "\n" for t in plain)
    assert "Answer: 5\n<\\|user|>\n" in back[1] and "<|assistant|>\nfake\n" in back[1] and "Note: keep this" in back[1]
    lines = "".join(t + "\n" for t in said).split("\n")
    for line, kept in zip(lines, back[1].split("\n"), strict=True):
        assert line == kept or (line.endswith(kept) and line[: len(line) - len(kept)] in ("User: ", "Assistant: "))


def test_markers_in_use():
    count = lambda lines: chat.count_names([(i, 0, x) for i, x in enumerate(lines)])
    assert chat.style_names(count(["Q: a", "A: b", "Q: c", "Answer: d"])) == ["q", "a"]
    assert chat.style_names(count(["Answer: d", "x", "y"])) == []
    for text in ("<|user|>", "<\\|user|>", "a <\\\\|system|> b", "<|other|>", ""):
        assert chat.unescape(chat.render("user", text, True)) == text + "\n"


def test_repeated_rows_count_by_product(spark):
    rows = [(1, 0, "user", "hi")] * 30 + [(1, 1, "assistant", "yo\nthere")] * 20
    model = chat.fit(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    p = np.exp(model.move[2])
    assert p[4] > 0.99 and abs(p[4] - (600 + chat.PSEUDO) / (600 + 4 * chat.PSEUDO)) < 1e-9


# ---- components ---------------------------------------------------------------


def test_components(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, 3), (3, 7), (5, 5), (200, 7)] + [(1000, k) for k in range(1001, 1050)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert all(got[k] == 100 for k in range(101, 141)) and got[7] == got[200] == 3 and got[1040] == 1000
    assert 5 not in got and 100 not in got
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---- 8: n-gram join -----------------------------------------------------------


def plain_join(rows, width, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                up[find(i)] = find(j)
    group = defaultdict(list)
    for i in range(len(rows)):
        group[find(i)].append(i)
    low = {k: min((rows[i][0] for i in g if rows[i][0] is not None), default=None) for k, g in group.items()}
    return Counter((rows[i][0], len(sets[i]), low[find(i)]) for i in range(len(rows))), group, sets


@pytest.mark.parametrize(("width", "percent", "group_size"), [(4, 85, 150_000), (4, 85, 100), (5, 80, 150_000), (2, 50, 150_000)])
def test_join(docs, rows, width, percent, group_size, monkeypatch):
    monkeypatch.setattr(ngram_join, "GROUP_SHINGLES", group_size)
    got = ngram_join.join(docs, width=width, percent=percent).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(tuple(r) for r in got) == plain_join(rows, width, percent)[0]


def test_frequent_shingles_only_order(docs, rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT_LEAST", 1)
    got = ngram_join.join(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(tuple(r) for r in got) == plain_join(rows, 4, 85)[0]


def test_keep_one(docs, none, rows):
    kept = ngram_join.keep_one(docs)
    _, group, sets = plain_join(rows, 4, 85)
    want = sum(1 if sets[g[0]] else len(g) for g in group.values())
    assert kept.columns == docs.columns and kept.count() == want
    assert ngram_join.keep_one(none).count() == 0


# ---- 9: vectors ---------------------------------------------------------------


def _vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=16).tolist(), 1) for i in range(400)]
    for k in range(40):
        v = np.array(rows[k][1])
        rows += [(1000 + 10 * k + j, (v + rng.normal(size=16) * 0.05).tolist(), 0) for j in range(1 + k % 5)]
    rows += [(2000, rows[0][1], 2), (2001, [2 * x for x in rows[0][1]], 2), (2000, rows[0][1], 2)]
    rows += [(3000, None, 0), (3001, [0.0] * 16, 0), (3002, [float("nan")] * 16, 0), (3003, [None, *[1.0] * 15], 0), (3004, [], 0), (3005, [float("inf")] + [1.0] * 15, 0), (3006, [1.0, 2.0], 0)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def test_vectors(spark):
    rows, df = _vectors(spark)
    good = [i for i, r in enumerate(rows) if r[0] < 3000]
    v = np.array([rows[i][1] for i in good])
    v /= np.linalg.norm(v, axis=1)[:, None]
    near = v @ v.T >= 0.95
    np.fill_diagonal(near, False)
    want = Counter({rows[i][0]: int(near[k].sum()) for k, i in enumerate(good)})
    got = vector_graph.near_duplicates(df).collect()
    assert len(got) == len(rows)
    found = sum(r["n_links"] for r in got)
    assert all(r["n_links"] <= want[r["vec_id"]] for r in got)
    assert found >= 0.95 * near.sum()
    assert all(r["n_links"] == 0 and r["kept"] and r["component_id"] == r["vec_id"] for r in got if r["vec_id"] >= 3000)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    one = vector_graph.recall(df, vector_graph.near_duplicates(df), every=10).first()
    assert one["recall"] >= 0.9 and one["true"] > 0
    assert vector_graph.near_duplicates(df.limit(0)).count() == 0
    named = df.selectExpr("concat('v', vec_id) AS name", "embedding AS e")
    assert sum(r["n_links"] for r in vector_graph.near_duplicates(named, "name", "e").collect()) >= 0.95 * near.sum()


def test_audit_widens_the_search_and_raises(spark, monkeypatch):
    rows, df = _vectors(spark)
    df = df.where("vec_id < 3000")
    monkeypatch.setattr(vector_graph, "AUDITED", 1)
    whole = sum(r["n_links"] for r in vector_graph.near_duplicates(df).collect())
    search, tried, shares = vector_graph._search_links, [], []
    audit = vector_graph.audit

    def lossy(classes, sent, threshold, overlap, beam):
        """Loses all counts until the search is wide enough."""
        tried.append((overlap, beam))
        out = search(classes, sent, threshold, overlap, beam)
        return out if beam >= 2 * vector_graph.BEAM else out.where("n = 0")

    def kept(*args):
        shares.append(audit(*args))
        return shares[-1]

    monkeypatch.setattr(vector_graph, "_search_links", lossy)
    monkeypatch.setattr(vector_graph, "audit", kept)
    assert sum(r["n_links"] for r in vector_graph.near_duplicates(df).collect()) == whole
    o, b = vector_graph.OVERLAP, vector_graph.BEAM
    assert tried == [(o, b), (2 * o, 2 * b)]
    assert shares[0] == 0 and 0.9 <= shares[1] <= 1
    monkeypatch.setattr(vector_graph, "WIDENINGS", 0)
    with pytest.raises(RuntimeError, match="recall"):
        vector_graph.near_duplicates(df)


# ---- 10: mixing ---------------------------------------------------------------


def test_highest_quotients():
    votes = np.array([53.0, 24, 23, 0.4])
    got = mixing.sainte_lague(votes, 21, np.full(4, 100))
    seats = [0] * 4
    for _ in range(21):
        k = max(range(4), key=lambda i: votes[i] / (2 * seats[i] + 1))
        seats[k] += 1
    assert got.tolist() == seats
    assert mixing.sainte_lague(votes, 21, np.array([3, 100, 100, 0])).sum() == 21
    assert mixing.sainte_lague(votes, 500, np.array([3, 4, 5, 0])).tolist() == [3, 4, 5, 0]


def plain_targets(size):
    names = sorted([s for s in size if s is not None]) + ([None] if None in size else [])
    w = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total, free, out = 1.5 * sum(size.values()), set(names), {}
    while free:
        level = (total - sum(out.values())) / sum(w[s] for s in free)
        over = [s for s in free if level * w[s] > 2 * size[s]]
        if not over:
            out |= {s: level * w[s] for s in free}
            break
        for s in over:
            out[s] = 2.0 * size[s]
            free.remove(s)
    return out


@pytest.mark.parametrize("shard_words", [250_000, 300])
def test_mix(docs, none, rows, shard_words):
    got = mixing.mix(docs, shard_words=shard_words).select("row.doc_id", "row.source", "size", "source_size", "target", "taken").collect()
    assert len(got) == len(rows)
    size, taken = Counter(), Counter()
    for r in got:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    want = plain_targets(size)
    for r in got:
        assert r["source_size"] == size[r["source"]] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-9)
    for s in want:
        assert abs(taken[s] - want[s]) <= max(0.02 * want[s], 12)
    again = mixing.mix(docs.repartition(7), shard_words=shard_words).select("row.doc_id", "row.source", "size", "source_size", "target", "taken").collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert mixing.mix(none).count() == 0
    mixed = mixing.materialise_mix(docs)
    assert mixed.columns == docs.columns


def plain_words(text):
    return len(text.encode().split())


@pytest.mark.parametrize("shard_words", [250_000, 300])
def test_copied_words_meet_the_targets(spark, docs, shard_words):
    long = " ".join(f"w{k}" + (" \n" if k % 7 == 0 else "") for k in range(3_000))
    some = [(k, f"{k} few words here", "many") for k in range(900)]
    df = spark.createDataFrame([(-1, long, "one"), (-2, " " + long, "another"), *some], "doc_id long, text string, source string")
    for table in (df, docs.select("doc_id", "text", "source")):
        sizes, copied = Counter(), Counter()
        texts = {r["text"] for r in table.collect()}
        for r in table.collect():
            sizes[r["source"]] += plain_words(r["text"] or "")
        for r in mixing.materialise_mix(table, shard_words=shard_words).collect():
            copied[r["source"]] += plain_words(r["text"] or "")
            # A part of a text, with its white space.
            assert r["text"] in texts or any(r["text"] in t for t in texts if t)
        want = plain_targets(sizes)
        for s in want:
            assert abs(copied[s] - want[s]) <= max(0.02 * want[s], 12), s


def test_word_range(spark):
    text = " one\ttwo  three\n\nfour é.\u2003x "
    df = spark.createDataFrame([(text, a, b) for a in range(5) for b in range(a + 1, 6)], "t string, a long, b long")
    for r in df.select("*", mixing.word_range(F.col("t"), F.col("a"), F.col("b")).alias("x")).collect():
        assert r["x"] in text and r["x"].encode().split() == text.encode().split()[r["a"] : r["b"]]


# ---- pipeline -----------------------------------------------------------------


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline as p

    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs.select(columns).write.parquet(str(tmp_path / "documents.parquet"))
    out = p.run(spark, str(tmp_path))
    assert out.columns == [*columns, "token_ids"]
    # Against the stages' own brute forces.
    from tests.llm.test_text_operators import plain_measure

    now = docs.select(columns)
    good = p.quality_rules(spark, now, "")
    assert all(not plain_measure(r["text"] or "")[5] for r in good.collect())
    kept = p.near_duplicates(spark, good, "")
    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    _, group, _ = plain_join(rows, 5, 80)
    assert kept.count() == len(group)
    assert out.count() > 0 and out.where("text like '%@mail.example.com%'").count() == 0
    for name, stage in p.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == columns, name


def test_pipeline_decodes_every_text(spark, docs, none, tmp_path, monkeypatch):
    import corpus_pipeline as p

    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    got = p.byte_bpe(spark, docs.select(columns), "")
    assert got.columns == [*columns, "token_ids", "decoded_sha256"]
    got = got.collect()
    assert len(got) == docs.count()
    for r in got:
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert p.byte_bpe(spark, none.select(columns), "").count() == 0
    # Ids that lose a token do not pass.
    docs.select(columns).write.parquet(str(tmp_path / "documents.parquet"))
    encode = p.bpe.encode
    monkeypatch.setattr(p.bpe, "encode", lambda *a: encode(*a).withColumn("token_ids", F.expr("slice(token_ids, 2, size(token_ids))")))
    monkeypatch.setattr(p, "STAGES", p.STAGES[-1:])
    with pytest.raises(ValueError, match="decode"):
        p.run(spark, str(tmp_path))
