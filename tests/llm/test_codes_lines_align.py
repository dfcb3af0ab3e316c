"""Vector codes, line de-duplication, token alignment."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kbforge.llm import align, codes, lines
from kbforge.llm.common import stored

# ---- 11: vector codes ---------------------------------------------------------


def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in kept]
    lengths = Counter(len(v) for _, v, _ in kept)
    length = max(lengths, key=lambda n: (lengths[n], n))
    kept = sorted((r for r in kept if len(r[1]) == length), key=lambda r: (r[0] is None, r[0], r[1]))
    ends = [k * length // parts for k in range(parts + 1)]
    part = lambda v, k: v[ends[k] : ends[k + 1]]
    books = [[part(v, k) for _, v, _ in kept[:entries]] for k in range(parts)]

    def best(k, p):
        d = [sum((x - y) ** 2 for x, y in zip(p, e)) for e in books[k]]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v, _ in kept:
            for k in range(parts):
                groups[k, best(k, part(v, k))[0]].append(part(v, k))
        for (k, e), members in groups.items():
            books[k][e] = [sum(c) // len(members) for c in zip(*members)]
    out, by_label = [], Counter()
    for i, v, label in kept:
        found = [best(k, part(v, k)) for k in range(parts)]
        error = sum(d for _, d in found)
        by_label[label] += error
        out.append((i, "".join(f"{e:02x}" for e, _ in found), error, label))
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return Counter((i, c, e, by_label[label], digest) for i, c, e, label in out)


VECTOR = "vec_id long, embedding array<float>, label int, code string, x int, n string, total string"


def _vectors(n, length, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, length))
    rows = []
    for i in range(n):
        v = (centres[i % 5] + rng.normal(size=length) * 0.3).astype(np.float32)
        rows.append((i, [float(x) for x in v], None if i % 7 == 0 else i % 3))
    return rows


@pytest.mark.parametrize("length", [16, 20, 5])
def test_codes_equal_brute_force(spark, length):
    rows = _vectors(150, length)
    rows += [rows[4], rows[4], (3, rows[9][1], 1), (None, rows[5][1], 2), (None, rows[6][1], None), (900, None, 1), (901, [], 1), (902, rows[0][1][:-1], 1)]
    rows += [(903, [float("nan"), *rows[0][1][1:]], 0), (904, [float("inf"), *rows[0][1][1:]], 0), (905, [None, *rows[0][1][1:]], 0), (906, [0.0] * length, 0)]
    df = spark.createDataFrame([(*r, "c", 1, "n", "t") for r in rows], VECTOR).repartition(3)
    got = codes.report(*codes.compress(df)).collect()
    assert Counter(map(tuple, got)) == plain_codes(rows)


def test_codes_of_few_or_no_rows(spark):
    few = [(i, [0.5 * i, -0.25], 1) for i in range(3)]
    df = spark.createDataFrame([(*r, "c", 1, "n", "t") for r in few], VECTOR)
    assert Counter(map(tuple, codes.report(*codes.compress(df)).collect())) == plain_codes(few)
    assert codes.report(*codes.compress(df.limit(0))).count() == 0
    huge = [(0, [3e38, -3e38] * 8, 1), (1, [0.0, 1.0] * 8, 1)]
    out = codes.report(*codes.compress(spark.createDataFrame([(*r, "c", 1, "n", "t") for r in huge], VECTOR)))
    assert [r["error"] for r in out.collect()] == [0, 0]


def test_pivots_spare_evaluations_and_lose_none():
    rng = np.random.default_rng(1)
    centres = rng.integers(-4000, 4000, (16, 8))
    x = centres[rng.integers(0, 16, (400, 8))] + rng.integers(-300, 300, (400, 8, 8))
    books = np.stack([centres[rng.permutation(16)] for _ in range(8)])
    books[:, 5] = books[:, 2]  # ties
    pivots = np.stack([codes.far_apart(b, 4) for b in books])
    which, d, evaluated = codes.nearest(x, codes.pivot_distances(x, pivots), books, pivots)
    full = ((x[:, :, None, :] - books[None]) ** 2).sum(axis=3)
    assert (which == full.argmin(axis=2)).all() and (d == full.min(axis=2)).all()
    assert evaluated < 0.5 * full.size


def test_decoded_vectors_are_as_far_as_the_error_says(spark):
    rows = _vectors(60, 16)
    df = spark.createDataFrame([(*r, "c", 1, "n", "t") for r in rows], VECTOR)
    found, books, length = codes.compress(df)
    for r in codes.decode(found, books, length).collect():
        exact = [math.floor(4096 * x) for x in dict((i, v) for i, v, _ in rows)[r["vec_id"]]]
        assert sum((a - math.floor(4096 * b)) ** 2 for a, b in zip(exact, r["decoded"])) == r["error"]


# ---- 12: lines ----------------------------------------------------------------


def plain_lines(rows, min_docs, keep):
    strip = " \t\n\x0b\x0c\r"
    lower = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    docs = [(i, [(line, lower(line.strip(strip))) for line in (t or "").split("\n")]) for i, t in rows]
    held = Counter(k for _, found in docs for k in {k for _, k in found if k})
    out = Counter()
    for i, found in docs:
        kept = [line for line, k in found if held[k] < min_docs]
        out[(i, len(found), len(found) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())] += 1
    return out


@pytest.fixture(scope="module")
def lined(spark):
    rng = random.Random(2)
    common = ["All rights reserved.", "  ALL RIGHTS reserved.\t", "home | news", "é\x0b", "　", "x"]
    rows = []
    for i in range(300):
        found = [" ".join(rng.choice("abcde") for _ in range(rng.randint(0, 3))) for _ in range(rng.randint(0, 6))]
        found += [rng.choice(common) for _ in range(rng.randint(0, 3))]
        if i % 3 == 0:
            found = ["Hot line", *found, "hot line "]
        rng.shuffle(found)
        rows.append((i, "\n".join(found)))
    rows += [(5, rows[5][1]), (5, rows[5][1]), (None, rows[6][1]), (None, None), (900, ""), (901, "\n\n"), (902, "z\n" * 5000), *[(7, "only\ncopies")] * 11]
    schema = "doc_id long, text string, n_lines string, keep string, a long, pos int"
    return spark.createDataFrame([(*r, "n", "k", 1, 2) for r in rows], schema).repartition(4).cache(), rows


@pytest.mark.parametrize(("min_docs", "parts"), [(10, 3), (2, 40), (10, 200), (1, 3)])
def test_lines_equal_brute_force(spark, lined, min_docs, parts):
    df, rows = lined
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)  # 200: a run of equal hashes over many tasks
    try:
        bitmaps = lines.keep_bitmaps(df, min_docs=min_docs)
        assert Counter(map(tuple, lines.report(df, bitmaps).collect())) == plain_lines(rows, min_docs, "none")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("parts", [2, 60])
def test_first_lines_stay(spark, lined, parts):
    df, _ = lined
    one = df.where("doc_id < 300").dropDuplicates(["doc_id"])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        out = lines.apply_bitmaps(one, lines.keep_bitmaps(one, min_docs=2, keep="first"))
        assert out.columns == df.columns
        kept = {r["doc_id"]: r["text"] for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    texts = {r["doc_id"]: r["text"] for r in one.collect()}
    held = Counter(k for t in texts.values() for k in {lines.line_key(x.encode()) for x in t.split("\n")})
    seen = set()
    for i in sorted(texts):
        want = []
        for line in texts[i].split("\n"):
            k = lines.line_key(line.encode())
            if not k or held[k] < 2 or k not in seen:
                want.append(line)
            seen.add(k)
        assert kept[i] == "\n".join(want)


def test_lines_of_the_corpus(docs, rows, none):
    bitmaps = stored(lines.keep_bitmaps(docs, min_docs=2))
    assert Counter(map(tuple, lines.report(docs, bitmaps).collect())) == plain_lines(rows, 2, "none")
    assert lines.report(none, lines.keep_bitmaps(none)).count() == 0
    for r in bitmaps.collect():
        keep = lines.unpack(r["keep"], r["n_lines"])
        assert len(keep) == r["n_lines"] and (~keep).sum() == r["n_dropped"] > 0
    with pytest.raises(ValueError):
        lines.keep_bitmaps(docs, keep="last")


def test_long_and_short_keys(spark):
    rows = [(i, "é\nab\nabc\nABC ") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = lines.apply_bitmaps(df, lines.keep_bitmaps(df, min_chars=2)).select("text").distinct().collect()
    assert [r["text"] for r in got] == ["é"]


# ---- 13: alignment ------------------------------------------------------------


def files():
    import public_tokenizers as P

    return P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.PATTERN


def plain_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a_file, b_file, _ = files()
    a_of, b_of = Tokenizer.from_file(a_file), sentencepiece.SentencePieceProcessor(model_file=b_file)
    a_of.encode_special_tokens = True
    to_byte = align.byte_decoder()
    b_bytes = lambda i: bytes([int(b_of.id_to_piece(i)[3:5], 16)]) if b_of.is_byte(i) else b_of.id_to_piece(i).replace("▁", " ").encode()
    found = []
    for _, t in rows:
        ids = [], []
        if t:
            a = a_of.encode(" " + t, add_special_tokens=False).ids
            b = b_of.encode(t)
            a_parts, b_parts = [bytes(to_byte[c] for c in a_of.id_to_token(i)) for i in a], [b_bytes(i) for i in b]
            if b"".join(a_parts) == b"".join(b_parts) == (" " + t).encode():
                ids = list(zip(a, a_parts)), list(zip(b, b_parts))
        spans = []
        for side in ids:
            at, out = 0, []
            for i, x in side:
                out.append((i, at, at + len(x)))
                at += len(x)
            spans.append(out)
        links, j = [], 0
        for i, lo, hi in spans[0]:
            while spans[1][j][2] <= lo:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][1] < hi:
                links.append((i, spans[1][k][0]))
                k += 1
        common = sorted({x[2] for x in spans[0]} & {x[2] for x in spans[1]})
        groups, lo = [], 0
        for end in common:
            groups.append(tuple([i for i, s, e in side if lo <= s and e <= end] for side in spans) if len(common) < 300 else None)
            lo = end
        found.append((len(spans[0]), len(spans[1]), groups, links, common, spans))
    count = Counter(p for f in found for p in set(f[3]))
    most = Counter()
    for (i, _), n in count.items():
        most[i] = max(most[i], n)
    out = Counter()
    for (doc_id, _), (n_a, n_b, groups, links, common, spans) in zip(rows, found):
        if groups and groups[0] is None:
            number = {}
            for side in (0, 1):
                g = np.searchsorted(common, [e for _, _, e in spans[side]])
                for (i, _, _), k in zip(spans[side], g.tolist()):
                    number.setdefault(k, ([], []))[side].append(i)
            groups = [number[k] for k in range(len(common))]
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if links else ""
        best = sum(count[p] == most[p[0]] for p in links)
        out[(doc_id, n_a, n_b, len(groups), len(links), best, sum(count[p] for p in links), digest)] += 1
    return out


ODD = ["▁ x", "a▁b", "<s> </s> <unk> <|endoftext|> <0x41>", "\x00\x01", "日本語のテキスト と 漢字", "🙂🙂 👩‍👩‍👧 ok", "مرحبا بالعالم", "é ﬁ ① Å", "  two  spaces ", "\n\n\tx\r\n", " ", "it's we'LL 'd", "a" * 5000, " " * 700 + "x", " \xa0　x", "１２３ ⅷ ²"]


@pytest.mark.parametrize(("frequent", "chunk", "gather"), [(1 << 20, 200_000, 1_000_000), (50, 40, 100), (0, 200_000, 5_000)])
def test_alignment_equals_brute_force(spark, docs, rows, monkeypatch, frequent, chunk, gather):
    monkeypatch.setattr(align, "CHUNK_CHARS", chunk)
    monkeypatch.setattr(align, "CHUNK_TOKENS", gather)
    extra = [(1000 + k, t) for k, t in enumerate(ODD)]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    aligned = stored(align.align(df, *files()))
    got = align.link_counts(aligned, align.vocabulary_size(files()[1]), frequent)
    assert Counter(map(tuple, got.collect())) == plain_alignment(rows + extra)


def test_tokens_of_groups_are_kept(spark, none):
    df = spark.createDataFrame([(1, "unbelievable tokenization, twice twice"), (2, None)], "doc_id long, text string")
    one, empty = align.align(df, *files(), tokens=True).orderBy("doc_id").collect()
    a, b, at_a, at_b, groups = one["a_ids"], one["b_ids"], 0, 0, []
    for x, y in zip(one["a_in_group"], one["b_in_group"]):
        groups.append(",".join(map(str, a[at_a : at_a + x])) + "|" + ",".join(map(str, b[at_b : at_b + y])))
        at_a, at_b = at_a + x, at_b + y
    assert hashlib.sha256(";".join(groups).encode()).hexdigest() == one["groups_sha256"]
    assert (at_a, at_b, len(groups)) == (one["n_a"], one["n_b"], one["n_groups"])
    assert empty["a_ids"] == [] and empty["groups_sha256"] == "" and empty["n_links"] == 0
    assert align.link_counts(stored(align.align(none, *files())), align.vocabulary_size(files()[1])).count() == 0


@pytest.mark.parametrize("work", [1, 3, 64])
def test_pieces_of_the_merge(work):
    rng = np.random.default_rng(work)
    for n in (1, 2, 50, 400):
        a, b = (np.unique(np.append(rng.integers(1, 2 * n + 2, n), 2 * n + 2)) for _ in range(2))
        link_a, link_b, in_a, in_b = align.merge(a, b, work)
        lo = lambda x: np.append(0, x[:-1])
        want = [(i, j) for i in range(len(a)) for j in range(len(b)) if lo(a)[i] < b[j] and lo(b)[j] < a[i]]
        assert list(zip(link_a.tolist(), link_b.tolist())) == want
        common = np.intersect1d(a, b)
        assert (in_a == np.searchsorted(common, a)).all() and (in_b == np.searchsorted(common, b)).all()


def test_pattern_and_model_agree_on_every_character():
    """Characters alone and between letters: both libraries of A cut alike."""
    from tokenizers import Tokenizer

    a_file, b_file, pattern = files()
    a_of = Tokenizer.from_file(a_file)
    of = align.Tokenizers.load(a_file, b_file, pattern)
    texts = []
    for lo in range(0, 0x30000, 97):
        chars = [chr(c) for c in range(lo, lo + 97) if not 0xD800 <= c < 0xE000]
        texts.append(" " + "".join(f"{c}a{c} {c}1" for c in chars))
    for t, e in zip(texts, a_of.encode_batch(texts, add_special_tokens=False)):
        assert e.ids == of.a.encode_ordinary(t)


def test_stored_pairs_are_whole(spark, docs):
    aligned = stored(align.align(docs, *files()))
    assert aligned.where(F.aggregate("times", F.lit(0).cast("long"), lambda s, x: s + x) != F.col("n_links")).count() == 0
