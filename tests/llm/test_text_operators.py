"""PII, quality rules, byte-level BPE, language model: against plain Python."""

import hashlib
import math
import random
import time
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from kbforge.llm import bpe, maxent, pii, quality
from kbforge.llm.queries import tokenizer

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


# ---- 1: personal data ---------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[ -]", "", m.group())
        if 16 <= len(digits) <= 19 and pii.luhn(digits):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


def test_base_spans_equal_the_patterns():
    rng = random.Random(2)
    parts = ["a", "b.c", "@", "x.y", "1", "22", "333", ".", "-", " ", "+", "4111 1111 1111 1111", "4111111111111111", "(", "%", "é"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert pii.base_spans(text) == plain_spans(text)


def test_base_spans_of_long_words_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 100_000, "+1" + "(" * 200_000):
        pii.base_spans(text)


def test_report(docs, none, rows):
    got = pii.report(pii.extract(docs)).collect()
    assert len(got) == len(rows)
    want = Counter()
    for i, t in rows:
        spans = plain_spans(t or "")
        want[(i, *[sum(s[0] == k for s in spans) for k in pii.KINDS], sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()))] += 1
    assert Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got) == want
    assert pii.report(pii.extract(none)).count() == 0


def test_contexts_reveal_what_the_grammars_miss(spark):
    rng = random.Random(1)
    texts = [f"{w} you can call her at +1 415 555 01{k:02d} any time" for k, w in enumerate("abcdefghijkl")]
    texts += [f"{w} you can write to her at jo{k}@mail{k}.example.com today" for k, w in enumerate("abcdefgh")]
    hidden = ["so you can call her at 415 555 0199 any time", "so you can write to her at jo(at)example.org today"]
    clean = ["page 12 of the 3000000 year old rock lay in 1234567 pieces", "version 3.0.0 was out"]
    texts += hidden + clean + ["x " * rng.randint(1, 5)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.report(pii.extract(df)).collect()}
    at = len(texts) - 5
    assert got[at] == "phone:23:35" and texts[at][23:35] == "415 555 0199"
    assert got[at + 1] == "email:27:44" and texts[at + 1][27:44] == "jo(at)example.org"
    assert got[at + 2] == got[at + 3] == ""
    red = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert red[at] == "so you can call her at [PHONE] any time" and red[at + 2] == clean[0]


def test_redact_keeps_rows_and_columns(docs, none):
    red = pii.redact(docs)
    assert red.columns == docs.columns and red.count() == docs.count()
    assert red.where("text is null").count() == docs.where("text is null").count()
    assert red.where("text like 'Mail me%'").first()["text"] == "Mail me: [EMAIL] or [PHONE], [IP]."
    assert pii.redact(none).count() == 0


def test_candidates_of_long_words_take_linear_time():
    for unit in ("a", "1", "@", "a@", "[at]", " at ", "1.", "+1 ", "a.", "x at y dot "):
        text = unit * (1_000_000 // len(unit))
        begun = time.perf_counter()
        spans = pii.base_spans(text)
        list(pii.candidates(text, spans))
        assert time.perf_counter() - begun < 10, unit


def test_spelled_addresses_and_rounds_to_a_fixed_point(spark):
    texts = [f"{w} please write to the clerk jo{k}@mail{k}.example.com before noon" for k, w in enumerate("abcdefgh")]
    # Found in the first round; their other context speaks for the last ones.
    bridge = [f"please write to the clerk ann{k} [at] host{k} [dot] org before noon" for k in range(5)]
    bridge += [f"{w} the new desk answers under ann{k} [at] host{k} [dot] org all day" for k, w in enumerate("vwxyz")]
    last = ["q the new desk answers under bob at farm dot example dot net all day"]
    df = spark.createDataFrame(list(enumerate(texts + bridge + last)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.report(pii.extract(df)).collect()}
    for k, t in enumerate(texts + bridge + last):
        assert len(got[k].split(",")) == 1 and got[k].startswith("email:"), t
    start, end = map(int, got[len(texts + bridge)].split(":")[1:])
    assert last[0][start:end] == "bob at farm dot example dot net"


def test_redact_takes_any_columns(spark):
    text = "Mail jo@mail.example.com now"
    odd = spark.createDataFrame([(1, text, 2.0, None)], "`a b` int, text string, `a.b` double, `c``d` string")
    out = pii.redact(odd)
    assert out.columns == odd.columns and out.first()["text"] == "Mail [EMAIL] now"
    assert pii.redact(odd.select("text")).first()["text"] == "Mail [EMAIL] now"


# ---- 2: quality rules ---------------------------------------------------------


def plain_measure(text):
    words = SPLIT.findall(text)
    lines = [x for x in text.split("\n") if SPLIT.search(x)]
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if seen[tuple(words[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_measures(docs, none, rows):
    judged = quality.apply_rules(quality.measure(docs))
    got = judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert Counter(tuple(r)[:7] for r in got) == Counter((i, *plain_measure(t or "")) for i, t in rows)
    assert not any(r["kept"] and r["base_failed"] for r in got)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)
    assert quality.keep_good(none).count() == 0


def test_verdicts(spark):
    good = "The quick brown fox jumps over the lazy dog and then it runs to the river in the dark of the night " * 1
    rows = [(0, good), (1, good.replace(" ", "### ")), (2, good + good + good), (3, "zq wx vb " * 3 + "plk jhg fds dsa " * 4)]
    got = {r["doc_id"]: r for r in quality.apply_rules(quality.measure(spark.createDataFrame(rows, "doc_id long, text string"))).selectExpr("row.doc_id", "failed_rules", "kept").collect()}
    assert got[0]["kept"] and not any(got[k]["kept"] for k in (1, 2, 3))
    assert "symbol_ratio" in got[1]["failed_rules"] and "repeated_windows" in got[2]["failed_rules"] and "stop_words" in got[3]["failed_rules"]


# ---- 3: byte-level BPE --------------------------------------------------------


def test_digests(docs, none, rows):
    rank_file, pattern = tokenizer()
    enc = bpe.encoding(rank_file, pattern)
    coded = bpe.decode(bpe.encode(docs, rank_file, pattern), rank_file, pattern)
    want = Counter()
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        want[(i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode()))] += 1
    assert Counter(tuple(r) for r in bpe.digests(coded).collect()) == want
    assert bpe.digests(bpe.decode(bpe.encode(none, rank_file, pattern), rank_file, pattern)).count() == 0


def test_pieces_join_to_the_whole(monkeypatch):
    rank_file, pattern = tokenizer()
    enc = bpe.encoding(rank_file, pattern)
    monkeypatch.setattr(bpe, "PIECE_CHARS", 40)
    monkeypatch.setattr(bpe, "_LONG_SPACES", re.compile(r"[^\S\x1c-\x1f]{8,}"))
    whole = bpe.pieces
    monkeypatch.setattr(bpe, "pieces", lambda text: whole(text, 40))
    rng = random.Random(3)
    parts = ["a", "b", "Z", "1", " ", "  ", "\n", "'s", "'t", "!", "é", "日", "\t", " ", "\x1c", "\u0085", " " * 20, "\n" * 12, "-", "😀", "̈", "<|endoftext|>"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(30, 300)))
        assert bpe.encode_text(enc, text).tolist() == enc.encode_ordinary(text)


def test_long_runs_are_encoded():
    rank_file, pattern = tokenizer()
    enc = bpe.encoding(rank_file, pattern)
    for text in ("a" * 200_000, " " * 200_000 + "x", "x" + " \n" * 300_000 + "y", "\t " * 100_000, "日本" * 50_000):
        assert enc.decode_bytes(bpe.encode_text(enc, text).tolist()) == text.encode()


# ---- 4: language model --------------------------------------------------------


def test_scores(docs, none, rows):
    got = maxent.score(docs).collect()
    tokens = lambda t: (t or "").encode().lower().split() + [b""]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = {}
    for i, t in rows:
        w = tokens(t)
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        want.setdefault((i, held(i), len(w), sum(c[x] > 0 for x in w), n), []).append(base)
    assert len(got) == len(rows)
    for r in got:
        known = want[(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"])]
        assert any(math.isclose(r["base_score"], b, rel_tol=1e-9) for b in known)
        assert r["score"] < 0 and math.isfinite(r["score"])
    assert maxent.score(none).count() == 0


def test_every_training_text_gives_gradients(spark, docs, monkeypatch):
    seen, inner = [], maxent.gradient
    monkeypatch.setattr(maxent, "gradient", lambda texts, *a: seen.append(texts.collect()) or inner(texts, *a))
    same = docs.select(F.lit(None).cast("long").alias("doc_id"), "text")
    other = docs.select(F.lit(1).cast("long").alias("doc_id"), "text")
    a = sorted(r["score"] for r in maxent.score(same).collect())
    b = sorted(r["score"] for r in maxent.score(other).collect())
    want = Counter(r["text"] or "" for r in docs.collect())
    for texts in seen:
        assert Counter(r["text"] for r in texts) == want
    assert len(seen) == 2 * maxent.ROUNDS
    # Ids do not decide what is learned.
    assert all(math.isclose(x, y, rel_tol=1e-6) for x, y in zip(a, b, strict=True))


def test_class_probabilities_sum_to_one():
    import numpy as np

    words = np.arange(1, 200, dtype=np.uint64) * np.uint64(7919)
    counts = np.arange(199, 0, -1)
    v = maxent.vocabulary(words, counts, int(counts.sum()) + 50, 230)
    classes = np.bincount(v.classes, weights=v.counts + maxent.SMOOTH, minlength=len(v.class_logs))
    size = 10**v.class_logs
    # Every class keeps room for one unknown token; the last also for the rare.
    assert np.allclose(classes[:-1] + maxent.SMOOTH, size[:-1])
    assert np.isclose(np.exp(v.log_prior.astype(float)).sum(), 1, atol=1e-5)


def test_history_helps_on_held_out_text(spark):
    rng = random.Random(4)
    after = {w: rng.sample("abcdefghijklmnop", 2) for w in "abcdefghijklmnop"}

    def chain(n):
        out = [rng.choice("abcdefghijklmnop")]
        for _ in range(n):
            out.append(rng.choice(after[out[-1]]))
        return " ".join(out)

    df = spark.createDataFrame([(i, chain(60)) for i in range(600)], "doc_id long, text string")
    r = maxent.score(df).where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert r[1] > 0.6 * r[0]
