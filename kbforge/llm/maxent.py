"""Operator 4: language-model scoring by a hashed maximum-entropy model.

Tokens are words with A-Z lower-cased and one end per text.  The probability of
a token is factored by class:

    P(token | history) = P(class | history) * P(token | class)

``P(class | history)`` is a softmax over hashed features of the history: the
previous word, the pair before, and two skips (the second and the third word
back).  ``P(token | class)`` is a smoothed share of counts.  The most frequent
tokens are classes of their own; the others fall into bands of frequency, the
last of which holds the rare and the unknown.

Training reads all training texts twice: counts of words, then joint counts of
(feature, class), which give the starting weights; gradient rounds follow, each
over all training texts.  Tasks return sums (of counts or of gradients)
that Spark adds; the weights, a table of fixed size, go back to the tasks.

Scoring works on whole Arrow batches in numpy.  Words frequent enough to be in
the lookup table (bounded: a word needs a share of ``FREQUENT_SHARE`` of all
tokens) are scored there; the rare ones of each text are joined with the count
table, by hash.  Words are told apart by 64 bits.

Defined results: a null or empty text is one end token; repeated rows are
learned from as often as they occur and scored each; a null id counts as
training text; without training texts all counts are zero and every score is
that of unknown tokens; an empty table gives an empty table; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbforge.llm.common import stored, whole_text
from kbforge.llm.shingles import mix, text_bytes, word_hashes

SMOOTH = 0.1
#: The lookup table holds words above this share of the training tokens, so
#: at most its inverse: 1,048,576 words of 17 bytes.
FREQUENT_SHARE = 1 / (1 << 20)
#: Classes: the most frequent tokens, and bands of the other ranks.
TOP_TOKENS, BANDS = 18, (64, 256, 1_024, 4_096, 65_536)
TEMPLATES, BUCKETS = 4, 4_096
#: Pseudo-counts of the starting weights, and their scale (features overlap).
PRIOR, SCALE = 20.0, 0.45
#: Gradient rounds, each over all training texts, and the step (the templates
#: of a token move together, so each goes a part of the way).
ROUNDS, STEP = 2, 0.25
#: Tokens counted, or scored, at a time.
HELD_TOKENS, STEP_TOKENS = 8_000_000, 1 << 16
CHUNK = 64

END = np.uint64(0x1D8E4E27C47D124F)


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of a batch of texts, an end after each, and the end
    places (exclusive) of the texts in them, from 0 on."""
    hashed, ends = word_hashes(*text_bytes(column))
    n = len(ends) - 1
    at = ends[1:] + np.arange(n)
    out = np.empty(len(hashed) + n, np.uint64)
    is_end = np.zeros(len(out), bool)
    is_end[at] = True
    out[is_end] = END
    out[~is_end] = hashed
    return out, np.append(0, at + 1)


@dataclass
class Vocabulary:
    """Frequent words sorted by hash, with counts and classes, and the class sizes."""

    words: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    class_logs: np.ndarray  # log10 of what a class's smoothed counts add to
    log_prior: np.ndarray  # natural log of the class shares
    tokens: int
    distinct: int

    def find(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the table, and whether the token is there."""
        if not len(self.words):
            return np.zeros(len(tokens), np.int64), np.zeros(len(tokens), bool)
        at = np.searchsorted(self.words, tokens)
        np.minimum(at, len(self.words) - 1, out=at)
        return at, self.words[at] == tokens

    def class_of(self, at: np.ndarray, known: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(at), len(self.class_logs) - 1)
        return np.where(known, self.classes[at], len(self.class_logs) - 1)


def vocabulary(words: np.ndarray, counts: np.ndarray, tokens: int, distinct: int) -> Vocabulary:
    order = np.lexsort((words, -counts))
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    classes = np.where(rank < TOP_TOKENS, rank, TOP_TOKENS + np.searchsorted(BANDS, rank, side="right"))
    n_classes = TOP_TOKENS + len(BANDS) + 2
    size = np.bincount(classes, weights=counts, minlength=n_classes)
    kinds = np.bincount(classes, minlength=n_classes).astype(float)
    size[-1] += tokens - counts.sum()
    kinds[-1] += distinct - len(words)
    by_hash = np.argsort(words)
    return Vocabulary(
        words[by_hash],
        counts[by_hash],
        classes[by_hash].astype(np.int16),
        np.log10(size + SMOOTH * (kinds + 1)),
        np.log((size + SMOOTH * (kinds + 1)) / (tokens + SMOOTH * (distinct + n_classes))).astype(np.float32),
        tokens,
        distinct,
    )


def count_words(texts: DataFrame) -> DataFrame:
    """``(word, c)`` over all texts, words by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            word, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(c.astype(np.int64))], ["word", "c"])

        for batch in batches:
            tokens, _ = _tokens(batch.column(0))
            held.append(tokens)
            size += len(tokens)
            if size >= HELD_TOKENS:
                yield counted()
                held, size = [], 0
        if held:
            yield counted()

    return texts.mapInArrow(run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _features(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Buckets of the history features (templates x tokens).  Before the first
    token of a text stand beginnings, one for each place."""
    n = len(tokens)
    back = np.arange(n) - np.repeat(starts[:-1], np.diff(starts))
    h = [np.full(n, np.uint64(k + 1)) for k in range(3)]
    for k in range(3):
        h[k][k + 1 :] = tokens[: n - k - 1]
        h[k][back <= k] = np.uint64(k + 1)
    bits = np.uint64(64 - BUCKETS.bit_length() + 1)
    last = h[0] * np.uint64(0x9E3779B97F4A7C15)
    pair = mix(last + h[1])
    raw = (mix(h[0]), pair, mix(h[1] ^ np.uint64(0xABCDEF)), mix(h[2] ^ np.uint64(0x123457)))
    return np.stack([x >> bits for x in raw]).astype(np.int32)


def _logits(features: np.ndarray, weights: np.ndarray, prior: np.ndarray) -> np.ndarray:
    out = weights[0].take(features[0], axis=0)
    for k in range(1, TEMPLATES):
        out += weights[k].take(features[k], axis=0)
    out += prior
    out -= out.max(axis=1, keepdims=True)
    return out


def _summed(parts: DataFrame) -> np.ndarray:
    """Add the tables that tasks return in chunks ``(chunk, data)``; every
    chunk is added in one stream, so no task holds more than its chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(data.as_py(), np.float32)
                if chunk in sums:
                    sums[chunk] += x
                else:
                    sums[chunk] = x.astype(np.float64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["chunk", "data"]
        )

    n = TEMPLATES * BUCKETS // CHUNK
    rows = parts.repartition(n // 8, "chunk").mapInArrow(run, "chunk int, data binary").collect()  # a table of fixed size
    width = len(rows[0]["data"]) // 8 // CHUNK if rows else 0
    out = np.zeros((n, CHUNK * width))
    for r in rows:
        out[r["chunk"]] = np.frombuffer(r["data"])
    return out.reshape(TEMPLATES, BUCKETS, width)


def _chunks(table: np.ndarray) -> pa.RecordBatch:
    flat = table.reshape(TEMPLATES * BUCKETS // CHUNK, -1).astype(np.float32)
    some = np.flatnonzero(flat.any(axis=1))
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([flat[i].tobytes() for i in some], pa.binary())], ["chunk", "data"])


def joint_counts(texts: DataFrame, vocab) -> np.ndarray:
    """How often each feature stands before each class (templates, buckets, classes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocab.value
        width = len(v.class_logs)
        out = np.zeros((TEMPLATES, BUCKETS * width))
        for batch in batches:
            tokens, starts = _tokens(batch.column(0))
            cls = v.class_of(*v.find(tokens))
            features = _features(tokens, starts)
            for k in range(TEMPLATES):
                out[k] += np.bincount(features[k] * width + cls, minlength=BUCKETS * width)
        yield _chunks(out.reshape(TEMPLATES, BUCKETS, width))

    return _summed(texts.mapInArrow(run, "chunk int, data binary"))


def gradient(texts: DataFrame, vocab, weights) -> np.ndarray:
    """Sum over tokens of (1 if the class occurred - its probability), for
    every feature of the token's history."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, w = vocab.value, weights.value
        width = len(v.class_logs)
        out = np.zeros((TEMPLATES, BUCKETS, width))
        for batch in batches:
            tokens, starts = _tokens(batch.column(0))
            cls = v.class_of(*v.find(tokens))
            features = _features(tokens, starts)
            # Half steps stay in the cache; 16-bit buckets are sorted by radix.
            step = STEP_TOKENS // 2
            for a in range(0, len(tokens), step):
                f, c = features[:, a : a + step], cls[a : a + step]
                p = _logits(f, w, v.log_prior)
                np.exp(p, out=p)
                p /= -p.sum(axis=1, keepdims=True)
                p[np.arange(len(c)), c] += 1
                for k in range(TEMPLATES):
                    buckets = f[k].astype(np.uint16)
                    order = np.argsort(buckets, kind="stable")
                    sorted_f = buckets[order]
                    first = np.flatnonzero(np.append(True, sorted_f[1:] != sorted_f[:-1]))
                    out[k][sorted_f[first]] += np.add.reduceat(p.take(order, axis=0), first, axis=0)
        yield _chunks(out)

    return _summed(texts.mapInArrow(run, "chunk int, data binary"))


def fit(training: DataFrame, rounds: int = ROUNDS):
    """The vocabulary, the weights and the table of all counts of
    ``training(text)``."""
    spark = training.sparkSession
    counts = stored(count_words(training.select("text")))
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    tokens, distinct = int(total[0]), int(total[1])
    often = counts.where(F.col("c") > max(tokens * FREQUENT_SHARE, 1)).toPandas()
    table = vocabulary(often.word.to_numpy(np.int64).view(np.uint64), often.c.to_numpy(np.int64), tokens, distinct)
    vocab = spark.sparkContext.broadcast(table)
    joint = joint_counts(training.select("text"), vocab)
    width = len(table.class_logs)
    weights = np.zeros((TEMPLATES, BUCKETS, width), np.float32)
    if joint.any():
        prior = np.exp(table.log_prior.astype(float))
        seen = joint.sum(axis=2, keepdims=True)
        weights = (SCALE * (np.log((joint + PRIOR * prior) / (seen + PRIOR)) - table.log_prior)).astype(np.float32)
        for _ in range(rounds):
            sent = spark.sparkContext.broadcast(weights)
            g = gradient(training.select("text"), vocab, sent)
            weights = (weights + STEP * g / (seen * prior + PRIOR)).astype(np.float32)
    return vocab, spark.sparkContext.broadcast(weights), counts


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``."""
    text = whole_text(text_col)
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 10 == 0, F.lit(False))
    docs = df.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), F.xxhash64(text).alias("key"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    vocab, weights, counts = fit(docs.where(~F.col("held_out")).select("text"))
    table = vocab.value
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, w = vocab.value, weights.value
        log_c = np.log10(v.counts + SMOOTH)
        rare_type = pa.list_(pa.struct([("word", pa.int64()), ("tf", pa.int64())]))
        for batch in batches:
            tokens, starts = _tokens(batch.column(4))
            n = len(starts) - 1
            row = np.repeat(np.arange(n), np.diff(starts))
            at, known = v.find(tokens)
            cls = v.class_of(at, known)
            frequent = np.where(known, log_c[at], 0.0) if len(log_c) else np.zeros(len(tokens))
            model = -v.class_logs[cls]
            features = _features(tokens, starts)
            for a in range(0, len(tokens), STEP_TOKENS):
                f, c = features[:, a : a + STEP_TOKENS], cls[a : a + STEP_TOKENS]
                logits = _logits(f, w, v.log_prior)
                own = logits[np.arange(len(c)), c]
                model[a : a + STEP_TOKENS] += (own - np.log(np.exp(logits).sum(axis=1))) / np.log(10)
            # The rare words of each text, counted.
            word, who = tokens[~known], row[~known]
            order = np.lexsort((word, who))
            word, who = word[order], who[order]
            first = np.flatnonzero(np.append(True, (np.diff(word) != 0) | (np.diff(who) != 0))) if len(word) else np.zeros(0, np.int64)
            tf = np.diff(np.append(first, len(word)))
            rare = pa.StructArray.from_arrays([pa.array(word[first].view(np.int64)), pa.array(tf, pa.int64())], ["word", "tf"])
            offsets = np.searchsorted(who[first], np.arange(n + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:4],
                    pa.array(np.diff(starts)),
                    pa.array(np.bincount(row, weights=known, minlength=n).astype(np.int64)),
                    pa.array(np.bincount(row, weights=frequent, minlength=n)),
                    pa.array(np.bincount(row, weights=model, minlength=n)),
                    pa.ListArray.from_arrays(pa.array(offsets), rare).cast(rare_type),
                ],
                ["doc_id", "held_out", "key", "n_bytes", "n_tokens", "n_frequent", "frequent", "model", "rare"],
            )

    rows = docs.mapInArrow(
        run,
        f"doc_id {kind}, held_out boolean, key long, n_bytes long, n_tokens long, n_frequent long, frequent double, model double, rare array<struct<word:long,tf:long>>",
    )
    rows = stored(rows)
    # Rare words by text; equal texts add up and are divided again.
    pairs = rows.select("key", "n_bytes", F.explode("rare").alias("r")).select("key", "n_bytes", "r.word", "r.tf")
    rare_counts = counts.where(F.col("c") <= max(table.tokens * FREQUENT_SHARE, 1))
    c = F.coalesce("c", F.lit(0))
    rare = (
        pairs.join(rare_counts, "word", "left")
        .groupBy("key", "n_bytes")
        .agg(F.sum(F.col("tf") * F.log10(c + SMOOTH)).alias("rare"), F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("n_rare"))
    )
    copies = rows.groupBy("key", "n_bytes").agg(F.count(F.lit(1)).alias("copies"))
    per_text = copies.join(rare, ["key", "n_bytes"], "left").select(
        "key", "n_bytes", (F.coalesce("rare", F.lit(0.0)) / F.col("copies")).alias("rare_log"), (F.coalesce("n_rare", F.lit(0)) / F.col("copies")).cast("long").alias("n_rare")
    )
    logs = F.col("frequent") + F.col("rare_log")
    whole = float(np.log10(table.tokens + SMOOTH * (table.distinct + 1)))
    return rows.drop("rare").join(per_text, ["key", "n_bytes"]).select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_frequent") + F.col("n_rare")).alias("n_known"),
        F.lit(table.tokens).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(whole)).alias("base_score"),
        (logs + F.col("model")).alias("score"),
    )
