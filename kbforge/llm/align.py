"""Operator 13: alignment of two tokenizers' tokens by merge-path partitioning.

Tokenizer A is byte-level BPE (``tokenizers`` file), B a sentencepiece model.
Both cut the same bytes, so the tokens' ends of A and B are two sorted lists:

1. Arrow batches of texts are encoded by both; the ends of all texts of a batch
   are laid one after the other.
2. The merge of the two lists is a path through a grid.  A binary search on
   every ``WORK``-th diagonal finds where the path crosses it, which divides
   the merge into independent pieces of equal work, however long a text is;
   all pieces are merged at once, a step of each at a time.
3. A piece emits a link for every byte range of one A and one B token.  Ends
   that A and B share close groups; groups that run over a piece's border are
   stitched by counting the closed ones over all pieces.
4. Documents that hold a linked pair of ids are counted per pair.  The
   ``FREQUENT`` pairs of the highest counts are broadcast and looked up where
   the text's pairs are, so no pair is hot in the join of the rest.

Texts longer than ``CHUNK_CHARS`` are cut where a space follows other
characters: there both tokenizers cut, as no match of A's pattern and no piece
of B's model holds a space after another character.

Defined results: a null or empty text, or one whose bytes a tokenizer changes,
has no tokens (zeros, digest ''); rows are counted as documents, so repeated
rows count each; other columns pass through; an empty table gives an empty
table.  Special-token strings in texts are ordinary text.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbforge.llm.bpe import encode_text
from kbforge.llm.common import stored, text_key, whole_text

#: Elements of the merge in one piece.
WORK = 64
#: Texts are encoded by so many characters at a time, and merged when so many
#: tokens have gathered.
CHUNK_CHARS = 200_000
CHUNK_TOKENS = 1_000_000
#: Pairs of the highest document counts that are broadcast (16 MB).
FREQUENT = 1 << 20

_CUT = re.compile(r"(?<=\S)(?= )")


def byte_decoder() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable
    Latin-1 characters stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Tokenizers:
    """Both tokenizers and the bytes of their tokens, loaded once in a worker."""

    _held: dict[tuple[str, str, str], Tokenizers] = {}

    def __init__(self, a_file: str, b_file: str, pattern: str):
        import sentencepiece
        import tiktoken

        of = byte_decoder()
        with open(a_file, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        ranks = {bytes(of[c] for c in token): i for token, i in vocabulary.items()}
        # Merges of a byte-level vocabulary are numbered as their results are,
        # so the ids are ranks.
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        self.a_bytes = _table({i: token for token, i in ranks.items()})
        pieces = {i: self.b.id_to_piece(i) for i in range(self.b.get_piece_size())}
        self.b_bytes = _table({i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces.items()})
        if len(self.a_bytes) * len(self.b_bytes) > 1 << 32:
            raise ValueError("a pair of ids must fit 32 bits")
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.a_text, self.b_text = _decimals(len(self.a_bytes), b",|"), _decimals(len(self.b_bytes), b",;")

    @classmethod
    def load(cls, *files: str) -> Tokenizers:
        if files not in cls._held:
            cls._held[files] = cls(*files)
        return cls._held[files]

    def encode(self, text: str) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of A for space + text and of B for the text, in parts that end
        where both cut; an empty list if a tokenizer changes the bytes."""
        whole, parts, start = " " + text, [], 0
        while start < len(whole):
            cut = _CUT.search(whole, start + CHUNK_CHARS) if len(whole) - start > CHUNK_CHARS else None
            end = cut.start() if cut else len(whole)
            part = whole[start:end]
            a = encode_text(self.a, part)
            b = np.array(self.b.encode(part[1:]), np.int32)  # B adds the space
            raw = part.encode()
            if b"".join(self.a_bytes[a].tolist()) != raw or b"".join(self.b_bytes[b].tolist()) != raw:
                return []
            parts.append((a, b))
            start = end
        return parts


def _table(of: dict[int, bytes]) -> np.ndarray:
    out = np.full(max(of) + 1, b"", object)
    for i, x in of.items():
        out[i] = x
    return out


def _decimals(n: int, ends: bytes) -> np.ndarray:
    """Decimal ids, each followed by one of the ends: row by end, column by id."""
    out = np.empty((len(ends), n), object)
    for k, e in enumerate(ends):
        out[k] = [b"%d%c" % (i, e) for i in range(n)]
    return out


def crossings(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many of the first ``d`` elements of the merge of two sorted lists
    come from ``a`` (first where equal), for each diagonal ``d``: one binary
    search on each, all in step."""
    low, high = np.maximum(diagonals - len(b), 0), np.minimum(diagonals, len(a))
    while True:
        busy = np.flatnonzero(low < high)
        if not len(busy):
            return low
        mid = (low[busy] + high[busy]) >> 1
        more = a[mid] <= b[diagonals[busy] - mid - 1]
        low[busy] = np.where(more, mid + 1, low[busy])
        high[busy] = np.where(more, high[busy], mid)


def merge(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The merge of the tokens' ends of A and B, which end alike.

    Returns, in order: the A and the B token of each link; and the group of
    each A and of each B token.
    """
    n = len(a) + len(b)
    starts = np.arange(0, n, work, dtype=np.int64)
    i = crossings(a, b, starts)
    j = starts - i
    # One sentinel each: nothing is left of that list.
    top = np.iinfo(a.dtype).max
    a, b = np.append(a, top), np.append(b, top)
    before = np.append(np.array([-1], a.dtype), a[:-1])  # the end before each A token's
    shape = (work, len(starts))
    at_a, at_b = np.zeros(shape, np.int32), np.zeros(shape, np.int32)
    from_a, closes = np.zeros(shape, bool), np.zeros(shape, bool)
    for k in range(work):
        at_a[k], at_b[k] = i, j
        x, y = a[i], b[j]
        take = x <= y
        from_a[k] = take
        # B's end was A's last one too: the link is out, the group is closed.
        closes[k] = ~take & (before[i] == y)
        i = i + take
        j = j + ~take
        # The last piece may be shorter; it stays at the sentinels.
        i[-1:] = np.minimum(i[-1:], len(a) - 1)
        j[-1:] = np.minimum(j[-1:], len(b) - 1)
    at_a, at_b, from_a, closes = (x.T.ravel()[:n] for x in (at_a, at_b, from_a, closes))
    # Stitching: a group's number is how many were closed before, in any piece.
    group = np.cumsum(closes)
    group -= closes
    links = ~closes
    return at_a[links], at_b[links], group[from_a], group[~from_a]


class _Batch:
    """Alignment of the texts of one Arrow batch."""

    def __init__(self, of: Tokenizers, n: int, tokens: bool):
        self.of, self.tokens = of, tokens
        self.n = np.zeros((4, n), np.int64)  # A tokens, B tokens, groups, links
        self.digest = [None] * n
        self.pairs = [[] for _ in range(n)]
        self.kept = [[[], [], [], []] for _ in range(n)]
        self.held, self.size = [], 0

    def add(self, row: int, text: str) -> None:
        for a, b in self.of.encode(text):
            if self.digest[row] is None:
                self.digest[row] = hashlib.sha256()
            self.held.append((row, a, b))
            self.size += len(a) + len(b)
            if self.size >= CHUNK_TOKENS:
                self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        rows, a_ids, b_ids = zip(*self.held, strict=True)
        a_to, b_to = np.cumsum([len(x) for x in a_ids]), np.cumsum([len(x) for x in b_ids])
        a_id, b_id = np.concatenate(a_ids), np.concatenate(b_ids)
        link_a, link_b, a_group, b_group = merge(np.cumsum(self.of.a_size[a_id]), np.cumsum(self.of.b_size[b_id]))
        groups = int(a_group[-1]) + 1
        a_in, b_in = np.bincount(a_group, minlength=groups), np.bincount(b_group, minlength=groups)
        a_last, b_last = np.cumsum(a_in), np.cumsum(b_in)
        # In the written form the A tokens of a group stand before its B tokens.
        written = np.empty(len(a_id) + len(b_id), object)
        a_end, b_end = np.zeros(len(a_id), np.int8), np.zeros(len(b_id), np.int8)
        a_end[a_last - 1] = 1
        b_end[b_last - 1] = 1
        written[np.arange(len(a_id)) + (b_last - b_in)[a_group]] = self.of.a_text[a_end, a_id]
        written[np.arange(len(b_id)) + a_last[b_group]] = self.of.b_text[b_end, b_id]
        pair = a_id[link_a].astype(np.uint32) * np.uint32(len(self.of.b_bytes)) + b_id[link_b].astype(np.uint32)
        links_to = np.searchsorted(link_a, a_to)
        g_to = a_group[a_to - 1] + 1
        a0 = b0 = l0 = g0 = 0
        for row, a1, b1, l1, g1 in zip(rows, a_to.tolist(), b_to.tolist(), links_to.tolist(), g_to.tolist(), strict=True):
            self.n[:, row] += (a1 - a0, b1 - b0, g1 - g0, l1 - l0)
            self.digest[row].update(b";" * bool(self.pairs[row]) + b"".join(written[a0 + b0 : a1 + b1].tolist())[:-1])
            self.pairs[row].append(np.unique(pair[l0:l1], return_counts=True))
            if self.tokens:
                parts = (a_id[a0:a1], b_id[b0:b1], a_in[g0:g1], b_in[g0:g1])
                for kept, part in zip(self.kept[row], parts, strict=True):
                    kept.append(part)
            a0, b0, l0, g0 = a1, b1, l1, g1
        self.held, self.size = [], 0

    def columns(self) -> list[pa.Array]:
        self.flush()
        pairs, times = [], []
        for found in self.pairs:
            p, n = found[0] if len(found) == 1 else _added(found)
            pairs.append(p.view(np.int32))
            times.append(n.astype(np.int32))
        digests = ["" if d is None else d.hexdigest() for d in self.digest]
        out = [pa.array(x) for x in self.n] + [pa.array(digests, pa.string()), _lists(pairs), _lists(times)]
        if self.tokens:
            out += [_lists([np.concatenate([np.zeros(0, np.int32), *k[c]]).astype(np.int32) for k in self.kept]) for c in range(4)]
        return out


def _added(found: list) -> tuple[np.ndarray, np.ndarray]:
    if not found:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    pairs, where = np.unique(np.concatenate([p for p, _ in found]), return_inverse=True)
    return pairs, np.bincount(where, np.concatenate([n for _, n in found])).astype(np.int64)


def _lengths(n) -> pa.Array:
    """Offsets of lists of ``n`` elements."""
    return pa.array(np.concatenate([[0], np.cumsum(n, dtype=np.int64)]).astype(np.int32))


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate([np.zeros(0, np.int32), *parts])
    return pa.ListArray.from_arrays(_lengths([len(x) for x in parts]), pa.array(flat, pa.int32()))


NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]
_SHAPE = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<int>"
_TOKENS = ", a_ids array<int>, b_ids array<int>, a_in_group array<int>, b_in_group array<int>"


def align(df: DataFrame, a_file: str, b_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", tokens: bool = False) -> DataFrame:
    """``(row, key, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times)``
    of every row: ``row`` is its id, ``key`` stands for its text, ``pairs`` are
    the distinct pairs of linked ids (A id times the size of B's vocabulary
    plus B id, as 32 bits) and ``times`` their links.  With ``tokens`` also the
    ids ``a_ids``, ``b_ids`` and the tokens of each group, ``a_in_group`` and
    ``b_in_group``."""
    docs = df.select(F.col(id_col).alias("doc_id"), text_key(whole_text(text_col)).alias("key"), whole_text(text_col).alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Tokenizers.load(a_file, b_file, pattern)
        for batch in batches:
            out = _Batch(of, batch.num_rows, tokens)
            for row, text in enumerate(batch.column(2)):
                if len(x := text.as_py()):
                    out.add(row, x)
            columns = [batch.column(0), batch.column(1), *out.columns()]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {id_type}, key struct<a:long,b:long>, {_SHAPE}{_TOKENS if tokens else ''}"
    names = [c.strip().split(" ")[0] for c in re.sub(r"<[^>]*>", "", schema).split(",")]
    return docs.mapInArrow(run, schema)


def vocabulary_size(b_file: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=b_file).get_piece_size()


def pair_counts(aligned: DataFrame, b_vocabulary: int) -> DataFrame:
    """``(pair, n, best)``: how many rows hold a pair of ids linked, and
    whether no other pair of its A id is held by more."""
    n = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    unsigned = F.when(F.col("pair") < 0, F.col("pair") + F.lit(1 << 32)).otherwise(F.col("pair").cast("long"))
    n = stored(n.withColumn("a_id", F.floor(unsigned / F.lit(b_vocabulary)).cast("int")))
    most = n.groupBy("a_id").agg(F.max("n").alias("most"))
    # One row per entry of A's vocabulary.
    return n.join(F.broadcast(most), "a_id").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _by_row(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the values of each row; row ``k`` ends at ``ends[k + 1]``."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return np.diff(total[ends])


def _look_up(table):
    """Sums over the broadcast pairs; the others are passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, best = table.value
        for batch in batches:
            pairs, times = batch.column(1), batch.column(2)
            flat, n = pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
            ends = pairs.offsets.to_numpy().astype(np.int64)
            ends = ends - ends[0]
            at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
            hit = known[at] == flat if len(known) else np.zeros(len(flat), bool)
            n_known = np.where(hit, n, 0)
            total, top = (_by_row(values[at] * n_known if len(known) else n_known, ends) for values in (count, best))
            kept = _lengths(_by_row(~hit, ends))
            left = [pa.ListArray.from_arrays(kept, pa.array(x[~hit].astype(np.int32))) for x in (flat, n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[3:], pa.array(top), pa.array(total), *left], names)

    names = ["doc_id", "key", *NUMBERS, "groups_sha256", "n_best", "count_sum", "pairs", "times"]
    return run


def link_counts(aligned: DataFrame, b_vocabulary: int, frequent: int = FREQUENT) -> DataFrame:
    """``aligned`` (a stored table) with ``n_best`` and ``count_sum`` of every
    row in place of its pairs."""
    spark = aligned.sparkSession
    # Counts in steps of a sixteenth of an octave: the level from which on no
    # more than ``frequent`` pairs are left, so no more reach the driver.
    level = F.floor(F.log2("n") * 16).cast("int")
    counts = stored(pair_counts(aligned, b_vocabulary).withColumn("level", level))
    floor, held = None, 0
    for r in counts.groupBy("level").agg(F.count(F.lit(1)).alias("pairs")).orderBy(F.desc("level")).collect():
        if (held := held + r["pairs"]) > frequent:
            break
        floor = r["level"]
    often = F.lit(False) if floor is None else F.col("level") >= floor
    top = counts.where(often).select("pair", "n", "best").toPandas().sort_values("pair")
    table = spark.sparkContext.broadcast((top["pair"].to_numpy(np.int32), top["n"].to_numpy(np.int64), top["best"].to_numpy(np.int64)))
    narrow = aligned.select("doc_id", "pairs", "times", "key", *NUMBERS, "groups_sha256")
    id_type = narrow.schema["doc_id"].dataType.simpleString()
    shape = _SHAPE.replace("pairs array<int>, times", "n_best long, count_sum long, pairs array<int>, times")
    looked = stored(narrow.mapInArrow(_look_up(table), f"doc_id {id_type}, key struct<a:long,b:long>, {shape}"))
    # The rare pairs of a text: once, however many rows hold the text.
    rare = looked.where(F.size("pairs") > 0).select("key", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("key", "p.pairs", "p.times").distinct()
    rare = rare.withColumnRenamed("pairs", "pair").join(counts.where(~often), "pair")
    more = rare.groupBy("key").agg(F.sum(F.col("n") * F.col("times")).alias("more_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"))
    # Texts of many copies have no rare pairs, so their rows stay out of the join.
    whole = looked.where(F.size("pairs") == 0).select("doc_id", *NUMBERS, "n_best", "count_sum", "groups_sha256")
    both = looked.where(F.size("pairs") > 0).drop("pairs", "times").join(more, "key")
    both = both.select(
        "doc_id",
        *NUMBERS,
        (F.col("n_best") + F.col("more_best")).alias("n_best"),
        (F.col("count_sum") + F.col("more_sum")).alias("count_sum"),
        "groups_sha256",
    )
    return whole.unionByName(both)
