"""Operator 11: vector codes by product quantisation with LAESA pivots.

1. Vectors become integers; each is cut into ``PARTS`` consecutive parts, and
   each part position has a codebook of ``ENTRIES`` entries.
2. A few pivots per part position are fixed (entries of the first codebook,
   far from each other).  The distance of every part to its pivots is computed
   once and written beside the vector.
3. In each round tasks get the codebooks and the distances of their entries to
   the pivots.  The largest difference of two pivot distances bounds a part's
   distance to an entry from below.  Entries are tried in the order of the
   bounds, and a part is done when its next bound exceeds its best distance;
   distances that decide are exact integers.
4. Tasks return sums and counts per part position and entry, which Spark adds
   up; only the codebooks pass through the driver.

Integers make all sums exact, so the codes are the same whatever the
partitioning and however often a task is run again.

Defined results: vectors that are null or hold null or non-finite components
are dropped, and so are those of another length than most (of the longer where
equal); a length that doesn't divide is cut at ``k * length // PARTS``; null ids come
last, rows of equal ids in the order of their components; with fewer rows than
entries a codebook is shorter; repeated rows count each; integers are held
within a bound so that squared distances fit 64 bits (2^28 for parts of 8), and
sums of errors at 2^63 - 1; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbforge.llm.common import stored
from kbforge.session import broadcast_if_small

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
PIVOTS = 4
#: Labels whose sums are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
_MOST = (1 << 63) - 1


def part_ends(length: int, parts: int) -> list[int]:
    return [k * length // parts for k in range(parts + 1)]


def bound(width: int) -> int:
    """The largest magnitude whose squared differences over ``width``
    components fit 64 bits."""
    return int(np.sqrt((1 << 62) / max(width, 8))) >> 1


def cut(flat: np.ndarray, parts: int) -> np.ndarray:
    """Vectors as (row, part, position); short parts are filled with zeros."""
    ends = part_ends(flat.shape[1], parts)
    width = max(np.diff(ends), default=0)
    out = np.zeros((len(flat), parts, width), np.int64)
    for k in range(parts):
        out[:, k, : ends[k + 1] - ends[k]] = flat[:, ends[k] : ends[k + 1]]
    return out


def far_apart(entries: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` of a codebook's entries, each the farthest from those before."""
    chosen = [0]
    gap = _squares(entries, entries[0])
    while len(chosen) < min(n, len(entries)) and gap.max(initial=0) > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, _squares(entries, entries[chosen[-1]]))
    return entries[chosen + [chosen[0]] * (n - len(chosen))]


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return np.einsum("...i,...i->...", d, d)


def pivot_distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances (row, part, pivot) of parts to the pivots (part, pivot, position)."""
    return np.sqrt(_squares(x[:, :, None, :], pivots[None]).astype(np.float64))


def nearest(x: np.ndarray, to_pivots: np.ndarray, books: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest entry of each part (lowest index of equals), its squared
    distance, and how many distances were evaluated.

    ``books`` is (part, entry, position).
    """
    rows, parts, width = x.shape
    entries = books.shape[1]
    between = np.sqrt(_squares(books[:, :, None, :], pivots[:, None]).astype(np.float64))  # part, entry, pivot
    lower = np.zeros((rows, parts, entries))
    for p in range(pivots.shape[1]):
        np.maximum(lower, np.abs(to_pivots[:, :, None, p] - between[None, :, :, p]), out=lower)
    # Rounding of roots and differences never makes a bound too high.
    lower -= 1e-6 + 1e-12 * (to_pivots.max(axis=2, initial=0)[:, :, None] + between.max(axis=2, initial=0)[None])
    lower = lower.reshape(rows * parts, entries)
    order = np.argsort(lower, axis=1, kind="stable")
    lower = np.take_along_axis(lower, order, axis=1)
    flat, part = x.reshape(rows * parts, width), np.tile(np.arange(parts), rows)
    best, which = np.full(rows * parts, _MOST), np.zeros(rows * parts, np.int64)
    left, reach, evaluated = np.arange(rows * parts), np.full(rows * parts, np.inf), 0
    for k in range(entries):
        left = left[lower[left, k] <= reach[left]]
        if not len(left):
            break
        e = order[left, k]
        d = _squares(flat[left], books[part[left], e])
        evaluated += len(left)
        better = (d < best[left]) | ((d == best[left]) & (e < which[left]))
        at = left[better]
        best[at], which[at], reach[at] = d[better], e[better], np.sqrt(d[better].astype(np.float64))
    return which.reshape(rows, parts), best.reshape(rows, parts), evaluated


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Components of a list column, where each row ends, and which rows count."""
    valid = ~column.is_null().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.array([0 if n is None else n for n in column.value_lengths().to_pylist()], np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    return values, ends, valid & (np.diff(bad[ends]) == 0)


def _integers(scale: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, ends, ok = _vectors(batch.column(2))
            rows = []
            for r in np.flatnonzero(ok).tolist():
                v = values[ends[r] : ends[r + 1]]
                most = bound(-(-len(v) // parts))
                rows.append(np.clip(np.floor(v * scale), -most, most).astype(np.int32))
            at = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(rows, pa.list_(pa.int32()))], ["vec_id", "label", "x"])

    return run


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), length)


def _measure(length: int, parts: int, pivots):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = pivot_distances(cut(_matrix(batch.column(2), length), parts), pivots.value)
            flat = pa.array(list(d.reshape(len(d), parts * pivots.value.shape[1])), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, flat], ["vec_id", "label", "x", "to_pivots"])

    return run


def _assigned(batches, length: int, parts: int, shared) -> Iterator[tuple]:
    books, pivots = shared.value
    for batch in batches:
        x = cut(_matrix(batch.column(batch.num_columns - 2), length), parts)
        far = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(len(x), parts, pivots.shape[1])
        yield (batch, x, *nearest(x, far, books, pivots)[:2])


def _sums(length: int, parts: int, shared):
    """Sums and counts of one task by part, entry and position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value[0]
        total, n = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        part = np.arange(parts)
        for _, x, which, _ in _assigned(batches, length, parts, shared):
            np.add.at(total, (part[None], which), x)
            np.add.at(n, (part[None], which), 1)
        k, e, at = np.indices(total.shape)
        used = n[k, e] > 0
        columns = [k[used], e[used], at[used], n[k, e][used], total[used]]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["part", "entry", "at", "n", "total"])

    return run


def _codes(length: int, parts: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, which, d in _assigned(batches, length, parts, shared):
            code = ["".join("%02x" % e for e in row) for row in which.tolist()]
            # A sum of parts may pass 64 bits where one part does not.
            error = [min(sum(row), _MOST) for row in d.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return run


def codebook_digest(books: np.ndarray, length: int) -> str:
    """SHA-256 of all entries' components by part, entry and position."""
    ends = part_ends(length, len(books))
    numbers = [v for k, book in enumerate(books.tolist()) for entry in book for v in entry[: ends[k + 1] - ends[k]]]
    return hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()


def compress(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    pivots: int = PIVOTS,
) -> tuple[DataFrame, np.ndarray, int]:
    """``(vec_id, label, code, error)`` of every kept vector, the final
    codebooks (part, entry, position) and the vectors' length."""
    spark = df.sparkSession
    source = df.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    ids, labels = (source.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    shape = f"vec_id {ids}, label {labels}, x array<int>"
    kept = stored(source.mapInArrow(_integers(scale, parts), shape))
    usual = kept.groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    length = usual["length"] if usual else 0
    kept = kept.where(F.size("x") == length)
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).collect()
    start = np.array([r["x"] for r in first], np.int64).reshape(len(first), length)
    books = np.ascontiguousarray(cut(start, parts).transpose(1, 0, 2))
    if not first:
        return kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), books, length
    fixed = np.stack([far_apart(book, pivots) for book in books])
    vectors = stored(kept.mapInArrow(_measure(length, parts, spark.sparkContext.broadcast(fixed)), f"{shape}, to_pivots array<double>"))
    narrow = vectors.select("x", "to_pivots")
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((books, fixed))
        sums = narrow.mapInArrow(_sums(length, parts, shared), "part long, entry long, at long, n long, total long")
        # Sums of all rows may pass 64 bits; one row a part, entry and position.
        sums = sums.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        books = books.copy()
        for r in sums.collect():
            books[r["part"], r["entry"], r["at"]] = int(r["total"]) // r["n"]
        shared.unpersist()
    shared = spark.sparkContext.broadcast((books, fixed))
    return vectors.mapInArrow(_codes(length, parts, shared), f"vec_id {ids}, label {labels}, code string, error long"), books, length


def decode(codes: DataFrame, books: np.ndarray, length: int, scale: int = SCALE, code_col: str = "code") -> DataFrame:
    """``codes`` with the vector that each code stands for, ``decoded``: the
    middle of its entries' integer cells."""
    ends = part_ends(length, len(books))
    shared = codes.sparkSession.sparkContext.broadcast(books)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def vector(code):
        def one(c: str) -> list[float]:
            which = [int(c[2 * k : 2 * k + 2], 16) for k in range(len(shared.value))]
            return np.concatenate([(shared.value[k, e, : ends[k + 1] - ends[k]] + 0.5) / scale for k, e in enumerate(which)]).tolist()

        return code.map(one, na_action="ignore")

    return codes.withColumn("decoded", vector(code_col))


def report(codes: DataFrame, books: np.ndarray, length: int) -> DataFrame:
    """Codes with the error summed over each label (nulls together) and the
    digest of the codebooks."""
    codes = stored(codes)
    sums = codes.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_MOST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    sums = broadcast_if_small(sums.withColumnRenamed("label", "of"), BROADCAST_ROWS)
    out = codes.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(codebook_digest(books, length)).alias("codebooks_sha256"))
