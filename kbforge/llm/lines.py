"""Operator 12: line de-duplication by range-partitioned hashes.

1. Every line of every text becomes one narrow row: a 128-bit hash of its key,
   the document, its position, and whether the key is new in the document.
2. The rows are range-partitioned by hash, document and position and sorted so
   (secondary sort).  The ranges are cut at single rows, so a line that a third
   of all documents hold is spread over many tasks.
3. Each task streams its rows.  The lines of one key are a run; as soon as a
   run has reached the wanted number of documents its rows go out, so a task
   holds no more than the lines of a few documents.  Runs at either end of a
   task may go on in the next one: their rows go out as open, with one summary
   a run, and the summaries (two a task) are added up and joined back.
4. Positions to drop are gathered per document into a compressed bitmap, one
   bit a line; no text moves until ``apply_bitmaps`` is asked for texts.

A key is the line without white space ``[\\x20\\x09-\\x0D]`` at both ends, A-Z
lower-cased.  With ``keep="none"`` a key that enough documents hold loses all
its lines; with ``keep="first"`` its first one in the order of ids (null last),
texts' keys and positions stays.

Defined results: a null or empty text is one empty line; a line without a key
stays; every row is a document, so repeated rows and rows without an id count
each, and equal rows are treated alike; other columns pass through; an empty
table gives an empty table.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbforge.llm.common import SPACES, quoted, stored, whole_row, whole_text

MIN_DOCS, MIN_CHARS = 10, 1
_STRIP = SPACES.encode()


def document_key(id_col: str, text_col: str) -> Column:
    """128 bits that stand for a row's id and text."""
    text = whole_text(text_col)
    return F.struct(F.xxhash64(id_col, text).alias("a"), F.xxhash64(F.lit("second"), id_col, text).alias("b"))


def line_key(line: bytes) -> bytes:
    return line.strip(_STRIP).lower()


def _lines(kind: str, min_chars: int):
    names = ["a", "b", "doc_id", "ka", "kb", "pos", "new"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, row, pos, new = [], [], [], []
            for r, text in enumerate(batch.column(3)):
                seen = set()
                for i, line in enumerate(text.as_py().encode().split(b"\n")):
                    key = line_key(line)
                    if not key or min_chars > 1 and len(key.decode()) < min_chars:
                        continue
                    h = hashlib.blake2b(key, digest_size=16).digest()
                    hashes.append(h)
                    row.append(r)
                    pos.append(i)
                    new.append(h not in seen)
                    seen.add(h)
            ab = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            at = pa.array(row, pa.int64())
            columns = [pa.array(ab[:, 0]), pa.array(ab[:, 1]), *(batch.column(k).take(at) for k in range(3))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(pos, pa.int32()), pa.array(new, pa.bool_())], names)

    return run, f"a long, b long, doc_id {kind}, ka long, kb long, pos int, new boolean"


_OUT = "ka long, kb long, pos int, open boolean, a long, b long, first boolean, task int, docs long"
_NAMES = ["ka", "kb", "pos", "open", "a", "b", "first", "task", "docs"]


class _Run:
    """The run that a task is in: its hash, documents so far, rows held back."""

    def __init__(self, hashed: tuple[int, int], open_start: bool):
        self.hashed, self.open_start, self.docs, self.rows, self.held = hashed, open_start, 0, 0, []


def _stream(min_docs: int, keep_first: bool):
    """Rows to drop of a sorted partition (``open`` false), rows of its first
    and last run on which other tasks have a say (``open`` true), and one
    summary (``pos`` null) of each such run."""

    def batch_of(rows: dict, is_open: bool, run: _Run | None, task: int, first: np.ndarray) -> pa.RecordBatch:
        n = len(rows["pos"])
        hashed = run.hashed if run and is_open else (None, None)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(rows["ka"]),
                pa.array(rows["kb"]),
                pa.array(rows["pos"], pa.int32()),
                pa.array(np.full(n, is_open)),
                pa.array([hashed[0]] * n, pa.int64()),
                pa.array([hashed[1]] * n, pa.int64()),
                pa.array(first),
                pa.array(np.full(n, task), pa.int32()),
                pa.nulls(n, pa.int64()),
            ],
            _NAMES,
        )

    def summary(run: _Run, task: int) -> pa.RecordBatch:
        row = [None, None, None, True, *run.hashed, False, task, run.docs]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], _NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        now: _Run | None = None

        def feed(part: dict, docs: int) -> Iterator[pa.RecordBatch]:
            """More rows of the run that the task is in."""
            n = len(part["pos"])
            first = np.zeros(n, bool)
            first[:1] = now.rows == 0
            now.docs += docs
            now.rows += n
            if now.open_start:
                yield batch_of(part, True, now, task, first)
            elif now.docs < min_docs:
                now.held.append((part, first))
            else:
                for held, f in [*now.held, (part, first)]:
                    kept = {c: x[~f] for c, x in held.items()} if keep_first else held
                    if len(kept["pos"]):
                        yield batch_of(kept, False, None, task, np.zeros(len(kept["pos"]), bool))
                now.held = []

        def close(last: bool) -> Iterator[pa.RecordBatch]:
            if now and (last or now.open_start):
                for part, first in now.held:
                    yield batch_of(part, True, now, task, first)
                yield summary(now, task)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "ka", "kb", "pos", "new")}
            turn = np.append(True, (x["a"][1:] != x["a"][:-1]) | (x["b"][1:] != x["b"][:-1]))
            starts = np.flatnonzero(turn)
            docs = np.add.reduceat(x["new"].astype(np.int64), starts)
            ends = np.append(starts[1:], n)
            cut = lambda lo, hi: {c: x[c][lo:hi] for c in ("ka", "kb", "pos")}
            # The first run may go on from the last batch, the last one into the next.
            for k in sorted({0, len(starts) - 1}):
                if k == len(starts) - 1 and k > 1:
                    inner = np.zeros(n, bool)
                    inner[starts[1] : starts[-1]] = np.repeat(docs[1:-1] >= min_docs, ends[1:-1] - starts[1:-1])
                    if keep_first:
                        inner[starts] = False
                    if inner.any():
                        rows = {c: x[c][inner] for c in ("ka", "kb", "pos")}
                        yield batch_of(rows, False, None, task, np.zeros(len(rows["pos"]), bool))
                hashed = (int(x["a"][starts[k]]), int(x["b"][starts[k]]))
                if now is None or now.hashed != hashed:
                    yield from close(False)
                    now = _Run(hashed, now is None)
                yield from feed(cut(starts[k], ends[k]), int(docs[k]))
        yield from close(True)

    return run


def dropped_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep: str = "none") -> DataFrame:
    """``(ka, kb, pos)`` of the lines to drop; ``ka, kb`` is the document's key."""
    if keep not in ("none", "first"):
        raise ValueError("keep is 'none' or 'first'")
    key = document_key(id_col, text_col)
    docs = df.select(F.col(id_col).alias("doc_id"), key["a"].alias("ka"), key["b"].alias("kb"), whole_text(text_col).alias("text"))
    run, schema = _lines(docs.schema["doc_id"].dataType.simpleString(), min_chars)
    # Cutting the ranges reads the rows once more, so they are written first.
    lines = stored(docs.mapInArrow(run, schema))
    order = ["a", "b", F.asc_nulls_last("doc_id"), "ka", "kb", "pos"]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    streamed = lines.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    found = stored(streamed.mapInArrow(_stream(min_docs, keep == "first"), _OUT))
    pieces = found.where("pos is null").groupBy("a", "b").agg(F.sum("docs").alias("total"), F.min("task").alias("start"))
    # Two summaries a task at most, so this table is small by construction.
    pieces = F.broadcast(pieces.where(F.col("total") >= min_docs))
    opened = found.where("open and pos is not null").drop("docs").join(pieces, ["a", "b"])
    if keep == "first":
        opened = opened.where(~(F.col("first") & (F.col("task") == F.col("start"))))
    return found.where("not open").select("ka", "kb", "pos").unionByName(opened.select("ka", "kb", "pos"))


def _pack(n_lines: int, dropped: list) -> bytes:
    keep = np.ones(n_lines, bool)
    keep[np.asarray(dropped, np.int64)] = False
    return zlib.compress(np.packbits(keep).tobytes(), 6)


def unpack(bitmap: bytes, n_lines: int) -> np.ndarray:
    """One boolean a line of a keep bitmap."""
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines).astype(bool)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ka, kb, n_lines, dropped = batch.columns
        keep = [_pack(n, d) for n, d in zip(n_lines.to_pylist(), dropped.to_pylist(), strict=True)]
        n_dropped = pa.array([len(d) for d in dropped.to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([ka, kb, n_lines, n_dropped, pa.array(keep, pa.binary())], ["ka", "kb", "n_lines", "n_dropped", "keep"])


def _n_lines(text_col: str) -> Column:
    text = whole_text(text_col)
    return (F.length(text) - F.length(F.translate(text, "\n", "")) + 1).cast("long")


def keep_bitmaps(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep: str = "none") -> DataFrame:
    """``(ka, kb, n_lines, n_dropped, keep)``, one row per document that loses a
    line: ``keep`` is its compressed bitmap, a bit of 1 for each line that stays."""
    dropped = dropped_lines(df, id_col, text_col, min_docs, min_chars, keep)
    key = document_key(id_col, text_col)
    # Sets, as equal rows send the same positions; they meet in the task first.
    lost = dropped.groupBy("ka", "kb").agg(F.collect_set("pos").alias("dropped"))
    counts = df.select(key["a"].alias("ka"), key["b"].alias("kb"), _n_lines(text_col).alias("n_lines"))
    counts = counts.groupBy("ka", "kb").agg(F.max("n_lines").alias("n_lines"))
    both = counts.join(lost, ["ka", "kb"]).select("ka", "kb", "n_lines", "dropped")
    return both.mapInArrow(_bitmaps, "ka long, kb long, n_lines long, n_dropped long, keep binary")


@F.pandas_udf(T.StringType())
def _kept(text: pd.Series, keep: pd.Series) -> pd.Series:
    out = []
    for t, bits in zip(text, keep, strict=True):
        if bits is not None:
            lines = t.split("\n")
            t = "\n".join(line for line, k in zip(lines, unpack(bits, len(lines)).tolist(), strict=True) if k)
        out.append(t)
    return pd.Series(out, dtype=object)


def _applied(df: DataFrame, bitmaps: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(row, n_lines, n_dropped, kept)``: the row and its text's kept lines."""
    key = document_key(id_col, text_col)
    rows = df.select(whole_row(df), key["a"].alias("ka"), key["b"].alias("kb"), whole_text(text_col).alias("text"), _n_lines(text_col).alias("lines"))
    both = rows.join(bitmaps.select("ka", "kb", "n_dropped", "keep"), ["ka", "kb"], "left")
    kept = F.when(F.col("keep").isNull(), F.col("text")).otherwise(_kept("text", "keep"))
    return both.select("row", F.col("lines").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"), kept.alias("kept"))


def apply_bitmaps(df: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with the kept lines of each text (joined by line feeds) in its place."""
    out = _applied(df, bitmaps, id_col, text_col)
    return out.select(*[F.col("kept").alias(c) if c == text_col else F.col("row." + quoted(c)).alias(c) for c in df.columns])


def report(df: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines, dropped lines and the digest of what stays, per document."""
    out = _applied(df, bitmaps, id_col, text_col)
    return out.select(F.col("row." + quoted(id_col)).alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
