"""Operator 6: removal of long repeated byte strings by bucket-pointer refinement.

Every byte covered by a string of ``LENGTH`` bytes that also starts somewhere
else in the corpus is removed.  Positions are sorted into buckets by the q-gram
they start with, and buckets are refined by the identifiers of later offsets
until they stand for whole windows:

1. Of each window only its anchor, the first least q-gram, is a position that
   counts; windows that share an anchor form a run.  Runs are bucketed by the
   anchor's q-gram; a bucket of one run holds no repeat and is dropped, which
   is most of a corpus.
2. A run's buckets refined to all its bytes (q, 2 q, ... reused recursively)
   tell runs that repeat as a whole.
3. What is left are runs that share the anchor but differ somewhere, at the
   edges of repeated passages.  Their bytes meet by bucket and are refined to
   single windows.  Buckets of very many different runs are not gathered: their
   windows are grouped by identifier instead, with the same result.

Equal runs are counted in each task before they are shuffled.

Defined results: a null text has no bytes; a text shorter than a window loses
nothing; repeated rows are repeats of each other; extra columns are ignored; an
empty table gives an empty table.  Removed bytes can split characters, so the
kept bytes are binary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbforge.llm.common import stored, whole_text
from kbforge.llm.shingles import text_bytes
from kbforge.llm.windows import PLACE_BITS, anchors, gram_ids, merged, refined

#: Window bytes, and bytes of an initial bucket (LENGTH = GRAM * 2 ** k).
LENGTH, GRAM = 200, 25
#: A bucket of more different runs than this is refined window by window.
BUCKET_RUNS = 4_000
#: Window starts handled at a time in a long text.
SEGMENT = 1 << (PLACE_BITS - 1)

NEED = "struct<lo:int,width:int,bucket:long,runs:long,witness:boolean>"


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _runs(raw: np.ndarray, length: int, gram: int) -> Iterator[tuple]:
    for start in range(0, max(len(raw) - length + 1, 1), SEGMENT):
        bucket, span, lo, width = anchors(raw[start : start + SEGMENT + length - 1], gram, length)
        if len(lo):
            yield bucket, span, lo + start, width


def _runs_of(batch: pa.RecordBatch, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """All runs of a batch ``(key, n, text)``: row, bucket, span, lo, width."""
    raw, ends = text_bytes(batch.column(2))
    found = [(np.full(len(r[0]), i), *r) for i in range(len(ends) - 1) for r in _runs(raw[ends[i] : ends[i + 1]], length, gram)]
    if not found:
        z = np.zeros(0, np.int64)
        return z, z.view(np.uint64), z.view(np.uint64), z, z
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _counted(length: int, gram: int):
    """Runs of a batch, equal ones counted: ``(bucket, span, c, rep)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, bucket, span, _, _ = _runs_of(batch, length, gram)
            key = batch.column(0).to_numpy(zero_copy_only=False)[row]
            order = np.lexsort((key, span, bucket))
            bucket, span, key = bucket[order], span[order], key[order]
            new = np.ones(len(order), bool)
            new[1:] = (bucket[1:] != bucket[:-1]) | (span[1:] != span[:-1])
            first = np.flatnonzero(new)
            c = np.diff(np.append(first, len(order)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(_signed(bucket[first])), pa.array(_signed(span[first])), pa.array(c, pa.int64()), pa.array(key[first], pa.int64())],
                ["bucket", "span", "c", "rep"],
            )

    return run


def _placed(length: int, gram: int):
    """Every run with its text: ``(key, n, bucket, span, lo, width)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, bucket, span, lo, width = _runs_of(batch, length, gram)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(_signed(bucket)), pa.array(_signed(span)), pa.array(lo, pa.int32()), pa.array(width, pa.int32())],
                ["key", "n", "bucket", "span", "lo", "width"],
            )

    return run


def _window_ids(raw: np.ndarray, starts: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each window of ``raw`` that starts at ``starts``."""
    ids = gram_ids(raw, gram)
    return refined(ids, starts, gram, length), refined(ids, starts, gram, length, 0x51ED270B)


def _slices(length: int, most: int):
    """The bytes of the runs asked for, in buckets of up to ``most`` runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()  # copies of a text lie together; one answers
        for batch in batches:
            out = []
            for key, n, text, asked in zip(*(batch.column(k) for k in ("key", "n", "text", "asked")), strict=True):
                if asked.is_valid and len(asked) and key.as_py() not in done:
                    done.add(key.as_py())
                    raw = text.as_py().encode()
                    for a in asked.as_py():
                        if a["runs"] <= most:
                            lo, width = a["lo"], a["width"]
                            out.append((a["bucket"], key.as_py(), n.as_py(), lo, a["witness"], raw[lo : lo + width + length - 1]))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["bucket", "key", "n", "lo", "witness", "bytes"])

    return run


def _many_windows(length: int, gram: int, most: int):
    """Windows of the runs asked for in larger buckets: ``(w1, w2, key, n, at, witness)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            for key, n, text, asked in zip(*(batch.column(k) for k in ("key", "n", "text", "asked")), strict=True):
                large = [a for a in asked.as_py() or () if a["runs"] > most]
                if not large or key.as_py() in done:
                    continue
                done.add(key.as_py())
                raw = np.frombuffer(text.as_py().encode(), np.uint8)
                starts = np.concatenate([np.arange(a["lo"], a["lo"] + a["width"]) for a in large])
                witness = np.repeat([a["witness"] for a in large], [a["width"] for a in large])
                w1, w2 = _window_ids(raw, starts, length, gram)
                k = len(starts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_signed(w1)), pa.array(_signed(w2)), pa.array([key.as_py()] * k, pa.int64()), pa.array([n.as_py()] * k, pa.int64()), pa.array(starts, pa.int64()), pa.array(witness)],
                    ["w1", "w2", "key", "n", "at", "witness"],
                )

    return run


def _resolve(length: int, gram: int):
    """Rows sorted by bucket to the windows that repeat in their bucket, as
    ``(key, n, start, end)``.  Whole buckets are compared, many at a time."""

    def compare(rows: pa.Table) -> pa.RecordBatch:
        raw, ends = text_bytes(rows.column("bytes").combine_chunks())
        width = np.diff(ends) - length + 1
        which = np.repeat(np.arange(len(width)), width)
        within = np.arange(len(which)) - np.repeat(np.cumsum(width) - width, width)
        w1, w2 = _window_ids(raw, ends[:-1][which] + within, length, gram)
        bucket = rows.column("bucket").to_numpy()[which]
        order = np.lexsort((w2, w1, bucket))
        same = (np.diff(w1[order]) == 0) & (np.diff(w2[order]) == 0) & (np.diff(bucket[order]) == 0)
        again = np.zeros(len(order), bool)
        again[order[1:]] |= same
        again[order[:-1]] |= same
        again &= ~rows.column("witness").to_numpy()[which]
        # Neighbouring windows of a run become one interval.
        hit = np.flatnonzero(again)
        joined = np.zeros(len(hit), bool)
        joined[1:] = (np.diff(hit) == 1) & (which[hit[1:]] == which[hit[:-1]])
        first = np.flatnonzero(~joined)
        last = np.append(first[1:], len(hit)) - 1 if len(first) else first
        row = which[hit[first]]
        lo = rows.column("lo").to_numpy()[row]
        at = pa.array(row)
        return pa.RecordBatch.from_arrays(
            [
                rows.column("key").combine_chunks().take(at),
                rows.column("n").combine_chunks().take(at),
                pa.array(lo + within[hit[first]], pa.int64()),
                pa.array(lo + within[hit[last]] + length, pa.int64()),
            ],
            ["key", "n", "start", "end"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            bucket = batch.column("bucket").to_numpy()
            # All buckets but the last are complete.
            table = pa.Table.from_batches(held)
            cut = int(np.searchsorted(table.column("bucket").to_numpy(), bucket[-1]))
            if cut:
                yield compare(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield compare(pa.Table.from_batches(held))

    return run


def _cut():
    """``(id, n_bytes, removed, kept)``."""
    removed_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, removed, kept = [], [], []
            for text, whole, parts in zip(*(batch.column(k) for k in ("text", "whole", "parts")), strict=True):
                raw = text.as_py().encode()
                spans = [(x["start"], x["end"]) for col in (whole, parts) for x in col.as_py() or ()]
                cut = merged(np.array(spans, np.int64).reshape(-1, 2)).tolist()
                n_bytes.append(len(raw))
                removed.append([{"start": a, "end": b} for a, b in cut])
                starts, stops = [0, *(b for _, b in cut)], [*(a for a, _ in cut), len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(starts, stops, strict=True)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(removed, removed_type), pa.array(kept, pa.binary())],
                [batch.schema.names[0], "n_bytes", "removed", "kept"],
            )

    return run


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, bucket_runs: int = BUCKET_RUNS) -> DataFrame:
    """``(doc_id, n_bytes, removed, kept)`` of every row: the maximal removed
    byte intervals, and the remaining bytes."""
    text = whole_text(text_col)
    docs = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("key"), F.octet_length(text).cast("long").alias("n"), text.alias("text"))
    plain = docs.select("key", "n", "text")

    # 1. Buckets of more than one run; their different runs side by side.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = plain.mapInArrow(_counted(length, gram), "bucket long, span long, c long, rep long")
    runs = counted.repartition(parts, "bucket").groupBy("bucket", "span").agg(F.sum("c").alias("c"), F.min("rep").alias("rep"))
    runs = runs.withColumn("runs", F.count(F.lit(1)).over(Window.partitionBy("bucket")))
    shared = stored(runs.where((F.col("c") > 1) | (F.col("runs") > 1)))

    # 2. Which of them each text holds: whole repeats, and runs to be refined.
    # Of a run that repeats, one text is asked for the bytes, as a witness.
    placed = plain.mapInArrow(_placed(length, gram), "key long, n long, bucket long, span long, lo int, width int")
    held = placed.join(shared, ["bucket", "span"])
    whole = F.when(F.col("c") > 1, F.struct(F.col("lo").cast("long").alias("start"), (F.col("lo") + F.col("width") + (length - 1)).cast("long").alias("end")))
    ask = F.when(
        (F.col("runs") > 1) & ((F.col("c") == 1) | (F.col("rep") == F.col("key"))),
        F.struct("lo", "width", "bucket", "runs", (F.col("c") > 1).alias("witness")),
    )
    needs = held.groupBy("key", "n").agg(F.collect_set(whole).alias("whole"), F.collect_set(ask).alias("asked"))

    # 3. Texts meet their runs; both readers below read one shuffle of the texts.
    with_needs = docs.join(needs, ["key", "n"], "left").select("doc_id", "key", "n", "text", "whole", "asked")
    slices = with_needs.mapInArrow(_slices(length, bucket_runs), "bucket long, key long, n long, lo int, witness boolean, bytes binary")
    small = slices.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_resolve(length, gram), "key long, n long, start long, end long")
    windows = with_needs.mapInArrow(_many_windows(length, gram, bucket_runs), "w1 long, w2 long, key long, n long, at long, witness boolean")
    again = windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    large = windows.where("not witness").join(again, ["w1", "w2"]).select("key", "n", F.col("at").alias("start"), (F.col("at") + length).alias("end"))
    refined_parts = small.unionByName(large).groupBy("key", "n").agg(F.collect_list(F.struct("start", "end")).alias("parts"))
    final = with_needs.join(refined_parts, ["key", "n"], "left").select("doc_id", "text", "whole", "parts")
    kind = df.schema[id_col].dataType.simpleString()
    return final.mapInArrow(_cut(), f"doc_id {kind}, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")


def report(found: DataFrame) -> DataFrame:
    """Bytes, removed bytes, removed runs and the digest of what remains."""
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
