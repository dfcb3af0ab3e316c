"""Operator 3: byte-level BPE encoding and decoding with a local rank file.

``encode`` adds the token ids of each text, ``decode`` adds the bytes that a
list of ids stands for.  Both use the tiktoken library inside Arrow batches;
each worker reads the rank file (a parameter, installed on every machine)
once.

Long texts are cut at boundaries that the split pattern can never match
across, so a piece of bounded length is merged at a time and the ids are
those of the whole text.

Defined results: a null or empty text has no ids (an empty list) and decodes
to no bytes; repeated rows are encoded each for itself; other columns pass
through, but a column named like the output is replaced; an empty table gives
an empty table.  Special-token strings in a text are ordinary text.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters handed to the library at a time.
PIECE_CHARS = 32_768
#: A run of white space longer than this is merged without the pattern.
SPACE_RUN_CHARS = 4_096

# A match never holds a non-space character followed by white space, and the
# pattern looks ahead only inside a run of white space, so the place between
# the two always ends a match.
_SAFE = re.compile(r"(?<=\S)(?=[ \n\r\t])")
# Without white space: an ASCII letter next to an ASCII digit, or either before
# an ASCII sign, as no match holds both and nothing looks behind.
_CLASS_CHANGE = re.compile(r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z0-9])(?=[!-&(-/:-@\[-`{-~])")
# White space as the library's pattern has it: without the four separators
# that Python counts too.
_LONG_SPACES = re.compile(r"[^\S\x1c-\x1f]{%d,}" % SPACE_RUN_CHARS)

_encodings: dict[tuple[str, str], object] = {}


def encoding(rank_file: str, pattern: str):
    """The tiktoken encoding of a rank file, loaded once in a worker."""
    import tiktoken

    key = (rank_file, pattern)
    if key not in _encodings:
        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}
        _encodings[key] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[key]


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Consecutive parts of ``text`` whose separate encodings join to that of
    the whole.  A part is about ``size`` long; it is longer only where no safe
    boundary follows."""
    start = 0
    while len(text) - start > size:
        at = _SAFE.search(text, start + size)
        near = _CLASS_CHANGE.search(text, start + size, at.start() if at else len(text))
        cut = near.start() if near else at.start() if at else len(text)
        if cut <= start or cut >= len(text):
            break
        yield text[start:cut]
        start = cut
    if start < len(text):
        yield text[start:]


def encode_text(enc, text: str) -> np.ndarray:
    """The ids of a whole text."""
    if len(text) <= PIECE_CHARS:
        parts = [text]
    else:
        parts = []
        # The pattern takes all but the last of a run of spaces (or the whole
        # run at the end of the text) as one match.
        start = 0
        for m in _LONG_SPACES.finditer(text):
            parts += pieces(text[start : m.start()])
            end = m.end() if m.end() == len(text) else m.end() - 1
            parts.append(text[m.start() : end].encode())
            start = end
        parts += pieces(text[start:])
    out = [
        np.asarray(enc._encode_single_piece(p), dtype=np.int32)
        if isinstance(p, bytes)
        else enc.encode_to_numpy(p, allowed_special=set(), disallowed_special=()).astype(np.int32)
        for p in parts
    ]
    return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.int32)


def _with_column(df: DataFrame, name: str, kind: T.DataType) -> tuple[DataFrame, T.StructType]:
    kept = df.drop(name) if name in df.columns else df
    return kept, T.StructType([*kept.schema.fields, T.StructField(name, kind)])


def encode(df: DataFrame, rank_file: str, pattern: str, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """``df`` with the list of token ids of each whole text."""
    at = [c for c in df.columns if c != ids_col].index(text_col)
    df, schema = _with_column(df, ids_col, T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in batches:
            ids = [encode_text(enc, x.as_py() or "") for x in batch.column(at)]
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=offsets[1:])
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, ids_col])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, rank_file: str, pattern: str, ids_col: str = "token_ids", bytes_col: str = "decoded") -> DataFrame:
    """``df`` with the bytes of each list of ids; bytes, as a list cut inside a
    character is not valid text.  A null list gives no bytes."""
    at = [c for c in df.columns if c != bytes_col].index(ids_col)
    df, schema = _with_column(df, bytes_col, T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in batches:
            lists = batch.column(at)
            out = [b"" if x.values is None else enc.decode_bytes(x.values.to_pylist()) for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, bytes_col])

    return df.mapInArrow(run, schema)


def digests(df: DataFrame, ids_col: str = "token_ids", bytes_col: str = "decoded", id_col: str = "doc_id") -> DataFrame:
    """Counts and SHA-256 digests of the ids and of the decoded bytes."""
    return df.select(
        F.col(id_col).alias("doc_id"),
        F.size(ids_col).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids_col).cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col(bytes_col), 256).alias("decoded_sha256"),
    )
