"""G1: split documents into overlapping windows of whitespace tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbforge.functions.text import WS_TOKEN_SPLIT, strip_ws

# Config defaults of the index build: 1200-token windows, 100 tokens overlap.
CHUNK_SIZE = 1200
CHUNK_OVERLAP = 100


def chunk_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
) -> DataFrame:
    """Text units ``(unit_id, doc_id, chunk_no, start_tok, n_tokens, text)``.

    Windows start at 0, step, 2*step, ... (step = size - overlap) for as long
    as the window adds tokens not already covered: a document of n tokens
    gives ``1`` unit when ``n <= size`` and ``ceil((n - overlap) / step)``
    otherwise.  Documents without a token give none.

    Narrow: one ``inline`` per document, no shuffle, so units stay in the
    partition of their document and every document is chunked whole.  A text is
    split once, and its windows are cut inside its row: no copy of all its
    tokens goes with each window.
    """
    if not 0 <= overlap < size:
        raise ValueError("need 0 <= overlap < size")
    step = size - overlap
    stripped = strip_ws(text_col)
    # a text that is not blank has a token: the filter need not split it
    some = docs.where(stripped != "").select(F.col(id_col).alias("doc_id"), F.split(stripped, WS_TOKEN_SPLIT).alias("_toks"))
    n = F.size("_toks")
    n_chunks = F.when(n <= size, F.lit(1)).otherwise(F.ceil((n - F.lit(overlap)) / F.lit(step)).cast("int"))

    def window(i):
        start = i * F.lit(step)
        return F.struct(
            i.alias("chunk_no"),
            start.alias("start_tok"),
            F.least(n - start, F.lit(size)).alias("n_tokens"),
            F.array_join(F.slice("_toks", start + 1, F.lit(size)), " ").alias("text"),
        )

    windows = some.select("doc_id", F.inline(F.transform(F.sequence(F.lit(0), n_chunks - 1), window)))
    return windows.select(
        F.concat(F.col("doc_id").cast("string"), F.lit("-"), F.col("chunk_no").cast("string")).alias("unit_id"),
        "doc_id",
        "chunk_no",
        "start_tok",
        "n_tokens",
        "text",
    )
