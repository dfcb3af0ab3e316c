"""Questions and answers of a log that arrives in any order.

A conversation's turns are keyed state.  Turns whose numbers follow each other
leave nothing open between them, so the state holds one interval per unbroken
run of numbers: its first turn (it may answer one that comes before) and its
last (it may wait for an answer).  A user turn goes out as soon as the next
number has arrived.  When no turn of a conversation has come for the timeout,
the user turns that still wait go out with the next logged turn, which may be
several numbers later, or unanswered, and the state is dropped.

The rows are those of ``pair_turns`` whatever the order of arrival within the
timeout; a turn that comes after it begins a new state, and a number that has
been seen already is ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# An interval: first and last number, role and text of the first and of the last turn.
LO, HI, LO_ROLE, LO_TEXT, HI_ROLE, HI_TEXT = range(6)


def _pair(turn: int, query: str | None, role: str | None, text: str | None) -> tuple:
    answer = text if role == "assistant" else None
    return turn, query, answer, answer is not None


def insert(runs: list[list], turn: int, role: str, text: str | None) -> list[tuple]:
    """Add a turn to the sorted intervals; the pairs that it settles."""
    at = next((i for i, r in enumerate(runs) if r[HI] >= turn), len(runs))
    if at < len(runs) and runs[at][LO] <= turn:
        return []
    out, new = [], [turn, turn, role, text, role, text]
    if at < len(runs) and runs[at][LO] == turn + 1:
        right = runs.pop(at)
        if role == "user":
            out.append(_pair(turn, text, right[LO_ROLE], right[LO_TEXT]))
        new = [turn, right[HI], role, text, right[HI_ROLE], right[HI_TEXT]]
    if at and runs[at - 1][HI] == turn - 1:
        left = runs[at - 1]
        if left[HI_ROLE] == "user":
            out.append(_pair(left[HI], left[HI_TEXT], role, text))
        runs[at - 1] = [left[LO], new[HI], left[LO_ROLE], left[LO_TEXT], new[HI_ROLE], new[HI_TEXT]]
    else:
        runs.insert(at, new)
    return out


def close(runs: list[list]) -> list[tuple]:
    """The pairs of the user turns that still wait."""
    after = [*runs[1:], None]
    return [
        _pair(r[HI], r[HI_TEXT], n[LO_ROLE] if n else None, n[LO_TEXT] if n else None)
        for r, n in zip(runs, after, strict=True)
        if r[HI_ROLE] == "user"
    ]


def pair_turns_stream(turns: DataFrame, timeout: str = "30 minutes", time_col: str = "logged_at") -> DataFrame:
    """``conv_id, turn, query, answer, answered`` of a stream of turns
    ``(conv_id, turn, role, text, logged_at)``; ``timeout`` is in event time,
    and is the watermark's delay too."""
    wait = int(pd.Timedelta(timeout).total_seconds() * 1000)
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        runs = json.loads(state.get[0]) if state.exists else []
        if state.hasTimedOut:
            out = close(runs)
            state.remove()
        else:
            out, last = [], 0
            for pdf in batches:
                rows = pdf[["turn", "role", "text"]].itertuples(index=False)
                for turn, role, text in rows:
                    out += insert(runs, int(turn), role, text)
                last = max(last, int(pdf["at"].max()))
            state.update((json.dumps(runs),))
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + wait)
        yield pd.DataFrame([(key[0], *r) for r in out], columns=["conv_id", "turn", "query", "answer", "answered"])

    seen = turns.withWatermark(time_col, timeout).select("conv_id", "turn", "role", "text", time_col, F.unix_millis(time_col).alias("at"))
    return seen.groupBy("conv_id").applyInPandasWithState(
        run, f"conv_id {kind}, turn long, query string, answer string, answered boolean", "runs string", "append", GroupStateTimeout.EventTimeTimeout
    )
