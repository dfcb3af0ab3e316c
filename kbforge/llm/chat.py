"""Operator 7: chat formatting by transcript parsing.

A transcript is lines in order; who speaks is told by speaker markers, and
where these lack, by the shape of the lines.  A hidden Markov model has a state
for the first and for a later line of a turn of each role; a line shows its
marker, whether a message begins there, its length and whether it asks.  The
model is counted from labelled conversations; Viterbi then finds the likeliest
states, and every turn is rendered in one canonical form.

A transcript can be of any length: it is cut into blocks of messages.  A
block's lines give a matrix of the best score from each state before it to
each state at its end; one short pass over a transcript's matrices fixes the
states between blocks; blocks then find their own lines' states.  The result
is that of Viterbi over the whole transcript, and no task holds more than one
block's lines.

Defined results: a null or empty text is one empty line; a null conversation
is one conversation; messages with the same number stand in order of their
texts; roles other than the three of the model are not learned from; a turn
that goes on over the end of a block is returned in parts, the later ones
marked ``continues`` and without a header; without labelled conversations all
states are equally likely and markers decide nothing; an empty table gives an
empty table; extra columns are ignored.

No character of a text is lost but a marker that names the role found, by the
name that this transcript uses for it.  A transcript uses markers if at least
half as many of its lines have one as it has messages; its name for a role is
the most frequent one, the first of ``MARKERS`` on a tie.  Headers that stand
in a text get a backslash after their ``<``, so no text makes a turn;
``unescape`` takes it off again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLES = ("system", "user", "assistant")
#: Messages of a block.
BLOCK = 64
PSEUDO = 0.5

# Speaker names that transcripts use for the roles (our own lists).
MARKERS = {
    "system": "system sys instruction instructions context setup",
    "user": "user human q question prompter customer me you asker",
    "assistant": "assistant ai a answer bot model agent gpt reply",
}
_ROLE_OF = {name: k + 1 for k, role in enumerate(ROLES) for name in MARKERS[role].split()}
NAMES = list(_ROLE_OF)
_HEADER = re.compile(r"<(\\*\|(?:" + "|".join(ROLES) + r")\|>)")
_ESCAPED = re.compile(r"<\\(\\*\|(?:" + "|".join(ROLES) + r")\|>)")
_MARK = re.compile(r"[\s#*<>\[\]|(-]{0,6}([A-Za-z]{1,12})[\s*\]|)>]{0,4}[:>\]]\s*")
#: Observation values: marker (none, one per role, another), new message,
#: length in words (0, up to 8, up to 40, more), question.
SHAPE = (5, 2, 4, 2)


def marker(line: str) -> tuple[int, int]:
    """Marker class of a line, and where the text after it starts."""
    m = _MARK.match(line)
    if not m:
        return 0, 0
    role = _ROLE_OF.get(m.group(1).lower())
    return (role, m.end()) if role else (4, 0)


def marker_name(line: str) -> str | None:
    """The speaker name that a line's marker gives to a role, in lower case."""
    m = _MARK.match(line)
    name = m.group(1).lower() if m else None
    return name if name in _ROLE_OF else None


def count_names(lines: list[tuple[int, int, str]]) -> np.ndarray:
    """How many lines have each of ``NAMES`` as marker, and last how many
    messages there are."""
    out = np.zeros(len(NAMES) + 1, np.int64)
    for _, k, line in lines:
        name = marker_name(line)
        out[-1] += k == 0
        if name:
            out[NAMES.index(name)] += 1
    return out


def style_names(counts: np.ndarray) -> list[str]:
    """The marker names that a transcript with these counts uses, at most one a role."""
    n = counts[:-1]
    if 2 * n.sum() < counts[-1]:
        return []
    out = []
    for role in range(1, len(ROLES) + 1):
        own = [j for j, name in enumerate(NAMES) if _ROLE_OF[name] == role]
        best = max(own, key=lambda j: (n[j], -j))
        if n[best]:
            out.append(NAMES[best])
    return out


def observe(line: str, fresh: bool) -> int:
    """The observation of a line as one number."""
    mark, at = marker(line)
    n = len(line[at:].split())
    size = 0 if n == 0 else 1 if n <= 8 else 2 if n <= 40 else 3
    asks = line.rstrip()[-1:] in ("?", "？")
    return int(np.ravel_multi_index((mark, int(fresh), size, int(asks)), SHAPE))


class Model:
    """Log-probabilities of a counted model; states are 2 * role + (0 first, 1 later)."""

    def __init__(self, observed: np.ndarray, moved: np.ndarray, begun: np.ndarray):
        # Features are taken as independent given the state.
        n = observed.reshape(len(ROLES) * 2, *SHAPE)
        total = np.zeros_like(n, float)
        for k in range(len(SHAPE)):
            one = n.sum(axis=tuple(1 + j for j in range(len(SHAPE)) if j != k)) + PSEUDO
            one = np.log(one / one.sum(axis=1, keepdims=True))
            total += one.reshape(len(n), *[s if j == k else 1 for j, s in enumerate(SHAPE)])
        self.emit = total.reshape(len(n), -1)
        states = np.arange(len(n))
        # A later line follows only a line of its own role.
        allowed = (states[None] % 2 == 0) | (states[:, None] // 2 == states[None] // 2)
        p = np.where(allowed, moved + PSEUDO, 0)
        with np.errstate(divide="ignore"):
            self.move = np.log(p / p.sum(axis=1, keepdims=True))
            p = np.where(states % 2 == 0, begun + PSEUDO, 0)
            self.begin = np.log(p / p.sum())


def _lines(texts: list) -> Iterator[tuple[int, int, str]]:
    for i, text in enumerate(texts):
        for k, line in enumerate((text or "").split("\n")):
            yield i, k, line


def block_matrix(model: Model, seen: list[int]) -> np.ndarray:
    """Best log-probability of a block's lines after its first, from each state
    of the first line to each state of the last."""
    out = np.full((len(model.emit),) * 2, -np.inf)
    np.fill_diagonal(out, 0)
    for o in seen[1:]:
        out = (out[:, :, None] + model.move[None]).max(axis=1) + model.emit[:, o]
    return out


def block_path(model: Model, seen: list[int], before: int | None, end: int) -> list[int]:
    """The best states of a block's lines between two given states."""
    back = []
    score = model.begin + model.emit[:, seen[0]] if before is None else model.move[before] + model.emit[:, seen[0]]
    for o in seen[1:]:
        step = score[:, None] + model.move
        back.append(step.argmax(axis=0))
        score = step.max(axis=0) + model.emit[:, o]
    path = [end]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def _by_block(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Runs of equal ``columns`` in sorted batches, each whole."""
    held: list[pd.DataFrame] = []
    last: tuple = ()
    for pdf in batches:
        if not len(pdf):
            continue
        keys = list(zip(*(pdf[c].astype(object).where(pdf[c].notna(), None) for c in columns), strict=True))
        starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
        if held and keys[0] != last:
            yield pd.concat(held, ignore_index=True)
            held = []
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            yield pd.concat([*held, pdf.iloc[a:b]], ignore_index=True)
            held = []
        held.append(pdf.iloc[starts[-1] :])
        last = keys[-1]
    if held:
        yield pd.concat(held, ignore_index=True)


def fit(messages: DataFrame) -> Model:
    """Count a model from ``messages(conv_id, turn, role, text)``."""
    n_states = len(ROLES) * 2
    known = messages.where(F.col("role").isin(*ROLES))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros(n_states * int(np.prod(SHAPE)), np.int64)
        for pdf in batches:
            role = [ROLES.index(r) for r in pdf.role]
            for i, k, line in _lines(pdf.text.tolist()):
                out[(2 * role[i] + (k > 0)) * int(np.prod(SHAPE)) + observe(line, k == 0)] += 1
        yield pd.DataFrame({"o": np.flatnonzero(out), "n": out[out > 0]})

    # Sums of a fixed number of cells.
    cells = known.select("role", "text").mapInPandas(run, "o long, n long").groupBy("o").agg(F.sum("n").alias("n")).collect()
    observed = np.zeros(n_states * int(np.prod(SHAPE)))
    for r in cells:
        observed[r["o"]] = r["n"]
    role = F.array_position(F.array(*[F.lit(x) for x in ROLES]), F.col("role")).cast("int") - 1
    more = F.greatest(F.size(F.split(F.coalesce("text", F.lit("")), "\n")) - 1, F.lit(0))
    flat = known.select("conv_id", "turn", role.alias("r"), more.alias("more"))
    # Repeated rows are counted before they meet: at most 6 x 3 rows a turn.
    here = flat.groupBy("conv_id", "turn", "r", (F.col("more") > 0).alias("long")).agg(F.count(F.lit(1)).alias("n"))
    after = flat.groupBy("conv_id", (F.col("turn") - 1).alias("turn"), F.col("r").alias("next")).agg(F.count(F.lit(1)).alias("m"))
    met = here.join(after, ["conv_id", "turn"])
    pairs = met.groupBy("r", "long", "next").agg(F.sum(F.col("n") * F.col("m")).alias("count")).collect()
    moved = np.zeros((n_states, n_states))
    for r in pairs:
        moved[2 * r["r"] + r["long"], 2 * r["next"]] = r["count"]
    for r in flat.where("more > 0").groupBy("r").agg(F.count(F.lit(1)).alias("n"), F.sum("more").alias("lines")).collect():
        moved[2 * r["r"], 2 * r["r"] + 1] = r["n"]
        moved[2 * r["r"] + 1, 2 * r["r"] + 1] = r["lines"] - r["n"]
    first = flat.join(flat.groupBy("conv_id").agg(F.min("turn").alias("turn")), ["conv_id", "turn"]).groupBy("r").count().collect()
    begun = np.zeros(n_states)
    for r in first:
        begun[2 * r["r"]] = r["count"]
    return Model(observed, moved, begun)


def _matrices(model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _by_block(batches, ["conv_id", "block"]):
            lines = list(_lines(pdf.text.tolist()))
            seen = [observe(line, k == 0) for _, k, line in lines]
            one = pdf[["conv_id", "block"]].iloc[:1]
            yield one.assign(first=seen[0], matrix=[block_matrix(model.value, seen).ravel()], marks=[count_names(lines)])

    return run


def _between(model):
    """For each block the state before it (-1 at the start), its last state and
    the marker names of its transcript."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        k = len(m.emit)
        for pdf in _by_block(batches, ["conv_id"]):
            score, back = None, []
            for first, flat in zip(pdf["first"], pdf.matrix, strict=True):
                rest = np.asarray(flat, float).reshape(k, k)
                if score is None:
                    score = ((m.begin + m.emit[:, first])[:, None] + rest).max(axis=0)
                else:
                    table = ((m.move + m.emit[:, first])[:, :, None] + rest[None]).max(axis=1)
                    step = score[:, None] + table
                    back.append(step.argmax(axis=0))
                    score = step.max(axis=0)
            end = [int(score.argmax())]
            for b in reversed(back):
                end.append(int(b[end[-1]]))
            end = end[::-1]
            names = style_names(np.sum([np.asarray(m, np.int64) for m in pdf.marks], axis=0))
            yield pdf[["conv_id", "block"]].assign(before=[-1, *end[:-1]], end=end, names=[names] * len(pdf))

    return run


def _turns(model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _by_block(batches, ["conv_id", "block"]):
            lines = list(_lines(pdf.text.tolist()))
            before = int(pdf.before.iloc[0])
            path = block_path(model.value, [observe(line, k == 0) for _, k, line in lines], None if before < 0 else before, int(pdf.end.iloc[0]))
            turn = pdf.turn.tolist()
            names = set(pdf.names.iloc[0])
            parts: list[list] = []
            for (i, k, line), state in zip(lines, path, strict=True):
                role, goes_on = ROLES[state // 2], bool(state % 2)
                if not goes_on or not parts:
                    text = line
                    if not goes_on and marker_name(line) in names and marker(line)[0] - 1 == state // 2:
                        text = line[marker(line)[1] :]
                    parts.append([turn[i], k, role, goes_on, [text]])
                else:
                    parts[-1][4].append(line)
            conv = pdf.conv_id.iloc[0]
            yield pd.DataFrame(
                {
                    "conv_id": [conv] * len(parts),
                    "turn": [p[0] for p in parts],
                    "line": [p[1] for p in parts],
                    "role": [p[2] for p in parts],
                    "continues": [p[3] for p in parts],
                    "n_lines": [len(p[4]) for p in parts],
                    "rendered": [render(p[2], "\n".join(p[4]), p[3]) for p in parts],
                }
            )

    return run


def render(role: str, text: str, continues: bool = False) -> str:
    """The canonical form of a turn, or of a later part of one."""
    text = _HEADER.sub(r"<\\\1", text)
    return f"{text}\n" if continues else f"<|{role}|>\n{text}\n"


def unescape(text: str) -> str:
    """The text of a rendered turn as it stood in the transcript."""
    return _ESCAPED.sub(r"<\1", text)


def parse(transcripts: DataFrame, model: Model) -> DataFrame:
    """``(conv_id, turn, line, role, continues, n_lines, rendered)`` of
    ``transcripts(conv_id, turn, text)``: one row per recovered turn, with the
    number of the message and of the line in it where the turn begins."""
    spark = transcripts.sparkSession
    sent = spark.sparkContext.broadcast(model)
    kinds = {c: transcripts.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = transcripts.select("conv_id", "turn", "text", F.floor(F.coalesce("turn", F.lit(0)) / BLOCK).cast("long").alias("block"))
    blocks = rows.repartition(parts, "conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "text")
    matrices = blocks.mapInPandas(_matrices(sent), f"conv_id {kinds['conv_id']}, block long, first int, matrix array<double>, marks array<long>")
    ends = (
        matrices.repartition(parts, "conv_id")
        .sortWithinPartitions("conv_id", "block")
        .mapInPandas(_between(sent), f"conv_id {kinds['conv_id']}, block long, before int, end int, names array<string>")
        .withColumnsRenamed({"conv_id": "c", "block": "b"})
    )
    met = rows.join(ends, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))).drop("c", "b")
    met = met.repartition(parts, "conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "text")
    return met.mapInPandas(
        _turns(sent), f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, line int, role string, continues boolean, n_lines int, rendered string"
    )


#: How the transcripts of a labelled table are written: markers by role in the
#: order of ROLES; the last style has none.
STYLES = (("System: ", "User: ", "Assistant: "), ("[system] ", "Human: ", "AI: "), ("### Instruction: ", "Q: ", "A: "), ("", "", ""))


def styled(messages: DataFrame) -> DataFrame:
    """Labelled messages as transcripts: each text after its role's marker, in
    a style that the conversation's hash picks.  The role column is kept."""
    style = F.pmod(F.xxhash64(F.lit("style"), "conv_id"), F.lit(len(STYLES)))
    mark: Column = F.lit("")
    for s, marks in enumerate(STYLES):
        for role, text in zip(ROLES, marks, strict=True):
            mark = F.when((style == s) & (F.col("role") == role), F.lit(text)).otherwise(mark)
    return messages.select("conv_id", "turn", "role", F.concat(mark, F.coalesce("text", F.lit(""))).alias("text"))
