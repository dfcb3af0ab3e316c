"""Operator 1: personal data by bootstrapped contextual extraction.

Fixed grammars find the base entities (e-mail, IP, card, phone).  These seeds
induce lexical patterns: the words before and after them.  Spark then scores a
bipartite graph of patterns and instances: a pattern is as reliable as the
share of its distinct instances that are known to be of one kind, an instance
is as likely as its patterns together say, round after round.  Instances the
grammars missed (an obfuscated address, a number without its plus sign) that
score high enough become entities of the kind their contexts speak for, and seeds of
the next round, until a round finds no more.

The first pass over the texts writes a narrow table: one row per document with
its base spans and its candidates, offsets and context patterns, but no text.
All rounds read that table.

Defined results: a null or empty text has no spans; texts of any length are
searched whole; spans are code points, end exclusive; equal texts get equal
spans; other columns pass through ``redact``; an empty table gives an empty
table.  Base spans never change; an added span never overlaps another.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbforge.llm.common import SPACES, drop_stored, quoted, stored, text_key, whole_row, whole_text
from kbforge.session import broadcast_if_small

KINDS = ("email", "ip", "card", "phone")

#: Distinct known instances that a pattern needs, and the score that it and an
#: added instance need.
MIN_SUPPORT = 3.0
MIN_PATTERN = 0.5
MIN_INSTANCE = 0.8
#: Characters of context read on each side of an instance.
CONTEXT_CHARS = 80
#: Added spans up to this many rows are broadcast to the texts.
BROADCAST_ROWS = 50_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)++")
_DIGITS = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# What an identifier that the grammars miss can look like: a run of digits in
# groups, a word with an at sign, or an address spelled in several words.
_NUMBER = re.compile(r"\(?[0-9](?:[ ().-]{0,2}[0-9]){6,}")
_AT = re.compile(r"@|\(at\)|\[at\]|\{at\}", re.IGNORECASE)
_SPELLED_AT = re.compile(r" ?(?:\(at\)|\[at\]|\{at\}| at ) ?", re.IGNORECASE)
# Labels of a domain have 63 characters at most.
_SPELLED_DOMAIN = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:\.| ?(?:\(dot\)|\[dot\]|\{dot\}) ?| dot )[A-Za-z0-9-]{1,63})+", re.IGNORECASE)
_SPACE = re.compile(r"[\x20\x09-\x0D]")
_EDGE = "\"'()[]{}<>,;:.!?"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")

SPAN = "struct<kind:string,start:long,end:long>"
CANDIDATE = "struct<kind:string,start:long,end:long,instance:string,patterns:array<string>>"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each at sign outwards: linear, whatever the length of the words."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
            at = text.find("@", free)
        else:
            free = max(free, at)  # what lies before this sign can't reach past it
            at = text.find("@", at + 1)


def ips(text: str) -> Iterator[tuple[int, int]]:
    """Fours of the digit groups that single dots join."""
    for m in _DOTTED.finditer(text):
        parts = m.group().split(".")
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in four):
                yield at, end
            at = end + 1


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _DIGITS.finditer(text):
        if 16 <= m.end() - m.start() <= 37:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                yield m.span()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = zip(KINDS, (emails(text), ips(text), cards(text), phones(text)), strict=True)
    return [(kind, start, end) for kind, spans in found for start, end in spans]


def _handles(text: str) -> Iterator[tuple[int, int]]:
    """Words that hold an at sign: from each sign outwards to white space, no
    further back than the last word's end, so each character is seen once."""
    free, m = 0, _AT.search(text)
    while m:
        start = m.start()
        while start > free and text[start - 1] not in SPACES:
            start -= 1
        stop = _SPACE.search(text, m.end())
        free = stop.start() if stop else len(text)
        yield start, free
        m = _AT.search(text, free)


def _spelled(text: str) -> Iterator[tuple[int, int]]:
    """Addresses like ``jo [at] example [dot] com`` and ``jo at example dot com``."""
    free = 0
    for m in _SPELLED_AT.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _SPELLED_DOMAIN.match(text, m.end()) if start < m.start() else None
        free = domain.end() if domain else m.start()
        if domain:
            yield start, domain.end()


def candidates(text: str, taken: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """Identifier-like runs that overlap no base span and no other candidate."""
    used = sorted((s, e) for _, s, e in taken)
    found: list[tuple[int, int]] = []
    numbers = (m.span() for m in _NUMBER.finditer(text))
    for edge, spans in ((_EDGE, _spelled(text)), (_EDGE, _handles(text)), (_EDGE.replace("(", ""), numbers)):
        for start, end in spans:
            while start < end and text[start] in edge:
                start += 1
            while start < end and text[end - 1] in _EDGE:
                end -= 1
            if end - start >= 5:
                found.append((start, end))
    i, free = 0, 0
    for start, end in sorted(found, key=lambda x: (x[0], -x[1])):
        while i < len(used) and used[i][1] <= start:
            i += 1
        if start >= free and not (i < len(used) and used[i][0] < end):
            yield start, end
            free = end


def contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns of an instance: the three and the two words before it,
    and the word before with the word after.  Digits are masked, so that a
    pattern holds no other identifier."""
    clean = lambda w: re.sub(r"[0-9]", "#", w.lower().strip(_EDGE))
    left = [clean(m.group()) for m in _WORD.finditer(text, max(0, start - CONTEXT_CHARS), start)]
    if start and text[start - 1] not in " \t\n\x0b\x0c\r" and left:
        left = left[:-1] + [left[-1] + "_"]
    right = [clean(m.group()) for m in _WORD.finditer(text, end, end + CONTEXT_CHARS)][:1]
    out = []
    if len(left) >= 3:
        out.append("3 " + " ".join(left[-3:]))
    if len(left) >= 2:
        out.append("2 " + " ".join(left[-2:]))
    if left and right:
        out.append(f"1 {left[-1]} | {right[0]}")
    return out


def _instance(text: str) -> str:
    return re.sub(r"[\s().-]", "", text.lower())


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    cand = pa.list_(
        pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])
    )
    for batch in batches:
        spans, seen = [], []
        for x in batch.column(batch.schema.get_field_index("text")):
            text = x.as_py()
            base = base_spans(text)
            spans.append([{"kind": k, "start": s, "end": e} for k, s, e in base])
            both = [*base, *((None, s, e) for s, e in candidates(text, base))]
            seen.append(
                [{"kind": k, "start": s, "end": e, "instance": _instance(text[s:e]), "patterns": contexts(text, s, e)} for k, s, e in both]
            )
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(spans, span), pa.array(seen, cand)], ["doc_id", "key", "spans", "seen"]
        )


def scan(df: DataFrame, id_col: str | None = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, key, spans, seen)`` of each row, without its text.  Without
    ``id_col`` the ids are null."""
    doc_id = F.col(id_col) if id_col else F.lit(None).cast("long")
    kind = df.select(doc_id.alias("doc_id")).schema["doc_id"].dataType.simpleString()
    rows = df.select(doc_id.alias("doc_id"), text_key(whole_text(text_col)).alias("key"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(_scan, f"doc_id {kind}, key struct<a:long,b:long>, spans array<{SPAN}>, seen array<{CANDIDATE}>")


def bootstrap(scanned: DataFrame) -> DataFrame:
    """``(key, kind, start, end)`` of the entities that contexts reveal.

    Copies of a text and repeated values count once: the graph is over
    distinct (pattern, instance) pairs.  Entities found stay found, so the
    rounds end: the last one finds none.
    """
    # The same value can stand in a seed and in a candidate; each is a node.
    seen = scanned.select("key", F.explode("seen").alias("s")).select("key", "s.*").distinct()
    edges = stored(seen.select(F.explode("patterns").alias("pattern"), "instance", F.coalesce("kind", F.lit("?")).alias("seed")).distinct())
    open_edges = edges.where("seed = '?'").select("pattern", "instance")
    # A pattern is judged over all its distinct instances, known or not.
    width = edges.groupBy("pattern").agg(F.count_distinct("instance", "seed").alias("width"))
    seeds = edges.where("seed != '?'").select("pattern", F.col("seed").alias("kind"), F.lit(1.0).alias("score"))
    good, likely = None, None
    while True:
        known = seeds if likely is None else seeds.unionByName(open_edges.join(likely, "instance").select("pattern", "kind", "score"))
        patterns = (
            known.groupBy("pattern", "kind")
            .agg(F.sum("score").alias("support"))
            .join(width, "pattern")
            .select("pattern", "kind", "support", (F.col("support") / F.col("width")).alias("conf"))
            .where((F.col("support") >= MIN_SUPPORT) & (F.col("conf") >= MIN_PATTERN))
        )
        scored = (
            open_edges.join(patterns, "pattern")
            .groupBy("instance", "kind")
            .agg((1.0 - F.exp(F.sum(F.log(F.greatest(1.0 - F.col("conf"), F.lit(1e-6)))))).alias("score"))
            .groupBy("instance")
            .agg(F.max(F.struct("score", "kind")).alias("best"))
            .select("instance", "best.kind", "best.score")
        )
        if good is not None:
            old = good.select("instance", "kind", F.lit(1.0).alias("score"))
            scored = scored.join(good.select("instance"), "instance", "left_anti").unionByName(old)
        last, likely = likely, stored(scored)
        more = likely.where(F.col("score") >= MIN_INSTANCE)
        n_before, n_now = 0 if good is None else good.count(), more.count()
        if last is not None:
            drop_stored(last)
        good = more.select("instance", "kind")
        if n_now == n_before:
            break
    found = good.select("instance", F.col("kind").alias("found"))
    return seen.where(F.col("kind").isNull()).join(found, "instance").select("key", F.col("found").alias("kind"), "start", "end")


def _order(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind)


def _text_of(spans: Column) -> Column:
    """``kind:start:end`` by kind as listed, then start, comma-joined."""
    by = F.array_sort(F.transform(spans, lambda s: F.struct(_order(s["kind"]).alias("o"), s["start"].alias("s"), s["end"].alias("e"), s["kind"].alias("k"))))
    return F.array_join(F.transform(by, lambda s: F.concat_ws(":", s["k"], s["s"].cast("string"), s["e"].cast("string"))), ",")


def extract(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, key, spans, added)``: base spans and spans added by context."""
    scanned = stored(scan(df, id_col, text_col))
    added = bootstrap(scanned).groupBy("key").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    return (
        scanned.select("doc_id", "key", "spans")
        .join(added, "key", "left")
        .select("doc_id", "key", "spans", F.coalesce("added", F.array().cast(f"array<{SPAN}>")).alias("added"))
    )


def report(found: DataFrame) -> DataFrame:
    """Counts, digest of the base spans and all spans of each document."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(k) for k in KINDS],
        F.sha2(_text_of(F.col("spans")).cast("binary"), 256).alias("base_sha256"),
        _text_of(F.concat("spans", "added")).alias("spans"),
    )


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with every span of its texts replaced by ``[EMAIL]`` and the like
    (where spans of two kinds overlap, by the first one's mark)."""
    added = bootstrap(stored(scan(df, None, text_col))).groupBy("key").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    rows = df.select(whole_row(df), text_key(whole_text(text_col)).alias("key"), F.col(text_col).alias("text"))
    rows = rows.join(broadcast_if_small(stored(added), BROADCAST_ROWS), "key", "left").select("row", "text", "added")
    shape = T.StructType([rows.schema["row"], T.StructField("clean", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, more in zip(batch.column(1), batch.column(2), strict=True):
                text = x.as_py()
                if text is not None:
                    spans = [*base_spans(text), *((m["kind"], m["start"], m["end"]) for m in more.as_py() or ())]
                    parts, free = [], 0
                    for start, end, name in sorted((s, e, k) for k, s, e in spans):
                        if start >= free:
                            parts += [text[free:start], f"[{name.upper()}]"]
                        free = max(free, end)
                    text = "".join(parts) + text[free:]
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["row", "clean"])

    clean = rows.mapInArrow(run, shape)
    return clean.select(*[F.col("clean").alias(c) if c == text_col else F.col("row." + quoted(c)).alias(c) for c in df.columns])
