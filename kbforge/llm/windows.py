"""Bucket identifiers of the positions of a text, refined by later offsets.

A bucket's identifier stands for the bytes that its positions start with, so
tasks agree on it without asking each other.
"""

from __future__ import annotations

import numpy as np

from kbforge.llm.shingles import inverse_powers, mix, powers

_SPREAD = np.uint64(0xD6E8FEB86659FD93)
_JOIN = np.uint64(0x9FB21C651E98DF25)
PLACE_BITS = 20
_PLACE = np.uint64((1 << PLACE_BITS) - 1)


def gram_ids(raw: np.ndarray, q: int) -> np.ndarray:
    """Initial buckets: an identifier of the ``q`` bytes at each position."""
    total = np.empty(len(raw) + 1, np.uint64)
    total[0] = 0
    x = raw.astype(np.uint64)
    x += np.uint64(1)
    x *= powers(len(raw))
    np.cumsum(x, out=total[1:])
    x = total[q:] - total[:-q]
    x *= inverse_powers(len(raw) - q + 1)
    x *= _SPREAD
    x ^= x >> np.uint64(29)
    x *= _SPREAD
    return x


def refined(ids: np.ndarray, at: np.ndarray, q: int, length: int, salt: int = 0) -> np.ndarray:
    """Identifiers of the ``length`` bytes at the positions ``at``: a bucket of
    ``q`` bytes is joined with that of the position ``q`` later, the result
    with that of ``2 q`` later, and so on; only for the positions asked for."""
    if length == q:
        return ids[at] + np.uint64(salt)
    half = length // 2
    x = refined(ids, at, q, half, salt)
    x *= _JOIN
    x += refined(ids, at + half, q, half, salt)
    return mix(x)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values: block prefixes and suffixes."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    table = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(raw: np.ndarray, q: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The windows of ``length`` bytes by their anchor: ``(bucket, span, lo,
    width)`` arrays, one entry for each run of windows that start at ``lo`` up
    to ``lo + width - 1`` and share an anchor.

    The anchor of a window is its first least q-gram.  It depends on the bytes
    of the window only, so equal windows have anchors in the same bucket and
    at the same place.  ``span`` identifies all bytes of the run's windows and
    where the anchor stands in them.
    """
    if len(raw) < length:
        none = np.zeros(0, np.uint64)
        return none, none, np.zeros(0, np.int64), np.zeros(0, np.int64)
    ids = gram_ids(raw, q)
    place = np.arange(len(ids), dtype=np.uint64)
    least = sliding_least((ids & ~_PLACE) | place, length - q + 1)
    at = (least & _PLACE).astype(np.int64)
    new = np.empty(len(at), bool)
    new[0] = True
    np.not_equal(at[1:], at[:-1], out=new[1:])
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(at)) - 1
    anchor = at[lo]
    # Two windows cover the run, as it is shorter than twice a window.
    span = refined(ids, lo, q, length) * _JOIN + refined(ids, hi, q, length)
    span = mix(mix(span) + ((hi - lo) << 20 | (anchor - lo)).astype(np.uint64))
    return ids[anchor], span, lo, hi - lo + 1


def merged(spans: np.ndarray) -> np.ndarray:
    """Sorted, disjoint and not adjacent intervals that cover the same bytes."""
    if not len(spans):
        return np.zeros((0, 2), np.int64)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.append(True, spans[1:, 0] > reach[:-1])
    starts = np.flatnonzero(new)
    return np.stack([spans[starts, 0], reach[np.append(starts[1:], len(spans)) - 1]], axis=1)
