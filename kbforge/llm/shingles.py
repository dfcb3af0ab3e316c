"""Sets of hashed word shingles, computed over a whole Arrow batch at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MULT = np.uint64(0xD6E8FEB86659FD93)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """``_BASE ** i`` modulo 2**64 for i below ``n``."""
    global _powers
    while len(_powers) < n:
        _powers = np.concatenate([_powers, _powers * (_powers[-1:] * _BASE)])
    return _powers[:n]


def inverse_powers(n: int) -> np.ndarray:
    global _inverse
    while len(_inverse) < n:
        _inverse = np.concatenate([_inverse, _inverse * (_inverse[-1:] * _UNBASE)])
    return _inverse[:n]


_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_inverse = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all their bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * _MULT
    x = x ^ (x >> np.uint64(32))
    x = x * _MULT
    return x ^ (x >> np.uint64(32))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row ends in them, without a copy."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def word_hashes(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, in
    order, and the number of words before each row."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    first = np.zeros(len(raw), bool)
    first[ends[:-1][ends[:-1] < len(raw)]] = True
    before = np.empty(len(raw), bool)
    before[0] = True
    before[1:] = space[:-1]
    starts = np.flatnonzero(~space & (before | first))
    last = np.zeros(len(raw), bool)
    last[ends[1:][ends[1:] > 0] - 1] = True
    after = np.empty(len(raw), bool)
    after[-1] = True
    after[:-1] = space[1:]
    stops = np.flatnonzero(~space & (after | last)) + 1
    lower = raw + np.uint8(32) * ((raw >= 65) & (raw <= 90)).astype(np.uint8)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((lower.astype(np.uint64) + np.uint64(1)) * powers(len(raw)), out=total[1:])
    hashed = (total[stops] - total[starts]) * inverse_powers(len(raw))[starts]
    hashed = mix(hashed ^ ((stops - starts).astype(np.uint64) << np.uint64(48)))
    return hashed, np.searchsorted(starts, ends)


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """For each text its distinct shingles of ``width`` words, hashed and
    sorted; a shorter text is one shingle, one without words none."""
    hashed, ends = word_hashes(*text_bytes(column))
    runs = hashed.copy()
    for k in range(1, width):
        runs[: len(hashed) - k] = runs[: len(hashed) - k] * _MULT + hashed[k:]
    runs = mix(runs)
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        n = b - a
        if n >= width:
            out.append(np.unique(runs[a : b - width + 1]))
        elif n:
            whole = np.uint64(n)
            with np.errstate(over="ignore"):
                for h in hashed[a:b]:
                    whole = whole * _BASE + h
            out.append(mix(np.array([whole], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
