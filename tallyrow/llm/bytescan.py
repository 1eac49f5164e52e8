"""Words of a batch of texts as spans of its UTF-8 bytes, and 64-bit hashes of spans, without a loop in Python."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time, besides a longer span.
GROUP = 1 << 18
_M = 1 << 64
_BASE = 0x9E3779B97F4A7C15

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LINE = np.zeros(256, bool)
LINE[10] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BYTE = np.random.default_rng(20240229).integers(0, _M, 256, np.uint64, endpoint=False) | np.uint64(1)
_powers = [np.ones(0, np.uint64), np.ones(0, np.uint64)]


def texts_of(batch: pa.RecordBatch, column: str) -> tuple[memoryview, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null: empty."""
    texts = batch.column(column).cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = memoryview(data if data is not None else b"")[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def spans(view: np.ndarray, offsets: np.ndarray, white: np.ndarray = SPACE, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of other bytes than white ones, and how many of them lie before each offset; runs also end where cuts is true (one longer than view)."""
    ink = ~white[view]
    edge = np.zeros(len(view) + 1, bool) if cuts is None else cuts
    edge[offsets] = True
    before, after = np.zeros(len(view), bool), np.zeros(len(view), bool)
    before[1:], after[:-1] = ink[:-1], ink[1:]
    starts = np.flatnonzero(ink & (~before | edge[:-1]))
    ends = np.flatnonzero(ink & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hash_group(view: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans in order; takes memory for the bytes from the first start to the last end.

    A span's sum of byte values times powers, divided by the power at its start, is the
    same wherever the span stands.
    """
    a, b = int(starts[0]), int(ends[-1])
    if len(_powers[0]) < b - a:
        n = max(2 * GROUP, b - a)
        for i, x in enumerate((_BASE, pow(_BASE, -1, _M))):
            _powers[i] = np.cumprod(np.full(n, x, np.uint64))
    upto = np.zeros(b - a + 1, np.uint64)
    np.cumsum(_BYTE[view[a:b]] * _powers[0][: b - a], out=upto[1:])
    return mix((upto[ends - a] - upto[starts - a]) * _powers[1][starts - a])


def groups(starts: np.ndarray):
    """Slices of spans that start within GROUP bytes of each other."""
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + GROUP)))
        yield lo, hi
        lo = hi


def hashes(view: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    for lo, hi in groups(starts):
        out[lo:hi] = hash_group(view, starts[lo:hi], ends[lo:hi])
    return out
