"""Elias-Fano coding of non-decreasing integers, read in place from a memory map by whole arrays of queries."""

from __future__ import annotations

import json
import mmap

import numpy as np

_BLOCK = 2  # words between entries of a directory
_ONE = np.uint64(1)

#: Place of the k-th one bit of a byte.
_IN_BYTE = np.zeros((256, 8), np.uint8)
for _x in range(256):
    _places = [i for i in range(8) if _x >> i & 1]
    _IN_BYTE[_x, : len(_places)] = _places


class EliasFano:
    """n values below universe: low bits packed, high bits in unary, with directories of ones and zeros."""

    def __init__(self, parts: dict[str, np.ndarray]):
        self.parts = parts
        self.n, self.l = (int(x) for x in parts["shape"])
        self.low, self.high, self.ones, self.zeros = (parts[k] for k in ("low", "high", "ones", "zeros"))

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> "EliasFano":
        n = len(values)
        l = max(0, int(universe // max(n, 1)).bit_length() - 1)  # noqa: E741
        values = values.astype(np.uint64)
        low = np.zeros(n * l // 64 + 2, np.uint64)
        if l:
            at = np.arange(n, dtype=np.uint64) * np.uint64(l)
            x = values & np.uint64((1 << l) - 1)
            np.bitwise_or.at(low, (at >> np.uint64(6)).astype(np.int64), x << (at & np.uint64(63)))
            over = (at & np.uint64(63)) + np.uint64(l) > 64
            np.bitwise_or.at(low, (at[over] >> np.uint64(6)).astype(np.int64) + 1, x[over] >> (np.uint64(64) - (at[over] & np.uint64(63))))
        buckets = (universe >> l) + 1
        bits = np.zeros(-(-(n + buckets + 1) // (64 * _BLOCK)) * 64 * _BLOCK, bool)
        bits[(values >> np.uint64(l)).astype(np.int64) + np.arange(n)] = True
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high).reshape(-1, _BLOCK).sum(1, dtype=np.int64))])[:-1]
        zeros = np.arange(len(ones), dtype=np.int64) * 64 * _BLOCK - ones
        kind = np.uint32 if len(bits) < 1 << 32 else np.int64
        return cls({"shape": np.array([n, l], np.int64), "low": low, "high": high, "ones": ones.astype(kind), "zeros": zeros.astype(kind)})

    @classmethod
    def inside(cls, parts: dict[str, np.ndarray], prefix: str) -> "EliasFano":
        """The one whose arrays have this prefix among others."""
        return cls({k[len(prefix) :]: v for k, v in parts.items() if k.startswith(prefix)})

    def named(self, prefix: str) -> dict[str, np.ndarray]:
        return {prefix + k: v for k, v in self.parts.items()}

    @property
    def last(self) -> np.uint64:
        """The greatest value."""
        return self.get(np.array([self.n - 1]))[0]

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Places of the k-th ones or zeros."""
        directory = self.ones if one else self.zeros
        block = np.searchsorted(directory, k.astype(directory.dtype), side="right") - 1
        rest = k - directory[block].astype(np.int64)
        word = block * _BLOCK
        for _ in range(_BLOCK - 1):
            c = np.bitwise_count(self.high[word] if one else ~self.high[word])
            on = rest >= c
            rest -= c * on
            word += on
        w = self.high[word] if one else ~self.high[word]
        place = word * 64
        for width in (32, 16, 8):
            part = w & np.uint64((1 << width) - 1)
            c = np.bitwise_count(part)
            on = rest >= c
            rest -= c * on
            place += width * on
            w = np.where(on, w >> np.uint64(width), part)
        return place + _IN_BYTE[w.astype(np.uint8), rest]

    def _next(self, place: np.ndarray, k: np.ndarray, one: bool) -> np.ndarray:
        """Places of the k-th ones or zeros, the first after the given places; by select where 64 bits have none."""
        place = place + 1
        word, shift = place >> 6, (place & 63).astype(np.uint64)
        last = len(self.high) - 1
        bits = self.high[np.minimum(word, last)] >> shift
        bits |= np.where(shift == 0, np.uint64(0), self.high[np.minimum(word + 1, last)] << ((np.uint64(64) - shift) & np.uint64(63)))
        if not one:
            bits = ~bits
        out = place + np.bitwise_count((bits & (~bits + _ONE)) - _ONE)
        # no bit in 64, or one that comes from a word beyond the last
        far = np.flatnonzero((bits == 0) | (out >> 6 > last))
        if len(far):
            out[far] = self._select(k[far], one)
        return out

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.l:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.l)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        over = np.where(shift == 0, np.uint64(0), self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)))
        return ((self.low[word] >> shift) | over) & np.uint64((1 << self.l) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at places i."""
        return ((self._select(i, True) - i).astype(np.uint64) << np.uint64(self.l)) | self._low(i)

    def range(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values at places i and i + 1."""
        here = self._select(i, True)
        both = (here, i), (self._next(here, i + 1, True), i + 1)
        return tuple((((place - k).astype(np.uint64) << np.uint64(self.l)) | self._low(k)).astype(np.int64) for place, k in both)

    def find(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The place of each x among the places lo to hi - 1; -1 if it isn't there. The values there must be distinct."""
        bucket = (x >> np.uint64(self.l)).astype(np.int64)
        before = np.where(bucket > 0, self._select(np.maximum(bucket - 1, 0), False), -1)
        at = np.maximum(before - bucket + 1, lo)
        stop = np.minimum(self._next(before, bucket, False) - bucket, hi)
        want = x & np.uint64((1 << self.l) - 1)
        out, end = np.full(len(x), -1, np.int64), stop.copy()
        left = np.flatnonzero(at < stop)
        while len(left):  # bisection: a frequent context has many successors in a bucket
            mid = (at[left] + stop[left]) >> 1
            less = self._low(mid) < want[left]
            at[left[less]] = mid[less] + 1
            stop[left[~less]] = mid[~less]
            left = left[at[left] < stop[left]]
        some = np.flatnonzero(at < end)
        hit = some[self._low(at[some]) == want[some]]
        out[hit] = at[hit]
        return out


def packed_levels(parts: dict[str, np.ndarray]) -> list[bytes]:
    """Arrays as the bytes of one file, each at a multiple of 64 bytes."""
    head, at = {}, 0
    for k, v in parts.items():
        head[k] = [str(v.dtype), len(v), at]
        at += -(-v.nbytes // 64) * 64
    line = json.dumps(head).encode()
    out = [len(line).to_bytes(8, "little") + line + b" " * (-(len(line) + 8) % 64)]
    return out + [v.tobytes() + b"\0" * (-v.nbytes % 64) for v in parts.values()]


def load(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file, as views of its memory map."""
    with open(path, "rb") as f:
        m = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    size = int.from_bytes(m[:8], "little")
    start = -(-(size + 8) // 64) * 64
    return {k: np.frombuffer(m, kind, n, start + at) for k, (kind, n, at) in json.loads(m[8 : 8 + size]).items()}
