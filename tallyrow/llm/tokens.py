"""Token ids of whole texts, for writing and packing.

Encoder wraps a file of the tokenizers library. If the file splits words by the pattern
below (its normaliser and splitter are read and compared), no token spans white space,
so the ids of a text are those of its white-space pieces in turn; nor does one span a
letter and a mark of ASCII next to it (but `'s` and the like), so a word and its full
stop are pieces of their own. Pieces repeat: each one goes through the library's
normaliser, splitter and model once, and is found again by a 64-bit hash of its bytes,
computed for a whole batch at a time. The table of pieces is bounded; when it is full,
those stay that were met again since it last was. Any other file is encoded text by text,
and so is a text that may hold the string of an added token, for the library looks for
those first.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np

from tallyrow.llm.bytescan import groups, hash_group, spans

#: Pieces and words kept by an Encoder.
PIECES = 500_000
WORDS = 80_000
#: Appended to each document.
END = 2
#: The split pattern of the file this encoder knows.
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

# Below U+0250 there is nothing to compose, and these are all the letters and numbers once lower-cased.
_PLAIN = re.compile("[\x21-\x7e\xa1-\xac\xae-\u012f\u0131-\u024f]*").fullmatch
_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u024f\u2c65\u2c66]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^a-z0-9\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xdf-\xf6\xf8-\u024f\u2c65\u2c66]+").findall
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 13, 32]] = True
# Letters of ASCII: 1; its marks: 2, the apostrophe: 3.
_CLASS = np.array([1 if chr(b).isalpha() else 3 if b == 39 else 2 if 33 <= b < 127 and not chr(b).isdigit() else 0 for b in range(128)] + [0] * 128, np.uint8)

_made: dict[str, "Encoder"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoder(path: str) -> "Encoder":
    """The process's Encoder of this file."""
    if path not in _made:
        _made[path] = Encoder(path)
    return _made[path]


def forget() -> None:
    """Drops the process's Encoders; encoder() makes them anew."""
    _made.clear()


def crc(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))


class Encoder:
    def __init__(self, path: str, pieces: int = PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        said = json.loads(self.model.to_str())
        kinds = [x.get("type") for x in (said.get("normalizer") or {}).get("normalizers", [])]
        splits = [x.get("pattern", {}).get("Regex") for x in (said.get("pre_tokenizer") or {}).get("pretokenizers", []) if x["type"] == "Split"]
        self.by_piece = kinds == ["NFC", "Replace", "Lowercase"] and splits == [SPLIT] and said["model"]["type"] == "BPE"
        # Added tokens are sought in the normalised text. Their last two characters, if marks of ASCII, are in the text itself then.
        ends = {x["content"][-2:] for x in said.get("added_tokens", [])}
        self.by_piece &= all(re.fullmatch(r"[!-/:-@\[-`{-~]{2}", x) for x in ends)
        self.added = re.compile("|".join(re.escape(x) for x in sorted(ends)).encode()) if ends else None
        del said
        self.most = pieces
        # The byte-level splitter shows printable bytes as themselves and the others as U+0100 and up.
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.shown = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in own)}
        self.plain = {chr(b): b for b in own} | {c: b for b, c in self.shown.items()}
        self._clear()

    def _clear(self) -> None:
        self.words: dict[str, list[int]] = {}
        self.mask = (1 << 18) - 1
        self.keys = np.zeros(self.mask + 1, np.uint64)
        self.number = np.zeros(self.mask + 1, np.int32)
        self.known = self.used = 0
        self.ids = np.zeros(1 << 18, np.uint16 if self.model.get_vocab_size() <= 1 << 16 else np.uint32)
        self.first = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int32)
        self.again = np.zeros(1 << 16, bool)

    # -- ids of a piece, by the library

    def _word(self, word: str) -> list[int]:
        got = self.words.get(word)
        if got is None:
            if len(self.words) >= WORDS:
                self.words.clear()
            shown = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.shown)
            got = self.words[word] = [t.id for t in self.model.model.tokenize(shown)]
        return got

    def _piece(self, piece: bytes) -> list[int]:
        text = piece.decode()
        if _PLAIN(text):
            parts = _SPLIT(text.lower())
        else:
            parts = [(bytes(self.plain[c] for c in p)).decode() for p, _ in self.model.pre_tokenizer.pre_tokenize_str(self.model.normalizer.normalize_str(text))]
        if len(parts) == 1:
            return self._word(parts[0])
        return [i for p in parts for i in self._word(p)]

    # -- the table of pieces

    def _find(self, h: np.ndarray) -> np.ndarray:
        at = (h >> np.uint64(20)).astype(np.int64) & self.mask
        key = self.keys[at]
        out = np.where(key == h, self.number[at], -1)
        open_ = np.flatnonzero((key != h) & (key != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            key = self.keys[at[open_]]
            hit = key == h[open_]
            out[open_[hit]] = self.number[at[open_[hit]]]
            open_ = open_[~hit & (key != 0)]
        return out

    def _put(self, h: np.ndarray, number: np.ndarray) -> None:
        at = (h >> np.uint64(20)).astype(np.int64) & self.mask
        left = np.arange(len(h))
        while len(left):
            free = left[self.keys[at[left]] == 0]
            _, one = np.unique(at[free], return_index=True)
            done = free[one]
            self.keys[at[done]], self.number[at[done]] = h[done], number[done]
            left = left[self.keys[at[left]] != h[left]]
            at[left] = (at[left] + 1) & self.mask

    def _learn(self, h: np.ndarray, data: memoryview, starts: np.ndarray, ends: np.ndarray) -> None:
        numbers = np.arange(self.known, self.known + len(h), dtype=np.int32)
        while 2 * (self.known + len(h)) > self.mask:
            old = self.keys != 0
            keys, number = self.keys[old], self.number[old]
            self.mask = 2 * self.mask + 1
            self.keys, self.number = np.zeros(self.mask + 1, np.uint64), np.zeros(self.mask + 1, np.int32)
            self._put(keys, number)
        got = [self._piece(bytes(data[a:b])) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        sizes = np.fromiter(map(len, got), np.int32, len(got))
        flat = np.fromiter((i for x in got for i in x), np.uint32, int(sizes.sum()))
        while self.known + len(h) > len(self.first):
            self.first, self.size, self.again = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.size, self.again))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.size[numbers] = sizes
        self.first[numbers] = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)
        self.known += len(h)
        self._put(h, numbers)

    def _forget(self) -> None:
        """Leaves the pieces that were met again, half of the table at most, the oldest first."""
        slots = np.flatnonzero(self.keys)
        slots = slots[self.again[self.number[slots]]]
        slots = slots[np.argsort(self.number[slots])][: self.most // 2]
        old, keys = self.number[slots], self.keys[slots]
        size = self.size[old]
        stop = np.cumsum(size, dtype=np.int64)
        ids = self.ids[np.repeat(self.first[old] - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)]
        self.keys[:], self.again[:] = 0, False
        self.known, self.used = len(old), len(ids)
        self.ids[: len(ids)], self.size[: len(old)], self.first[: len(old)] = ids, size, stop - size
        self._put(keys, np.arange(len(old), dtype=np.int32))

    def encode_batch(self, data: bytes | memoryview, offsets: np.ndarray, end: int | None = END) -> tuple[np.ndarray, np.ndarray]:
        """Flat uint32 ids of the texts data[offsets[i]:offsets[i + 1]], each with the end id, and their offsets."""
        if not self.by_piece:
            return self._whole(data, offsets, end)
        if self.added is None or not self.added.search(data):
            return self._pieces(data, offsets, end)
        at = np.array([m.start() for m in self.added.finditer(data)])
        flat, sizes, done = [], [], 0
        for i in [*np.unique(np.searchsorted(offsets, at, side="right") - 1).tolist(), len(offsets) - 1]:
            for own, run in ((offsets[done : i + 1], self._pieces), (offsets[i : i + 2], self._whole)):
                if len(own) > 1:
                    ids, bounds = run(data[own[0] : own[-1]], own - own[0], end)
                    flat.append(ids)
                    sizes.append(np.diff(bounds))
            done = i + 1
        return np.concatenate(flat), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])

    def _whole(self, data: bytes | memoryview, offsets: np.ndarray, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Each text by the library."""
        tail = [] if end is None else [end]
        got = [self.model.encode(bytes(data[a:b]).decode(), add_special_tokens=False).ids + tail for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in got], dtype=np.int64)])
        return np.array([i for x in got for i in x], np.uint32), bounds

    def _pieces(self, data: bytes | memoryview, offsets: np.ndarray, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        n = len(offsets) - 1
        tail = 0 if end is None else 1
        view = np.frombuffer(data, np.uint8)
        kind, cuts = _CLASS[view], np.zeros(len(view) + 1, bool)
        cuts[1:-1] = ((kind[:-1] == 1) & (kind[1:] > 1)) | ((kind[:-1] == 2) & (kind[1:] == 1))
        starts, ends, cut = spans(view, offsets, _WHITE, cuts)
        parts, sizes = [], [np.zeros(0, np.int64)]
        for lo, hi in groups(starts):
            ids, size = self._group(memoryview(data), view, starts[lo:hi], ends[lo:hi])
            parts.append(ids)
            sizes.append(size)
        flat = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        upto = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])[cut]
        bounds = upto + np.arange(n + 1) * tail
        if not tail:
            return flat, bounds
        out = np.empty(len(flat) + n, np.uint32)
        keep = np.ones(len(out), bool)
        keep[bounds[1:] - 1] = False
        out[keep] = flat
        out[~keep] = end
        return out, bounds

    def _group(self, data: memoryview, view: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = hash_group(view, starts, ends) | np.uint64(1)
        row = self._find(h)
        self.again[row[row >= 0]] = True
        if len(new := np.flatnonzero(row < 0)):
            if self.known + len(new) > self.most:
                self._forget()
                if self.known + len(new) > self.most:
                    self._clear()
                new = np.flatnonzero(self._find(h) < 0)
            keys, one = np.unique(h[new], return_index=True)
            self._learn(keys, data, starts[new[one]], ends[new[one]])
            row = self._find(h)
        size = self.size[row].astype(np.int64)
        stop = np.cumsum(size)
        at = np.repeat(self.first[row] - (stop - size), size)
        at += np.arange(len(at))
        return self.ids[at].astype(np.uint32), size

    def encode(self, text: str | None, end: int | None = END) -> np.ndarray:
        data = (text or "").encode()
        return self.encode_batch(data, np.array([0, len(data)]), end)[0]
