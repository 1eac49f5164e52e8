"""Language-model scores from an Elias-Fano n-gram trie.

The model has three orders over lower-cased words and an end token, with Dirichlet
smoothing, each order towards the one below and the lowest by add-one:
p(w | v) = (c(v, w) + M p(w)) / (c(v) + M), p(w | u, v) = (c(u, v, w) + M3 p(w | v)) / (c(u, v) + M3).
A text's first word has the start as its context and no third order.

Level 1: the words' 64-bit hashes in order as an Elias-Fano sequence for each range of
hashes, with their counts; a word's id is its rank.

Levels 2 and 3 of what follows a word v, in shards by a hash of (v, w), so that a
frequent context is spread over all of them:

- the contexts v that occur in the shard, and Elias-Fano pointers to their successors w;
- the words u before v, and Elias-Fano pointers to the successors of (u, v). These are
  numbered relative to their context: w is its rank among the successors of v.
- a byte each for the smoothed probabilities, quantised over the shard's range: of w
  after v, of w after (u, v) without its denominator, and of that denominator for (v, w)
  as a context, which is asked for with the text's next word.

A query finds v, searches w among its successors, then u, and w's rank among the
successors of (u, v).

Counting passes go over all training texts: tasks count their own n-grams, send sorted
blocks to a shard, and a shard merges blocks and writes its level to the shared folder
in spark.checkpoint.dir, put in place at once. Scoring maps these files; nothing is sent
to the driver but a line for each file. A folder that isn't mounted is read and written
through pyarrow's file systems; a worker then maps a copy of a level.

Training texts are those whose crc32(doc_id as text) mod 7 is not 2 (a null id trains).
Nulls: a null text is empty: it has the end token only. Repeated rows count each time.
An empty table gives an empty result. Extra columns are ignored. Words count as equal if
their 64-bit hashes are. Ids have 32 bits: more different words are refused.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrow.llm.bytescan import LOWER, hashes, mix, spans, texts_of
from tallyrow.llm.common import documents, release, remainder, scratch, ship
from tallyrow.llm.elias_fano import EliasFano, load, packed_levels

#: Weight of the unigram model in the bigram model, and of that in the trigram model, in tokens.
M, M3 = 50.0, 30.0
#: Tokens counted by a task before it sends them on.
TOKENS = 2_000_000
#: Bytes of text for a shard of words, and for a shard of n-grams.
WORD_BYTES, GRAM_BYTES = 32 << 20, 16 << 20

#: Hash of the end token.
_END = np.uint64(0x1F0E0D0C0B0A0908)
#: In the place of u: a first word.
_NONE = 0xFFFFFFFF

_U32 = np.uint64(32)
_LOW32 = np.uint64(0xFFFFFFFF)


def tokens(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's tokens, the end token last, and their bounds."""
    data, offsets = texts_of(batch, column)
    view = LOWER[np.frombuffer(data, np.uint8)]
    starts, ends, cut = spans(view, offsets)
    n = len(offsets) - 1
    bounds = cut + np.arange(n + 1)
    out = np.full(len(starts) + n, _END, np.uint64)
    keep = np.ones(len(out), bool)
    keep[bounds[1:] - 1] = False
    out[keep] = hashes(view, starts, ends)
    return out, bounds


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _order(u: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order, and u (32 bits) with its key's place among them above it, as one number to sort by."""
    keys, place = np.unique(key, return_inverse=True)
    return keys, place.astype(np.uint64) << _U32 | u.astype(np.uint32)


def _sum(n: np.ndarray | None, *keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums of n (None: ones) over equal keys, and the keys, in order of the last, then of a first one of 32 bits."""
    seen, x = (None, keys[0]) if len(keys) == 1 else _order(*keys)
    if n is None:
        x = np.sort(x)
        first = _firsts(x)
        n = np.diff(np.append(first, len(x)))
    else:
        order = np.argsort(x)
        x, n = x[order], n[order]
        first = _firsts(x)
        n = np.add.reduceat(n, first) if len(first) else n
    x = x[first]
    return (n, x) if seen is None else (n, x.astype(np.uint32), seen[(x >> _U32).astype(np.int64)])


def _counted(keys_of: Callable, shard_of: Callable) -> Callable:
    """A task's counts as blocks: shard, n, keys."""

    def flush(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        keys = [np.concatenate(x) for x in zip(*held, strict=True)]
        n, *keys = _sum(None, *keys)
        shard = shard_of(keys[-1])
        if shard.max() < 1 << 16:
            shard = shard.astype(np.uint16)  # sorted by digits
        order = np.argsort(shard, kind="stable")
        shard = shard[order]
        ids, first = np.unique(shard, return_index=True)
        cuts = list(zip(first.tolist(), [*first[1:].tolist(), len(shard)], strict=True))
        arrays = [x[order] for x in (n.astype(np.uint32), *keys)]
        columns = [pa.array([x[a:b].tobytes() for a, b in cuts], pa.binary()) for x in arrays]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), *columns], ["shard", "n", *["low", "high"][-len(keys) :]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                held.append(keys_of(*tokens(batch.slice(at, 500))))
                size += len(held[-1][0])
                if size >= TOKENS:
                    yield from flush(held)
                    held, size = [], 0
        if size:
            yield from flush(held)

    return run


def _merged(table: pa.Table) -> tuple[np.ndarray, ...]:
    """n and the keys of a shard's blocks together."""
    kinds = {"n": np.uint32, "low": np.uint32, "high": np.uint64}
    got = {c: np.concatenate([np.frombuffer(x.as_py(), k) for x in table.column(c)]) for c, k in kinds.items() if c in table.column_names}
    return _sum(got.pop("n").astype(np.int64), *got.values())


class Words:
    """Level 1: ids and counts of words."""

    def __init__(self, files: list[tuple[str, int]]):
        self.first = np.concatenate([[0], np.cumsum([n for _, n in files])])
        self.levels = [_opened(p) for p, _ in files]
        self.hashes = [EliasFano.inside(x, "h.") for x in self.levels]
        self.least = np.array([x["least"][0] for x in self.levels], np.uint64)

    @staticmethod
    def build(keys: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
        e = EliasFano.of(keys - keys[0], int(keys[-1] - keys[0]) + 1)
        return e.named("h.") | {"least": keys[:1], "n": n.astype(np.uint32) if n.max() < 1 << 32 else n}

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Ids of sorted hashes; -1 for words not seen."""
        out = np.full(len(h), -1, np.int64)
        cut = [*np.searchsorted(h, self.least).tolist(), len(h)]
        for i, e in enumerate(self.hashes):
            q = h[cut[i] : cut[i + 1]] - self.least[i]
            inside = q <= e.last
            at = e.find(q[inside], np.zeros(int(inside.sum()), np.int64), np.full(int(inside.sum()), e.n))
            out[cut[i] : cut[i + 1]][inside] = np.where(at >= 0, at + self.first[i], -1)
        return out

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Counts of ids in any order; 0 for -1."""
        out = np.zeros(len(ids), np.int64)
        shard = np.searchsorted(self.first, ids, side="right") - 1
        for i, x in enumerate(self.levels):
            own = shard == i
            out[own] = x["n"][ids[own] - self.first[i]]
        return out


def _quantised(x: np.ndarray, name: str) -> dict[str, np.ndarray]:
    low, high = (float(x.min()), float(x.max())) if len(x) else (0.0, 0.0)
    step = (high - low) / 255 or 1.0
    return {f"{name}.q": np.rint((x - low) / step).astype(np.uint8), f"{name}.scale": np.array([low, step])}


class Trie:
    """A shard of levels 2 and 3."""

    def __init__(self, parts: dict[str, np.ndarray]):
        self.parts = parts
        self.v, self.to_w, self.w, self.u, self.to_rank, self.rank = (EliasFano.inside(parts, k) for k in ("v.", "vw.", "w.", "u.", "uw.", "r."))
        self.words, self.widest = (int(x) for x in parts["shape"])

    @staticmethod
    def build(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: np.ndarray, words: int, p2: Callable) -> dict[str, np.ndarray]:
        """u, v, w, n: n-grams in order of v, w and u, each once; p2(v, w, n): smoothed probabilities of bigrams."""
        pair = _firsts(v, w)
        n2 = np.add.reduceat(n, pair) if len(pair) else n
        v2, w2 = v[pair], w[pair]
        first = _firsts(v2)
        contexts, begins = v2[first], np.append(first, len(v2))
        place = np.repeat(np.arange(len(contexts)), np.diff(begins))  # of each pair's context
        rank = np.arange(len(v2)) - begins[place]
        widest = int(rank.max(initial=0)) + 1
        p = p2(v2, w2, n2)
        of = np.repeat(np.arange(len(pair)), np.diff(np.append(pair, len(v))))  # pair of each n-gram
        three = np.flatnonzero(u != _NONE)
        three = three[np.argsort(place[of[three]].astype(np.uint64) << _U32 | u[three].astype(np.uint64), kind="stable")]  # by rank already
        own, u3 = of[three], u[three].astype(np.int64)
        first3 = _firsts(place[own], u3)
        begins3 = np.append(first3, len(three))
        number = np.repeat(np.arange(len(first3)), np.diff(begins3))
        parts = {"shape": np.array([words, widest], np.int64)}
        parts |= EliasFano.of(contexts, words + 2).named("v.") | EliasFano.of(begins, len(v2) + 1).named("vw.")
        parts |= EliasFano.of(place * words + w2, max(1, len(contexts)) * words + 1).named("w.")
        parts |= EliasFano.of(place[own][first3] * (words + 1) + u3[first3], max(1, len(contexts)) * (words + 1) + 1).named("u.")
        parts |= EliasFano.of(begins3, len(three) + 1).named("uw.")
        parts |= EliasFano.of(number * widest + rank[own], max(1, len(first3)) * widest + 1).named("r.")
        top = np.log10(n[three] + M3 * p[own])
        return parts | _quantised(np.log10(p), "p2") | _quantised(top, "p3") | _quantised(-np.log10(n2 + M3), "under")

    def _value(self, name: str, at: np.ndarray) -> np.ndarray:
        low, step = self.parts[f"{name}.scale"]
        return low + step * self.parts[f"{name}.q"][at]

    def ask(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 of p(w | v), of the numerator of p(w | u, v), and of one over the denominator of (v, w) as a context; NaN if not seen. They come in order of v and w."""
        out = [np.full(len(v), np.nan) for _ in range(3)]
        none = np.zeros(len(v), np.int64)
        if not self.v.n:
            return tuple(out)
        # v and w are in order, so that each context and each pair is looked up once
        first = _firsts(v)
        each = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(v))))
        at = self.v.find(v[first].astype(np.uint64), none[first], none[first] + self.v.n)
        lo, hi = np.zeros((2, len(first)), np.int64)
        found = at >= 0
        lo[found], hi[found] = self.to_w.range(at[found])
        at, lo, hi = at[each], lo[each], hi[each]
        some = np.flatnonzero(at >= 0)
        first = some[_firsts(v[some], w[some])]
        each = np.repeat(np.arange(len(first)), np.diff(np.append(np.searchsorted(some, first), len(some))))
        pair = self.w.find((at[first] * self.words + w[first]).astype(np.uint64), lo[first], hi[first])[each]
        some, pair = some[pair >= 0], pair[pair >= 0]
        at, lo = at[some], lo[some]
        out[0][some], out[2][some] = self._value("p2", pair), self._value("under", pair)
        known = np.flatnonzero((u[some] != _NONE) & (u[some] >= 0)) if self.u.n else some[:0]
        some, at, rank = some[known], at[known], (pair - lo)[known]
        before = self.u.find((at * (self.words + 1) + u[some]).astype(np.uint64), np.zeros(len(at), np.int64), np.full(len(at), self.u.n))
        some, rank, before = some[before >= 0], rank[before >= 0], before[before >= 0]
        lo, hi = self.to_rank.range(before)
        gram = self.rank.find((before * self.widest + rank).astype(np.uint64), lo, hi)
        out[1][some[gram >= 0]] = self._value("p3", gram[gram >= 0])
        return tuple(out)


def _file_system(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path)


def _saved(path: str, parts: dict[str, np.ndarray]) -> None:
    """Puts a level in place at once, so that a repeated task does no harm."""
    fs, where = _file_system(path)
    fs.create_dir(os.path.dirname(where), recursive=True)
    tmp = f"{where}.{os.urandom(8).hex()}"
    with fs.open_output_stream(tmp) as f:
        for x in packed_levels(parts):
            f.write(x)
    fs.move(tmp, where)


def _opened(path: str) -> dict[str, np.ndarray]:
    """A level, mapped."""
    fs, where = _file_system(path)
    if fs.type_name == "local":
        return load(where)
    with tempfile.NamedTemporaryFile() as copy:  # mapped, so it may go at once
        with fs.open_input_stream(where) as f:
            while block := f.read(1 << 20):
                copy.write(block)
        copy.flush()
        return load(copy.name)


class Model:
    """Where the levels are, and the totals."""

    def __init__(self, words: list[tuple[str, int]], tries: list[str | None], total: int):
        self.words, self.tries, self.total = words, tries, total
        self.size = sum(n for _, n in words)
        self._levels = None

    def __getstate__(self):
        return self.__dict__ | {"_levels": None}

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.total + self.size + 1))

    def shard(self, key: np.ndarray) -> np.ndarray:
        return (mix(key) % np.uint64(len(self.tries))).astype(np.int32)

    def score(self, batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """n_tokens, n_known, base_score, score of each text."""
        if self._levels is None:
            self._levels = Words(self.words), [t and Trie(_opened(t)) for t in self.tries]
        words, tries = self._levels
        h, bounds = tokens(batch)
        seen, back = np.unique(h, return_inverse=True)
        own = words.ids(seen)
        count = words.counts(own)
        ids, c, base = own[back], count[back], self.unigram(count)[back]
        starts = bounds[:-1]
        v, before, u = (np.empty(len(ids), np.int64) for _ in range(3))
        v[1:], before[1:], u[1:] = ids[:-1], c[:-1], v[:-1]
        v[starts], before[starts] = self.size, count[np.searchsorted(seen, _END)] if len(seen) else 0  # as many starts as ends
        u[1:] = v[:-1]
        u[starts] = _NONE
        logp = base + np.log10(M / (before + M))
        asked = np.flatnonzero((ids >= 0) & (v >= 0) & (before > 0))
        key = (v[asked].astype(np.uint64) << _U32) | ids[asked].astype(np.uint64)
        third = np.full(len(ids), np.nan)
        under = np.full(len(ids), -np.log10(M3))  # of the token's bigram as a context
        if len(tries) and len(asked):
            keys, x = _order(u[asked], key)
            x, which = np.unique(x, return_inverse=True)
            key, ask_u = keys[(x >> _U32).astype(np.int64)], (x & _LOW32).astype(np.int64)  # u: -1 is as _NONE
            ask_v, ask_w = (k.astype(np.int64) for k in (key >> _U32, key & _LOW32))
            shard = self.shard(key)
            got = np.full((3, len(key)), np.nan)
            for k in np.unique(shard).tolist():
                if tries[k] is not None:
                    mine = np.flatnonzero(shard == k)
                    got[:, mine] = tries[k].ask(ask_u[mine], ask_v[mine], ask_w[mine])
            got = got[:, which]
            for target, x in zip((logp, third, under), got, strict=True):
                hit = ~np.isnan(x)
                target[asked[hit]] = x[hit]
        later = np.ones(len(ids), bool)
        later[starts] = False
        at = np.flatnonzero(later)
        logp[at] = under[at - 1] + np.where(np.isnan(third[at]), np.log10(M3) + logp[at], third[at])
        n = np.diff(bounds)
        sums = [np.add.reduceat(x, starts) if len(n) else np.zeros(0) for x in ((c > 0).astype(np.int64), base, logp)]
        return n, *sums


def train(docs: DataFrame, learn: Column) -> Model:
    """docs: text; learn: which rows train."""
    spark = docs.sparkSession
    ship(spark)
    folder = scratch(spark, "lm")
    folder = f"file://{folder}" if folder.startswith("/") else folder.replace("file:///", "file:/").replace("file:/", "file:///")
    rows = docs.filter(learn).select("text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts, grams = max(4, -(-size // WORD_BYTES)), max(4, -(-size // GRAM_BYTES))
    kinds = "shard int, n long, total long, path string"

    def written(name: str, shard: int, levels: dict[str, np.ndarray], n: int, total: int) -> pa.Table:
        _saved(path := f"{folder}/{name}-{shard}", levels)
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([n], pa.int64()), "total": pa.array([total], pa.int64()), "path": [path]})

    def merge_words(table: pa.Table) -> pa.Table:
        n, keys = _merged(table)
        return written("words", table.column("shard")[0].as_py(), Words.build(keys, n), len(keys), int(n.sum()))

    def word_shard(h: np.ndarray) -> np.ndarray:
        return ((h >> _U32) * np.uint64(parts) >> _U32).astype(np.int32)

    blocks = rows.mapInArrow(_counted(lambda h, bounds: (h,), word_shard), "shard int, n binary, high binary")
    found = sorted(blocks.groupBy("shard").applyInArrow(merge_words, kinds).collect())  # a line for each file
    del blocks
    release(spark)
    model = Model([(r.path, r.n) for r in found], [None] * grams if found else [], sum(r.total for r in found))
    if model.size >= _NONE - 1:
        raise ValueError(f"{model.size} different words: ids have 32 bits")
    if not found:
        return model

    def keys_of(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if model._levels is None:
            model._levels = Words(model.words)
        seen, back = np.unique(h, return_inverse=True)
        ids = model._levels.ids(seen)[back].astype(np.uint64)
        v, u = np.empty(len(ids), np.uint64), np.empty(len(ids), np.uint32)
        v[1:] = ids[:-1]
        v[bounds[:-1]] = model.size
        u[1:] = v[:-1]
        u[bounds[:-1]] = _NONE
        return u, (v << _U32) | ids

    def merge_grams(table: pa.Table) -> pa.Table:
        n, u, key = _merged(table)
        v, w = (key >> _U32).astype(np.int64), (key & _LOW32).astype(np.int64)
        words = Words(model.words)

        def p2(v: np.ndarray, w: np.ndarray, n: np.ndarray) -> np.ndarray:
            before = words.counts(np.where(v == model.size, words.ids(np.array([_END], np.uint64))[0], v))
            return (n + M * 10 ** model.unigram(words.counts(w))) / (before + M)

        return written("grams", table.column("shard")[0].as_py(), Trie.build(u, v, w, n, model.size, p2), len(n), int(n.sum()))

    blocks = rows.mapInArrow(_counted(keys_of, model.shard), "shard int, n binary, low binary, high binary")
    tries = list(model.tries)
    for r in blocks.groupBy("shard").applyInArrow(merge_grams, kinds).collect():  # a line for each file
        tries[r.shard] = r.path
    del blocks
    release(spark)
    model.tries = tries
    return model


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                n, known, base, score = model.score(part)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64())], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_known long, base_score double, score double")


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held = F.coalesce(remainder(F.col("doc_id"), 7) == 2, F.lit(False))
    model = train(docs, ~held)
    return scores(docs, model).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
