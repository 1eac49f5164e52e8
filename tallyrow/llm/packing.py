"""Packing by lexical retrieval: each seed document's window is filled with its BM25 neighbours.

Document frequencies and the mean length are those of all documents. A shard of about
SHARD_BYTES of text is one group, and documents are routed so that BM25 neighbours meet:

1. A tree of hyperplanes is grown over a sample of BM25 vectors (random projections to
   DIMS numbers); its leaves have about half a shard of text each.
2. Texts that share a band of minima over SHINGLE successive ids go to the leaf of the
   least of them, so near copies aren't parted by a plane they lie close to.
3. Neighbouring leaves are put together to shards; a leaf above SHARD_BYTES is dealt over
   several by a hash, near copies together unless they alone are half a shard.

A shard builds its own inverted BM25 index over token ids, then takes the first unused
document as seed, asks the index for unused neighbours with all of the seed's terms, and
fills the window greedily in order of score. The document that overruns a window is cut
there and its rest is the next seed, so that only the last window of a shard has padding.

Routing is approximate: a neighbour in another shard isn't seen. The README has its recall.

A shard holds a bounded number of bytes besides its largest document, whatever the size
of the table.

Nulls: a null text is empty and has the end id alone; a null id is carried. Repeated
rows are packed as documents of their own. An empty table gives no pieces. A document
longer than a window fills several. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrow.llm.bytescan import texts_of
from tallyrow.llm.common import documents, freeing, give_back, join_small, ship, staged, trim_executors
from tallyrow.llm.tokens import END, crc, default_path, encoder, forget

WINDOW = 4096
SHARD_BYTES = 2 << 20
K1, B = 1.2, 0.75
DIMS = 64
#: Documents whose ids are worked on at a time.
FEW = 256
#: Documents of the sample for each leaf of the tree, and at most.
LEAF_SAMPLE, SAMPLE = 16, 1 << 16
#: Bands of two minima each, over so many successive ids.
BANDS, SHINGLE = 4, 5
_MIX = np.random.default_rng(11).integers(0, 1 << 63, (BANDS, 2), np.uint64) * np.uint64(2) + np.uint64(1)

_planes: dict[int, np.ndarray] = {}


def _slices(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indexes starts[0], starts[0] + 1, ... of each slice in turn."""
    stop = np.cumsum(sizes)
    return np.repeat(starts - (stop - sizes), sizes) + np.arange(stop[-1] if len(stop) else 0)


def idf(df: np.ndarray, n: int) -> np.ndarray:
    return np.log1p((n - df + 0.5) / (df + 0.5))


class Index:
    """Inverted BM25 index of a shard, weighed by the document frequencies, number and mean length of all documents."""

    def __init__(self, ids: np.ndarray, bounds: np.ndarray, df: np.ndarray, docs: int, mean: float):
        n, length = len(bounds) - 1, np.diff(bounds)
        doc = np.repeat(np.arange(n, dtype=np.int64), length)
        pair, tf = np.unique((ids.astype(np.int64) << 32) | doc, return_counts=True)  # sorted by term, then document
        self.doc, term = (pair & 0xFFFFFFFF).astype(np.int32), pair >> 32
        new = np.flatnonzero(np.diff(term, prepend=-1))
        self.terms, self.first, self.size = term[new], new, np.diff(new, append=len(term))
        self.n = n
        norm = K1 * (1 - B + B * length[self.doc] / max(1.0, mean))
        self.weight = np.repeat(idf(df[self.terms], docs), self.size) * tf * (K1 + 1) / (tf + norm)
        # The other way round: the terms of a document.
        order = np.argsort(self.doc, kind="stable")
        self.own = np.repeat(np.arange(len(new)), self.size)[order]
        self.own_bounds = np.concatenate([[0], np.cumsum(np.bincount(self.doc, minlength=n))])

    def scores(self, seed: int) -> np.ndarray:
        rows = self.own[self.own_bounds[seed] : self.own_bounds[seed + 1]]
        at = _slices(self.first[rows], self.size[rows])
        return np.bincount(self.doc[at], self.weight[at], self.n)


def pack_shard(ids: np.ndarray, bounds: np.ndarray, window: int, df: np.ndarray, docs: int, mean: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start in it, length, sequence, offset) of a shard."""
    n, length = len(bounds) - 1, np.diff(bounds)
    index = Index(ids, bounds, df, docs, mean)
    unused = np.ones(n, bool)
    pieces, seq, filled = [], 0, 0
    waiting, done, next_ = -1, 0, 0  # the document being placed, its ids placed so far, the first that may be unused

    def place(doc: int, start: int) -> int:
        """Puts as much of doc as fits; returns its start afterwards."""
        nonlocal seq, filled
        size = min(int(length[doc]) - start, window - filled)
        pieces.append((doc, start, size, seq, filled))
        filled += size
        if filled == window:
            seq, filled = seq + 1, 0
        return start + size

    while True:
        if waiting < 0:
            while next_ < n and not unused[next_]:
                next_ += 1
            if next_ == n:
                return pieces
            waiting, done = next_, 0
            unused[waiting] = False
        while done < length[waiting]:
            done = place(waiting, done)
        seed, waiting = waiting, -1
        if filled:
            score = np.where(unused, index.scores(seed), -1.0)
            for doc in np.argsort(-score, kind="stable").tolist():
                if not unused[doc]:
                    break
                unused[doc] = False
                at, before = place(doc, 0), seq
                if filled == 0:
                    if at < length[doc]:
                        waiting, done = doc, at
                    break


def terms_of(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different ids of each document in order, how often each stands there, and where each document's begin."""
    n = len(bounds) - 1
    key = np.sort(np.repeat(np.arange(n, dtype=np.uint64) << np.uint64(32), np.diff(bounds)) | ids.astype(np.uint64))
    new = np.flatnonzero(np.diff(key, prepend=np.uint64((1 << 64) - 1)))
    term, doc = (key[new] & np.uint64(0xFFFFFFFF)).astype(np.int64), (key[new] >> np.uint64(32)).astype(np.int64)
    return term, np.diff(new, append=len(key)), np.searchsorted(doc, np.arange(n + 1))


def vectors(term: np.ndarray, tf: np.ndarray, begins: np.ndarray, weight: np.ndarray, mean: float, length: np.ndarray) -> np.ndarray:
    """Projected BM25 vectors of length 1; weight: the idf of each id."""
    v = len(weight)
    if v not in _planes:
        _planes[v] = np.random.default_rng(5).standard_normal((v, DIMS), np.float32)
    norm = np.repeat(K1 * (1 - B + B * length / max(1.0, mean)), np.diff(begins))
    w = (weight[term] * tf * (K1 + 1) / (tf + norm)).astype(np.float32)
    out = np.zeros((len(begins) - 1, DIMS), np.float32)
    for i, (a, b) in enumerate(zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)):
        out[i] = w[a:b] @ _planes[v][term[a:b]]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


class Tree:
    """Halves a sample by planes across its widest direction until a part has at most `most` of its bytes."""

    def __init__(self, points: np.ndarray, size: np.ndarray, most: float):
        self.normal, self.cut, self.below, self.leaves = [], [], [], 0
        self.root = self._grow(points, size, np.arange(len(points)), most)
        self.normal = np.array(self.normal, np.float32).reshape(-1, DIMS)
        self.cut, self.below = np.array(self.cut, np.float32), np.array(self.below, np.int64).reshape(-1, 2)

    def _grow(self, points: np.ndarray, size: np.ndarray, own: np.ndarray, most: float) -> int:
        """A node, or -1 - its number for a leaf."""
        if len(own) >= LEAF_SAMPLE // 2 and size[own].sum() > most:
            x = points[own] - points[own].mean(0)
            direction = np.random.default_rng(len(own)).standard_normal(DIMS).astype(np.float32)
            for _ in range(12):
                direction = x.T @ (x @ direction)
                direction /= max(float(np.linalg.norm(direction)), 1e-30)
            at = points[own] @ direction
            cut = np.median(at)
            low = at < cut
            if 0.1 < low.mean() < 0.9:
                me = len(self.normal)
                self.normal.append(direction)
                self.cut.append(cut)
                self.below.append(None)
                self.below[me] = (self._grow(points, size, own[low], most), self._grow(points, size, own[~low], most))
                return me
        self.leaves += 1
        return -self.leaves

    def leaf(self, points: np.ndarray) -> np.ndarray:
        node = np.full(len(points), self.root, np.int64)
        while len(open_ := np.flatnonzero(node >= 0)):
            at = node[open_]
            high = (points[open_] * self.normal[at]).sum(1) >= self.cut[at]
            node[open_] = self.below[at, high.astype(np.int64)]
        return -1 - node


def bands(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A list of BANDS hashes for each document of SHINGLE ids at least, else an empty one."""
    n, length = len(bounds) - 1, np.diff(bounds)
    out = np.zeros((n, BANDS), np.uint64)
    long = np.flatnonzero(length >= SHINGLE)
    if len(long):
        h = np.zeros(len(ids) - SHINGLE + 1, np.uint64)
        for k in range(SHINGLE):
            h = (h ^ ids[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        # From each start to the last shingle inside the document: every second slice.
        cuts = np.stack([bounds[long], np.minimum(bounds[long + 1] - SHINGLE + 1, len(h))], 1).ravel()
        cuts = cuts[:-1] if cuts[-1] == len(h) else cuts
        for k in range(BANDS):
            one, two = (np.minimum.reduceat(h * m, cuts)[::2] for m in _MIX[k])
            out[long, k] = (one * np.uint64(0xBF58476D1CE4E5B9)) ^ (two >> np.uint64(7)) ^ np.uint64(k)
    sizes = np.where(length >= SHINGLE, BANDS, 0)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(out[length >= SHINGLE].ravel().view(np.int64)))


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    values = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int64) * values.itemsize), pa.py_buffer(values)]).cast(pa.binary())


def _unbinary(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    c = column.cast(pa.large_binary())
    _, offsets, data = c.buffers()
    offsets = np.frombuffer(offsets, np.int64)[c.offset : c.offset + len(c) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(kind), (offsets - offsets[0]) // kind.itemsize


def _kind(path: str, end: int) -> tuple[int, np.dtype]:
    """Number of ids, and how an id is kept."""
    n = max(encoder(path).model.get_vocab_size(), end + 1)
    return n, np.dtype("<u2" if n <= 1 << 16 else "<u4")


def _few(batches):
    """Slices of some documents, so that arrays of their ids stay small."""
    for batch in batches:
        for at in range(0, len(batch), FEW):
            yield batch.slice(at, FEW)


def grow(rows: DataFrame, path: str, end: int, count: int, total: int, shard_bytes: int) -> tuple[Tree, np.ndarray, float]:
    """The tree, and the idf and mean length of its sample."""
    leaves = max(1, -(-2 * total // shard_bytes))
    share = min(1.0, min(LEAF_SAMPLE * leaves, SAMPLE) / max(1, count))
    n, _ = _kind(path, end)

    def run(batches):
        for batch in _few(batches):
            ids, bounds = encoder(path).encode_batch(*texts_of(batch, "text"), end)
            term, tf, begins = terms_of(ids, bounds)
            yield pa.RecordBatch.from_pydict({"size": batch.column("size"), "length": np.diff(bounds), "term": _binary(term.astype("<u4"), begins), "tf": _binary(tf.astype("<u4"), begins)})

    chosen = rows.filter(F.pmod(F.xxhash64("_h"), F.lit(1 << 20)) < int(share * (1 << 20))) if leaves > 1 else rows.limit(0)
    # At most SAMPLE documents, and of each only its different ids.
    got = chosen.mapInArrow(freeing(run), "size long, length long, term binary, tf binary").toArrow().combine_chunks()
    if not len(got):
        return Tree(np.zeros((0, DIMS), np.float32), np.zeros(0), 1), np.zeros(n), 1.0
    term, begins = _unbinary(got["term"].combine_chunks(), np.dtype("<u4"))
    tf, _ = _unbinary(got["tf"].combine_chunks(), np.dtype("<u4"))
    length, size = got["length"].to_numpy(), got["size"].to_numpy()
    weight = idf(np.bincount(term, minlength=n), len(got))
    return Tree(vectors(term.astype(np.int64), tf, begins, weight, length.mean(), length), size, size.sum() * shard_bytes / 2 / total), weight, float(length.mean())


def _encode(path: str, end: int, tree: Tree, weight: np.ndarray, mean: float):
    def run(batches):
        kind = _kind(path, end)[1]
        for batch in _few(batches):
            ids, bounds = encoder(path).encode_batch(*texts_of(batch, "text"), end)
            leaf = tree.leaf(vectors(*terms_of(ids, bounds), weight, mean, np.diff(bounds))) if tree.leaves > 1 else np.zeros(len(batch), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_h"), batch.column("size"), pa.array(leaf), bands(ids, bounds), _binary(ids.astype(kind), bounds)], ["doc_id", "_h", "size", "leaf", "bands", "ids"])

    return run


def frequencies(coded: DataFrame, path: str, end: int) -> tuple[np.ndarray, int, float]:
    """In how many of all documents each id stands, their number and mean length."""
    n, kind = _kind(path, end)

    def run(batches):
        # All texts are encoded; a worker needs neither again.
        forget()
        _planes.clear()
        df, docs, length = np.zeros(n, np.int64), 0, 0
        for batch in _few(batches):
            ids, bounds = _unbinary(batch.column("ids"), kind)
            df += np.bincount(terms_of(ids, bounds)[0], minlength=n)
            docs, length = docs + len(batch), length + len(ids)
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"t": np.concatenate([[-1, -2], seen]), "n": np.concatenate([[docs, length], df[seen]])})

    # A row for each id, whatever the input.
    got = coded.select("ids").mapInArrow(freeing(run), "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    by = dict(zip(got["t"].to_pylist(), got["n"].to_pylist(), strict=True))
    docs, length = by.pop(-1, 0), by.pop(-2, 0)
    df = np.zeros(n, np.int64)
    df[list(by)] = list(by.values())
    return df, docs, length / max(1, docs)


def route(coded: DataFrame, leaves: int, shard_bytes: int) -> DataFrame:
    """coded with its _shard."""
    spark = coded.sparkSession
    own = coded.select("_h", "size", "leaf", F.explode("bands").alias("band"))
    led = staged(own.groupBy("band").agg(F.min(F.struct("_h", "leaf")).alias("to"), F.count("*").alias("n")).filter("n > 1").select("band", "to"), "packing-bands")
    moved = join_small(own, led, ["band"], "inner", salt=F.col("_h")).groupBy("_h").agg(F.min("to").alias("to"), F.max("size").alias("size")).filter("to._h <> _h")
    moved = staged(moved.select("_h", "size", F.col("to._h").alias("key"), F.col("to.leaf").alias("to_leaf")), "packing-moved")
    # At most two rows for each shard.
    large = moved.groupBy("key").agg(F.sum("size").alias("all")).filter(F.col("all") > shard_bytes // 2)
    moved = staged(join_small(moved, large, ["key"]).select("_h", F.when(F.col("all").isNull(), F.col("key")).alias("key"), "to_leaf"), "packing-keys")
    placed = join_small(coded, moved, ["_h"], salt=F.col("_h")).withColumn("leaf", F.coalesce("to_leaf", "leaf")).withColumn("key", F.coalesce("key", "_h"))
    size = {r.leaf: r.n for r in placed.groupBy("leaf").agg(F.sum("size").alias("n")).collect()}
    table, first, filled = [], 0, 0
    for leaf in range(leaves):
        own_size = size.get(leaf, 0)
        if filled and filled + own_size > shard_bytes:
            first, filled = first + 1, 0
        parts = max(1, -(-own_size // shard_bytes))
        table.append((leaf, first, parts))
        first, filled = (first + parts, 0) if parts > 1 else (first, filled + own_size)
    shards = spark.createDataFrame(table, "leaf long, first long, parts long")
    return placed.join(F.broadcast(shards), "leaf").withColumn("_shard", F.col("first") + F.pmod(F.xxhash64("key"), F.col("parts")))


def _pack(path: str, window: int, end: int, with_ids: bool, df: np.ndarray, docs: int, mean: float):
    kind = _kind(path, end)[1]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("_h", "ascending")]).combine_chunks()
        batch = table.to_batches()[0]
        shard = batch.column("_shard")[0].as_py()
        ids, bounds = _unbinary(batch.column("ids"), kind)
        ids = ids.astype(np.uint32)
        pieces = pack_shard(ids, bounds, window, df, docs, mean)
        doc, start, size, seq, offset = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
        at = bounds[doc] + start
        spans = [ids[a:b] for a, b in zip(at.tolist(), (at + size).tolist(), strict=True)]
        columns = {"doc_id": batch.column("doc_id").take(pa.array(doc)), "start": start, "length": size, "ids_crc32": np.array([crc(x) for x in spans], np.int64), "doc_tokens": np.diff(bounds)[doc], "sequence_id": (shard << 32) + seq, "offset": offset}
        if with_ids:
            columns["ids"] = pa.array([x.view(np.int32) for x in spans], pa.list_(pa.int32()))
        give_back()
        return pa.table(columns)

    return run


def coded(docs: DataFrame, path: str, shard_bytes: int, end: int) -> tuple[DataFrame, int]:
    """doc_id, _h, size, leaf, bands, ids of each document, staged, and the number of leaves."""
    rows = docs.select("doc_id", "text").withColumn("_h", F.xxhash64("doc_id", "text")).withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    said = rows.agg(F.count("*").alias("n"), F.sum("size").alias("total")).first()
    tree, weight, mean = grow(rows, path, end, said.n, said.total or 0, shard_bytes)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, _h long, size long, leaf long, bands array<long>, ids binary"
    return staged(rows.mapInArrow(freeing(_encode(path, end, tree, weight, mean)), schema), "packing-ids"), tree.leaves


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, shard_bytes: int = SHARD_BYTES, end: int = END, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece, and ids if wanted."""
    path = tokenizer or default_path()
    ship(docs.sparkSession)
    texts, leaves = coded(docs, path, shard_bytes, end)
    run = _pack(path, window, end, with_ids, *frequencies(texts, path, end))
    trim_executors(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return route(texts, leaves, shard_bytes).select("doc_id", "_h", "_shard", "ids").groupBy("_shard").applyInArrow(run, schema)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
