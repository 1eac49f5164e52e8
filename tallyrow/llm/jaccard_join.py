"""N-gram Jaccard join by PartEnum signatures, and its connected components.

A text's set: distinct shingles of lower-cased words (64-bit hashes; three words unless
said otherwise). Two sets link when their Jaccard similarity is at least 0.9, or another
threshold g.

1. summaries(): size and a 64-bit identity of each set; texts with equal sets are one
   class, and only a representative goes on.
2. signatures(): sizes fall into bands whose ends are a factor g apart, so linked sets
   are in the same band or in neighbouring ones; each set is signed for its own band and
   the next. In a band linked sets differ in at most k elements. The domain (the range
   of hashes) is cut into n1 parts, each into N2 cells; some part has at most K2
   differences, so some choice of N2 - K2 of its cells has none: every choice is a
   signature. Choices without elements would bring unrelated sets together. So where they
   are likely there are 2 spare() parts more than needed, linked sets agree in at least
   2 spare() + 1 parts, and each set leaves out the spare() parts whose choices have fewest
   elements: one part at least is left in both.
3. shared(): signatures meet in one exchange of packed blocks. A task signs a set once
   however many copies of it it reads, and a signature that many of its sets share is
   known to be shared there: its members go straight on, dealt by set, with one mark for
   the other tasks, so a hot signature isn't collected in one task. In a block a
   signature has WIDTH bytes, and its shard stands for the others.
4. Sets that share a signature are compared exactly, but not all with all: connectivity
   is what counts. First each member with the leader of its bucket; linked sets
   are contracted to components; of the buckets that still hold more than one
   component, those of at most PAIRED members compare all pairs by sketches of SKETCH
   bits, which never differ in more bits than their sets in elements, and are done once
   the pairs that this leaves are compared, if those are no more than the members; the
   others go to other leaders; what is open then goes to remaining(), which finds
   the links across components without making all pairs of a bucket. Every pair not
   compared is in one component by then or can't be linked, so no link is lost.
   Sketches are also compared before sets are sent to their leaders.
5. components(): alternating large-star and small-star steps, in tables; at most UNITED
   edges are united by one task instead, which takes no exchange.

Staged tables are deleted once nothing reads them.

Nulls: a null text, or one without a word, has an empty set and links with nothing; a
null id is carried, and its component is the smallest id of its class. Repeated rows are
copies. An empty table gives an empty result. Extra columns are ignored;
deduplicated() carries them, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyrow.llm.bytescan import LOWER, hashes, mix, spans, texts_of
from tallyrow.llm.common import BROADCAST_ROWS, discard, documents, freeing, give_back, join_small, marked, packed, release, ship, staged, stored, trim_driver

#: Words of a shingle, and the least Jaccard similarity in hundredths.
WORDS, PERCENT = 3, 90
N2, K2 = 3, 1
#: Members' sets go to their leaders in so many parts at most, one after the other, so that their shuffle takes a part of the disk; and about how many bytes a part has where fewer parts do.
SLICES, SLICE = 4, 1 << 25
#: Edges whose components one task finds (16 bytes an edge); each step in tables takes several exchanges, however few they are.
UNITED = BROADCAST_ROWS
#: Bits of a set's sketch, a power of two: each element flips one.
SKETCH = 1 << 10
#: Rounds before remaining(): leaders, sketches of small buckets, leaders.
ROUNDS = 3
#: Members of a bucket whose sketches are all compared, and rows with sketches that a task holds for that.
PAIRED, SKETCHED = 1 << 10, 1 << 16
#: Signatures a task holds before it sends them on, and about how many make a shard; in a larger shard a set's number repeats more, and packs better.
HELD, SHARD = 1 << 18, 1 << 21
#: Bytes of a signature in a block, besides its shard; two that agree in them by chance are compared in vain.
WIDTH = 5
#: Columns of blocks.
BLOCKS = "shard int, sig binary, sid binary, flag binary, high binary"
#: A signature that so many of a task's sets share goes straight on.
HOT = 16
#: Elements of all pivots that may be broadcast.
PIVOTS = 1 << 20
#: Sets a task remembers to have signed.
SEEN = 1 << 17
#: Flags of a signature in a block: for the set's own band; its bucket is shared for certain; it is to go straight on.
OWN, MARK, STRAIGHT = 1, 2, 4

_CHOICES = list(combinations(range(N2), N2 - K2))


def _chain(h: np.ndarray, words: int) -> np.ndarray:
    """Hashes of all runs of so many words."""
    x = mix(h[: len(h) - words + 1] + np.uint64(words))
    for j in range(1, words):
        x = mix(x + h[j : len(h) - words + 1 + j])
    return x


def shingle_sets(data: memoryview, offsets: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    view = LOWER[np.frombuffer(data, np.uint8)]
    starts, ends, cut = spans(view, offsets)
    h = hashes(view, starts, ends)
    runs = _chain(h, words) if len(h) >= words else np.zeros(0, np.uint64)
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if b - a >= words:
            yield np.unique(runs[a : b - words + 1])
        else:
            yield _chain(h[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def identity(s: np.ndarray) -> int:
    return int(mix((mix(s).sum(dtype=np.uint64) + np.uint64(len(s)))[None])[0].astype(np.int64))


def bands(limit: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Last size of each band up to limit and one beyond, and the most differences in it and the one before."""
    ends, at = [], 1
    while not ends or ends[-1] < limit or len(ends) < 2:
        ends.append(at * 100 // percent)
        at = ends[-1] + 1
    ends.append(at * 100 // percent)
    return np.array(ends), np.array([2 * e * (100 - percent) // (100 + percent) for e in ends])


def spare(size: int, k: int) -> int:
    """Parts a set of a band may leave out: about twice as many as are expected to have an empty choice."""
    n1 = k // (K2 + 1) + 1
    return math.ceil(2 * n1 * len(_CHOICES) * math.exp(-0.75 * size * (N2 - K2) / (n1 * N2))) if k >= 8 else 0


def signatures(s: np.ndarray, ends: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a set, and whether each is for its own band (else for the next)."""
    sums = np.zeros(len(s) + 1, np.uint64)
    np.cumsum(mix(s), out=sums[1:])
    band, out, own = int(np.searchsorted(ends, len(s))), [], []
    for i in (band, band + 1):
        k = int(most[i])
        if k == 0:  # equal sets only
            out.append(mix(sums[-1:] + np.uint64(i + 1)))
            own.append(np.full(1, i == band))
            continue
        out_of = spare(int(ends[i]), k)
        n1 = k // (K2 + 1) + 1 + 2 * out_of
        cells = n1 * N2
        edges = np.array([(c << 64) // cells for c in range(1, cells)], np.uint64)
        at = np.concatenate([[0], np.searchsorted(s, edges), [len(s)]])
        cell = np.diff(sums[at]).reshape(n1, N2)
        kept = np.arange(n1)
        if out_of:
            size = np.diff(at).reshape(n1, N2)
            fewest = np.min([size[:, list(c)].sum(axis=1) for c in _CHOICES], axis=0)
            kept = np.sort(np.argsort(fewest, kind="stable")[out_of:])
        part = mix(np.arange(n1, dtype=np.uint64) + np.uint64(i + 1 << 32))
        for j, choice in enumerate(_CHOICES):
            x = part + np.uint64(j)
            for c in choice:
                x = mix(x + cell[:, c])
            out.append(x[kept])
            own.append(np.full(len(kept), i == band))
    return np.concatenate(out), np.concatenate(own)


def sketch(s: np.ndarray) -> np.ndarray:
    """A bit for each cell of the range of hashes, set if an odd number of elements lies there; as longs."""
    odd = np.bincount((s >> np.uint64(65 - SKETCH.bit_length())).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _summaries(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, n, sid = batch.slice(at, 500), [], []
                for s in shingle_sets(*texts_of(part, "text"), words):
                    n.append(len(s))
                    sid.append(identity(s) if len(s) else None)
                columns = [part.column("doc_id"), part.column("_th"), pa.array(n, pa.int64()), pa.array(sid, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "_th", "n_shingles", "sid"])

    return run


def _blocks(sig: np.ndarray, sid: np.ndarray, flag: np.ndarray, shard: np.ndarray, width: int) -> pa.RecordBatch:
    """A row for each shard; within it in the given order, so that a set's repeated number packs well.

    sig is cut to its low bytes, so many as width; the others are in high for what goes straight on, else the shard tells them.
    """
    order = np.argsort(shard, kind="stable")
    sig, sid, flag, shard = sig[order].astype("<u8").view(np.uint8).reshape(-1, 8), sid[order], flag[order], shard[order]
    ids, first = np.unique(shard, return_index=True)
    cuts = list(zip(first.tolist(), [*first[1:].tolist(), len(shard)], strict=True))
    columns = [pa.array(ids, pa.int32()), *(pa.array([x[a:b].tobytes() for a, b in cuts], pa.binary()) for x in (sig[:, :width], sid, flag))]
    high = pa.array([sig[a:b, width:][flag[a:b] == STRAIGHT].tobytes() for a, b in cuts], pa.binary())
    return pa.RecordBatch.from_arrays([*columns, high], ["shard", "sig", "sid", "flag", "high"])


def _flushed(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], shards: int, width: int) -> pa.RecordBatch:
    """Blocks of (sig, sid, own). Below 8 bytes, above width are the number of the shard: some signatures become equal then, but none unequal."""

    def by_sig(sig: np.ndarray) -> np.ndarray:
        return ((sig >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)

    sig, sid, own = (np.concatenate(x) for x in zip(*held, strict=True))
    shard = by_sig(sig)
    if width < 8:
        sig = shard.astype(np.uint64) << np.uint64(8 * width) | sig & np.uint64((1 << 8 * width) - 1)
    order = np.argsort(sig, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(sig[order]) != 0]))
    many = np.diff(first, append=len(sig))
    hot = np.zeros(len(sig), bool)
    hot[order] = np.repeat(many >= HOT, many)
    marks = order[first[many >= HOT]]
    cold = np.flatnonzero(~hot)
    hot = np.flatnonzero(hot)
    take = np.concatenate([cold, marks, hot])
    flag = np.concatenate([own[cold].astype(np.uint8), np.full(len(marks), MARK, np.uint8), np.full(len(hot), STRAIGHT, np.uint8)])
    shard = np.concatenate([shard[cold], shard[marks], by_sig(mix(sid[hot].view(np.uint64)))])
    return _blocks(sig[take], sid[take], flag, shard, width)


def _signed(words: int, percent: int, shards: int):
    """Signatures of a task's sets as blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, most = bands(1000, percent)
        held, size, seen = [], 0, set()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                for s in shingle_sets(*texts_of(batch.slice(at, 500), "text"), words):
                    if not len(s) or (sid := identity(s)) in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(sid)
                    if len(s) > ends[-3]:
                        ends, most = bands(2 * len(s), percent)
                    sig, own = signatures(s, ends, most)
                    held.append((sig, np.full(len(sig), sid), own))
                    size += len(sig)
                    if size >= HELD:
                        yield _flushed(held, shards, WIDTH)
                        held, size = [], 0
                        give_back()
        if held:
            yield _flushed(held, shards, WIDTH)

    return run


def _placed(shards: int):
    """Elements e of the codes of a task's sets as blocks; sig is a hash of g, coded and the element, odd if coded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                g, sid, coded = (part.column(c).to_numpy(zero_copy_only=False) for c in ("g", "sid", "coded"))
                n = part.column("e").value_lengths().to_numpy(zero_copy_only=False)
                own = mix(mix(g.view(np.uint64)) + coded.astype(np.uint64))
                sig = mix(part.column("e").flatten().to_numpy(zero_copy_only=False).view(np.uint64) + np.repeat(own, n))
                sig = sig & ~np.uint64(1) | np.repeat(coded.astype(np.uint64), n)
                held.append((sig, np.repeat(sid, n), np.ones(len(sig), bool)))
                size += len(sig)
                if size >= HELD:
                    yield _flushed(held, shards, 8)
                    held, size = [], 0
                    give_back()
        if size:
            yield _flushed(held, shards, 8)

    return run


def _shared(table: pa.Table) -> pa.Table:
    """Of a shard: sig, sid of the signatures that several sets have, one of them for its own band."""
    give_back()  # what the shard before took
    low, sid, flag, high = (
        np.concatenate([np.frombuffer(x.as_py(), kind) for x in table.column(c)])
        for c, kind in (("sig", np.uint8), ("sid", np.int64), ("flag", np.uint8), ("high", np.uint8))
    )
    straight, width = flag == STRAIGHT, len(low) // len(flag)
    sig = np.zeros((len(flag), 8), np.uint8)
    sig[:, :width] = low.reshape(-1, width)
    sig[straight, width:] = high.reshape(np.count_nonzero(straight), 8 - width)
    sig = sig.view("<u8").ravel()
    if width < 8:
        sig[~straight] |= np.uint64(table.column("shard")[0].as_py() << 8 * width)
    out = [(sig[straight], sid[straight])]
    sig, sid, flag = sig[~straight], sid[~straight], flag[~straight]
    if len(sig):
        order = np.lexsort((sid, sig))
        sig, sid, flag = sig[order], sid[order], flag[order]
        first = np.flatnonzero(np.concatenate([[True], np.diff(sig) != 0]))
        many = np.diff(first, append=len(sig))
        flags = np.bitwise_or.reduceat(flag, first)
        live = ((sid[first] != sid[first + many - 1]) & (flags & OWN > 0)) | (flags & MARK > 0)
        new = np.concatenate([[True], (np.diff(sig) != 0) | (np.diff(sid) != 0)])
        keep = np.repeat(live, many) & new & (flag & MARK == 0)
        out.append((sig[keep], sid[keep]))
    sig, sid = (np.concatenate(x) for x in zip(*out, strict=True))
    return pa.table({"sig": pa.array(sig.view(np.int64)), "sid": pa.array(sid)})


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                got = list(shingle_sets(*texts_of(batch.slice(at, 500), "text"), words))
                flat = np.concatenate([np.zeros(0, np.uint64), *got]).astype(np.int64)
                bounds = np.concatenate([[0], np.cumsum([len(s) for s in got])])
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat))
                own = np.concatenate([np.zeros(0, np.int64), *map(sketch, got)])
                bits = pa.ListArray.from_arrays(pa.array(np.arange(len(got) + 1) * (SKETCH // 64), pa.int32()), pa.array(own))
                yield pa.RecordBatch.from_arrays([pa.array([identity(s) for s in got], pa.int64()), lists, bits], ["sid", "s", "k"])

    return run


def _by_sketch(percent: int):
    """Of whole buckets: the pairs (sid, y) across components that sketches and sizes leave; for a bucket that has more of them than members, its members instead (sig, sid, n; y null)."""

    def run(table: pa.Table) -> pa.Table:
        sig, sid, n, comp = (table.column(c).to_numpy() for c in ("sig", "sid", "n", "comp"))
        bits = table.column("k").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, SKETCH // 64)
        order = np.lexsort((sid, sig))
        order = order[np.concatenate([[True], (np.diff(sig[order]) != 0) | (np.diff(sid[order]) != 0)])]
        out, left = [np.zeros((2, 0), np.int64)], [order[:0]]
        for own in np.split(order, np.flatnonzero(np.diff(sig[order])) + 1):
            size, c = n[own], comp[own]
            fits = 100 * size[:, None] >= percent * size[None, :]
            i, j = np.nonzero(np.triu(fits & fits.T & (c[:, None] != c[None, :]), 1))
            found = []
            for at in range(0, len(i), 1 << 14):
                a, b = own[i[at : at + (1 << 14)]], own[j[at : at + (1 << 14)]]
                differ = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64)
                may = (100 + percent) * differ <= (100 - percent) * (n[a] + n[b])
                found.append(np.stack([sid[a[may]], sid[b[may]]]))
            if sum(x.shape[1] for x in found) > len(own):
                left.append(own)
            else:
                out += found
        pairs, rest = np.concatenate(out, axis=1), np.concatenate(left)
        none = np.arange(pairs.shape[1] + len(rest)) < pairs.shape[1]  # of pairs
        fill = np.zeros(pairs.shape[1], np.int64)
        columns = [
            pa.array(np.concatenate([fill, sig[rest]]), mask=none),
            pa.array(np.concatenate([pairs[0], sid[rest]])),
            pa.array(np.concatenate([pairs[1], np.zeros(len(rest), np.int64)]), mask=~none),
            pa.array(np.concatenate([fill, n[rest]]), mask=none),
        ]
        return pa.table(columns, names=["sig", "sid", "y", "n"])

    return run


def united(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges (a, b) but the least of each component, and that least node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while (root[u] != root[v]).any():
        least = np.minimum(root[u], root[v])
        for x in (u, v):
            np.minimum.at(root, root[x], least)
        while (root[root] != root).any():
            root = root[root]
    rest = root != np.arange(len(nodes))
    return nodes[rest], nodes[root[rest]]


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [np.zeros((2, 0), np.int64), *(np.stack([batch.column(c).to_numpy() for c in ("u", "v")]) for batch in batches)]
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in united(*np.concatenate(held, axis=1))], ["node", "comp"])


def components(edges: DataFrame) -> DataFrame:
    """node, comp (its component's least node) of edges (a, b), a != b; staged.

    The least neighbours are staged before they are joined, so that each side of the join
    has an exchange of its own and a hub's edges can be split.
    """
    edges = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star")
    if edges.count() <= UNITED:
        out = staged(edges.coalesce(1).mapInArrow(freeing(_united), "node long, comp long"), "star")
        discard(edges)
        return out
    seen = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = staged(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "star-least")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = staged(large.filter("u != v").distinct(), "star-large")
        low = staged(large.groupBy("u").agg(F.min("v").alias("m")), "star-low")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low).filter("u != v")
        old, edges = edges, staged(small.distinct(), "star")
        discard(old, least, large, low)
        trim_driver(edges.sparkSession)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            out = edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
            out.staged_at = edges.staged_at
            return out
        seen = now


def remaining(open_: DataFrame, links: DataFrame | None, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b), staged, that join the components left in the buckets open_ (sig, sid, n, comp, _a: the bucket's least comp).

    The table sets is deleted once those of the buckets are copied. Buckets that share a
    component form a group, and one member of it is the pivot p. A
    set x is coded by its difference from p, E(x). Two sets differ in
    |E(x)| + |E(y)| - 2 |E(x) & E(y)| elements, so with W(x) = (100 + percent) |E(x)| -
    (100 - percent) |x| they link just when 2 (100 + percent) |E(x) & E(y)| >= W(x) + W(y).

    - A pair with W(x) + W(y) <= 0 links; then both link to the member of least W too.
      Those links are made, one for each member, and all others lie within their component.
    - x is near if p holds percent of its elements or more. Any other pair of near sets
      shares at least (W(x) + W(y)) / 2 (100 + percent) elements of its codes.
    - A pair with a set that isn't near shares elements outside p: at least percent of x,
      less those of x in p.

    In both cases elements are ordered by rarity in the group, only the prefixes that this
    number leaves are joined, and the positions of the shared element bound what can
    follow. Members of a large group of copies that are near but under the threshold
    differ from p by edits of their own, which no other member has: they make no pair.
    """
    d, made = 2 * (100 + percent), []

    def keep(df: DataFrame, name: str) -> DataFrame:
        made.append(staged(df, name))
        return made[-1]

    groups = components(open_.filter("comp != _a").select(F.col("comp").alias("a"), F.col("_a").alias("b")))
    members = keep(open_.select("sid", "n", "comp").distinct(), "members")
    members = join_small(members, groups.withColumnRenamed("node", "_c").withColumnRenamed("comp", "g").withColumnRenamed("_c", "comp"), ["comp"])
    members = keep(members.withColumn("g", F.coalesce("g", "comp")), "members")
    if links is not None:
        degree = links.select(F.explode(F.array("a", "b")).alias("sid")).groupBy("sid").agg(F.count("*").alias("deg"))
        ranked = members.join(degree, "sid", "left")
    else:
        ranked = members.withColumn("deg", F.lit(0))
    pivots = ranked.groupBy("g").agg(F.max(F.struct(F.coalesce("deg", F.lit(0)).alias("deg"), "sid")).alias("p")).select("g", F.col("p.sid").alias("sid"))
    # In parts, so that their shuffle takes a part of the disk; then the table of all sets has had its last use.
    parts = []
    for k in range(SLICES):
        own = members.filter(F.pmod(F.xxhash64("sid"), F.lit(SLICES)) == k)
        parts.append(keep(own.join(_these(sets, own).hint("merge"), "sid").dropDuplicates(["sid"]), "open-sets"))
        release(members.sparkSession)
    discard(sets)
    sets = parts[0]
    for x in parts[1:]:
        sets = sets.union(x)
    # Pivots are few, so their sets are found without an exchange of all of them.
    chosen = keep(pivots, "chosen")
    pivots = keep(join_small(sets.select("sid", "s"), chosen, ["sid"], "inner", salt=F.col("sid"), salts=1).select("g", F.col("s").alias("p")), "pivots")
    # The pivots are broadcast if all their elements together are few.
    small = (pivots.agg(F.sum(F.size("p"))).first()[0] or 0) <= PIVOTS
    coded = join_small(sets, pivots, ["g"], "inner", salt=F.col("sid"), limit=BROADCAST_ROWS if small else 0)
    coded = coded.select("g", "sid", "n", "comp", F.array_except("s", "p").alias("a"), F.array_except("p", "s").alias("r")).withColumn("na", F.size("a").cast("long"))
    coded = coded.withColumn("w", (100 + percent) * (F.col("na") + F.size("r")) - (100 - percent) * F.col("n")).withColumn("near", 100 * (F.col("n") - F.col("na")) >= percent * F.col("n"))
    coded = keep(coded, "coded")

    least = keep(coded.groupBy("g").agg(F.min(F.struct("w", "sid", "comp")).alias("z")).select("g", F.col("z.w").alias("w0"), F.col("z.sid").alias("s0"), F.col("z.comp").alias("c0")), "least")
    each = join_small(coded.drop("a", "r"), least, ["g"], "inner", salt=F.col("sid"))
    sure = keep(each.filter("comp != c0 AND w + w0 <= 0").select(F.least("sid", "s0").alias("a"), F.greatest("sid", "s0").alias("b")), "sure")
    inner = each.filter("comp = c0 OR w + w0 <= 0").select("comp", F.lit(True).alias("inside")).distinct()
    placed = join_small(each, keep(inner, "inner"), ["comp"], salt=F.col("sid")).withColumn("inside", F.coalesce("inside", F.lit(False)))
    placed = keep(placed, "placed")
    outside = keep(placed.filter("near AND NOT inside").groupBy("g").agg(F.min("w").alias("w1")), "outside")
    placed = join_small(placed, outside, ["g"], salt=F.col("sid"))

    ne = F.expr(f"(w + {100 - percent} * n) div {100 + percent}")  # size of the code
    left_after = lambda other: F.col("ne") + 1 - F.greatest(F.lit(1), F.expr(f"cast(ceil((w + {other}) / {d}D) as bigint)"))
    placed = keep(placed.withColumn("ne", ne).withColumn("p1", F.when(F.col("near"), left_after("w1"))), "placed")
    partner = keep(placed.filter("inside AND p1 > 0").groupBy("g").agg(F.min("w").alias("w2")), "partners")  # of those inside that can have one
    placed = join_small(placed, partner, ["g"], salt=F.col("sid")).withColumn("p0", F.when(F.col("inside") | F.col("w2").isNull(), F.col("p1")).otherwise(left_after("w2")))
    beyond = F.col("na") + 1 - F.greatest(F.lit(1), F.expr(f"({percent} * n + 99) div 100 - (n - na)"))
    placed = placed.withColumn("p0", F.coalesce(F.greatest("p0", "p1"), F.lit(0))).withColumn("pa", beyond).withColumn("c", F.col("n") - F.col("na"))
    placed = keep(placed.filter("p0 > 0 OR pa > 0").select("sid", "n", "w", "ne", "na", "c", "near", "inside", "p0", "p1", "pa", F.when(F.col("inside"), F.col("c0")).otherwise(F.col("comp")).alias("label")), "placed")
    discard(*parts, pivots)
    release(sets.sparkSession)
    # Codes are needed of near sets with a prefix, elements outside p only in groups that have a set that isn't near.
    prefixed = keep(placed.filter("p0 > 0").select(F.xxhash64("sid").alias("_k")), "prefixed")
    near = marked(coded.filter("near").withColumn("_k", F.xxhash64("sid")), prefixed, "_k").filter("_maybe")
    far = keep(coded.filter("NOT near").select("g").distinct(), "far")
    mixed = join_small(coded, far, ["g"], "inner", salt=F.col("sid"))
    # Elements meet once, as packed hashes; what goes on is those that several sets of the group have.
    codes = near.select("g", "sid", F.lit(True).alias("coded"), F.concat("a", "r").alias("e")).union(mixed.select("g", "sid", F.lit(False).alias("coded"), F.col("a").alias("e")))
    shards = max(4, math.ceil((coded.agg(F.sum(2 * F.col("na") + F.size("r"))).first()[0] or 0) / SHARD))
    elements = keep(codes.mapInArrow(freeing(_placed(shards)), BLOCKS).groupBy("shard").applyInArrow(_shared, "sig long, sid long").withColumnRenamed("sig", "e"), "elements")
    release(elements.sparkSession)
    common = elements.groupBy("e").agg(F.count("*").alias("df"))
    elements = elements.withColumn("coded", F.col("e").bitwiseAND(F.lit(1)) != 0)
    own = Window.partitionBy("sid", "coded")
    seen = elements.join(common.hint("merge"), "e").withColumn("k", F.row_number().over(own.orderBy("df", "e"))).withColumn("all", F.count("*").over(own))
    prefix = seen.join(placed, "sid").withColumn("i", F.expr("if(coded, ne, na) - all + k")).filter("i <= if(coded, p0, pa)")
    prefix = keep(prefix.select("coded", "e", "sid", "n", "w", "c", "near", "inside", "label", F.expr("if(coded, ne, na) - i").alias("rest"), F.expr("coded AND i <= p1").alias("short")), "prefix")
    release(prefix.sparkSession)
    of = ("sid", "n", "w", "c", "near", "inside", "label", "rest", "short")
    x = prefix.filter("if(coded, NOT inside, NOT near)").select("coded", "e", *(F.col(c).alias(f"{c}x") for c in of))
    y = prefix.select("coded", "e", *(F.col(c).alias(f"{c}y") for c in of))
    may = F.expr(f"""labelx != labely AND 100 * least(nx, ny) >= {percent} * greatest(nx, ny) AND if(coded,
        (insidey OR (sidx < sidy AND shortx AND shorty)) AND {d} * (1 + least(restx, resty)) >= wx + wy,
        (neary OR sidx < sidy) AND {100 + percent} * (1 + least(restx, resty) + least(cx, cy)) >= {percent} * (nx + ny))""")
    pairs = keep(x.join(y, ["coded", "e"]).filter(may).select("sidx", "sidy").distinct(), "pairs")
    release(pairs.sparkSession)
    coded = coded.select("sid", "w", F.concat("a", "r").alias("s"))
    needed = marked(coded.withColumn("_k", F.xxhash64("sid")), pairs.select(F.explode(F.array(F.xxhash64("sidx"), F.xxhash64("sidy"))).alias("_k")), "_k")
    coded = needed.filter("_maybe").select("sid", "w", F.col("s").alias("e"))
    one = pairs.join(coded.select(F.col("sid").alias("sidx"), F.col("e").alias("ex"), F.col("w").alias("wx")), "sidx")
    two = one.join(coded.select(F.col("sid").alias("sidy"), F.col("e").alias("ey"), F.col("w").alias("wy")), "sidy")
    found = two.filter(d * F.size(F.array_intersect("ex", "ey")) >= F.col("wx") + F.col("wy")).select(F.least("sidx", "sidy").alias("a"), F.greatest("sidx", "sidy").alias("b"))
    out = staged(sure.union(found), "links")
    discard(groups, *made)
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, _th (hash of the text) and _k (hash of both)."""
    rows = docs.select("doc_id", "text").withColumn("_th", F.xxhash64("text"))
    return rows.withColumn("_k", F.xxhash64("doc_id", "_th"))


def _these(sets: DataFrame, sids: DataFrame) -> DataFrame:
    """The rows of sets that may be among sids (staged)."""
    keys = sids.select(F.xxhash64("sid").alias("_k"))
    return marked(sets.withColumn("_k", F.xxhash64("sid")), keys, "_k").filter("_maybe").select("sid", "s")


def _likely(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (sid, y, n, ny) whose sketches differ in no more bits than linked sets may in elements."""
    one, two = sketches.select("sid", F.col("k").alias("k1")), sketches.select(F.col("sid").alias("y"), F.col("k").alias("k2"))
    differ = F.expr(" + ".join(f"bit_count(k1[{i}] ^ k2[{i}])" for i in range(SKETCH // 64)))
    both = pairs.join(one.hint("merge"), "sid").join(two.hint("merge"), "y")
    return both.filter((100 + percent) * differ <= (100 - percent) * (F.col("n") + F.col("ny"))).select("sid", "y")


def led(open_: DataFrame, sets: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Links (a, b), staged, of the buckets' members sid with their leaders y."""
    fits = 100 * F.least("n", "ny") >= percent * F.greatest("n", "ny")
    pairs = open_.filter((F.col("comp") != F.col("cy")) & fits).select("sid", "y", "n", "ny").distinct()
    return _linked(staged(_likely(pairs, sketches, percent), "pairs"), sets, percent)


def paired(open_: DataFrame, sets: DataFrame, sketches: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) of the buckets (sig, sid, n, comp, m: rows of the bucket) in which sketches leave few pairs; and sig, sid, n of the other buckets; staged."""
    small = open_.filter(F.col("m") <= PAIRED).select("sig", "sid", "n", "comp")
    shards = max(4, math.ceil(small.count() / SKETCHED))
    bits = small.join(sketches.hint("merge"), "sid").withColumn("shard", F.pmod(F.xxhash64("sig"), F.lit(shards)))
    seen = staged(bits.groupBy("shard").applyInArrow(_by_sketch(percent), "sig long, sid long, y long, n long"), "compared")
    release(open_.sparkSession)
    pairs = staged(seen.filter("y IS NOT NULL").select("sid", "y").distinct(), "pairs")
    rest = staged(open_.filter(F.col("m") > PAIRED).select("sig", "sid", "n").union(seen.filter("y IS NULL").select("sig", "sid", "n")), "live")
    discard(seen)
    return _linked(pairs, sets, percent), rest


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b), staged, of pairs (sid, y; staged, deleted here), by their sets."""
    made, size = [], stored(sets)
    size += size * pairs.count() // max(1, sets.count())  # a set goes to its leader once for each pair
    slices = min(SLICES, size // SLICE + 1)
    for k in range(slices):
        own = pairs.filter(F.pmod(F.xxhash64("y"), F.lit(slices)) == k)
        leaders = _these(sets, own.select(F.col("y").alias("sid"))).select(F.col("sid").alias("y"), F.col("s").alias("sy"))
        # Merged at every size: sets are too large to be broadcast on all but small tables.
        both = own.join(_these(sets, own).hint("merge"), "sid").join(leaders.hint("merge"), "y").withColumn("i", F.size(F.array_intersect("s", "sy")))
        both = both.filter(100 * F.col("i") >= percent * (F.size("s") + F.size("sy") - F.col("i")))
        made.append(staged(both.select(F.least("sid", "y").alias("a"), F.greatest("sid", "y").alias("b")), "links"))
        release(sets.sparkSession)
    out = made[0]
    for x in made[1:]:
        out = out.union(x)
    if slices > 1:
        out = staged(out, "links")
        discard(*made)
    discard(pairs)
    return out


def shared(texts: DataFrame, reps: DataFrame, words: int, percent: int) -> DataFrame:
    """sig, sid, n of the signatures that several classes share, staged."""
    total = reps.agg(F.sum("n")).first()[0] or 0
    expected = total * 6.4 * (100 - percent) / (100 + percent)
    shards = max(4, math.ceil(expected / SHARD))
    blocks = texts.select("text").mapInArrow(freeing(_signed(words, percent, shards)), BLOCKS)
    live = staged(blocks.groupBy("shard").applyInArrow(_shared, "sig long, sid long"), "shared")
    release(texts.sparkSession)
    out = staged(live.join(reps.select("sid", "n"), "sid"), "live")
    discard(live)
    release(texts.sparkSession)
    return out


def classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Summaries (doc_id, _th, n_shingles, sid), staged; and sid, component_id of the classes that hold several rows or are linked, staged."""
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = _keyed(docs)
    rows = texts.select("doc_id", "text", "_th").mapInArrow(freeing(_summaries(words)), f"doc_id {kind}, _th long, n_shingles long, sid long")
    rows = staged(rows, "summaries")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_th")).alias("r")
    reps = rows.filter("sid IS NOT NULL").groupBy("sid")
    reps = staged(reps.agg(first, F.min("doc_id").alias("least"), F.count("*").alias("rows"), F.min("n_shingles").alias("n")), "classes")
    live = shared(texts, reps, words, percent)
    # The sets of these classes, each from the text of its representative; a set may be there more than once, or not needed.
    wanted = live.select("sid").distinct().join(reps, "sid").select("r.doc_id", "r._th")
    wanted = staged(wanted.select(F.xxhash64("doc_id", "_th").alias("_k")), "wanted")
    sets = marked(texts, wanted, "_k").filter("_maybe").select("text").mapInArrow(freeing(_sets(words)), "sid long, s array<long>, k array<long>")
    sets = staged(sets, "sets")
    sketches = staged(sets.select("sid", "k").dropDuplicates(["sid"]), "sketches")
    discard(wanted)

    links = comp = None
    held = []
    for step in range(ROUNDS + 1):
        open_ = live.withColumn("comp", F.col("sid"))
        if comp is not None:
            open_ = live.join(comp, live.sid == comp.node, "left").select("sig", "sid", "n", F.coalesce("comp", "sid").alias("comp"))
        order = F.xxhash64("sid", F.lit(step))
        bucket = open_.groupBy("sig").agg(F.min("comp").alias("_a"), F.max("comp").alias("_b"), F.count("*").alias("m"), F.min(F.struct(order, "sid", "n", "comp")).alias("l"))
        bucket = bucket.filter("_a != _b").select("sig", "_a", "m", F.col("l.sid").alias("y"), F.col("l.n").alias("ny"), F.col("l.comp").alias("cy"))
        bucket = staged(bucket, "leaders")
        if bucket.isEmpty():
            discard(bucket)
            break
        # Of mixed buckets. In a round of leaders those don't stay, as all their pairs are compared.
        old, live = live, staged(open_.join(bucket, "sig").select("sig", "sid", "n", "comp", "_a", "m", "y", "ny", "cy"), "live")
        discard(old, bucket)
        rest = live.filter("sid != y").select("sig", "sid", "n")
        rest.staged_at = live.staged_at
        if step == ROUNDS:
            new = remaining(live.select("sig", "sid", "n", "comp", "_a"), links, sets, percent)
        elif step == 1:
            new, rest = paired(live, sets, sketches, percent)
        else:
            new = led(live, sets, sketches, percent)
        held.append(new)
        release(spark)
        if not new.isEmpty():
            links = new if links is None else links.union(new)
            discard(comp)
            comp = components(links)
        if rest.staged_at != live.staged_at:
            discard(live)
        live = rest
    discard(live, sets, sketches, *held)
    release(spark)
    several = reps.select("sid", "least", "rows")
    if comp is None:
        found = staged(several.filter("rows > 1").select("sid", F.col("least").alias("component_id")), "components")
    else:
        member = several.join(comp, several.sid == comp.node, "left").withColumn("c", F.coalesce("comp", "sid"))
        linked = comp.select(F.col("comp").alias("c")).distinct().withColumn("linked", F.lit(True))
        member = staged(member.join(linked, "c", "left").filter("rows > 1 OR linked").select("sid", "c", "least"), "members")
        label = staged(member.groupBy("c").agg(F.min("least").alias("component_id")), "labels")
        found = staged(member.join(label, "c").select("sid", "component_id"), "components")
        discard(member, label, comp)
    discard(reps)
    return rows, found


def _labelled(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with the component_id of their class, null for a class of one row without links."""
    return join_small(rows, found, ["sid"], salt=F.col("_th") + F.coalesce(F.hash("doc_id"), F.lit(0)))


def jaccard_join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs."""
    out = _labelled(*classes(docs, words, percent))
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def deduplicated(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component: one with the smallest doc_id.

    Rows with an empty set stay, as do those of a component without any doc_id. Rows that
    can't be among the ones to go are told by a bitmap and not shuffled.
    """
    rows, found = classes(docs, words, percent)
    several = _labelled(rows, found).filter("component_id IS NOT NULL")
    # A row of the smallest id stays; of several such rows the one of least hash.
    own = several.groupBy("sid", "component_id", "doc_id", "_th").agg(F.count("*").alias("n"))
    own = staged(own.withColumn("first", F.expr("coalesce(doc_id = component_id, false)")), "members")
    keeper = own.filter("first").groupBy("component_id").agg(F.min("_th").alias("keeps"))
    acts = own.join(keeper, "component_id").withColumn("stays", F.expr("first AND _th = keeps")).filter("NOT stays OR n > 1")
    acts = acts.groupBy("doc_id", "_th").agg(F.max("stays").alias("stays")).withColumn("_k", F.xxhash64("doc_id", "_th"))
    acts = staged(acts, "dropped")
    discard(own, rows, found)
    keyed = docs.select(packed(docs), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_th")).withColumn("_k", F.xxhash64("_id", "_th"))
    seen = marked(keyed, acts, "_k")
    a = acts.select(F.col("_k").alias("_ak"), F.col("doc_id").alias("_ai"), F.col("_th").alias("_at"), "stays")
    same = (F.col("_k") == F.col("_ak")) & F.col("_id").eqNullSafe(F.col("_ai")) & F.col("_th").eqNullSafe(F.col("_at"))
    asked = seen.filter("_maybe").join(a, same, "left")
    kept = asked.filter("stays IS NULL").select("_doc").union(asked.filter("stays").dropDuplicates(["_k"]).select("_doc"))
    return seen.filter("NOT _maybe").select("_doc").union(kept).select("_doc.*")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(documents(spark, sf_dir))
