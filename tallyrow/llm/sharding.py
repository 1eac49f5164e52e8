"""Sharding by histogram sort: exact splitters first, then one exchange.

Native: DataFrame and SQL functions only.

The key of a row is (64-bit hash of its text, doc_id), read as 16 bytes. Each round
counts the exact bytes of text in every bin of the next key byte, over all partitions
(partial sums, then at most 256 rows for each splitter still open), so the bytes below
each candidate boundary are known exactly. A splitter is settled when a boundary lies
within the tolerance of its target, and its bin is probed one byte deeper otherwise.
Boundaries between hashes are between groups of equal texts: a group stays in one shard
unless it is too heavy for the tolerance, in which case the splitter moves on into
doc_id. So one group of any size doesn't unbalance the shards.

Law: bytes. Splitters are also placed inside the shards (parts of a shard), so a shard
is sorted by several tasks; slots follow the key order.

Nulls: a null text counts 0 bytes and hashes as its own group; a null doc_id sorts with
the least one. Ids may be any long; ids of another type are ordered by their hash. Rows that agree in text and doc_id can't be told apart by a key and stay
together. Empty table: empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyrow.llm.common import documents, staged

SHARDS = 16
#: Parts of a shard, each sorted by a task of its own.
PARTS = 8
#: A splitter may lie so far from its target, as a share of a shard's bytes.
TOLERANCE = 0.004

_TOP = 1 << 63


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, _h, and _i: doc_id as a long. Staged."""
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull()).alias("_h"),
    )
    whole = docs.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long")
    number = F.col("doc_id").cast("long") if whole else F.xxhash64("doc_id")
    return staged(rows.withColumn("_i", F.coalesce(F.when(F.col("doc_id").isNotNull(), number), F.lit(-_TOP))), "keys")


def splitters(keys: DataFrame, parts: int, tolerance: float) -> list[tuple[int, int]]:
    """parts - 1 pairs (_h, _i) in order: the least keys of parts 1, 2, ...; past the last key for parts that stay empty."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    targets = [total * s // parts for s in range(1, parts)]
    settled: dict[int, tuple[int, int]] = {}
    # Of each open splitter: its bin as a prefix of the 128-bit key, and the bytes below that bin.
    open_ = {s: (0, 0) for s in range(len(targets))}
    # As unsigned numbers, in the same order.
    flipped, number = (F.col(c).bitwiseXOR(F.lit(-_TOP)) for c in ("_h", "_i"))
    for level in range(1, 17):
        shift = 8 * (8 - level) if level <= 8 else 8 * (16 - level)
        if level <= 8:
            rows = keys if level == 1 else keys.filter(F.shiftrightunsigned(flipped, shift + 8).isin([p for p, _ in set(open_.values())]))
            bins = rows.groupBy(F.shiftrightunsigned(flipped, shift).alias("p")).agg(F.sum("size").alias("n"))
            found = {r.p: r.n for r in bins.collect()}
        else:
            heads: dict[int, list[int]] = {}
            for p, _ in set(open_.values()):
                head, tail = divmod(p, 1 << 8 * (level - 9))
                heads.setdefault((head ^ _TOP) - (1 << 64) * ((head ^ _TOP) >= _TOP), []).append(tail)
            cond = F.lit(False)
            for h, tails in heads.items():
                cond |= (F.col("_h") == F.lit(h)) & (F.shiftrightunsigned(number, shift + 8).isin(tails) if level > 9 else F.lit(True))
            bins = keys.filter(cond).groupBy("_h", F.shiftrightunsigned(number, shift).alias("p")).agg(F.sum("size").alias("n"))
            found = {(((r["_h"] % (1 << 64)) ^ _TOP) << 8 * (level - 8)) + r.p % (1 << 64): r.n for r in bins.collect()}
        # shiftrightunsigned by 0 leaves the sign: prefixes are counted as unsigned.
        found = {p % (1 << 64) if level <= 8 else p: n for p, n in found.items()}
        inside: dict[int, list[tuple[int, int]]] = {}
        for p, n in sorted(found.items()):
            inside.setdefault(p >> 8, []).append((p, n))
        for s, (prefix, below) in list(open_.items()):
            target = targets[s]
            for p, n in inside.get(prefix, []):
                if below + n >= target:
                    break
                below += n
            else:
                settled[s] = _least(prefix + 1, level - 1)
                del open_[s]
                continue
            if min(target - below, below + n - target) <= tolerance or level == 16:
                settled[s] = _least(p if target - below <= below + n - target else p + 1, level)
                del open_[s]
            else:
                open_[s] = (p, below)
        if not open_:
            break
    return [settled[s] for s in sorted(settled)]


def _least(prefix: int, level: int) -> tuple[int, int]:
    """The least key with this prefix of level bytes, as signed _h and _i; past all keys if there is none."""
    key = prefix << 8 * (16 - level)
    if key >= 1 << 128:
        return (1 << 63) - 1, (1 << 63) - 1
    h, i = divmod(key, 1 << 64)
    return h - _TOP, i - _TOP


def _rank(bounds: list[tuple[int, int]]) -> Column:
    """How many of the sorted bounds are at most the row's key."""
    at = F.array(*(F.struct(F.lit(h).cast("long").alias("h"), F.lit(i).cast("long").alias("i")) for h, i in bounds))
    return F.size(F.filter(at, lambda b: (b.h < F.col("_h")) | ((b.h == F.col("_h")) & (b.i <= F.col("_i"))))) if bounds else F.lit(0)


def shard(docs: DataFrame, shards: int = SHARDS, parts: int = PARTS, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of each row of docs."""
    keys = keyed(docs)
    said = keys.agg(F.sum("size").alias("total"), F.max("size").alias("most")).first()
    # A boundary can't be nearer than half the largest row at worst, so groups aren't split for less.
    bounds = splitters(keys, shards * parts, max(tolerance * (said.total or 0) / shards, (said.most or 0) / 2))
    outer = bounds[parts - 1 :: parts]
    rows = keys.withColumn("shard", _rank(outer))
    # Within its shard a row is compared with that shard's own bounds only.
    own = [bounds[s * parts : s * parts + parts - 1] for s in range(shards)]
    part = F.lit(0)
    if bounds and parts > 1:
        part = F.coalesce(*(F.when(F.col("shard") == s, _rank(b)) for s, b in enumerate(own)))
    rows = rows.withColumn("_part", part)
    counts = rows.groupBy("shard", "_part").agg(F.count("*").alias("n")).collect()  # shards * parts rows at most
    before, starts = {}, []
    for r in sorted(counts, key=lambda r: (r.shard, r._part)):
        starts.append(F.struct(F.lit(r.shard).alias("s"), F.lit(r._part).alias("p"), F.lit(before.get(r.shard, 0)).cast("long").alias("b")))
        before[r.shard] = before.get(r.shard, 0) + r.n
    place = F.row_number().over(Window.partitionBy("shard", "_part").orderBy(F.col("_h"), F.col("_i"), F.col("size"))).cast("long") - 1
    first = F.element_at(F.filter(F.array(*starts), lambda x: (x.s == F.col("shard")) & (x.p == F.col("_part"))), 1).b if starts else F.lit(0).cast("long")
    return rows.withColumn("slot", place + first).select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), "slot")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir)).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
