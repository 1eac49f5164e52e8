"""Benchmark decontamination by a prefix-filtered set join of word shingles.

Native: DataFrame and SQL functions only.

A window is 13 consecutive words of a benchmark item (a shorter item is one window). A
window stands in a text only if all its shingles of five words do (of as many words as
it has, if fewer), so one shingle is a sufficient prefix: the rarest. Steps:

1. counted(): shingles are ordered by rarity, from counts of item shingles over all
   texts. Counts are summed before they are shuffled; no place or text goes with them.
2. prefixes(): each window keeps its rarest shingle as its prefix. A window of which some
   shingle was never seen is gone.
3. places(): one more pass over the texts finds the prefixes and no other shingle, with
   the words around each place. A hit gives a start; the length and position bound drops
   starts at which the window would begin before the text or end after it.
4. The window is compared word by word with the words carried along, so no text is read
   again or shuffled.

Both passes test hashes against a bitmap of BITS bits first, a constant of the plan that
doesn't grow with the benchmark; what passes is joined exactly.

Nulls: a null text or item has no words; a null id is carried (items: as null, which is
not an item). Rows with the same doc_id and text get the same result, each its own row;
items that repeat an id count once. Empty tables give no hits. Extra columns of any name
are ignored; cleaned() carries them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrow.llm.common import alnum_words, discard, documents, join_small, marked, packed, staged

WINDOW = 13
SHINGLE = 5
#: Contaminated: at least one word in so many is hit.
SHARE = 20
#: Bits of the bitmap, as a power of two.
BITS = 20

_KEY = ["doc_id", "_th"]


def _hash(words: str, start: str, k: int) -> str:
    return "xxhash64(" + ", ".join(f"get({words}, {start} + {i})" for i in range(k)) + ")"


def item_windows(bench: DataFrame) -> DataFrame:
    """item_id, win (words with a space between), wlen, k of each window of each item."""
    items = bench.select("item_id", F.expr(alnum_words("text")).alias("_w")).filter("item_id IS NOT NULL AND size(_w) > 0")
    starts = f"transform(sequence(0, greatest(size(_w) - {WINDOW}, 0)), i -> slice(_w, i + 1, {WINDOW}))"
    windows = items.select("item_id", F.explode(F.expr(starts)).alias("_v"))
    return windows.select("item_id", F.array_join("_v", " ").alias("win"), F.size("_v").alias("wlen"), F.expr(f"least(size(_v), {SHINGLE})").alias("k")).distinct()


def window_shingles(windows: DataFrame) -> DataFrame:
    """win, wlen, k, off, h: the shingles of each distinct window."""
    cases = " ".join(f"WHEN {k} THEN transform(sequence(0, wlen - {k}), i -> {_hash('_v', 'i', k)})" for k in range(1, SHINGLE + 1))
    split = windows.select("win", "wlen", "k").distinct().withColumn("_v", F.split("win", " "))
    return split.select("win", "wlen", "k", F.posexplode(F.expr(f"CASE k {cases} END")).alias("off", "h"))


def _bitmap(keys: DataFrame) -> str:
    """SQL: whether the bit of h is set. At most 2 ** (BITS - 6) words of 64 bits come to the driver, whatever the number of keys."""
    at, bit = f"shiftrightunsigned(h, {70 - BITS})", f"cast(shiftrightunsigned(h, {64 - BITS}) & 63 AS int)"
    rows = keys.groupBy(F.expr(at).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, {bit})")).alias("bits")).collect()
    words = [0] * (1 << BITS - 6)
    for r in rows:
        words[r["at"]] = r["bits"]
    return f"(get(from_json('{words}', 'array<bigint>'), cast({at} AS int)) & shiftleft(1L, {bit})) <> 0"


def _sizes(shingles: DataFrame) -> list[int]:
    return sorted(r.k for r in shingles.select("k").distinct().collect())  # at most SHINGLE values


def places(docs: DataFrame, keys: DataFrame, around: bool) -> DataFrame:
    """doc_id, _th, n_words and places: array of (k, pos, h) at which a shingle may be one of keys (k, h; staged).

    around: with lead and words, the words from WINDOW - 1 before the place, or lead if there are fewer, to WINDOW - 1 behind it.
    """
    hit, sizes = _bitmap(keys), _sizes(keys)
    more = f", least(i, {WINDOW - 1}) AS lead, slice(w, greatest(i - {WINDOW - 1}, 0) + 1, least(i, {WINDOW - 1}) + {WINDOW}) AS words" if around else ""
    each = [
        f"""transform(array(CASE WHEN size(w) >= {k} THEN transform(slice(w, 1, size(w) - {k - 1}), (x, i) -> {_hash("w", "i", k)}) ELSE cast(array() AS array<bigint>) END), hs ->
            transform(filter(CASE WHEN size(hs) > 0 THEN sequence(0, size(hs) - 1) ELSE cast(array() AS array<int>) END, i -> exists(array(hs[i]), h -> {hit})),
                      i -> struct({k} AS k, i AS pos, hs[i] AS h{more})))[0]"""
        for k in sizes or [SHINGLE]
    ]
    found = f"transform(array({alnum_words('text')}), w -> struct(size(w) AS n, concat({', '.join(each)}) AS p))[0]"
    rows = docs.select("doc_id", F.xxhash64("text").alias("_th"), F.expr(found).alias("_f"))
    return rows.select(*_KEY, F.col("_f.n").cast("long").alias("n_words"), F.col("_f.p").alias("places"))


def prefixes(docs: DataFrame, shingles: DataFrame) -> DataFrame:
    """win, wlen, k, h, off: the rarest shingle of each window of which every shingle was seen in the texts."""
    keys = staged(shingles.select("k", "h").distinct(), "item-shingles")
    # Outer: else Spark adds a filter on the size of the array, for which it is made a second time.
    seen = places(docs, keys, False).select(F.explode_outer("places").alias("p"))
    counts = staged(seen.filter("p IS NOT NULL").groupBy("p.k", "p.h").agg(F.count("*").alias("df")), "shingle-counts")
    # A count may be of a shingle that only shares a bit: it meets no item shingle here.
    ranked = shingles.join(counts, ["k", "h"], "left")
    rarest = F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "h", "off")).alias("p")
    out = staged(ranked.groupBy("win", "wlen", "k").agg(rarest).filter("p.df > 0").select("win", "wlen", "k", "p.h", "p.off"), "prefixes")
    discard(keys, counts)
    return out


def matches(docs: DataFrame, bench: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Staged: the windows of bench; doc_id, _th, n_words of each row; and doc_id, _th, start, wlen, win of each window in each text."""
    docs = docs.select("doc_id", "text")
    windows = staged(item_windows(bench), "windows")
    shingles = staged(window_shingles(windows), "shingles")
    prefix = prefixes(docs, shingles)
    rows = staged(places(docs, prefix, True), "places")
    hit = rows.select(*_KEY, "n_words", F.explode("places").alias("p")).select(*_KEY, "n_words", "p.*")
    starts = join_small(hit, prefix, ["k", "h"], "inner", salt=F.col("_th") + F.col("pos"))
    starts = starts.withColumn("start", F.col("pos") - F.col("off")).filter("start >= 0 AND start + wlen <= n_words")
    found = starts.filter(F.expr("array_join(slice(words, lead - off + 1, wlen), ' ') = win")).select(*_KEY, "n_words", "start", "wlen", "win").distinct()
    found = staged(found, "found")
    discard(shingles, prefix)
    return windows, rows, found


_COVERED = """aggregate(found, struct(cast(0 AS long) AS n, cast(0 AS long) AS upto),
  (a, x) -> struct(a.n + greatest(0L, x.start + x.wlen - greatest(cast(x.start AS long), a.upto)) AS n, greatest(a.upto, cast(x.start + x.wlen AS long)) AS upto)).n"""


def report(docs: DataFrame, bench: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Staged: doc_id, _th, n_words of each row; and doc_id, _th, n_words, n_hit, n_items, items_sha256 of the texts with windows."""
    windows, rows, found = matches(docs, bench)
    owned = join_small(found.select(*_KEY, "win").distinct(), windows.select("win", "item_id"), ["win"], "inner", salt=F.col("_th"))
    listed = owned.groupBy(*_KEY).agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    spans = found.groupBy(*_KEY, "n_words").agg(F.array_sort(F.collect_set(F.struct("start", "wlen"))).alias("found"))
    n_hit = spans.select(*_KEY, "n_words", F.expr(_COVERED).alias("n_hit"))
    joined = n_hit.alias("a").join(listed.alias("b"), F.expr("a.doc_id <=> b.doc_id AND a._th = b._th"))
    columns = ["a.doc_id", "a._th", "n_words", "n_hit", F.size("items").cast("long").alias("n_items")]
    out = staged(joined.select(*columns, F.sha2(F.array_join("items", ","), 256).alias("items_sha256")), "report")
    discard(windows, found)
    return rows, out


def decontaminate(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    rows, found = report(docs, bench)
    out = join_small(rows.select(*_KEY, "n_words"), found.drop("n_words"), _KEY, salt=F.col("_th"))
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        F.expr(f"coalesce(n_hit, 0) > 0 AND {SHARE} * coalesce(n_hit, 0) >= n_words").alias("contaminated"),
    )


def cleaned(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated. Only rows that a bitmap can't tell from contaminated ones are shuffled."""
    rows, found = report(docs, bench)
    discard(rows)
    bad = staged(found.filter(f"{SHARE} * n_hit >= n_words").select(*_KEY, F.xxhash64(*_KEY).alias("_k")), "contaminated")
    discard(found)
    keyed = docs.select(packed(docs), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_th")).withColumn("_k", F.xxhash64("_id", "_th"))
    seen = marked(keyed, bad, "_k")
    b = bad.select(F.col("_k").alias("_bk"), F.col("doc_id").alias("_bi"), F.col("_th").alias("_bt"))
    same = (F.col("_k") == F.col("_bk")) & F.col("_id").eqNullSafe(F.col("_bi")) & (F.col("_th") == F.col("_bt"))
    kept = seen.filter("_maybe").join(b, same, "left_anti").select("_doc")
    return seen.filter("NOT _maybe").select("_doc").union(kept).select("_doc.*")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
