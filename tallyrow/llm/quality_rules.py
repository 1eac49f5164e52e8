"""Quality rules with thresholds that adapt to each language and source.

Native: DataFrame and SQL functions only.

1. base(): counts of each whole text, in one projection without a shuffle.
2. sketches(): per (lang, source) and metric a log-linear histogram of 16 steps per
   doubling. It is a quantile sketch of relative error 1/16 whose merge is the sum of
   its buckets, so partial sketches combine before the shuffle and coarser levels
   (language, everything) are merges of the finer ones. Integers only, hence the same
   on every run and cluster.
3. fences(): quartiles from the sketches; a value beyond q3 + 3 * spread (for the word
   length also q1 - 3 * spread) is out, spread being the quartile distance, with a floor
   so that a uniform source doesn't reject its own ordinary texts.
4. verdicts(): the fences joined to the rows, which are then kept or rejected.

Nulls: a null text has no words (so it fails the base rule); null lang and null source
are groups of their own; null ids are carried. Repeated rows each get their own result.
An empty table gives an empty result. Extra columns of any name are ignored here;
filtered() carries them unchanged. Windows of three words are compared by a 64-bit hash
within one text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrow.llm.common import discard, documents, join_small, marked, packed, space_words, staged

#: A group of fewer texts uses its language's sketch, a language of fewer the overall one.
LEAST = 100
#: Fences lie so many spreads beyond the quartiles.
REACH = 3
#: Metrics as integers, with the least spread of each: characters per 100 words, and symbols, repeated lines and repeated words per 1000.
SPREADS = {"m_len": 100, "m_sym": 100, "m_dup": 200, "m_rep": 130}

_METRICS = {
    "m_len": "100 * word_chars div n_words",
    "m_sym": "1000 * n_symbols div n_words",
    "m_dup": "1000 * n_dup_lines div n_lines",
    "m_rep": "1000 * n_repeat_words div n_words",
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]

# Starts of the three-word windows that occur twice: each window's hash and place packed
# in one long (36 and 28 bits), sorted as plain longs; neighbours with the same 36 bits
# are compared by the whole hash.
_REPEATED = """
transform(array(transform(sequence(0, size(_w) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2]))), h ->
  CASE WHEN size(array_distinct(h)) = size(h) THEN 0L ELSE
    transform(array(sort_array(transform(h, (x, i) -> shiftleft(shiftrightunsigned(x, 28), 28) | i))), s ->
      transform(array(filter(s, (p, j) -> (p ^ get(s, j - 1)) BETWEEN 0L AND 268435455L OR (p ^ get(s, j + 1)) BETWEEN 0L AND 268435455L)), t ->
        transform(array(sort_array(transform(filter(t, (p, j) ->
              exists(array(j - 2, j - 1, j + 1, j + 2), k -> h[cast(get(t, k) & 268435455L AS int)] = h[cast(p & 268435455L AS int)])), p -> p & 268435455L))), r ->
          aggregate(transform(r, (x, j) -> CASE WHEN j = size(r) - 1 THEN 3L ELSE least(3L, r[j + 1] - x) END), 0L, (a, x) -> a + x))[0])[0])[0]
  END)[0]
"""


def base(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with the counts of each text; the columns in COUNTS must not be taken."""
    rows = rows.withColumn("_w", F.expr(space_words(text))).withColumn("_l", F.expr(f"filter(split(coalesce({text}, ''), '\\n'), x -> x RLIKE '[^\\\\x20\\\\x09-\\\\x0D]')"))
    return rows.select(
        *(c for c in rows.columns if c not in ("_w", "_l")),
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.expr(f"cast(octet_length(regexp_replace(coalesce({text}, ''), '[^#*$%&|<>]+', '')) AS long)").alias("n_symbols"),
        F.expr("cast(size(_l) - size(array_distinct(_l)) AS long)").alias("n_dup_lines"),
        F.expr(f"CASE WHEN size(_w) < 4 THEN 0L ELSE {_REPEATED} END").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
    )


def with_metrics(counted: DataFrame) -> DataFrame:
    failed = F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    return counted.withColumn("base_failed", failed).withColumns({k: F.expr(f"CASE WHEN NOT base_failed THEN {v} END") for k, v in _METRICS.items()})


def _bucket(v: str) -> str:
    e = f"(length(bin({v})) - 5)"
    return f"CASE WHEN {v} < 32 THEN {v} ELSE {e} * 16 + shiftright({v}, {e}) END"


def sketches(metrics: DataFrame) -> DataFrame:
    """lang, source, metric, bucket, n over the texts that pass the base rule."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.expr(_bucket(m)).cast("int").alias("bucket")) for m in _METRICS)))
    return metrics.filter("NOT base_failed").select("lang", "source", each.alias("x")).groupBy("lang", "source", "x.metric", "x.bucket").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame) -> DataFrame:
    """lang, source, and lo_ and hi_ of each metric."""
    spark = sketch.sparkSession
    value = "CASE WHEN bucket < 32 THEN bucket ELSE shiftleft(16 + bucket % 16, bucket div 16 - 1) END"
    quartiles = lambda keys, tag: f"""
      SELECT {keys} metric, max(total) AS n_{tag},
             min(CASE WHEN 4 * upto >= total THEN {value} END) AS a_{tag}, min(CASE WHEN 4 * upto >= 3 * total THEN {value} END) AS b_{tag}
      FROM (SELECT {keys} metric, bucket, sum(n) OVER (PARTITION BY {keys} metric ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {keys} metric) AS total
            FROM (SELECT {keys} metric, bucket, sum(n) AS n FROM {{sketch}} GROUP BY {keys} metric, bucket))
      GROUP BY {keys} metric"""  # noqa: E731
    floor = "CASE metric " + " ".join(f"WHEN '{m}' THEN {s}" for m, s in SPREADS.items()) + " END"
    level = lambda q: f"CASE WHEN n_s >= {LEAST} THEN {q}_s WHEN n_l >= {LEAST} THEN {q}_l ELSE {q}_a END"
    return spark.sql(f"""
      WITH s AS ({quartiles("lang, source,", "s")}), l AS ({quartiles("lang,", "l")}), a AS ({quartiles("", "a")}),
      q AS (SELECT s.lang, s.source, s.metric, {level("a")} AS a, {level("b")} AS b
            FROM s JOIN l ON s.lang <=> l.lang AND s.metric = l.metric JOIN a ON s.metric = a.metric)
      SELECT lang, source, {", ".join(f"max(CASE WHEN metric = '{m}' THEN a - {REACH} * greatest(b - a, {floor}) END) AS lo_{m}, max(CASE WHEN metric = '{m}' THEN b + {REACH} * greatest(b - a, {floor}) END) AS hi_{m}" for m in SPREADS)}
      FROM q GROUP BY lang, source""", sketch=sketch)


def verdicts(metrics: DataFrame, bounds: DataFrame, salt: str) -> DataFrame:
    """metrics with kept, by the joined fences; bounds: staged."""
    out = " OR ".join([*(f"{m} > hi_{m}" for m in SPREADS), "m_len < lo_m_len"])
    joined = join_small(metrics, bounds, ["lang", "source"], salt=F.col(salt))
    return joined.withColumn("kept", F.expr(f"NOT base_failed AND NOT coalesce({out}, false)"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, the metrics, base_failed and kept of each row."""
    rows = docs.select("doc_id", "text", "lang", "source")
    metrics = staged(with_metrics(base(rows).drop("text")), "quality")
    bounds = staged(fences(sketches(metrics)), "fences")
    return verdicts(metrics, bounds, "doc_id")


def filtered(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with docs' columns.

    Only the metrics are staged. Rows that a bitmap can't tell from rejected ones are
    compared with these, and no other row is shuffled.
    """
    key = ["doc_id", "_th", "lang", "source"]
    rows = docs.select("doc_id", F.col("text").alias("_text"), F.xxhash64("text").alias("_th"), "lang", "source")
    metrics = staged(with_metrics(base(rows, "_text").drop("_text")), "quality")
    bounds = staged(fences(sketches(metrics)), "fences")
    bad = verdicts(metrics, bounds, "_th").filter("NOT kept").select(*key).distinct().withColumn("_k", F.xxhash64(*key))
    bad = staged(bad, "rejected")
    discard(metrics, bounds)
    own = [F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_th"), F.col("lang").alias("_lang"), F.col("source").alias("_source")]
    keyed = docs.select(packed(docs), *own).withColumn("_k", F.xxhash64("_id", "_th", "_lang", "_source"))
    seen = marked(keyed, bad, "_k")
    b = bad.select(*(F.col(c).alias(f"_b{i}") for i, c in enumerate(["_k", *key])))
    same = F.col("_k") == F.col("_b0")
    for i, c in enumerate(("_id", "_th", "_lang", "_source"), 1):
        same &= F.col(c).eqNullSafe(F.col(f"_b{i}"))
    kept = seen.filter("_maybe").join(b, same, "left_anti").select("_doc")
    return seen.filter("NOT _maybe").select("_doc").union(kept).select("_doc.*")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = ["doc_id", *COUNTS[:5], "base_failed", "kept"]
    return quality_rules(documents(spark, sf_dir)).select(*keep)
