"""Counters, percentiles, access scores, distinct lists and other aggregates."""

from tallyrow.plans.query import Query

#: Half-life of an access, in milliseconds.
HALF_LIFE = 259200000


def percentiles(value: str, where: str = "TRUE", names: tuple[str, str, str] = ("p50", "p75", "p95")) -> str:
    """SQL: each event type's percentiles from a histogram of two significant digits.

    A value's bucket keeps its eight highest bits; a percentile is the greatest value of its
    bucket. Buckets are counted before they are put in order, so a type has at most 128 rows
    for each doubling, however many values it has.
    """
    bucket = "(v IDIV p + 1) * p - 1"
    power = "CAST(power(2, greatest(length(bin(v)) - 8, 0)) AS BIGINT)"
    counted = f"SELECT event_type, {bucket} AS top, count(*) AS n FROM (SELECT event_type, v, {power} AS p FROM (SELECT event_type, CAST(floor({value}) AS BIGINT) AS v FROM events WHERE {where}) AS a) AS b GROUP BY event_type, {bucket}"
    upto = f"SELECT event_type, top, sum(n) OVER (PARTITION BY event_type ORDER BY top) AS upto, sum(n) OVER (PARTITION BY event_type) AS total FROM ({counted}) AS c"
    shown = ", ".join(f"min(CASE WHEN {a} * upto >= {b} * total THEN top END) AS {n}" for n, a, b in zip(names, (2, 4, 20), (1, 3, 19), strict=True))
    return f"SELECT event_type, {shown}, CAST(max(total) AS BIGINT) AS n FROM ({upto}) AS d GROUP BY event_type"


QUERIES = {
    # Each access counts one and halves with each half-life; elapsed time in whole milliseconds.
    "frecency_score": Query(f"SELECT user_id, round(sum(power(2.0, -((MICROS('2024-02-01 00:00:00') - TS_MICROS) IDIV 1000) / {HALF_LIFE}.0)), 9) AS score, count(*) AS num_accesses FROM events GROUP BY user_id".replace("MICROS('2024-02-01 00:00:00')", "1706745600000000")),
    # Increments are summed, absolute values keep the latest.
    "counters": Query("SELECT event_type, count(*) AS increments, max(CASE WHEN rn = 1 THEN value END) AS latest FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) AS e GROUP BY event_type"),
    # A02
    "histogram_percentiles": Query(percentiles("value * 100")),
    # A03
    "latency_percentiles": Query(percentiles("value * 1000000000.0", names=("p50_ns", "p75_ns", "p95_ns"))),
    # A09
    "distinct_workspaces": Query("SELECT DISTINCT c_mktsegment AS workspace FROM customer ORDER BY workspace"),
    # A10
    "pane_count": Query("SELECT c_mktsegment AS workspace, count(*) AS panes FROM customer GROUP BY c_mktsegment"),
    # P36
    "workspace_empty": Query("SELECT r.r_name AS workspace, coalesce(c.n, 0) = 0 AS is_empty FROM region r LEFT JOIN (SELECT n_regionkey, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 GROUP BY n_regionkey) c ON c.n_regionkey = r.r_regionkey"),
    # A14
    "interval_cardinality": Query("SELECT l_suppkey, CAST(sum(l_linenumber) AS BIGINT) AS values_held FROM lineitem GROUP BY l_suppkey"),
    # Most frequent first, then the greater value.
    "value_frequency": Query("SELECT p_size AS pixel, count(*) AS n FROM part WHERE p_partkey % 3 = 0 GROUP BY p_size ORDER BY n DESC, pixel DESC"),
    # Rows of the same body are aliases of the first.
    "alias_groups": Query("SELECT p_brand AS body_a, p_size AS body_b, min_by(p_name, p_partkey) AS name, count(*) - 1 AS aliases FROM part GROUP BY p_brand, p_size"),
    # Best score for each glyph, the first of equals.
    "best_alias": Query("SELECT glyph, alias, score FROM (SELECT p_brand AS glyph, p_name AS alias, p_size AS score, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS rn FROM part) AS x WHERE rn = 1"),
    # A token for each four bytes.
    "token_estimate": Query("SELECT doc_id, CAST(BYTES(text) IDIV 4 AS BIGINT) AS tokens FROM documents"),
    # Turns of a conversation from the end on, while the estimate stays within the limit.
    "context_trim": Query("SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(BYTES(text) IDIV 4) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS upto FROM conversations) AS x WHERE upto <= 3500"),
    # Dense ids of matched texts in the order first seen.
    "match_dictionary": Query("SELECT text, CAST(row_number() OVER (ORDER BY first_seen) - 1 AS BIGINT) AS match_id, n FROM (SELECT props AS text, min(event_id) AS first_seen, count(*) AS n FROM events GROUP BY props) AS x"),
    # Summed width of ASCII names.
    "width_sum": Query("SELECT p_brand, CAST(sum(length(p_name)) AS BIGINT) AS width FROM part GROUP BY p_brand"),
    # Rows changed since a sequence number, as half-open ranges.
    "dirty_ranges": Query("SELECT l_orderkey AS pane, min(l_linenumber) AS lo, max(l_linenumber) + 1 AS hi FROM (SELECT l_orderkey, l_linenumber, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS island FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey > 60) AS d) AS x GROUP BY l_orderkey, island"),
    # Metric read-outs by kind of key.
    "metric_sizes": Query(percentiles("value", "event_type LIKE '%e'")),
    "metric_latencies": Query(percentiles("value * 1000000000.0", "event_type NOT LIKE '%e'", ("p50_ns", "p75_ns", "p95_ns"))),
    # Leaves of each tree.
    "leaf_count": Query("SELECT n_regionkey AS tree, count(*) AS leaves FROM nation GROUP BY n_regionkey"),
}
