"""Intervals, zones, edges, rankings and the join-shaped lookups."""

from tallyrow.plans.query import Query

# A supplier's half-open ranges [lo, hi).
_RANGES = "(SELECT l_suppkey AS k, l_orderkey AS lo, l_orderkey + l_linenumber AS hi FROM lineitem)"
_MERGED = f"(SELECT k, min(lo) AS lo, max(hi) AS hi FROM (SELECT k, lo, hi, sum(new) OVER (PARTITION BY k ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT k, lo, hi, CASE WHEN lo <= max(hi) OVER (PARTITION BY k ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM {_RANGES} AS r) AS s) AS t GROUP BY k, island)"
# A user's events in order, as runs of one type.
_RUNS = "(SELECT user_id, event_id, event_type, ts, sum(edge) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS zone FROM (SELECT user_id, event_id, event_type, ts, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS edge FROM events) AS e)"

QUERIES = {
    # W01, U01
    "interval_coalesce": Query(f"SELECT k, lo, hi FROM {_MERGED} AS m"),
    # U02, U03, P08
    "range_pairs": Query("SELECT l_orderkey, l_linenumber, least(a, b) AS union_lo, greatest(a + 5, b + 3) AS union_hi, CASE WHEN least(a + 5, b + 3) > greatest(a, b) THEN greatest(a, b) END AS common_lo, least(a + 5, b + 3) > greatest(a, b) AS overlap FROM (SELECT l_orderkey, l_linenumber, l_partkey % 10 AS a, l_suppkey % 10 AS b FROM lineitem) AS x"),
    # What is left of a range without another, in up to two pieces.
    "range_subtract": Query("SELECT l_orderkey, l_linenumber, lo, hi FROM (SELECT l_orderkey, l_linenumber, a AS lo, least(a + 9, b) AS hi FROM (SELECT l_orderkey, l_linenumber, l_partkey % 10 AS a, l_suppkey % 10 + 2 AS b FROM lineitem) AS x UNION ALL SELECT l_orderkey, l_linenumber, greatest(a, b + 3) AS lo, a + 9 AS hi FROM (SELECT l_orderkey, l_linenumber, l_partkey % 10 AS a, l_suppkey % 10 + 2 AS b FROM lineitem) AS y) AS z WHERE lo < hi"),
    # U05
    "clip_ranges": Query(f"SELECT k, greatest(lo, 100) AS lo, least(hi, 900) AS hi FROM {_MERGED} AS m WHERE least(hi, 900) > greatest(lo, 100)"),
    # U07, A14
    "range_values": Query("SELECT l_orderkey, SERIES(CAST(1 AS BIGINT), CAST(l_linenumber AS BIGINT))) AS v FROM lineitem"),
    # P09
    "range_contains": Query(f"SELECT k, count(*) AS holding FROM {_MERGED} AS m WHERE lo <= 500 AND hi > 500 GROUP BY k"),
    # P10, X11: changed since a sequence number; 0 is always new.
    "changed_since": Query("SELECT event_id FROM events WHERE event_id = 0 OR event_id > 500"),
    # Runs of one type with their ends.
    "zones": Query(f"SELECT user_id, CAST(zone AS BIGINT) AS zone, min(event_type) AS type, min(event_id) AS first_id, count(*) AS width FROM {_RUNS} AS r GROUP BY user_id, zone"),
    # P16
    "zones_of_type": Query(f"SELECT user_id, count(DISTINCT zone) AS zones FROM {_RUNS} AS r WHERE event_type = 'click' GROUP BY user_id"),
    # Entries into a state.
    "edge_trigger": Query("SELECT user_id, event_id FROM (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) AS e WHERE event_type = 'purchase' AND (before IS NULL OR before <> 'purchase')"),
    # The last state that was recognised stays.
    "sticky_state": Query("SELECT event_id, last_value(CASE WHEN event_type IN ('click', 'purchase') THEN event_type END) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS state FROM events", "SELECT event_id, last_value(CASE WHEN event_type IN ('click', 'purchase') THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS state FROM events"),
    # When each state was entered.
    "state_since": Query(f"SELECT user_id, CAST(zone AS BIGINT) AS zone, TRUE AS entered, min(TS_MICROS) AS since_us FROM {_RUNS} AS r GROUP BY user_id, zone"),
    # The delta, or everything if the gap is too wide.
    "change_log": Query("SELECT user_id, event_id, CASE WHEN newest - 400 > 500 THEN 'repaint' ELSE 'delta' END AS mode FROM (SELECT user_id, event_id, max(event_id) OVER (PARTITION BY user_id) AS newest FROM events) AS e WHERE event_id > 400 OR newest - 400 > 500"),
    # Cells that differ between two screens.
    "screen_diff": Query("SELECT a.p_partkey AS cell, b.p_brand AS becomes FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 WHERE a.p_brand <> b.p_brand"),
    # A history without repeats in a row.
    "history_append": Query("SELECT user_id, event_id, event_type FROM (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) AS e WHERE before IS NULL OR before <> event_type"),
    # Labels go by the last place of a text, from the bottom up.
    "label_rank": Query("SELECT props, CAST(dense_rank() OVER (ORDER BY last_seen DESC) - 1 AS BIGINT) AS label FROM (SELECT props, max(event_id) AS last_seen FROM events GROUP BY props) AS x"),
    # T10
    "retention": Query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) AS e WHERE rn <= 5"),
    # Neighbours with wrap-around.
    "match_neighbours": Query("SELECT event_id, (pos - 1 + n) % n AS next_pos, (pos + 1) % n AS prior_pos FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events) AS e"),
    # Catalogue rows with a title looked up, empty if there is none.
    "catalogue": Query("SELECT c.c_custkey AS pane, n.n_name AS tab, coalesce(s.s_name, '') AS window_title FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN (SELECT s_nationkey, min(s_name) AS s_name FROM supplier GROUP BY s_nationkey) s ON s.s_nationkey = n.n_nationkey"),
    # J02, J11
    "resolve": Query("SELECT c_custkey AS pane, n_nationkey AS tab, r_regionkey AS window_id, r_name AS domain FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    # J03
    "containing": Query("SELECT r_regionkey FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_regionkey = r_regionkey AND n_name LIKE '%1%')"),
    # Commands with their scores, best first.
    "palette": Query("SELECT p_partkey, p_name, coalesce(n, 0) AS score FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey) u ON u.l_partkey = p_partkey ORDER BY score DESC, p_partkey"),
    # J05
    "resolve_version": Query("SELECT c.c_custkey, coalesce(s.s_name, n.n_name, 'none') AS version FROM customer c LEFT JOIN supplier s ON s.s_suppkey = c.c_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey"),
    # J06
    "interval_intersection": Query(f"SELECT a.k, greatest(a.lo, b.lo) AS lo, least(a.hi, b.hi) AS hi FROM {_MERGED} AS a JOIN (SELECT k - 1 AS k, lo, hi FROM {_MERGED} AS m) b ON a.k = b.k AND a.lo < b.hi AND b.lo < a.hi"),
    # The next coordinate at or after an offset.
    "next_coordinate": Query("SELECT event_id, min(later) AS coordinate FROM (SELECT event_id, min(CASE WHEN event_type = 'click' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS later FROM events) AS e GROUP BY event_id"),
    # The first value of an option wins.
    "first_option": Query("SELECT user_id, event_type AS option_name, min_by(value, event_id) AS value FROM events GROUP BY user_id, event_type"),
    # Attach and detach.
    "attach_detach": Query("SELECT c_custkey AS id, 'attach' AS change FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) UNION ALL SELECT s_suppkey AS id, 'detach' AS change FROM supplier WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49 AND l_orderkey % 7 = 0)"),
    # Upsert by key.
    "upsert": Query("SELECT user_id, max(event_id) AS event_id FROM (SELECT user_id, event_id FROM events WHERE event_id <= 500 UNION ALL SELECT user_id, event_id FROM events WHERE event_id > 500) AS e GROUP BY user_id"),
    # P35
    "windows_sorted": Query("SELECT n_nationkey FROM nation WHERE n_regionkey = 2 ORDER BY n_nationkey"),
    # Columns of a linear selection.
    "selection_columns": Query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 3 ELSE 0 END AS lo, CASE WHEN l_linenumber = 4 THEN 9 ELSE 80 END AS hi FROM lineitem WHERE l_linenumber BETWEEN 1 AND 4"),
    # The last 32768 bytes of what each conversation said.
    "rolling_window": Query("SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(BYTES(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS upto FROM conversations) AS x WHERE upto <= 32768"),
    # All sixteen combinations of modifiers.
    "modifier_combinations": Query("SELECT r_regionkey, SERIES(CAST(0 AS BIGINT), CAST(15 AS BIGINT))) AS mods FROM region"),
    # A tree in order of its paths.
    "preorder": Query("SELECT concat(CAST(r_regionkey AS STRING), '/', CAST(n_nationkey AS STRING)) AS path, CAST(row_number() OVER (ORDER BY r_regionkey, n_nationkey) AS BIGINT) AS place FROM nation JOIN region ON n_regionkey = r_regionkey"),
}
