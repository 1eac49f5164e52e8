"""Navigation, lookups between zones and panes, labels and pages of matches, trees and read-outs."""

from tallyrow.operators.ordered import _MERGED, _RUNS
from tallyrow.plans.query import Query

# Panes of a screen: three in each row, tiled; the one of least key is active.
_PANES = "(SELECT c_nationkey AS tab, c_custkey AS idx, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) % 3 * 81 AS lft, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) IDIV 3 * 25 AS top, 80 AS width, 24 AS height, CAST(abs(c_acctbal) AS BIGINT) % 5 AS recency FROM customer)"
_TOUCHES = {
    "right": "p.lft = a.lft + a.width + 1 AND {tall}",
    "left": "p.lft + p.width + 1 = a.lft AND {tall}",
    "up": "p.top + p.height + 1 = a.top AND {wide}",
    "down": "a.top + a.height + 1 = p.top AND {wide}",
}
_TALL = "least(a.top + a.height, p.top + p.height) > greatest(a.top, p.top)"
_WIDE = "least(a.lft + a.width, p.lft + p.width) > greatest(a.lft, p.lft)"


def neighbour(direction: str) -> str:
    """SQL: the pane that touches a pane's edge: of the highest score, the later one if equal."""
    touches = _TOUCHES[direction].format(tall=_TALL, wide=_WIDE)
    return f"SELECT tab, idx, '{direction}' AS direction, target FROM (SELECT a.tab, a.idx, p.idx AS target, row_number() OVER (PARTITION BY a.tab, a.idx ORDER BY p.recency DESC, p.idx DESC) AS rn FROM {_PANES} a JOIN {_PANES} p ON p.tab = a.tab AND {touches}) AS x WHERE rn = 1"


# Zones of a user's events as rows of (start, end) places.
_PLACED = "(SELECT user_id, zone, min(event_type) AS type, min(place) AS lo, max(place) AS hi FROM (SELECT user_id, zone, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS place FROM %s AS r) AS q GROUP BY user_id, zone)" % _RUNS
# Ranges of two sets for each supplier: orders of even lines and of odd ones.
_TWO = "(SELECT l_suppkey AS k, l_orderkey AS lo, l_orderkey + 20 AS hi, l_linenumber % 2 AS side FROM lineitem)"
# Matches of a search: every event of one type, in order of its row.
_FOUND = "(SELECT user_id, event_id AS y, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE event_type = 'click')"
_CELLS = "(SELECT user_id, CAST(event_id % 7 AS INT) AS start_x, CAST(event_id IDIV 7 AS INT) AS start_y, event_type AS text FROM events)"

QUERIES = {
    # One set without another, by a sweep over the ends of both: where the first holds and the second doesn't.
    "interval_difference": Query(
        f"""SELECT k, lo, hi FROM (
          SELECT k, x AS lo, lead(x) OVER (PARTITION BY k ORDER BY x) AS hi, sum(da) OVER (PARTITION BY k ORDER BY x) AS a, sum(db) OVER (PARTITION BY k ORDER BY x) AS b
          FROM (SELECT k, x, sum(da) AS da, sum(db) AS db FROM (
            SELECT k, lo AS x, CASE WHEN side = 0 THEN 1 ELSE 0 END AS da, side AS db FROM {_TWO} AS p
            UNION ALL SELECT k, hi AS x, CASE WHEN side = 0 THEN -1 ELSE 0 END AS da, -side AS db FROM {_TWO} AS q) AS e GROUP BY k, x) AS s) AS t
        WHERE a > 0 AND b <= 0 AND lo < hi"""
    ),
    # A range taken out of every set.
    "interval_remove": Query(f"SELECT k, lo, hi FROM (SELECT k, lo, least(hi, 400) AS hi FROM {_MERGED} AS m UNION ALL SELECT k, greatest(lo, 600) AS lo, hi FROM {_MERGED} AS n) AS x WHERE lo < hi"),
    # Ranges added without being merged.
    "interval_append": Query("SELECT l_suppkey AS k, l_orderkey AS lo, l_orderkey + l_linenumber AS hi FROM lineitem WHERE l_linenumber = 1 UNION ALL SELECT l_suppkey AS k, l_orderkey AS lo, l_orderkey + l_linenumber AS hi FROM lineitem WHERE l_linenumber = 2"),
    # A range of stable rows as physical ones, of a screen that holds rows 100 to 999: off the top the first, off the bottom the last ones.
    "stable_range": Query(
        """SELECT lo, hi, CASE WHEN lo < 100 THEN 0 WHEN hi - 1 > 999 THEN greatest(900 - (hi - lo), 0) ELSE lo - 100 END AS phys_lo,
          CASE WHEN lo < 100 THEN least(hi - lo, 900) WHEN hi - 1 > 999 THEN 900 ELSE hi - 100 END AS phys_hi
        FROM (SELECT DISTINCT o_orderkey AS lo, o_orderkey + 40 AS hi FROM orders) AS r"""
    ),
    # The columns of each row that a rectangle, or a run of text, selects.
    "selection_rectangle": Query(
        """SELECT y, rectangular, CASE WHEN rectangular THEN least(x0, x1) WHEN y = y0 THEN x0 ELSE 0 END AS lo,
          CASE WHEN rectangular THEN greatest(x0, x1) + 1 WHEN y = y1 THEN x1 + 1 ELSE 9223372036854775807 END AS hi
        FROM (SELECT l_orderkey + l_linenumber AS y, l_orderkey AS y0, l_orderkey + 5 AS y1, l_partkey % 80 AS x0, l_suppkey % 80 AS x1, l_linenumber % 2 = 0 AS rectangular FROM lineitem) AS s WHERE y BETWEEN y0 AND y1"""
    ),
    # The zone that holds a place.
    "zone_at": Query(f"SELECT z.user_id, z.zone, z.type FROM {_PLACED} AS z WHERE z.lo <= 10 AND z.hi >= 10"),
    # From a place on, the second click zone after the insertion point.
    "zone_navigation": Query(f"SELECT user_id, lo AS place FROM (SELECT user_id, lo, type, row_number() OVER (PARTITION BY user_id ORDER BY lo) AS n FROM {_PLACED} AS z WHERE type = 'click' AND lo > (SELECT min(w.lo) FROM {_PLACED} AS w WHERE w.lo >= 5)) AS x WHERE n = 2"),
    # The zone that each selected place stands in.
    "zone_around": Query(f"SELECT z.user_id, s.place, z.lo, z.hi FROM (SELECT user_id, count(*) IDIV 2 AS place FROM events GROUP BY user_id) s JOIN {_PLACED} AS z ON z.user_id = s.user_id AND s.place BETWEEN z.lo AND z.hi"),
    # Neighbours in all four directions.
    "pane_neighbours": Query(" UNION ALL ".join(neighbour(d) for d in _TOUCHES)),
    # The first value of an option wins, except that one option collects its values.
    "option_values": Query(
        """SELECT user_id, event_type AS option_name, CASE WHEN event_type = 'signup' THEN TEXTAGG(CAST(event_id AS STRING); ' '; event_id) ELSE CAST(min(event_id) AS STRING) END AS value FROM events GROUP BY user_id, event_type"""
    ),
    # Different match ids in order.
    "distinct_matches": Query("SELECT DISTINCT CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS BIGINT) AS match_id FROM events ORDER BY match_id"),
    # Results in order of their place.
    "result_order": Query(f"SELECT user_id, start_y, start_x, text, CAST(row_number() OVER (PARTITION BY user_id ORDER BY start_y, start_x, text) AS BIGINT) AS place FROM {_CELLS} AS c"),
    # The first match in the page above a viewport at row 500 of 200 rows, else one step; the first beyond the page, else the last.
    "next_match_page": Query(f"SELECT user_id, coalesce(min(CASE WHEN y > 300 AND y < 500 THEN pos END), greatest(max(CASE WHEN y <= 500 THEN pos ELSE 0 END) - 1, 0)) AS goes_to FROM {_FOUND} AS f GROUP BY user_id"),
    "prior_match_page": Query(f"SELECT user_id, coalesce(min(CASE WHEN y >= 700 THEN pos END), least(max(CASE WHEN y <= 500 THEN pos ELSE 0 END), max(n) - 1)) AS goes_to FROM {_FOUND} AS f GROUP BY user_id"),
    # Of the links that cover a cell the longest wins, the first of equals; a cell that has a link keeps it.
    "cell_links": Query(
        """SELECT k, cell, link FROM (SELECT c.k, c.cell, CASE WHEN c.cell % 10 = 0 THEN 'own' ELSE m.link END AS link, row_number() OVER (PARTITION BY c.k, c.cell ORDER BY m.hi - m.lo DESC, m.lo) AS rn
          FROM (SELECT DISTINCT l_suppkey AS k, l_partkey % 60 AS cell FROM lineitem) c
          JOIN (SELECT l_suppkey AS k, l_orderkey % 60 AS lo, l_orderkey % 60 + l_linenumber * 3 AS hi, CAST(min(l_orderkey) AS STRING) AS link FROM lineitem WHERE l_quantity > 45 GROUP BY l_suppkey, l_orderkey % 60, l_linenumber) m
          ON m.k = c.k AND c.cell >= m.lo AND c.cell < m.hi) AS x WHERE rn = 1"""
    ),
    # Connected clients; P37: a variable of each pane; P39: whether a feature is there.
    "client_list": Query("SELECT c_custkey AS client, c_name AS name, c_mktsegment AS workspace FROM customer ORDER BY client"),
    "user_vars": Query("SELECT event_id, map('type', event_type, 'user', CAST(user_id AS STRING))['type'] AS type_var FROM events", "SELECT event_id, map(['type', 'user'], [event_type, CAST(user_id AS STRING)])['type'] AS type_var FROM events"),
    "has_feature": Query("SELECT p_partkey, array_contains(array('Brand#11', 'Brand#12', 'Brand#13'), p_brand) AS has FROM part", "SELECT p_partkey, list_contains(['Brand#11', 'Brand#12', 'Brand#13'], p_brand) AS has FROM part"),
    # The different names below each root of a tree.
    "tree_names": Query(
        """WITH RECURSIVE walk(root, kind, id, name) AS (
          SELECT r_regionkey, 0, CAST(r_regionkey AS BIGINT), r_name FROM region
          UNION ALL
          SELECT w.root, w.kind + 1, c.id, c.name FROM walk w JOIN (
            SELECT 1 AS kind, CAST(n_regionkey AS BIGINT) AS parent, CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation
            UNION ALL SELECT 2 AS kind, CAST(c_nationkey AS BIGINT) AS parent, c_custkey AS id, c_mktsegment AS name FROM customer) c ON c.kind = w.kind + 1 AND c.parent = w.id)
        SELECT DISTINCT root, name FROM walk"""
    ),
    # Children before their parent; R05: the third leaf of each tree.
    "postorder": Query("SELECT path, CAST(row_number() OVER (PARTITION BY tree ORDER BY leaf, n_nationkey) AS BIGINT) AS place FROM (SELECT r_regionkey AS tree, 1 AS leaf, -1 AS n_nationkey, r_name AS path FROM region UNION ALL SELECT n_regionkey AS tree, 0 AS leaf, n_nationkey, n_name AS path FROM nation) AS t"),
    "nth_leaf": Query("SELECT n_regionkey AS tree, n_name AS leaf FROM (SELECT n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS n FROM nation) AS l WHERE n = 2"),
    # A dimension split in two, by cells or per cent.
    "split_size": Query(
        """SELECT p_partkey, CASE WHEN second THEN remain ELSE target END AS first_size, CASE WHEN second THEN target ELSE remain END AS second_size
        FROM (SELECT p_partkey, second, target, greatest(dim - (target + 1), 0) AS remain FROM (
          SELECT p_partkey, p_partkey % 2 = 0 AS second, dim, greatest(CASE WHEN p_partkey % 3 = 0 THEN size ELSE dim * size IDIV 100 END, 1) AS target
          FROM (SELECT p_partkey, 80 + p_partkey % 40 AS dim, CAST(p_size AS BIGINT) AS size FROM part) AS a) AS b) AS c"""
    ),
    # A shared map's values, keys and size.
    "shared_map": Query("SELECT user_id, count(*) AS len, CAST(max(CASE WHEN event_type = 'click' THEN n END) AS BIGINT) AS click FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type) AS s GROUP BY user_id"),
    # Scrollback cleared below the rows in view; X20: entities without a part that lives.
    "clear_scrollback": Query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) AS e WHERE rn <= 24"),
    "drop_dead": Query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)"),
    # Requests in the order in which a state was entered; X12: what is pushed to a consumer that has seen everything up to 500.
    "approval_queue": Query("SELECT user_id, event_id, CAST(row_number() OVER (ORDER BY event_id) AS BIGINT) AS place FROM (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) AS e WHERE event_type = 'purchase' AND (before IS NULL OR before <> 'purchase')"),
    "push_changes": Query("SELECT user_id, max(event_id) AS seqno, count(*) AS n_rows FROM events WHERE event_id > 500 GROUP BY user_id"),
    # Print actions in a row as one; others stay.
    "merge_prints": Query(
        f"SELECT user_id, min(event_id) AS first_id, CASE WHEN event_type = 'view' THEN TEXTAGG(CAST(event_id AS STRING); ','; event_id) ELSE CAST(min(event_id) AS STRING) END AS action FROM (SELECT user_id, event_id, event_type, CASE WHEN event_type = 'view' THEN zone ELSE -event_id - 1 END AS run FROM {_RUNS} AS r) AS x GROUP BY user_id, run, event_type"
    ),
    # Read-outs of the counters, and of the events in whole seconds that have any.
    "counter_values": Query("SELECT event_type AS name, count(*) AS value FROM events GROUP BY event_type ORDER BY name"),
    # A result as text for a context.
    "tool_result": Query("SELECT conv_id, turn, concat('Tool [', role, '] (', CASE WHEN turn % 2 = 0 THEN 'ok' ELSE 'error' END, '): ', text, chr(10)) AS line FROM conversations"),
    # Records as JSON; K04: the same of catalogue rows.
    "json_encode": Query("SELECT n_nationkey, to_json(named_struct('name', n_name, 'region', n_regionkey)) AS json FROM nation", "SELECT n_nationkey, CAST(json_object('name', n_name, 'region', n_regionkey) AS VARCHAR) AS json FROM nation"),
    "catalogue_json": Query("SELECT to_json(named_struct('pane', c_custkey, 'tab', n_name)) AS json FROM customer JOIN nation ON n_nationkey = c_nationkey", "SELECT CAST(json_object('pane', c_custkey, 'tab', n_name) AS VARCHAR) AS json FROM customer JOIN nation ON n_nationkey = c_nationkey"),
    # A store that keeps each content once.
    "blob_store": Query("SELECT sha2(text, 256) AS id, min(doc_id) AS first_doc, max(BYTES(text)) AS size FROM documents GROUP BY sha2(text, 256)", "SELECT sha256(text) AS id, min(doc_id) AS first_doc, CAST(max(strlen(text)) AS INT) AS size FROM documents GROUP BY ALL"),
    # A recording written line by line, read back and kept where its kind is output.
    "recording": Query(
        "SELECT event_id, e[2] AS text FROM (SELECT event_id, from_json(to_json(array(CAST(event_id AS STRING), CASE WHEN event_id % 3 = 0 THEN 'i' ELSE 'o' END, event_type)), 'array<string>') AS e FROM events) AS r WHERE e[1] = 'o'",
        "SELECT event_id, event_type AS text FROM events WHERE event_id % 3 <> 0",
    ),
}
