"""SQL on another engine for the queries that SQL can express in full."""

from __future__ import annotations

from tallyrow.llm.quality_rules import LEAST, REACH, SPREADS

_LOWERED = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE = "list_filter(regexp_split_to_array({}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_ALNUM = "list_filter(regexp_split_to_array({}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

_VALUE = "CASE WHEN bucket < 32 THEN bucket ELSE (16 + bucket % 16) << CAST(bucket // 16 - 1 AS INT) END"
_BUCKET = "CASE WHEN v < 32 THEN v ELSE (length(bin(v)) - 5) * 16 + (v >> CAST(length(bin(v)) - 5 AS INT)) END"


def _quartiles(keys: str, tag: str) -> str:
    by = f"{keys} metric"
    return f"""SELECT {by}, max(total) AS n_{tag}, min(CASE WHEN 4 * upto >= total THEN {_VALUE} END) AS a_{tag}, min(CASE WHEN 4 * upto >= 3 * total THEN {_VALUE} END) AS b_{tag}
      FROM (SELECT {by}, bucket, sum(n) OVER (PARTITION BY {by} ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {by}) AS total FROM (SELECT {by}, bucket, count(*) AS n FROM sketch GROUP BY {by}, bucket)) GROUP BY {by}"""


_FLOOR = "CASE metric " + " ".join(f"WHEN '{m}' THEN {x}" for m, x in SPREADS.items()) + " END"
_OUT = " OR ".join([*(f"{m} > hi_{m}" for m in SPREADS), "m_len < lo_m_len"])
_LEVEL = lambda q: f"CASE WHEN n_s >= {LEAST} THEN {q}_s WHEN n_l >= {LEAST} THEN {q}_l ELSE {q}_a END"

QUALITY_RULES = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text, {_SPACE.format("coalesce(text, '')")} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
three AS (SELECT rid, i, list_slice(w, i, i + 2) AS x FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM d)),
again AS (SELECT t.rid, t.i FROM three t JOIN (SELECT rid, x FROM three GROUP BY rid, x HAVING count(*) > 1) r ON r.rid = t.rid AND r.x = t.x),
covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY rid),
base AS (SELECT d.rid, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, len(l) AS n_lines FROM d LEFT JOIN covered ON covered.rid = d.rid),
rows AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
metrics AS (SELECT *, CASE WHEN NOT base_failed THEN 100 * word_chars // n_words END AS m_len, CASE WHEN NOT base_failed THEN 1000 * n_symbols // n_words END AS m_sym, CASE WHEN NOT base_failed THEN 1000 * n_dup_lines // n_lines END AS m_dup, CASE WHEN NOT base_failed THEN 1000 * n_repeat_words // n_words END AS m_rep FROM rows),
sketch AS (SELECT lang, source, metric, {_BUCKET} AS bucket FROM (SELECT lang, source, unnest(['m_len', 'm_sym', 'm_dup', 'm_rep']) AS metric, unnest([m_len, m_sym, m_dup, m_rep]) AS v FROM metrics WHERE NOT base_failed)),
s AS ({_quartiles("lang, source,", "s")}), l AS ({_quartiles("lang,", "l")}), a AS ({_quartiles("", "a")}),
q AS (SELECT s.lang, s.source, s.metric, {_LEVEL("a")} AS a, {_LEVEL("b")} AS b FROM s JOIN l ON s.lang IS NOT DISTINCT FROM l.lang AND s.metric = l.metric JOIN a ON s.metric = a.metric),
fences AS (SELECT lang, source, {", ".join(f"max(CASE WHEN metric = '{m}' THEN a - {REACH} * greatest(b - a, {_FLOOR}) END) AS lo_{m}, max(CASE WHEN metric = '{m}' THEN b + {REACH} * greatest(b - a, {_FLOOR}) END) AS hi_{m}" for m in SPREADS)} FROM q GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce({_OUT}, FALSE) AS kept
FROM metrics m LEFT JOIN fences f ON f.lang IS NOT DISTINCT FROM m.lang AND f.source IS NOT DISTINCT FROM m.source"""

JACCARD_JOIN = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPACE.format(_LOWERED.format("text"))} AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, x FROM (
  SELECT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') AS x FROM d WHERE len(w) BETWEEN 1 AND 2)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sets a JOIN sets b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * common.n >= 90 * (p.n + q.n - common.n)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.least, d.doc_id)) AS component_id
FROM d LEFT JOIN sizes z ON z.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS least FROM reach GROUP BY a) c ON c.a = d.doc_id"""

DECONTAMINATE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_ALNUM.format(_LOWERED.format("text"))} AS w FROM documents),
items AS (SELECT item_id, {_ALNUM.format(_LOWERED.format("text"))} AS w FROM benchmark WHERE item_id IS NOT NULL),
wins AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS x FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM items WHERE len(w) > 0)),
places AS (SELECT rid, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS x FROM (SELECT rid, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM wins) AS sizes)),
hits AS (SELECT rid, i, p.n, item_id FROM places p JOIN wins ON wins.n = p.n AND wins.x = p.x),
covered AS (SELECT rid, count(DISTINCT place) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS place FROM hits) GROUP BY rid),
listed AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered ON covered.rid = d.rid LEFT JOIN listed ON listed.rid = d.rid"""

ORACLE = {"op2_quality_rules": QUALITY_RULES, "op4_jaccard_join": JACCARD_JOIN, "op5_decontaminate": DECONTAMINATE}
