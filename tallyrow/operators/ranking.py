"""Fuzzy ranking, labels for matches, links of a line and distinct colours."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyrow.plans.query import Frame, Query


def fuzzy_score(query: str, text: str) -> str:
    """SQL: null if the characters of query don't stand in text in order, else higher for a shorter span and an earlier start.

    A rule of our own: a hundred for each character, less the length of the first shortest
    run from each character to the next, less the place at which it begins.
    """
    pattern = ".*?".join(re.escape(c) for c in query.lower())
    span = f"regexp_extract(lower({text}), RX'(?s){pattern}', 0)"
    return f"CASE WHEN MATCHES(lower({text}), RX'(?s){pattern}') THEN {100 * len(query)} - length({span}) - instr(lower({text}), {span}) END"


def labels(alphabet: str, n: int) -> list[str]:
    """At most n labels of one or two characters, none a prefix of another.

    As many two-character groups, from the end of the alphabet, as are needed; each uses up
    its first character as a label of its own.
    """
    size = len(alphabet)
    groups = next((g for g in range(size + 1) if size - g + g * size >= n), size)
    single, double = list(alphabet[: size - groups]), []
    left = n - len(single)
    for c in reversed(alphabet[size - groups :]):  # the last character's group was made first and is full
        own = min(left - len(double), size)
        double = [c + x for x in alphabet[:own]] + double
    return (single[: max(0, n - len(double))] + double)[:n]


def labelled(matches: DataFrame, text: str, place: str, alphabet: str, most: int) -> DataFrame:
    """text and label: the first label for the text seen last, and so on, for at most `most` texts; most bounds what is collected into one task and broadcast."""
    last = matches.groupBy(text).agg(F.max(place).alias("_last")).orderBy(F.desc("_last"), text).limit(most)
    ranked = last.withColumn("_n", F.row_number().over(Window.orderBy(F.desc("_last"), text)) - 1)
    spark = matches.sparkSession
    known = spark.createDataFrame(list(enumerate(labels(alphabet, min(most, matches.select(text).distinct().count())))), "_n int, label string")
    return ranked.join(F.broadcast(known), "_n").select(text, "label")


def distinct_colours(pool: list[tuple[float, float, float]], threshold: float, lightness: tuple[float, float], least_chroma: float, limit: int) -> list[tuple[float, float, float]]:
    """Of a pool (L, a, b; the commonest first) at most limit colours that differ by threshold from those chosen before; a pool that gives too few is gone through again with a lower threshold."""
    out: list[tuple[float, float, float]] = []
    while len(out) < limit and threshold >= 1:
        for c in pool:
            far = all(float(np.linalg.norm(np.subtract(c, o))) >= threshold for o in out)
            if len(out) < limit and far and lightness[0] <= c[0] <= lightness[1] and float(np.hypot(c[1], c[2])) >= least_chroma:
                out.append(c)
        threshold -= 5
    return out


# The default rules, in order; the number of the group that is shown.
LINK_RULES = [
    (r"\((\w+://\S+)\)", "$1", 1),
    (r"\[(\w+://\S+)\]", "$1", 1),
    (r"<(\w+://\S+)>", "$1", 1),
    (r"\b\w+://[^\s()]*\(\S*\)(?=\s|$|[^_/a-zA-Z0-9-])", "$0", 0),
    (r"\b\w+://\S+[_/a-zA-Z0-9-]", "$0", 0),
    (r"\b\w+@[\w-]+(\.[\w-]+)+\b", "mailto:$0", 0),
]


def links(df: DataFrame, text: str, rules: list[tuple[str, str, int]] = LINK_RULES) -> DataFrame:
    """df with rule, shown and link of each match in each row's text, and place: the longest match first, the earlier rule of equals."""
    quoted = lambda x: x.replace("\\", "\\\\").replace("'", "\\'")
    found = [f"transform(regexp_extract_all(`{text}`, '{quoted(p)}', 0), m -> struct({i} AS rule, length(m) AS n, regexp_extract(m, '{quoted(p)}', {g}) AS shown, regexp_replace(m, '{quoted(p)}', '{quoted(f)}') AS link))" for i, (p, f, g) in enumerate(rules)]
    by_length = "(x, y) -> CASE WHEN x.n > y.n THEN -1 WHEN x.n < y.n THEN 1 WHEN x.rule < y.rule THEN -1 WHEN x.rule > y.rule THEN 1 ELSE 0 END"
    out = df.select("*", F.posexplode(F.expr(f"array_sort(concat({', '.join(found)}), {by_length})")).alias("place", "_m"))
    return out.select(*df.columns, "place", "_m.rule", "_m.shown", "_m.link")


def spans(df: DataFrame, text: str, pattern: str, group: int = 0) -> DataFrame:
    """df with lo, hi (half-open, in characters) of each match of a pattern in each row's text, in order; group: the one whose text is looked for at the match."""
    escaped = pattern.replace("\\", "\\\\").replace("'", "\\'")
    step = f"""aggregate(regexp_extract_all(`{text}`, '{escaped}', {group}), struct(cast(1 AS int) AS at, cast(array() AS array<struct<lo:int,hi:int>>) AS found),
      (a, m) -> struct(cast(locate(m, `{text}`, a.at) + length(m) AS int) AS at, array_append(a.found, struct(locate(m, `{text}`, a.at) - 1 AS lo, locate(m, `{text}`, a.at) - 1 + length(m) AS hi)) AS found)).found"""
    out = df.select("*", F.explode(F.expr(step)).alias("_s"))
    return out.select(*df.columns, "_s.lo", "_s.hi")


_MARKED = "concat(text, ' (http://a.b/c', CAST(doc_id AS STRING), ') x@y', CAST(doc_id AS STRING), '.org ftp://host/dir')"
_DISTINCT = "(SELECT event_type, dense_rank() OVER (ORDER BY last_seen DESC, event_type) - 1 AS n FROM (SELECT event_type, max(event_id) AS last_seen FROM events GROUP BY event_type) AS e)"

QUERIES = {
    # T01
    "fuzzy_rank": Query(f"SELECT p_partkey, score, CAST(row_number() OVER (ORDER BY score DESC, p_partkey) AS BIGINT) AS place FROM (SELECT p_partkey, {fuzzy_score('aen', 'p_name')} AS score FROM part) AS p WHERE score IS NOT NULL"),
    # An exact name goes first.
    "palette_match": Query(f"SELECT p_partkey, score FROM (SELECT p_partkey, CASE WHEN p_partkey = 7 THEN 1000000 ELSE {fuzzy_score('re', 'p_name')} END AS score FROM part) AS p WHERE score IS NOT NULL ORDER BY score DESC, p_partkey"),
    # The best alias of each glyph, or its code point.
    "character_picker": Query(f"SELECT glyph, alias, score FROM (SELECT p_brand AS glyph, p_name AS alias, score, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_partkey) AS rn FROM (SELECT p_partkey, p_brand, p_name, CASE WHEN p_brand = 'Brand#11' THEN 1000000 ELSE {fuzzy_score('e', 'p_name')} END AS score FROM part) AS p WHERE score IS NOT NULL) AS x WHERE rn = 1"),
    # T07, T08
    "match_labels": Frame(lambda t: labelled(t("events"), "event_type", "event_id", "ab", 100), "SELECT event_type, l AS label FROM %s AS d JOIN (VALUES %s) AS known(n, l) ON known.n = d.n" % (_DISTINCT, ", ".join(f"({i}, '{x}')" for i, x in enumerate(labels("ab", 5))))),
    # P05, P33, T04
    "default_links": Frame(
        lambda t: links(t("documents").select("doc_id", F.expr("concat('see (http://a.b/c', cast(doc_id AS string), ') and x@y', cast(doc_id AS string), '.org')").alias("line")), "line").select("doc_id", "place", "rule", "link"),
        "SELECT doc_id, place, rule, link FROM (SELECT doc_id, unnest([0, 1, 2]) AS place, unnest([0, 4, 5]) AS rule, unnest(['http://a.b/c' || doc_id, 'http://a.b/c' || doc_id, 'mailto:x@y' || doc_id || '.org']) AS link FROM documents) AS x",
    ),
    # Places of each match in each line.
    "search_spans": Frame(lambda t: spans(t("part").select("p_partkey", "p_name"), "p_name", "r").select("p_partkey", "lo", "hi"), "SELECT p_partkey, CAST(i - 1 AS INT) AS lo, CAST(i AS INT) AS hi FROM (SELECT p_partkey, p_name, unnest(range(1, length(p_name) + 1)) AS i FROM part) AS x WHERE substring(p_name, i, 1) = 'r'"),
}
