"""Ordered folds of one key's rows that no window expresses: throughput, caches, limits, intervals in order of insertion, logical lines.

Each runs over the rows of one key in order, in an Arrow-batched group; what it keeps is
bounded except where said. Nulls in the key form a group; a null order comes first. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrow.functions.width import text_width
from tallyrow.plans.query import Frame


def folded(df: DataFrame, key: str, order: list[str], run: Callable[[pd.DataFrame], list[tuple]], schema: str) -> DataFrame:
    """The rows (without the key) that run gives for each key's rows in order; schema: of these."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    kind = df.schema[key].dataType.simpleString()

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(run(rows.sort_values(order, na_position="first", kind="stable")), columns=names)
        out.insert(0, key, rows[key].iloc[0])
        return out

    return df.groupBy(key).applyInPandas(group, f"{key} {kind}, {schema}")


def windows(times: list[float], values: list[int], gap: float = 1.0) -> list[int]:
    """Sums of the windows that an event opens and the first event more than gap seconds later closes."""
    out, start, count = [], None, 0
    for t, v in zip(times, values, strict=True):
        if start is None:
            start = t
        elif t - start > gap:
            out.append(count)
            start, count = t, 0
        count += v
    return out


def throughput(df: DataFrame, key: str, seconds: str, value: str, gap: float = 1.0) -> DataFrame:
    """key and n_windows, p50, p75, p95 of the closed windows' sums."""

    def run(rows: pd.DataFrame) -> list[tuple]:
        sums = sorted(windows(rows[seconds].tolist(), rows[value].tolist(), gap))
        pick = lambda q: sums[max(0, -(-len(sums) * q // 100) - 1)] if sums else None
        return [(len(sums), pick(50), pick(75), pick(95))]

    return folded(df.select(key, seconds, value), key, [seconds], run, "n_windows long, p50 long, p75 long, p95 long")


class Cache:
    """Keeps the keys used most often. Before one goes, the key unused for longest loses frequency by its age."""

    def __init__(self, capacity: int):
        self.capacity, self.tick = capacity, 0
        self.entries: dict[object, list[int]] = {}  # frequency, last tick; the least recent first

    def get(self, key: object) -> bool:
        if key not in self.entries:
            return False
        self.tick += 1
        entry = self.entries.pop(key)
        self.entries[key] = [min(entry[0] + 1, 65535), self.tick]
        return True

    def put(self, key: object) -> list[object]:
        """The keys that go."""
        self.tick += 1
        self.entries.pop(key, None)
        gone = []
        while self.entries and len(self.entries) >= self.capacity:
            gone.append(self.evict())
        self.entries[key] = [0, self.tick]
        return gone

    def decay(self) -> None:
        key = next(iter(self.entries), None)
        if key is None:
            return
        frequency, last = self.entries[key]
        age = (self.tick - last) // 10
        if frequency and age > 1:
            self.entries[key] = self.entries.pop(key)  # not looked at again at once
            self.entries[key][0] = frequency // age

    def evict(self) -> object:
        self.decay()
        key = min(self.entries, key=lambda k: self.entries[k][0])
        del self.entries[key]
        return key


def cached(df: DataFrame, key: str, order: list[str], item: str, capacity: int) -> DataFrame:
    """key, step, item, hit, n_gone of each request: an item that isn't held is put in."""

    def run(rows: pd.DataFrame) -> list[tuple]:
        cache, out = Cache(capacity), []
        for step, x in enumerate(rows[item].tolist()):
            hit = cache.get(x)
            out.append((step, x, hit, 0 if hit else len(cache.put(x))))
        return out

    kind = df.schema[item].dataType.simpleString()
    return folded(df.select(key, *order, item), key, order, run, f"step long, {item} {kind}, hit boolean, n_gone int")


def admitted(times: list[float], amounts: list[int], per_second: int) -> list[int]:
    """Of each request the amount let through: all of it or the largest half, quarter and so on that conforms; 0 if not even one does."""
    allowed, last, out = float(per_second), None, []
    for t, n in zip(times, amounts, strict=True):
        allowed = per_second if last is None else min(per_second, allowed + (t - last) * per_second)
        last = t
        while n > allowed:
            n //= 2
        allowed -= n
        out.append(n)
    return out


def rate_limited(df: DataFrame, key: str, seconds: str, amount: str, per_second: int) -> DataFrame:
    def run(rows: pd.DataFrame) -> list[tuple]:
        got = admitted(rows[seconds].tolist(), rows[amount].tolist(), per_second)
        return list(zip(rows[seconds], rows[amount], got, strict=True))

    return folded(df.select(key, seconds, amount), key, [seconds], run, f"{seconds} double, {amount} long, admitted long")


def inserted(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The set after adding half-open ranges in order. A range is merged with what it overlaps and with one that ends where it starts, but not with one that starts where it ends."""
    out: list[tuple[int, int]] = []
    for lo, hi in ranges:
        if lo >= hi:
            continue
        near = [r for r in out if r[0] < hi and lo <= r[1]]
        out = sorted([r for r in out if r not in near] + [(min(lo, *(r[0] for r in near), lo), max(hi, *(r[1] for r in near), hi))])
    return out


def insert_ranges(df: DataFrame, key: str, order: list[str], lo: str, hi: str) -> DataFrame:
    """key, lo, hi of each key's set. Keeps the set of one key in memory."""
    return folded(df.select(key, *order, lo, hi), key, order, lambda rows: inserted(list(zip(rows[lo].tolist(), rows[hi].tolist(), strict=True))), "lo long, hi long")


#: Columns of a logical line, beyond which a row begins another.
LOGICAL = 1024


def logical(rows: list[tuple[int, str, bool]], most: int = LOGICAL) -> list[tuple[int, int, str]]:
    """First row, last row and text of each logical line of rows (number, text, whether it goes on in the next)."""
    out, held, width, goes_on = [], [], 0, False
    for n, text, more in rows:
        w = text_width(text)
        if held and (not goes_on or (width > 0 and width + w > most)):
            out.append((held[0][0], held[-1][0], "".join(t for _, t in held)))
            held, width = [], 0
        held.append((n, text))
        width, goes_on = width + w, more
    if held:
        out.append((held[0][0], held[-1][0], "".join(t for _, t in held)))
    return out


def logical_lines(df: DataFrame, key: str, row: str, text: str, wrapped: str, most: int = LOGICAL) -> DataFrame:
    """key, first_row, last_row, text of each logical line."""

    def run(rows: pd.DataFrame) -> list[tuple]:
        return logical(list(zip(rows[row].tolist(), rows[text].tolist(), rows[wrapped].tolist(), strict=True)), most)

    return folded(df.select(key, row, text, wrapped), key, [row], run, "first_row long, last_row long, text string")


def rewrap(df: DataFrame, key: str, row: str, text: str, wrapped: str, width: int) -> DataFrame:
    """key, row, text, wrapped after all rows are put together to logical lines, without a limit, and cut anew."""
    from tallyrow.functions.width import wrapped as cut

    def run(rows: pd.DataFrame) -> list[tuple]:
        out = []
        for _, _, line in logical(list(zip(rows[row].tolist(), rows[text].tolist(), rows[wrapped].tolist(), strict=True)), 1 << 62):
            parts = cut(line, width)
            out += [(p, i + 1 < len(parts)) for i, p in enumerate(parts)]
        return [(i, p, more) for i, (p, more) in enumerate(out)]

    return folded(df.select(key, row, text, wrapped), key, [row], run, "row long, text string, wrapped boolean")


def last_logical_lines(df: DataFrame, key: str, row: str, text: str, wrapped: str, n: int) -> DataFrame:
    """key and text: the last n logical lines of each key, right-trimmed, joined by line ends."""
    lines = logical_lines(df, key, row, text, wrapped)
    last = lines.groupBy(key).agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("first_row", "text")))), 1, n).alias("x"))
    return last.select(key, F.array_join(F.transform(F.reverse("x"), lambda r: F.rtrim(r["text"])), "\n").alias("text"))


def zone_text(df: DataFrame, key: str, row: str, text: str, wrapped: str, first: tuple[int, int], last: tuple[int, int]) -> DataFrame:
    """key and text from (row, column) to (row, column), both included; a line end only between rows that don't go on."""
    inside = df.filter(F.col(row).between(first[0], last[0]))
    lo = F.when(F.col(row) == first[0], first[1]).otherwise(0)
    hi = F.when(F.col(row) == last[0], last[1] + 1).otherwise(1 << 30)
    cut = F.substring(F.col(text), (lo + 1).cast("int"), (hi - lo).cast("int"))
    shown = F.when(F.col(wrapped) & (F.col(row) < last[0]), cut).otherwise(F.rtrim(cut))
    end = F.when(F.col(wrapped) | (F.col(row) == last[0]), "").otherwise("\n")
    parts = inside.select(key, F.struct(F.col(row).alias("r"), F.concat(shown, end).alias("t")).alias("p"))
    return parts.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["t"]), "").alias("text"))


def word_around(df: DataFrame, text: str, column: int, wrapped: str) -> DataFrame:
    """df with lo, hi (half-open) of the word around a column, and whether it reaches the end of a row that goes on."""
    before = F.length(F.regexp_extract(F.substring(F.col(text), 1, column + 1), r"\w*$", 0))
    after = F.length(F.regexp_extract(F.substring(F.col(text), column + 1, 1 << 30), r"^\w*", 0))
    inside = F.col(text).isNotNull() & (F.length(text) > column) & (after > 0)
    hi = F.when(inside, column + after).otherwise(column)
    out = df.withColumns({"lo": F.when(inside, column + 1 - before).otherwise(column), "hi": hi})
    return out.withColumn("with_wrap", F.col(wrapped) & (F.col("hi") > F.col("lo")) & (F.col("hi") >= F.length(text)))


def _rows(t):
    """Names of parts as rows of a screen, some of which go on."""
    return t("part").select(F.col("p_brand").alias("pane"), F.col("p_partkey").alias("row"), F.col("p_name").alias("text"), (F.col("p_size") % 3 != 0).alias("wrapped"))


def _seconds(t):
    return t("events").select("user_id", "event_type", "event_id", (F.expr("unix_micros(cast(ts AS timestamp))") / 3_600_000_000.0).alias("hours"), F.lit(1).cast("long").alias("one"))


_ISLANDS = "(SELECT *, sum(CASE WHEN before THEN 0 ELSE 1 END) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT p_brand, p_partkey, p_name, coalesce(lag(p_size % 3 <> 0) OVER (PARTITION BY p_brand ORDER BY p_partkey), FALSE) AS before FROM part) AS a)"

QUERIES = {
    # Hours stand for seconds, as events of the tables are far apart.
    "throughput": Frame(lambda t: throughput(_seconds(t), "event_type", "hours", "one")),
    # T11, X15, X16
    "lfu_cache": Frame(lambda t: cached(t("events").withColumn("item", F.col("event_id") % 11), "user_id", ["event_id"], "item", 4)),
    # X14
    "rate_limit": Frame(lambda t: rate_limited(_seconds(t).withColumn("amount", F.col("event_id") % 40 + 1), "user_id", "hours", "amount", 16)),
    # In order of insertion.
    "interval_insert": Frame(lambda t: insert_ranges(t("lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", F.col("l_orderkey").alias("a"), (F.col("l_orderkey") + F.col("l_linenumber")).alias("b")), "l_suppkey", ["l_orderkey", "l_linenumber"], "a", "b"), "SELECT k AS l_suppkey, lo, hi FROM (SELECT k, min(lo) AS lo, max(hi) AS hi FROM (SELECT k, lo, hi, sum(new) OVER (PARTITION BY k ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT l_suppkey AS k, l_orderkey AS lo, l_orderkey + l_linenumber AS hi, CASE WHEN l_orderkey <= max(l_orderkey + l_linenumber) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_orderkey + l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM lineitem) AS s) AS t GROUP BY k, island) AS m"),
    # W04
    "logical_lines": Frame(lambda t: logical_lines(_rows(t), "pane", "row", "text", "wrapped"), f"SELECT p_brand AS pane, min(p_partkey) AS first_row, max(p_partkey) AS last_row, TEXTAGG(p_name; ''; p_partkey) AS text FROM {_ISLANDS} AS i GROUP BY p_brand, island"),
    # W07
    "rewrapped": Frame(lambda t: rewrap(_rows(t), "pane", "row", "text", "wrapped", 16)),
    # P32
    "last_logical_lines": Frame(lambda t: last_logical_lines(_rows(t), "pane", "row", "text", "wrapped", 2), f"SELECT pane, TEXTAGG(text; chr(10); n DESC) AS text FROM (SELECT pane, rtrim(text) AS text, row_number() OVER (PARTITION BY pane ORDER BY first_row DESC) AS n FROM (SELECT p_brand AS pane, min(p_partkey) AS first_row, TEXTAGG(p_name; ''; p_partkey) AS text FROM {_ISLANDS} AS i GROUP BY p_brand, island) AS l) AS x WHERE n <= 2 GROUP BY pane"),
    # P30
    "zone_text": Frame(lambda t: zone_text(_rows(t), "pane", "row", "text", "wrapped", (20, 2), (120, 4)), "SELECT pane, TEXTAGG(part; ''; p_partkey) AS text FROM (SELECT p_brand AS pane, p_partkey, CASE WHEN p_size % 3 <> 0 AND p_partkey < 120 THEN cut ELSE rtrim(cut) END || CASE WHEN p_size % 3 <> 0 OR p_partkey = 120 THEN '' ELSE chr(10) END AS part FROM (SELECT p_brand, p_partkey, p_size, CASE WHEN p_partkey = 20 THEN substring(p_name, 3) WHEN p_partkey = 120 THEN substring(p_name, 1, 5) ELSE p_name END AS cut FROM part WHERE p_partkey BETWEEN 20 AND 120) AS c) AS x GROUP BY pane"),
    # P13
    "word_around": Frame(lambda t: word_around(_rows(t), "text", 3, "wrapped").select("row", "lo", "hi", "with_wrap"), "SELECT p_partkey AS row, CASE WHEN good THEN 4 - length(regexp_extract(substring(p_name, 1, 4), '\\w*$', 0)) ELSE 3 END AS lo, CASE WHEN good THEN 3 + length(regexp_extract(substring(p_name, 4), '^\\w*', 0)) ELSE 3 END AS hi, p_size % 3 <> 0 AND good AND 3 + length(regexp_extract(substring(p_name, 4), '^\\w*', 0)) >= length(p_name) AS with_wrap FROM (SELECT *, length(p_name) > 3 AND length(regexp_extract(substring(p_name, 4), '^\\w*', 0)) > 0 AS good FROM part) AS p"),
}
