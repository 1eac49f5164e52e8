"""Text measured in columns of a terminal: width, padding, truncation, wrapping and tables.

A grapheme is as wide as its widest reading, two columns at most: wide and full-width
characters and emoji take two, combining and invisible ones none, all others one. A text
presentation selector makes a grapheme narrow, an emoji one wide. Vectorised functions
over Arrow batches; null gives null.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrow.plans.query import Frame

_GRAPHEME = regex.compile(r"\X")
_EMOJI = regex.compile(r"\p{Emoji_Presentation}")


@lru_cache(maxsize=1 << 14)
def char_width(c: str) -> int:
    """Columns of a character by itself."""
    if unicodedata.category(c) in ("Mn", "Me", "Cf", "Cc") or "ᅠ" <= c <= "ᇿ":
        return 0
    return 2 if unicodedata.east_asian_width(c) in "WF" or _EMOJI.match(c) else 1


@lru_cache(maxsize=1 << 14)
def grapheme_width(g: str) -> int:
    if "️" in g:
        return 2
    if "︎" in g:
        return 1
    return min(2, max(map(char_width, g), default=0) if len(g) > 1 else char_width(g))


def graphemes(s: str) -> list[str]:
    return list(s) if s.isascii() and "\r" not in s else _GRAPHEME.findall(s)


def text_width(s: str) -> int:
    return len(s) if s.isascii() and s.isprintable() else sum(map(grapheme_width, graphemes(s)))


def columns(s: str, lo: int, hi: int) -> str:
    """The graphemes that begin at columns lo to hi - 1."""
    out, at = [], 0
    for g in graphemes(s):
        if lo <= at < hi:
            out.append(g)
        at += grapheme_width(g)
    return "".join(out)


def kept_right(s: str, most: int) -> str:
    out, at = [], 0
    for g in reversed(graphemes(s)):
        if (at := at + grapheme_width(g)) > most:
            break
        out.append(g)
    return "".join(reversed(out))


def kept_left(s: str, most: int) -> str:
    out, at = [], 0
    for g in graphemes(s):
        if (at := at + grapheme_width(g)) > most:
            break
        out.append(g)
    return "".join(out)


def wrapped(s: str, width: int) -> list[str]:
    """Rows of at most width columns; blanks at the end are dropped, a blank text stays as it is."""
    if not s.rstrip(" "):
        return [s]
    rows, at = [[]], 0
    for g in graphemes(s.rstrip(" ")):
        w = grapheme_width(g)
        if rows[-1] and at + w > width:
            rows.append([])
            at = 0
        rows[-1].append(g)
        at += w
    return ["".join(r) for r in rows]


def _over(f, kind: str):
    @F.pandas_udf(kind)
    def run(x: pd.Series) -> pd.Series:
        return x.map(f, na_action="ignore")

    return run


def display_width(text: Column) -> Column:
    return _over(text_width, "long")(text)


def pad_right(text: Column, width: int) -> Column:
    return _over(lambda s: s + " " * (width - text_width(s)), "string")(text)


def pad_left(text: Column, width: int) -> Column:
    return _over(lambda s: " " * (width - text_width(s)) + s, "string")(text)


def truncate_left(text: Column, most: int) -> Column:
    """Keeps the right-hand end."""
    return _over(lambda s: kept_right(s, most), "string")(text)


def truncate_right(text: Column, most: int) -> Column:
    """Keeps the left-hand start."""
    return _over(lambda s: kept_left(s, most), "string")(text)


def columns_as_str(text: Column, lo: int, hi: int) -> Column:
    return _over(lambda s: columns(s, lo, hi), "string")(text)


def wrap(text: Column, width: int) -> Column:
    return _over(lambda s: wrapped(s, width), "array<string>")(text)


def width_class(char: Column) -> Column:
    """zero, narrow or wide."""
    return _over(lambda c: ("zero", "narrow", "wide")[grapheme_width(c)] if c else None, "string")(char)


def presentation(grapheme: Column) -> Column:
    """emoji or text: by its selector, else by its first character."""
    return _over(lambda g: "emoji" if "️" in g or ("︎" not in g and _EMOJI.match(g)) else "text", "string")(grapheme)


def table(df: DataFrame, align: dict[str, str]) -> DataFrame:
    """df's rows as lines of a table: a column is as wide as its widest cell or name; align: left, right or center of each."""
    cells = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in align))
    widths = cells.agg(*(F.greatest(F.coalesce(F.max(display_width(F.col(c))), F.lit(0)), F.lit(text_width(c))).alias(c) for c in align)).first()  # one row

    def cell(c: str) -> Column:
        w, how = widths[c], align[c]

        def placed(s: str) -> str:
            left = w - text_width(s)
            before = {"left": 0, "right": left, "center": left // 2}[how]
            return " " * before + s + " " * (left - before)

        return _over(placed, "string")(F.col(c))

    return cells.select(F.rtrim(F.concat_ws(" ", *(cell(c) for c in align))).alias("line"))


_STYLES = {"bold": "\x1b[1m", "italic": "\x1b[3m", "underline": "\x1b[4m", "reset": "\x1b[0m"}


def format_items(items: Column) -> Column:
    """Styled items (array of struct of style and text) as one text with escape sequences, reset at the end of each."""
    style = F.create_map(*(F.lit(x) for kv in _STYLES.items() for x in kv))
    one = lambda x: F.concat(F.coalesce(style[x["style"]], F.lit("")), x["text"], F.when(x["style"].isNotNull(), F.lit(_STYLES["reset"])).otherwise(""))
    return F.array_join(F.transform(items, one), "")


QUERIES = {
    # F01, A16
    "display_width": Frame(lambda t: t("documents").select("doc_id", display_width(F.substring("text", 1, 200)).alias("width")), "SELECT doc_id, CAST(length(replace(replace(substring(text, 1, 200), chr(10), ''), chr(9), '')) AS BIGINT) AS width FROM documents"),
    # F02, F03
    "width_class": Frame(lambda t: t("part").select("p_partkey", width_class(F.substring("p_name", 1, 1)).alias("class"), presentation(F.col("p_name")).alias("presentation")), "SELECT p_partkey, 'narrow' AS class, 'text' AS presentation FROM part"),
    # F05, F06
    "padded": Frame(lambda t: t("nation").select("n_nationkey", pad_right(F.col("n_name"), 12).alias("left_aligned"), pad_left(F.col("n_name"), 12).alias("right_aligned")), "SELECT n_nationkey, n_name || repeat(' ', greatest(12 - length(n_name), 0)) AS left_aligned, repeat(' ', greatest(12 - length(n_name), 0)) || n_name AS right_aligned FROM nation"),
    # F07, F08, P12
    "truncated": Frame(lambda t: t("part").select("p_partkey", truncate_left(F.col("p_name"), 5).alias("tail"), truncate_right(F.col("p_name"), 5).alias("head"), columns_as_str(F.col("p_name"), 2, 6).alias("middle")), "SELECT p_partkey, right(p_name, 5) AS tail, left(p_name, 5) AS head, substring(p_name, 3, 4) AS middle FROM part"),
    # W08
    "wrapped": Frame(lambda t: t("part").select("p_partkey", F.posexplode(wrap(F.col("p_name"), 4)).alias("row", "text")), "SELECT p_partkey, CAST(i AS INT) AS row, substring(rtrim(p_name), CAST(i * 4 + 1 AS BIGINT), 4) AS text FROM (SELECT p_partkey, p_name, unnest(range(greatest((length(rtrim(p_name)) + 3) // 4, 1))) AS i FROM part) AS x"),
    # F09, K02, K08
    "styled": Frame(lambda t: t("nation").select("n_nationkey", format_items(F.array(F.struct(F.lit("bold").alias("style"), F.col("n_name").alias("text")), F.struct(F.lit(None).cast("string").alias("style"), F.lit(" x").alias("text")))).alias("text")), "SELECT n_nationkey, chr(27) || '[1m' || n_name || chr(27) || '[0m' || ' x' AS text FROM nation"),
    # K01
    "text_table": Frame(lambda t: table(t("nation"), {"n_nationkey": "right", "n_name": "left", "n_regionkey": "right"}), "SELECT lpad(CAST(n_nationkey AS VARCHAR), 11, ' ') || ' ' || rpad(n_name, greatest(CAST((SELECT max(length(n_name)) FROM nation) AS INT), 6), ' ') || ' ' || lpad(CAST(n_regionkey AS VARCHAR), 11, ' ') AS line FROM nation"),
}
