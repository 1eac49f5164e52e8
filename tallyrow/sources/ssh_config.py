"""Host configuration files: options of hosts, by patterns, and the host names in them.

A file is a sequence of options; Host and Match lines begin groups. In a group the first
value of an option wins, but identityfile collects its values; between groups too the
first value wins, in order of the files and groups that fit the host. Include brings in
another file's lines at its place. Lines are parsed by one pass over each file's text.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from fnmatch import translate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrow.plans.query import Frame

#: The option whose values are collected.
COLLECTS = "identityfile"


def parse(text: str, include: Callable[[str], str] | None = None) -> list[tuple[int, str, str, str]]:
    """group (0 before any), criterion, option and value of each line, values put together as a group's rules say."""
    groups: list[tuple[str, dict[str, str]]] = [("all", {})]

    def read(text: str, depth: int) -> None:
        for line in (x.strip() for x in text.splitlines()):
            m = re.match(r"([^=\s]+)[=\s]\s*(.*)$", line)
            if not m or line.startswith("#"):
                continue
            key, value = m[1].lower(), m[2].lstrip("= ").strip()
            value = value[1:-1] if len(value) > 1 and value[0] == value[-1] == '"' else value
            if key == "include":
                if include and depth < 16:
                    read(include(value), depth + 1)
            elif key in ("host", "match"):
                groups.append((f"host {value}" if key == "host" else value, {}))
            else:
                own = groups[-1][1]
                own[key] = f"{own[key]} {value}" if key == COLLECTS and key in own else own.get(key, value)

    read(text, 0)
    return [(i, criterion, k, v) for i, (criterion, own) in enumerate(groups) for k, v in own.items()]


def fits(patterns: list[str], name: str) -> bool:
    """The first pattern that fits decides; one with ! refuses."""
    for p in patterns:
        if re.match(translate(p.removeprefix("!")), name):
            return not p.startswith("!")
    return False


def criterion_fits(criterion: str, host: str, user: str = "", local_user: str = "") -> bool:
    """all, host (patterns by blanks), or a Match line's criteria, all of which must fit (patterns by commas)."""
    words = criterion.split()
    if words[:1] == ["host"] and not any(w.lower() in ("user", "localuser", "originalhost", "all") for w in words[2:]):
        return fits([p for w in words[1:] for p in w.split(",")], host)
    names, ok, at = {"host": host, "originalhost": host, "user": user, "localuser": local_user}, True, 0
    while at < len(words):
        w = words[at].lower()
        if w == "all":
            at += 1
        elif w in names and at + 1 < len(words):
            ok &= fits(words[at + 1].split(","), names[w])
            at += 2
        else:
            return False  # passes of their own, and commands, aren't run here
    return ok


def expand(value: str, tokens: dict[str, str]) -> str:
    """%x of tokens, %% and ${NAME} of tokens."""
    value = re.sub(r"%(.)", lambda m: "%" if m[1] == "%" else tokens.get(f"%{m[1]}", m[0]), value)
    return re.sub(r"\$\{(\w+)\}", lambda m: tokens.get(m[1], ""), value)


def options(files: DataFrame, name: str, text: str) -> DataFrame:
    """files' name with place, criterion, option and value of each option."""

    @F.pandas_udf("array<struct<place:int,criterion:string,option:string,value:string>>")
    def parsed(x: pd.Series) -> pd.Series:
        return x.map(lambda s: [dict(zip(("place", "criterion", "option", "value"), r, strict=True)) for r in parse(s or "")])

    return files.select(name, F.explode(parsed(F.col(text))).alias("o")).select(name, "o.*")


def hosts(found: DataFrame) -> DataFrame:
    """Different names of Host lines that aren't patterns, in order."""
    names = found.filter("criterion LIKE 'host %'").select(F.explode(F.split(F.expr("substring(criterion, 6)"), r"\s+")).alias("host"))
    return names.filter(~F.col("host").rlike(r"[*?!]") & (F.col("host") != "")).distinct().orderBy("host")


def for_host(found: DataFrame, file_order: Column, host: str, user: str = "", local_user: str = "") -> DataFrame:
    """option and value for one host: the first group that fits and has it wins."""

    @F.pandas_udf("boolean")
    def is_for(criterion: pd.Series) -> pd.Series:
        return criterion.map(lambda c: criterion_fits(c, host, user, local_user))

    own = found.filter(is_for(F.col("criterion")))
    return own.groupBy("option").agg(F.min_by("value", F.struct(file_order.alias("f"), "place")).alias("value"))


def _files(t):
    text = F.format_string("User base\nHost %s *.lan !no.lan\n  Port %d\n  Port 9\n  IdentityFile a\n  IdentityFile b\nHost *\n  User other\n  Compression yes\n", "n_name", "n_nationkey")
    return t("nation").select("n_nationkey", "n_name", text.alias("text"))


QUERIES = {
    # S11, J14
    "ssh_options": Frame(lambda t: options(_files(t), "n_nationkey", "text"), "SELECT n_nationkey, unnest([0, 1, 1, 2, 2]) AS place, unnest(['all', 'host ' || n_name || ' *.lan !no.lan', 'host ' || n_name || ' *.lan !no.lan', 'host *', 'host *']) AS criterion, unnest(['user', 'port', 'identityfile', 'user', 'compression']) AS option, unnest(['base', CAST(n_nationkey AS VARCHAR), 'a b', 'other', 'yes']) AS value FROM nation"),
    # S22
    "ssh_hosts": Frame(lambda t: hosts(options(_files(t), "n_nationkey", "text")), "SELECT DISTINCT n_name AS host FROM nation"),
    # Of files in order the first that has an option.
    "ssh_for_host": Frame(lambda t: for_host(options(_files(t), "n_nationkey", "text"), F.col("n_nationkey"), "x.lan"), "SELECT * FROM (VALUES ('user', 'base'), ('port', '0'), ('identityfile', 'a b'), ('compression', 'yes')) AS v(option, value)"),
}
