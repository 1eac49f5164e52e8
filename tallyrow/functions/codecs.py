"""Encodings without a built-in function: YAML and TOML, shell words, base91, visual escapes. Null gives null."""

from __future__ import annotations

import json
import re
import shlex
import tomllib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyrow.plans.query import Frame


def _over(f, kind: str = "string"):
    @F.pandas_udf(kind)
    def run(x: pd.Series) -> pd.Series:
        return x.map(f, na_action="ignore")

    return run


# -- YAML: the block form of maps, lists and scalars, with scalars as JSON where they need it


def to_yaml(value: object, indent: str = "") -> str:
    if isinstance(value, (dict, list)) and value:
        lines = []
        for k, v in value.items() if isinstance(value, dict) else ((None, v) for v in value):
            head = "-" if k is None else f"{_plain(k)}:"
            inner = isinstance(v, (dict, list)) and v
            lines.append(f"{indent}{head}\n{to_yaml(v, indent + '  ')}" if inner else f"{indent}{head} {_plain(v)}")
        return "\n".join(lines)
    return indent + _plain(value)


def _plain(v: object) -> str:
    if isinstance(v, str) and re.fullmatch(r"[A-Za-z_][\w ./-]*(?<! )", v) and v.lower() not in ("true", "false", "null", "yes", "no", "on", "off"):
        return v
    return json.dumps(v, ensure_ascii=False)


def from_yaml(text: str) -> object:
    """What to_yaml() writes, and other block YAML of that form; comments and blank lines are skipped."""
    rows = [(len(x) - len(x.lstrip(" ")), x.strip()) for x in text.split("\n") if x.strip() and not x.lstrip().startswith("#") and x.strip() != "---"]
    at = 0

    def scalar(x: str) -> object:
        if x in ("", "~"):
            return None
        try:
            return json.loads(x)
        except ValueError:
            return x[1:-1].replace("''", "'") if len(x) > 1 and x[0] == x[-1] == "'" else x

    def block(depth: int) -> object:
        nonlocal at
        if not rows:
            return None
        out: object = None
        while at < len(rows) and rows[at][0] == depth:
            line = rows[at][1]
            item = re.match(r"-(?:\s+(.*))?$", line)
            pair = None if item else re.match(r"(\"(?:[^\"\\]|\\.)*\"|[^:]+?):(?:\s+(.*))?$", line)
            if not item and not pair:
                at += 1
                return scalar(line)
            rest = (item[1] if item else pair[2]) or ""
            at += 1
            deeper = not rest and at < len(rows) and rows[at][0] > depth
            value = block(rows[at][0]) if deeper else scalar(rest)
            if item:
                out = [] if out is None else out
                out.append(value)
            else:
                out = {} if out is None else out
                key = scalar(pair[1])
                out[key if isinstance(key, str) else pair[1]] = value
        return out

    return block(rows[0][0] if rows else 0)


def to_toml(value: dict, path: tuple[str, ...] = ()) -> str:
    """Tables below their own head; null values are left out."""

    def one(v: object) -> str:
        if isinstance(v, dict):
            return "{ " + ", ".join(f"{_key(k)} = {one(x)}" for k, x in v.items() if x is not None) + " }"
        return "[" + ", ".join(map(one, v)) + "]" if isinstance(v, list) else json.dumps(v, ensure_ascii=False)

    own = [f"{_key(k)} = {one(v)}" for k, v in value.items() if v is not None and not isinstance(v, dict)]
    head = [f"[{'.'.join(map(_key, path))}]"] if path else []
    inner = [to_toml(v, (*path, k)) for k, v in value.items() if isinstance(v, dict)]
    return "\n".join([*head, *own, *inner])


def _key(k: str) -> str:
    return k if re.fullmatch(r"[\w-]+", k, re.ASCII) else json.dumps(k, ensure_ascii=False)


def _attempt(f):
    def run(x: str) -> str | None:
        try:
            return json.dumps(f(x), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return None

    return run


def yaml_encode(text: Column) -> Column:
    """A value given as JSON."""
    return _over(lambda x: to_yaml(json.loads(x)))(text)


def yaml_decode(text: Column) -> Column:
    """The value as JSON."""
    return _over(_attempt(from_yaml))(text)


def toml_encode(text: Column) -> Column:
    return _over(lambda x: to_toml(json.loads(x)))(text)


def toml_decode(text: Column) -> Column:
    """The value as JSON; null for what isn't TOML."""
    return _over(_attempt(tomllib.loads))(text)


def json_pretty(text: Column) -> Column:
    return _over(lambda x: json.dumps(json.loads(x), indent=2, ensure_ascii=False))(text)


# -- themes: each format to one record


def scheme_of(text: str, kind: str) -> dict | None:
    """name, foreground, background and colours of a theme in toml, base16 (YAML) or sexy (JSON)."""
    try:
        if kind == "toml":
            x = tomllib.loads(text)
            c = x.get("colors", {})
            return {"name": x.get("metadata", {}).get("name"), "foreground": c.get("foreground"), "background": c.get("background"), "colors": [*c.get("ansi", []), *c.get("brights", [])]}
        x = from_yaml(text) if kind == "base16" else json.loads(text)
        if kind == "base16":
            base = {k: f"#{x[k].lstrip('#')}" if isinstance(x[k], str) else f"#{x[k]:06d}" for k in x if re.fullmatch(r"base0[0-9A-F]", k)}
            order = ["00", "08", "0B", "0A", "0D", "0E", "0C", "05", "03", "08", "0B", "0A", "0D", "0E", "0C", "07"]
            return {"name": x.get("scheme"), "foreground": base.get("base05"), "background": base.get("base00"), "colors": [base[f"base{i}"] for i in order]}
        return {"name": x.get("name"), "foreground": x.get("foreground"), "background": x.get("background"), "colors": x.get("color", [])}
    except (ValueError, KeyError, AttributeError, TypeError):
        return None


def load_scheme(text: Column, kind: str) -> Column:
    return F.from_json(_over(lambda x: json.dumps(scheme_of(x, kind)))(text), "name string, foreground string, background string, colors array<string>")


def save_scheme(text: Column) -> Column:
    """A theme given as JSON (name, foreground, background, colors) as TOML."""

    def one(x: str) -> str:
        s = json.loads(x)
        c = s.get("colors") or []
        return to_toml({"colors": {"foreground": s.get("foreground"), "background": s.get("background"), "ansi": c[:8], "brights": c[8:]}, "metadata": {"name": s.get("name")}})

    return _over(one)(text)


# -- shell words


def shell_split(line: Column) -> Column:
    """Null for a line with a quote that isn't closed."""

    def one(x: str) -> list[str] | None:
        try:
            return shlex.split(x, comments=True)
        except ValueError:
            return None

    return _over(one, "array<string>")(line)


def shell_quote(word: Column) -> Column:
    return _over(shlex.quote)(word)


def shell_join(words: Column) -> Column:
    return _over(lambda x: shlex.join(x))(words)


# -- base91

_91 = [chr(c) for c in (*range(65, 91), *range(97, 123), *range(48, 58))] + list('!#$%&()*+,./:;<=>?@[]^_`{|}~"')


def base91(data: bytes) -> str:
    """13 or 14 bits as two characters."""
    out, held, bits = [], 0, 0
    for byte in data:
        held |= byte << bits
        bits += 8
        if bits > 13:
            size = 13 if held & 8191 > 88 else 14
            v = held & ((1 << size) - 1)
            held, bits = held >> size, bits - size
            out += _91[v % 91], _91[v // 91]
    if bits:
        out.append(_91[held % 91])
        if bits > 7 or held > 90:
            out.append(_91[held // 91])
    return "".join(out)


def base91_encode(data: Column) -> Column:
    return _over(lambda x: base91(bytes(x)))(data)


# -- visual escapes

_SHORT = {"n": 10, "r": 13, "b": 8, "a": 7, "v": 11, "t": 9, "f": 12, "s": 32, "0": 0, "\\": 92, "E": 27}


def unvis_text(text: str) -> str | None:
    """Escapes of three octal digits, a letter, ^X for control and M for the high bit; null if one is broken."""
    out, at, data = bytearray(), 0, text
    while at < len(data):
        c = data[at]
        if c != "\\":
            out += c.encode()
            at += 1
            continue
        rest = data[at + 1 :]
        if m := re.match(r"[0-3][0-7]{2}", rest):
            out.append(int(m[0], 8))
        elif m := re.match(r"M-(.)", rest, re.S):
            out.append(ord(m[1]) & 255 | 128)
        elif m := re.match(r"M?\^(.)", rest, re.S):
            low = 127 if m[1] == "?" else ord(m[1]) & 31
            out.append(low | (128 if rest[0] == "M" else 0))
        elif rest and rest[0] == "\n":
            m = re.match("\n", rest)
        elif rest and rest[0] in _SHORT:
            m = re.match(r"(?s).", rest)
            out.append(_SHORT[rest[0]])
        else:
            return None
        at += 1 + len(m[0])
    return out.decode("utf-8", "replace")


def unvis(text: Column) -> Column:
    return _over(unvis_text)(text)


def _nested(t):
    return t("nation").select("n_nationkey", F.to_json(F.struct(F.col("n_name").alias("name"), F.struct(F.col("n_regionkey").alias("region"), F.array(F.lit(1), F.lit(2)).alias("list")).alias("inner"))).alias("json"))


_JSON = """SELECT n_nationkey, '{"name":"' || n_name || '","inner":{"region":' || n_regionkey || ',"list":[1,2]}}' AS json FROM nation"""
_THEME = """SELECT n_nationkey, n_name AS name, '#ffffff' AS foreground, CAST(16 AS INT) AS n FROM nation"""


def _themes(t, kind: str):
    n = t("nation").select("n_nationkey", "n_name")
    quoted = ",".join(f'"#{i:06x}"' for i in range(16))
    if kind == "sexy":
        text = F.concat(F.lit('{"name":"'), "n_name", F.lit(f'","foreground":"#ffffff","background":"#000000","color":[{quoted}]}}'))
    elif kind == "toml":
        text = save_scheme(F.concat(F.lit('{"name":"'), "n_name", F.lit(f'","foreground":"#ffffff","background":"#000000","colors":[{quoted}]}}')))
    else:
        rows = "\n".join(f'base0{i:X}: "{"ffffff" if i == 5 else f"{i:06x}"}"' for i in range(16))
        text = F.concat(F.lit('scheme: "'), "n_name", F.lit(f'"\n{rows}'))
    x = load_scheme(text, kind)
    return n.select("n_nationkey", x.alias("x")).select("n_nationkey", "x.name", "x.foreground", F.size("x.colors").alias("n"))


QUERIES = {
    # K06, V04; K07, V05; K05, V03
    "yaml": Frame(lambda t: _nested(t).select("n_nationkey", yaml_decode(yaml_encode(F.col("json"))).alias("json")), _JSON),
    "toml": Frame(lambda t: _nested(t).select("n_nationkey", toml_decode(toml_encode(F.col("json"))).alias("json")), _JSON),
    "json_pretty": Frame(lambda t: t("nation").select("n_nationkey", json_pretty(F.to_json(F.struct(F.col("n_name").alias("name")))).alias("json")), """SELECT n_nationkey, '{' || chr(10) || '  "name": "' || n_name || '"' || chr(10) || '}' AS json FROM nation"""),
    # S24, K14; S25; S26
    "theme_toml": Frame(lambda t: _themes(t, "toml"), _THEME),
    "theme_yaml": Frame(lambda t: _themes(t, "base16"), _THEME),
    "theme_json": Frame(lambda t: _themes(t, "sexy"), _THEME),
    # F11; F12, F13
    "shell_split": Frame(lambda t: t("part").select("p_partkey", F.explode(shell_split(F.concat(F.lit("run -x '"), "p_name", F.lit("' \"a b\"")))).alias("word")), "SELECT p_partkey, unnest(['run', '-x', p_name, 'a b']) AS word FROM part"),
    "shell_join": Frame(lambda t: t("part").select("p_partkey", shell_join(F.array(F.lit("run"), F.lit("a b"), F.lit("it's"))).alias("line"), shell_quote(F.lit("$x")).alias("quoted")), "SELECT p_partkey, 'run ''a b'' ''it''\"''\"''s''' AS line, '''$x''' AS quoted FROM part"),
    # F15
    "base91": Frame(lambda t: t("part").select("p_partkey", base91_encode(F.col("p_name").cast("binary")).alias("text"))),
    # F16
    "unvis": Frame(lambda t: t("part").select("p_partkey", unvis(F.concat("p_name", F.lit("\\040\\\\\\011end\\s"))).alias("text")), "SELECT p_partkey, p_name || ' ' || chr(92) || chr(9) || 'end ' AS text FROM part"),
}
