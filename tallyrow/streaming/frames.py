"""Frames and control lines that arrive in pieces.

A frame is its length, a serial number and a kind (each as LEB128) and a body of the
length less the other two; the top bit of the length's number marks a compressed body,
which is given as it is. What remains of a key's bytes after the last whole frame is kept.

Control lines are %begin, %end and %error with a time, a number and flags around the
lines of a reply, and notifications that begin with a per cent sign.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrow.operators.folds import folded
from tallyrow.plans.query import Frame

COMPRESSED = 1 << 63


def leb128(n: int) -> bytes:
    out = bytearray()
    while True:
        low, n = n & 127, n >> 7
        out.append(low | (128 if n else 0))
        if not n:
            return bytes(out)


def read_leb128(data: bytes, at: int) -> tuple[int, int] | None:
    """The number at a place, and the place behind it; None if it isn't whole."""
    n = shift = 0
    while at < len(data):
        n |= (data[at] & 127) << shift
        at += 1
        if not data[at - 1] & 128:
            return n, at
        shift += 7
    return None


def frame(serial: int, kind: int, body: bytes, compressed: bool = False) -> bytes:
    tail = leb128(serial) + leb128(kind) + body
    return leb128(len(tail) | (COMPRESSED if compressed else 0)) + tail


def frames(data: bytes) -> tuple[list[tuple[int, int, bool, bytes]], bytes]:
    """serial, kind, compressed and body of each whole frame, and the bytes behind the last."""
    out, at = [], 0
    while head := read_leb128(data, at):
        size, begin = head[0] & ~COMPRESSED, head[1]
        if begin + size > len(data):
            break
        serial = read_leb128(data[: begin + size], begin)
        kind = serial and read_leb128(data[: begin + size], serial[1])
        if not kind:
            raise ValueError("a frame is shorter than its head")
        out.append((serial[0], kind[0], bool(head[0] & COMPRESSED), data[kind[1] : begin + size]))
        at = begin + size
    return out, data[at:]


def decode(df: DataFrame, key: str, order: str, chunk: str) -> DataFrame:
    """key, place, serial, kind, compressed, body of each frame in each key's chunks in order."""

    def run(rows: pd.DataFrame) -> list[tuple]:
        held, out = b"", []
        for x in rows[chunk]:
            got, held = frames(held + bytes(x or b""))
            out += got
        return [(i, *f) for i, f in enumerate(out)]

    return folded(df.select(key, order, chunk), key, [order], run, "place long, serial long, kind long, compressed boolean, body binary")


def stream(df: DataFrame, key: str, order: str, chunk: str) -> DataFrame:
    """The same of a stream; the bytes of a frame that isn't whole yet are kept as state."""
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Frames(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.held = handle.getValueState("rest", "rest binary")

        def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
            rest = bytes(self.held.get()[0]) if self.held.exists() else b""
            got = pd.concat(list(rows)).sort_values(order, kind="stable")
            out, rest = frames(rest + b"".join(bytes(x or b"") for x in got[chunk]))
            self.held.update((rest,))
            names = ["serial", "kind", "compressed", "body"]
            own = pd.DataFrame(out, columns=names)
            own.insert(0, "pane", key[0])
            yield own

        def close(self) -> None:
            pass

    kind = df.schema[key].dataType.simpleString()
    return df.groupBy(key).transformWithStateInPandas(Frames(), f"pane {kind}, serial long, kind long, compressed boolean, body binary", "Append", "None")


_GUARD = re.compile(r"%(begin|end|error) (-?\d+) (\d+) (\d+)$")


def control_events(lines: list[str]) -> list[tuple[str, int | None, str]]:
    """event, number and text: a reply with its lines joined, or a notification's name with the rest of its line."""
    out, number, held = [], None, []
    for line in lines:
        guard = _GUARD.match(line)
        if guard and guard[1] == "begin":
            number, held = int(guard[3]), []
        elif guard and number == int(guard[3]):
            out.append(("error" if guard[1] == "error" else "reply", number, "\n".join(held)))
            number = None
        elif number is not None:
            held.append(line)
        elif line.startswith("%"):
            name, _, rest = line[1:].partition(" ")
            out.append((name, None, rest))
    return out


def control(df: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """key, place, event, number, text of each key's lines in order."""
    return folded(df.select(key, order, line), key, [order], lambda rows: [(i, *e) for i, e in enumerate(control_events([x or "" for x in rows[line]]))], "place long, event string, number long, text string")


def layout(text: str) -> list[tuple[int, str, int, int, int, int, int | None]]:
    """depth, kind (pane, columns or rows), width, height, left, top and pane of each node of a layout: a checksum, then size, place and what is inside."""
    body = text.split(",", 1)[1] if re.match(r"[0-9a-f]{4},", text) else text
    out, depth = [], 0
    for m in re.finditer(r"(\d+)x(\d+),(\d+),(\d+)(?:,(\d+))?(?=([{\[]?))|[}\]]", body):
        if m[1] is None:
            depth -= 1
            continue
        kind = {"{": "columns", "[": "rows"}.get(m[6], "pane")
        out.append((depth, kind, *(int(m[i]) for i in range(1, 5)), int(m[5]) if m[5] and kind == "pane" else None))
        depth += kind != "pane"
    return out


def layouts(df: DataFrame, key: str, text: str) -> DataFrame:
    """key and the nodes of each layout, in order."""
    schema = "array<struct<depth:int,kind:string,width:int,height:int,left:int,top:int,pane:int>>"

    @F.pandas_udf(schema)
    def parsed(x: pd.Series) -> pd.DataFrame:
        names = ["depth", "kind", "width", "height", "left", "top", "pane"]
        return x.map(lambda s: [dict(zip(names, n, strict=True)) for n in layout(s)] if s else [])

    return df.select(key, F.posexplode(parsed(F.col(text))).alias("place", "n")).select(key, "place", "n.*")


def _chunks(t):
    @F.pandas_udf("binary")
    def framed(serial: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([frame(int(n), len(x), x.encode()) for n, x in zip(serial, text, strict=True)])

    whole = t("events").select("user_id", "event_id", framed("event_id", "event_type").alias("f"))
    cut = F.array(F.struct((F.col("event_id") * 2).alias("o"), F.substring("f", 1, 3).alias("c")), F.struct((F.col("event_id") * 2 + 1).alias("o"), F.expr("substring(f, 4)").alias("c")))
    return whole.select("user_id", F.explode(cut).alias("x")).select("user_id", "x.o", "x.c")


QUERIES = {
    # S14
    "frames": Frame(lambda t: decode(_chunks(t), "user_id", "o", "c").select("user_id", "place", "serial", F.decode("body", "UTF-8").alias("body")), "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place, event_id AS serial, event_type AS body FROM events"),
    # S15
    "control_lines": Frame(
        lambda t: control(t("events").select("user_id", F.posexplode(F.array(F.format_string("%%begin 1 %d 0", "event_id"), F.col("event_type"), F.format_string("%%end 1 %d 0", "event_id"), F.lit("%exit now"))).alias("i", "line"), (F.col("event_id") * 4 + F.col("i")).alias("o")), "user_id", "o", "line").select("user_id", "event", "number", "text"),
        "SELECT user_id, unnest(['reply', 'exit']) AS event, unnest([event_id, NULL]) AS number, unnest([event_type, 'now']) AS text FROM events",
    ),
    # S16
    "layouts": Frame(lambda t: layouts(t("nation").select("n_nationkey", F.format_string("bb62,%dx40,0,0{80x40,0,0,1,79x40,81,0[79x20,81,0,2,79x19,81,21,3]}", F.col("n_nationkey") + 160).alias("l")), "n_nationkey", "l"), "SELECT n_nationkey, unnest([0, 1, 2, 3, 4]) AS place, unnest([0, 1, 1, 2, 2]) AS depth, unnest(['columns', 'pane', 'rows', 'pane', 'pane']) AS kind, unnest([n_nationkey + 160, 80, 79, 79, 79]) AS width, unnest([40, 40, 40, 20, 19]) AS height, unnest([0, 0, 81, 81, 81]) AS \"left\", unnest([0, 0, 0, 0, 21]) AS top, unnest([NULL, 1, NULL, 2, 3]) AS pane FROM nation"),
}
