"""State of a program in each pane, told from its output, as a stream and as a batch.

Output is stripped of escape sequences and kept in a window of the last 32 KiB for each
key. A program is recognised once, by the first pattern that fits, and keeps its type;
its state is classified anew with each chunk from the last 1 KiB. Entering the state of
awaiting approval asks for it once. A chunk may instead end a pane's program or remove
the pane.

The fold of one key's chunks is Pane; batch() runs it over a table, stream() keeps it as
Spark state between micro-batches. Null text is an empty chunk; a null key is a pane of
its own; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrow.operators.folds import folded
from tallyrow.plans.query import Frame, Query

WINDOW, RECENT, TAIL, PROMPT = 32768, 4096, 1024, 2048

# Escape sequences, and the patterns of both programs, in order of trial.
ESCAPES = re.compile(r"\x1b\[[\x20-\x3f]*[a-zA-Z@-~]|\x1b\][^\x07\x1b]*(?:\x07|\x1b\\)|\x1b[()][0-9A-B]|\x1b[=>Nc78]|\x07|\r")
FIRST = {
    "startup": r"(?i)claude[\s_-]*code|╭─.*claude|Claude Code",
    "permission": r"(?i)Do\s*you\s*want\s*to\s*proceed|Yes,?\s*and\s*don.?t\s*ask\s*again|don.?taskagain|1\.?\s*Yes\s*2\.?\s*Yes|allowtool",
    "tool_use": r"[╭╰│├┤┬┴┼─]",
    "thinking": r"(?i)thinking|Thinking\.\.\.|processing|generating",
    "idle": r"(?m)^>\s*$|╰─.*$|Tokens remaining",
    "error": r"(?i)error|Error:|failed|panic|FATAL|aborted|timed? ?out",
    "tool_name": r"(?i)(Read|Edit|Write|Bash|Glob|Grep|WebFetch|WebSearch|Task|NotebookEdit)\b",
}
SECOND = {
    "startup": r"(?i)codex|openai",
    "error": r"(?i)error|failed|aborted",
    "thinking": r"(?i)thinking|processing|searching",
    "writing": r"(?i)writing|editing|applying|patching",
    "idle": r"(?i)ready|waiting|idle|\$\s*$",
}
_FIRST, _SECOND = ({k: re.compile(p) for k, p in x.items()} for x in (FIRST, SECOND))
AWAITING = "awaiting-approval"


def last_bytes(text: str, n: int) -> str:
    """The last n bytes of a text, from the next character's start on."""
    data = text.encode()
    if len(data) <= n:
        return text
    at = len(data) - n
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return data[at:].decode()


class Pane:
    """What is known of one pane."""

    def __init__(self, text: str = "", kind: str | None = None, state: str | None = None, tool: str | None = None, since: int | None = None):
        self.text, self.kind, self.state, self.tool, self.since = text, kind, state, tool, since

    def dump(self) -> str:
        return json.dumps([self.text, self.kind, self.state, self.tool, self.since])

    def _enter(self, state: str, at: int) -> None:
        if state != self.state:
            self.state, self.since = state, at

    def push(self, chunk: str | None, at: int) -> str | None:
        """Takes a chunk of output; the prompt, if it asks for approval now."""
        self.text = last_bytes(self.text + ESCAPES.sub("", chunk or ""), WINDOW)
        recent, before = last_bytes(self.text, RECENT), self.state
        if self.kind is None:
            self.kind = next((k for k, p in (("first", _FIRST), ("second", _SECOND)) if p["startup"].search(recent)), None)
            if self.kind:
                self._enter("starting", at)
        if self.kind:
            (self._first if self.kind == "first" else self._second)(last_bytes(recent, TAIL), at)
        return last_bytes(self.text, PROMPT) if self.state == AWAITING and before != AWAITING else None

    def _first(self, tail: str, at: int) -> None:
        if m := _FIRST["tool_name"].search(tail):
            self.tool = m[0]
        has = {k: bool(p.search(tail)) for k, p in _FIRST.items()}
        rules = [
            (has["permission"] and not has["idle"], AWAITING),
            (has["error"] and not has["tool_use"], "errored"),
            (has["thinking"], "thinking"),
            (has["tool_use"] and not has["permission"], "writing"),
            (has["idle"], "idle"),
        ]
        if state := next((s for ok, s in rules if ok), None):
            self._enter(state, at)

    def _second(self, tail: str, at: int) -> None:
        names = {"error": "errored", "thinking": "thinking", "writing": "writing", "idle": "idle"}
        if state := next((s for k, s in names.items() if _SECOND[k].search(tail)), None):
            self._enter(state, at)

    def exit(self, at: int) -> None:
        if self.kind:
            self._enter("exited", at)


def fold(pane: Pane, rows: list[tuple]) -> tuple[Pane, list[tuple]]:
    """rows: seq, kind (output, exit or remove), text. The pane after them, and for each row seq, program, state, tool, since, prompt."""
    out = []
    for seq, kind, text in rows:
        prompt = None
        if kind == "remove":
            pane = Pane()
        elif kind == "exit":
            pane.exit(seq)
        else:
            prompt = pane.push(text, seq)
        out.append((seq, pane.kind, pane.state, pane.tool, pane.since, prompt))
    return pane, out


_OUT = "seq long, program string, state string, tool string, since long, prompt string"


def batch(df: DataFrame, key: str, seq: str = "seq", kind: str = "kind", text: str = "text") -> DataFrame:
    """key and the state after each row of df."""
    rows = df.select(key, F.col(seq).cast("long").alias("seq"), F.col(kind).alias("kind"), F.col(text).alias("text"))
    return folded(rows, key, ["seq"], lambda x: fold(Pane(), list(zip(x["seq"].tolist(), x["kind"], x["text"], strict=True)))[1], _OUT)


def stream(df: DataFrame, key: str) -> DataFrame:
    """The same of a stream with the columns key, seq, kind and text; a pane's state goes when it is removed."""
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Panes(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.held = handle.getValueState("pane", "dump string")

        def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
            pane = Pane(*json.loads(self.held.get()[0])) if self.held.exists() else Pane()
            got = pd.concat(list(rows)).sort_values("seq", kind="stable")
            pane, out = fold(pane, list(zip(got["seq"].tolist(), got["kind"], got["text"], strict=True)))
            if pane.kind is None and not pane.text:
                self.held.clear()
            else:
                self.held.update((pane.dump(),))
            frame = pd.DataFrame(out, columns=[c.split(" ")[0] for c in _OUT.split(", ")])
            frame.insert(0, "pane", key[0])
            yield frame

        def close(self) -> None:
            pass

    kind = df.schema[key].dataType.simpleString()
    return df.groupBy(key).transformWithStateInPandas(Panes(), f"pane {kind}, {_OUT}", "Append", "None")


def status(program: str, state: str, tool: str) -> str:
    """SQL: program, state and, in parentheses, the last tool."""
    return f"concat({program}, ' ', {state}, CASE WHEN {tool} IS NULL THEN '' ELSE concat(' (', {tool}, ')') END)"


def _chunks(t):
    """Turns of conversations as output of panes: they begin with a banner, then say what a program would."""
    said = F.expr(
        """CASE turn % 6 WHEN 0 THEN concat('Claude Code ', text) WHEN 1 THEN 'Thinking...' WHEN 2 THEN 'Do you want to proceed 1. Yes'
        WHEN 3 THEN repeat('x', 1100) WHEN 4 THEN 'error: no' ELSE text END"""
    )
    return t("conversations").select("conv_id", F.col("turn").alias("seq"), F.when(F.col("turn") % 11 == 10, "exit").otherwise("output").alias("kind"), said.alias("text"))


QUERIES = {
    # The state after each chunk.
    "agent_states": Frame(lambda t: batch(_chunks(t), "conv_id").select("conv_id", "seq", "program", "state", "tool", "since", F.length("prompt").alias("prompt_size"))),
    # F22
    "agent_status": Query(f"SELECT conv_id, turn, {status('role', chr(39) + 'idle' + chr(39), 'tool')} AS status FROM (SELECT conv_id, turn, role, CASE WHEN turn % 2 = 0 THEN 'Read' END AS tool FROM conversations) AS c"),
    # The last 32768 bytes of what each key said, whole characters.
    "recent_text": Frame(lambda t: folded(t("conversations").select("conv_id", "turn", "text"), "conv_id", ["turn"], lambda rows: [(last_bytes("".join(x or "" for x in rows["text"]), WINDOW),)], "recent string"), "SELECT conv_id, string_agg(text, '' ORDER BY turn) AS recent FROM conversations GROUP BY conv_id HAVING sum(strlen(text)) <= 32768"),
}
