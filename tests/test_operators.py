"""Operators of the engine against fixtures with known results."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyrow.functions import codecs, colour, handlers, width
from tallyrow.operators import folds, ranking
from tallyrow.plans.query import Query
from tallyrow.sources import files, ssh_config
from tallyrow.streaming import agents, frames


@pytest.mark.parametrize(
    ("alphabet", "n", "want"),
    [("abcd", 3, "a b c"), ("abcd", 6, "a b c da db dc"), ("abcd", 8, "a b ca cb da db dc dd"), ("ab", 5, "aa ab ba bb"), ("abcd", 0, ""), ("abcd", 4, "a b c d")],
)
def test_labels(alphabet, n, want):
    assert ranking.labels(alphabet, n) == want.split()


def test_labels_are_prefix_free():
    for n in range(0, 30):
        got = ranking.labels("abcde", n)
        assert len(got) == min(n, 25) == len(set(got))
        assert not any(a != b and b.startswith(a) for a in got for b in got)
    assert len(ranking.labels("asdfqwerzxcvjklmiuopghtybn", 792)) == 676


def test_intervals_in_order_of_insertion():
    one = lambda *xs: [(x, x + 1) for x in xs]
    assert folds.inserted(one(1, 2, 4)) == [(1, 3), (4, 5)]
    assert folds.inserted([*one(1, 2, 4), (2, 6)]) == [(1, 6)]
    assert folds.inserted(one(2, 1)) == [(1, 2), (2, 3)]  # adjacency counts on the left only
    assert folds.inserted([(3, 3)]) == []


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [([(1, 15)], [(1, 10)], [(10, 15)]), ([(1, 10)], [(1, 15)], []), ([(1, 2), (3, 4), (5, 6)], [(2, 3), (4, 5), (6, 7)], [(1, 2), (3, 4), (5, 6)]), ([(1, 5), (8, 10)], [(3, 9)], [(1, 3), (9, 10)])],
)
def test_interval_difference(spark, a, b, want):
    from tallyrow.operators.lookups import QUERIES

    rows = [(1, lo, hi, side) for side, own in ((0, a), (1, b)) for lo, hi in own]
    df = spark.createDataFrame(rows, "k int, lo long, hi long, side int")
    text = QUERIES["interval_difference"].sql
    own = text[text.index("(SELECT l_suppkey") : text.index("FROM lineitem)") + len("FROM lineitem)")]
    df.createOrReplaceTempView("own_ranges")
    got = spark.sql(Query(text.replace(own, "(SELECT k, lo, hi, side FROM own_ranges)")).text(0)).collect()
    spark.catalog.dropTempView("own_ranges")
    # Pieces that touch come from the ends inside them.
    merged = []
    for r in sorted((r.lo, r.hi) for r in got):
        merged[-1:] = [(merged[-1][0], r[1])] if merged and merged[-1][1] == r[0] and not any(r[0] in x for x in want) else [*merged[-1:], r]
    assert merged == want


def test_throughput_windows():
    assert folds.windows([0, 0.4, 0.8, 1.2, 3, 3.5, 9], [1, 1, 1, 1, 1, 1, 1]) == [3, 1, 2]
    assert folds.windows([], []) == [] and folds.windows([5], [9]) == []


def test_rate_limit_halves():
    assert folds.admitted([0, 0, 1], [40, 10, 3], 16) == [10, 5, 3]
    assert folds.admitted([0, 0], [16, 1], 16) == [16, 0]


def test_cache_decays_and_evicts():
    c = folds.Cache(2)
    c.put("a")
    for _ in range(9):
        c.get("a")
    c.put("b")
    for _ in range(25):
        c.get("b")
    assert c.entries["a"][0] == 9
    assert c.put("c") == ["a"]  # 9 // ((36 - 10) // 10) = 4 is under 25
    assert c.get("a") is False and c.get("b") and c.get("c")


def test_logical_lines():
    rows = [(0, "ab", True), (1, "cd", False), (2, "e", False), (3, "x" * 600, True), (4, "y" * 600, True), (5, "z", False)]
    assert folds.logical(rows) == [(0, 1, "abcd"), (2, 2, "e"), (3, 3, "x" * 600), (4, 5, "y" * 600 + "z")]
    assert folds.logical([]) == []


def test_width():
    assert [width.text_width(x) for x in ("abc", "日本", "é", "é", "👍", "👍🏽", "❤️", "​", "")] == [3, 4, 1, 1, 2, 2, 2, 0, 0]
    assert width.kept_left("日本語", 5) == "日本" and width.kept_right("日本語", 5) == "本語"
    assert width.wrapped("日本語ab  ", 4) == ["日本", "語ab"] and width.wrapped("   ", 2) == ["   "]
    assert width.columns("a日b", 1, 3) == "日"


def test_table(spark):
    df = spark.createDataFrame([("a", "日本", 1), ("bcd", None, 22)], "x string, y string, z int")
    assert [r.line for r in width.table(df, {"x": "left", "y": "center", "z": "right"}).collect()] == ["a   日本  1", "bcd      22"]


@pytest.mark.parametrize("value", [{"a": 1, "b": [1, 2.5, "x y"], "c": {"d": "true", "e": {"f": ["g", "h"]}}, "it's": "#no"}, {"k": "1", "l": -3, "m": False}])
def test_nested_values(value):
    assert codecs.from_yaml(codecs.to_yaml(value)) == value
    import tomllib

    assert tomllib.loads(codecs.to_toml(value)) == value


def test_yaml_by_hand():
    assert codecs.from_yaml("# a theme\nname: 'it''s'\nlist:\n  - 1\n  - two words\nempty:\n") == {"name": "it's", "list": [1, "two words"], "empty": None}


def test_base91_and_unvis():
    rng = np.random.default_rng(1)
    seen = {codecs.base91(rng.bytes(n)) for n in range(0, 40)}
    assert len(seen) == 40 and codecs.base91(b"test") == "fPNKd" and codecs.base91(b"") == ""
    assert codecs.unvis_text(r"a\040b\\c\tx\^Id") == "a b\\c\tx\td" and codecs.unvis_text("a\\q") is None


def test_shell_words(spark):
    df = spark.createDataFrame([("a 'b c' \"d\"",), ("it's",), (None,)], "x string")
    assert [r.w for r in df.select(codecs.shell_split(F.col("x")).alias("w")).collect()] == [["a", "b c", "d"], None, None]


def test_links_longest_first(spark):
    df = spark.createDataFrame([("  http://example.com",), ("woot@example.com or a@b.org",), ("see (http://a.b/c) and [http://d.e/f]",), (None,), ("",)], "line string")
    got = {}
    for r in ranking.links(df, "line").collect():
        got.setdefault(r.line, []).append((r.place, r.link))
    assert sorted(got["  http://example.com"]) == [(0, "http://example.com")]
    assert [x for _, x in sorted(got["woot@example.com or a@b.org"])] == ["mailto:woot@example.com", "mailto:a@b.org"]
    assert "http://a.b/c" in [x for _, x in got["see (http://a.b/c) and [http://d.e/f]"]] and len(got) == 3


def test_spans(spark):
    df = spark.createDataFrame([("abcabc",), ("xx",), (None,)], "t string")
    assert [(r.lo, r.hi) for r in ranking.spans(df, "t", "b.").collect()] == [(1, 3), (4, 6)]


def test_distinct_colours():
    pool = [(50, 40, 0), (51, 41, 0), (60, 0, 60), (5, 50, 50), (50, 1, 1)]
    assert ranking.distinct_colours(pool, 30, (20, 90), 10, 3) == [(50, 40, 0), (60, 0, 60), (51, 41, 0)][:2] + ranking.distinct_colours(pool, 30, (20, 90), 10, 3)[2:]
    assert ranking.distinct_colours([], 30, (0, 100), 0, 3) == []


def test_colour_difference(spark):
    """Two pairs of the published table of the formula's test data."""
    for a, b, want in (((50, 2.6772, -79.7751), (50, 0, -82.7485), 2.0425), ((50, 2.5, 0), (73, 25, -18), 27.1492)):
        source = f"(SELECT {a[0]}e0 AS ll, {a[1]}e0 AS la, {a[2]}e0 AS lb, {b[0]}e0 AS ll2, {b[1]}e0 AS la2, {b[2]}e0 AS lb2)"
        assert spark.sql(f"SELECT de FROM {colour.delta_e(source)} AS x").first().de == pytest.approx(want, abs=1e-4)


def chunks():
    return [
        (1, 0, "output", "$ ls\r\n"), (1, 1, "output", "\x1b[1mClaude Code\x1b[0m v1"), (1, 2, "output", "Thinking..."), (1, 3, "output", "x" * 1100),
        (1, 4, "output", "Doyouwanttoproceed 1.Yes2.Yes"), (1, 5, "output", "more"), (1, 6, "exit", None), (1, 7, "remove", None), (1, 8, "output", "ls"),
        (2, 0, "output", "plain shell"), (3, 0, "output", "codex ready"), (3, 1, "output", "y" * 1100 + "applying patch Edit"), (None, 0, "output", None),
    ]


WANT = {
    (1, 0): None, (1, 1): "starting", (1, 2): "thinking", (1, 3): "thinking", (1, 4): agents.AWAITING, (1, 5): agents.AWAITING, (1, 6): "exited", (1, 7): None, (1, 8): None,
    (2, 0): None, (3, 0): "idle", (3, 1): "writing", (None, 0): None,
}


def test_agents(spark):
    df = spark.createDataFrame(chunks(), "pane long, seq long, kind string, text string")
    got = {(r.pane, r.seq): r for r in agents.batch(df, "pane").collect()}
    assert {k: r.state for k, r in got.items()} == WANT
    assert got[1, 4].prompt and not got[1, 5].prompt and got[1, 5].since == 4
    assert agents.batch(df.limit(0), "pane").count() == 0


def test_agents_stream(spark, tmp_path):
    conf = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.shuffle.partitions": "2"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    schema = "pane long, seq long, kind string, text string"
    rows = [r for r in chunks() if r[0] is not None]
    for i in range(2):  # two micro-batches: the state goes from one to the other
        spark.createDataFrame([r for r in rows if (r[1] > 3) == bool(i)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    query = agents.stream(source, "pane").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination(120)
    got = {(r.pane, r.seq): r.state for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == {k: v for k, v in WANT.items() if k[0] is not None}


def test_last_bytes():
    assert agents.last_bytes("aéb", 2) == "b" and agents.last_bytes("aéb", 3) == "éb" and agents.last_bytes("", 3) == ""


def test_frames(spark):
    data = frames.frame(1, 300, b"hello") + frames.frame(2, 4, b"", True)
    for cut in range(len(data) + 1):
        first, rest = frames.frames(data[:cut])
        more, left = frames.frames(rest + data[cut:])
        assert first + more == [(1, 300, False, b"hello"), (2, 4, True, b"")] and left == b""
    assert frames.control_events(["%begin 1 7 0", "a", "b", "%end 1 7 0", "%window-add @1", "%begin 1 8 0", "%error 1 8 0", "%begin 1 9 0"]) == [("reply", 7, "a\nb"), ("window-add", None, "@1"), ("error", 8, "")]
    assert frames.layout("b25d,80x24,0,0,5") == [(0, "pane", 80, 24, 0, 0, 5)]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one 1\ntwo\r\nthree 3\n")
    (tmp_path / "b.log").write_text("".join(f"line {i}\n" for i in range(503)))
    for folder in (".git", "target", "sub"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "c.txt").write_text("one 9\n")
    base = str(tmp_path)
    assert [(r.name, r["size"]) for r in files.listing(spark, base, "*.txt").collect()] == [("a.txt", 19)]
    assert [r.path for r in files.glob(spark, "*.log", base).collect()] == ["b.log"]
    last = files.numbered(spark, f"{base}/b.log").collect()[-1]
    assert (last.number, last.line) == (501, "... (3 more lines)")
    assert [r.line for r in files.lines(spark, f"{base}/a.txt").orderBy("number").collect()] == ["one 1", "two", "three 3"]
    hits = [r.hit.rsplit("/", 1)[1] for r in files.grep_folder(spark, base, r"one \d").collect()]
    assert sorted(hits) == ["a.txt:1: one 1", "c.txt:1: one 9"]
    assert files.grep(files.lines(spark, f"{base}/b.log"), "line").count() == 50
    assert files.grep(files.lines(spark, f"{base}/a.txt"), "one (").count() == 0


def test_recording(spark, tmp_path):
    df = spark.createDataFrame([(0.5, 'say "hi"\n'), (1.25, "\x1b[0m")], "at double, text string")
    body = [r.value for r in files.recorded(df, "at", "text").collect()]
    (tmp_path / "r.cast").write_text("\n".join([json.dumps({"version": 2}), *body, '[2.0,"i","no"]']) + "\n")
    header, events = files.recording(spark, str(tmp_path / "r.cast"))
    assert json.loads(header.first().header) == {"version": 2}
    assert [(r.seconds, r.text) for r in events.orderBy("number").collect()] == [(0.5, 'say "hi"\n'), (1.25, "\x1b[0m")]


def test_ssh_config(spark):
    text = 'User a\nHost x !y *.z\n  Port=22\n  port 23\n  IdentityFile "f g"\n  IdentityFile h\nInclude more\nMatch host x user bob\n  Compression yes\n# no\nBroken\n'
    got = ssh_config.parse(text, lambda name: f"Host {name}\nUser b\n")
    assert got == [(0, "all", "user", "a"), (1, "host x !y *.z", "port", "22"), (1, "host x !y *.z", "identityfile", "f g h"), (2, "host more", "user", "b"), (3, "host x user bob", "compression", "yes")]
    assert ssh_config.fits(["!y", "*"], "x") and not ssh_config.fits(["!y", "*"], "y") and not ssh_config.fits([], "x")
    assert ssh_config.criterion_fits("host x user bob", "x", "bob") and not ssh_config.criterion_fits("host x user bob", "x", "al")
    assert ssh_config.expand("%h:%p %% ${HOME}", {"%h": "x", "%p": "22", "HOME": "/h"}) == "x:22 % /h"


def test_handlers(spark):
    h, seen = handlers.Handlers(), []
    h.register("e", lambda x: seen.append(x))
    h.register("e", lambda x: False)
    h.register("e", lambda x: seen.append("never"))
    assert h.emit("e", 1) is False and seen == [1] and h.emit("none") is True
    name = h.callback(lambda x: x + 1)
    assert h.call(name, 2) == 3 and h.call("none") is None
    df, got = handlers.observed(spark.range(10), "seen", "id")
    df.collect()
    assert got.get["rows"] == 10
