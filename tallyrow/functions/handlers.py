"""Extension points: handlers of named events, metrics of a plan, sources and parsers of one's own.

Handlers run on the driver in the order in which they were registered, as they change
what the driver does; functions of columns are registered with Spark itself. A source is
any class with Spark's DataSource interface, a parser any table function.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tallyrow.plans.query import Frame, Query


class Handlers:
    """Handlers by the name of their event."""

    def __init__(self):
        self._by_name: dict[str, list[Callable]] = defaultdict(list)
        self._callbacks = 0

    def register(self, name: str, handler: Callable) -> None:
        self._by_name[name].append(handler)

    def emit(self, name: str, *args: object) -> bool:
        """Runs all handlers in order until one returns False; whether the default should follow."""
        return all(handler(*args) is not False for handler in self._by_name[name])

    def call(self, name: str, *args: object) -> object:
        """The first handler's result; None without one."""
        return self._by_name[name][0](*args) if self._by_name[name] else None

    def callback(self, handler: Callable) -> str:
        """Registers a handler under a name of its own."""
        self._callbacks += 1
        self.register(name := f"callback-{self._callbacks}", handler)
        return name


def observed(df: DataFrame, name: str, key: str) -> tuple[DataFrame, object]:
    """df, and an Observation that holds its rows and distinct keys once df has run."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), F.approx_count_distinct(key).alias("keys")), seen


class Rows(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class PaneSource(DataSource):
    """Rows of a made-up screen: options rows, per_task and text, of which %d is the row's number."""

    @classmethod
    def name(cls) -> str:
        return "pane"

    def schema(self) -> str:
        return "row long, text string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(int(self.options.get("rows", 24)), int(self.options.get("per_task", 1000)), self.options.get("text", "row %d"))


class _Reader(DataSourceReader):
    def __init__(self, rows: int, per_task: int, text: str):
        self.rows, self.per_task, self.text = rows, per_task, text

    def partitions(self) -> list[InputPartition]:
        return [Rows(a, min(a + self.per_task, self.rows)) for a in range(0, self.rows, self.per_task)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        for i in range(partition.first, partition.last):
            yield i, self.text.replace("%d", str(i))


def register_source(spark: SparkSession, source: type[DataSource] = PaneSource) -> None:
    spark.dataSource.register(source)


@F.udtf(returnType="kind: string, text: string")
class ParseLine:
    """A line's runs of printable text and its control characters."""

    def eval(self, line: str):
        held = ""
        for c in line or "":
            if c.isprintable():
                held += c
                continue
            if held:
                yield "print", held
            held = ""
            yield "control", f"{ord(c):02x}"
        if held:
            yield "print", held


def _pane(t):
    spark = t("nation").sparkSession
    register_source(spark)
    return spark.read.format("pane").option("rows", 50).option("per_task", 20).option("text", "line %d").load()


def _parsed(t):
    spark = t("nation").sparkSession
    spark.udtf.register("parse_line", ParseLine)
    return spark.sql("SELECT n_nationkey, p.kind, p.text FROM {nation} AS n, LATERAL parse_line(concat(n_name, chr(9), 'x')) AS p", nation=t("nation"))


QUERIES = {
    # E06; E07
    "pane_source": Frame(_pane, "SELECT i AS row, 'line ' || i AS text FROM (SELECT unnest(range(50)) AS i) AS x"),
    "parsed_lines": Frame(_parsed, "SELECT n_nationkey, unnest(['print', 'control', 'print']) AS kind, unnest([n_name, '09', 'x']) AS text FROM nation"),
    # Rates, histograms and counters in one report, by key.
    "metrics_report": Query(
        """SELECT 'counter' AS kind, event_type AS name, CAST(count(*) AS DOUBLE) AS a, CAST(sum(user_id) AS DOUBLE) AS b FROM events GROUP BY event_type
        UNION ALL SELECT 'rate' AS kind, event_type AS name, CAST(count(*) AS DOUBLE) AS a, CAST(count(DISTINCT CAST(ts AS DATE)) AS DOUBLE) AS b FROM events GROUP BY event_type
        UNION ALL SELECT 'histogram' AS kind, event_type AS name, min(value) AS a, max(value) AS b FROM events GROUP BY event_type"""
    ),
}
