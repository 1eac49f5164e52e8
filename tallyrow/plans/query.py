"""Queries as SQL text that runs on Spark and, for comparison, on another ANSI engine."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tallyrow.plans.shipping import ship

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: What differs between the two dialects: in Spark, elsewhere.
DIALECT = {
    r"\bRX'": ("r'", "'"),
    r"\bMATCHES\(": ("regexp_like(", "regexp_matches("),
    r"\bSIZE\(": ("size(", "len("),
    r"\bIDIV\b": ("div", "//"),
    r"\bSTARTS\(": ("startswith(", "starts_with("),
    r"\bMICROS\(": ("unix_micros(timestamp ", "epoch_us("),
    r"\bTS_MICROS\b": ("unix_micros(cast(ts AS timestamp))", "epoch_us(ts)"),
    r"\bSERIES\(": ("explode(sequence(", "unnest(generate_series("),
    r"\bREPLACE_ALL\((.*?), (RX'(?:[^']|'')*'), ('[^']*')\)": (r"regexp_replace(\1, \2, \3)", r"regexp_replace(\1, \2, \3, 'g')"),
    r"\bBYTES\(": ("octet_length(", "strlen("),
    r"\bTEXTAGG\((.*?); (.*?); (.*?)\)": (r"listagg(\1, \2) WITHIN GROUP (ORDER BY \3)", r"string_agg(\1, \2 ORDER BY \3)"),
    r"\bUNNEST_ALL\(": ("explode(", "unnest("),
    r"\bALL_MATCHES\(": ("regexp_extract_all(", "regexp_extract_all("),
    r"\bLAMBDA (\w+) -> ": (r"\1 -> ", r"lambda \1: "),
    r"\bTRANSFORM\(": ("transform(", "list_transform("),
    r"\bFILTER_LIST\(": ("filter(", "list_filter("),
    r"\{lines\}": (
        r"(SELECT doc_id, pos AS row, line FROM documents LATERAL VIEW posexplode(split(text, '\n')) AS pos, line)",
        "(SELECT doc_id, unnest(range(len(string_split(text, chr(10)))))::INT AS row, unnest(string_split(text, chr(10))) AS line FROM documents)",
    ),
}

#: A table that a text reads; one without an alias keeps its name.
_TABLE = re.compile(rf"\b(FROM|JOIN)\s+({'|'.join(TABLES)})\b(?!\s*\.)()")


@dataclass(frozen=True)
class Frame:
    """A plan written with DataFrames: run(read), where read(name) is a table; other: SQL for the other engine, if there is any."""

    run: Callable[[Callable[[str], DataFrame]], DataFrame]
    other: str | None = None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return self.run(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

    @property
    def oracle(self) -> str | None:
        return self.other and Query(self.other).text(1)


@dataclass(frozen=True)
class Query:
    """A named plan; other: the text for the other engine where placeholders don't cover the difference."""

    sql: str
    other: str | None = None

    def text(self, which: int) -> str:
        out = self.other if which and self.other else self.sql
        # Replacement of calls first: its pattern contains the marker of a raw string.
        for marker in sorted(DIALECT, key=lambda m: "REPLACE" not in m):
            new = DIALECT[marker][which]
            out = re.sub(marker, new if re.search(r"\\[1-9]", new) else (lambda m, n=new: n), out)
        return out

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(_TABLE.sub(lambda m: f"{m[1]} parquet.`{sf_dir}/{m[2]}.parquet`{m[3]}", self.text(0)))

    def on(self, **tables: DataFrame) -> DataFrame:
        """The same plan over the caller's own DataFrames, by the names and columns that the text uses."""
        spark, tag = next(iter(tables.values())).sparkSession, uuid.uuid4().hex[:8]
        for name, df in tables.items():
            df.createOrReplaceTempView(f"{name}_{tag}")
        try:
            return spark.sql(_TABLE.sub(lambda m: f"{m[1]} {m[2]}_{tag}{m[3]}", self.text(0)))
        finally:
            for name in tables:
                spark.catalog.dropTempView(f"{name}_{tag}")

    @property
    def oracle(self) -> str:
        return self.text(1)
