"""Files as tables: listings, recordings, numbered text, searches in folders.

Paths are read by Spark's readers, so they may be in any store. A missing path is Spark's
own error; an empty folder gives an empty table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines of a file that are shown.
SHOWN = 500
#: Matches of a search that are listed.
MATCHES = 50
#: Folders that a search leaves out, besides hidden ones.
SKIPPED = ["node_modules", "target", "__pycache__"]


def listing(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """path, name, size and modified of the files of a folder whose names fit the pattern, by path; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    return files.select("path", name, F.col("length").alias("size"), F.col("modificationTime").alias("modified")).orderBy("path")


def glob(spark: SparkSession, pattern: str, base: str | None = None) -> DataFrame:
    """path of what fits the pattern, relative to base if one is given, in order."""
    whole = f"{base.rstrip('/')}/{pattern}" if base else pattern
    path = F.col("path")
    if base:
        path = F.regexp_replace(path, "^.*?" + re.escape(base.rstrip("/").split(":", 1)[-1].lstrip("/")) + "/", "")
    return spark.read.format("binaryFile").load(whole).select(path.alias("path")).orderBy("path")


def lines(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """path, number (from 1) and line of each line of the files; a file is one row at first, so files should be of moderate size."""
    files = spark.read.option("recursiveFileLookup", str(recursive).lower()).text(path, wholetext=True).withColumn("path", F.input_file_name())
    split = files.select("path", F.posexplode(split_lines(F.col("value"))).alias("number", "line"))
    return split.withColumn("number", F.col("number") + 1)


def split_lines(text: Column) -> Column:
    """Lines at line ends, any carriage returns before them included; a final one gives no empty line."""
    return F.split(F.regexp_replace(text, r"\r*\n\z", ""), r"\r*\n")


def numbered(spark: SparkSession, path: str, shown: int = SHOWN) -> DataFrame:
    """The first lines with their numbers, and a last row that says how many more there are."""
    all_ = lines(spark, path)
    first = all_.filter(F.col("number") <= shown)
    more = all_.groupBy("path").agg(F.count("*").alias("n")).filter(F.col("n") > shown)
    rest = more.select("path", F.lit(shown + 1).alias("number"), F.format_string("... (%d more lines)", F.col("n") - shown).alias("line"))
    return first.union(rest).orderBy("path", "number")


def grep(found: DataFrame, pattern: str, most: int = MATCHES) -> DataFrame:
    """hit (path:number: line) of the first lines of lines() that fit the pattern, in order; a pattern that isn't valid is looked for as it is."""
    try:
        re.compile(pattern)
        fits = F.col("line").rlike(pattern)
    except re.error:
        fits = F.contains(F.col("line"), F.lit(pattern))
    hits = found.filter(fits).orderBy("path", "number").limit(most)
    return hits.select(F.concat("path", F.lit(":"), "number", F.lit(": "), "line").alias("hit"))


def grep_folder(spark: SparkSession, folder: str, pattern: str, most: int = MATCHES) -> DataFrame:
    """grep() over a folder and what is below it, without hidden names and SKIPPED."""
    root = re.escape(folder.rstrip("/").split(":", 1)[-1].lstrip("/"))
    below = F.regexp_replace("path", f"^.*?{root}/", "")
    hidden = below.rlike(r"(^|/)(\.[^/]*|" + "|".join(SKIPPED) + r")(/|$)")
    return grep(lines(spark, folder, recursive=True).filter(~hidden), pattern, most)


def recording(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A terminal recording's headers (path and JSON) and its output events: path, number, seconds and text."""
    all_ = lines(spark, path)
    event = F.from_json("line", "array<string>")
    out = all_.filter("number > 1").select("path", "number", event.alias("e")).filter(F.col("e")[1] == "o")
    return all_.filter("number = 1").select("path", F.col("line").alias("header")), out.select("path", "number", F.col("e")[0].cast("double").alias("seconds"), F.col("e")[2].alias("text"))


def recorded(events: DataFrame, seconds: str, text: str) -> DataFrame:
    """Lines of a recording: [seconds, "o", text], in order of time. Write them behind a header as text."""
    said = F.regexp_extract(F.to_json(F.array(F.col(text))), r"(?s)^\[(.*)\]$", 1)
    return events.orderBy(seconds).select(F.concat(F.lit("["), F.col(seconds).cast("string"), F.lit(',"o",'), said, F.lit("]")).alias("value"))
