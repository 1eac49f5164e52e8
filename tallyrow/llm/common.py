"""What the pipeline operators share: scratch tables, size-checked joins, word arrays."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REPO = str(Path(__file__).resolve().parents[2])
#: A table is broadcast only if it has at most so many rows (rows here are narrow: under 200 bytes).
BROADCAST_ROWS = 200_000
#: A bitmap of keys has 1 << BITMAP words of 64 bits, whatever the number of keys.
BITMAP = 16


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; one of our own only where that is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        where = "file://" + tempfile.mkdtemp(prefix="tallyrow-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: Python workers give large freed blocks back, so that one that waits for its next task takes less of an executor's memory.
WORKER = {"MALLOC_MMAP_THRESHOLD_": "8388608", "MALLOC_TRIM_THRESHOLD_": "33554432", "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}


#: Settings of Arrow batches where they are as Spark has them: theirs, and ours. Texts are long rows, and a batch of 10,000 takes much memory on both sides.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000")}


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package when it isn't installed on them, and sets WORKER for them."""
    env = spark.sparkContext.environment
    if REPO not in env.get("PYTHONPATH", ""):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (REPO, env.get("PYTHONPATH", "")) if x)
    for k, v in WORKER.items():
        env.setdefault(k, v)
    for k, (default, own) in BATCH.items():
        if spark.conf.get(k, default) == default:
            spark.conf.set(k, own)


def give_back() -> None:
    """Returns memory that this process has freed to the system, where the C library can."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def trim_driver(spark: SparkSession) -> str:
    """Returns native memory that the driver's JVM has freed (its compiler takes most of it) to the system; says what came of it, nothing where the JVM has no such command."""
    jvm = spark.sparkContext._jvm
    kind = lambda name: jvm.java.lang.Class.forName(name)
    types, args = spark.sparkContext._gateway.new_array(jvm.java.lang.Class, 4), spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
    types[0], types[1], types[2], types[3] = (kind(x) for x in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"))
    try:
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # By the interface's method: the server's own class can't be called from outside its module.
        return str(kind("javax.management.MBeanServer").getMethod("invoke", types).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args))
    except Py4JError:
        return ""


def trim_executors(spark: SparkSession) -> None:
    """Lets the JVM of each executor collect its garbage, after which it returns heap that it doesn't use to the system. Else a heap stays as large as the stage before made it, beside the Python workers of the next."""
    n = spark.sparkContext.defaultParallelism  # a task for each core
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')")).collect()


def freeing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run for mapInArrow; a worker that waits for its next task then holds little memory of the last one."""

    def freed(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return freed


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _file_system(spark: SparkSession, path: str):
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df written as a table in the shared folder and read again: lineage ends there, so a lost executor costs no recomputation.

    The table goes with discard(), at the latest when the driver ends.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    jpath, fs = _file_system(spark, path)
    fs.deleteOnExit(jpath)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes staged tables that nothing reads any more."""
    for t in tables:
        if t is not None and getattr(t, "staged_at", None):
            jpath, fs = _file_system(t.sparkSession, t.staged_at)
            fs.delete(jpath, True)


def stored(table: DataFrame) -> int:
    """Bytes of a staged table's files."""
    jpath, fs = _file_system(table.sparkSession, table.staged_at)
    return fs.getContentSummary(jpath).getLength()


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to; else they stay until the driver happens to collect its garbage.

    Each of many plans also leaves memory that the driver's JVM has freed and not given back.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim_driver(spark)
    give_back()


def packed(docs: DataFrame) -> Column:
    """All columns of docs as one struct, so that no name can clash; unpacked by select("_doc.*")."""
    return F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in docs.columns)).alias("_doc")


def marked(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """rows with _maybe: false if the row's key (a long hash) can't be among those of keys (staged).

    The keys are put in a bitmap of 2 ** 22 bits, at most 1 << BITMAP rows of two longs,
    which is what is broadcast whatever their number. More keys set more bits, so that
    fewer rows are told apart; the exact join of the rows that are left decides.
    """
    word, bit = F.shiftrightunsigned(F.col(key), 64 - BITMAP), F.expr(f"shiftleft(1L, cast(`{key}` & 63L AS int))")
    bitmap = keys.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    found = rows.join(F.broadcast(bitmap), word == F.col("_word"), "left")
    return found.withColumn("_maybe", F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))).drop("_word", "_bits")


def join_small(left: DataFrame, small: DataFrame, keys: list[str], how: str = "left", salt: Column | None = None, salts: int = 16, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Null-safe join of left with small (unique keys, cheap to count: a staged table).

    small is broadcast if it has at most limit rows. Beyond that both sides are
    shuffled, left rows dealt over salts copies of each small row, so that a hot key
    is never in one task.
    """
    small = small.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(c for c in small.columns if c not in keys))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    drop = [f"_k{i}" for i in range(len(keys))]
    if small.count() <= limit:
        out = left.join(F.broadcast(small), on, how)
    else:
        left = left.withColumn("_s", F.pmod(F.hash(salt if salt is not None else F.rand(7)), F.lit(salts)))
        small = small.withColumn("_ks", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        out, drop = left.join(small, [*on, F.col("_s") == F.col("_ks")], how), [*drop, "_s", "_ks"]
    return out.drop(*drop)


def space_words(text: str) -> str:
    """SQL for the words [^\\x20\\x09-\\x0D]+ of a text; null: none."""
    return f"filter(split(coalesce({text}, ''), '[\\\\x20\\\\x09-\\\\x0D]+'), x -> x <> '')"


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def alnum_words(text: str) -> str:
    """SQL for the words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text with A-Z lower-cased; null: none."""
    return f"filter(split(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '[\\\\x00-\\\\x2F\\\\x3A-\\\\x60\\\\x7B-\\\\x7F]+'), x -> x <> '')"


def remainder(doc_id: Column, m: int) -> Column:
    """crc32(doc_id as text) mod m; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % m


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
