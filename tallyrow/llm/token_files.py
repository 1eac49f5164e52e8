"""Token ids as Parquet list columns, written in ascending doc_id order and read selectively.

write(): rows are range-partitioned and sorted by (doc_id, hash of the text), encoded
batch by batch and written by Spark's Parquet writer, one file for each range of about
FILE bytes of text, in order: doc_id, n_tokens and ids (list of int32). Dictionary encoding suits ids of a small
vocabulary and delta encoding those of a large one; row groups and pages are small and
carry column and offset indexes, so a read of few documents or of the metadata alone
touches few pages. metadata() gives the rows with the number of ids before each and reads
no ids; read() adds the ids, of a range of documents if asked for one.

Partial sums run inside a file; the sums of whole files (one number each) are added up
on the driver, and sent back as a row for each file.

Nulls: a null text is empty, so it has the end id only; a null id sorts first. Rows that
repeat an id are all written, next to each other. An empty table gives no rows. A very
long text is one row of any length. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyrow.llm.bytescan import texts_of
from tallyrow.llm.common import documents, scratch, ship
from tallyrow.llm.tokens import END, crc, default_path, encoder

ROW_GROUP = 16 << 20
PAGE = 256 << 10
FILE = 32 << 20


def _encode(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):  # ids take several times the place of their text
                part = batch.slice(at, 1000)
                ids, bounds = e.encode_batch(*texts_of(part, "text"), end)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(bounds), pa.int64()), lists], ["doc_id", "n_tokens", "ids"])

    return run


def write(docs: DataFrame, to: str, tokenizer: str | None = None, end: int = END, encoding: str = "dictionary", row_group: int = ROW_GROUP, page: int = PAGE, file: int = FILE) -> None:
    """encoding: dictionary or delta."""
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = docs.select("doc_id", "text").repartitionByRange(max(1, -(-size // file)), F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    out = rows.mapInArrow(_encode(tokenizer or default_path(), end), f"doc_id {kind}, n_tokens long, ids array<int>")
    options = {"parquet.block.size": row_group, "parquet.page.size": page, "parquet.enable.dictionary": str(encoding == "dictionary").lower(), "parquet.writer.version": "PARQUET_1_0" if encoding == "dictionary" else "PARQUET_2_0", "compression": "zstd"}
    out.write.options(**{k: str(v) for k, v in options.items()}).parquet(to)


def _rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files with _f, the number of their file, and _n, their place in it."""
    file = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int")
    return spark.read.parquet(path).withColumns({"_f": file, "_n": F.col("_metadata.row_index")})


def _placed(rows: DataFrame, path: str) -> DataFrame:
    """rows (doc_id, _f, _n, n_tokens and others) with start."""
    spark = rows.sparkSession
    totals = sorted((r["_f"], r.n) for r in _rows(spark, path).groupBy("_f").agg(F.sum("n_tokens").alias("n")).collect())
    before, at = [], 0
    for f, n in totals:
        before.append((f, at))
        at += n
    files = F.broadcast(spark.createDataFrame(before, "_g int, _before long"))  # a row for each file
    w = Window.partitionBy("_f").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("_own", F.coalesce(F.sum("n_tokens").over(w), F.lit(0))).join(files, F.col("_f") == F.col("_g"))
    return out.withColumn("start", F.col("_before") + F.col("_own")).drop("_own", "_g", "_before")


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens in no set order; start counts the ids of all documents before. Reads no ids."""
    return _placed(_rows(spark, path).select("doc_id", "n_tokens", "_f", "_n"), path).select("doc_id", "start", "n_tokens")


def read(spark: SparkSession, path: str, first: object = None, last: object = None) -> DataFrame:
    """doc_id, start, n_tokens, ids, of the documents from first to last if given.

    Places come from n_tokens alone; only the wanted rows' ids are read, by the bounds of
    row groups and pages, and joined.
    """
    rows = _rows(spark, path)
    for bound, is_wanted in ((first, F.col("doc_id") >= F.lit(first)), (last, F.col("doc_id") <= F.lit(last))):
        rows = rows if bound is None else rows.filter(is_wanted)
    placed = _placed(_rows(spark, path).select("doc_id", "n_tokens", "_f", "_n"), path).select("_f", "_n", "start")
    return rows.join(placed, ["_f", "_n"]).select("doc_id", "start", "n_tokens", "ids")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        flat, bounds = ids.values.to_numpy(zero_copy_only=False).view(np.uint32), ids.offsets.to_numpy()
        sums = [crc(flat[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_f"), batch.column("_n"), pa.array(np.diff(bounds), pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "_f", "_n", "n_tokens", "ids_crc32"])


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files: as read(), but the ids are summed up before rows are placed."""
    rows = _rows(spark, path)
    kind = rows.schema["doc_id"].dataType.simpleString()
    small = rows.select("doc_id", "ids", "_f", "_n").mapInArrow(_digest, f"doc_id {kind}, _f int, _n long, n_tokens long, ids_crc32 long")
    return _placed(small, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    write(documents(spark, sf_dir), path)
    return digests(spark, path)
