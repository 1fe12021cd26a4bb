"""Helpers of the corpus operators: reading, cutting lineage, Arrow batches in bounded pieces."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker holds as numpy arrays at once.
PIECE_BYTES = 2 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words are runs of letters, digits and non-ASCII characters (after A-Z became a-z).
ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words are runs of anything but ASCII white space.
SPACED_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col):
    """A-Z to a-z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(col, F.lit("")), UPPER, LOWER)


#: The folder of a local session that has none set; the setting itself can't be changed while a session runs.
_own_root: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session may fall back to a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_root:
        _own_root.append(tempfile.mkdtemp(prefix="tidemark-"))
    return _own_root[0]


#: Folders that this driver wrote and nobody has deleted yet.
_written: list[str] = []


def new_path(spark: SparkSession, label: str) -> str:
    """A new folder's name in the shared folder."""
    _written.append(f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}")
    return _written[-1]


#: Spark's setting that deletes a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here and a lost executor loses nothing. The shuffle files of its making are deleted at once."""
    spark = df.sparkSession
    path = new_path(spark, label)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Delete a table that cut() wrote and that nothing reads any more."""
    path = getattr(df, "cut_path", None)
    if path:
        drop_path(df.sparkSession, path)


def drop_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if path in _written:
        _written.remove(path)


def drop_written(spark: SparkSession) -> None:
    """Delete every table that operators wrote and that is still there. Their results read some of them: call it when those results are stored."""
    for path in list(_written):
        drop_path(spark, path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that are over: it does so when the driver has collected the garbage that refers to them."""
    gc.collect()
    spark._jvm.System.gc()


def pieces(batches: Iterable[pa.RecordBatch], column: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches (no copy) with about `most` bytes of `column` each, one row at least."""
    for batch in batches:
        n, at = batch.num_rows, 0
        if not n:
            continue
        sizes = batch.column(column)
        sizes = pa.compute.fill_null(pa.compute.binary_length(sizes), 0).to_pylist()
        while at < n:
            end, held = at + 1, sizes[at]
            while end < n and held + sizes[end] <= most:
                held += sizes[end]
                end += 1
            yield batch.slice(at, end - at)
            at = end


def text_bytes(column: pa.Array) -> list[bytes]:
    """The column's texts as UTF-8; null is empty."""
    return pa.compute.fill_null(column.cast(pa.binary()), b"").to_pylist()


def keep_rows(rows: DataFrame, copies: str) -> DataFrame:
    """One row again for each of `copies` equal input rows that were handled once."""
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).drop("_copy", copies)
