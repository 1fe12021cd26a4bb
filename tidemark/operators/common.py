"""Predicates and small steps that many operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXCLUDED_CATEGORIES = ("equipment", "invert")


def at(now: str) -> Column:
    return F.lit(now).cast("timestamp_ntz")


def hours_before(now: str, hours: int) -> Column:
    return F.expr(f"cast('{now}' as timestamp_ntz) - interval '{hours}' hour")


def days_before(now: str, days: int) -> Column:
    return hours_before(now, 24 * days)


def visible(vendors: DataFrame) -> DataFrame:
    """Active vendors whose slug does not begin with an underscore."""
    return vendors.where(F.col("active") & ~F.col("slug").startswith("_"))


def of_visible(rows: DataFrame, vendors: DataFrame) -> DataFrame:
    """The rows(vendor_id, ...) of visible vendors."""
    return rows.join(visible(vendors).select(F.col("id").alias("vendor_id")), "vendor_id", "left_semi")


def not_excluded(category: str = "category") -> Column:
    """A missing category is not excluded."""
    return F.col(category).isNull() | ~F.col(category).isin(*EXCLUDED_CATEGORIES)


#: Folders that this driver made and nobody has deleted yet.
_folders: list[str] = []


def drop_stored(spark: SparkSession) -> None:
    """Delete all folders that operators and streams have made. Results read some of them: call it when those results are stored."""
    while _folders:
        at = spark._jvm.org.apache.hadoop.fs.Path(_folders.pop())
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder where executors and driver meet: in spark.checkpoint.dir, of local sessions without one in their own temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    _folders.append(f"{root or tempfile.mkdtemp(prefix='tidemark-')}/{label}-{uuid.uuid4().hex}")
    return _folders[-1]


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows written to a shared folder and read back: what many branches of a plan use is computed once, and a lost executor loses nothing."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """The rows, kept from being broadcast in a join: a plan takes a table's size from its compressed file, and dictionaries of numbered names are many times larger than that."""
    return df.hint("merge")


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in a total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def top(df: DataFrame, order: list[Column], limit: int | None = None, offset: int = 0) -> DataFrame:
    """Sorted, and cut to a page if a limit is given; without one all rows stay."""
    if limit is not None and limit < 1:
        raise ValueError("a limit is at least 1")
    out = df.orderBy(*order)
    if offset:
        out = out.offset(offset)
    return out if limit is None else out.limit(limit)


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, integers as longs, dates as text: what both engines show alike."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DecimalType, T.FloatType)):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("long")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)
