"""Incremental forms of the log's and the snapshot's queries: after any split of the input into batches they give what the batch queries give over all of it.

The log is a stream keyed by listing: the state of a listing is its last row, so a new row meets the one before without a scan of the history. The states are a table, and a batch meets it in
one window, without a call for each listing. The snapshot is a table for each batch of scrapes. A batch reads its predecessor's table and overwrites its own, so that a batch which is run again
after a failure leaves what it left before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import events
from ..operators.common import shared_folder  # noqa: F401

LOG = "id long, listing_id long, price decimal(10,2), in_stock boolean, observed_at timestamp_ntz"
CHANGES = LOG + ", prior_price decimal(10,2), prior_stock boolean, prior_at timestamp_ntz"
PRIOR = {"prior_price": "price", "prior_stock": "in_stock", "prior_at": "observed_at"}


def log_changes(log: DataFrame) -> DataFrame:
    """The stream of the log for run_available, which adds each row's previous price, stock and time of the same listing, as events.with_previous gives them over a whole log."""
    return log.select("id", "listing_id", "price", "in_stock", "observed_at")


def run_available(changes: DataFrame, path: str, checkpoint: str) -> None:
    """Add what the stream has now, with the rows before, to the table at `path`, and return. With the same checkpoint the next call goes on where this one ended, also after a failure.

    A listing's rows may be spread over batches in any way that keeps their order in time; rows of one batch need no order. State is one row for each listing: batch b reads
    {checkpoint}/last/{(b-1) % 2} and overwrites {checkpoint}/last/{b % 2} and {path}/batch={b}.
    """

    def run(rows: DataFrame, batch: int) -> None:
        known = rows.withColumn("new", F.lit(True))
        if batch:
            last = rows.sparkSession.read.schema(LOG).parquet(f"{checkpoint}/last/{(batch - 1) % 2}")
            known = known.unionByName(last.withColumn("new", F.lit(False)))
        order = ["new", "observed_at", "id"]
        w = Window.partitionBy("listing_id").orderBy(*order)
        prior = [F.lag(c).over(w).alias(name) for name, c in PRIOR.items()]
        known.select("*", *prior).where("new").drop("new").write.mode("overwrite").parquet(f"{path}/batch={batch}")
        own = [c.split()[0] for c in LOG.split(", ")]
        last = known.groupBy("listing_id").agg(F.max_by(F.struct(*own), F.struct(*order)).alias("r")).select("r.*")
        last.write.mode("overwrite").parquet(f"{checkpoint}/last/{batch % 2}")

    changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def changes_at(spark: SparkSession, path: str) -> DataFrame:
    """The table that run_available has written."""
    return spark.read.schema(CHANGES).parquet(path).select(*[c.split()[0] for c in CHANGES.split(", ")])


def lead_events_of(changes: DataFrame, listings: DataFrame, vendors: DataFrame, corals: DataFrame, now: str, hours: int, limit: int | None = None) -> DataFrame:
    """Lead events from a table that run_available has written: no window over the history is left, the rows after the window's edge are enough."""
    return events.lead_events(changes, listings, vendors, corals, now, hours, None, limit, changed=True)


def keep_snapshot(scrapes: DataFrame, first: DataFrame, folder: str, step: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]], checkpoint: str) -> None:
    """Carry a snapshot through the batches of a stream of scraped items: step(snapshot, items) gives the next snapshot and the rows that the log gains.

    Batch b reads {folder}/snapshot/{b-1} (`first` for b = 0) and overwrites {folder}/snapshot/{b} and {folder}/log/batch={b}.
    """
    spark = first.sparkSession

    def run(items: DataFrame, batch: int) -> None:
        before = first if batch == 0 else spark.read.schema(first.schema).parquet(f"{folder}/snapshot/{batch - 1}")
        after, gained = step(before, items)
        after.write.mode("overwrite").parquet(f"{folder}/snapshot/{batch}")
        gained.write.mode("overwrite").parquet(f"{folder}/log/batch={batch}")

    scrapes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def snapshot_after(scrapes: DataFrame, first: DataFrame, folder: str, step: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]) -> DataFrame:
    """The snapshot after all scrapes that the stream has now; a second call with the same folder takes those that have come since."""
    spark = first.sparkSession
    keep_snapshot(scrapes, first, folder, step, f"{folder}/checkpoint")
    commits = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/checkpoint/commits")
    done = [int(f.getPath().getName()) for f in commits.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(commits) if f.getPath().getName().isdigit()]
    return spark.read.schema(first.schema).parquet(f"{folder}/snapshot/{max(done)}") if done else first


def arriving(spark: SparkSession, schema, path: str) -> DataFrame:
    """The files of a folder as a stream: each call of run_available or snapshot_after takes those that are new, in one batch."""
    return spark.readStream.schema(schema).parquet(path)
