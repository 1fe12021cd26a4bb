"""Arrival guards: which lead events are real arrivals, which are a vendor's first scrape, a bulk relist or a bulk cluster; and their upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import at, days_before, not_excluded

#: A vendor's day is a bulk relist above the larger of a floor and a multiple of the vendor's median day.
COHORT_FLOOR, COHORT_FACTOR = 80.0, 4.0
#: Listings of one vendor that were first seen at one instant, from which they are a bulk cluster.
BULK_ROWS = 50
STALE_DAYS = 21


def first_success(runs: DataFrame) -> DataFrame:
    """(vendor_id, first_success): a successful run finished before t exactly if first_success < t, so no inequality join is needed."""
    return runs.where("status = 'success'").groupBy("vendor_id").agg(F.min("finished_at").alias("first_success"))


def baseline(listings: DataFrame, now: str, hours: int) -> DataFrame:
    """(vendor_id, median): of listings first seen on an active UTC day, today left out."""
    days = max(30, -(-hours // 24))
    today = F.date_trunc("day", at(now))
    rows = listings.where((F.col("first_seen_at") >= days_before(now, days)) & (F.col("first_seen_at") < today))
    per_day = rows.groupBy("vendor_id", F.to_date("first_seen_at").alias("day")).agg(F.count("*").alias("n"))
    return per_day.groupBy("vendor_id").agg(F.percentile("n", F.lit(0.5)).alias("median"))


def dispositions(leads: DataFrame, listings: DataFrame, vendors: DataFrame, runs: DataFrame, now: str, hours: int = 168, floor: float = COHORT_FLOOR, factor: float = COHORT_FACTOR) -> DataFrame:
    """Uncapped lead events with guard_disposition: kept, cold_start, bulk_relist or bulk_cluster; threshold and median only for bulk_relist."""
    rows = leads.where(not_excluded())
    rows = rows.join(first_success(runs), "vendor_id", "left")
    listed = F.col("event") == "just-listed"
    cold = listed & ~F.coalesce(F.col("first_success") < F.col("first_seen_at"), F.lit(False))
    rows = rows.withColumn("_cold", cold).withColumn("arr_day", F.to_date("event_at"))
    cohort = rows.where(listed & ~F.col("_cold")).groupBy("vendor_id", "arr_day").agg(F.count("*").alias("_n"))
    cohort = cohort.join(baseline(listings, now, hours), "vendor_id", "left").withColumn("_median", F.coalesce("median", F.lit(0.0)))
    tripped = cohort.withColumn("_threshold", F.greatest(F.lit(floor), F.col("_median") * factor)).where("_n > _threshold").select("vendor_id", "arr_day", "_threshold", "_median")
    rows = rows.join(tripped, ["vendor_id", "arr_day"], "left")
    tag = F.when(~listed, "kept").when(F.col("_cold"), "cold_start").when(F.col("_threshold").isNotNull(), "bulk_relist").when(F.col("bulk_cluster"), "bulk_cluster").otherwise("kept")
    rows = rows.withColumn("guard_disposition", tag)
    relist = F.col("guard_disposition") == "bulk_relist"
    return rows.withColumn("guard_threshold", F.when(relist, F.col("_threshold"))).withColumn("guard_median", F.when(relist, F.col("_median"))).drop("_cold", "_threshold", "_median", "first_success")


def guarded_arrivals(tagged: DataFrame) -> DataFrame:
    return tagged.where("guard_disposition = 'kept'")


def aggregate_activity(leads: DataFrame, hours: int = 24) -> DataFrame:
    """One row, also when nothing happened: the window's uncapped lead events of all three arms outside bulk clusters, and their vendors."""
    return leads.where(not_excluded() & ~F.col("bulk_cluster")).agg(F.count("*").alias("n"), F.countDistinct("vendor_id").alias("vendors"), F.lit(hours).alias("window_hours"))


def cluster_flips(listings: DataFrame, least: int = BULK_ROWS) -> DataFrame:
    """The listings with bulk_cluster set where enough of a vendor's were first seen at one instant; it is never unset here."""
    w = Window.partitionBy("vendor_id", "first_seen_at")
    return listings.withColumn("bulk_cluster", F.col("bulk_cluster") | (F.count("*").over(w) >= least))


def cluster_drift(listings: DataFrame, least: int = BULK_ROWS) -> DataFrame:
    """(vendor_id, to_true, to_false): stored flags that differ from what the counts say, by vendor."""
    w = Window.partitionBy("vendor_id", "first_seen_at")
    rows = listings.withColumn("_right", F.count("*").over(w) >= least).where(~F.col("_right").eqNullSafe(F.col("bulk_cluster")))
    return rows.groupBy("vendor_id").agg(F.count(F.when(F.col("_right"), 1)).alias("to_true"), F.count(F.when(~F.col("_right"), 1)).alias("to_false"))


def first_seen_repair(listings: DataFrame, history: DataFrame) -> DataFrame:
    """(id, first_seen_at, repaired_at): listings whose log begins before their first_seen_at."""
    first = history.groupBy(F.col("listing_id").alias("id")).agg(F.min("observed_at").alias("repaired_at"))
    return listings.select("id", "first_seen_at").join(first, "id").where("repaired_at < first_seen_at")


def stale_listings(listings: DataFrame, runs: DataFrame, now: str, days: int = STALE_DAYS) -> DataFrame:
    """(id, vendor_id, last_seen_at): in stock, not seen for `days`, though a successful run began after it was last seen."""
    last = runs.where("status = 'success'").groupBy("vendor_id").agg(F.max("started_at").alias("last_run"))
    rows = listings.where("in_stock").where(F.col("last_seen_at") < days_before(now, days)).join(last, "vendor_id")
    return rows.where("last_run > last_seen_at").select("id", "vendor_id", "last_seen_at")


def guard_report(tagged: DataFrame) -> DataFrame:
    """(vendor_id, arr_day, guard_disposition, n): arrivals that a guard held back."""
    return tagged.where("guard_disposition <> 'kept'").groupBy("vendor_id", "arr_day", "guard_disposition").agg(F.count("*").alias("n"))
