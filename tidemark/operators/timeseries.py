"""Listed-and-gone velocity, price histories, as-of daily envelopes and vendor cadence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import days_before, not_excluded, of_visible

#: A cadence is shown from so many days of history, at most so many hours between scrapes, and so many drops.
CADENCE_DAYS, CADENCE_GAP, CADENCE_DROPS = 42, 6, 15
GAP_DAYS = 14


def velocity(history: DataFrame, listings: DataFrame, vendors: DataFrame, corals: DataFrame, runs: DataFrame, now: str, days: int | None = None) -> DataFrame:
    """Listings of visible vendors and known corals that were in stock and went: first in stock, first out of stock after it, last in stock before that, and the last successful run before the first.

    Everything but the run is one pass of windows over the log: the running minimum of in-stock times marks what comes after the first.
    """
    gone = listings.where("not in_stock and named_coral_id is not null and auction_end_time is null and not is_auction").where(not_excluded())
    gone = of_visible(gone, vendors).join(corals.select(F.col("id").alias("named_coral_id")), "named_coral_id", "left_semi").select(F.col("id").alias("listing_id"), "vendor_id", "named_coral_id")
    rows = history.join(gone, "listing_id")
    per = Window.partitionBy("listing_id")
    rows = rows.withColumn("first_in_stock_at", F.min(F.when(F.col("in_stock"), F.col("observed_at"))).over(per))
    rows = rows.withColumn("first_oos_at", F.min(F.when(~F.col("in_stock") & (F.col("observed_at") > F.col("first_in_stock_at")), F.col("observed_at"))).over(per))
    found = rows.where("first_oos_at is not null").groupBy("listing_id", "vendor_id", "named_coral_id", "first_in_stock_at", "first_oos_at").agg(
        F.max(F.when(F.col("in_stock") & (F.col("observed_at") < F.col("first_oos_at")), F.col("observed_at"))).alias("last_in_stock_at")
    )
    if days is not None:
        found = found.where(F.col("first_oos_at") >= days_before(now, days))
    return _with_prior_run(found, runs).orderBy(F.col("first_oos_at").desc(), F.col("listing_id").desc())


def _with_prior_run(found: DataFrame, runs: DataFrame) -> DataFrame:
    """As-of backward by day: the last run of the same day before the instant, else the last one of the latest earlier day that has any.

    Runs of a vendor and day are ordered with that day's instants only; the days' last runs are few and are carried forward.
    """
    last = Window.partitionBy("vendor_id", "day").orderBy("t", F.col("run").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    instants = found.select("vendor_id", F.col("first_in_stock_at").alias("t"), "listing_id", F.lit(None).cast("timestamp_ntz").alias("run"))
    ends = runs.where("status = 'success'").select("vendor_id", F.col("finished_at").alias("t"), F.lit(None).cast("long").alias("listing_id"), F.col("finished_at").alias("run"))
    events = instants.unionByName(ends).withColumn("day", F.to_date("t"))
    within = events.withColumn("same_day", F.max("run").over(last)).where("listing_id is not null").select("vendor_id", "day", "listing_id", "same_day")
    days = events.groupBy("vendor_id", "day").agg(F.max("run").alias("newest"))
    before = Window.partitionBy("vendor_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    carried = days.withColumn("earlier", F.max("newest").over(before)).select("vendor_id", "day", "earlier")
    prior = within.join(carried, ["vendor_id", "day"]).select("listing_id", F.coalesce("same_day", "earlier").alias("prior_run_at")).where("prior_run_at is not null")
    return found.join(prior, "listing_id")


def _named(listings: DataFrame, vendors: DataFrame, coral: int | None) -> DataFrame:
    rows = listings.where("named_coral_id is not null" if coral is None else f"named_coral_id = {int(coral)}")
    return of_visible(rows, vendors).select(F.col("id").alias("listing_id"), "named_coral_id", "vendor_id")


def price_points(history: DataFrame, listings: DataFrame, vendors: DataFrame, now: str, coral: int | None = None, days: int | None = None) -> DataFrame:
    """Raw points of the visible vendors' listings of one named coral, or of all; a window's edge is an instant."""
    rows = history.join(_named(listings, vendors, coral), "listing_id")
    if days is not None:
        rows = rows.where(F.col("observed_at") >= days_before(now, days))
    return rows.select("named_coral_id", "vendor_id", "listing_id", "id", "price", "in_stock", "observed_at").orderBy("named_coral_id", "listing_id", "observed_at", "id")


def daily_states(history: DataFrame, listings: DataFrame, vendors: DataFrame, now: str, coral: int | None = None, days: int | None = None) -> DataFrame:
    """(named_coral_id, vendor_id, listing_id, day, price): the state of each visible vendor's listing at the end of each day it was in stock with a price.

    The last row of each day holds until the day before the next one, or today: intervals, which are then laid out by day. So the cost
    is that of the result, not of all days times all listings. A window clamps an interval's start to a calendar day.
    """
    last = history.join(_named(listings, vendors, coral), "listing_id").groupBy("named_coral_id", "vendor_id", "listing_id", F.to_date("observed_at").alias("day")).agg(F.max(F.struct("observed_at", "id", "price", "in_stock")).alias("s"))
    today = F.to_date(F.lit(now))
    spans = last.withColumn("until", F.coalesce(F.date_sub(F.lead("day").over(Window.partitionBy("listing_id").orderBy("day")), 1), today))
    start = F.col("day") if days is None else F.greatest(F.col("day"), F.date_sub(today, days))
    spans = spans.withColumn("start", start).where("start <= until and s.in_stock and s.price > 0")  # a descending sequence would count down
    return spans.select("named_coral_id", "vendor_id", "listing_id", F.explode(F.sequence("start", "until")).alias("day"), F.col("s.price").alias("price"))


def price_envelope(history: DataFrame, listings: DataFrame, vendors: DataFrame, now: str, coral: int | None = None, days: int | None = None) -> DataFrame:
    """(named_coral_id, day, price): the lowest state of each day; days without any are absent."""
    return daily_states(history, listings, vendors, now, coral, days).groupBy("named_coral_id", "day").agg(F.min("price").alias("price"))


def price_by_vendor(history: DataFrame, listings: DataFrame, vendors: DataFrame, now: str, coral: int | None = None, days: int | None = None) -> DataFrame:
    """(named_coral_id, vendor_id, day, price, listing_count)."""
    return daily_states(history, listings, vendors, now, coral, days).groupBy("named_coral_id", "vendor_id", "day").agg(F.min("price").alias("price"), F.count("*").alias("listing_count"))


def drop_cadence(listings: DataFrame, vendors: DataFrame, runs: DataFrame, arrivals: DataFrame, now: str, slug: str | None = None, least_days: int = CADENCE_DAYS, most_gap: float = CADENCE_GAP, least_drops: int = CADENCE_DROPS) -> DataFrame:
    """One row for each vendor (or the named one): days of history, organic drops by weekday (Sunday first), the last one, the median hours between the last GAP_DAYS days' scrapes, and whether it qualifies.

    `arrivals` are the guarded just-listed events.
    """
    one = vendors if slug is None else vendors.where(F.col("slug") == slug)
    w = Window.partitionBy("vendor_id").orderBy("finished_at", "id")
    good = runs.where("status = 'success' and finished_at is not null")
    span = good.groupBy("vendor_id").agg(F.min("finished_at").alias("_first"))
    gaps = good.where(F.col("finished_at") >= days_before(now, GAP_DAYS)).withColumn("g", (F.unix_seconds(F.col("finished_at").cast("timestamp")) - F.unix_seconds(F.lag("finished_at").over(w).cast("timestamp"))) / 3600)
    gaps = gaps.groupBy("vendor_id").agg(F.round(F.percentile("g", F.lit(0.5)), 2).alias("median_gap_hours"))
    dow = F.dayofweek("event_at") - 1
    drops = arrivals.where("event = 'just-listed' and not bulk_cluster").groupBy("vendor_id").agg(
        F.count("*").alias("organic_drops"), F.max("event_at").alias("last_drop_at"), *[F.count(F.when(dow == d, 1)).alias(f"dow_{d}") for d in range(7)]
    )
    out = one.select(F.col("id").alias("vendor_id"), "slug").join(span, "vendor_id", "left").join(gaps, "vendor_id", "left").join(drops, "vendor_id", "left")
    out = out.withColumn("history_days", F.coalesce(F.datediff(F.to_date(F.lit(now)), F.to_date("_first")), F.lit(0)))
    for c in ("organic_drops", *[f"dow_{d}" for d in range(7)]):
        out = out.withColumn(c, F.coalesce(c, F.lit(0)))
    ok = (F.col("history_days") >= least_days) & (F.col("median_gap_hours") <= most_gap) & (F.col("organic_drops") >= least_drops)
    return out.withColumn("qualifies", F.coalesce(ok, F.lit(False))).drop("_first")


def browseable(listings: DataFrame) -> DataFrame:
    """(vendor_id, n): in stock and of no excluded category."""
    return listings.where(F.col("in_stock") & not_excluded()).groupBy("vendor_id").agg(F.count("*").alias("n"))


def segments(series: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, first_day, last_day, days, drawn): the unbroken runs of days of a daily series(keys, day); a run of one day is no line."""
    w = Window.partitionBy(*keys).orderBy("day")
    island = series.select(*keys, "day").distinct().withColumn("_g", F.date_sub(F.col("day"), F.row_number().over(w)))
    runs = island.groupBy(*keys, "_g").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("days")).drop("_g")
    return runs.withColumn("drawn", F.col("days") >= 2)


def thin_history(envelope: DataFrame, by_vendor: DataFrame) -> DataFrame:
    """(named_coral_id, thin, day, price): corals with at most one day in all and no vendor with two; then the latest observation, the lowest of its day."""
    days = envelope.groupBy("named_coral_id").agg(F.count("*").alias("_days"))
    points = by_vendor.groupBy("named_coral_id", "vendor_id").agg(F.count("*").alias("_n")).groupBy("named_coral_id").agg(F.max("_n").alias("_most"))
    last = by_vendor.groupBy("named_coral_id").agg(F.max(F.struct("day", (-F.col("price")).alias("low"))).alias("_last"))
    thin = (F.col("_days") <= 1) & (F.col("_most") < 2)
    rows = days.join(points, "named_coral_id").join(last, "named_coral_id")
    return rows.select("named_coral_id", thin.alias("thin"), F.when(thin, F.col("_last.day")).alias("day"), F.when(thin, -F.col("_last.low")).alias("price"))
