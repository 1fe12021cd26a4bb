"""Fleet health: run medians and canaries, category histories, coverage, out-of-stock studies, price distributions, repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import at, days_before, hours_before, not_excluded

# Gates of a run and limits of the signals.
CANARY_FLOOR, CANARY_SHARE, PAGES_SHARE = 5, 0.2, 0.5
HISTORY_RUNS, ZERO_DAYS, SATURATED, MOST_EMPTY = 14, 3, 8, 8
TREND, TREND_LEAST, LEAST_PATH, SLOT_MINUTE = 0.5, 5, 3, 11


def run_medians(runs: DataFrame, now: str, days: int = 7, canary: str = "silent canary") -> DataFrame:
    """(vendor_id, seen, pages): medians over successful runs, and failed ones that the canary stopped; vendors without any are absent."""
    good = (F.col("status") == "success") | ((F.col("status") == "failed") & F.coalesce(F.col("error_message").contains(canary), F.lit(False)))
    rows = runs.where(good & (F.col("started_at") >= days_before(now, days)))
    return rows.groupBy("vendor_id").agg(F.percentile("listings_seen", F.lit(0.5)).alias("seen"), F.percentile("pages_fetched", F.lit(0.5)).alias("pages"))


def run_gates(runs: DataFrame, medians: DataFrame) -> DataFrame:
    """(id, vendor_id, canary, incomplete): too few rows, or pages, against the vendor's median (0 without one)."""
    rows = runs.join(medians, "vendor_id", "left")
    seen, pages = F.coalesce("seen", F.lit(0.0)), F.coalesce("pages", F.lit(0.0))
    return rows.select("id", "vendor_id", (F.col("listings_seen") < F.greatest(F.lit(CANARY_FLOOR), CANARY_SHARE * seen)).alias("canary"), (F.col("pages_fetched") < PAGES_SHARE * pages).alias("incomplete"))


def category_signals(runs: DataFrame, paths: DataFrame, keep: int = HISTORY_RUNS) -> DataFrame:
    """(vendor_id, path, current, zero_streak, last_nonzero_at, verdict) over the newest successful runs(vendor_id, id, started_at, counts map<string,int>).

    paths(vendor_id, path) are those a vendor is expected to have; a missing key counts 0. The streak is the number of newest runs before the first non-zero one.
    """
    w = Window.partitionBy("vendor_id").orderBy(F.col("started_at").desc(), F.col("id").desc())
    last = runs.where("status = 'success'").withColumn("n", F.row_number().over(w)).where(F.col("n") <= keep)
    rows = last.join(paths, "vendor_id").select("vendor_id", "path", "n", "started_at", F.coalesce(F.try_element_at("counts", F.col("path")), F.lit(0)).alias("c"))
    each = rows.groupBy("vendor_id", "path").agg(
        F.max(F.when(F.col("n") == 1, F.col("c"))).alias("current"), (F.coalesce(F.min(F.when(F.col("c") > 0, F.col("n"))), F.max("n") + 1) - 1).alias("zero_streak"), F.max(F.when(F.col("c") > 0, F.col("started_at"))).alias("last_nonzero_at")
    )
    # a path without any count in all the runs is empty by choice
    return each.withColumn("verdict", F.when(F.col("last_nonzero_at").isNotNull(), F.when(F.col("zero_streak") == ZERO_DAYS, "persistence").when(F.col("zero_streak") == SATURATED, "saturated")))


def breadth(signals: DataFrame, most: int = MOST_EMPTY) -> DataFrame:
    """(vendor_id, empty_now, empty_before, widened): whether a vendor has just come to more empty paths than allowed."""
    rows = signals.groupBy("vendor_id").agg(F.count(F.when(F.col("zero_streak") >= 1, 1)).alias("empty_now"), F.count(F.when(F.col("zero_streak") >= 2, 1)).alias("empty_before"))
    return rows.withColumn("widened", (F.col("empty_now") > most) & (F.col("empty_before") <= most))


def path_histories(runs: DataFrame, paths: DataFrame, keep: int = HISTORY_RUNS) -> DataFrame:
    """(vendor_id, path, n, started_at, c): the counts of the newest successful runs, from the newest one on; a missing key counts 0."""
    w = Window.partitionBy("vendor_id").orderBy(F.col("started_at").desc(), F.col("id").desc())
    last = runs.where("status = 'success'").withColumn("n", F.row_number().over(w)).where(F.col("n") <= keep)
    return last.join(paths, "vendor_id").select("vendor_id", "path", "n", "started_at", F.coalesce(F.try_element_at("counts", F.col("path")), F.lit(0)).alias("c"))


def slot_of(instant: Column, minute: int = SLOT_MINUTE) -> Column:
    """The end of the hourly slot that an instant is in: after the slot before, up to this one."""
    own = F.date_trunc("hour", instant) + F.expr(f"interval '{minute}' minute")
    return F.when(own < instant, own + F.expr("interval '1' hour")).otherwise(own)


def in_slot(instant: Column, now: Column, minute: int = SLOT_MINUTE) -> Column:
    """Whether an instant is in the last slot that has ended at `now`."""
    own = F.date_trunc("hour", now) + F.expr(f"interval '{minute}' minute")
    end = F.when(own > now, own - F.expr("interval '1' hour")).otherwise(own)
    return (instant > end - F.expr("interval '1' hour")) & (instant <= end)


def digest_buckets(runs: DataFrame, paths: DataFrame, least: int = LEAST_PATH, days: int = ZERO_DAYS) -> DataFrame:
    """(vendor_id, path, bucket, current, streak, slot, median, deviates) of every path: curator-empty (zero in all runs kept), pinged (a streak of `days` or more, with
    the slot that it reached that in), warn, sparse (under `least`) or healthy. The median is over the runs of the week before the newest one; sparse and healthy paths may deviate from it, and `shown` says that
    such a deviation is reported: of a median that is not too small.
    """
    rows = path_histories(runs, paths)
    newest = F.max("started_at").over(Window.partitionBy("vendor_id"))
    rows = rows.withColumn("week", F.when(F.col("started_at") >= newest - F.expr("interval '168' hour"), F.col("c")))
    each = rows.groupBy("vendor_id", "path").agg(
        F.max("c").alias("most"), F.max(F.when(F.col("n") == 1, F.col("c"))).alias("current"), (F.coalesce(F.min(F.when(F.col("c") > 0, F.col("n"))), F.max("n") + 1) - 1).alias("streak"),
        F.map_from_entries(F.collect_list(F.struct("n", "started_at"))).alias("_at"), F.percentile("week", F.lit(0.5)).alias("median"),
    )
    bucket = F.when(F.col("most") == 0, "curator-empty").when(F.col("streak") >= days, "pinged").when(F.col("streak") >= 1, "warn").when(F.col("current") < least, "sparse").otherwise("healthy")
    shown = F.col("bucket").isin("sparse", "healthy")
    out = each.withColumn("bucket", bucket).withColumn("slot", F.when(F.col("bucket") == "pinged", slot_of(F.try_element_at("_at", (F.col("streak") - days + 1).cast("int")))))
    deviates = shown & (F.col("median") > 0) & (F.abs(F.col("current") - F.col("median")) / F.col("median") > TREND)
    return out.select("vendor_id", "path", "bucket", "current", "streak", "slot", F.when(shown, F.col("median")).alias("median"), deviates.alias("deviates"), (deviates & (F.col("median") >= TREND_LEAST)).alias("shown"))


def flips_of_a_day(runs: DataFrame, now: str, hours: int = 24) -> DataFrame:
    """(vendor_id, oos): listings that went out of stock in the successful runs of the last `hours`; all vendors with a run are there."""
    recent = F.col("started_at") > hours_before(now, hours)
    return runs.groupBy("vendor_id").agg(F.coalesce(F.sum(F.when((F.col("status") == "success") & recent, F.col("listings_oos"))), F.lit(0)).alias("oos"))


def coverage(listings: DataFrame, vendors: DataFrame, recoverable: Column) -> DataFrame:
    """(vendor_id, n, missing, share, recoverable): in-stock listings outside auctions, of all but test vendors, without a category, by vendor and (vendor_id null) in all; recoverable is a test of those that could have one."""
    missing = F.col("category").isNull()
    real = vendors.where(~F.col("slug").startswith("_")).select(F.col("id").alias("vendor_id"))
    rows = listings.where("in_stock and not is_auction").join(real, "vendor_id", "left_semi").rollup("vendor_id").agg(F.count("*").alias("n"), F.count(F.when(missing, 1)).alias("missing"), F.count(F.when(missing & recoverable, 1)).alias("recoverable"))
    return rows.where("vendor_id is not null or n > 0").withColumn("share", F.round(F.col("missing") / F.col("n"), 6))


def oos_calibration(runs: DataFrame, now: str, days: int = 14) -> DataFrame:
    rows = runs.where((F.col("status") == "success") & (F.col("started_at") >= days_before(now, days)))
    return rows.groupBy("vendor_id").agg(F.count("*").alias("runs"), F.percentile("listings_oos", F.lit(0.5)).alias("p50"), F.round(F.percentile("listings_oos", F.lit(0.95)), 6).alias("p95"), F.max("listings_oos").alias("most"))


def oos_top(runs: DataFrame, now: str, days: int = 14, n: int = 3) -> DataFrame:
    rows = runs.where((F.col("status") == "success") & (F.col("started_at") >= days_before(now, days)))
    w = Window.partitionBy("vendor_id").orderBy(F.col("listings_oos").desc(), F.col("id").asc())
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select("vendor_id", "place", "id", "listings_oos")


def transitions(history: DataFrame) -> DataFrame:
    """(was, now, n): how often stock went from one state to another."""
    w = Window.partitionBy("listing_id").orderBy("observed_at", "id")
    rows = history.withColumn("was", F.lag("in_stock").over(w)).where("was is not null")
    return rows.groupBy("was", F.col("in_stock").alias("now")).agg(F.count("*").alias("n"))


def nearest_rank(df: DataFrame, keys: list[str], value: str, shares: tuple[float, ...], half_even: bool = True) -> DataFrame:
    """For each group the values at the rounded rank share * (n - 1): a value that occurs, unlike an interpolated percentile.

    Ranks come from a window, so no group is gathered in one list.
    """
    w = Window.partitionBy(*keys)
    rows = df.where(F.col(value).isNotNull()).withColumn("_r", F.row_number().over(w.orderBy(value)) - 1).withColumn("_n", F.count("*").over(w))
    rank = lambda q: F.bround((F.col("_n") - 1) * q, 0) if half_even else F.floor((F.col("_n") - 1) * q + 0.5)
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.max(F.when(F.col("_r") == rank(q), F.col(value))).alias(f"p{round(q * 100)}") for q in shares])


def week_cover(leads: DataFrame) -> DataFrame:
    """(vendor_slug, event, day, n)."""
    return leads.groupBy("vendor_slug", "event", F.to_date("event_at").alias("day")).agg(F.count("*").alias("n"))


def cluster_census(listings: DataFrame, least: int) -> DataFrame:
    """One row: groups of one vendor and instant with `least` listings or more, and their listings."""
    rows = listings.groupBy("vendor_id", "first_seen_at").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return rows.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("listings"))


def leak_audit(listings: DataFrame, hit: str, harmless: str) -> DataFrame:
    """(vendor_id, hits, sample): in-stock titles that match `hit` and not `harmless`."""
    rows = listings.where("in_stock").where(F.col("raw_title").rlike(hit) & ~F.col("raw_title").rlike(harmless))
    return rows.groupBy("vendor_id").agg(F.count("*").alias("hits"), F.min("raw_title").alias("sample"))


def absent_from_last_run(listings: DataFrame, runs: DataFrame, minutes: int = 5) -> DataFrame:
    """In stock, but last seen before the vendor's latest successful run ended less a margin; dearest first."""
    last = runs.where("status = 'success'").groupBy("vendor_id").agg(F.max("finished_at").alias("last_run"))
    rows = listings.where("in_stock").join(last, "vendor_id").where(F.expr(f"last_seen_at < last_run - interval '{minutes}' minute"))
    return rows.select("id", "vendor_id", "current_price", "last_seen_at").orderBy(F.col("current_price").desc_nulls_last(), "id")


def stale_partition(stale: DataFrame, live: DataFrame) -> DataFrame:
    """(product_url, part): not in the live catalogue, there but rejected by the filter, or accepted but stale. live(product_url, accepted)."""
    rows = stale.select("product_url").join(live, "product_url", "left")
    return rows.select("product_url", F.when(F.col("accepted").isNull(), "not-in-catalogue").when(~F.col("accepted"), "rejected").otherwise("stale").alias("part"))


def reclassification(rows: DataFrame, anchored: Column, most: int, most_share: float) -> DataFrame:
    """One row: how many categories would be filled, corrected (an anchor explains the change) or drift (skipped), and whether the writes stay below both ceilings."""
    fill = F.col("stored").isNull() & F.col("inferred").isNotNull()
    change = ~F.col("stored").eqNullSafe(F.col("inferred")) & F.col("stored").isNotNull()
    out = rows.agg(F.count("*").alias("n"), F.count(F.when(fill, 1)).alias("fill"), F.count(F.when(change & anchored, 1)).alias("correct"), F.count(F.when(change & ~anchored, 1)).alias("drift"))
    writes = F.col("fill") + F.col("correct")
    return out.withColumn("allowed", (writes <= most) & (writes <= most_share * F.col("n")))


def filter_drift(stored: DataFrame, live: DataFrame) -> DataFrame:
    """(vendor_id, why, n, share) of stored(vendor_id, product_url) against the live catalogue under a filter, live(vendor_id, product_url, why): how many of a vendor's listings are kept, go for each reason, or are
    not in the catalogue any more."""
    fresh = live.select("vendor_id", "product_url", F.coalesce("why", F.lit("kept")).alias("why"))
    rows = stored.join(fresh, ["vendor_id", "product_url"], "left").withColumn("why", F.coalesce("why", F.lit("not-in-catalogue")))
    return rows.groupBy("vendor_id", "why").agg(F.count("*").alias("n")).withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("vendor_id")), 6))


def version_drift(live: DataFrame, fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """(vendor_id, old, new, n): stored listings by what two versions of the filter say of them, live and fresh(vendor_id, product_url, why); only where the two differ."""
    both = live.select("vendor_id", "product_url", F.coalesce("why", F.lit("kept")).alias("old")).join(fresh.select("vendor_id", "product_url", F.coalesce("why", F.lit("kept")).alias("new")), ["vendor_id", "product_url"])
    rows = both.where("old <> new").join(stored.select("vendor_id", "product_url"), ["vendor_id", "product_url"], "left_semi")
    return rows.groupBy("vendor_id", "old", "new").agg(F.count("*").alias("n"))


def without_rejected(listings: DataFrame, rejected: DataFrame) -> DataFrame:
    """The listings whose product_url the live filter does not reject."""
    return listings.join(rejected.select("product_url").distinct(), "product_url", "left_anti")


def auction_repair(listings: DataFrame, live: DataFrame) -> DataFrame:
    """(id, current_price, is_auction): in-stock listings whose url ends in -auc or is in a live auction lose their price and gain the flag."""
    rows = listings.join(live.select("product_url", F.lit(True).alias("_live")).distinct(), "product_url", "left")
    hit = F.col("in_stock") & (F.lower("product_url").endswith("-auc") | F.coalesce("_live", F.lit(False)))
    return rows.select("id", F.when(~hit, F.col("current_price")).alias("current_price"), (F.col("is_auction") | hit).alias("is_auction"))


def dependants(ids: DataFrame, history: DataFrame) -> DataFrame:
    """(id, rows): the log's rows for each of the ids, those without any included."""
    n = history.join(ids.select(F.col("id").alias("listing_id")), "listing_id", "left_semi").groupBy(F.col("listing_id").alias("id")).agg(F.count("*").alias("rows"))
    return ids.select("id").join(n, "id", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))


def same_ids(found: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: ids on either side only; a repair goes on where both are 0."""
    a, b = found.select("id").distinct(), expected.select("id").distinct()
    both = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), "id", "full")
    return both.agg(F.count(F.when(F.col("_b").isNull(), 1)).alias("unexpected"), F.count(F.when(F.col("_a").isNull(), 1)).alias("absent"))


def preflight(listings: DataFrame, most_missing: float, with_auctions: bool = False) -> DataFrame:
    """(vendor_id, total, auctions, gated, missing, share, verdict): per cent without a category among what can be browsed, or all. A vendor with auctions only can't be judged."""
    rows = listings.groupBy("vendor_id").agg(
        F.count("*").alias("total"), F.count(F.when(F.col("is_auction"), 1)).alias("auctions"), F.count(F.when(F.col("category").isNull(), 1)).alias("_null"), F.count(F.when(F.col("category").isNull() & ~F.col("is_auction"), 1)).alias("_open")
    )
    gated, missing = (F.col("total"), F.col("_null")) if with_auctions else (F.col("total") - F.col("auctions"), F.col("_open"))
    rows = rows.withColumns({"gated": gated, "missing": missing}).withColumn("share", F.when(F.col("gated") > 0, F.col("missing") / F.col("gated") * 100))
    verdict = F.when(F.col("gated") == 0, "cannot-evaluate").when(F.col("share") > most_missing, "fail").otherwise("pass")
    return rows.select("vendor_id", "total", "auctions", "gated", "missing", F.round("share", 6).alias("share"), verdict.alias("verdict"))


def floor_cuts(listings: DataFrame, floors: tuple[float, ...]) -> DataFrame:
    """(floor, cut, n, share): how many of the in-stock priced listings outside auctions each price floor would cut."""
    rows = listings.where("in_stock and current_price is not null and auction_end_time is null and not is_auction")
    one = rows.agg(F.count("*").alias("n"), *[F.count(F.when(F.col("current_price") < x, 1)).alias(f"f{i}") for i, x in enumerate(floors)])
    each = F.explode(F.array(*[F.struct(F.lit(float(x)).alias("floor"), F.col(f"f{i}").alias("cut")) for i, x in enumerate(floors)]))
    return one.select("n", each.alias("e")).select("e.floor", "e.cut", "n", F.round(F.col("cut") / F.col("n") * 100, 6).alias("share"))


def category_changes(listings: DataFrame, fresh: DataFrame) -> DataFrame:
    """(id, old, new): listings whose category in the live catalogue fresh(product_url, category) is another; those that it has no more are left alone."""
    live = fresh.select("product_url", F.col("category").alias("new"))
    return listings.join(live, "product_url").where(~F.col("category").eqNullSafe(F.col("new"))).select("id", F.col("category").alias("old"), "new")
