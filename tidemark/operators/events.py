"""Lead events of listings (price drops, restocks, new listings) and recent price drops, from the change log.

`lag` runs over a listing's whole history before any window is applied, so a change across the window's edge is seen;
ties in time are broken by the log's id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import days_before, first_by, hours_before, top, visible

EVENTS = ("price-dropped", "back-in-stock", "just-listed")
#: A restock counts only after so many hours out of stock.
RESTOCK_HOURS = 24
#: A vendor's own markdown counts from this ratio of the compare-at price to the price.
MARKDOWN_RATIO = "1.05"


def with_previous(history: DataFrame) -> DataFrame:
    """The log with each row's previous price, stock and time of the same listing."""
    w = Window.partitionBy("listing_id").orderBy("observed_at", "id")
    return history.select("*", F.lag("price").over(w).alias("prior_price"), F.lag("in_stock").over(w).alias("prior_stock"), F.lag("observed_at").over(w).alias("prior_at"))


def observed_drops(history: DataFrame, since: Column) -> DataFrame:
    """(listing_id, id, event_at, new_price, prior_price): rows of the log whose price is below the one before."""
    rows = with_previous(history).where((F.col("price") < F.col("prior_price")) & (F.col("observed_at") > since))
    return rows.select("listing_id", "id", F.col("observed_at").alias("event_at"), F.col("price").alias("new_price"), "prior_price")


def _no_prices(df: DataFrame) -> list[Column]:
    return [F.lit(None).cast("decimal(10,2)").alias(c) for c in ("new_price", "prior_price")]


def drop_arm(history: DataFrame, listings: DataFrame, now: str, hours: int) -> DataFrame:
    live = listings.where("in_stock and current_price is not null and auction_end_time is null and not is_auction").select(F.col("id").alias("listing_id"))
    return observed_drops(history, hours_before(now, hours)).join(live, "listing_id", "left_semi").select("listing_id", F.lit(EVENTS[0]).alias("event"), F.lit(1).alias("precedence"), "event_at", "new_price", "prior_price")


def restock_arm(history: DataFrame, listings: DataFrame, now: str, hours: int, gap_hours: int = RESTOCK_HOURS) -> DataFrame:
    """The first restock of each listing in the window; the gap counts from the previous row of the log."""
    rows = with_previous(history).where("in_stock and prior_stock = false").where(F.col("observed_at") > hours_before(now, hours))
    rows = rows.where(F.expr(f"observed_at - prior_at >= interval '{gap_hours}' hour"))
    rows = first_by(rows, ["listing_id"], [F.col("observed_at").asc(), F.col("id").asc()])
    live = listings.where("in_stock and not is_auction").select(F.col("id").alias("listing_id"))
    rows = rows.join(live, "listing_id", "left_semi")
    return rows.select("listing_id", F.lit(EVENTS[1]).alias("event"), F.lit(2).alias("precedence"), F.col("observed_at").alias("event_at"), *_no_prices(rows))


def listed_arm(listings: DataFrame, now: str, hours: int) -> DataFrame:
    rows = listings.where("in_stock and not is_auction").where(F.col("first_seen_at") > hours_before(now, hours))
    return rows.select(F.col("id").alias("listing_id"), F.lit(EVENTS[2]).alias("event"), F.lit(3).alias("precedence"), F.col("first_seen_at").alias("event_at"), *_no_prices(rows))


def log_arms(history: DataFrame, listings: DataFrame, now: str, hours: int, gap_hours: int = RESTOCK_HOURS, changed: bool = False) -> DataFrame:
    """The drop and restock arms in one pass over the log; of restocks all that count, not only the first. `changed`: the log has the previous states already."""
    rows = (history if changed else with_previous(history)).where(F.col("observed_at") > hours_before(now, hours))
    arm = lambda n, new, prior: F.struct(F.lit(EVENTS[n - 1]).alias("event"), F.lit(n).alias("precedence"), new.cast("decimal(10,2)").alias("new_price"), prior.cast("decimal(10,2)").alias("prior_price"))
    drop = F.when(F.col("price") < F.col("prior_price"), arm(1, F.col("price"), F.col("prior_price")))
    back = F.when(F.expr(f"in_stock and prior_stock = false and observed_at - prior_at >= interval '{gap_hours}' hour"), arm(2, F.lit(None), F.lit(None)))
    arms = rows.select("listing_id", F.col("observed_at").alias("event_at"), F.explode(F.array_compact(F.array(drop, back))).alias("arm")).select("listing_id", "event_at", "arm.*")
    live = listings.where("in_stock and not is_auction").select(F.col("id").alias("listing_id"), F.expr("current_price is not null and auction_end_time is null").alias("_priced"))
    return arms.join(live, "listing_id").where("precedence = 2 or _priced").select("listing_id", "event", "precedence", "event_at", "new_price", "prior_price")


def lead_events(
    history: DataFrame, listings: DataFrame, vendors: DataFrame, corals: DataFrame, now: str, hours: int = 24, events: list[str] | None = None, limit: int | None = 100, listing_ids: DataFrame | None = None, changed: bool = False
) -> DataFrame:
    """One event for each listing: the first by precedence, then the latest, of restocks the first. The filter asks what the lead event *is*, so it comes after the ranking.

    `listing_ids`, a table with listing_id, restricts the listings; `limit` None gives all rows; `changed` says that `history` has the previous states, as with_previous gives them.
    """
    for e in events or ():
        if e not in EVENTS:
            raise ValueError(f"no such event: {e}")
    if listing_ids is not None:
        listings = listings.join(listing_ids.select(F.col("listing_id").alias("id")), "id", "left_semi")
        history = history.join(listing_ids.select("listing_id"), "listing_id", "left_semi")
    arms = log_arms(history, listings, now, hours, changed=changed).unionByName(listed_arm(listings, now, hours))
    lead = first_by(arms, ["listing_id"], [F.col("precedence").asc(), F.when(F.col("precedence") == 2, F.col("event_at")).asc(), F.col("event_at").desc(), F.col("new_price").asc_nulls_last(), F.col("prior_price").asc_nulls_last()])
    if events:
        lead = lead.where(F.col("event").isin(*events))
    shown = listings.select(F.col("id").alias("listing_id"), "vendor_id", "named_coral_id", "raw_title", "product_url", "current_price", "compare_at_price", "category", "bulk_cluster", "first_seen_at", "image_url")
    out = lead.join(shown, "listing_id").join(visible(vendors).select(F.col("id").alias("vendor_id"), F.col("slug").alias("vendor_slug"), "display_name"), "vendor_id")
    out = out.join(corals.select(F.col("id").alias("named_coral_id"), "canonical_name", F.col("slug").alias("coral_slug"), "origin_vendor"), "named_coral_id", "left")
    return top(out, [F.col("event_at").desc(), F.col("listing_id").asc()], limit)


def recent_price_drops(history: DataFrame, listings: DataFrame, vendors: DataFrame, now: str, days: int = 7) -> DataFrame:
    """One row for each listing: its latest observed drop, or else the vendor's own markdown that began in the window (no prior price). Decimal arithmetic decides the ratio."""
    live = listings.where("in_stock and current_price is not null and auction_end_time is null")
    live = live.join(visible(vendors).select(F.col("id").alias("vendor_id")), "vendor_id", "left_semi")
    seen = observed_drops(history, days_before(now, days)).join(live.select(F.col("id").alias("listing_id")), "listing_id", "left_semi")
    seen = seen.select("listing_id", F.lit(1).alias("arm"), "event_at", "id", "new_price", "prior_price")
    marked = live.where(F.expr(f"compare_at_price >= current_price * cast({MARKDOWN_RATIO} as decimal(3,2))")).where(F.col("markdown_started_at") > days_before(now, days))
    marked = marked.select(F.col("id").alias("listing_id"), F.lit(2).alias("arm"), F.col("markdown_started_at").alias("event_at"), F.lit(0).cast("long").alias("id"), F.col("current_price").alias("new_price"), F.lit(None).cast("decimal(10,2)").alias("prior_price"))
    best = first_by(seen.unionByName(marked), ["listing_id"], [F.col("arm").asc(), F.col("event_at").desc(), F.col("id").desc()]).drop("id")
    shown = live.select(F.col("id").alias("listing_id"), "vendor_id", "named_coral_id", "raw_title", "category", "current_price", "compare_at_price", "bulk_cluster")
    return best.join(shown, "listing_id").orderBy(F.col("event_at").desc(), F.col("listing_id").asc())
