"""What to show: gates, scores, band balance, superlatives, samples and spotlights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import PRICE_BANDS
from ..functions.text import drop_dollars, drop_fraction, price_band
from .common import at, first_by, top

# Weights and limits of the score.
CHEAPEST, DROP, NAMED, RECENCY, BALANCE = 100.0, 50.0, 30.0, 10.0, 8.0
FULL_DOLLARS, LEAST_PRICE, RECENT_PICKS = 100.0, 25.0, 6
# Limits of a superlative drop.
MOST_OFF, LEAST_NEW, LEAST_OFF, LEAST_WORTH = 0.90, 5.0, 0.25, 100.0
SAMPLE = 9


def gate_reason(image: Column, host: str, price: Column, least: float = LEAST_PRICE) -> Column:
    """The first reason against showing a listing, null if none. Pictures must be of the mirror `host`."""
    return F.when(image.isNull(), "no-image").when(~image.startswith(host.rstrip("/") + "/"), "non-mirror-image").when(price.isNull(), "price-on-request").when(price < least, "below-price-floor")


def card_eligible() -> Column:
    """Whether a row can be a card: it is of a named entity and has a price."""
    return F.col("named_coral_id").isNotNull() & F.col("current_price").isNotNull()


def recency(event_at: Column, now: str, hours: int) -> Column:
    """1 for an event just now, falling to 0 at the window's edge."""
    age = (F.unix_seconds(at(now).cast("timestamp")) - F.unix_seconds(event_at.cast("timestamp"))) / (3600.0 * hours)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - age))


def band_penalty(picks: DataFrame, recent: int = RECENT_PICKS, mode: str | None = None) -> DataFrame:
    """(band, penalty): how far a band's share of the last picks(band, selected_at, id, mode) is above its fair one, scaled to BALANCE; of one mode's picks, or of all. Without picks no band has one."""
    last = top(picks if mode is None else picks.where(F.col("mode") == mode), [F.col("selected_at").desc(), F.col("id").desc()], recent)
    fair = 1.0 / len(PRICE_BANDS)
    total = last.agg(F.count("*").alias("_t"))
    share = last.groupBy("band").agg(F.count("*").alias("_n")).join(F.broadcast(total))  # one row
    return share.select("band", (F.greatest(F.lit(0.0), F.col("_n") / F.col("_t") - fair) / (1 - fair) * BALANCE).alias("penalty"))


def score(candidates: DataFrame, medals: DataFrame, cheapest: DataFrame, penalties: DataFrame, now: str, hours: int) -> DataFrame:
    """candidates(listing_id, named_coral_id, current_price, event_at) with score."""
    rows = candidates.join(medals, "listing_id", "left").join(cheapest.select(F.col("id").alias("listing_id"), F.lit(1.0).alias("_best")).distinct(), "listing_id", "left")
    rows = rows.withColumn("band", price_band(F.col("current_price"))).join(F.broadcast(penalties), "band", "left")
    drop = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("dollars", F.lit(0.0)) / FULL_DOLLARS))
    value = CHEAPEST * F.coalesce("_best", F.lit(0.0)) + DROP * drop + NAMED * F.when(F.col("named_coral_id").isNotNull(), 1.0).otherwise(0.0) + RECENCY * recency(F.col("event_at"), now, hours) - F.coalesce("penalty", F.lit(0.0))
    return rows.withColumn("score", value).drop("_best", "penalty")


def ranked(scored: DataFrame, limit: int | None = 7) -> DataFrame:
    return top(scored, [F.col("score").desc(), F.col("event_at").desc(), F.col("listing_id").asc()], limit)


def select(leads: DataFrame, medals: DataFrame, cheapest: DataFrame, penalties: DataFrame, now: str, hours: int, host: str, limit: int | None = 7) -> DataFrame:
    """Candidates through the gate, scored and ranked, in one plan."""
    fine = leads.where(gate_reason(F.col("image_url"), host, F.col("current_price")).isNull())
    return ranked(score(fine, medals, cheapest, penalties, now, hours), limit)


def medals(drops: DataFrame) -> DataFrame:
    """(listing_id, dollars): the largest saving of each listing."""
    return drops.groupBy("listing_id").agg(F.max(drop_dollars(F.col("new_price"), F.col("prior_price"), F.col("compare_at_price"))).alias("dollars"))


def superlative(drops: DataFrame, limit: int | None = 1, worth: float = LEAST_WORTH) -> DataFrame:
    """The deepest believable and worthy drop of a row that can be a card; of equal ones the first in the drops' order."""
    rows = drops.where(card_eligible()).withColumn("fraction", drop_fraction(F.col("current_price"), F.col("prior_price"), F.col("compare_at_price")))
    rows = rows.where((F.col("fraction") > 0) & (F.col("fraction") < MOST_OFF) & (F.col("current_price") >= LEAST_NEW) & (F.col("fraction") >= LEAST_OFF) & (F.col("current_price") >= worth))
    return top(rows, [F.col("fraction").desc(), F.col("event_at").desc(), F.col("listing_id").asc()], limit)


def fastest(velocity: DataFrame, limit: int | None = 1) -> DataFrame:
    """The shortest time from the last run without a listing until it was gone."""
    rows = velocity.withColumn("hours", (F.unix_seconds(F.col("first_oos_at").cast("timestamp")) - F.unix_seconds(F.col("prior_run_at").cast("timestamp"))) / 3600)
    return top(rows, [F.col("hours").asc(), F.col("listing_id").asc()], limit)


ARRIVALS = ("just-listed", "back-in-stock")


def carousel(arrivals: DataFrame, size: int = SAMPLE, without: tuple[str, ...] = ()) -> DataFrame:
    """Of arrivals and restocks that can be a card and are not of the vendors `without`, one of each coral (the latest), each vendor's first ones before the rest, cut to `size`; total counts
    all arrivals and restocks."""
    newest = [F.col("event_at").desc(), F.col("listing_id").desc()]
    every = arrivals.where(F.col("event").isin(*ARRIVALS))
    fine = every.where(card_eligible())
    fine = fine.where(~F.col("vendor_slug").isin(*without)) if without else fine
    spread = first_by(fine, ["named_coral_id"], newest).withColumn("vendor_rank", F.row_number().over(Window.partitionBy("vendor_slug").orderBy(*newest)))
    total = every.agg(F.count("*").alias("total"))
    return top(spread, [(F.col("vendor_rank") > 1).asc(), *newest], size).join(F.broadcast(total))  # one row


def composition(arrivals: DataFrame) -> DataFrame:
    """One row (total, composition): all-arrivals (also without any), all-restocks or mixed."""
    of = lambda event: F.count(F.when(F.col("event") == event, 1)) > 0
    kind = F.when(of(ARRIVALS[0]) & of(ARRIVALS[1]), "mixed").when(of(ARRIVALS[1]), "all-restocks").otherwise("all-arrivals")
    return arrivals.where(F.col("event").isin(*ARRIVALS)).agg(F.count("*").alias("total"), kind.alias("composition"))


def spotlight(offers: DataFrame, size: int = SAMPLE) -> DataFrame:
    """Of the corals that two vendors or more carry and of which an offer can be a card, the one with most vendors, then the most recent, then the largest id. `vendors` counts all that carry it;
    the cards are each vendor's latest offer that can be one, newest first. `offers` are market.carriers."""
    spread = offers.groupBy("named_coral_id").agg(F.countDistinct("vendor_id").alias("vendors"), F.count(F.when(card_eligible(), 1)).alias("cards"), F.max("first_seen_at").alias("latest"))
    chosen = top(spread.where("vendors >= 2 and cards >= 1"), [F.col("vendors").desc(), F.col("latest").desc(), F.col("named_coral_id").desc()], 1)
    rows = offers.where(card_eligible()).join(F.broadcast(chosen), "named_coral_id")  # one row
    newest = [F.col("first_seen_at").desc(), F.col("id").desc()]
    return top(first_by(rows, ["vendor_id"], newest).select("named_coral_id", "vendor_id", "id", "current_price", "first_seen_at", "vendors"), newest, size)
