"""Cross-vendor rankings, feeds, inventory pages, search, lookups and vendor onboarding."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import data_row, markdown_escape, originator, price_text, price_value, relative_time, type_label
from .common import at, days_before, first_by, not_excluded, of_visible, top, visible
from .timeseries import browseable

SORTS = ("newest", "price-asc", "price-desc")
CHANNELS = ("email", "discord")
PAGE = 50
SEARCH_ROWS, SEARCH_CHARS, SEARCH_TOKENS = 51, 80, 6
STRIP_DAYS = 7


def cheapest(listings: DataFrame, vendors: DataFrame) -> DataFrame:
    """The rows at each coral's lowest price where two vendors or more offer it; ties all stay."""
    rows = listings.where("in_stock and current_price is not null and named_coral_id is not null and auction_end_time is null").where(not_excluded())
    rows = rows.join(visible(vendors).select(F.col("id").alias("vendor_id"), F.col("slug").alias("vendor_slug")), "vendor_id")
    best = rows.groupBy("named_coral_id").agg(F.min("current_price").alias("low"), F.countDistinct("vendor_id").alias("vendor_count")).where("vendor_count >= 2")
    return rows.join(best, "named_coral_id").where("current_price = low").select("id", "named_coral_id", "vendor_id", "vendor_slug", "current_price", "vendor_count")


def carriers(listings: DataFrame, vendors: DataFrame, corals: DataFrame) -> DataFrame:
    """In-stock named listings outside auctions, by coral, newest first."""
    rows = listings.where("in_stock and named_coral_id is not null and auction_end_time is null and not is_auction")
    rows = rows.join(visible(vendors).select(F.col("id").alias("vendor_id"), "display_name"), "vendor_id")
    rows = rows.join(corals.select(F.col("id").alias("named_coral_id"), "canonical_name"), "named_coral_id")
    return rows.select("id", "named_coral_id", "canonical_name", "vendor_id", "display_name", "current_price", "first_seen_at").orderBy("named_coral_id", F.col("first_seen_at").desc(), F.col("id").desc())


def most_restocked(leads: DataFrame, limit: int | None = 10) -> DataFrame:
    rows = leads.where("event = 'back-in-stock' and named_coral_id is not null").where(not_excluded()).groupBy("named_coral_id", "canonical_name").agg(F.count("*").alias("restocks"))
    return top(rows, [F.col("restocks").desc(), F.col("canonical_name").asc(), F.col("named_coral_id").asc()], limit)


def recent_drops(listings: DataFrame, now: str, limit: int = 10, days: int = 7) -> DataFrame:
    """The newest arrivals, one for each coral; three times the limit is looked at, and listings without a coral are all different."""
    rows = listings.where(F.col("in_stock") & not_excluded() & ~F.col("bulk_cluster")).where(F.col("first_seen_at") > days_before(now, days))
    newest = [F.col("first_seen_at").desc(), F.col("id").desc()]
    window = top(rows, newest, 3 * limit)
    key = F.coalesce(F.col("named_coral_id").cast("string"), F.concat(F.lit("listing "), F.col("id").cast("string")))
    return top(first_by(window.withColumn("_key", key), ["_key"], newest).drop("_key"), newest, limit)


def with_drop_context(rows: DataFrame, drops: DataFrame) -> DataFrame:
    """The rows (id) with new_price, prior_price and drop_at where their lead event is a price drop."""
    d = drops.where("event = 'price-dropped'").select(F.col("listing_id").alias("id"), "new_price", "prior_price", F.col("event_at").alias("drop_at"))
    return rows.join(d, "id", "left")


def availability(listings: DataFrame, now: str, coral: int | None = None, include_oos: bool = True, days: int = 7) -> DataFrame:
    """A coral's listings (or all corals') of all vendors: in stock first, then by price with missing ones last, then newest."""
    rows = listings.where(F.col("last_seen_at") > days_before(now, days)).where("not is_auction and named_coral_id is not null")
    rows = rows if coral is None else rows.where(F.col("named_coral_id") == coral)
    rows = rows if include_oos else rows.where("in_stock")
    price = F.when(F.col("in_stock"), F.col("current_price"))
    return rows.orderBy("named_coral_id", F.col("in_stock").desc(), price.asc_nulls_last(), F.col("first_seen_at").desc(), F.col("id"))


def in_window_vendors(listings: DataFrame, now: str, days: int = 7) -> DataFrame:
    """(named_coral_id, vendors): the gates of `availability`, in stock or not."""
    return availability(listings, now, days=days).groupBy("named_coral_id").agg(F.countDistinct("vendor_id").alias("vendors"))


def _page_rows(listings: DataFrame, now: str, category: str | None, include_oos: bool, days: int) -> DataFrame:
    """What vendors' pages show, and count."""
    rows = listings.where(F.col("last_seen_at") > days_before(now, days)).where(not_excluded()).where("not is_auction")
    rows = rows if include_oos else rows.where("in_stock")
    return rows if category is None else rows.where(F.col("category") == category)


def inventory(listings: DataFrame, vendor: int, now: str, page: int = 1, sort: str = "newest", category: str | None = None, include_oos: bool = False, days: int = 14, size: int | None = PAGE) -> DataFrame:
    """One page of a vendor's listings; only the newest ladder puts bulk clusters last. Ties go by first_seen_at, newest first, then by id."""
    if sort not in SORTS:
        raise ValueError(f"no such sort: {sort}")
    rows = _page_rows(listings, now, category, include_oos, days).where(F.col("vendor_id") == vendor)
    first = {"newest": F.col("bulk_cluster").asc(), "price-asc": F.col("current_price").asc_nulls_last(), "price-desc": F.col("current_price").desc_nulls_last()}[sort]
    return top(rows, [first, F.col("first_seen_at").desc(), F.col("id").asc()], size, (page - 1) * (size or 0))


def inventory_totals(listings: DataFrame, now: str, category: str | None = None, include_oos: bool = False, days: int = 14) -> DataFrame:
    """(vendor_id, total, gated_auctions) for every vendor with listings in the window: what its pages have in all, and whether they leave out auctions (of any stock or category)."""
    shown = _page_rows(listings, now, category, include_oos, days).select("vendor_id", F.lit(1).alias("shown"), F.lit(0).alias("gated"))
    recent = listings.where(F.col("last_seen_at") > days_before(now, days)).select("vendor_id", F.lit(0).alias("shown"), F.col("is_auction").cast("int").alias("gated"))
    return shown.unionByName(recent).groupBy("vendor_id").agg(F.sum("shown").alias("total"), (F.max("gated") > 0).alias("gated_auctions"))


def event_rows(events: DataFrame, sort: str = "newest", category: str | None = None, cap: int | None = None, suppress_bulk: bool = False) -> DataFrame:
    """Any event rows by category, with or without bulk arrivals, in one of the ladders, capped after sorting."""
    rows = events.where(not_excluded())
    rows = rows if category is None else rows.where(F.col("category") == category)
    if suppress_bulk:
        rows = rows.where("not (event = 'just-listed' and bulk_cluster)")
    price = {"price-asc": [F.col("current_price").asc_nulls_last()], "price-desc": [F.col("current_price").desc_nulls_last()]}
    if sort not in SORTS:
        raise ValueError(f"no such sort: {sort}")
    return top(rows, [*price.get(sort, []), F.col("event_at").desc(), F.col("listing_id").asc()], cap)


def tokens_of(query: str) -> list[str]:
    """A search text's tokens: lower case, marks stripped, at most SEARCH_CHARS characters and SEARCH_TOKENS tokens, wildcards escaped with !."""
    text = unicodedata.normalize("NFKD", query.lower())
    text = " ".join("".join(c for c in text if not unicodedata.combining(c)).split())[:SEARCH_CHARS]
    return ["".join("!" + c if c in "!%_" else c for c in token) for token in text.split()[:SEARCH_TOKENS]]


def matches(column: str, query: str) -> Column:
    """Every token is somewhere in the column, whatever its case; a query without tokens matches nothing."""
    tokens = tokens_of(query)
    out = F.lit(bool(tokens))
    for token in tokens:
        like = token.replace("\\", "\\\\").replace("'", "\\'")
        out = out & F.expr(f"{column} ilike '%{like}%' escape '!'")
    return out


def search_corals(corals: DataFrame, aliases: DataFrame, query: str) -> DataFrame:
    """Active corals whose normalised name has all tokens, or else the smallest alias that has."""
    hit = aliases.where("match_behavior = 'auto-link'").where(matches("alias_text", query)).groupBy(F.col("named_coral_id").alias("id")).agg(F.min("alias_text").alias("matched_alias"))
    rows = corals.where("active").withColumn("_own", matches("normalized_name", query)).join(hit, "id", "left").where("_own or matched_alias is not null")
    return rows.select("id", "canonical_name", "slug", F.when(~F.col("_own"), F.col("matched_alias")).alias("matched_alias")).orderBy("canonical_name")


def search_vendors(vendors: DataFrame, query: str) -> DataFrame:
    return visible(vendors).where(matches("display_name", query)).select("id", "slug", "display_name").orderBy("display_name")


def search_listings(listings: DataFrame, vendors: DataFrame, query: str, limit: int | None = SEARCH_ROWS) -> DataFrame:
    """By the normalised title; one row more than is shown, so that the caller sees an overflow."""
    rows = of_visible(listings.where("in_stock and not is_auction").where(not_excluded()).where(matches("normalized_title", query)), vendors)
    return top(rows.select("id", "vendor_id", "raw_title", "current_price", "first_seen_at"), [F.col("first_seen_at").desc(), F.col("id").desc()], limit)


def coral_directory(corals: DataFrame, listings: DataFrame, vendors: DataFrame) -> DataFrame:
    """Active corals with whether any vendor but test vendors (active or not) ever listed them, when that was first and last, and whether their page is indexed: those ever listed with a public slug."""
    real = vendors.where(~F.col("slug").startswith("_")).select(F.col("id").alias("vendor_id"))
    seen = listings.where("named_coral_id is not null").join(real, "vendor_id", "left_semi").groupBy(F.col("named_coral_id").alias("id")).agg(F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"))
    return corals.where("active").select("id", "slug", "canonical_name").join(seen, "id", "left").withColumn("has_ever_listed", F.col("last_seen_at").isNotNull()).withColumn("indexable", F.col("has_ever_listed") & ~F.col("slug").startswith("_"))


def coral_images(corals: DataFrame, listings: DataFrame, vendors: DataFrame, now: str, days: int = 7) -> DataFrame:
    """Each public coral's picture, of what visible vendors have in stock and listed within `days`, auctions left out: listings with one first, then the newest. Corals without such listings are absent."""
    rows = of_visible(listings.where("named_coral_id is not null and in_stock and not is_auction").where(F.col("last_seen_at") > days_before(now, days)), vendors)
    best = first_by(rows, ["named_coral_id"], [F.col("image_url").isNull().asc(), F.col("first_seen_at").desc(), F.col("id").desc()])
    return best.select("named_coral_id", "image_url", F.col("id").alias("listing_id")).join(corals.where(F.col("active") & ~F.col("slug").startswith("_")).select(F.col("id").alias("named_coral_id"), "slug"), "named_coral_id")


def freshness(listings: DataFrame) -> DataFrame:
    """(named_coral_id, vendors, latest): by how many vendors a coral is in stock, and when any of its listings was last seen, as an ISO text, of which the largest is the latest."""
    rows = listings.where("named_coral_id is not null")
    return rows.groupBy("named_coral_id").agg(F.countDistinct(F.when(F.col("in_stock"), F.col("vendor_id"))).alias("vendors"), F.max(F.date_format("last_seen_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("latest"))


def sitemap_slugs(envelope: DataFrame, corals: DataFrame, least: int = 2) -> DataFrame:
    """(slug, days): corals whose price envelope has `least` days or more, from one envelope of all corals."""
    days = envelope.groupBy(F.col("named_coral_id").alias("id")).agg(F.count("*").alias("days")).where(F.col("days") >= least)
    return corals.where("active").join(days, "id").select("slug", "days")


def scrape_clock(runs: DataFrame) -> DataFrame:
    """(vendor_id, last_started, last_finished) of successful runs."""
    return runs.where("status = 'success'").groupBy("vendor_id").agg(F.max("started_at").alias("last_started"), F.max("finished_at").alias("last_finished"))


def vendor_lookup(vendors: DataFrame) -> DataFrame:
    """Visible vendors with the slug of their page, where underscores become hyphens."""
    return visible(vendors).select("id", "slug", F.translate("slug", "_", "-").alias("page_slug"), "display_name").orderBy("display_name")


def browse_counts(vendors: DataFrame, listings: DataFrame) -> DataFrame:
    n = browseable(listings)
    return vendors.select(F.col("id").alias("vendor_id"), "slug").join(n, "vendor_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def _channel(channel: str) -> str:
    if channel not in CHANNELS:
        raise ValueError(f"no such channel: {channel}")
    return f"announced_{channel}_at"


def pending_announcements(vendors: DataFrame, listings: DataFrame, channel: str) -> DataFrame:
    """Visible vendors with something to browse that were not announced on the channel yet."""
    rows = visible(vendors).where(F.col(_channel(channel)).isNull())
    return rows.select(F.col("id").alias("vendor_id"), "slug", "display_name").join(browseable(listings), "vendor_id").where("n > 0")


def onboarding_strip(vendors: DataFrame, listings: DataFrame, now: str | None = None, days: int = STRIP_DAYS) -> DataFrame:
    """Vendors announced somewhere that had no organic drop since; the earlier announcement counts. With `now`, those of the last days only."""
    rows = visible(vendors).where("first_organic_drop_at is null and (announced_email_at is not null or announced_discord_at is not null)")
    rows = rows.select(F.col("id").alias("vendor_id"), "slug", F.least("announced_email_at", "announced_discord_at").alias("announced_at")).join(browseable(listings), "vendor_id").where("n > 0")
    if now is not None:
        rows = rows.where((F.col("announced_at") >= days_before(now, days)) & (F.col("announced_at") <= at(now)))
    return rows.orderBy(F.col("announced_at").desc(), "slug")


def mark_announced(vendors: DataFrame, announced: DataFrame, channel: str, now: str) -> tuple[DataFrame, DataFrame]:
    """The vendors after the announcement of those in announced(slug), and the slugs that it stamped: those that had no stamp yet."""
    column = _channel(channel)
    rows = vendors.join(announced.select("slug", F.lit(True).alias("_announced")).distinct(), "slug", "left").withColumn("_new", F.coalesce(F.col("_announced") & F.col(column).isNull(), F.lit(False)))
    return rows.select(*[F.when(F.col("_new"), at(now)).otherwise(F.col(c)).alias(c) if c == column else F.col(c) for c in vendors.columns]), rows.where("_new").select("slug")


def stamp_organic_drop(vendors: DataFrame, arrivals: DataFrame, now: str) -> DataFrame:
    """The vendors with first_organic_drop_at set once: where announced, unstamped, and a guarded just-listed event is there."""
    organic = arrivals.where("event = 'just-listed'").select(F.col("vendor_id").alias("id")).distinct().withColumn("_organic", F.lit(True))
    rows = vendors.join(organic, "id", "left")
    due = F.col("_organic") & F.col("first_organic_drop_at").isNull() & (F.col("announced_email_at").isNotNull() | F.col("announced_discord_at").isNotNull())
    return rows.withColumn("first_organic_drop_at", F.when(due, at(now)).otherwise(F.col("first_organic_drop_at"))).drop("_organic")


def vendor_recent_drops(arrivals: DataFrame, slug: str | None = None, limit: int | None = None) -> DataFrame:
    """Guarded just-listed events outside bulk clusters, of one vendor or all, newest first."""
    rows = arrivals.where("event = 'just-listed' and not bulk_cluster").where(not_excluded())
    rows = rows if slug is None else rows.where(F.col("vendor_slug") == slug)
    return top(rows, [F.col("event_at").desc(), F.col("listing_id").desc()], limit)


def digest_groups(events: DataFrame, per_vendor: int | None = 3) -> DataFrame:
    """Event rows by vendor with group_size and place; larger groups first, in a group by precedence and then newest, capped for each vendor."""
    rows = events.where(not_excluded()).where("not (event = 'just-listed' and bulk_cluster)")
    w = Window.partitionBy("vendor_slug")
    rows = rows.withColumn("group_size", F.count("*").over(w)).withColumn("place", F.row_number().over(w.orderBy("precedence", F.col("event_at").desc(), "listing_id")))
    rows = rows if per_vendor is None else rows.where(F.col("place") <= per_vendor)
    return rows.orderBy(F.col("group_size").desc(), "vendor_slug", "place")


#: A digest's characters (as UTF-16 counts them) and lines for each vendor.
DIGEST_CHARS, DIGEST_LINES = 4096, 3


def _chars(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("long")


def digest_blocks(events: DataFrame, now: str, more_at: str, lines: int = DIGEST_LINES, budget: int = DIGEST_CHARS, before: str = "") -> DataFrame:
    """(place, display_name, n, collapsed, block): a digest's text by vendor, the busiest first and then by name, in a vendor by precedence and then newest.

    A block is a heading, `lines` lines and how many more there are at `more_at`. While all blocks and the text `before` them are longer than `budget`, the quietest vendor's block that is
    still whole becomes its heading and the number of its rows: by sums from the first block on, a block collapses if the whole blocks up to it and the collapsed ones after it don't fit.
    """
    rows = events.where(not_excluded()).where("not (event = 'just-listed' and bulk_cluster)")
    rows = rows.withColumn("_row", F.row_number().over(Window.partitionBy("display_name").orderBy("precedence", F.col("event_at").desc(), "listing_id")))
    price = price_value(F.col("current_price"), F.lit(True), F.col("prior_price"), F.col("compare_at_price"))
    shown = F.when(price["old_value"].isNotNull(), F.concat(F.lit("~~"), price["old_value"], F.lit("~~ "), price["value"])).otherwise(price["value"])
    fields = F.array(F.struct(F.lit("Price").alias("label"), shown.alias("value")), F.struct(F.when(F.col("event") == "back-in-stock", "Back").otherwise("Listed").alias("label"), relative_time(F.coalesce("event_at", "first_seen_at"), at(now)).alias("value")))
    bold = lambda text: F.concat(F.lit("**"), markdown_escape(text), F.lit("**"))
    name = bold(F.col("raw_title"))
    linked = F.when(F.col("product_url").rlike("(?i)^https://"), F.concat(F.lit("["), name, F.lit("](<"), F.col("product_url"), F.lit(">)"))).otherwise(name)
    kept = F.when(F.col("_row") <= lines, F.struct("_row", F.concat(linked, F.lit(" — "), data_row(fields)).alias("line")))
    per = rows.groupBy("display_name").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(kept)).alias("_lines"))  # nulls are not gathered: `lines` structs at most
    count = lambda n: n.cast("string")
    head = F.concat(bold(F.col("display_name")), F.lit(" — "), count(F.col("n")), F.when(F.col("n") == 1, " drop").otherwise(" drops"))
    tail = lambda n: F.concat(F.lit("\n+ "), count(n), F.lit(f" more at {more_at}"))
    whole = F.concat(head, F.lit("\n"), F.array_join(F.transform("_lines", lambda x: x["line"]), "\n"), F.when(F.col("n") > lines, tail(F.col("n") - lines)).otherwise(""))
    per = per.select("display_name", "n", whole.alias("_whole"), F.concat(head, tail(F.col("n"))).alias("_short"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("n").desc(), F.lower("display_name"), "display_name")  # one digest: a row for each vendor
    per = per.withColumn("place", F.row_number().over(order))
    up_to, all_of = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy(F.lit(0))
    short = _chars(F.col("_short"))  # those after a row are all less those up to it: Spark sums a frame that ends with the partition anew for each row
    size = len(before.encode("utf-16-le")) // 2 + F.sum(_chars(F.col("_whole")) - short).over(up_to) + F.sum(short).over(all_of) + 2 * (F.count("*").over(all_of) - 1)
    per = per.withColumn("collapsed", size > budget)
    return per.select("place", "display_name", "n", "collapsed", F.when(F.col("collapsed"), F.col("_short")).otherwise(F.col("_whole")).alias("block"))


def digest_text(blocks: DataFrame, budget: int = DIGEST_CHARS, before: str = "") -> DataFrame:
    """One row (text): the blocks, whose places count from 1, under `before`, cut to the budget if even collapsed ones are too long. Without blocks the text is `before`.

    Two characters part a block from the one before, so those at places beyond the budget begin beyond it: they are counted, not gathered.
    """
    near = F.collect_list(F.when(F.col("place") <= budget, F.struct("place", "block")))
    text = F.concat(F.lit(before), F.array_join(F.transform(F.array_sort(near), lambda x: x["block"]), "\n\n"))
    size = len(before.encode("utf-16-le")) // 2 + F.coalesce(F.sum(_chars(F.col("block"))), F.lit(0)) + 2 * F.greatest(F.count("*") - 1, F.lit(0))
    return blocks.agg(text.alias("text"), size.alias("size")).select(F.when(F.col("size") > budget, F.concat(F.substring("text", 1, budget - 1), F.lit("…"))).otherwise(F.col("text")).alias("text"))


def watchdog(events: DataFrame) -> DataFrame:
    """One row: events that a digest would show, and those left out as bulk arrivals."""
    rows = events.where(not_excluded())
    bulk = (F.col("event") == "just-listed") & F.col("bulk_cluster")
    return rows.agg(F.count(F.when(~bulk, 1)).alias("shown"), F.count(F.when(bulk, 1)).alias("bulk"))


def recipients(signups: DataFrame, sent: DataFrame, day: str) -> DataFrame:
    """Confirmed and not unsubscribed signups, none if a digest was sent that day."""
    rows = signups.where("confirmed_at is not null and unsubscribed_at is null").withColumn("_day", F.lit(day).cast("date"))
    return rows.join(sent.select(F.col("sent_date").alias("_day")), "_day", "left_anti").drop("_day")


def offer_summary(listings: DataFrame) -> DataFrame:
    """(named_coral_id, low_price, high_price, offer_count) over in-stock listings with a price above 0; corals without any are absent."""
    rows = listings.where("in_stock and current_price > 0 and named_coral_id is not null")
    return rows.groupBy("named_coral_id").agg(F.min("current_price").alias("low_price"), F.max("current_price").alias("high_price"), F.count("*").alias("offer_count"))


def _cheapest_of(listings: DataFrame, vendors: DataFrame, offer: Column, most: int = 3) -> DataFrame:
    """(named_coral_id, low, n, vendors, listed_at) over a coral's rows where `offer` holds: the lowest price, how many offers, who has it (the newest first, `most` named, how many more) and when its newest listing there was listed.

    Ties are ranked by window: of a coral with many tied vendors only `most` are gathered.
    """
    rows = listings.where("named_coral_id is not null").where(offer).join(vendors.select(F.col("id").alias("vendor_id"), F.col("label").alias("vendor")), "vendor_id", "left")
    low = rows.groupBy("named_coral_id").agg(F.min("current_price").alias("low"), F.count("*").alias("n"))
    newest = [F.col("first_seen_at").desc(), F.col("id").asc()]
    ties = rows.join(low, "named_coral_id").where("current_price = low")
    one = first_by(ties, ["named_coral_id", "vendor"], newest).withColumn("_place", F.row_number().over(Window.partitionBy("named_coral_id").orderBy(*newest)))
    named = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_place") <= most, F.struct("_place", "vendor")))), lambda x: x["vendor"]), ", ")
    more = F.count(F.when(F.col("_place") > most, 1))
    tied = one.groupBy("named_coral_id").agg(F.concat(named, F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"))).otherwise("")).alias("vendors"), F.max(F.when(F.col("_place") == 1, F.col("first_seen_at"))).alias("listed_at"))
    return low.join(tied, "named_coral_id")


def reference_fields(listings: DataFrame, vendors: DataFrame, corals: DataFrame, now: str, labels: DataFrame | None = None) -> DataFrame:
    """(named_coral_id, reference, summary, lineage): a coral's line in a text, on its page, and its own line there.

    The text's line has the lowest price above 0, who has it, and the month the coral was first seen, and is empty without an offer. The page's has the lowest price of any kind (0 too), who has
    it, the originator, and how long ago the cheapest was listed; the coral's own has its type and originator. Vendors are shown by labels(slug, label), else by their display names.
    """
    short = vendors.join(labels, "slug", "left") if labels is not None else vendors.withColumn("label", F.lit(None).cast("string"))
    short = short.select("id", F.coalesce("label", "display_name").alias("label"))
    own = _cheapest_of(listings, short, F.expr("in_stock and current_price > 0"))
    page = _cheapest_of(listings, short, F.expr("in_stock and current_price is not null"))
    first = listings.where("named_coral_id is not null").groupBy("named_coral_id").agg(F.min("first_seen_at").alias("first"))
    every = first.join(own.toDF("named_coral_id", "low", "n", "vendors", "_"), "named_coral_id", "left").drop("_").join(page.toDF("named_coral_id", "any_low", "_n", "any_vendors", "listed_at"), "named_coral_id", "left")
    every = every.join(corals.select(F.col("id").alias("named_coral_id"), "origin_vendor", "coral_type"), "named_coral_id", "left")
    field = lambda label, value: F.struct(label.alias("label") if isinstance(label, Column) else F.lit(label).alias("label"), value.alias("value"))
    shown = lambda low: F.when(F.col(low).isNotNull(), price_text(F.col(low)))
    given = lambda c: F.when(F.col(c) != "", F.col(c))
    month = F.when(F.col("low").isNotNull(), F.date_format("first", "MMM yyyy"))
    line = F.array(field(F.when(F.col("n") > 1, "Cheapest now").otherwise("Listed now"), shown("low")), field("Vendor", F.col("vendors")), field("First seen", month))
    summary = F.array(field("Price", shown("any_low")), field("Vendor", F.col("any_vendors")), field("Lineage", originator(given("origin_vendor"))), field("Listed", F.when(F.col("listed_at").isNotNull(), relative_time(F.col("listed_at"), at(now)))))
    lineage = F.array(field("Type", type_label(given("coral_type"))["display"]), field("Origin", originator(given("origin_vendor"))))
    return every.select("named_coral_id", data_row(line).alias("reference"), data_row(summary).alias("summary"), data_row(lineage).alias("lineage"))


def guides_of(files: DataFrame) -> DataFrame:
    """(slug, kind, title, updated, description, body) of files(path, content), guides whose name is a slug (lower-case letters, digits and hyphens, .mdx), newest first.

    The heading between two lines of --- says kind, title, updated and description; what it leaves out is GUIDE, the slug, nothing and null. A file without a heading is all body.
    """
    slug = F.regexp_extract("path", r"([^/]+)\.mdx$", 1)
    head = F.regexp_extract("content", r"^---\r?\n([\s\S]*?)\r?\n---[ \t]*(?:\r?\n|$)", 1)
    own = lambda k: F.regexp_replace(F.trim(F.regexp_extract("_head", rf"(?m)^{k}:[ \t]*(.*?)[ \t\r]*$", 1)), r"""^(["'])(.*)\1$""", "$2")
    given = lambda k, default: F.when(own(k) != "", own(k)).otherwise(default)
    rows = files.select(slug.alias("slug"), head.alias("_head"), F.regexp_replace("content", r"^---\r?\n[\s\S]*?\r?\n---[ \t]*(?:\r?\n|$)", "").alias("body")).where(F.col("slug").rlike("^[a-z0-9-]+$"))
    out = rows.select("slug", given("kind", F.lit("GUIDE")).alias("kind"), given("title", F.col("slug")).alias("title"), F.substring(own("updated"), 1, 10).alias("updated"), given("description", F.lit(None)).alias("description"), "body")
    return out.orderBy(F.col("updated").desc(), "slug")


def featured_in(guides: DataFrame, tags: tuple[str, ...]) -> DataFrame:
    """(coral_slug, slug, updated) of guides(slug, updated, body): the corals that a guide features, by the slug attribute of its elements `tags`, newest guide first."""
    opening = r"<(?:" + "|".join(tags) + r")\b[^>]*?\bslug=(?:\"([^\"]+)\"|'([^']+)')"
    found = F.array_distinct(F.concat(F.regexp_extract_all("body", F.lit(opening), F.lit(1)), F.regexp_extract_all("body", F.lit(opening), F.lit(2))))
    rows = guides.select(F.explode(found).alias("coral_slug"), "slug", "updated").where("coral_slug <> ''")
    return rows.orderBy("coral_slug", F.col("updated").desc(), "slug")
