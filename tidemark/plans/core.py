"""The temporal and market queries over the generated tables, with parameters at which both sides of each branch occur."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import events, guards, market, timeseries
from ..operators.common import plain
from ..sources.adapters import NOW, Model
from .oracle import SHOWN, T, TITLE_SQL, VELOCITY, VISIBLE, drops, leads, since, sql, states, tagged

#: Smaller than the operators' defaults: the generated log is small and spans a month.
FLOOR, FACTOR, BULK = 3.0, 1.5, 3
WEEK, MONTH = 168, 720


def _leads(m: Model, hours: int, kinds: list[str] | None = None, limit: int | None = None) -> DataFrame:
    return events.lead_events(m.price_history, m.listings, m.vendors, m.named_corals, NOW, hours, kinds, limit)


def _tagged(m: Model, hours: int = WEEK) -> DataFrame:
    return guards.dispositions(_leads(m, hours), m.listings, m.vendors, m.scraper_runs, NOW, hours, FLOOR, FACTOR)


def _arrivals(m: Model, hours: int = WEEK) -> DataFrame:
    return guards.guarded_arrivals(_tagged(m, hours))


def _drops(m: Model) -> DataFrame:
    return events.recent_price_drops(m.price_history, m.listings, m.vendors, NOW)


LEAD = "listing_id event event_at new_price prior_price vendor_slug named_coral_id canonical_name coral_slug origin_vendor current_price compare_at_price category".split()
LEAD_SQL = "listing_id, event, event_at, new_price::double as new_price, prior_price::double as prior_price, vendor_slug, named_coral_id, canonical_name, coral_slug, origin_vendor, current_price::double as current_price, compare_at_price::double as compare_at_price, category"
TAG_SQL = "listing_id, event, event_at, vendor_slug, guard_disposition, case when guard_disposition = 'bulk_relist' then t_threshold end as guard_threshold, case when guard_disposition = 'bulk_relist' then t_med end as guard_median, arr_day::varchar as arr_day"
DROP = "listing_id arm event_at new_price prior_price vendor_id named_coral_id current_price compare_at_price".split()
DROP_SQL = "listing_id, arm::bigint as arm, event_at, new_price::double as new_price, prior_price::double as prior_price, vendor_id, named_coral_id, current_price::double as current_price, compare_at_price::double as compare_at_price"
ROW = "id vendor_id named_coral_id current_price first_seen_at category".split()
ROW_SQL = "id, vendor_id, named_coral_id, current_price::double as current_price, first_seen_at, category"
STATE_OK = "s.in_stock and s.price > 0"

_Q = {
    "lead_events": (lambda m: _leads(m, WEEK).select(*LEAD), sql(f"select {LEAD_SQL} from leads", *leads(WEEK))),
    "lead_events_day_top_100": (lambda m: _leads(m, 24, None, 100).select(*LEAD), sql(f"select {LEAD_SQL} from leads order by event_at desc, listing_id limit 100", *leads(24))),
    "lead_events_restocked_only": (lambda m: _leads(m, MONTH, ["back-in-stock"]).select(*LEAD), sql(f"select {LEAD_SQL} from leads where event = 'back-in-stock'", *leads(MONTH))),
    "observed_price_drops": (
        lambda m: events.observed_drops(m.price_history, F.lit("2024-01-24 00:00:00").cast("timestamp_ntz")),
        sql(f"select listing_id, id, observed_at as event_at, price::double as new_price, prior_price::double as prior_price from prev where price < prior_price and observed_at >= {since(WEEK)}", leads(WEEK)[1]),
    ),
    "recent_price_drops": (lambda m: _drops(m).select(*DROP), sql(f"select {DROP_SQL} from drops", *drops(7))),
    "arrivals_dispositioned": (
        lambda m: _tagged(m).select("listing_id", "event", "event_at", "vendor_slug", "guard_disposition", "guard_threshold", "guard_median", "arr_day"),
        sql(f"select {TAG_SQL} from tagged", *tagged(WEEK, FLOOR, FACTOR)),
    ),
    "arrivals_guarded": (lambda m: _arrivals(m).select(*LEAD), sql(f"select {LEAD_SQL} from tagged where guard_disposition = 'kept'", *tagged(WEEK, FLOOR, FACTOR))),
    "guard_report": (
        lambda m: guards.guard_report(_tagged(m, MONTH)),
        sql("select vendor_id, arr_day::varchar as arr_day, guard_disposition, count(*) as n from tagged where guard_disposition <> 'kept' group by all", *tagged(MONTH, FLOOR, FACTOR)),
    ),
    "aggregate_activity": (
        lambda m: guards.aggregate_activity(_leads(m, WEEK), WEEK),
        sql(f"select count(*) as n, count(distinct vendor_id) as vendors, {WEEK}::bigint as window_hours from leads where {SHOWN} and not bulk_cluster", *leads(WEEK)),
    ),
    "velocity": (
        lambda m: timeseries.velocity(m.price_history, m.listings, m.vendors, m.named_corals, m.scraper_runs, NOW),
        sql("select * from velocity", VISIBLE, *VELOCITY),
    ),
    "cross_vendor_cheapest": (
        lambda m: market.cheapest(m.listings, m.vendors),
        sql(
            "select o.id, o.named_coral_id, o.vendor_id, o.vendor_slug, o.current_price::double as current_price, b.vendor_count from offers o join (select named_coral_id, min(current_price) as low, count(distinct vendor_id) as vendor_count from offers group by 1) b on b.named_coral_id = o.named_coral_id and b.low = o.current_price where b.vendor_count >= 2",
            VISIBLE,
            f"offers as (select l.*, v.slug as vendor_slug from listings l join visible v on v.id = l.vendor_id where in_stock and current_price is not null and named_coral_id is not null and auction_end_time is null and {SHOWN})",
        ),
    ),
    "cross_vendor_carriers": (
        lambda m: market.carriers(m.listings, m.vendors, m.named_corals),
        sql("select l.id, l.named_coral_id, c.canonical_name, l.vendor_id, v.display_name, l.current_price::double as current_price, l.first_seen_at from listings l join visible v on v.id = l.vendor_id join named_corals c on c.id = l.named_coral_id where l.in_stock and l.auction_end_time is null and not l.is_auction", VISIBLE),
    ),
    "most_restocked": (
        lambda m: market.most_restocked(_leads(m, MONTH)),
        sql(f"select named_coral_id, canonical_name, count(*) as restocks from leads where event = 'back-in-stock' and named_coral_id is not null and {SHOWN} group by 1, 2 order by restocks desc, canonical_name, named_coral_id limit 10", *leads(MONTH)),
    ),
    "coral_price_history": (
        lambda m: timeseries.price_points(m.price_history, m.listings, m.vendors, NOW, None, 10),
        sql(f"select l.named_coral_id, l.vendor_id, p.listing_id, p.id, p.price::double as price, p.in_stock, p.observed_at from price_history p join listings l on l.id = p.listing_id where l.named_coral_id is not null and p.observed_at >= {since(240)} and l.vendor_id in (select id from visible)", VISIBLE),
    ),
    "coral_price_envelope": (
        lambda m: timeseries.price_envelope(m.price_history, m.listings, m.vendors, NOW),
        sql(f"select named_coral_id, day::varchar as day, min(s.price)::double as price from states where {STATE_OK} group by 1, 2", *states("named_coral_id is not null", None)),
    ),
    "coral_price_envelope_windowed": (
        lambda m: timeseries.price_envelope(m.price_history, m.listings, m.vendors, NOW, 74, 9),
        sql(f"select named_coral_id, day::varchar as day, min(s.price)::double as price from states where {STATE_OK} group by 1, 2", *states("named_coral_id = 74", 9)),
    ),
    "coral_price_by_vendor": (
        lambda m: timeseries.price_by_vendor(m.price_history, m.listings, m.vendors, NOW),
        sql(f"select named_coral_id, vendor_id, day::varchar as day, min(s.price)::double as price, count(*) as listing_count from states where {STATE_OK} group by 1, 2, 3", *states("named_coral_id is not null", None)),
    ),
    "vendor_drop_cadence": (
        lambda m: timeseries.drop_cadence(m.listings, m.vendors, m.scraper_runs, _arrivals(m, MONTH), NOW, None, 14, 24.0, 2),
        sql(
            f"""select v.id as vendor_id, v.slug, g.median_gap_hours, coalesce(d.organic_drops, 0) as organic_drops, d.last_drop_at, {", ".join(f"coalesce(d.dow_{k}, 0) as dow_{k}" for k in range(7))},
              coalesce(date_diff('day', g.first_run::date, {T}::date), 0) as history_days, coalesce(coalesce(date_diff('day', g.first_run::date, {T}::date), 0) >= 14 and g.median_gap_hours <= 24 and coalesce(d.organic_drops, 0) >= 2, false) as qualifies
            from vendors v left join gaps g on g.vendor_id = v.id left join per_day d on d.vendor_id = v.id""",
            *tagged(MONTH, FLOOR, FACTOR),
            f"gaps as (select vendor_id, max(first_run) as first_run, round(median(g), 2) as median_gap_hours from (select vendor_id, null as first_run, epoch(finished_at - lag(finished_at) over (partition by vendor_id order by finished_at, id)) / 3600 as g from scraper_runs where status = 'success' and finished_at >= {since(336)} union all select vendor_id, min(finished_at), null from scraper_runs where status = 'success' group by 1) group by 1)",
            f"per_day as (select vendor_id, count(*) as organic_drops, max(event_at) as last_drop_at, {', '.join(f'count(*) filter (where extract(dow from event_at) = {k}) as dow_{k}' for k in range(7))} from tagged where guard_disposition = 'kept' and event = 'just-listed' and not bulk_cluster group by 1)",
        ),
    ),
    "vendor_recent_drops": (
        lambda m: market.vendor_recent_drops(_arrivals(m)).select(*LEAD),
        sql(f"select {LEAD_SQL} from tagged where guard_disposition = 'kept' and event = 'just-listed' and not bulk_cluster", *tagged(WEEK, FLOOR, FACTOR)),
    ),
    "browseable_in_stock": (lambda m: market.browse_counts(m.vendors, m.listings), sql(f"select v.id as vendor_id, v.slug, (select count(*) from listings l where l.vendor_id = v.id and in_stock and {SHOWN}) as n from vendors v")),
    "pending_onboarding": (
        lambda m: market.pending_announcements(m.vendors, m.listings, "discord"),
        sql(f"select * from (select id as vendor_id, slug, display_name, (select count(*) from listings l where l.vendor_id = v.id and in_stock and {SHOWN}) as n from visible v where announced_discord_at is null) where n > 0", VISIBLE),
    ),
    "onboarding_strip_state": (
        lambda m: market.onboarding_strip(m.vendors, m.listings),
        sql(f"select * from (select id as vendor_id, slug, least(announced_email_at, announced_discord_at) as announced_at, (select count(*) from listings l where l.vendor_id = v.id and in_stock and {SHOWN}) as n from visible v where first_organic_drop_at is null and (announced_email_at is not null or announced_discord_at is not null)) where n > 0", VISIBLE),
    ),
    "onboarding_strip_recent": (
        lambda m: market.onboarding_strip(m.vendors, m.listings, NOW),
        sql(f"select * from (select id as vendor_id, slug, least(announced_email_at, announced_discord_at) as announced_at, (select count(*) from listings l where l.vendor_id = v.id and in_stock and {SHOWN}) as n from visible v where first_organic_drop_at is null) where n > 0 and announced_at between {since(WEEK)} and {T}", VISIBLE),
    ),
    "mark_onboarding_announced": (
        lambda m: market.mark_announced(m.vendors, m.vendors.where("id between 1 and 3").select("slug"), "email", NOW)[0].select("id", "slug", "announced_email_at"),
        sql(f"select id, slug, case when announced_email_at is null and slug in ('vendor-1', 'vendor-2', 'vendor-3') then {T} else announced_email_at end as announced_email_at from vendors"),
    ),
    "stamp_first_organic_drop": (
        lambda m: market.stamp_organic_drop(m.vendors, _arrivals(m, MONTH), NOW).select("id", "first_organic_drop_at"),
        sql(f"select id, case when first_organic_drop_at is null and (announced_email_at is not null or announced_discord_at is not null) and id in (select vendor_id from tagged where guard_disposition = 'kept' and event = 'just-listed') then {T} else first_organic_drop_at end as first_organic_drop_at from vendors", *tagged(MONTH, FLOOR, FACTOR)),
    ),
    "recent_drops_feed": (
        lambda m: market.recent_drops(m.listings, NOW).select(*ROW),
        sql(
            f"select {ROW_SQL} from (select *, row_number() over (partition by coalesce(named_coral_id::varchar, 'listing ' || id) order by first_seen_at desc, id desc) as n from newest) where n = 1 order by first_seen_at desc, id desc limit 10",
            f"newest as (select * from listings where in_stock and {SHOWN} and not bulk_cluster and first_seen_at > {since(WEEK)} order by first_seen_at desc, id desc limit 30)",
        ),
    ),
    "listing_drop_context": (
        lambda m: market.with_drop_context(m.listings.where("in_stock").select("id", "vendor_id"), _leads(m, WEEK)),
        sql("select l.id, l.vendor_id, d.new_price::double as new_price, d.prior_price::double as prior_price, d.event_at as drop_at from listings l left join leads d on d.listing_id = l.id and d.event = 'price-dropped' where l.in_stock", *leads(WEEK)),
    ),
    "coral_availability": (
        lambda m: market.availability(m.listings, NOW).select(*ROW, "in_stock"),
        sql(f"select {ROW_SQL}, in_stock from listings where last_seen_at > {since(WEEK)} and not is_auction and named_coral_id is not null"),
    ),
    "coral_in_window_vendors": (lambda m: market.in_window_vendors(m.listings, NOW), sql(f"select named_coral_id, count(distinct vendor_id) as vendors from listings where last_seen_at > {since(WEEK)} and not is_auction and named_coral_id is not null group by 1")),
    "vendor_inventory_page": (
        lambda m: market.inventory(m.listings, 10, NOW, 2, "price-asc", None, True, size=2).select(*ROW),
        sql(f"select {ROW_SQL} from listings where vendor_id = 10 and last_seen_at > {since(336)} and {SHOWN} and not is_auction order by current_price asc nulls last, first_seen_at desc, id limit 2 offset 2"),
    ),
    "vendor_inventory_totals": (
        lambda m: market.inventory_totals(m.listings, NOW),
        sql(f"select vendor_id, count(*) filter (where in_stock and not is_auction and {SHOWN}) as total, bool_or(is_auction) as gated_auctions from listings where last_seen_at > {since(336)} group by 1"),
    ),
    "vendor_inventory_totals_lps": (
        lambda m: market.inventory_totals(m.listings, NOW, "lps", True),
        sql(f"select vendor_id, count(*) filter (where category = 'lps' and not is_auction) as total, bool_or(is_auction) as gated_auctions from listings where last_seen_at > {since(336)} group by 1"),
    ),
    "recent_arrivals_day": (
        lambda m: market.event_rows(_leads(m, 48), "newest", None, 100, True).select(*LEAD),
        sql(f"select {LEAD_SQL} from leads where {SHOWN} and not (event = 'just-listed' and bulk_cluster) order by event_at desc, listing_id limit 100", *leads(48)),
    ),
    "recent_arrivals_week": (
        lambda m: market.event_rows(_arrivals(m).where("event in ('just-listed', 'back-in-stock')"), "price-desc").select(*LEAD),
        sql(f"select {LEAD_SQL} from tagged where guard_disposition = 'kept' and event in ('just-listed', 'back-in-stock')", *tagged(WEEK, FLOOR, FACTOR)),
    ),
    "price_drops_feed": (
        lambda m: market.event_rows(_drops(m).withColumn("event", F.lit("price-dropped")), "price-asc", "lps", 250).select(*DROP),
        sql(f"select {DROP_SQL} from drops where category = 'lps' order by drops.current_price nulls last, event_at desc, listing_id limit 250", *drops(7)),
    ),
    "latest_price_drop": (lambda m: _drops(m).agg(F.max("event_at").alias("latest_at"), F.count("*").alias("n")), sql("select max(event_at) as latest_at, count(*) as n from drops", *drops(7))),
    "search_corals": (
        lambda m: market.search_corals(m.named_corals, m.aliases, "MORPH 1"),
        sql("select id, canonical_name, slug, case when not own then alias end as matched_alias from (select c.*, normalized_name ilike '%morph%' and normalized_name ilike '%1%' as own, (select min(alias_text) from aliases a where a.named_coral_id = c.id and match_behavior = 'auto-link' and alias_text ilike '%morph%' and alias_text ilike '%1%') as alias from named_corals c where active) where own or alias is not null"),
    ),
    "search_vendors": (lambda m: market.search_vendors(m.vendors, "supplier 00"), sql("select id, slug, display_name from visible where display_name ilike '%supplier%' and display_name ilike '%00%'", VISIBLE)),
    "search_listings": (
        lambda m: market.search_listings(m.listings.withColumn("normalized_title", text.normalize_title(F.col("raw_title"))), m.vendors, "torch  frag"),
        sql(f"select id, vendor_id, raw_title, current_price::double as current_price, first_seen_at from (select *, {TITLE_SQL} as title from listings) where in_stock and not is_auction and {SHOWN} and title ilike '%torch%' and title ilike '%frag%' and vendor_id in (select id from visible) order by first_seen_at desc, id desc limit 51", VISIBLE),
    ),
    "coral_directory": (
        lambda m: market.coral_directory(m.named_corals, m.listings, m.vendors),
        sql("select c.id, c.slug, c.canonical_name, min(l.first_seen_at) as first_seen_at, max(l.last_seen_at) as last_seen_at, count(l.id) > 0 as has_ever_listed, count(l.id) > 0 and not starts_with(c.slug, '_') as indexable from named_corals c left join (select l.* from listings l join vendors v on v.id = l.vendor_id where not starts_with(v.slug, '_')) l on l.named_coral_id = c.id where c.active group by 1, 2, 3"),
    ),
    "coral_images": (
        lambda m: market.coral_images(m.named_corals, m.listings, m.vendors, NOW),
        sql(f"select n.named_coral_id, n.image_url, n.id as listing_id, c.slug from (select *, row_number() over (partition by named_coral_id order by image_url is null, first_seen_at desc, id desc) as r from listings where named_coral_id is not null and in_stock and not is_auction and last_seen_at > {since(WEEK)} and vendor_id in (select id from visible)) n join named_corals c on c.id = n.named_coral_id and c.active and not starts_with(c.slug, '_') where r = 1", VISIBLE),
    ),
    "price_history_sitemap": (
        lambda m: market.sitemap_slugs(timeseries.price_envelope(m.price_history, m.listings, m.vendors, NOW, None, 90), m.named_corals),
        sql(f"select c.slug, e.days from named_corals c join (select named_coral_id, count(distinct day) as days from states where {STATE_OK} group by 1) e on e.named_coral_id = c.id where c.active and e.days >= 2", *states("named_coral_id is not null", 90)),
    ),
    "coral_freshness": (
        lambda m: market.freshness(m.listings),
        sql("select named_coral_id, count(distinct vendor_id) filter (where in_stock) as vendors, strftime(max(last_seen_at), '%Y-%m-%dT%H:%M:%SZ') as latest from listings where named_coral_id is not null group by 1"),
    ),
    "scrape_clock": (lambda m: market.scrape_clock(m.scraper_runs), sql("select vendor_id, max(started_at) as last_started, max(finished_at) as last_finished from scraper_runs where status = 'success' group by 1")),
    "vendor_lookup": (lambda m: market.vendor_lookup(m.vendors), sql("select id, slug, replace(slug, '_', '-') as page_slug, display_name from visible", VISIBLE)),
    "digest_groups": (
        lambda m: market.digest_groups(_leads(m, 48)).select("vendor_slug", "group_size", "place", "listing_id", "event"),
        sql(f"select vendor_slug, group_size, place, listing_id, event from (select *, count(*) over (partition by vendor_slug) as group_size, row_number() over (partition by vendor_slug order by precedence, event_at desc, listing_id) as place from leads where {SHOWN} and not (event = 'just-listed' and bulk_cluster)) where place <= 3", *leads(48)),
    ),
    "digest_watchdog": (
        lambda m: market.watchdog(_leads(m, WEEK)),
        sql(f"select count(*) filter (where not (event = 'just-listed' and bulk_cluster)) as shown, count(*) filter (where event = 'just-listed' and bulk_cluster) as bulk from leads where {SHOWN}", *leads(WEEK)),
    ),
    "bulk_cluster_flips": (
        lambda m: guards.cluster_flips(m.listings, BULK).select("id", "bulk_cluster"),
        sql(f"select id, bulk_cluster or count(*) over (partition by vendor_id, first_seen_at) >= {BULK} as bulk_cluster from listings"),
    ),
    "bulk_cluster_audit": (
        lambda m: guards.cluster_drift(m.listings, BULK),
        sql(f"select vendor_id, count(*) filter (where ok) as to_true, count(*) filter (where not ok) as to_false from (select *, count(*) over (partition by vendor_id, first_seen_at) >= {BULK} as ok from listings) where ok is distinct from bulk_cluster group by 1"),
    ),
    "first_seen_repair": (
        lambda m: guards.first_seen_repair(m.listings.withColumn("first_seen_at", F.expr("first_seen_at + interval '2' hour")), m.price_history),
        sql("select l.id, l.first_seen_at + interval '2' hour as first_seen_at, min(p.observed_at) as repaired_at from listings l join price_history p on p.listing_id = l.id group by 1, 2 having min(p.observed_at) < l.first_seen_at + interval '2' hour"),
    ),
    "stale_listings": (
        lambda m: guards.stale_listings(m.listings, m.scraper_runs, NOW, 14),
        sql(f"select id, vendor_id, last_seen_at from listings l where in_stock and last_seen_at < {since(336)} and exists (select 1 from scraper_runs r where r.vendor_id = l.vendor_id and r.status = 'success' and r.started_at > l.last_seen_at)"),
    ),
}

QUERIES = {name: (lambda spark, folder, make=make: plain(make(Model(spark, folder)))) for name, (make, _) in _Q.items()}
ORACLE_SQL = {name: text for name, (_, text) in _Q.items()}
