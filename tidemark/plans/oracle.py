"""Fragments of SQL for the second engine: the steps that several queries share."""

from __future__ import annotations

from ..functions.labels import TITLE_ENDS
from ..sources.adapters import NOW, with_tables

T = f"timestamp '{NOW}'"
SHOWN = "(category is null or category not in ('equipment', 'invert'))"
VISIBLE = "visible as (select * from vendors where active and not starts_with(slug, '_'))"
PREV = "prev as (select *, lag(price) over w as prior_price, lag(in_stock) over w as prior_stock, lag(observed_at) over w as prior_at from price_history window w as (partition by listing_id order by observed_at, id))"

TITLE_SQL = f"trim(regexp_replace(regexp_replace(rtrim(strip_accents(lower(raw_title))), '(?i){TITLE_ENDS.replace(chr(39), chr(39) * 2)}', ''), '\\s+', ' ', 'g'))"


def since(hours: int) -> str:
    return f"{T} - interval '{hours}' hour"


def leads(hours: int) -> tuple[str, ...]:
    """WITH entries up to `leads`, the uncapped lead events."""
    arms = f"""arms as (
  select p.listing_id, 'price-dropped' as event, 1 as precedence, p.observed_at as event_at, p.price as new_price, p.prior_price from prev p join listings l on l.id = p.listing_id
  where p.price < p.prior_price and p.observed_at > {since(hours)} and l.in_stock and l.current_price is not null and l.auction_end_time is null and not l.is_auction
  union all
  select listing_id, 'back-in-stock', 2, observed_at, null, null from (
    select p.*, row_number() over (partition by p.listing_id order by observed_at, p.id) as n from prev p
    where p.in_stock and p.prior_stock = false and p.observed_at > {since(hours)} and p.observed_at - p.prior_at >= interval '24' hour) r
  join listings l on l.id = r.listing_id where r.n = 1 and l.in_stock and not l.is_auction
  union all
  select id, 'just-listed', 3, first_seen_at, null, null from listings where in_stock and not is_auction and first_seen_at > {since(hours)})"""
    lead = """leads as (
  select a.listing_id, a.event, a.precedence, a.event_at, a.new_price, a.prior_price, l.vendor_id, l.named_coral_id, l.raw_title, l.product_url, l.current_price, l.compare_at_price, l.category, l.bulk_cluster, l.first_seen_at, l.image_url,
         v.slug as vendor_slug, v.display_name, c.canonical_name, c.slug as coral_slug, c.origin_vendor
  from (select *, row_number() over (partition by listing_id order by precedence, event_at desc, new_price nulls last, prior_price nulls last) as n from arms) a
  join listings l on l.id = a.listing_id join visible v on v.id = l.vendor_id left join named_corals c on c.id = l.named_coral_id where a.n = 1)"""
    return (VISIBLE, PREV, arms, lead)


def tagged(hours: int, floor: float, factor: float) -> tuple[str, ...]:
    """WITH entries up to `tagged`, the lead events with their disposition."""
    days = max(30, -(-hours // 24))
    return (
        *leads(hours),
        f"runs_ok as (select vendor_id, finished_at from scraper_runs where status = 'success')",
        f"warm as (select d.*, event = 'just-listed' and not exists (select 1 from runs_ok r where r.vendor_id = d.vendor_id and r.finished_at < d.first_seen_at) as cold, event_at::date as arr_day from leads d where {SHOWN})",
        f"base as (select vendor_id, median(n) as med from (select vendor_id, first_seen_at::date as day, count(*) as n from listings where first_seen_at >= {T} - interval '{days}' day and first_seen_at < date_trunc('day', {T}) group by 1, 2) group by 1)",
        f"trip as (select c.vendor_id, c.arr_day, greatest({floor}::double, {factor}::double * coalesce(b.med, 0)) as threshold, coalesce(b.med, 0)::double as med from (select vendor_id, arr_day, count(*) as n from warm where event = 'just-listed' and not cold group by 1, 2) c left join base b on b.vendor_id = c.vendor_id where c.n > greatest({floor}::double, {factor}::double * coalesce(b.med, 0)))",
        "tagged as (select w.*, case when event <> 'just-listed' then 'kept' when cold then 'cold_start' when t.threshold is not null then 'bulk_relist' when bulk_cluster then 'bulk_cluster' else 'kept' end as guard_disposition, t.threshold as t_threshold, t.med as t_med from warm w left join trip t on t.vendor_id = w.vendor_id and t.arr_day = w.arr_day)",
    )


def drops(days: int) -> tuple[str, ...]:
    """WITH entries up to `drops`, recent price drops by either arm."""
    return (
        VISIBLE,
        PREV,
        "live as (select l.* from listings l join visible v on v.id = l.vendor_id where in_stock and current_price is not null and auction_end_time is null)",
        f"""both_arms as (select p.listing_id, 1 as arm, p.observed_at as event_at, p.id, p.price as new_price, p.prior_price from prev p join live l on l.id = p.listing_id where p.price < p.prior_price and p.observed_at > {since(24 * days)}
  union all select id, 2, markdown_started_at, 0, current_price, null from live where compare_at_price >= current_price * 1.05::decimal(3,2) and markdown_started_at > {since(24 * days)})""",
        "drops as (select a.listing_id, a.arm, a.event_at, a.new_price, a.prior_price, l.vendor_id, l.named_coral_id, l.raw_title, l.category, l.current_price, l.compare_at_price, l.bulk_cluster from (select *, row_number() over (partition by listing_id order by arm, event_at desc, id desc) as n from both_arms) a join live l on l.id = a.listing_id where n = 1)",
    )


#: WITH entries up to `velocity`, after VISIBLE.
VELOCITY = (
    f"gone as (select l.id as listing_id, l.vendor_id, l.named_coral_id from listings l join visible v on v.id = l.vendor_id join named_corals c on c.id = l.named_coral_id where not l.in_stock and l.auction_end_time is null and not l.is_auction and {SHOWN})",
    "firsts as (select g.*, min(p.observed_at) as t from gone g join price_history p on p.listing_id = g.listing_id where p.in_stock group by all)",
    "oos as (select f.listing_id, min(p.observed_at) as t from firsts f join price_history p on p.listing_id = f.listing_id and not p.in_stock and p.observed_at > f.t group by 1)",
    "prior as (select f.listing_id, max(r.finished_at) as t from firsts f join scraper_runs r on r.vendor_id = f.vendor_id and r.status = 'success' and r.finished_at < f.t group by 1)",
    "velocity as (select f.listing_id, f.vendor_id, f.named_coral_id, f.t as first_in_stock_at, o.t as first_oos_at, (select max(p.observed_at) from price_history p where p.listing_id = f.listing_id and p.in_stock and p.observed_at < o.t) as last_in_stock_at, r.t as prior_run_at from firsts f join oos o on o.listing_id = f.listing_id join prior r on r.listing_id = f.listing_id)",
)


def states(where: str, days: int | None) -> tuple[str, ...]:
    """WITH entries up to `states`, by the literal form: for every day and listing the last row of the log up to its end."""
    floor = "min(observed_at)::date" if days is None else f"greatest(min(observed_at)::date, {T}::date - {days})"
    return (
        VISIBLE,
        f"named as (select id as listing_id, named_coral_id, vendor_id from listings where {where} and vendor_id in (select id from visible))",
        f"spine as (select listing_id, unnest(generate_series({floor}::timestamp, {T}::date::timestamp, interval '1' day))::date as day from price_history join named using (listing_id) group by listing_id)",
        "states as (select n.named_coral_id, n.vendor_id, s.listing_id, s.day, (list(struct_pack(price := p.price, in_stock := p.in_stock) order by p.observed_at desc, p.id desc))[1] as s "
        "from spine s join named n using (listing_id) join price_history p on p.listing_id = s.listing_id and p.observed_at < s.day + interval '1' day group by all)",
    )


def sql(body: str, *more: str) -> str:
    return with_tables(body, *more)
