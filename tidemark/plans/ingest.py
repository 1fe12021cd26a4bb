"""The text, diff, matching, ranking and health queries over the generated tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.labels import CATEGORY_PATTERNS, CORAL_CATEGORIES, LINEAGE, LOOSE_PLATE, NOT_CORAL, NOT_PLATE
from ..operators import cdc, events, guards, health, market, matching, ranking, timeseries
from ..operators.common import plain
from ..sources import catalogues
from ..sources.adapters import NOW, Model
from .core import FACTOR, FLOOR, WEEK
from .oracle import SHOWN, T, TITLE_SQL, VELOCITY, VISIBLE, drops, leads, since, sql, tagged

MONTH = 720
# a scrape that leaves out a seventh of the listings, changes prices and stock of others, and has new ones
SCRAPE = "scrape as (select product_url, case when id % 5 = 0 then cast(current_price * cast(0.9 as decimal(2,1)) as decimal(10,2)) else current_price end as current_price, case when id % 4 = 0 then not in_stock else in_stock end as in_stock from listings where id % 7 <> 0 union all select concat(product_url, '/new'), current_price, in_stock from listings where id % 6 = 0)"
GONE = "gone as (select product_url, current_price as last_price, vendor_id from listings where in_stock and product_url not in (select product_url from scrape) and id % 14 <> 0)"
DIFF = "diff as (select s.product_url, s.current_price as now_price, s.in_stock as now_stock, l.current_price as was_price, l.in_stock as was_stock, case when l.id is null then 'new' when l.current_price is distinct from s.current_price then 'price_changed' when not l.in_stock and s.in_stock then 'restocked' when l.in_stock and not s.in_stock then 'oos' else 'unchanged' end as decision from scrape s left join listings l on l.product_url = s.product_url)"


def _scrape(m: Model) -> DataFrame:
    price = F.when(F.col("id") % 5 == 0, F.expr("cast(current_price * cast(0.9 as decimal(2,1)) as decimal(10,2))")).otherwise(F.col("current_price"))
    old = m.listings.where("id % 7 <> 0").select("product_url", price.alias("current_price"), F.when(F.col("id") % 4 == 0, ~F.col("in_stock")).otherwise(F.col("in_stock")).alias("in_stock"))
    return old.unionByName(m.listings.where("id % 6 = 0").select(F.concat("product_url", F.lit("/new")).alias("product_url"), "current_price", "in_stock"))


def _gone(m: Model) -> DataFrame:
    return cdc.cohort_gone(m.listings, _scrape(m), m.listings.where("id % 14 = 0").select("product_url"))


def _diff(m: Model) -> DataFrame:
    return cdc.classify(_scrape(m), m.listings)


def _titles(m: Model) -> DataFrame:
    return m.listings.withColumn("title", text.normalize_title(F.col("raw_title")))


def _prefixed(m: Model) -> DataFrame:
    return _titles(m).join(m.vendors.select(F.col("id").alias("vendor_id"), "originator_prefix"), "vendor_id")


def _leads(m: Model, hours: int = WEEK) -> DataFrame:
    return events.lead_events(m.price_history, m.listings, m.vendors, m.named_corals, NOW, hours, None, None)


def _arrivals(m: Model) -> DataFrame:
    return guards.guarded_arrivals(guards.dispositions(_leads(m), m.listings, m.vendors, m.scraper_runs, NOW, WEEK, FLOOR, FACTOR))


def _drops(m: Model) -> DataFrame:
    return events.recent_price_drops(m.price_history, m.listings, m.vendors, NOW)


def _velocity(m: Model) -> DataFrame:
    return timeseries.velocity(m.price_history, m.listings, m.vendors, m.named_corals, m.scraper_runs, NOW)


def _picks(m: Model) -> DataFrame:
    return m.price_history.where("id % 11 = 0 and price is not null").select("id", F.when(F.col("id") % 2 == 0, "reel").otherwise("post").alias("mode"), text.price_band(F.col("price") * 2).alias("band"), F.col("observed_at").alias("selected_at"))


def _counts(m: Model) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(f"path-{k}").alias("k"), (F.when((F.col("id") + k) % 4 == 0, F.lit(0)).otherwise(F.col("listings_seen") % (k + 2))).cast("int").alias("v")) for k in range(5)])
    return m.scraper_runs.withColumn("counts", F.map_from_entries(F.filter(pairs, lambda p: ~((p["k"] == "path-3") & (F.col("id") % 3 == 0)))))


def _paths(m: Model) -> DataFrame:
    return m.vendors.select(F.col("id").alias("vendor_id"), F.explode(F.array(*[F.lit(f"path-{k}") for k in range(6)])).alias("path"))


def _signals(m: Model) -> DataFrame:
    return health.category_signals(_counts(m), _paths(m))


def _absent_hash() -> Column:
    return F.when(F.col("vendor_id") % 2 == 0, "same").otherwise((F.col("id") % 30).cast("string"))


def _gate(m: Model) -> DataFrame:
    """The newest run of each vendor as the one to decide on, those before it as its past."""
    newest = m.scraper_runs.withColumn("n", F.row_number().over(Window.partitionBy("vendor_id").orderBy(F.col("started_at").desc(), F.col("id").desc())))
    now = newest.where("n = 1").select(
        "vendor_id", (F.col("vendor_id") % 3 != 0).alias("over"), _absent_hash().alias("absent_hash"), (F.col("vendor_id") % 11 == 10).alias("canary"), (F.col("vendor_id") % 13 == 12).cast("int").alias("matcher_errors"),
        F.lit(False).alias("partial"), F.lit(False).alias("incomplete"), F.col("listings_seen").alias("seen"),
    )
    now = now.join(m.scraper_runs.groupBy("vendor_id").agg(F.percentile("listings_seen", F.lit(0.5)).alias("median_seen")), "vendor_id")
    past = newest.where("n > 1").select("vendor_id", "started_at", "id", _absent_hash().alias("absent_hash"))
    return cdc.accept_over_cap(now, past).select("vendor_id", "over", "converged", "cohort_safe")


def _raw_type() -> Column:
    kinds = F.array(*map(F.lit, ("sps", " LPS ", "Acropora tenuis", "ZOA", "softie", "Acropora sp.")))
    return F.coalesce(F.get(kinds, (F.col("id") % 7).cast("int")), F.col("coral_type"))


def _raw_origin() -> Column:
    names = F.array(*map(F.lit, ("Community / canonical", "WWC/Tyree", "ORA", " JF ")))
    return F.coalesce(F.get(names, (F.col("id") % 6).cast("int")), F.col("origin_vendor"))


def _case_category(own: str = "raw_title") -> str:
    q = lambda p: p.replace("'", "''")
    arms = " ".join(f"when regexp_matches(hay, '(?i){q(p)}') then " + (f"case when thing then 'equipment' else '{label}' end" if label in CORAL_CATEGORIES else f"'{label}'") for label, p in CATEGORY_PATTERNS)
    return f"case {arms} when regexp_matches({own}, '(?i){q(LOOSE_PLATE)}') and not regexp_matches({own}, '(?i){q(NOT_PLATE)}') then 'lps' end"


BAND_SQL = "case when {p} >= 800 then '$800+' when {p} >= 400 then '$400-800' when {p} >= 150 then '$150-400' when {p} >= 0 then '<$150' end"
HOST = "https://img.example"
MEDAL = "medals as (select listing_id, max(greatest(0.0, (coalesce(case when prior_price > 0 then prior_price end, case when compare_at_price > 0 then compare_at_price end))::double - new_price::double)) as dollars from drops group by 1)"
CHEAP = f"offers as (select l.*, v.slug as vendor_slug from listings l join visible v on v.id = l.vendor_id where in_stock and current_price is not null and named_coral_id is not null and auction_end_time is null and {SHOWN}), cheap as (select distinct o.id from offers o join (select named_coral_id, min(current_price) as low from offers group by 1 having count(distinct vendor_id) >= 2) b on b.named_coral_id = o.named_coral_id and b.low = o.current_price)"
PENALTY = f"lastpicks as (select {BAND_SQL.format(p='price * 2')} as band from price_history where id % 11 = 0 and price is not null order by observed_at desc, id desc limit 6), penalties as (select band, greatest(0.0, count(*) / (select count(*) from lastpicks) - 0.25) / 0.75 * 8.0 as penalty from lastpicks group by 1)"
MEDIANS = f"medians as (select vendor_id, median(listings_seen) as seen, median(pages_fetched) as pages from scraper_runs where (status = 'success' or (status = 'failed' and coalesce(contains(error_message, 'silent canary'), false))) and started_at >= {since(WEEK)} group by 1)"
FIRST_SCORE = "round(100.0 * (c.id is not null)::int + 50.0 * greatest(0.0, least(1.0, coalesce(m.dollars, 0.0) / 100.0)) + 30.0 * (l.named_coral_id is not null)::int + 10.0 * greatest(0.0, least(1.0, 1.0 - (epoch({t}) - floor(epoch(l.event_at))) / (3600.0 * 168))) - coalesce(p.penalty, 0.0), 6)"

# the cascade over `texts`(title, originator_prefix, ...) and the dictionary `ents`, `al`; a stage for each table, then the first stage that has a hit
def _cascade(keys: str) -> tuple[str, ...]:
    tri = lambda x: f"list_distinct([substr('  ' || {x} || ' ', i, 3) for i in range(1, len({x}) + 2)])"
    return (
        "tt as (select distinct title from texts where title <> '')",
        "own as (select t.title, e.id, t.title = e.name as whole, row_number() over (partition by t.title order by t.title = e.name desc, len(e.name) desc, e.id) as n from tt t join ents e on starts_with(t.title || ' ', e.name || ' ') and (e.guard is null or starts_with(t.title, e.guard)))",
        "longer as (select distinct title, originator_prefix, originator_prefix || ' ' || title as text from texts where title <> '' and originator_prefix <> '')",
        "implied as (select t.title, t.originator_prefix, e.id, row_number() over (partition by t.title, t.originator_prefix order by t.text = e.name desc, len(e.name) desc, e.id) as n from longer t join ents e on starts_with(t.text || ' ', e.name || ' ') and (e.guard is null or starts_with(t.text, e.guard)))",
        "linked as (select t.title, a.named_coral_id as id, row_number() over (partition by t.title order by len(a.alias_text) desc, a.named_coral_id) as n from tt t join al a on contains(t.title, lower(a.alias_text)) and a.match_behavior = 'auto-link' and a.named_coral_id in (select id from ents))",
        "flagged as (select t.title, a.cluster_label as label, row_number() over (partition by t.title order by len(a.alias_text) desc, a.cluster_label) as n from tt t join al a on contains(t.title, lower(a.alias_text)) and a.match_behavior = 'flag-review')",
        f"tri as (select title, id, ok, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) as s from (select t.title, t.a, e.id, e.b, e.guard is null or starts_with(t.title, e.guard) as ok from (select title, {tri('title')} as a from tt) t cross join (select *, {tri('name')} as b from ents) e))",
        "best as (select *, row_number() over (partition by title order by s desc, id) as n, coalesce(lead(s) over (partition by title order by s desc, id), 0) as next from tri)",
        f"""staged as (select {keys}, case when o.id is not null then case when o.whole then 1 else 2 end when i.id is not null then 3 when l.id is not null then 4 when f.title is not null then 5 when b.id is not null then 6 end as stage,
              coalesce(o.id, i.id, l.id, b.id) as found, f.label, b.s from texts t left join own o on o.title = t.title and o.n = 1 left join implied i on i.title = t.title and i.originator_prefix = t.originator_prefix and i.n = 1
              left join linked l on l.title = t.title and l.n = 1 left join flagged f on f.title = t.title and f.n = 1 left join best b on b.title = t.title and b.n = 1 and b.s >= 0.7 and b.s - b.next >= 0.05 and b.ok)""",
        """matched as (select *, case stage when 5 then null else found end as named_coral_id, case when stage <= 3 then 'exact' when stage = 4 then 'alias' when stage = 5 then 'manual' when stage = 6 then 'fuzzy' end as match_confidence,
              case stage when 1 then 'canonical-exact' when 2 then 'canonical-prefix' when 3 then 'canonical-implicit-prefix' when 4 then 'alias-hit' when 5 then 'cluster:' || label when 6 then printf('fuzzy-%.2f', s) end as match_method from staged)""",
    )


ENTS = "ents as (select id, normalized_name as name, case when requires_vendor_prefix then lower(split_part(canonical_name, ' ', 1)) || ' ' end as guard from named_corals where active{more})"
AL = "al as (select * from aliases{more})"
HIST = (
    "lastruns as (select *, row_number() over (partition by vendor_id order by started_at desc, id desc) as n from scraper_runs where status = 'success')",
    "hist as (select l.vendor_id, 'path-' || k as path, l.n, l.started_at, case when k = 5 or (k = 3 and l.id % 3 = 0) or (l.id + k) % 4 = 0 then 0 else l.listings_seen % (k + 2) end as c from lastruns l cross join range(6) t(k) where l.n <= 14)",
)

GATED = (
    "ordered as (select *, case when vendor_id % 2 = 0 then 'same' else (id % 30)::varchar end as h, row_number() over (partition by vendor_id order by started_at desc, id desc) as n from scraper_runs)",
    "hashes as (select vendor_id, count(h) as c, min(h) as low, max(h) as high from ordered where n between 2 and 3 group by 1)",
    "gated as (select o.vendor_id, o.vendor_id % 3 <> 0 as over, h as absent_hash, o.vendor_id % 11 <> 10 and o.vendor_id % 13 <> 12 as ok, listings_seen as seen, m.median_seen from ordered o join (select vendor_id, median(listings_seen) as median_seen from scraper_runs group by 1) m on m.vendor_id = o.vendor_id where n = 1)",
)

_Q = {
    "normalized_titles": (lambda m: _titles(m).select("id", "title"), sql(f"select id, {TITLE_SQL} as title from listings")),
    "inferred_categories": (
        lambda m: m.star("documents").select("doc_id", text.infer_category(F.col("source"), F.array("lang"), F.col("text")).alias("category")).unionAll(m.listings.select("id", text.infer_category(F.lit(None), F.lit(None), F.col("raw_title")))),
        sql(
            f"select doc_id, {_case_category('own')} as category from hays",
            f"hays as (select *, regexp_matches(own, '(?i){NOT_CORAL}') as thing from (select doc_id, concat_ws(' ', coalesce(source, ''), coalesce(lang, ''), coalesce(text, '')) as hay, coalesce(text, '') as own from documents union all select id, concat_ws(' ', '', '', raw_title), raw_title from listings))",
        ),
    ),
    "lineage_flags": (
        lambda m: m.listings.select("id", text.lineage_flag(F.concat(F.when(F.col("id") % 3 == 0, "WWC ").otherwise("wwc "), F.initcap("raw_title"))).alias("flag")),
        sql(f"select id, case when regexp_matches(case when id % 3 = 0 then 'WWC ' else 'wwc ' end || upper(raw_title[1]) || lower(raw_title[2:]), '{LINEAGE}') then 'vendor-named' else 'unknown' end as flag from listings"),
    ),
    "trigram_similarity": (
        lambda m: matching.similar(_titles(m).where("title like 'corall %'").select("title").distinct(), m.named_corals.select("id", "normalized_name"), 0.5),
        sql(
            "select title, id, s from (select a.x as title, b.id, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 6) as s from (select distinct x, list_distinct([substr('  ' || x || ' ', i, 3) for i in range(1, len(x) + 2)]) as t from titled where x like 'corall %') a cross join (select id, list_distinct([substr('  ' || normalized_name || ' ', i, 3) for i in range(1, len(normalized_name) + 2)]) as t from named_corals) b) where s >= 0.5",
            f"titled as (select {TITLE_SQL} as x from listings)",
        ),
    ),
    "price_display": (
        lambda m: m.listings.select("id", text.price_value(F.col("current_price"), F.col("in_stock"), F.when(F.col("id") % 5 == 0, F.expr("cast(current_price + 5 as decimal(10,2))")), F.col("compare_at_price")).alias("v"), text.price_band(F.col("current_price")).alias("band")).select("id", "v.*", text.field_text(F.col("v")).alias("shown"), "band"),
        sql(
            f"select id, kind, value, old_value, case when old_value is null then value else old_value || ' ' || value end as shown, {BAND_SQL.format(p='current_price')} as band from (select *, case when kind = 'price-drop-new' then printf('$%.2f', current_price::double + 5) when kind = 'vendor-markdown' then printf('$%.2f', compare_at_price::double) end as old_value from (select *, case when current_price is null then 'price on request' else printf('$%.2f', current_price::double) end as value, case when not in_stock then 'invalidated' when id % 5 = 0 and current_price is not null then 'price-drop-new' when current_price > 0 and compare_at_price::double - current_price::double >= current_price::double * 0.05 - 1e-9 then 'vendor-markdown' else 'text' end as kind from listings))"
        ),
    ),
    "relative_times": (
        lambda m: m.listings.select("id", text.relative_time(F.col("last_seen_at"), F.lit(NOW).cast("timestamp_ntz")).alias("ago")),
        sql(f"select id, case when s >= 604800 then strftime(last_seen_at, '%b %-d') else n || ' ' || unit || case when n = 1 then ' ago' else 's ago' end end as ago from (select *, case when s < 3600 then greatest(1, s // 60) when s < 86400 then s // 3600 else s // 86400 end::bigint as n, case when s < 3600 then 'minute' when s < 86400 then 'hour' else 'day' end as unit from (select *, greatest(0, epoch({T})::bigint - floor(epoch(last_seen_at))::bigint) as s from listings))"),
    ),
    "drop_measures": (
        lambda m: _drops(m).select("listing_id", F.round(text.drop_fraction(F.col("new_price"), F.col("prior_price"), F.col("compare_at_price")), 6).alias("fraction"), F.round(text.drop_dollars(F.col("new_price"), F.col("prior_price"), F.col("compare_at_price")), 6).alias("dollars")),
        sql("select listing_id, round(greatest(0.0, least(1.0, (base - new_price::double) / base)), 6) as fraction, round(greatest(0.0, base - new_price::double), 6) as dollars from (select *, coalesce(case when prior_price > 0 then prior_price end, case when compare_at_price > 0 then compare_at_price end)::double as base from drops)", *drops(7)),
    ),
    "day_buckets": (
        lambda m: _leads(m).select("listing_id", text.day_divider(F.col("event_at"), F.lit(NOW).cast("timestamp_ntz"), F.col("listing_id").asc()).alias("divider"), text.day_label(F.to_date("event_at"), F.to_date(F.lit(NOW))).alias("bucket")),
        sql(f"select listing_id, case when coalesce(lag(event_at) over (order by event_at desc, listing_id), {T})::date <> event_at::date then bucket end as divider, bucket from (select *, case when n = 1 then 'YESTERDAY' when n > 1 and n < 7 then n || ' DAYS AGO' when n >= 7 then upper(strftime(event_at, '%b %-d')) end as bucket from (select *, date_diff('day', event_at::date, {T}::date) as n from leads))", *leads(WEEK)),
    ),
    "market_line": (
        lambda m: m.listings.where("named_coral_id is not null").groupBy("named_coral_id").agg(text.availability_state(F.count("*"), F.count(F.when(F.col("in_stock"), 1)), F.count(F.when(F.col("in_stock"), F.col("current_price")))).alias("state"), F.countDistinct(F.when(F.col("in_stock"), F.col("vendor_id"))).alias("vendors"), F.min(F.when(F.expr("in_stock and current_price > 0"), F.col("current_price"))).alias("low"), F.max(F.when(F.expr("in_stock and current_price > 0"), F.col("current_price"))).alias("high")),
        sql("select named_coral_id, case when count(*) filter (where in_stock) = 0 then 'all-oos' when count(current_price) filter (where in_stock) = 0 then 'price-on-request' else 'available' end as state, count(distinct vendor_id) filter (where in_stock) as vendors, (min(current_price) filter (where in_stock and current_price > 0))::double as low, (max(current_price) filter (where in_stock and current_price > 0))::double as high from listings where named_coral_id is not null group by 1"),
    ),
    "absent_set_fingerprint": (
        lambda m: _gone(m).join(m.listings.select("product_url", "vendor_id"), "product_url").groupBy("vendor_id").agg(text.set_fingerprint(F.collect_list("product_url")).alias("absent_hash"), F.count("*").alias("n")),
        sql("select vendor_id, sha256(string_agg(product_url, ',' order by product_url)) as absent_hash, count(*) as n from gone group by 1", SCRAPE, GONE),
    ),
    "diff_decisions": (lambda m: _diff(m), sql("select product_url, now_price::double as now_price, now_stock, was_price::double as was_price, was_stock, decision from diff", SCRAPE, DIFF)),
    "diff_cohort_gone": (lambda m: _gone(m), sql("select product_url, last_price::double as last_price from gone", SCRAPE, GONE)),
    "diff_counters": (
        lambda m: cdc.counters(_diff(m)),
        sql('select count(*) as seen, count(*) filter (where decision = \'new\') as "new", count(*) filter (where decision = \'price_changed\') as price_changed, count(*) filter (where decision = \'restocked\') as restocked, count(*) filter (where decision = \'oos\') as oos, count(*) filter (where decision = \'unchanged\') as unchanged from diff', SCRAPE, DIFF),
    ),
    "diff_new_snapshot": (
        lambda m: cdc.apply_scrape(m.listings, _diff(m), _gone(m), NOW).select("product_url", "current_price", "in_stock", "first_seen_at", "last_seen_at", "image_url", "vendor_id", "compare_at_price"),
        sql(f"select coalesce(l.product_url, d.product_url) as product_url, (case when d.product_url is not null then d.now_price else l.current_price end)::double as current_price, case when d.product_url is not null then d.now_stock when g.product_url is not null then false else l.in_stock end as in_stock, coalesce(l.first_seen_at, {T}) as first_seen_at, case when d.product_url is not null then {T} else l.last_seen_at end as last_seen_at, l.image_url, l.vendor_id, l.compare_at_price::double as compare_at_price from listings l full join diff d on d.product_url = l.product_url left join gone g on g.product_url = l.product_url", SCRAPE, DIFF, GONE),
    ),
    "diff_log_rows": (
        lambda m: cdc.log_rows(_diff(m), _gone(m), NOW),
        sql(f"select product_url, now_price::double as price, now_stock as in_stock, {T} as observed_at from diff where decision <> 'unchanged' union all select product_url, last_price::double, false, {T} from gone", SCRAPE, DIFF, GONE),
    ),
    "diff_mirror_queue": (
        lambda m: cdc.mirror_queue(_diff(m), m.listings),
        sql("select product_url from diff where decision = 'new' union all select product_url from diff where decision <> 'new' and product_url in (select product_url from listings where image_url is null)", SCRAPE, DIFF),
    ),
    "markdown_episodes": (
        lambda m: m.listings.select("id", cdc.markdown_started(F.when(F.col("id") % 3 != 0, F.col("compare_at_price")), F.when(F.col("id") % 5 != 0, F.col("compare_at_price")), F.col("markdown_started_at"), NOW).alias("started_at")),
        sql(f"select id, case when (case when id % 5 <> 0 then compare_at_price end) is null then null when (case when id % 3 <> 0 then compare_at_price end) is null then {T} else markdown_started_at end as started_at from listings"),
    ),
    "flip_gate": (
        lambda m: cdc.flip_gate(m.listings, _gone(m).join(m.listings.select("product_url", "vendor_id"), "product_url"), 2, 0.1),
        sql("select *, flips > cap as over from (select l.vendor_id, l.in_stock, coalesce(g.flips, 0) as flips, greatest(2, floor(l.in_stock * 0.1::double))::bigint as cap from (select vendor_id, count(*) as in_stock from listings l where l.in_stock group by 1) l left join (select vendor_id, count(*) as flips from gone group by 1) g on g.vendor_id = l.vendor_id)", SCRAPE, GONE),
    ),
    "stable_flips": (
        lambda m: _gate(m),
        sql(
            "select g.vendor_id, over, converged, ok and (not over or converged) as cohort_safe from (select g.*, over and ok and median_seen > 0 and seen >= 0.8 * median_seen and coalesce(h.c = 2 and h.low = h.high and h.low = g.absent_hash, false) as converged from gated g left join hashes h on h.vendor_id = g.vendor_id) g",
            *GATED,
        ),
    ),
    "finished_runs": (
        lambda m: cdc.finish_runs(m.scraper_runs.withColumn("status", F.when(F.col("status") == "partial", "running").otherwise(F.col("status"))), NOW),
        sql(f"select id, case when status = 'partial' and started_at < {since(6)} then 'failed' when status = 'partial' then 'running' else status end as status, case when status = 'partial' and started_at < {since(6)} then 'timeout' else error_message end as error_message from scraper_runs"),
    ),
    "entity_matches": (
        lambda m: matching.match(_prefixed(m), m.named_corals, m.aliases, NOW),
        sql(
            f"select title, originator_prefix, named_coral_id, match_confidence, match_method, case when stage is not null then {T} end as matched_at from matched",
            f"texts as (select distinct {TITLE_SQL} as title, originator_prefix from listings l join vendors v on v.id = l.vendor_id)", ENTS.format(more=""), AL.format(more=""), *_cascade("t.title, t.originator_prefix"),
        ),
    ),
    "rematched_listings": (
        lambda m: matching.rematch(_titles(m).withColumn("named_coral_id", F.when(F.col("id") % 7 == 1, F.col("named_coral_id"))).withColumn("match_method", F.when(F.col("id") % 5 == 0, "cluster:one")), m.vendors, m.named_corals, m.aliases, 37, NOW),
        sql(
            "select id, named_coral_id, match_confidence, match_method, first_seen_at as matched_at from matched where named_coral_id is not null",
            f"texts as (select l.id, first_seen_at, {TITLE_SQL} as title, originator_prefix from listings l join vendors v on v.id = l.vendor_id where v.active and last_seen_at >= {since(WEEK)} and (l.id % 7 <> 1 or named_coral_id is null) and l.id % 5 <> 0)",
            ENTS.format(more=" and id = 37"), AL.format(more=" where named_coral_id = 37"), *_cascade("t.id, t.first_seen_at"),
        ),
    ),
    "gate_reasons": (
        lambda m: _leads(m).select("listing_id", ranking.gate_reason(F.col("image_url"), HOST, F.col("current_price")).alias("reason")),
        sql(f"select listing_id, case when image_url is null then 'no-image' when not starts_with(image_url, '{HOST}/') then 'non-mirror-image' when current_price is null then 'price-on-request' when current_price < 25 then 'below-price-floor' end as reason from leads", *leads(WEEK)),
    ),
    "band_penalties": (lambda m: ranking.band_penalty(_picks(m)).withColumn("penalty", F.round("penalty", 6)), sql("select band, round(penalty, 6) as penalty from penalties", PENALTY)),
    "band_penalties_of_mode": (
        lambda m: ranking.band_penalty(_picks(m), mode="reel").withColumn("penalty", F.round("penalty", 6)),
        sql("select band, round(penalty, 6) as penalty from penalties", PENALTY.replace("where id % 11 = 0", "where id % 22 = 0")),
    ),
    "drop_medals": (lambda m: ranking.medals(_drops(m)).withColumn("dollars", F.round("dollars", 6)), sql("select listing_id, round(dollars, 6) as dollars from medals", *drops(7), MEDAL)),
    "selection": (
        lambda m: ranking.select(_leads(m), ranking.medals(_drops(m)), market.cheapest(m.listings, m.vendors), ranking.band_penalty(_picks(m)), NOW, WEEK, HOST).select("listing_id", F.round("score", 6).alias("score")),
        sql(
            f"select l.listing_id, {FIRST_SCORE.format(t=T)} as score from leads l left join medals m on m.listing_id = l.listing_id left join cheap c on c.id = l.listing_id left join penalties p on p.band = {BAND_SQL.format(p='l.current_price')} where starts_with(image_url, '{HOST}/') and current_price >= 25 order by score desc, event_at desc, l.listing_id limit 7",
            *leads(WEEK), *drops(7)[2:], MEDAL, CHEAP, PENALTY,
        ),
    ),
    "superlative_drop": (
        lambda m: ranking.superlative(_drops(m), 3, 10.0).select("listing_id", F.round("fraction", 6).alias("fraction")),
        sql("select listing_id, round(f, 6) as fraction from (select *, greatest(0.0, least(1.0, (base - current_price::double) / base)) as f from (select *, coalesce(case when prior_price > 0 then prior_price end, case when compare_at_price > 0 then compare_at_price end)::double as base from drops where named_coral_id is not null and current_price is not null)) where f < 0.9 and f >= 0.25 and current_price >= 10 order by f desc, event_at desc, listing_id limit 3", *drops(7)),
    ),
    "fastest_gone": (
        lambda m: ranking.fastest(_velocity(m), 5).select("listing_id", F.round("hours", 6).alias("hours")),
        sql("select listing_id, round((floor(epoch(first_oos_at)) - floor(epoch(prior_run_at))) / 3600, 6) as hours from velocity order by (floor(epoch(first_oos_at)) - floor(epoch(prior_run_at))) / 3600, listing_id limit 5", VISIBLE, *VELOCITY),
    ),
    "arrivals_carousel": (
        lambda m: ranking.carousel(_arrivals(m)).select("listing_id", "vendor_slug", "vendor_rank", "total"),
        sql(
            "select listing_id, vendor_slug, vendor_rank, (select count(*) from arr) as total from (select *, row_number() over (partition by vendor_slug order by event_at desc, listing_id desc) as vendor_rank from (select *, row_number() over (partition by named_coral_id order by event_at desc, listing_id desc) as n from arr where named_coral_id is not null and current_price is not null) where n = 1) order by vendor_rank > 1, event_at desc, listing_id desc limit 9",
            *tagged(WEEK, FLOOR, FACTOR), "arr as (select * from tagged where guard_disposition = 'kept' and event in ('just-listed', 'back-in-stock'))",
        ),
    ),
    "arrivals_composition": (
        lambda m: ranking.composition(_arrivals(m)),
        sql("select count(*) as total, case when count(distinct event) = 2 then 'mixed' when max(event) = 'back-in-stock' then 'all-restocks' else 'all-arrivals' end as composition from tagged where guard_disposition = 'kept' and event in ('just-listed', 'back-in-stock')", *tagged(WEEK, FLOOR, FACTOR)),
    ),
    "lineage_spotlight": (
        lambda m: ranking.spotlight(market.carriers(m.listings, m.vendors, m.named_corals)),
        sql(
            "select named_coral_id, vendor_id, id, current_price::double as current_price, first_seen_at, vendors from (select o.*, s.vendors, row_number() over (partition by vendor_id order by first_seen_at desc, id desc) as n from carried o join (select named_coral_id, count(distinct vendor_id) as vendors from carried group by 1 having count(distinct vendor_id) >= 2 and count(current_price) >= 1 order by vendors desc, max(first_seen_at) desc, named_coral_id desc limit 1) s on s.named_coral_id = o.named_coral_id where current_price is not null) where n = 1 order by first_seen_at desc, id desc limit 9",
            VISIBLE, "carried as (select l.* from listings l join visible v on v.id = l.vendor_id join named_corals c on c.id = l.named_coral_id where in_stock and auction_end_time is null and not is_auction)",
        ),
    ),
    "run_medians": (lambda m: health.run_medians(m.scraper_runs, NOW), sql("select * from medians", MEDIANS)),
    "run_gates": (
        lambda m: health.run_gates(m.scraper_runs, health.run_medians(m.scraper_runs, NOW)),
        sql("select r.id, r.vendor_id, r.listings_seen < greatest(5, 0.2::double * coalesce(m.seen, 0)) as canary, r.pages_fetched < 0.5::double * coalesce(m.pages, 0) as incomplete from scraper_runs r left join medians m on m.vendor_id = r.vendor_id", MEDIANS),
    ),
    "category_signals": (
        lambda m: _signals(m),
        sql(
            "select vendor_id, path, max(case when n = 1 then c end) as current, coalesce(min(case when c > 0 then n end), max(n) + 1) - 1 as zero_streak, max(case when c > 0 then started_at end) as last_nonzero_at, case coalesce(min(case when c > 0 then n end), max(n) + 1) - 1 when 3 then case when max(c) > 0 then 'persistence' end when 8 then case when max(c) > 0 then 'saturated' end end as verdict from hist group by 1, 2",
            *HIST,
        ),
    ),
    "signal_breadth": (
        lambda m: health.breadth(_signals(m), 1),
        sql("select *, empty_now > 1 and empty_before <= 1 as widened from (select vendor_id, count(*) filter (where z >= 1) as empty_now, count(*) filter (where z >= 2) as empty_before from (select vendor_id, path, coalesce(min(case when c > 0 then n end), max(n) + 1) - 1 as z from hist group by 1, 2) group by 1)", *HIST),
    ),
    "flips_of_a_day": (
        lambda m: health.flips_of_a_day(m.scraper_runs, NOW),
        sql(f"select vendor_id, coalesce(sum(listings_oos) filter (where status = 'success' and started_at > {since(24)}), 0)::bigint as oos from scraper_runs group by 1"),
    ),
    "digest_buckets": (
        lambda m: health.digest_buckets(_counts(m), _paths(m)),
        sql(
            "select vendor_id, path, bucket, current, streak, case when bucket = 'pinged' then case when own < reached then own + interval '1' hour else own end end as slot, case when bucket in ('sparse', 'healthy') then median end as median, coalesce(bucket in ('sparse', 'healthy') and median > 0 and abs(current - median) / median > 0.5, false) as deviates, coalesce(bucket in ('sparse', 'healthy') and median >= 5 and abs(current - median) / median > 0.5, false) as shown "
            "from (select *, date_trunc('hour', reached) + interval '11' minute as own, case when most = 0 then 'curator-empty' when streak >= 3 then 'pinged' when streak >= 1 then 'warn' when current < 3 then 'sparse' else 'healthy' end as bucket from each)",
            *HIST,
            "streaks as (select vendor_id, path, max(c) as most, max(case when n = 1 then c end) as current, coalesce(min(case when c > 0 then n end), max(n) + 1) - 1 as streak, max(started_at) as newest from hist group by 1, 2)",
            "each as (select s.*, (select started_at from hist h where h.vendor_id = s.vendor_id and h.path = s.path and h.n = s.streak - 2) as reached, (select median(c) from hist h where h.vendor_id = s.vendor_id and h.path = s.path and h.started_at >= s.newest - interval '168' hour) as median from streaks s)",
        ),
    ),
    "slot_membership": (
        lambda m: m.scraper_runs.select("id", health.slot_of(F.col("started_at")).alias("slot"), health.in_slot(F.col("started_at"), F.lit("2024-01-15 12:05:00").cast("timestamp_ntz")).alias("current")),
        sql("select id, case when date_trunc('hour', started_at) + interval '11' minute < started_at then date_trunc('hour', started_at) + interval '71' minute else date_trunc('hour', started_at) + interval '11' minute end as slot, started_at > timestamp '2024-01-15 10:11:00' and started_at <= timestamp '2024-01-15 11:11:00' as current from scraper_runs"),
    ),
    "category_coverage": (
        lambda m: health.coverage(m.listings.withColumn("category", F.when(F.col("id") % 4 != 0, F.col("category"))), m.vendors, text.infer_category(F.lit(None), F.lit(None), F.col("raw_title")).isNotNull()),
        sql(
            "select vendor_id, count(*) as n, count(*) filter (where c is null) as missing, round(count(*) filter (where c is null) / count(*), 6) as share, count(*) filter (where c is null and found is not null) as recoverable from classed group by rollup(vendor_id)",
            f"classed as (select vendor_id, case when id % 4 <> 0 then category end as c, {_case_category()} as found from (select *, concat_ws(' ', '', '', raw_title) as hay, regexp_matches(raw_title, '(?i){NOT_CORAL}') as thing from listings) where in_stock and not is_auction and vendor_id in (select id from vendors where not starts_with(slug, '_')))",
        ),
    ),
    "oos_calibration": (
        lambda m: health.oos_calibration(m.scraper_runs, NOW),
        sql(f"select vendor_id, count(*) as runs, quantile_cont(listings_oos, 0.5) as p50, round(quantile_cont(listings_oos, 0.95), 6) as p95, max(listings_oos) as most from scraper_runs where status = 'success' and started_at >= {since(336)} group by 1"),
    ),
    "oos_top_runs": (
        lambda m: health.oos_top(m.scraper_runs, NOW),
        sql(f"select vendor_id, place, id, listings_oos from (select *, row_number() over (partition by vendor_id order by listings_oos desc, id) as place from scraper_runs where status = 'success' and started_at >= {since(336)}) where place <= 3"),
    ),
    "stock_transitions": (lambda m: health.transitions(m.price_history), sql("select was, in_stock as now, count(*) as n from (select *, lag(in_stock) over (partition by listing_id order by observed_at, id) as was from price_history) where was is not null group by 1, 2")),
    "price_quantiles": (
        lambda m: health.nearest_rank(m.listings.where("in_stock"), ["vendor_id"], "current_price", (0.1, 0.5, 0.9)),
        sql("select vendor_id, n, " + ", ".join(f"prices[(floor(x{q}) + case when x{q} - floor(x{q}) > 0.5 or (x{q} - floor(x{q}) = 0.5 and floor(x{q})::bigint % 2 = 1) then 1 else 0 end)::bigint + 1]::double as p{q}" for q in (10, 50, 90)) + " from (select *, (n - 1) * 0.1::double as x10, (n - 1) * 0.5::double as x50, (n - 1) * 0.9::double as x90 from (select vendor_id, count(*) as n, list(current_price order by current_price) as prices from listings where in_stock and current_price is not null group by 1))"),
    ),
    "week_cover": (lambda m: health.week_cover(_leads(m)), sql("select vendor_slug, event, event_at::date::varchar as day, count(*) as n from leads group by 1, 2, 3", *leads(WEEK))),
    "cluster_census": (
        lambda m: health.cluster_census(m.listings, 3),
        sql("select count(*) as groups, coalesce(sum(n), 0)::bigint as listings from (select count(*) as n from listings group by vendor_id, first_seen_at having count(*) >= 3)"),
    ),
    "title_leaks": (
        lambda m: health.leak_audit(m.listings, "(?i)frag", "(?i)torch"),
        sql("select vendor_id, count(*) as hits, min(raw_title) as sample from listings where in_stock and regexp_matches(raw_title, '(?i)frag') and not regexp_matches(raw_title, '(?i)torch') group by 1"),
    ),
    "absent_from_last_run": (
        lambda m: health.absent_from_last_run(m.listings, m.scraper_runs),
        sql("select l.id, l.vendor_id, l.current_price::double as current_price, l.last_seen_at from listings l join (select vendor_id, max(finished_at) as t from scraper_runs where status = 'success' group by 1) r on r.vendor_id = l.vendor_id where l.in_stock and l.last_seen_at < r.t - interval '5' minute"),
    ),
    "stale_partition": (
        lambda m: health.stale_partition(guards.stale_listings(m.listings, m.scraper_runs, NOW, 7).join(m.listings.select("id", "product_url"), "id"), m.listings.where("id % 3 <> 0").select("product_url", (F.col("id") % 2 == 0).alias("accepted"))),
        sql(f"select product_url, case when id % 3 = 0 then 'not-in-catalogue' when id % 2 = 1 then 'rejected' else 'stale' end as part from listings l where in_stock and last_seen_at < {since(WEEK)} and exists (select 1 from scraper_runs r where r.vendor_id = l.vendor_id and r.status = 'success' and r.started_at > l.last_seen_at)"),
    ),
    "reclassification": (
        lambda m: health.reclassification(m.listings.select(F.col("category").alias("stored"), F.when(F.col("id") % 4 != 0, "lps").alias("inferred"), "id"), F.col("id") % 2 == 0, 100, 0.5),
        sql("select *, fill + correct <= 100 and fill + correct <= 0.5::double * n as allowed from (select count(*) as n, count(*) filter (where category is null and id % 4 <> 0) as fill, count(*) filter (where category is not null and category is distinct from (case when id % 4 <> 0 then 'lps' end) and id % 2 = 0) as correct, count(*) filter (where category is not null and category is distinct from (case when id % 4 <> 0 then 'lps' end) and id % 2 = 1) as drift from listings)"),
    ),
    "without_rejected": (lambda m: health.without_rejected(m.listings, m.listings.where("id % 9 = 0")).select("id", "product_url"), sql("select id, product_url from listings where id % 9 <> 0")),
    "auction_repair": (
        lambda m: health.auction_repair(m.listings, m.listings.where("id % 10 = 0")),
        sql("select id, case when in_stock and id % 10 = 0 then null else current_price::double end as current_price, is_auction or (in_stock and id % 10 = 0) as is_auction from listings"),
    ),
    "purge_dependants": (lambda m: health.dependants(m.listings.where("id % 17 = 0").select("id"), m.price_history), sql("select l.id, count(p.id) as rows from listings l left join price_history p on p.listing_id = l.id where l.id % 17 = 0 group by 1")),
    "repair_id_check": (
        lambda m: health.same_ids(m.listings.where("id % 5 = 0").select("id"), m.listings.where("id % 10 = 0").select("id")),
        sql("select count(*) filter (where id % 5 = 0 and id % 10 <> 0) as unexpected, count(*) filter (where id % 10 = 0 and id % 5 <> 0) as absent from listings"),
    ),
    "cohort_decisions": (
        lambda m: cdc.cohort_decisions(_diff(m).join(m.listings.select("product_url", "vendor_id"), "product_url"), _gone(m).join(m.listings.select("product_url", "vendor_id"), "product_url"), _gate(m)),
        sql(
            "select l.vendor_id, d.product_url, d.decision from diff d join listings l on l.product_url = d.product_url union all select g.vendor_id, g.product_url, 'oos' from gone g join safe s on s.vendor_id = g.vendor_id",
            SCRAPE, GONE, DIFF, *GATED,
            "safe as (select g.vendor_id from gated g left join hashes h on h.vendor_id = g.vendor_id where ok and (not over or median_seen > 0 and seen >= 0.8 * median_seen and coalesce(h.c = 2 and h.low = h.high and h.low = g.absent_hash, false)))",
        ),
    ),
    "type_labels": (
        lambda m: m.named_corals.select("id", text.type_label(_raw_type()).alias("t")).select("id", "t.*"),
        sql("select id, case when upper(x) in ('SPS', 'LPS') then upper(x) when not regexp_matches(x, '^[A-Z][a-z]+\\s+[a-z]+$') and lower(x) in ('zoa', 'chalice', 'clam', 'anemone', 'softie', 'mushroom') then upper(x[1]) || lower(x[2:]) else x end as display, upper(x) not in ('SPS', 'LPS') and regexp_matches(x, '^[A-Z][a-z]+\\s+[a-z]+$') as italic from (select id, trim(case id % 7 when 0 then 'sps' when 1 then ' LPS ' when 2 then 'Acropora tenuis' when 3 then 'ZOA' when 4 then 'softie' when 5 then 'Acropora sp.' else coral_type end) as x from named_corals)"),
    ),
    "originators": (
        lambda m: m.named_corals.select("id", text.originator(_raw_origin()).alias("display")),
        sql("select id, case id % 6 when 0 then null when 1 then 'World Wide Corals / Steve Tyree' when 2 then 'ORA' when 3 then 'Jason Fox Signature Corals' else trim(origin_vendor) end as display from named_corals"),
    ),
    "tied_vendors": (
        lambda m: m.listings.where("named_coral_id is not null").groupBy("named_coral_id").agg(text.tied_vendors(F.transform(F.array_sort(F.collect_set("vendor_id")), lambda v: F.concat(F.lit("v"), v.cast("string"))), 1).alias("vendors")),
        sql("select named_coral_id, 'v' || min(vendor_id) || case when count(distinct vendor_id) > 1 then ' +' || (count(distinct vendor_id) - 1) else '' end as vendors from listings where named_coral_id is not null group by 1"),
    ),
    "page_skeletons": (
        lambda m: catalogues.skeleton_hashes(m.star("pages").select(F.col("url").alias("path"), "html")),
        # the generated pages have one class at most for each element, and no start tags inside scripts
        "select url as path, len(t) as tags, sha256(array_to_string(list_transform(t, lambda x: regexp_extract(x, '^<([a-z0-9]+)', 1) || '.' || regexp_extract(x, 'class=\"([^\"]*)\"', 1)), chr(10))) as skeleton_hash, contains(coalesce(html, ''), 'data-no-products-notification') as empty from (select *, regexp_extract_all(coalesce(html, ''), '<[a-z][^>]*>') as t from pages)",
    ),
}

QUERIES = {name: (lambda spark, folder, make=make: plain(make(Model(spark, folder)))) for name, (make, _) in _Q.items()}
ORACLE_SQL = {name: query for name, (_, query) in _Q.items() if query}
