"""The studies, audits, rules, crawls, digests and charts over the generated tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chart, text
from ..operators import health, market, studies, timeseries
from ..operators.common import plain
from ..sources import catalogues
from ..sources.adapters import NOW, Model
from .core import FACTOR, FLOOR, MONTH, _arrivals, _leads, _tagged
from .documents import _products
from .oracle import SHOWN, T, leads, sql, states, tagged

FAST = 240
FLIPS = "flips as (select p.*, l.vendor_id, l.named_coral_id, lag(p.in_stock) over (partition by p.listing_id order by p.observed_at, p.id) as was from price_history p join listings l on l.id = p.listing_id)"
FIRSTS = "firsts as (select listing_id, vendor_id, named_coral_id, min(observed_at) filter (where in_stock) as fs from flips group by 1, 2, 3)"
GOINGS = "goings as (select f.*, (select min(observed_at) from price_history p where p.listing_id = f.listing_id and not p.in_stock and p.observed_at > f.fs) as foa from firsts f where fs is not null)"
PASS = "(select max_by(id, (started_at, id)) from scraper_runs r where r.vendor_id = {of}.vendor_id and r.started_at <= {at})"
FASTS = f"""fasts as (select g.listing_id, g.vendor_id, g.named_coral_id, g.fs as first_in_stock_at, g.foa as first_oos_at, exists (select 1 from price_history p where p.listing_id = g.listing_id and p.in_stock and p.observed_at > g.foa) as relisted,
  case when g.named_coral_id is not null then exists (select 1 from firsts o where o.vendor_id = g.vendor_id and o.named_coral_id = g.named_coral_id and o.listing_id <> g.listing_id and o.fs > g.foa and o.fs <= g.foa + interval '168' hour) end as coral_reappeared,
  {PASS.format(of='g', at='g.foa')} as run_id from goings g where g.foa - g.fs <= interval '{FAST}' hour)"""
CHURN = "churned as (select vendor_id, listing_id, count(*) filter (where in_stock <> was) as transitions from flips group by 1, 2)"
SIZES = f"sizes as (select vendor_id, run_id, count(*) as size from (select f.vendor_id, {PASS.format(of='f', at='f.observed_at')} as run_id from flips f where was and not in_stock) where run_id is not null group by 1, 2)"


def _fast(m: Model) -> DataFrame:
    return studies.fast_goings(m.price_history, m.listings, m.scraper_runs, FAST)


def _newest(m: Model) -> DataFrame:
    return m.price_history.agg(F.max("observed_at").alias("at"))


def _rank(values: str, q: float) -> str:
    """The nearest rank of a sorted list, halves to even, 0 without values."""
    x = f"((len({values}) - 1) * {q}::double)"
    return f"coalesce({values}[(floor{x} + case when {x} - floor{x} > 0.5 or ({x} - floor{x} = 0.5 and floor{x}::bigint % 2 = 1) then 1 else 0 end)::bigint + 1], 0)"


VERDICT = f"""select *, case when fast = 0 then 'none' when relist_rate < 0.1 and reappear_rate < 0.2 and churn_median <= 2 and churn_p90 <= 4 and isolated_share >= 0.5 then 'ship' else 'hold' end as verdict from (
  select c.vendor_id, c.listings, c.churn_most, round(c.churny / c.listings, 6) as churny_share, {_rank('c.t', 0.5)} as churn_median, {_rank('c.t', 0.9)} as churn_p90,
    coalesce(fast, 0) as fast, coalesce(f.relisted, 0) as relisted, coalesce(fair, 0) as fair, coalesce(fair_relisted, 0) as fair_relisted, coalesce(fair_named, 0) as fair_named, coalesce(fair_reappeared, 0) as fair_reappeared, coalesce(sized, 0) as sized, coalesce(isolated, 0) as isolated, coalesce(bulk, 0) as bulk, coalesce(passes, 0) as passes,
    coalesce(g.n, 0) as biggest_pass, {_rank('f.s', 0.5)} as cluster_median,
    round(coalesce(fair_relisted / nullif(fair, 0), 0), 6) as relist_rate, round(coalesce(fair_reappeared / nullif(fair_named, 0), 0), 6) as reappear_rate, round(coalesce(isolated / nullif(sized, 0), 0), 6) as isolated_share, round(coalesce(bulk / nullif(sized, 0), 0), 6) as bulk_share, round(coalesce(g.n / nullif(fast, 0), 0), 6) as biggest_share
  from (select vendor_id, count(*) as listings, max(transitions) as churn_most, count(*) filter (where transitions >= 3) as churny, list(transitions order by transitions) as t from churned group by 1) c
  left join (select f.vendor_id, count(*) as fast, count(*) filter (where relisted) as relisted, count(*) filter (where ok) as fair, count(*) filter (where ok and relisted) as fair_relisted, count(*) filter (where ok and coral_reappeared is not null) as fair_named, count(*) filter (where ok and coral_reappeared) as fair_reappeared,
      count(size) as sized, count(*) filter (where size = 1) as isolated, count(*) filter (where size >= 10) as bulk, count(distinct run_id) as passes, list(size order by size) filter (where size is not null) as s
    from (select f.*, s.size, first_oos_at <= (select max(observed_at) from price_history) - interval '168' hour as ok from fasts f left join sizes s on s.vendor_id = f.vendor_id and s.run_id = f.run_id) f group by 1) f on f.vendor_id = c.vendor_id
  left join (select vendor_id, max(n) as n from (select vendor_id, count(*) as n from fasts where run_id is not null group by vendor_id, run_id) group by 1) g on g.vendor_id = c.vendor_id)"""

TERMS = [(None, "contains", "colony"), (None, "prefix", "rare morph"), (None, "exact", "Mystery Zoanthid Pack - sold out"), (3, "contains", "CORAL"), (10, "prefix", "coral 1"), (None, "contains", "frag 1"), (12, "exact", "corall 37")]
OLD_TERMS = [t for t in TERMS if t[1] != "prefix" and t[2] != "frag 1"]
_values = lambda terms: ", ".join(f"({'null' if v is None else v}::bigint, '{a}', '{t.lower()}', '{t}')" for v, a, t in terms)
HIT = "(t.vendor_id is null or t.vendor_id = l.vendor_id) and case t.axis when 'contains' then contains(lower(raw_title), t.low) when 'prefix' then starts_with(lower(raw_title), t.low) else trim(lower(raw_title)) = t.low end"


def _terms(m: Model, terms: list[tuple] = TERMS) -> DataFrame:
    return m.spark.createDataFrame(terms, "vendor_id long, axis string, term string")


RULES_JSON = {
    0: '{"product_types": ["lps", "sps", ""], "no_tags": ["frag pack"], "tags": null}', 1: '{"tags": ["coral"], "no_title_starts": ["RARE morph"], "auction_tags": ["auction3"]}', 2: '{"no_sku_ends": ["-x"], "no_titles": [" corall 37 "], "no_title_parts": ["frag"]}',
    3: '{"no_tags": "frag", "colour": ["red"], "tags": ["", " coral"], "product_types": [" ", 5, null, {"a": 1}]}', 4: '["lps"]', 5: "{not json", 6: '{"no_title_parts": [], "no_tags": [" - "], "no_titles": ["  "]}',
}


def _configs(m: Model) -> DataFrame:
    text = F.element_at(F.create_map(*[F.lit(x) for pair in RULES_JSON.items() for x in pair]), (F.col("id") % 8).cast("int"))
    return m.vendors.select(F.col("id").alias("vendor_id"), F.when(F.col("id") % 8 < 7, text).alias("filter"))


def _vendor_products(m: Model) -> DataFrame:
    return _products(m).join(m.listings.select("id", "vendor_id"), "id")


RULED = """select id, case when not in_stock then 'unavailable' when k = 0 and coalesce(category not in ('lps', 'sps', ''), true) then 'product-type' when k = 1 and id % 8 <> 0 and not (id % 8 > 1) then 'tag-missing' when k = 0 and id % 8 = 1 then 'tag-denied'
  when k = 2 and contains(lower(raw_title), 'frag') then 'no_title_parts' when k = 1 and starts_with(lower(raw_title), 'rare morph') then 'no_title_starts' when k = 2 and trim(lower(raw_title)) = 'corall 37' then 'no_titles' when k = 2 and id % 5 = 0 then 'sku-denied' end as why from (select *, vendor_id % 8 as k from listings)"""


def _live(m: Model, rules: int) -> DataFrame:
    """What the live catalogue and the filters of the first vendors say of the listings; a ninth of them are in it no more."""
    why = catalogues.keep_reasons(_vendor_products(m), catalogues.filter_rules(_configs(m))[0].where(F.col("vendor_id") % 8 < rules)).select("id", "why")
    return why.join(m.listings.where("id % 9 <> 4").select("id", "vendor_id", "product_url"), "id")


def _priced_cards(m: Model) -> DataFrame:
    price = F.when(F.col("id") % 5 > 0, F.concat(F.lit("$ "), F.format_number(F.col("current_price"), 2))).otherwise("ask")
    was = F.when(F.col("id") % 3 > 0, F.concat(F.lit('<s class="price price--non-sale"> $'), F.format_number(F.col("current_price") * 100, 2), F.lit(" </s>"))).otherwise('<s class="price--non-sale"></s>')
    card = F.concat(F.lit('<li><article data-name="n" data-entity-id="'), "id", F.lit('" data-product-price="'), F.coalesce(price, F.lit("")), F.lit('">'), F.coalesce(was, F.lit("")), F.lit("</article></li>"))
    return m.listings.select(F.col("id").cast("string").alias("path"), card.alias("html"))


def _guide_files(m: Model) -> DataFrame:
    updated = F.concat(F.lit("updated: 2024-01-"), F.lpad((F.col("id") % 28 + 1).cast("string"), 2, "0"), F.lit("T00:00:00Z\n"))
    title = F.concat(F.lit('title: "'), "canonical_name", F.lit(': basics"\n'))
    more = F.when(F.col("id") % 4 == 1, F.concat(title, F.lit("kind: CARE\n"))).when(F.col("id") % 4 == 2, F.concat(title, F.lit("description:  About it \n"))).otherwise("")
    text = F.concat(F.when(F.col("id") % 4 == 3, "").otherwise(F.concat(F.lit("---\n"), more, updated, F.lit("---\n"))), F.lit("Body "), "canonical_name")
    return m.named_corals.select(F.concat(F.lit("/guides/"), F.when(F.col("id") % 6 == 5, "Guide_").otherwise("guide-"), "id", F.lit(".mdx")).alias("path"), text.alias("content"))


def _grid_pages(m: Model) -> DataFrame:
    """Paths and pages of each vendor: 4 paths with up to 6 pages that end in different ways."""
    rows = m.vendors.select(F.col("id").alias("vendor_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")).select("*", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("page"))
    x = F.pmod(F.col("vendor_id") * 7 + F.col("k") * 5 + F.col("page") * 3, F.lit(11))
    return rows.select("vendor_id", F.concat(F.lit("/p"), "k").alias("path"), "page", F.when(x == 0, 404).otherwise(200).alias("status"), F.when((x == 1) & (F.col("vendor_id") % 5 == 0), "block").when((x == 2) & (F.col("vendor_id") % 5 == 1), "http_5xx").alias("error"), F.when(x < 5, 0).otherwise(x).alias("cards"), (x == 4).alias("empty"))


PAGES_SQL = (
    "grid as (select id as vendor_id, k, page, (id * 7 + k * 5 + page * 3) % 11 as x from vendors, range(4) a(k), range(1, 7) b(page))",
    "fetched as (select vendor_id, '/p' || k as path, page, x = 0 as gone, case when x = 1 and vendor_id % 5 = 0 then 'block' when x = 2 and vendor_id % 5 = 1 then 'http_5xx' end as error, case when x < 5 then 0 else x end as cards, x = 4 as empty from grid)",
    "ended as (select *, case when gone then 'not-found' when error is not null then 'failed' when cards = 0 then 'no-cards' end as e from fetched)",
    "crawled as (select vendor_id, path, count(*) filter (where e is null or e = 'no-cards') as pages, coalesce(sum(cards) filter (where e is null), 0)::bigint as n, coalesce(bool_or(page = 1 and e = 'no-cards' and empty), false) as marked_empty, coalesce(bool_or(page = 1 and e = 'not-found'), false) as missing, max(e) as \"end\", max(error) filter (where e = 'failed') as error from ended x where not exists (select 1 from ended y where y.vendor_id = x.vendor_id and y.path = x.path and y.page < x.page and y.e is not null) group by 1, 2)",
)
SURFACE = "select vendor_slug, event_at::date as day, count(*) as n from {} group by 1, 2"
SITE = "shop.example"
BUDGET = 6000
DIGEST_LINE = f"""case when product_url ilike 'https://%' then '[**' || raw_title || '**](<' || product_url || '>)' else '**' || raw_title || '**' end || ' — Price. ' || case when prior_price is not null and current_price is not null then '~~' || printf('$%.2f', prior_price::double) || '~~ '
  when current_price > 0 and compare_at_price::double - current_price::double >= current_price::double * 0.05 - 1e-9 then '~~' || printf('$%.2f', compare_at_price::double) || '~~ ' else '' end || coalesce(printf('$%.2f', current_price::double), 'price on request') || ' — ' || case when event = 'back-in-stock' then 'Back' else 'Listed' end || '. ' ||
  case when s < 3600 then greatest(1, s // 60) || ' minute' || case when greatest(1, s // 60) = 1 then ' ago' else 's ago' end when s < 86400 then s // 3600 || ' hour' || case when s // 3600 = 1 then ' ago' else 's ago' end else s // 86400 || ' day' || case when s // 86400 = 1 then ' ago' else 's ago' end end"""
DIGEST = (
    f"rows_ as (select *, row_number() over (partition by display_name order by precedence, event_at desc, listing_id) as r, greatest(0, epoch({T})::bigint - floor(epoch(event_at))::bigint) as s from leads where {SHOWN} and not (event = 'just-listed' and bulk_cluster))",
    f"per as (select display_name, count(*) as n, '**' || display_name || '** — ' || count(*) || case when count(*) = 1 then ' drop' else ' drops' end as head, string_agg({DIGEST_LINE}, chr(10) order by r) filter (where r <= 3) as lines from rows_ group by 1)",
    f"texts as (select display_name, n, head || chr(10) || lines || case when n > 3 then chr(10) || '+ ' || (n - 3) || ' more at {SITE}' else '' end as w, head || chr(10) || '+ ' || n || ' more at {SITE}' as c, row_number() over (order by n desc, lower(display_name), display_name) as place from per)",
    # collapsed one by one from the end: what is left whole before a block is judged is everything up to it
    f"judged as (select place, display_name, n, w, c, (select sum(len(w)) from texts b where b.place <= a.place) + coalesce((select sum(len(c)) from texts b where b.place > a.place), 0) + 2 * ((select count(*) from texts) - 1) + 10 > {BUDGET} as collapsed from texts a)",
)


def _points(m: Model) -> DataFrame:
    return timeseries.price_by_vendor(m.price_history, m.listings, m.vendors, NOW)


AXIS = (
    "lines as (select named_coral_id, vendor_id, day, min(s.price)::double as price from states where s.in_stock and s.price > 0 group by 1, 2, 3)",
    "spans as (select named_coral_id, min(price) as lo, max(price) as hi from lines group by 1)",
    "axes as (select named_coral_id, lo - pad as y_min, hi + pad as y_max from (select *, case when lo = hi then greatest(abs(lo) * 0.1, 1.0) else (hi - lo) * 0.06 end as pad from spans))",
)


def _ends(m: Model) -> DataFrame:
    last = _points(m).groupBy("named_coral_id", "vendor_id").agg(F.max_by("price", "day").alias("price"), F.max("day").alias("day"))
    rows = last.join(chart.price_axis(_points(m), ["named_coral_id"]), "named_coral_id")
    return rows.select("named_coral_id", F.concat(F.lit("v"), "vendor_id").alias("label"), F.round(chart.scaled_y(F.col("price").cast("double"), F.col("y_min"), F.col("y_max")) + chart.LABEL_DOWN, 2).alias("y"))


ENDS = (
    "ends as (select named_coral_id, label, y, row_number() over (partition by named_coral_id order by y, label) as k from (select l.named_coral_id, 'v' || vendor_id as label, round(24 + (y_max - max_by(price, day)) / (y_max - y_min) * 264 + 3.5, 2) as y from lines l join axes a on a.named_coral_id = l.named_coral_id group by l.named_coral_id, vendor_id, y_max, y_min))",
    # both folds step by step
    "down as (select named_coral_id, label, y, k, y as d from ends where k = 1 union all select e.named_coral_id, e.label, e.y, e.k, greatest(e.y, d.d + 13) from down d join ends e on e.named_coral_id = d.named_coral_id and e.k = d.k + 1)",
    "up as (select named_coral_id, label, y, k, least(d, 300) as placed from down x where k = (select max(k) from ends e where e.named_coral_id = x.named_coral_id) union all select d.named_coral_id, d.label, d.y, d.k, least(least(d.d, 300), u.placed - 13) from up u join down d on d.named_coral_id = u.named_coral_id and d.k = u.k - 1)",
)

_Q = {
    "fast_gone": (lambda m: _fast(m), sql("select * from fasts", FLIPS, FIRSTS, GOINGS, FASTS)),
    "listing_churn": (lambda m: studies.churn(m.price_history, m.listings), sql("select * from churned", FLIPS, CHURN)),
    "going_clusters": (lambda m: studies.going_clusters(m.price_history, m.listings, m.scraper_runs), sql("select * from sizes", FLIPS, SIZES)),
    "going_verdicts": (
        lambda m: studies.going_verdicts(_fast(m), studies.churn(m.price_history, m.listings), studies.going_clusters(m.price_history, m.listings, m.scraper_runs), _newest(m)),
        sql(VERDICT, FLIPS, FIRSTS, GOINGS, FASTS, CHURN, SIZES),
    ),
    "deny_term_hits": (
        lambda m: studies.term_hits(m.listings, _terms(m)),
        sql(f"select distinct l.id, t.term, t.axis from listings l join terms t on {HIT}", f"terms(vendor_id, axis, low, term) as (values {_values(TERMS)})"),
    ),
    "false_kills": (
        lambda m: studies.false_kills(m.listings, _terms(m, OLD_TERMS), _terms(m)),
        sql(
            f"select l.id, l.vendor_id, l.raw_title, string_agg(distinct t.axis || ':' || t.term, ', ' order by t.axis || ':' || t.term) as terms from listings l join terms t on {HIT} where not exists (select 1 from old t where {HIT}) group by 1, 2, 3",
            f"terms(vendor_id, axis, low, term) as (values {_values(TERMS)})", f"old(vendor_id, axis, low, term) as (values {_values(OLD_TERMS)})",
        ),
    ),
    "term_collisions": (
        lambda m: studies.collisions(m.listings, m.listings.where("id % 50 = 8").select("vendor_id", F.col("raw_title").alias("term"), "id")),
        sql("select distinct l.id, l.vendor_id, e.raw_title as term from listings l join listings e on e.id % 50 = 8 and e.vendor_id = l.vendor_id and contains(lower(l.raw_title), lower(e.raw_title)) where not (l.id % 50 = 8 and l.raw_title = e.raw_title)"),
    ),
    "terms_within_only": (
        lambda m: studies.within_only(m.listings, m.spark.createDataFrame([(None, "Frag"), (None, "coral")], "vendor_id long, term string")),
        sql("select id, t as term from listings, (values ('Frag'), ('coral')) x(t) where contains(lower(raw_title), lower(t)) and not starts_with(lower(raw_title), lower(t))"),
    ),
    "repair_gates": (
        lambda m: studies.repair_gate(m.listings.where("in_stock and raw_title like 'Rare%'").select("vendor_id", "id"), m.listings.where("in_stock and raw_title like 'Rare%' and id % 40 <> 8").select("vendor_id", "id"), m.scraper_runs),
        sql("select d.vendor_id, count(*) as derived, count(*) filter (where d.id % 40 = 8) as unexpected, 0::bigint as absent, case when max(r.status) = 'success' then max(r.id) end as run_id, count(*) filter (where d.id % 40 = 8) = 0 and coalesce(max(r.status) = 'success', false) as ready from listings d left join (select vendor_id, max_by(status, (started_at, id)) as status, max_by(id, (started_at, id)) as id from scraper_runs group by 1) r on r.vendor_id = d.vendor_id where d.in_stock and d.raw_title like 'Rare%' group by 1"),
    ),
    "bridged_stock": (
        lambda m: studies.stock_bridge(m.listings, *(_ready(m),) * 2, m.scraper_runs)[0].select("id", "in_stock"),
        sql("select l.id, l.in_stock and not coalesce(l.raw_title like 'Rare%' and r.status = 'success', false) as in_stock from listings l left join (select vendor_id, max_by(status, (started_at, id)) as status from scraper_runs group by 1) r on r.vendor_id = l.vendor_id"),
    ),
    "bridged_log": (
        lambda m: studies.stock_bridge(m.listings, *(_ready(m),) * 2, m.scraper_runs)[1],
        sql("select l.id as listing_id, l.current_price::double as price, false as in_stock, r.id as scraper_run_id from listings l join (select vendor_id, max_by(status, (started_at, id)) as status, max_by(id, (started_at, id)) as id from scraper_runs group by 1) r on r.vendor_id = l.vendor_id where l.in_stock and l.raw_title like 'Rare%' and r.status = 'success'"),
    ),
    "review_samples": (
        lambda m: studies.review_sample(m.listings, F.col("vendor_id") % 10 == 0, "seed-7", 2, 3),
        sql("select id, vendor_id, current_price::double as current_price, a <= 2 as dear, b <= 3 as drawn from (select *, row_number() over (partition by vendor_id order by current_price desc nulls last, id) as a, row_number() over (partition by vendor_id order by md5('seed-7:' || id), id) as b from listings) where a <= 2 or b <= 3 or vendor_id % 10 = 0"),
    ),
    "surfaces_agree": (
        lambda m: studies.reconcile(studies.by_vendor_and_day(_arrivals(m, MONTH)), studies.by_vendor_and_day(_tagged(m, MONTH)), ["vendor_slug", "day"], "n"),
        sql(
            f"select vendor_slug, day::varchar as day, a.n as left, b.n as right from ({SURFACE.format('kept')}) a full join ({SURFACE.format('wide')}) b using (vendor_slug, day) where a.n is distinct from b.n",
            *tagged(MONTH, FLOOR, FACTOR), "kept as (select * from tagged where guard_disposition = 'kept')", "wide as (select * from tagged)",
        ),
    ),
    "filter_rules": (
        lambda m: catalogues.filter_rules(_configs(m))[0],
        sql(
            "select v.id as vendor_id, r.axis, r.entry from vendors v join r on r.k = v.id % 8",
            "r(k, axis, entry) as (values (0, 'product_types', 'lps'), (0, 'product_types', 'sps'), (0, 'product_types', ''), (0, 'no_tags', 'frag pack'), (1, 'tags', 'coral'), (1, 'no_title_starts', 'RARE morph'), (1, 'auction_tags', 'auction3'), (2, 'no_sku_ends', '-x'), (2, 'no_titles', ' corall 37 '), (2, 'no_title_parts', 'frag'))",
        ),
    ),
    "filter_errors": (
        lambda m: catalogues.filter_rules(_configs(m))[1],
        sql(
            "select v.id as vendor_id, r.axis, r.entry, r.problem from vendors v join r on r.k = v.id % 8",
            """r(k, axis, entry, problem) as (values (3, 'no_tags', '"frag"', 'not a list'), (3, 'colour', '["red"]', 'no such axis'), (3, 'tags', '', 'matches nothing or everything'), (3, 'tags', ' coral', 'matches nothing or everything'), (3, 'product_types', ' ', 'matches nothing or everything'), (3, 'product_types', '5', 'not a text'), (3, 'product_types', 'null', 'not a text'), (3, 'product_types', '{"a":1}', 'not a text'),
              (4, null, null, 'not a mapping of axes'), (5, null, null, 'not a mapping of axes'), (6, 'no_tags', ' - ', 'matches nothing or everything'), (6, 'no_titles', '  ', 'matches nothing or everything'))""",
        ),
    ),
    "ruled_products": (lambda m: catalogues.keep_reasons(_vendor_products(m), catalogues.filter_rules(_configs(m))[0]).select("id", "why"), sql(RULED)),
    "filter_drift": (
        lambda m: health.filter_drift(m.listings, _live(m, 7)),
        sql(f"select vendor_id, why, count(*) as n, round(count(*) / sum(count(*)) over (partition by vendor_id), 6) as share from (select l.vendor_id, case when l.id % 9 = 4 then 'not-in-catalogue' else coalesce(r.why, 'kept') end as why from listings l join ruled r on r.id = l.id) group by 1, 2", f"ruled as ({RULED})"),
    ),
    "version_drift": (
        lambda m: health.version_drift(_live(m, 7), _live(m, 2), m.listings),
        sql("select l.vendor_id, coalesce(r.why, 'kept') as old, case when not in_stock then 'unavailable' else coalesce(case when l.vendor_id % 8 < 2 then r.why end, 'kept') end as new, count(*) as n from listings l join ruled r on r.id = l.id where l.id % 9 <> 4 and coalesce(r.why, 'kept') <> case when not in_stock then 'unavailable' else coalesce(case when l.vendor_id % 8 < 2 then r.why end, 'kept') end group by 1, 2, 3", f"ruled as ({RULED})"),
    ),
    "card_prices": (
        lambda m: catalogues.card_prices(catalogues.parse_cards(_priced_cards(m))).select("vendor_sku", "current_price", "compare_at_price"),
        sql("select id::varchar as vendor_sku, case when id % 5 > 0 then current_price::double end as current_price, case when id % 5 > 0 and id % 3 > 0 and current_price * 100 > current_price then (current_price * 100)::double end as compare_at_price from listings"),
    ),
    "guide_headings": (
        lambda m: market.guides_of(_guide_files(m)).withColumn("body", F.length("body")),
        sql("select 'guide-' || id as slug, case when id % 4 = 1 then 'CARE' else 'GUIDE' end as kind, case when id % 4 in (0, 3) then 'guide-' || id else canonical_name || ': basics' end as title, case when id % 4 = 3 then '' else '2024-01-' || lpad((id % 28 + 1)::varchar, 2, '0') end as updated, case when id % 4 = 2 then 'About it' end as description, len(canonical_name) + 5 as body from named_corals where id % 6 <> 5"),
    ),
    "signup_links": (
        lambda m: m.star("customer").select("c_custkey", text.signup_links(F.when(F.col("c_custkey") % 7 != 0, F.concat("c_name", F.lit(" é+/=~&"), "c_custkey")), "https://shop.example/").alias("l")).select("c_custkey", "l.*"),
        "select c_custkey, 'https://shop.example/confirm?t=' || t as confirm, 'https://shop.example/unsubscribe?t=' || t as unsubscribe from (select c_custkey, url_encode(case when c_custkey % 7 <> 0 then c_name || ' é+/=~&' || c_custkey end) as t from customer)",
    ),
    "crawled_paths": (lambda m: catalogues.crawl(_grid_pages(m)), sql("select * from crawled", *PAGES_SQL)),
    "crawl_verdicts": (
        lambda m: catalogues.schema_change(catalogues.crawl(_grid_pages(m))),
        sql("select vendor_id, paths, pages, n, silent, case when coalesce(b, false) then 'block' when coalesce(f, false) then 'fetch' when gone or n = 0 or silent >= greatest(3, floor(paths * 0.3)) then 'html_schema_change' when silent > 0 then 'partial' else 'ok' end as verdict from (select vendor_id, count(*) as paths, sum(pages)::bigint as pages, sum(n)::bigint as n, count(*) filter (where n = 0 and not marked_empty) as silent, bool_or(error = 'block') as b, bool_or(\"end\" = 'failed') as f, bool_or(missing) as gone from crawled group by 1)", *PAGES_SQL),
    ),
    "page_sentinels": (
        lambda m: m.listings.select("id", catalogues.schema_sentinel(F.when(F.col("id") % 4 > 0, F.concat(F.lit('{"products": [{"b": 1, "a": {"z": 2}'), F.when(F.col("id") % 4 == 1, ', "c": null').otherwise(""), F.lit('}, {"d": 4}]}'))).otherwise('{"products": []}')).alias("sentinel")),
        sql("select id, case id % 4 when 0 then null when 1 then sha256('a,b,c') else sha256('a,b') end as sentinel from listings"),
    ),
    "digest_blocks": (
        lambda m: market.digest_blocks(_leads(m, 144), NOW, SITE, 3, BUDGET, "0123456789"),
        sql("select place, display_name, n, collapsed, case when collapsed then c else w end as block from judged", *leads(144), *DIGEST),
    ),
    "digest_text": (
        lambda m: market.digest_text(market.digest_blocks(_leads(m, 144), NOW, SITE, 3, BUDGET, "0123456789"), BUDGET, "0123456789"),
        sql(f"select case when len(t) > {BUDGET} then t[1:{BUDGET - 1}] || '…' else t end as text from (select '0123456789' || string_agg(case when collapsed then c else w end, chr(10) || chr(10) order by place) as t from judged)", *leads(144), *DIGEST),
    ),
    "price_axes": (
        lambda m: chart.price_axis(_points(m), ["named_coral_id"]).select("named_coral_id", F.round("y_min", 6).alias("y_min"), F.round("y_max", 6).alias("y_max"), F.array_join(F.transform("ticks", lambda t: F.format_string("%.2f", t)), " ").alias("ticks")),
        sql(
            """select named_coral_id, round(y_min, 6) as y_min, round(y_max, 6) as y_max, (select string_agg(printf('%.2f', first + i * step), ' ' order by i) from range(100) r(i) where first + i * step <= y_max + 1e-9) as ticks from (select *, ceil(y_min / step) * step as first from (
              select *, case when share < 1.5 then 1.0 when share < 3 then 2.0 when share < 7 then 5.0 else 10.0 end * power as step from (select *, (y_max - y_min) / 4 / power as share from (select *, pow(10.0::double, floor(log10((y_max - y_min) / 4))) as power from axes))))""",
            *states("named_coral_id is not null", None), *AXIS,
        ),
    ),
    "time_axes": (
        lambda m: chart.time_axis(_points(m), ["named_coral_id"], F.lit(NOW)).select("named_coral_id", "t0", "t1", F.array_join("labels", " ").alias("labels")),
        sql(
            f"select named_coral_id, t0, {T} as t1, (select string_agg(upper(strftime(t0 + to_microseconds((i * epoch_us({T}) - i * epoch_us(t0)) // (n - 1)), '%b %-d')), ' ' order by i) from range(7) r(i) where i < n) as labels from (select *, case when {T} - t0 <= interval '14' day then 4 when {T} - t0 <= interval '45' day then 5 else 7 end as n from (select named_coral_id, case when min(day)::timestamp >= {T} then {T} - interval '1' day else min(day)::timestamp end as t0 from states where s.in_stock and s.price > 0 group by 1))",
            *states("named_coral_id is not null", None),
        ),
    ),
    "end_labels": (
        lambda m: chart.end_labels(_ends(m), ["named_coral_id"]),
        "with recursive " + sql("select named_coral_id, label, y, round(placed, 2) as placed from up", *states("named_coral_id is not null", None), *AXIS, *ENDS).removeprefix("with "),
    ),
    "label_widths": (
        lambda m: chart.view_width(m.listings.where("named_coral_id is not null").select("named_coral_id", F.col("raw_title").alias("label"), (F.col("id") % 700).alias("x")), ["named_coral_id"]),
        sql("select named_coral_id, round(greatest(760.0, max(id % 700 + len(raw_title) * 6.3 + 6)))::bigint as width from listings where named_coral_id is not null group by 1"),
    ),
}


def _ready(m: Model) -> DataFrame:
    """The ids of a repair, at vendors whose latest run succeeded: elsewhere the gate would stop it."""
    good = m.scraper_runs.groupBy("vendor_id").agg(F.max_by("status", F.struct("started_at", "id")).alias("status")).where("status = 'success'")
    return m.listings.where("in_stock and raw_title like 'Rare%'").join(good, "vendor_id", "left_semi").select("vendor_id", "id")


QUERIES = {name: (lambda spark, folder, make=make: plain(make(Model(spark, folder)))) for name, (make, _) in _Q.items()}
ORACLE_SQL = {name: text for name, (_, text) in _Q.items()}
