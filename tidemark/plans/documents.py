"""The queries over vendor documents, displays of corals and request values. The documents are made of the listings, so that SQL can say what they must give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import posts, text
from ..functions.labels import BRANDED_NOTE, COMMON_TAGS, UNTAGGED_NOUNS
from ..operators import health, market, timeseries
from ..operators.common import plain
from ..sources import catalogues
from ..sources.adapters import NOW, Model
from .ingest import _drops
from .oracle import T, TITLE_SQL, drops, sql, states
from .posts import NOUNS, TOKENS, _in

PER_PAGE = 20


def _attribute(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f' {name}="'), value.cast("string"), F.lit('"')), F.lit(""))


def _pages(listings: DataFrame, card: Column, more: str = "") -> DataFrame:
    """(path, html): the cards of a vendor's listings, PER_PAGE to a page."""
    path = F.concat_ws("/", "vendor_id", F.floor(F.col("id") / PER_PAGE))
    rows = listings.select(path.alias("path"), "id", card.alias("card")).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("id", "card"))).alias("c"))
    return rows.select("path", F.concat(F.lit("<html><body><ul>"), F.array_join("c.card", ""), F.lit(f"</ul>{more}</body></html>")).alias("html"))


def _grid(m: Model) -> DataFrame:
    price = lambda kind, column: F.concat(F.lit(f'<span data-price-type="{kind}"'), _attribute("data-price-amount", F.col(column)), F.lit("></span>"))
    link = F.concat(F.lit('<a class="product-item-link"'), F.when(F.col("id") % 10 != 0, _attribute("href", F.col("product_url"))).otherwise(""), F.lit(">\n "), F.col("raw_title"), F.lit(" </a>"))
    picture = F.concat(F.lit('<img class="product-image-photo" src="/static/Loader.gif"'), _attribute("data-original", F.concat("image_url", F.lit("?w=9"))), F.lit("/>"))
    return _pages(m.listings, F.concat(F.lit('<li class="item product product-item">'), link, price("oldPrice", "compare_at_price"), price("finalPrice", "current_price"), picture, F.lit("</li>")))


def _toolbars(m: Model) -> DataFrame:
    to, total = F.col("id") % 7 * 20 + 20, F.col("id") % 5 * 30 + 10
    number = lambda n: F.concat(F.lit('<span class="toolbar-number">'), n.cast("string"), F.lit("</span>"))
    return m.listings.select(F.col("id").cast("string").alias("path"), F.concat(F.lit("<p>Items "), F.when(F.col("id") % 3 != 0, F.concat(number(F.lit(1)), F.lit("-"), number(to), F.lit(" of "))).otherwise(""), number(total), F.lit("</p>")).alias("html"))


def _articles(m: Model) -> DataFrame:
    head = F.concat(F.lit("<article"), _attribute("data-name", F.col("raw_title")), _attribute("data-product-price", F.concat(F.lit("$"), F.col("current_price").cast("string"))), _attribute("data-entity-id", F.col("id")), F.lit(">"))
    return _pages(m.listings, F.concat(F.lit('<li class="product">'), head, F.lit('<a class="card-figure__link"'), _attribute("href", F.col("product_url")), F.lit('></a><img class="card-image"'), _attribute("src", F.col("image_url")), F.lit("></article></li>")))


def _products(m: Model) -> DataFrame:
    """Products as a vendor's JSON has them, read back from it."""
    variant = lambda sku, available, price, compare: F.struct(sku.alias("sku"), available.alias("available"), price.alias("price"), compare.alias("compare_at_price"))
    none = F.lit(None).cast("string")
    product = F.struct(
        "id", F.col("raw_title").alias("title"), F.concat(F.lit("h"), "id").alias("handle"), F.col("category").alias("product_type"),
        F.array(F.when(F.col("id") % 8 == 0, "Auction12").when(F.col("id") % 8 == 1, "Frag-Pack").otherwise("coral")).alias("tags"),
        F.array(variant(F.lit(""), F.lit(False), F.lit("0.00"), none), variant(F.concat(F.lit("S-"), "id", F.when(F.col("id") % 5 == 0, "-x-1").otherwise("")), F.col("in_stock"), F.col("current_price").cast("string"), F.col("compare_at_price").cast("string"))).alias("variants"),
        F.array(F.struct(F.col("image_url").alias("src"))).alias("images"),
    )
    pages = m.listings.groupBy("vendor_id", F.floor(F.col("id") / PER_PAGE).alias("page")).agg(F.to_json(F.struct(F.collect_list(product).alias("products"))).alias("json"))
    return pages.select(F.explode(F.from_json("json", catalogues.PRODUCTS)["products"]).alias("p")).select("p.*")


KEEP = {"product_types": ["lps", "sps"], "no_tags": ["frag pack"], "no_title_starts": ["rare morph"], "no_sku_ends": ["-x"]}
ROUNDS = ("auction1",)
ENVELOPES = states("named_coral_id is not null", None)
SHOWN_STATES = "select * from states where s.in_stock and s.price > 0"


def _requests(m: Model) -> DataFrame:
    return m.listings.select("id", F.get(F.array(*map(F.lit, ("newest", "price-asc", "cheap", "week"))), (F.col("id") % 5).cast("int")).alias("v"))


def _fetches(m: Model) -> DataFrame:
    status = F.get(F.array(*map(F.lit, (200, 403, 429, 503, 404, 200))), (F.col("id") % 7).cast("int"))
    body = F.when(F.col("id") % 3 == 0, F.concat(F.repeat(F.lit("x"), (F.col("id") % 50 * 100).cast("int")), F.lit("<title>Access denied</title>"))).otherwise("<title>Shop</title>")
    return m.listings.select("id", status.alias("status"), body.alias("body"))


def _guides(m: Model) -> DataFrame:
    body = F.concat(F.lit('Words, a link to /x and <Entry kind="a" slug="'), "slug", F.lit("\" /> then <Reference slug='"), "slug", F.lit("'/> and <Entry slug='other-"), F.col("id") % 3, F.lit("'>"))
    return m.named_corals.select(F.concat(F.lit("guide-"), "id").alias("slug"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 20).cast("int")).alias("updated"), body.alias("body"))


def _kind() -> Column:
    return F.get(F.array(F.lit(""), F.lit("sps"), F.lit("ZOA"), F.lit("Acropora tenuis")), (F.col("id") % 4).cast("int"))


def _cheapest(name: str, test: str) -> tuple[str, ...]:
    """WITH entries: of each coral the lowest price that passes, the number of offers, its vendors (newest first, three named) and the newest listing's time."""
    return (
        f"{name}_offers as (select *, min(current_price) over (partition by named_coral_id) as low, count(*) over (partition by named_coral_id) as n from listings where in_stock and named_coral_id is not null and {test})",
        f"{name}_tied as (select named_coral_id, low, n, label, first_seen_at, o.id from {name}_offers o join shops on shops.id = o.vendor_id where current_price = low qualify row_number() over (partition by named_coral_id, label order by first_seen_at desc, o.id) = 1)",
        f"{name} as (select named_coral_id, low::double as low, n, array_to_string(list(label order by first_seen_at desc, id)[1:3], ', ') || case when count(*) > 3 then ' +' || (count(*) - 3) else '' end as v, max_by(first_seen_at, (first_seen_at, -id)) as listed_at from {name}_tied group by 1, 2, 3)",
    )


_SECONDS = f"greatest(0, epoch({T})::bigint - floor(epoch(p.listed_at))::bigint)"
_AGO = f"case when {_SECONDS} >= 604800 then strftime(p.listed_at, '%b %-d') when {_SECONDS} >= 86400 then {_SECONDS} // 86400 || ' day' || case when {_SECONDS} // 86400 = 1 then ' ago' else 's ago' end when {_SECONDS} >= 3600 then {_SECONDS} // 3600 || ' hour' || case when {_SECONDS} // 3600 = 1 then ' ago' else 's ago' end else greatest(1, {_SECONDS} // 60) || ' minute' || case when greatest(1, {_SECONDS} // 60) = 1 then ' ago' else 's ago' end end"


_Q = {
    "grid_cards": (
        lambda m: catalogues.parse_grid(_grid(m)).drop("place"),
        sql(f"select vendor_id || '/' || floor(id / {PER_PAGE})::bigint as path, product_url, raw_title, current_price::double as current_price, case when compare_at_price > current_price then compare_at_price::double end as compare_at_price, image_url from listings where id % 10 <> 0"),
    ),
    "grid_last_pages": (lambda m: catalogues.last_page(_toolbars(m)), sql("select id::varchar as path, id % 3 = 0 or id % 7 * 20 + 20 >= id % 5 * 30 + 10 as last from listings")),
    "article_cards": (
        lambda m: catalogues.first_wins(catalogues.parse_cards(_articles(m))).select("path", "product_url", "raw_title", "price_text", "vendor_sku", "image_url"),
        sql(f"select vendor_id || '/' || floor(id / {PER_PAGE})::bigint as path, product_url, raw_title, '$' || current_price as price_text, id::varchar as vendor_sku, image_url from listings"),
    ),
    "product_listings": (
        lambda m: catalogues.to_listings(_products(m), "https://shop.example/", ROUNDS).drop("category"),
        sql(f"select 'https://shop.example/products/h' || id as product_url, raw_title, {TITLE_SQL} as normalized_title, case when id % 8 <> 0 and current_price > 0 then current_price::double end as current_price, case when id % 8 <> 0 and compare_at_price > current_price and current_price > 0 then compare_at_price::double end as compare_at_price, in_stock, 'S-' || id || case when id % 5 = 0 then '-x-1' else '' end as vendor_sku, image_url, case when regexp_matches(raw_title, '^[A-Z]{{2,4}}\\s+[A-Z][a-z]+') then 'vendor-named' else 'unknown' end as lineage_flag, id % 8 = 0 as is_auction from listings"),
    ),
    "product_keep_reasons": (
        lambda m: _products(m).select("id", catalogues.keep_reason(KEEP, True, ROUNDS).alias("why")),
        sql("select id, case when not in_stock then 'unavailable' when id % 8 <> 0 and coalesce(category not in ('lps', 'sps'), true) then 'product-type' when id % 8 = 1 then 'tag-denied' when starts_with(lower(raw_title), 'rare morph') then 'no_title_starts' when id % 5 = 0 then 'sku-denied' end as why from listings"),
    ),
    "variant_prices": (
        lambda m: _products(m).select("id", text.coerce_variants(F.col("variants")).alias("v")).select("id", F.col("v.price").alias("price"), F.col("v.compare_at").alias("compare_at")),
        sql("select id, case when current_price > 0 then current_price::double end as price, case when current_price > 0 and compare_at_price > current_price then compare_at_price::double end as compare_at from listings"),
    ),
    "superlative_pcts": (
        lambda m: _drops(m).where("prior_price > 0").select("listing_id", text.superlative_pct(F.col("new_price"), F.col("prior_price")).alias("pct")),
        sql("select listing_id, round_even((prior_price::double - new_price::double) / prior_price::double * 100, 0)::bigint as pct from drops where prior_price > 0", *drops(7)),
    ),
    "digest_recipients": (
        lambda m: market.recipients(
            m.star("customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.lit(NOW).cast("timestamp_ntz")).alias("confirmed_at"), F.when(F.col("c_custkey") % 5 == 0, F.lit(NOW).cast("timestamp_ntz")).alias("unsubscribed_at")),
            m.star("nation").select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("n_nationkey")).alias("sent_date")), "2024-01-30",
        ).select("c_custkey"),
        "select c_custkey from customer where c_custkey % 3 <> 0 and c_custkey % 5 <> 0 and date '2024-01-30' not in (select date '2024-01-01' + n_nationkey from nation)",
    ),
    "fetch_classes": (
        lambda m: _fetches(m).select("id", catalogues.fetch_error(F.col("status"), F.col("body")).alias("error")),
        sql("select id, case when id % 7 = 6 then 'network' when id % 7 = 2 then 'http_429' when id % 7 = 3 then 'http_5xx' when id % 7 in (0, 1, 5) and away then 'block' when id % 7 in (1, 4) then 'other' end as error from (select id, id % 3 = 0 and id % 50 * 100 + 28 <= 4096 as away from listings)"),
    ),
    "offer_summaries": (
        lambda m: market.offer_summary(m.listings),
        sql("select named_coral_id, min(current_price)::double as low_price, max(current_price)::double as high_price, count(*) as offer_count from listings where in_stock and current_price > 0 and named_coral_id is not null group by 1"),
    ),
    "reference_fields": (
        lambda m: market.reference_fields(m.listings, m.vendors, m.named_corals.withColumn("coral_type", _kind()), NOW, m.vendors.where("id % 3 = 0").select("slug", F.concat(F.lit("V"), "id").alias("label"))),
        sql(
            f"""select f.named_coral_id, case when o.low is null then '' else case when o.n > 1 then 'Cheapest now. ' else 'Listed now. ' end || printf('$%.2f', o.low) || ' — Vendor. ' || o.v || ' — First seen. ' || strftime(f.first, '%b %Y') end as reference,
              coalesce(printf('Price. $%.2f', p.low) || ' — Vendor. ' || p.v || ' — ', '') || 'Lineage. ' || c.origin_vendor || coalesce(' — Listed. ' || {_AGO}, '') as summary,
              case c.id % 4 when 0 then '' when 1 then 'Type. SPS — ' when 2 then 'Type. Zoa — ' else 'Type. Acropora tenuis — ' end || 'Origin. ' || c.origin_vendor as lineage
            from (select named_coral_id, min(first_seen_at) as first from listings where named_coral_id is not null group by 1) f join named_corals c on c.id = f.named_coral_id left join own o on o.named_coral_id = f.named_coral_id left join page p on p.named_coral_id = f.named_coral_id""",
            "shops as (select id, case when id % 3 = 0 then 'V' || id else display_name end as label from vendors)", *_cheapest("own", "current_price > 0"), *_cheapest("page", "current_price is not null"),
        ),
    ),
    "featured_corals": (
        lambda m: market.featured_in(_guides(m), ("Entry", "Reference")),
        sql("select coral_slug, slug, updated from (select slug as coral_slug, 'guide-' || id as slug, (date '2024-01-01' + (id % 20)::int)::varchar as updated from named_corals union all select 'other-' || (id % 3), 'guide-' || id, (date '2024-01-01' + (id % 20)::int)::varchar from named_corals)"),
    ),
    "history_segments": (
        lambda m: timeseries.segments(timeseries.price_by_vendor(m.price_history, m.listings, m.vendors, NOW), ["named_coral_id", "vendor_id"]),
        sql("select named_coral_id, vendor_id, min(day)::varchar as first_day, max(day)::varchar as last_day, count(*) as days, count(*) >= 2 as drawn from (select *, day - row_number() over (partition by named_coral_id, vendor_id order by day)::int as g from (select distinct named_coral_id, vendor_id, day from shown)) group by named_coral_id, vendor_id, g", *ENVELOPES, f"shown as ({SHOWN_STATES})"),
    ),
    "thin_histories": (
        lambda m: timeseries.thin_history(*(f(m.price_history, m.listings, m.vendors, NOW) for f in (timeseries.price_envelope, timeseries.price_by_vendor))),
        sql(
            "select named_coral_id, thin, case when thin then day::varchar end as day, case when thin then price::double end as price from (select d.named_coral_id, d.n <= 1 and d.most < 2 as thin, l.day, l.price from (select named_coral_id, count(distinct day) as n, max(k) as most from (select named_coral_id, day, count(*) over (partition by named_coral_id, vendor_id) as k from points) group by 1) d join (select *, row_number() over (partition by named_coral_id order by day desc, price) as n from points) l on l.named_coral_id = d.named_coral_id and l.n = 1)",
            *ENVELOPES, f"shown as ({SHOWN_STATES})",
            "points as (select named_coral_id, vendor_id, day, min(s.price) as price from shown group by 1, 2, 3)",
        ),
    ),
    "category_preflight": (
        lambda m: health.preflight(m.listings.withColumn("is_auction", F.col("is_auction") | (F.col("vendor_id") % 4 == 3)), 10.0),
        sql("select *, case when gated = 0 then 'cannot-evaluate' when share > 10 then 'fail' else 'pass' end as verdict from (select *, case when gated > 0 then round(missing / gated * 100, 6) end as share from (select vendor_id, count(*) as total, count(*) filter (where a) as auctions, count(*) filter (where not a) as gated, count(*) filter (where not a and category is null) as missing from (select *, is_auction or vendor_id % 4 = 3 as a from listings) group by 1))"),
    ),
    "price_floor_cuts": (
        lambda m: health.floor_cuts(m.listings, (15, 25, 50)),
        sql("select floor::double as floor, count(*) filter (where current_price < floor) as cut, count(*) as n, round(count(*) filter (where current_price < floor) / count(*) * 100, 6) as share from (select current_price, unnest([15, 25, 50]) as floor from listings where in_stock and current_price is not null and auction_end_time is null and not is_auction) group by 1"),
    ),
    "category_changes": (
        lambda m: health.category_changes(m.listings, m.listings.where("id % 3 <> 0").select("product_url", F.when(F.col("id") % 2 == 0, F.col("category")).otherwise("lps").alias("category"))),
        sql("select id, category as old, case when id % 2 = 0 then category else 'lps' end as new from listings where id % 3 <> 0 and id % 2 = 1 and category is distinct from 'lps'"),
    ),
    "url_parts": (
        lambda m: m.listings.select("id", text.url_handle(F.concat("product_url", F.when(F.col("id") % 2 == 0, "/Ab c/?x=/y").otherwise("#f"))).alias("handle"), text.picture_ending(F.concat(F.coalesce("image_url", F.lit("i.JPEG")), F.lit("?v=a.png"))).alias("ending"), text.picture_type(text.picture_ending(F.coalesce("image_url", F.lit("i.bin")))).alias("type")),
        sql("select id, case when id % 2 = 0 then 'ab-c' else id::varchar end as handle, case when image_url is null then '.jpeg' else '.webp' end as ending, case when image_url is null then 'image/jpeg' else 'image/webp' end as type from listings"),
    ),
    "escaped_titles": (
        lambda m: m.listings.select("id", text.html_escape(F.concat(F.lit("<b a='1'>&"), "raw_title", F.lit('"'))).alias("escaped")),
        sql("select id, '&lt;b a=&#39;1&#39;&gt;&amp;' || raw_title || '&quot;' as escaped from listings"),
    ),
    "request_values": (
        lambda m: _requests(m).select("id", text.one_of(F.col("v"), market.SORTS, "newest").alias("sort"), text.one_of(F.col("v"), ("day", "week"), "day").alias("span")),
        sql("select id, case when id % 5 = 1 then 'price-asc' else 'newest' end as sort, case when id % 5 = 3 then 'week' else 'day' end as span from listings"),
    ),
    "publishable_formats": (
        lambda m: m.listings.select("id", F.coalesce(text.publishable(F.get(F.array(*map(F.lit, text.CONTENT_FORMATS)), (F.col("id") % 8).cast("int"))), F.lit(False)).alias("ok")),
        sql("select id, id % 8 < 4 as ok from listings"),
    ),
    "post_tags": (
        lambda m: m.listings.select("id", F.array_join(F.array_sort(posts.post_tags(posts.type_tags(F.col("raw_title")), F.lit(None).cast("string"), F.concat(F.lit("#v"), F.col("vendor_id")))), " ").alias("tags")),
        sql(
            f"select l.id, array_to_string(list_sort(list_distinct(list_concat(coalesce(n.tags, []), [{_in(COMMON_TAGS)}], ['#v' || l.vendor_id || '{BRANDED_NOTE}']))), ' ') as tags from listings l left join (select id, list('#' || noun) as tags from nouns where noun not in ({_in(UNTAGGED_NOUNS)}) group by id) n on n.id = l.id",
            TOKENS, NOUNS,
        ),
    ),
}

QUERIES = {name: (lambda spark, folder, make=make: plain(make(Model(spark, folder)))) for name, (make, _) in _Q.items()}
ORACLE_SQL = {name: query for name, (_, query) in _Q.items() if query}
