"""What scrapes write: patches over the snapshot, the log, the life of runs, and the same kept up to date from streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import cdc, persist
from ..operators.common import plain
from ..sources.adapters import NOW, Model
from ..streaming import ingest
from .core import LEAD, LEAD_SQL
from .oracle import PREV, T, leads, sql

WEEK = 168
#: The snapshot's columns beyond the model's, for Spark and the second engine alike.
STORED = {
    "vendor_sku": "case when id % 4 <> 0 then concat('S-', cast(id as varchar(19))) end", "normalized_title": "lower(raw_title)", "currency": "'USD'", "lineage_flag": "'unknown'",
    "last_price_changed_at": "case when id % 3 = 0 then first_seen_at end", "match_confidence": "case when named_coral_id is not null then 'exact' end",
    "match_method": "case when named_coral_id is not null then 'canonical-exact' end", "matched_at": "case when named_coral_id is not null then first_seen_at end",
}
#: A scrape: a seventh of the listings is absent, prices, stock, titles and markdowns of others have changed, some are new (each under an url of its own).
SCRAPED = {
    "raw_title": "case when id % 8 = 0 then concat(raw_title, ' v2') else raw_title end", "normalized_title": "lower(case when id % 8 = 0 then concat(raw_title, ' v2') else raw_title end)",
    "current_price": "case when id % 5 = 0 then cast(current_price * cast(0.9 as decimal(2,1)) as decimal(10,2)) else current_price end",
    "compare_at_price": "case when id % 9 = 0 then null when id % 9 = 1 then coalesce(compare_at_price, cast(99 as decimal(10,2))) else compare_at_price end",
    "in_stock": "case when id % 4 = 0 then not in_stock else in_stock end", "vendor_sku": "concat('T-', cast(id as varchar(19)))", "is_auction": "is_auction or id % 20 = 0",
    "category": "case when id % 10 = 0 then 'sps' else category end", "lineage_flag": "'vendor-named'", "vendor_image_url": "case when id % 3 <> 0 then concat('https://shop.example/', cast(id as varchar(19))) end",
}
COLUMNS = ["vendor_id", "product_url", "vendor_sku", "raw_title", "normalized_title", "current_price", "compare_at_price", "markdown_started_at", "currency", "in_stock", "is_auction", "category", "lineage_flag", "first_seen_at", "last_seen_at", "image_url", "last_price_changed_at", "named_coral_id", "match_confidence", "match_method", "matched_at", "bulk_cluster"]
SHOWN_COLUMNS = ", ".join(f"{c}::double as {c}" if c.endswith("_price") else c for c in COLUMNS)
_scraped = ", ".join(f"{v} as {c}" for c, v in SCRAPED.items())
STORED_SQL = f"stored as (select {', '.join(c for c in COLUMNS if c not in STORED)}, id, {', '.join(f'{v} as {c}' for c, v in STORED.items())} from listings)"
ITEMS_SQL = f"items as (select vendor_id, product_url, {_scraped} from listings where id % 7 <> 0 union all select vendor_id, concat(product_url, '/new'), {_scraped} from listings where id % 6 = 0)"
MATCHED_SQL = "matched as (select vendor_id, concat(product_url, '/new') as product_url, named_coral_id, 'fuzzy' as match_confidence, 'fuzzy-0.80' as match_method, last_seen_at as matched_at from listings where id % 12 = 0)"
COHORT_SQL = "cohort as (select vendor_id, product_url from listings where id % 7 = 0 and id % 2 = 1 and in_stock)"


def _stored(m: Model) -> DataFrame:
    return m.listings.selectExpr(*[c for c in COLUMNS if c not in STORED], "id", *[f"{v} as {c}" for c, v in STORED.items()]).select(*COLUMNS)


def _items(m: Model) -> DataFrame:
    of = lambda url: ["vendor_id", f"{url} as product_url", *[f"{v} as {c}" for c, v in SCRAPED.items()]]
    return m.listings.where("id % 7 <> 0").selectExpr(*of("product_url")).unionByName(m.listings.where("id % 6 = 0").selectExpr(*of("concat(product_url, '/new')")))


def _patches(m: Model) -> DataFrame:
    matched = m.listings.where("id % 12 = 0").selectExpr("vendor_id", "concat(product_url, '/new') as product_url", "named_coral_id", "'fuzzy' as match_confidence", "'fuzzy-0.80' as match_method", "last_seen_at as matched_at")
    cohort = m.listings.where("id % 7 = 0 and id % 2 = 1 and in_stock").select("vendor_id", "product_url")
    return persist.patches(_items(m), _stored(m), NOW, matched, F.col("vendor_id") % 2 == 0, cohort)


def snapshot_sql(before: str, items: str, after: str, now: str, matched: str = "", cohort: str = "", hotlinked: str = "false") -> str:
    """A WITH entry: the snapshot `after` the items, column by column. n: the row is new, s: all of it is written, m: what happens to its markdown."""
    match = lambda c: f"case when n and q.product_url is not null then q.{c} else b.{c} end as {c}" if matched else f"b.{c} as {c}"
    whole = lambda c, v=None: f"case when s then {v or 'i.' + c} else b.{c} end as {c}"
    return f"""{after} as (select vendor_id, product_url, {', '.join(whole(c) for c in ('vendor_sku', 'raw_title', 'normalized_title', 'current_price'))},
      case when seen then i.compare_at_price else b.compare_at_price end as compare_at_price, case m when 'set' then {now} when 'clear' then null else b.markdown_started_at end as markdown_started_at,
      {whole('currency', "'USD'")}, case when s then i.in_stock {"when g.product_url is not null then false" if cohort else ""} else b.in_stock end as in_stock, {', '.join(whole(c) for c in ('is_auction', 'category', 'lineage_flag'))},
      case when n then {now} else b.first_seen_at end as first_seen_at, case when seen then {now} else b.last_seen_at end as last_seen_at, case when n and hot and i.vendor_image_url <> '' then i.vendor_image_url else b.image_url end as image_url,
      case when d = 'price_changed' then {now} else b.last_price_changed_at end as last_price_changed_at, {', '.join(map(match, persist.MATCH))}, case when n then false else b.bulk_cluster end as bulk_cluster
      from (select *, d = 'new' as n, seen and d <> 'unchanged' as s, case when not seen then 'keep' when i.compare_at_price is not null and b.compare_at_price is null then 'set' when i.compare_at_price is null and b.compare_at_price is not null then 'clear' else 'keep' end as m
        from (select vendor_id, product_url, b, i, i.product_url is not null as seen, {hotlinked} as hot, case when i.product_url is null then 'absent' when b.product_url is null then 'new' when i.current_price is distinct from b.current_price then 'price_changed' when i.in_stock <> b.in_stock then 'stock' else 'unchanged' end as d
          from {before} b full join {items} i using (vendor_id, product_url))) x
      {f"left join {matched} q using (vendor_id, product_url)" if matched else ""} {f"left join {cohort} g using (vendor_id, product_url)" if cohort else ""})"""


def _runs(m: Model) -> DataFrame:
    more = {"git_sha": "concat('rev-', cast(id % 3 as varchar(9)))", "error_class": "case when status = 'failed' then 'http_5xx' end", "phase_b_finished_at": "case when id % 2 = 0 then finished_at end"}
    rows = m.scraper_runs.withColumn("per_category_counts", F.create_map(F.lit("a"), (F.col("id") % 4).cast("int")))
    return rows.selectExpr("* except (status)", "case when status = 'partial' then 'running' else status end as status", *[f"{v} as {c}" for c, v in more.items()])


RUNS_SQL = "runs as (select * exclude (status), case when status = 'partial' then 'running' else status end as status, 'rev-' || id % 3 as git_sha, case when status = 'failed' then 'http_5xx' end as error_class, case when id % 2 = 0 then finished_at end as phase_b_finished_at from scraper_runs)"


def _finished(m: Model) -> DataFrame:
    runs = _runs(m)
    outcomes = runs.where("status = 'running'").selectExpr("id", "case when id % 5 = 0 then 'failed' else 'success' end as status", "case when id % 5 = 0 then 'block' end as error_class", "case when id % 5 = 0 then repeat('x', cast(id % 3 * 900 as int)) end as error_message", "listings_seen + 1 as listings_seen", "case when id % 2 = 0 then map('b', 1) end as per_category_counts")
    return persist.finish_runs(runs, outcomes, NOW).select("id", "status", "finished_at", "error_class", F.length("error_message").alias("chars"), "listings_seen", F.array_join(F.map_keys("per_category_counts"), ",").alias("paths"))


def _weeks(column: str) -> list[Column]:
    return [F.expr(f"extract(day from {column}) between {a} and {a + 6}") for a in (1, 8, 15, 22, 29)]


def _changes(m: Model) -> DataFrame:
    """The whole log as a stream to which the weeks are added; it stops and goes on after each."""
    folder = ingest.shared_folder(m.spark, "log")
    for week in _weeks("observed_at"):
        m.price_history.where(week).write.mode("append").parquet(f"{folder}/in")
        ingest.run_available(ingest.log_changes(ingest.arriving(m.spark, m.price_history.schema, f"{folder}/in")), f"{folder}/out", f"{folder}/checkpoint")
    return ingest.changes_at(m.spark, f"{folder}/out")


SCRAPES = 3


def _scrape(k: int) -> dict[str, str]:
    return SCRAPED | {"current_price": f"case when (id + {k}) % 5 = 0 then cast(current_price * cast(0.{9 - k} as decimal(2,1)) as decimal(10,2)) else current_price end", "compare_at_price": f"case when (id + {k}) % 3 = 0 then null else cast({100 + k} as decimal(10,2)) end"}


def _streamed_snapshot(m: Model) -> DataFrame:
    """Scrapes as a stream to which one is added after the other."""
    folder, of = ingest.shared_folder(m.spark, "scrapes"), lambda k, url: ["vendor_id", f"{url} as product_url", *[f"{v} as {c}" for c, v in _scrape(k).items()]]

    def step(before: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
        patched = persist.patches(items, before, NOW)
        return persist.apply_patches(before, patched, NOW), persist.log_of(patched, before, F.lit(None).cast("long"), NOW)

    for k in range(SCRAPES):
        items = m.listings.where(f"(id + {k}) % 7 <> 0").selectExpr(*of(k, "product_url")).unionByName(m.listings.where(f"(id + {k}) % 6 = 0").selectExpr(*of(k, f"concat(product_url, '/{k % 2}')")))
        items.write.mode("append").parquet(f"{folder}/in")
        out = ingest.snapshot_after(ingest.arriving(m.spark, items.schema, f"{folder}/in"), _stored(m), folder, step)
    return out


_scrape_columns = lambda k: ", ".join(f"{v} as {c}" for c, v in _scrape(k).items())
STREAM_SQL = [
    f"items{k} as (select vendor_id, product_url, {_scrape_columns(k)} from listings where (id + {k}) % 7 <> 0 union all select vendor_id, concat(product_url, '/{k % 2}'), {_scrape_columns(k)} from listings where (id + {k}) % 6 = 0)"
    for k in range(SCRAPES)
]

_Q = {
    "persisted_snapshot": (
        lambda m: persist.apply_patches(_stored(m), _patches(m), NOW).select(*COLUMNS),
        sql(f"select {SHOWN_COLUMNS} from after", STORED_SQL, ITEMS_SQL, MATCHED_SQL, COHORT_SQL, snapshot_sql("stored", "items", "after", T, "matched", "cohort", "vendor_id % 2 = 0")),
    ),
    "persisted_log_rows": (
        lambda m: persist.log_of(_patches(m), _stored(m), F.lit(7), NOW),
        sql(
            f"select vendor_id, product_url, i.current_price::double as price, i.in_stock, {T} as observed_at, 7::bigint as scraper_run_id from items i left join stored b using (vendor_id, product_url) where b.id is null or i.current_price is distinct from b.current_price or i.in_stock <> b.in_stock "
            f"union all select vendor_id, product_url, b.current_price::double, false, {T}, 7 from cohort join stored b using (vendor_id, product_url)",
            STORED_SQL, ITEMS_SQL, COHORT_SQL,
        ),
    ),
    "persist_flips_after_new_rows": (
        lambda m: persist.bulk_flips(persist.apply_patches(_stored(m), _patches(m), NOW), _patches(m), 3).select("product_url", "bulk_cluster"),
        sql("select product_url, bulk_cluster or (bool_or(fresh) over (partition by vendor_id) and count(*) over (partition by vendor_id, first_seen_at) >= 3) as bulk_cluster from (select a.*, a.product_url like '%/new' as fresh from after a)", STORED_SQL, ITEMS_SQL, MATCHED_SQL, COHORT_SQL, snapshot_sql("stored", "items", "after", T, "matched", "cohort", "vendor_id % 2 = 0")),
    ),
    "runs_started": (
        lambda m: persist.start_runs(_runs(m), m.vendors.selectExpr("1000000000 + id as id", "id as vendor_id", "'rev-9' as git_sha"), NOW).select("id", "vendor_id", "status", "git_sha", "started_at", "finished_at"),
        sql(f"select id, vendor_id, status, git_sha, started_at, finished_at from runs union all select 1000000000 + id, id, 'running', 'rev-9', {T}, null from vendors", RUNS_SQL),
    ),
    "runs_finished": (
        lambda m: _finished(m),
        sql(f"select id, case when status <> 'running' then status when id % 5 = 0 then 'failed' else 'success' end as status, case when status = 'running' then {T} else finished_at end as finished_at, case when status <> 'running' then error_class when id % 5 = 0 then 'block' end as error_class, case when status <> 'running' then len(error_message) when id % 5 = 0 and id % 3 > 0 then least(1000, id % 3 * 900) end as chars, listings_seen + (status = 'running')::int as listings_seen, case when status <> 'running' then 'a' when id % 2 = 0 then 'b' else '' end as paths from runs", RUNS_SQL),
    ),
    "runs_with_pictures": (
        lambda m: persist.finish_pictures(_runs(m), _runs(m).where("id % 3 = 0").select("id"), NOW).select("id", "phase_b_finished_at"),
        sql(f"select id, case when id % 3 = 0 then {T} else phase_b_finished_at end as phase_b_finished_at from runs", RUNS_SQL),
    ),
    "stale_runs_failed": (
        lambda m: persist.fail_stale_runs(_runs(m), m.vendors.selectExpr("id as vendor_id", "'rev-1' as git_sha"), NOW)[0].select("id", "status", "error_class", "error_message", "finished_at"),
        sql(f"select id, case when h then 'failed' else status end as status, case when h then 'timeout' else error_class end as error_class, case when h then 'stopped from outside' else error_message end as error_message, case when h then {T} else finished_at end as finished_at from (select *, status = 'running' and git_sha = 'rev-1' and vendor_id in (select id from vendors) as h from runs)", RUNS_SQL),
    ),
    "stale_runs_counted": (
        lambda m: persist.fail_stale_runs(_runs(m), m.vendors.selectExpr("id as vendor_id", "'rev-1' as git_sha"), NOW)[1],
        sql("select vendor_id, git_sha, count(*) filter (where status = 'running') as failed from runs where git_sha = 'rev-1' and vendor_id in (select id from vendors) group by 1, 2", RUNS_SQL),
    ),
    "streamed_log_changes": (
        lambda m: _changes(m),
        sql("select id, listing_id, price::double as price, in_stock, observed_at, prior_price::double as prior_price, prior_stock, prior_at from prev", PREV),
    ),
    "streamed_lead_events": (
        lambda m: ingest.lead_events_of(_changes(m), m.listings, m.vendors, m.named_corals, NOW, WEEK).select(*LEAD),
        sql(f"select {LEAD_SQL} from leads", *leads(WEEK)),
    ),
    "streamed_snapshot": (
        lambda m: _streamed_snapshot(m).select(*COLUMNS),
        sql(f"select {SHOWN_COLUMNS} from after{SCRAPES - 1}", STORED_SQL, *[x for k in range(SCRAPES) for x in (STREAM_SQL[k], snapshot_sql("stored" if k == 0 else f"after{k - 1}", f"items{k}", f"after{k}", T))]),
    ),
}

QUERIES = {name: (lambda spark, folder, make=make: plain(make(Model(spark, folder)))) for name, (make, _) in _Q.items()}
ORACLE_SQL = {name: text for name, (_, text) in _Q.items()}
