"""The model's tables over the generated star schema, as SELECT text that Spark and a second SQL engine both accept.

The star schema has no catalogue of listings, so each table is derived: `events` is the price and stock log, `supplier` the vendors, `part` the
named entities, `orders` (moved into the month of the events) the ingest runs. A listing is a user in one of four spans of eight days. Prices,
categories, entities and auction flags are missing for some rows, so that null-safe branches are reached. All tables are taken whole: three
users share an entity and two vendors have three users, which spreads listings over the vendors and entities of every scale factor.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

#: Every query takes the present as an argument; this is the registered queries' present, just after the last event.
NOW = "2024-01-31 00:00:00"
VENDOR = "cast(floor(user_id * 2 / 3) as bigint)"
ENTITY = "cast(floor(user_id / 3) * 37 as bigint)"
LISTING = "user_id * 4 + cast(floor((extract(day from ts) - 1) / 8) as bigint)"

#: table -> (the star-schema table it reads, SELECT text). {ntz} is the type of a timestamp without time zone.
TABLES: dict[str, tuple[str, str]] = {
    "price_history": (
        "events",
        f"select event_id as id, {LISTING} as listing_id, case when event_id % 97 = 0 then null else cast(value as decimal(10,2)) end as price, "
        "event_type <> 'error' as in_stock, ts as observed_at from {src}",
    ),
    "listings": (
        "events",
        f"""select cast(listing_id as bigint) as id, {VENDOR} as vendor_id,
  concat('https://shop-', cast({VENDOR} as varchar(9)), '.example/p/', cast(listing_id as varchar(19))) as product_url,
  case user_id % 6 when 0 then concat('Coral ', cast({ENTITY} as varchar(9)))
    when 1 then concat('CORAL ', cast({ENTITY} as varchar(9)), ' Frag WYSIWYG $25.00 in stock')
    when 2 then concat('Rare Morph ', cast({ENTITY} as varchar(9)), ' colony')
    when 3 then concat('Corall ', cast({ENTITY} as varchar(9)))
    when 4 then case when user_id % 4 = 0 then cast({ENTITY} as varchar(9)) else concat('Torch Frag ', cast(user_id as varchar(19))) end else 'Mystery Zoanthid Pack - sold out' end as raw_title,
  last_price as current_price, last_stock as in_stock,
  case when user_id % 9 = 0 then null else concat(case when user_id % 9 = 1 then 'https://cdn.example/' else 'https://img.example/' end, cast(listing_id as varchar(19)), '.webp') end as image_url,
  case user_id % 11 when 0 then null when 1 then 'equipment' when 2 then 'invert' when 3 then 'sps' when 4 then 'zoa' when 5 then 'mushroom' else 'lps' end as category,
  case when user_id % 5 = 4 then null else {ENTITY} end as named_coral_id,
  date_trunc('hour', first_ts) as first_seen_at, last_ts as last_seen_at,
  case when (user_id + listing_id) % 6 = 0 then cast(last_price * cast(1.05 as decimal(3,2)) as decimal(10,2)) when (user_id + listing_id) % 6 = 1 then cast(last_price * cast(1.30 as decimal(3,2)) as decimal(10,2))
    when (user_id + listing_id) % 6 = 2 then cast(last_price * cast(1.02 as decimal(3,2)) as decimal(10,2)) end as compare_at_price,
  case when (user_id + listing_id) % 6 <= 2 then date_trunc('hour', last_ts) - (user_id % 50) * interval '1' hour end as markdown_started_at,
  case when user_id % 29 = 3 then last_ts + interval '3' day end as auction_end_time, user_id % 31 = 5 as is_auction, user_id % 13 = 7 as bulk_cluster
from (select user_id, {LISTING} as listing_id, min(ts) as first_ts, max(ts) as last_ts, max_by(event_type, ts) <> 'error' as last_stock,
        cast(case when max_by(event_id, ts) % 97 = 0 then null else max_by(value, ts) end as decimal(10,2)) as last_price
      from {{src}} group by user_id, {LISTING}) s""",
    ),
    "vendors": (
        "supplier",
        "select s_suppkey as id, case when s_suppkey % 10 = 9 then concat('_test-', cast(s_suppkey as varchar(9))) else concat('vendor-', cast(s_suppkey as varchar(9))) end as slug, s_name as display_name, s_suppkey % 10 <> 8 as active, "
        "case when s_suppkey % 3 = 0 then cast('2024-01-20 00:00:00' as {ntz}) + (s_suppkey % 100) * interval '1' hour end as announced_email_at, "
        "case when s_suppkey % 4 = 1 then cast('2024-01-27 00:00:00' as {ntz}) - (s_suppkey % 10) * interval '1' day end as announced_discord_at, "
        "case when s_suppkey % 10 = 6 then cast('2024-01-22 00:00:00' as {ntz}) end as first_organic_drop_at, case when s_suppkey % 3 <> 1 then 'coral' end as originator_prefix from {src}",
    ),
    "named_corals": (
        "part",
        "select p_partkey as id, concat('Coral ', cast(p_partkey as varchar(9))) as canonical_name, concat('coral ', cast(p_partkey as varchar(9))) as normalized_name, concat('coral-', cast(p_partkey as varchar(9))) as slug, "
        "concat('Vendor ', cast(p_size % 10 as varchar(9))) as origin_vendor, p_type as coral_type, p_size % 5 = 0 as requires_vendor_prefix, p_partkey % 15 <> 14 as active from {src}",
    ),
    "aliases": (
        "part",
        "select p_partkey as id, concat('rare morph ', cast(p_partkey as varchar(9))) as alias_text, case when p_partkey % 4 <> 3 then p_partkey end as named_coral_id, "
        "case when p_partkey % 4 = 3 then concat('cluster-', cast(p_partkey as varchar(9))) end as cluster_label, case when p_partkey % 4 = 3 then 'flag-review' else 'auto-link' end as match_behavior from {src}",
    ),
    "scraper_runs": (
        "orders",
        "select o_orderkey as id, cast(floor(o_orderkey / 150) as bigint) as vendor_id, started_at, started_at + interval '10' minute as finished_at, "
        "case o_orderstatus when 'F' then 'success' when 'O' then 'failed' else 'partial' end as status, cast(floor(o_totalprice / 1000) as bigint) as listings_seen, cast(o_orderkey % 12 as bigint) as pages_fetched, "
        "cast(o_custkey % 40 as bigint) as listings_oos, case when o_orderstatus = 'O' then case when o_custkey % 3 = 0 then 'silent canary: too few rows' else 'timeout' end end as error_message "
        "from (select *, cast('2024-01-01 06:00:00' as {ntz}) + (o_orderkey % 30) * interval '1' day + (o_custkey % 17) * interval '1' hour as started_at from {src}) s",
    ),
}


@dataclass
class Model:
    """The model's tables of one folder."""

    spark: SparkSession
    folder: str

    def star(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def table(self, name: str) -> DataFrame:
        source, text = TABLES[name]
        return self.spark.sql(text.format(src="{src}", ntz="timestamp_ntz"), src=self.star(source))

    @cached_property
    def price_history(self) -> DataFrame:
        return self.table("price_history")

    @cached_property
    def listings(self) -> DataFrame:
        return self.table("listings")

    @cached_property
    def vendors(self) -> DataFrame:
        return self.table("vendors")

    @cached_property
    def named_corals(self) -> DataFrame:
        return self.table("named_corals")

    @cached_property
    def aliases(self) -> DataFrame:
        return self.table("aliases")

    @cached_property
    def scraper_runs(self) -> DataFrame:
        return self.table("scraper_runs")


def with_tables(body: str, *more: str) -> str:
    """SQL for the second engine: the tables that `body` and `more` (further WITH entries) name, then the body."""
    text = " ".join((*more, body))
    used = [f"{name} as ({sql.format(src=source, ntz='timestamp')})" for name, (source, sql) in TABLES.items() if name in text]
    return "with " + ",\n".join((*used, *more)) + "\n" + body
