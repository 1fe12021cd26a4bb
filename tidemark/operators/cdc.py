"""Catalogue diffs: what a scrape changed, the new snapshot and the rows it adds to the log. Snapshot in, snapshot out; nothing is updated in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import at, hours_before

#: The flip cap: the larger of a floor and a share of the stock; the share of the median that a whole scrape has; scrapes that must agree.
CAP_FLOOR, CAP_SHARE, WHOLE_SHARE, AGREEING = 50, 0.25, 0.8, 3
ERROR_CHARS = 1000


def decision(known: Column, was_price: Column, now_price: Column, was_stock: Column, now_stock: Column) -> Column:
    """new, price_changed (which wins over a change of stock), restocked, oos or unchanged; a missing price differs from any other."""
    return (
        F.when(~F.coalesce(known, F.lit(False)), "new")
        .when(~was_price.eqNullSafe(now_price), "price_changed")
        .when(~was_stock & now_stock, "restocked")
        .when(was_stock & ~now_stock, "oos")
        .otherwise("unchanged")
    )


def classify(scraped: DataFrame, current: DataFrame) -> DataFrame:
    """(product_url, decision, was_price, now_price, was_stock, now_stock) for every scraped item(product_url, current_price, in_stock)."""
    old = current.select("product_url", F.col("current_price").alias("was_price"), F.col("in_stock").alias("was_stock"), F.lit(True).alias("_known"))
    rows = scraped.select("product_url", F.col("current_price").alias("now_price"), F.col("in_stock").alias("now_stock")).join(old, "product_url", "left")
    return rows.withColumn("decision", decision(*map(F.col, ("_known", "was_price", "now_price", "was_stock", "now_stock")))).drop("_known")


def cohort_gone(current: DataFrame, scraped: DataFrame, filtered: DataFrame) -> DataFrame:
    """(product_url, last_price): in stock, absent from the scrape and not filtered by the parser, so out of stock now; the last price stays."""
    rows = current.where("in_stock").join(scraped.select("product_url"), "product_url", "left_anti").join(filtered.select("product_url"), "product_url", "left_anti")
    return rows.select("product_url", F.col("current_price").alias("last_price"))


def counters(decisions: DataFrame) -> DataFrame:
    """One row: how many of each decision."""
    kinds = ("new", "price_changed", "restocked", "oos", "unchanged")
    return decisions.agg(F.count("*").alias("seen"), *[F.count(F.when(F.col("decision") == k, 1)).alias(k) for k in kinds])


def markdown_started(was: Column, value: Column, started: Column, now: str) -> Column:
    """When a markdown episode began: now if a compare-at price appears, never if it goes, else as before."""
    return F.when(value.isNull(), F.lit(None)).when(was.isNull(), at(now)).otherwise(started)


def apply_scrape(current: DataFrame, decisions: DataFrame, gone: DataFrame, now: str) -> DataFrame:
    """The snapshot afterwards, with all columns of `current`: product_url, current_price, in_stock, first_seen_at, last_seen_at and what more it has, null for new items.

    first_seen_at never changes; cohort flips leave last_seen_at.
    """
    seen = decisions.select("product_url", "now_price", "now_stock", F.lit(True).alias("_seen"))
    flipped = gone.select("product_url", F.lit(True).alias("_gone"))
    rows = current.join(seen, "product_url", "full").join(flipped, "product_url", "left")
    changed = {
        "current_price": F.when(F.col("_seen"), F.col("now_price")).otherwise(F.col("current_price")),
        "in_stock": F.when(F.col("_seen"), F.col("now_stock")).when(F.col("_gone"), False).otherwise(F.col("in_stock")),
        "first_seen_at": F.coalesce("first_seen_at", at(now)),
        "last_seen_at": F.when(F.col("_seen"), at(now)).otherwise(F.col("last_seen_at")),
    }
    return rows.select(*[changed.get(c, F.col(c)).alias(c) for c in current.columns])


def log_rows(decisions: DataFrame, gone: DataFrame, now: str) -> DataFrame:
    """(product_url, price, in_stock, observed_at): what the log gains. Unchanged items add nothing."""
    changed = decisions.where("decision <> 'unchanged'").select("product_url", F.col("now_price").alias("price"), F.col("now_stock").alias("in_stock"))
    flips = gone.select("product_url", F.col("last_price").alias("price"), F.lit(False).alias("in_stock"))
    return changed.unionByName(flips).withColumn("observed_at", at(now))


def mirror_queue(decisions: DataFrame, current: DataFrame) -> DataFrame:
    """(product_url): new items, and known ones without a picture."""
    bare = current.where("image_url is null").select("product_url")
    return decisions.where("decision = 'new'").select("product_url").unionByName(decisions.join(bare, "product_url", "left_semi").where("decision <> 'new'").select("product_url"))


def flip_gate(previous: DataFrame, gone: DataFrame, floor: int = CAP_FLOOR, share: float = CAP_SHARE) -> DataFrame:
    """(vendor_id, in_stock, flips, cap, over): whether a vendor's flips are more than its cap; both tables have vendor_id."""
    stock = previous.where("in_stock").groupBy("vendor_id").agg(F.count("*").alias("in_stock"))
    flips = gone.groupBy("vendor_id").agg(F.count("*").alias("flips"))
    rows = stock.join(flips, "vendor_id", "left").withColumn("flips", F.coalesce("flips", F.lit(0)))
    rows = rows.withColumn("cap", F.greatest(F.lit(floor), F.floor(F.col("in_stock") * share)))
    return rows.withColumn("over", F.col("flips") > F.col("cap"))


def accept_over_cap(gate: DataFrame, hashes: DataFrame, agreeing: int = AGREEING) -> DataFrame:
    """The gate of one run for each vendor with `converged`, whether flips over the cap are taken all the same, and `cohort_safe`, whether flips are taken at all.

    gate(vendor_id, over, absent_hash, canary, matcher_errors, partial, incomplete, seen, median_seen); hashes(vendor_id, started_at, id, absent_hash) are of
    the runs before. Converged are flips of which the cap is the only thing against, of a run that has seen WHOLE_SHARE of the median, if the `agreeing` - 1 runs
    before left the same set absent.
    """
    w = Window.partitionBy("vendor_id").orderBy(F.col("started_at").desc(), F.col("id").desc())
    last = hashes.withColumn("_n", F.row_number().over(w)).where(F.col("_n") < agreeing)
    before = last.groupBy("vendor_id").agg(F.count("absent_hash").alias("_c"), F.min("absent_hash").alias("_low"), F.max("absent_hash").alias("_high"))
    sound = ~F.col("canary") & (F.col("matcher_errors") == 0) & ~F.col("partial") & ~F.col("incomplete")
    whole = F.coalesce((F.col("median_seen") > 0) & (F.col("seen") >= WHOLE_SHARE * F.col("median_seen")), F.lit(False))
    same = F.lit(True) if agreeing < 2 else F.coalesce((F.col("_c") == agreeing - 1) & (F.col("_low") == F.col("_high")) & (F.col("absent_hash") == F.col("_low")), F.lit(False))
    out = gate.join(before, "vendor_id", "left").withColumn("converged", F.col("over") & sound & whole & F.col("absent_hash").isNotNull() & same)
    return out.withColumn("cohort_safe", sound & (~F.col("over") | F.col("converged"))).drop("_c", "_low", "_high")


def cohort_decisions(items: DataFrame, cohort: DataFrame, gate: DataFrame) -> DataFrame:
    """A run's decisions: those on scraped items(vendor_id, product_url, decision), and those on absent ones of cohort(vendor_id, product_url) of vendors whose gate is safe."""
    taken = cohort.join(gate.where("cohort_safe").select("vendor_id"), "vendor_id", "left_semi").select("vendor_id", "product_url", F.lit("oos").alias("decision"))
    return items.select("vendor_id", "product_url", "decision").unionByName(taken)


def finish_runs(runs: DataFrame, now: str, hours: int = 6) -> DataFrame:
    """(id, status, error_message): runs that are still running after `hours` become failed by timeout; error texts are cut to ERROR_CHARS."""
    late = (F.col("status") == "running") & (F.col("started_at") < hours_before(now, hours))
    return runs.select("id", F.when(late, "failed").otherwise(F.col("status")).alias("status"), F.substring(F.when(late, "timeout").otherwise(F.col("error_message")), 1, ERROR_CHARS).alias("error_message"))
