"""What a scrape writes: patches that state which columns each row really gives, merged over the snapshot, and the life of the run that made them.

A column that a patch doesn't state keeps its value; one that it states as null is overwritten. Which columns are stated depends on the decision: unchanged rows only give
their time, compare-at price and the edges of a markdown episode; a coral's match is given by new rows alone; absent rows of a cohort give their stock and nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import cdc
from .common import at
from .guards import BULK_ROWS

KEY = ["vendor_id", "product_url"]
# The columns that a scrape may write, in the table's order.
WRITABLE = (
    "vendor_id", "vendor_sku", "product_url", "raw_title", "normalized_title", "current_price", "compare_at_price", "markdown_started_at", "currency", "in_stock",
    "is_auction", "category", "lineage_flag", "last_seen_at", "image_url", "last_price_changed_at", "named_coral_id", "match_confidence", "match_method", "matched_at",
)
# What an item has that doesn't say it, and what the table gives a new row that nobody wrote.
ITEM_DEFAULTS = {"currency": "USD", "is_auction": False, "lineage_flag": "unknown"}
ROW_DEFAULTS = {"currency": "USD", "is_auction": False, "lineage_flag": "unknown", "bulk_cluster": False}
REQUIRED = ("raw_title", "normalized_title", "in_stock")
MATCH = ("named_coral_id", "match_confidence", "match_method", "matched_at")
STATED = ("vendor_id", "product_url", "vendor_sku", "raw_title", "normalized_title", "current_price", "compare_at_price", "currency", "in_stock", "is_auction", "category", "lineage_flag", "last_seen_at")
ERROR_CHARS = 1000


def markdown_action(was: Column, value: Column) -> Column:
    """set where a compare-at price appears, clear where it goes, else keep."""
    return F.when(was.isNull() & value.isNotNull(), "set").when(was.isNotNull() & value.isNull(), "clear").otherwise("keep")


def patches(items: DataFrame, current: DataFrame, now: str, matched: DataFrame | None = None, hotlinked: Column | None = None, cohort: DataFrame | None = None) -> DataFrame:
    """(WRITABLE columns, decision, present): a row for each item, and each of the absent ones in cohort(vendor_id, product_url); `present` names the columns that it gives.

    items(vendor_id, product_url, ..., vendor_image_url), one for each key; columns that they lack have ITEM_DEFAULTS or null. matched(vendor_id, product_url, MATCH columns) are
    entity matches, taken for new rows only. `hotlinked` says of an item whether its vendor's pictures are linked: a new row then has its picture at once.
    """
    types = {f.name: f.dataType for f in current.schema.fields}
    given = lambda c: F.col(c) if c in items.columns else F.lit(ITEM_DEFAULTS.get(c))
    rows = items.select(*[given(c).cast(types[c]).alias(c) for c in STATED if c != "last_seen_at"], (F.col("vendor_image_url") if "vendor_image_url" in items.columns else F.lit(None).cast("string")).alias("_picture"), (F.lit(False) if hotlinked is None else hotlinked).alias("_hotlinked"))
    rows = rows.withColumn("currency", F.coalesce("currency", F.lit(ITEM_DEFAULTS["currency"])))
    # one meeting of items and snapshot gives the decision and the markdown's edges
    was = current.select(*KEY, F.lit(True).alias("_known"), F.col("current_price").alias("_price"), F.col("in_stock").alias("_stock"), F.col("compare_at_price").alias("_was"))
    rows = rows.join(was, KEY, "left").withColumn("decision", cdc.decision(*map(F.col, ("_known", "_price", "current_price", "_stock", "in_stock")))).withColumn("_markdown", markdown_action(F.col("_was"), F.col("compare_at_price")))
    if matched is None:
        rows = rows.withColumns({c: F.lit(None).cast(types[c]) for c in MATCH}).withColumn("_matched", F.lit(False))
    else:
        rows = rows.join(matched.select(*KEY, *MATCH, F.lit(True).alias("_matched")), KEY, "left")
    new, changed = F.col("decision") == "new", F.col("decision") == "price_changed"
    picture = new & F.col("_hotlinked") & (F.col("_picture") != "")
    markdown = F.when(F.col("_markdown") != "keep", F.array(F.lit("markdown_started_at"))).otherwise(F.array())
    some = lambda test, *names: F.when(F.coalesce(test, F.lit(False)), F.array(*map(F.lit, names))).otherwise(F.array())
    stated = F.concat(F.array(*map(F.lit, STATED)), markdown, some(picture, "image_url"), some(changed, "last_price_changed_at"), some(new & F.col("_matched"), *MATCH))
    touched = F.concat(F.array(*map(F.lit, [*KEY, "last_seen_at", "compare_at_price"])), markdown)
    values = {
        "last_seen_at": at(now), "markdown_started_at": F.when(F.col("_markdown") == "set", at(now)), "image_url": F.when(picture, F.col("_picture")),
        "last_price_changed_at": F.when(changed, at(now)),
    }
    present = F.when(F.col("decision") == "unchanged", touched).otherwise(stated).cast("array<string>")
    out = rows.select(*[values.get(c, F.col(c)).cast(types[c]).alias(c) for c in WRITABLE], "decision", present.alias("present"))
    if cohort is None:
        return out
    none = [F.lit(False).alias(c) if c == "in_stock" else F.lit(None).cast(types[c]).alias(c) for c in WRITABLE if c not in KEY]
    gone = cohort.select(*KEY, *none, F.lit("oos").alias("decision"), F.array(*map(F.lit, [*KEY, "in_stock"])).alias("present"))
    return out.unionByName(gone)


def apply_patches(current: DataFrame, patched: DataFrame, now: str) -> DataFrame:
    """The snapshot afterwards, with the columns of `current`: stated columns are overwritten, also by null, all others keep their values; unknown keys become rows.

    first_seen_at is nobody's to write: now for a new row, as before for all others. A column outside WRITABLE stops the job, as does a new row without a REQUIRED one.
    """
    stray = [c for c in patched.columns if c not in (*WRITABLE, "decision", "present")]
    if stray:
        raise ValueError(f"columns that a scrape may not write: {', '.join(sorted(stray))}")
    names = F.array(*map(F.lit, WRITABLE))
    unknown = F.array_except("present", names)
    checked = F.when(F.size(unknown) > 0, F.raise_error(F.concat(F.lit("columns that a scrape may not write: "), F.array_join(unknown, ", ")))).otherwise(F.col("present"))
    own = patched.select(*KEY, checked.alias("_present"), *[F.col(c).alias(f"_new_{c}") for c in WRITABLE if c not in KEY])
    rows = current.withColumn("_known", F.lit(True)).join(own, KEY, "full")
    is_new = F.col("_known").isNull()

    def merged(c: str) -> Column:
        if c in KEY:
            return F.col(c)
        if c == "first_seen_at":
            return F.when(is_new, at(now)).otherwise(F.col(c))
        old = F.when(is_new, F.lit(ROW_DEFAULTS[c])).otherwise(F.col(c)) if c in ROW_DEFAULTS else F.col(c)
        value = F.when(F.array_contains("_present", c), F.col(f"_new_{c}")).otherwise(old) if c in WRITABLE else old
        return F.when(is_new & value.isNull(), F.raise_error(F.concat(F.lit(f"a new row without {c}: "), F.col("product_url")))).otherwise(value) if c in REQUIRED else value

    return rows.select(*[merged(f.name).cast(f.dataType).alias(f.name) for f in current.schema.fields])


def log_of(patched: DataFrame, current: DataFrame, run_id: Column, now: str) -> DataFrame:
    """(vendor_id, product_url, price, in_stock, observed_at, scraper_run_id): what the log gains; unchanged rows add nothing, absent ones their last price."""
    last = current.select(*KEY, F.col("current_price").alias("_last"))
    rows = patched.where("decision <> 'unchanged'").join(last, KEY, "left")
    price = F.when(F.array_contains("present", "current_price"), F.col("current_price")).otherwise(F.col("_last"))
    return rows.select(*KEY, price.alias("price"), "in_stock", at(now).alias("observed_at"), run_id.alias("scraper_run_id"))


def bulk_flips(snapshot: DataFrame, patched: DataFrame, least: int = BULK_ROWS) -> DataFrame:
    """The snapshot with bulk_cluster set anew at vendors that have new rows: no other group can have grown."""
    grown = patched.where("decision = 'new'").select("vendor_id", F.lit(True).alias("_grown")).distinct()
    crossed = F.count("*").over(Window.partitionBy("vendor_id", "first_seen_at")) >= least
    rows = snapshot.join(grown, "vendor_id", "left").withColumn("_crossed", F.coalesce("_grown", F.lit(False)) & crossed)
    return rows.select(*[(F.col(c) | F.col("_crossed")).alias(c) if c == "bulk_cluster" else F.col(c) for c in snapshot.columns])


def start_runs(runs: DataFrame, begun: DataFrame, now: str) -> DataFrame:
    """The runs and those of begun(id, vendor_id, git_sha), which are running; what they don't have yet is null."""
    given = {"id": F.col("id"), "vendor_id": F.col("vendor_id"), "git_sha": F.col("git_sha"), "status": F.lit("running"), "started_at": at(now)}
    return runs.unionByName(begun.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in runs.schema.fields]))


def finish_runs(runs: DataFrame, outcomes: DataFrame, now: str) -> DataFrame:
    """The runs with outcomes(id, status, error_class, error_message, counters and what else a run is finished with): every column that outcomes have is overwritten, finished_at is now.

    Error texts are cut to ERROR_CHARS, empty ones are null, missing counts by path are no paths.
    """
    own = [c for c in outcomes.columns if c != "id" and c in runs.columns]
    rows = runs.join(outcomes.select("id", F.lit(True).alias("_over"), *[F.col(c).alias(f"_new_{c}") for c in own]), "id", "left")
    value = {c: F.col(f"_new_{c}") for c in own}
    if "error_message" in own:
        value["error_message"] = F.when(F.col("_new_error_message") != "", F.substring("_new_error_message", 1, ERROR_CHARS))
    if "per_category_counts" in own:
        value["per_category_counts"] = F.coalesce("_new_per_category_counts", F.expr("cast(map() as map<string,int>)"))
    value["finished_at"] = at(now)
    return rows.select(*[F.when(F.col("_over"), value[f.name]).otherwise(F.col(f.name)).cast(f.dataType).alias(f.name) if f.name in value else F.col(f.name) for f in runs.schema.fields])


def finish_pictures(runs: DataFrame, ids: DataFrame, now: str) -> DataFrame:
    """The runs with phase_b_finished_at now for ids(id): those whose pictures are done; null stays the mark of one that was cut off."""
    rows = runs.join(ids.select("id", F.lit(True).alias("_done")).distinct(), "id", "left")
    return rows.select(*[F.when(F.col("_done"), at(now)).otherwise(F.col(c)).alias(c) if c == "phase_b_finished_at" else F.col(c) for c in runs.columns])


def fail_stale_runs(runs: DataFrame, stopped: DataFrame, now: str, message: str = "stopped from outside") -> tuple[DataFrame, DataFrame]:
    """The runs after the clean-up of stopped(vendor_id, git_sha), and how many it failed for each: runs of that vendor and revision that still count as running become timeouts."""
    rows = runs.join(stopped.select("vendor_id", "git_sha", F.lit(True).alias("_stopped")).distinct(), ["vendor_id", "git_sha"], "left")
    hit = F.coalesce(F.col("_stopped"), F.lit(False)) & (F.col("status") == "running")
    value = {"status": F.lit("failed"), "error_class": F.lit("timeout"), "error_message": F.lit(message), "finished_at": at(now)}
    after = rows.select(*[F.when(hit, value[c]).otherwise(F.col(c)).alias(c) if c in value else F.col(c) for c in runs.columns])
    return after, rows.where(F.col("_stopped")).groupBy("vendor_id", "git_sha").agg(F.count(F.when(hit, 1)).alias("failed"))
