"""Studies and audits: what goes out of stock fast and why, what a filter would wrongly drop, guarded repairs, review samples, surfaces that must agree."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .health import nearest_rank

# Limits of the verdict on a vendor's fast goings.
RELIST_MOST, REAPPEAR_MOST, CHURN_MEDIAN, CHURN_P90, ISOLATED_LEAST, BULK_PASS, CHURNY = 0.10, 0.20, 2, 4, 0.50, 10, 3
FAST_HOURS, FAIR_DAYS = 24, 7
#: Deny terms that one audit holds as an automaton in each task.
MOST_TERMS = 200_000
SAMPLE_DEAREST, SAMPLE_DRAWN = 5, 5


def pass_of(rows: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    """(key, run_id) of rows(key, vendor_id, t): the pass that made an observation, the vendor's last run that began at or before it (of equal ones the largest id). Rows before every run are absent.

    Runs meet the observations of their own day only; of the days before, the newest run of each is carried forward.
    """
    began = F.struct(F.col("started_at").alias("at"), F.col("id").alias("run_id"))
    nothing = F.lit(None).cast("struct<at:timestamp_ntz,run_id:bigint>")
    ours = rows.select("vendor_id", F.col(key).alias("k"), "t", nothing.alias("run"), F.lit(1).alias("_after"))
    theirs = runs.select("vendor_id", F.lit(None).cast(rows.schema[key].dataType).alias("k"), F.col("started_at").alias("t"), began.alias("run"), F.lit(0).alias("_after"))
    events = ours.unionByName(theirs).withColumn("day", F.to_date("t"))
    so_far = Window.partitionBy("vendor_id", "day").orderBy("t", "_after").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = events.withColumn("same", F.max("run").over(so_far)).where("_after = 1").select("vendor_id", "day", "k", "same")
    earlier = Window.partitionBy("vendor_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = events.groupBy("vendor_id", "day").agg(F.max("run").alias("newest")).withColumn("carried", F.max("newest").over(earlier)).drop("newest")
    return within.join(days, ["vendor_id", "day"]).select(F.col("k").alias(key), F.coalesce("same", "carried")["run_id"].alias("run_id")).where("run_id is not null")


def _flips(history: DataFrame, listings: DataFrame) -> DataFrame:
    """The log of known listings with the vendor and the stock before."""
    w = Window.partitionBy("listing_id").orderBy("observed_at", "id")
    known = listings.select(F.col("id").alias("listing_id"), "vendor_id", "named_coral_id")
    return history.join(known, "listing_id").withColumn("was", F.lag("in_stock").over(w))


def fast_goings(history: DataFrame, listings: DataFrame, runs: DataFrame, hours: int = FAST_HOURS, days: int = FAIR_DAYS) -> DataFrame:
    """(listing_id, vendor_id, named_coral_id, first_in_stock_at, first_oos_at, relisted, coral_reappeared, run_id): listings, named or not, in stock again or not, that were out of stock within `hours`.

    `relisted` is the same listing in stock again; `coral_reappeared` another listing of the vendor's same coral first in stock within `days` after, null for unnamed ones; run_id the pass
    that saw it go, null before any run.
    """
    per = Window.partitionBy("listing_id")
    rows = _flips(history, listings).withColumn("fs", F.min(F.when(F.col("in_stock"), F.col("observed_at"))).over(per))
    rows = rows.withColumn("foa", F.min(F.when(~F.col("in_stock") & (F.col("observed_at") > F.col("fs")), F.col("observed_at"))).over(per))
    each = rows.where("fs is not null").groupBy("listing_id", "vendor_id", "named_coral_id", "fs", "foa").agg(F.coalesce(F.max(F.col("in_stock") & (F.col("observed_at") > F.col("foa"))), F.lit(False)).alias("relisted"))
    fast = each.where(F.expr(f"foa - fs <= interval '{hours}' hour"))
    keys = ["vendor_id", "named_coral_id"]
    gone = fast.where("named_coral_id is not null").select(*keys, "listing_id", F.col("foa").alias("t"), F.lit(1).alias("_kind"), F.lit(None).cast("timestamp_ntz").alias("back"))
    came = each.where("named_coral_id is not null").select(*keys, F.lit(None).cast("long").alias("listing_id"), F.col("fs").alias("t"), F.lit(0).alias("_kind"), F.col("fs").alias("back"))
    after = Window.partitionBy(*keys).orderBy("t", "_kind").rowsBetween(Window.currentRow, Window.unboundedFollowing)  # what comes at the same instant is before
    next_ = gone.unionByName(came).withColumn("next", F.min("back").over(after)).where("_kind = 1").select("listing_id", "next")
    out = fast.join(next_, "listing_id", "left").join(pass_of(fast.select("listing_id", "vendor_id", F.col("foa").alias("t")), runs, "listing_id"), "listing_id", "left")
    again = F.when(F.col("named_coral_id").isNotNull(), F.coalesce(F.expr(f"next <= foa + interval '{24 * days}' hour"), F.lit(False)))
    return out.select("listing_id", *keys, F.col("fs").alias("first_in_stock_at"), F.col("foa").alias("first_oos_at"), "relisted", again.alias("coral_reappeared"), "run_id")


def churn(history: DataFrame, listings: DataFrame) -> DataFrame:
    """(vendor_id, listing_id, transitions): how often each listing's stock changed, 0 included."""
    return _flips(history, listings).groupBy("vendor_id", "listing_id").agg(F.count(F.when(F.col("in_stock") != F.col("was"), 1)).alias("transitions"))


def going_clusters(history: DataFrame, listings: DataFrame, runs: DataFrame) -> DataFrame:
    """(vendor_id, run_id, size): listings that each pass saw go out of stock; goings before any run have none and are left out."""
    gone = _flips(history, listings).where("was and not in_stock").select("id", "vendor_id", F.col("observed_at").alias("t"))
    return gone.select("id", "vendor_id").join(pass_of(gone, runs, "id"), "id").groupBy("vendor_id", "run_id").agg(F.count("*").alias("size"))


def going_verdicts(fast: DataFrame, changes: DataFrame, clusters: DataFrame, newest: DataFrame, days: int = FAIR_DAYS) -> DataFrame:
    """One row for each vendor with listings in the log: counts, rates and the verdict (ship, hold, or none without fast goings).

    Rates only count goings with `days` of log after them, up to the one row of newest(at). Percentiles are nearest ranks. A vendor ships if little is relisted, corals seldom come again, listings seldom
    change and most goings are alone in their pass.
    """
    fair = F.col("first_oos_at") <= F.expr(f"at - interval '{24 * days}' hour")
    rows = fast.withColumn("_one", F.lit(1)).join(F.broadcast(newest.withColumn("_one", F.lit(1))), "_one").join(clusters, ["vendor_id", "run_id"], "left")  # one row
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    n = lambda test: F.count(F.when(test, 1))
    named = F.col("coral_reappeared").isNotNull()
    per = rows.groupBy("vendor_id").agg(
        F.count("*").alias("fast"), n(F.col("relisted")).alias("relisted"), n(fair).alias("fair"), n(fair & F.col("relisted")).alias("fair_relisted"), n(fair & named).alias("fair_named"), n(fair & F.col("coral_reappeared")).alias("fair_reappeared"),
        F.count("size").alias("sized"), n(F.col("size") == 1).alias("isolated"), n(F.col("size") >= BULK_PASS).alias("bulk"), F.countDistinct("run_id").alias("passes"),
    )
    biggest = rows.where("run_id is not null").groupBy("vendor_id", "run_id").agg(F.count("*").alias("c")).groupBy("vendor_id").agg(F.max("c").alias("biggest_pass"))
    typical = nearest_rank(rows, ["vendor_id"], "size", (0.5,)).select("vendor_id", F.col("p50").alias("cluster_median"))
    stable = nearest_rank(changes, ["vendor_id"], "transitions", (0.5, 0.9)).select("vendor_id", F.col("p50").alias("churn_median"), F.col("p90").alias("churn_p90"))
    all_ = changes.groupBy("vendor_id").agg(F.count("*").alias("listings"), F.max("transitions").alias("churn_most"), F.round(n(F.col("transitions") >= CHURNY) / F.count("*"), 6).alias("churny_share"))
    out = all_.join(stable, "vendor_id").join(per, "vendor_id", "left").join(biggest, "vendor_id", "left").join(typical, "vendor_id", "left")
    counts = [c for c in (*per.columns[1:], "biggest_pass", "cluster_median")]
    out = out.fillna(0, counts).withColumns({"relist_rate": share("fair_relisted", "fair"), "reappear_rate": share("fair_reappeared", "fair_named"), "isolated_share": share("isolated", "sized"), "bulk_share": share("bulk", "sized"), "biggest_share": share("biggest_pass", "fast")})
    ship = (F.col("relist_rate") < RELIST_MOST) & (F.col("reappear_rate") < REAPPEAR_MOST) & (F.col("churn_median") <= CHURN_MEDIAN) & (F.col("churn_p90") <= CHURN_P90) & (F.col("isolated_share") >= ISOLATED_LEAST)
    out = out.withColumn("verdict", F.when(F.col("fast") == 0, "none").when(ship, "ship").otherwise("hold"))
    return out.withColumns({c: F.round(c, 6) for c in ("relist_rate", "reappear_rate", "isolated_share", "bulk_share", "biggest_share")})


def term_hits(rows: DataFrame, terms: DataFrame, key: str = "id", text: str = "raw_title") -> DataFrame:
    """(key, term, axis) for every term of terms(vendor_id, axis, term) that a row's text has: anywhere (contains), at its beginning (prefix) or as the whole of it, white space at its ends aside (exact); case never counts.

    A term without a vendor_id holds for all vendors. All terms are looked for at once, in one pass of an automaton over each text; it is built once a task from MOST_TERMS terms at most. Null texts hit nothing.
    """
    held = terms.select("vendor_id", "axis", "term").where("term is not null and term <> ''").distinct().limit(MOST_TERMS + 1).collect()
    if len(held) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms for one audit")
    owners: dict[str, list[tuple]] = {}
    for r in held:
        plain = (r["term"].strip() if r["axis"] == "exact" else r["term"]).lower()
        owners.setdefault(plain, []).append((r["vendor_id"], r["axis"], r["term"]))
    fields = rows.select(key, "vendor_id", text).schema

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = ahocorasick.Automaton()
        for plain, own in owners.items():
            if plain:
                machine.add_word(plain, (len(plain), own))
        if len(machine):
            machine.make_automaton()
        for frame in frames:
            out = []
            for number, vendor, title in zip(frame[key], frame["vendor_id"], frame[text]):
                if not isinstance(title, str) or not len(machine):
                    continue
                low = title.lower()
                whole, found = low.strip(), set()
                for end, (size, own) in machine.iter(low):
                    for of, axis, term in own:
                        if (of is None or of == vendor) and (axis == "contains" or axis == "prefix" and end + 1 == size or axis == "exact" and size == len(whole)):
                            found.add((axis, term))
                out += [(number, term, axis) for axis, term in found]
            yield pd.DataFrame(out, columns=[key, "term", "axis"])

    return rows.select(key, "vendor_id", text).mapInPandas(run, f"`{key}` {fields[key].dataType.simpleString()}, term string, axis string")


def false_kills(rows: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, vendor_id, raw_title, terms): rows that the old deny terms keep and the new ones drop, with the terms that do so (axis:term, in order)."""
    dropped = term_hits(rows, new).groupBy("id").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "axis", "term"))), ", ").alias("terms"))
    return rows.select("id", "vendor_id", "raw_title").join(dropped, "id").join(term_hits(rows, old).select("id"), "id", "left_anti")


def collisions(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """(id, vendor_id, term): rows whose title has an entry of expected(vendor_id, term, id) though another id is the one expected of it."""
    terms = expected.select("vendor_id", F.lit("contains").alias("axis"), "term")
    hits = term_hits(rows, terms).join(rows.select("id", "vendor_id"), "id")
    return hits.select("id", "vendor_id", "term").join(expected.select("vendor_id", "term", "id"), ["vendor_id", "term", "id"], "left_anti")


def within_only(rows: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(id, term): rows that have a term of prefixes(vendor_id, term), but not at their beginning: what an entry would wrongly drop if it were looked for anywhere."""
    anywhere = term_hits(rows, prefixes.select("vendor_id", F.lit("contains").alias("axis"), "term"))
    first = term_hits(rows, prefixes.select("vendor_id", F.lit("prefix").alias("axis"), "term"))
    return anywhere.select("id", "term").join(first.select("id", "term"), ["id", "term"], "left_anti")


def repair_gate(derived: DataFrame, expected: DataFrame, runs: DataFrame) -> DataFrame:
    """(vendor_id, derived, unexpected, absent, run_id, ready) of derived(vendor_id, id) and expected(vendor_id, id): a vendor is ready if both have the same ids and its latest run succeeded."""
    both = derived.select("vendor_id", "id", F.lit(1).alias("_d")).distinct().join(expected.select("vendor_id", "id", F.lit(1).alias("_e")).distinct(), ["vendor_id", "id"], "full")
    sets = both.groupBy("vendor_id").agg(F.count("_d").alias("derived"), F.count(F.when(F.col("_e").isNull(), 1)).alias("unexpected"), F.count(F.when(F.col("_d").isNull(), 1)).alias("absent"))
    last = runs.groupBy("vendor_id").agg(F.max(F.struct("started_at", "id", "status")).alias("last"))
    rows = sets.join(last, "vendor_id", "left").withColumn("run_id", F.when(F.col("last.status") == "success", F.col("last.id"))).drop("last")
    return rows.withColumn("ready", (F.col("unexpected") == 0) & (F.col("absent") == 0) & F.col("run_id").isNotNull())


def stock_bridge(listings: DataFrame, derived: DataFrame, expected: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The listings with the derived ones out of stock, and the log's rows (listing_id, price, in_stock, scraper_run_id) under each vendor's latest run.

    The gate is part of both plans: if it isn't ready for a vendor, the job that writes them stops with its counts, and nothing is written.
    """
    gate = repair_gate(derived, expected, runs)
    why = F.concat(F.lit("repair stopped at vendor "), F.col("vendor_id").cast("string"), F.lit(": unexpected "), F.col("unexpected").cast("string"), F.lit(", absent "), F.col("absent").cast("string"), F.lit(", latest run "), F.coalesce(F.col("run_id").cast("string"), F.lit("not successful")))
    checked = gate.select("vendor_id", F.when(F.col("ready"), F.col("run_id")).otherwise(F.raise_error(why)).alias("_run"))
    hit = derived.select("vendor_id", "id").distinct().join(checked, "vendor_id")
    rows = listings.join(hit.select("id", "_run"), "id", "left")
    after = rows.select(*[F.when(F.col("_run").isNotNull(), False).otherwise(F.col(c)).alias(c) if c == "in_stock" else F.col(c) for c in listings.columns])
    return after, rows.where("_run is not null").select(F.col("id").alias("listing_id"), F.col("current_price").alias("price"), F.lit(False).alias("in_stock"), F.col("_run").alias("scraper_run_id"))


def review_sample(rows: DataFrame, whole: Column, seed: str, dearest: int = SAMPLE_DEAREST, drawn: int = SAMPLE_DRAWN) -> DataFrame:
    """(id, vendor_id, current_price, dear, drawn): for a person to look at, of each vendor the dearest rows and as many drawn ones, each row once; all rows of a vendor where `whole` is true.

    Drawn are the smallest of a hash of seed and id: the same seed draws the same rows, whatever else is there, and samples of parts of a table can be merged.
    """
    w = Window.partitionBy("vendor_id")
    dear = F.row_number().over(w.orderBy(F.col("current_price").desc_nulls_last(), F.col("id").asc())) <= dearest
    lot = F.row_number().over(w.orderBy(F.md5(F.concat_ws(":", F.lit(seed), "id")), F.col("id").asc())) <= drawn
    out = rows.withColumns({"dear": dear, "drawn": lot, "_whole": whole}).where("dear or drawn or _whole")
    return out.select("id", "vendor_id", "current_price", "dear", "drawn")


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], value: str, tolerance: float = 0.0) -> DataFrame:
    """(keys, left, right): where two surfaces, read at one instant, don't agree on a value; a key that one of them lacks has null there."""
    both = left.select(*keys, F.col(value).alias("left")).join(right.select(*keys, F.col(value).alias("right")), keys, "full")
    close = F.col("left").isNotNull() & F.col("right").isNotNull() & (F.abs(F.col("left") - F.col("right")) <= tolerance) if tolerance else F.col("left").eqNullSafe(F.col("right"))
    return both.where(~close)


def by_vendor_and_day(events: DataFrame) -> DataFrame:
    """(vendor_slug, day, n): a surface of events in the form that reconcile() takes."""
    return events.groupBy("vendor_slug", F.to_date("event_at").alias("day")).agg(F.count("*").alias("n"))
