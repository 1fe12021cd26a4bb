"""Patches and their merge, runs, and streams that stop and go on: small cases with known answers."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from test_scenarios import HISTORY, NOW, at

from tidemark.operators import events, persist
from tidemark.streaming import ingest

SNAPSHOT = (
    "vendor_id long, product_url string, vendor_sku string, raw_title string, normalized_title string, current_price decimal(10,2), compare_at_price decimal(10,2), markdown_started_at timestamp_ntz, currency string, in_stock boolean, is_auction boolean, "
    "category string, lineage_flag string, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, image_url string, last_price_changed_at timestamp_ntz, named_coral_id long, match_confidence string, match_method string, matched_at timestamp_ntz, bulk_cluster boolean"
)
D = Decimal
ITEM = "vendor_id long, product_url string, raw_title string, normalized_title string, current_price decimal(10,2), compare_at_price decimal(10,2), in_stock boolean, vendor_sku string, category string, vendor_image_url string"
LATE = datetime(2026, 6, 14, 12)


def row(url, price="5.00", compare=None, marked=None, stock=True, vendor=1, **more):
    values = dict(vendor_id=vendor, product_url=url, vendor_sku="old", raw_title="t", normalized_title="t", current_price=price and D(price), compare_at_price=compare and D(compare), markdown_started_at=marked, currency="EUR", in_stock=stock, is_auction=True, category="lps",
                  lineage_flag="vendor-named", first_seen_at=at(1), last_seen_at=at(2), image_url=None, last_price_changed_at=at(1), named_coral_id=3, match_confidence="exact", match_method="m", matched_at=at(1), bulk_cluster=True)
    return tuple((values | more).values())


def item(url, price="5.00", compare=None, stock=True, vendor=1, title="t2", sku=None, category=None, picture="p"):
    return (vendor, url, title, title, price and D(price), compare and D(compare), stock, sku, category, picture)


def test_what_each_decision_writes(spark):
    current = spark.createDataFrame([row("same", compare="9.00", marked=at(1)), row("price"), row("oos"), row("absent"), row("onset"), row("end", compare="9.00", marked=at(1)), row("other", vendor=2)], SNAPSHOT)
    items = spark.createDataFrame([item("same", compare="8.00"), item("price", "4.00", sku="n", category="sps"), item("oos", stock=False), item("onset", compare="7.00"), item("end"), item("new", None, "6.00"), item("other")], ITEM)
    matched = spark.createDataFrame([(1, u, 77, "alias", "a", at(14)) for u in ("new", "price")], "vendor_id long, product_url string, named_coral_id long, match_confidence string, match_method string, matched_at timestamp_ntz")
    patched = persist.patches(items, current, NOW, matched, F.col("vendor_id") == 1, spark.createDataFrame([(1, "absent")], "vendor_id long, product_url string"))
    after = {(r["vendor_id"], r["product_url"]): r for r in persist.apply_patches(current, patched, NOW).collect()}
    before = {(r["vendor_id"], r["product_url"]): r for r in current.collect()}
    change = lambda u, v=1: {c: after[v, u][c] for c in after[v, u].asDict() if after[v, u][c] != before[v, u][c]}
    assert change("same") == {"compare_at_price": D("8.00"), "last_seen_at": LATE}  # the episode goes on, titles stay
    assert change("onset") == {"compare_at_price": D("7.00"), "markdown_started_at": LATE, "last_seen_at": LATE}
    assert change("end") == {"compare_at_price": None, "markdown_started_at": None, "last_seen_at": LATE}
    assert change("absent") == {"in_stock": False}
    stated = {"vendor_sku": None, "raw_title": "t2", "normalized_title": "t2", "currency": "USD", "is_auction": False, "category": None, "lineage_flag": "unknown", "last_seen_at": LATE}
    assert change("oos") == stated | {"in_stock": False}
    assert change("price") == stated | {"current_price": D("4.00"), "vendor_sku": "n", "category": "sps", "last_price_changed_at": LATE}  # no match for a known row
    new = after[1, "new"]
    assert (new["first_seen_at"], new["markdown_started_at"], new["image_url"], new["named_coral_id"], new["bulk_cluster"], new["current_price"]) == (LATE, LATE, "p", 77, False, None)
    assert after[1, "new"]["last_price_changed_at"] is None and change("other", 2) == {} and (1, "other") in after  # another vendor's url is another key
    log = {r["product_url"]: (r["price"], r["in_stock"], r["scraper_run_id"]) for r in persist.log_of(patched, current, F.lit(5), NOW).collect()}
    assert log == {"price": (D("4.00"), True, 5), "oos": (D("5.00"), False, 5), "new": (None, True, 5), "other": (D("5.00"), True, 5), "absent": (D("5.00"), False, 5)}
    flipped = persist.bulk_flips(persist.apply_patches(current, patched, NOW), patched, 1)
    assert {r["product_url"] for r in flipped.where("not bulk_cluster").collect()} == set()


def test_stray_and_missing_columns_stop_the_job(spark):
    current = spark.createDataFrame([row("a")], SNAPSHOT)
    patched = persist.patches(spark.createDataFrame([item("b")], ITEM), current, NOW)
    with pytest.raises(ValueError, match="may not write: first_seen_at"):
        persist.apply_patches(current, patched.withColumn("first_seen_at", F.lit(NOW)), NOW)
    with pytest.raises(Exception, match="may not write: bulk_cluster"):
        persist.apply_patches(current, patched.withColumn("present", F.array_append("present", F.lit("bulk_cluster"))), NOW).collect()
    untitled = persist.patches(spark.createDataFrame([item("b", title=None)], ITEM), current, NOW)
    with pytest.raises(Exception, match="a new row without raw_title: b"):
        persist.apply_patches(current, untitled, NOW).collect()
    assert persist.apply_patches(current, persist.patches(spark.createDataFrame([], ITEM), current, NOW), NOW).collect() == current.collect()


RUN = "id long, vendor_id long, status string, git_sha string, started_at timestamp_ntz, finished_at timestamp_ntz, error_class string, error_message string, listings_seen long, per_category_counts map<string,int>, phase_b_finished_at timestamp_ntz"


def test_life_of_a_run(spark):
    runs = spark.createDataFrame([], RUN)
    runs = persist.start_runs(runs, spark.createDataFrame([(1, 7, "a"), (2, 7, "b"), (3, 8, "a")], "id long, vendor_id long, git_sha string"), NOW)
    assert {(r["id"], r["status"], r["started_at"], r["finished_at"]) for r in runs.collect()} == {(i, "running", LATE, None) for i in (1, 2, 3)}
    done = persist.finish_runs(runs, spark.createDataFrame([(1, "failed", "x" * 2000, 4, None), (3, "success", "", 5, {"p": 2})], "id long, status string, error_message string, listings_seen long, per_category_counts map<string,int>"), NOW)
    got = {r["id"]: r for r in done.collect()}
    assert len(got[1]["error_message"]) == 1000 and got[1]["per_category_counts"] == {} and got[3]["error_message"] is None and got[3]["per_category_counts"] == {"p": 2} and got[2]["finished_at"] is None
    pictured = persist.finish_pictures(done, done.where("id = 3").select("id"), NOW)
    assert {r["id"] for r in pictured.where("phase_b_finished_at is not null").collect()} == {3}
    after, failed = persist.fail_stale_runs(pictured, spark.createDataFrame([(7, "b"), (7, "a"), (9, "z")], "vendor_id long, git_sha string"), NOW)
    assert {(r["vendor_id"], r["git_sha"]): r["failed"] for r in failed.collect()} == {(7, "a"): 0, (7, "b"): 1}
    assert {r["id"]: (r["status"], r["error_class"]) for r in after.collect()} == {1: ("failed", None), 2: ("failed", "timeout"), 3: ("success", None)}


def test_any_split_of_the_log_gives_the_batch_result(spark, tmp_path):
    """Listings spread over batches at random, ties in time, null prices, batches without rows; the stream is stopped and started from its checkpoint after each."""
    rng, rows, t = random.Random(6), [], datetime(2026, 6, 1)
    for n in range(400):
        t += timedelta(minutes=rng.choice([0, 0, 7]))
        rows.append((n, rng.randrange(20), rng.choice([None, D(rng.randrange(1, 9))]), rng.random() < 0.6, t))
    log = spark.createDataFrame(rows, HISTORY)
    want = {tuple(r) for r in events.with_previous(log).collect()}
    for trial in range(2):
        folder, at_ = tmp_path / str(trial), 0
        while at_ < len(rows):
            size = rng.choice([1, 90, 200])
            part = rows[at_ : at_ + size]
            rng.shuffle(part)
            spark.createDataFrame(part, HISTORY).write.mode("append").parquet(f"{folder}/in")
            at_ += size
            for _ in range(2):  # the second call has nothing to do
                ingest.run_available(ingest.log_changes(ingest.arriving(spark, log.schema, f"{folder}/in")), f"{folder}/out", f"{folder}/checkpoint")
        got = spark.read.schema(ingest.CHANGES).parquet(f"{folder}/out")
        columns = events.with_previous(log).columns
        assert sorted(map(str, ({tuple(r) for r in got.select(*columns).collect()} ^ want))) == [] and got.count() == len(rows)


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    """A scrape fails after its log is written: the next call repeats the batch and overwrites what it left."""
    first = spark.createDataFrame([row("a"), row("b")], SNAPSHOT)
    broken = [True]

    def step(before, items):
        patched = persist.patches(items, before, NOW)
        return persist.apply_patches(before, patched, NOW), persist.log_of(patched, before, F.lit(1), NOW)

    def fails_once(before, items):
        after, gained = step(before, items)
        return after, gained.withColumn("price", F.raise_error(F.lit("lost")).cast("decimal(10,2)")) if broken[0] else gained

    scrapes = [[item("a", "4.00"), item("c")], [item("a", "3.00"), item("b", stock=False)]]
    for k, items in enumerate(scrapes):
        spark.createDataFrame(items, ITEM).write.mode("append").parquet(f"{tmp_path}/in")
        stream = lambda: ingest.arriving(spark, spark.createDataFrame([], ITEM).schema, f"{tmp_path}/in")
        broken[0] = k == 1
        if broken[0]:
            with pytest.raises(Exception, match="lost"):
                ingest.snapshot_after(stream(), first, str(tmp_path), fails_once)
            broken[0] = False
        after = ingest.snapshot_after(stream(), first, str(tmp_path), fails_once)
    assert {r["product_url"]: (r["current_price"], r["in_stock"]) for r in after.collect()} == {"a": (D("3.00"), True), "b": (D("5.00"), False), "c": (D("5.00"), True)}
    log = spark.read.parquet(f"{tmp_path}/log").collect()
    assert sorted((r["batch"], r["product_url"], r["price"]) for r in log) == [(0, "a", D("4.00")), (0, "c", D("5.00")), (1, "a", D("3.00")), (1, "b", D("5.00"))]
