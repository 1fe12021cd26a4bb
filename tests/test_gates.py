"""Every gate of the core queries with a row that only this gate removes: visible vendors, categories, auctions, stock, windows' edges."""

from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from test_scenarios import HISTORY, LISTING, NOW, RUN, VENDOR, at, listing

from tidemark.operators import events, guards, health, market, ranking, timeseries

SHOPS = [(1, "one", "One", True), (2, "two", "Two", True), (3, "_test", "Test", True), (4, "gone", "Gone", False)]
EDGE = datetime(2026, 6, 7, 12)  # NOW less a week


@pytest.fixture(scope="module")
def shops(spark):
    return spark.createDataFrame([(*s, None, None, None) for s in SHOPS], VENDOR)


@pytest.fixture(scope="module")
def corals(spark):
    return spark.createDataFrame([(1, "A", "a", "a", "V", True), (2, "B", "b", "b", "V", True), (3, "_C", "c", "_c", "V", True), (4, "D", "d", "d", "V", False)], "id long, canonical_name string, normalized_name string, slug string, origin_vendor string, active boolean")


def seen(row, when, image=None, title=None):
    return (*row[:9], when, *row[10:15], image, title or row[3])


SEEN = LISTING + ", normalized_title string"


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


def log(spark, *rows):
    return spark.createDataFrame([(n, i, Decimal(p), s, t) for n, (i, p, s, t) in enumerate(rows, 1)], HISTORY)


def test_activity_counts_lead_events_of_all_arms(spark, shops, corals):
    rows = spark.createDataFrame([listing(1), listing(2, 2), listing(3, first=at(14, 6)), listing(4, 3, first=at(14, 6)), listing(5, 4, first=at(14, 6)), listing(6, first=at(14, 6), category="invert"), listing(7, first=at(14, 6), bulk=True), listing(8, first=at(14, 6), category=None)], LISTING)
    history = log(spark, (1, "9", True, at(3)), (1, "8", True, at(14)), (2, "9", False, at(3)), (2, "9", True, at(14)))
    leads = events.lead_events(history, rows, shops, corals, NOW, 24, limit=None)
    assert [tuple(r) for r in guards.aggregate_activity(leads, 24).collect()] == [(4, 2, 24)]


def test_velocity_gates(spark, shops, corals):
    cases = {1: {}, 2: {"vendor": 3}, 3: {"vendor": 4}, 4: {"category": "equipment"}, 5: {"category": "invert"}, 6: {"coral": 99}, 7: {"category": None}}
    rows = spark.createDataFrame([listing(i, **({"coral": 1, "stock": False} | more)) for i, more in cases.items()], LISTING)
    history = log(spark, *[(i, "9", s, t) for i in cases for s, t in ((True, at(6)), (False, at(8)))])
    runs = spark.createDataFrame([(v, v, at(1), at(1, 1), "success") for v in (1, 2, 3, 4)], RUN)
    assert ids(timeseries.velocity(history, rows, shops, corals, runs, NOW), "listing_id") == [1, 7]


def test_price_series_leave_hidden_vendors_out(spark, shops):
    rows = spark.createDataFrame([listing(i, i, 1) for i in (1, 2, 3, 4)], LISTING)
    history = log(spark, (1, "50", True, at(12)), (2, "40", True, at(12)), (3, "1", True, at(12)), (4, "2", True, at(12)))
    assert ids(timeseries.price_points(history, rows, shops, NOW, 1), "vendor_id") == [1, 2]
    assert {r["price"] for r in timeseries.price_envelope(history, rows, shops, NOW).collect()} == {Decimal("40.00")}
    assert {r["vendor_id"] for r in timeseries.price_by_vendor(history, rows, shops, NOW).collect()} == {1, 2}


def test_restocks_of_excluded_categories_do_not_count(spark):
    rows = spark.createDataFrame([("back-in-stock", 1, "A", "lps"), ("back-in-stock", 1, "A", None), ("back-in-stock", 1, "A", "invert"), ("just-listed", 1, "A", "lps"), ("back-in-stock", None, None, "lps")], "event string, named_coral_id long, canonical_name string, category string")
    assert [tuple(r) for r in market.most_restocked(rows).collect()] == [(1, "A", 2)]


def test_availability_and_vendor_counts(spark):
    rows = [seen(listing(1, 1, 1), at(13)), seen(listing(2, 2, 1, auction=at(20)), at(13)), seen(listing(3, 3, 1, is_auction=True), at(13)), seen(listing(4, 4, 1), EDGE), seen(listing(5, 4, 1, stock=False), EDGE + timedelta(seconds=1))]
    table = spark.createDataFrame(rows, SEEN)
    assert ids(market.availability(table, NOW)) == [1, 2, 5] and ids(market.availability(table, NOW, 1, False)) == [1, 2]
    assert [tuple(r) for r in market.in_window_vendors(table, NOW).collect()] == [(1, 3)]


def test_inventory_total_has_the_pages_gates(spark):
    late = EDGE - timedelta(days=7)
    rows = [seen(listing(1), at(13)), seen(listing(2, auction=at(20)), at(13)), seen(listing(3, is_auction=True, stock=False, category="invert"), at(13)), seen(listing(4, stock=False), at(13)), seen(listing(5, category="sps"), at(13)), seen(listing(6), late), seen(listing(7, category="invert"), at(13)), seen(listing(8, 2), at(13)), seen(listing(9, 4, is_auction=True), late)]
    table = spark.createDataFrame(rows, SEEN)
    for kind in ({}, {"category": "lps"}, {"include_oos": True}, {"category": "lps", "include_oos": True}):
        pages = market.inventory(table, 1, NOW, **kind).count()
        assert {r["vendor_id"]: (r["total"], r["gated_auctions"]) for r in market.inventory_totals(table, NOW, **kind).collect()} == {1: (pages, True), 2: (1, False)}
    assert market.inventory(table, 1, NOW).count() == 3 and market.inventory(table, 1, NOW, category="lps", include_oos=True).count() == 3


def test_search_reads_normalised_texts(spark, shops, corals):
    rows = [seen(listing(1), at(13), title="gold torch"), seen(listing(2, is_auction=True), at(13), title="gold torch"), seen(listing(3, 3), at(13), title="gold torch"), seen(listing(4, category="equipment"), at(13), title="gold torch"), seen(listing(5, stock=False), at(13), title="gold torch"), seen(listing(6), at(13))]
    assert ids(market.search_listings(spark.createDataFrame(rows, SEEN), shops, "Görch törch gold".replace("Görch ", ""))) == [1]
    aliases = spark.createDataFrame([("zz b", 1, None, "auto-link"), ("zz c", 1, None, "flag-review")], "alias_text string, named_coral_id long, cluster_label string, match_behavior string")
    found = lambda q: [(r["id"], r["matched_alias"]) for r in market.search_corals(corals, aliases, q).collect()]
    assert found("zz") == [(1, "zz b")] and found("b") == [(1, "zz b"), (2, None)] and found("_C") == [] and found("d") == []


def test_directory_and_pictures(spark, shops, corals):
    rows = [seen(listing(1, 3, 1), at(13), "x"), seen(listing(2, 4, 2, stock=False), at(2), "y"), seen(listing(3, 1, 3), at(13), "z"), seen(listing(4, 1, 4), at(13), "z")]
    table = spark.createDataFrame(rows, SEEN)
    assert {r["id"]: (r["has_ever_listed"], r["indexable"]) for r in market.coral_directory(corals, table, shops).collect()} == {1: (False, False), 2: (True, True), 3: (True, False)}
    rows = [seen(listing(1, 1, 1, first=at(1)), at(13), "old"), seen(listing(2, 1, 1, first=at(2)), at(13)), seen(listing(3, 1, 1, first=at(3), stock=False), at(13), "oos"), seen(listing(4, 1, 1, first=at(3), is_auction=True), at(13), "auction"), seen(listing(5, 3, 1, first=at(3)), at(13), "test"), seen(listing(6, 1, 1, first=at(3)), EDGE, "edge"), seen(listing(7, 2, 2), at(13)), seen(listing(8, 2, 3), at(13), "c"), seen(listing(9, 2, 4), at(13), "d")]
    found = market.coral_images(corals, spark.createDataFrame(rows, SEEN), shops, NOW).collect()
    assert {r["named_coral_id"]: (r["listing_id"], r["image_url"]) for r in found} == {1: (1, "old"), 2: (7, None)}


def test_spotlight_order(spark):
    offer = "named_coral_id long, vendor_id long, id long, current_price double, first_seen_at timestamp_ntz"
    # coral 1 is carried most widely but has no card; 2 and 3 are equal, the larger id goes first
    rows = [(1, v, v, None, at(9)) for v in (1, 2, 3, 4)] + [(c, v, 10 * c + v, None if v == 3 else 5.0 * v, at(9 - v)) for c in (2, 3) for v in (1, 2, 3)] + [(3, 1, 39, 1.0, at(1)), (2, 1, 29, 1.0, at(1))]
    found = [(r["named_coral_id"], r["vendor_id"], r["id"], r["vendors"]) for r in ranking.spotlight(spark.createDataFrame(rows, offer)).collect()]
    assert found == [(3, 1, 31, 3), (3, 2, 32, 3)]
    assert ranking.spotlight(spark.createDataFrame([r for r in rows if r[0] == 1], offer)).collect() == []


def test_coverage_without_test_vendors(spark, shops):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([listing(1, category=None), listing(2, 3, category=None), listing(3, 4, category=None), listing(4, category=None, is_auction=True), listing(5)], LISTING)
    assert {r["vendor_id"]: (r["n"], r["missing"]) for r in health.coverage(rows, shops, F.lit(True)).collect()} == {None: (3, 2), 1: (2, 1), 4: (1, 1)}
