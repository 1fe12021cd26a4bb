"""Small cases with known answers."""

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import cdc, events, guards, health, market, matching, ranking, timeseries
from tidemark.sources import catalogues

NOW = "2026-06-14 12:00:00"
LISTING = "id long, vendor_id long, named_coral_id long, raw_title string, product_url string, current_price decimal(10,2), in_stock boolean, category string, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, compare_at_price decimal(10,2), markdown_started_at timestamp_ntz, auction_end_time timestamp_ntz, is_auction boolean, bulk_cluster boolean, image_url string"
VENDOR = "id long, slug string, display_name string, active boolean, announced_email_at timestamp_ntz, announced_discord_at timestamp_ntz, first_organic_drop_at timestamp_ntz"
HISTORY = "id long, listing_id long, price decimal(10,2), in_stock boolean, observed_at timestamp_ntz"
RUN = "id long, vendor_id long, started_at timestamp_ntz, finished_at timestamp_ntz, status string"


def at(day, hour=0, minute=0):
    return datetime(2026, 6, day, hour, minute)


def listing(id, vendor=1, coral=None, price="50.00", stock=True, first=at(1), compare=None, marked=None, auction=None, is_auction=False, category="lps", bulk=False):
    price = None if price is None else Decimal(price)
    return (id, vendor, coral, f"title {id}", f"https://x/{id}", price, stock, category, first, at(13), None if compare is None else Decimal(compare), marked, auction, is_auction, bulk, None)


def vendors(spark, n=3):
    return spark.createDataFrame([(i, f"v{i}", f"V {i}", True, None, None, None) for i in range(1, n + 1)], VENDOR)


def test_cheapest_keeps_ties_and_needs_two_vendors(spark):
    rows, n = [], 0
    for coral, offers in enumerate([[10, 12, 15], [20, 20], [5], [(8, "auction"), 30, 40], [(5, "oos"), 25, 35], [None, 50, 55]]):
        for vendor, offer in enumerate(offers, 1):
            n += 1
            price, flag = offer if isinstance(offer, tuple) else (offer, "")
            rows.append(listing(n, vendor, coral, None if price is None else str(price), flag != "oos", auction=at(20) if flag == "auction" else None))
    found = market.cheapest(spark.createDataFrame(rows, LISTING), vendors(spark))
    assert {r["id"] for r in found.collect()} == {1, 4, 5, 8, 11, 14}


def test_velocity(spark):
    cases = {
        1: ([(True, at(6, 12)), (True, at(7, 12)), (False, at(8, 12))], {}),
        2: ([(False, at(5)), (True, at(6)), (False, at(9))], {}),
        3: ([(True, at(1, 0, 3)), (False, at(8, 12))], {}),
        4: ([(True, at(6, 12))], {"stock": True}),
        5: ([(True, at(6)), (False, at(8))], {"coral": None}),
        6: ([(True, at(6)), (False, at(8))], {"auction": at(9)}),
        7: ([(True, at(6)), (False, at(8))], {"is_auction": True}),
    }
    rows = [listing(i, **({"coral": 1, "stock": False} | more)) for i, (_, more) in cases.items()]
    log, n = [], 0
    for i, (states, _) in cases.items():
        for stock, t in states:
            n += 1
            log.append((n, i, Decimal("9.00"), stock, t))
    runs = spark.createDataFrame([(1, 1, at(1), at(1, 0, 5), "success"), (2, 1, at(10), at(10, 1), "success")], RUN)
    found = {r["listing_id"]: r for r in timeseries.velocity(spark.createDataFrame(log, HISTORY), spark.createDataFrame(rows, LISTING), vendors(spark), spark.createDataFrame([(1,)], "id long"), runs, NOW).collect()}
    assert set(found) == {1, 2}
    assert (found[1]["first_in_stock_at"], found[1]["last_in_stock_at"], found[1]["first_oos_at"], found[1]["prior_run_at"]) == (at(6, 12), at(7, 12), at(8, 12), at(1, 0, 5))
    assert found[2]["first_oos_at"] == at(9)


def test_price_drops_ratio_order_and_arms(spark):
    rows = [listing(1, price="100.00", compare="105.00", marked=at(10)), listing(2, price="100.00", compare="104.90", marked=at(10)), listing(3, price="100.00", compare="200.00", marked=at(10)), listing(4, price="40.00", compare="90.00", marked=at(13)), listing(5, stock=False, compare="90.00", marked=at(13))]
    log = spark.createDataFrame([(1, 4, Decimal("60.00"), True, at(2)), (2, 4, None, True, at(3)), (3, 4, Decimal("50.00"), True, at(4)), (4, 4, Decimal("40.00"), True, at(9))], HISTORY)
    found = events.recent_price_drops(log, spark.createDataFrame(rows, LISTING), vendors(spark), NOW).collect()
    assert [(r["listing_id"], r["arm"]) for r in found] == [(1, 2), (3, 2), (4, 1)]
    assert found[2]["prior_price"] == Decimal("50.00")


def test_lead_event_restock_gap_and_filter_after_rank(spark):
    rows = spark.createDataFrame([listing(1, first=at(14)), listing(2), listing(3)], LISTING)
    log = spark.createDataFrame(
        [(1, 1, Decimal("60.00"), True, at(13)), (2, 1, Decimal("50.00"), True, at(14, 1)), (3, 2, Decimal("50.00"), False, at(12)), (4, 2, Decimal("50.00"), True, at(14, 2)), (5, 3, Decimal("50.00"), False, at(12)), (6, 3, Decimal("51.00"), False, at(14)), (7, 3, Decimal("51.00"), True, at(14, 3))], HISTORY
    )
    corals = spark.createDataFrame([(1, "A", "a", "V")], "id long, canonical_name string, slug string, origin_vendor string")
    lead = lambda kinds: {(r["listing_id"], r["event"]) for r in events.lead_events(log, rows, vendors(spark), corals, NOW, 24, kinds).collect()}
    assert lead(None) == {(1, "price-dropped"), (2, "back-in-stock")}
    assert lead(["just-listed"]) == set()
    with pytest.raises(ValueError):
        lead(["sold"])


def test_envelope_gaps_and_window(spark):
    rows = spark.createDataFrame([listing(1, coral=1), listing(2, coral=1)], LISTING)
    log = spark.createDataFrame([(1, 1, Decimal("10.00"), True, at(5, 3)), (2, 1, Decimal("12.00"), True, at(5, 4)), (3, 1, Decimal("12.00"), False, at(7)), (4, 2, Decimal("0.00"), True, at(6)), (5, 1, Decimal("8.00"), True, at(10, 23))], HISTORY)
    days = lambda n: {str(r["day"])[-2:]: float(r["price"]) for r in timeseries.price_envelope(log, rows, vendors(spark), NOW, 1, n).collect()}
    assert days(None) == {"05": 12.0, "06": 12.0} | {str(d): 8.0 for d in range(10, 15)}
    assert days(2) == {"12": 8.0, "13": 8.0, "14": 8.0}


def test_activity_has_a_row_without_listings(spark):
    row = guards.aggregate_activity(spark.createDataFrame([], LISTING)).collect()
    assert [(r["n"], r["vendors"]) for r in row] == [(0, 0)]


def test_onboarding(spark):
    v = vendors(spark)
    rows = spark.createDataFrame([listing(i, 1) for i in range(3)] + [listing(10, 1, stock=False), listing(11, 1, category="invert"), listing(12, 1, category="equipment"), listing(13, 2, category=None)], LISTING)
    assert {(r["slug"], r["n"]) for r in market.pending_announcements(v, rows, "email").collect()} == {("v1", 3), ("v2", 1)}
    slugs = lambda *xs: spark.createDataFrame([(x,) for x in xs], "slug string")
    after, stamped = market.mark_announced(v, slugs("v1", "v3", "v3", "unknown"), "email", NOW)
    assert {r["slug"] for r in stamped.collect()} == {"v1", "v3"}
    assert market.mark_announced(after, slugs("v1"), "email", NOW)[1].count() == 0
    assert [r["slug"] for r in market.onboarding_strip(after, rows).collect()] == ["v1"]
    with pytest.raises(ValueError):
        market.pending_announcements(v, rows, "fax")


def test_bulk_flip_is_monotonic(spark):
    rows = spark.createDataFrame([listing(i, 1) for i in range(4)] + [listing(9, 2, bulk=True)], LISTING)
    assert {r["id"]: r["bulk_cluster"] for r in guards.cluster_flips(rows, 4).collect()} == {0: True, 1: True, 2: True, 3: True, 9: True}
    assert {(r["vendor_id"], r["to_true"], r["to_false"]) for r in guards.cluster_drift(rows, 4).collect()} == {(1, 4, 0), (2, 0, 1)}


def test_diff_decisions_and_cohort(spark):
    schema = "product_url string, current_price decimal(10,2), in_stock boolean"
    d = Decimal
    old = spark.createDataFrame([("a", d(5), True), ("b", d(5), False), ("c", d(5), True), ("e", None, True), ("f", d(5), True), ("g", d(5), True), ("h", d(5), False)], schema)
    new = spark.createDataFrame([("a", d(4), False), ("b", d(5), True), ("c", d(5), False), ("d", d(1), True), ("e", None, True)], schema)
    assert {r["product_url"]: r["decision"] for r in cdc.classify(new, old).collect()} == {"a": "price_changed", "b": "restocked", "c": "oos", "d": "new", "e": "unchanged"}
    gone = cdc.cohort_gone(old, new, spark.createDataFrame([("g",)], "product_url string"))
    assert [(r["product_url"], r["last_price"]) for r in gone.collect()] == [("f", d(5))]


CORAL = "id long, canonical_name string, normalized_name string, origin_vendor string, requires_vendor_prefix boolean, active boolean"
ALIAS = "alias_text string, named_coral_id long, cluster_label string, match_behavior string"


def test_matcher_stages(spark):
    corals = spark.createDataFrame([(1, "Gold Torch", "gold torch", "Acme", False, True), (2, "Gold Torch Supreme", "gold torch supreme", "Acme", False, True), (3, "Zed Dragon", "zed dragon", "Zed", True, True), (4, "Pink Lemonade", "pink lemonade", "Acme", False, True), (5, "Old Name", "old name", "Acme", False, False), (6, "Needs Word", "bare word", "Acme", True, True)], CORAL)
    aliases = spark.createDataFrame([("gt special", 1, None, "auto-link"), ("old alias", 5, None, "auto-link"), ("holy grail", None, "grail", "flag-review"), ("zd", 3, None, "auto-link")], ALIAS)
    cases = {
        ("gold torch", None): (1, "exact", "canonical-exact"), ("gold torch supreme frag", None): (2, "exact", "canonical-prefix"), ("gold torches", None): (1, "fuzzy", "fuzzy-0.71"),
        ("dragon", "zed"): (3, "exact", "canonical-implicit-prefix"), ("dragon frag", "zed"): (3, "exact", "canonical-implicit-prefix"), ("dragon", None): (None, None, None), ("dragon", "acme"): (None, None, None),
        ("bare word", None): (None, None, None), ("big gt special", None): (1, "alias", "alias-hit"), ("an old alias", None): (None, None, None), ("my zd", None): (3, "alias", "alias-hit"),
        ("a holy grail", "zed"): (None, "manual", "cluster:grail"), ("pink lemonad", None): (4, "fuzzy", "fuzzy-0.80"), ("nothing", None): (None, None, None), ("", "zed"): (None, None, None),
    }
    rows = matching.match(spark.createDataFrame(list(cases), "title string, originator_prefix string"), corals, aliases, NOW).collect()
    assert {(r["title"], r["originator_prefix"]): (r["named_coral_id"], r["match_confidence"], r["match_method"]) for r in rows} == cases
    assert all((r["matched_at"] == at(14, 12)) == (r["match_method"] is not None) for r in rows)
    near = spark.createDataFrame([(1, "Pink Lemonade A", "pink lemonade a", "Acme", False, True), (2, "Pink Lemonade B", "pink lemonade b", "Acme", False, True)], CORAL)
    assert matching.match(spark.createDataFrame([("pink lemonade", None)], "title string, originator_prefix string"), near, aliases, NOW).collect()[0]["match_method"] is None
    none = matching.match(spark.createDataFrame([("gold torch", "x")], "title string, originator_prefix string"), corals.where("id < 0"), aliases.where("named_coral_id < 0"), NOW)
    assert none.collect()[0]["named_coral_id"] is None


def test_rematch_window_and_clusters(spark):
    corals, aliases = spark.createDataFrame([(1, "Gold Torch", "gold torch", "Acme", False, True), (2, "Zed Dragon", "zed dragon", "Zed", True, True)], CORAL), spark.createDataFrame([], ALIAS)
    rows = [(1, 1, "gold torch", None, None, at(1), at(13)), (2, 1, "gold torch", None, None, at(1), at(7)), (3, 1, "gold torch", None, "cluster:x", at(1), at(13)), (4, 2, "gold torch", None, None, at(1), at(13)), (5, 1, "gold torch", 9, None, at(1), at(13)), (6, 1, "dragon", None, None, at(2), at(13))]
    listings = spark.createDataFrame(rows, "id long, vendor_id long, title string, named_coral_id long, match_method string, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz")
    shops = spark.createDataFrame([(1, True, "zed"), (2, False, None)], "id long, active boolean, originator_prefix string")
    found = lambda coral: [(r["id"], r["match_method"], r["matched_at"]) for r in matching.rematch(listings, shops, corals, aliases, coral, NOW).collect()]
    assert found(1) == [(1, "canonical-exact", at(1))] and found(2) == [(6, "canonical-implicit-prefix", at(2))]


def test_data_rows(spark):
    price = lambda now, stock=True, prior=None, compare=None: text.field_text(text.price_value(*(F.lit(x).cast("decimal(10,2)") if not isinstance(x, bool) else F.lit(x) for x in (now, stock, prior, compare))))
    ago = lambda then: text.relative_time(F.lit(then).cast("timestamp_ntz"), F.lit("2026-05-14 12:00:00").cast("timestamp_ntz"))
    row = lambda *fields: text.data_row(F.array(*[F.struct(F.lit(k).alias("label"), v.alias("value")) for k, v in fields]))
    cases = {
        "Vendor. World Wide Corals": row(("Vendor", F.lit("World Wide Corals"))), "Price. $80.00 $60.00": row(("Price", price(60, prior=80))), "Price. $100.00 $75.00": row(("Price", price(75, compare=100))),
        "Price. $40.00": row(("Price", price(40, False, 90))), "Listed. 1 minute ago": row(("Listed", ago("2026-05-14 11:59:00"))), "Listed. 2 hours ago": row(("Listed", ago("2026-05-14 10:00:00"))),
        "Back. 1 day ago": row(("Back", ago("2026-05-13 12:00:00"))), "Back. 3 days ago": row(("Back", ago("2026-05-11 12:00:00"))),
        "Price. $80.00 $60.00 — Listed. 1 hour ago — Lineage. Acropora": row(("Price", price(60, prior=80)), ("Listed", ago("2026-05-14 11:00:00")), ("Lineage", F.lit("Acropora"))),
        "Price. price on request": row(("Price", price(None)), ("Back", F.lit(None).cast("string"))),
    }
    got = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cases.values())]).first()
    assert list(got) == list(cases)


def test_cohort_gate(spark):
    schema = "vendor_id long, over boolean, absent_hash string, canary boolean, matcher_errors int, partial boolean, incomplete boolean, seen long, median_seen double"
    sound = (True, "h", False, 0, False, False, 90, 100.0)
    changed = {2: {}, 3: {2: True}, 4: {3: 1}, 5: {4: True}, 6: {5: True}, 7: {6: 79}, 8: {1: None}, 9: {0: False}, 10: {}, 11: {7: None}}
    gate = spark.createDataFrame([(v, *[more.get(i, x) for i, x in enumerate(sound)]) for v, more in changed.items()], schema)
    past = spark.createDataFrame([(v, at(d), d, "other" if (v, d) == (10, 12) else "h") for v in changed for d in (10, 11, 12)], "vendor_id long, started_at timestamp_ntz, id long, absent_hash string")
    got = {r["vendor_id"]: (r["converged"], r["cohort_safe"]) for r in cdc.accept_over_cap(gate, past).collect()}
    assert got == {2: (True, True), 9: (False, True)} | {v: (False, False) for v in (3, 4, 5, 6, 7, 8, 10, 11)}


def test_titles_categories_prices(spark):
    rows = spark.createDataFrame([("JF Homewrecker Ténuis 57xec_a5-041626 $650 in-stock",), ("Gold Torch -  WYSIWYG",), ("SPS frag kit",), ("Oil Spill Plate",), ("Plate rack",), (None,)], "t string")
    got = [(r[0], r[1]) for r in rows.select(text.normalize_title(F.col("t")), text.infer_category(F.lit(None), F.lit(None), F.col("t"))).collect()]
    assert got == [("jf homewrecker tenuis", None), ("gold torch", "lps"), ("sps frag kit", "equipment"), ("oil spill plate", "lps"), ("plate rack", None), (None, None)]
    variants = spark.createDataFrame([([("x", None), ("0.00", "9"), ("12.50", "15.00")],), ([("12.50", "12.00")],), ([],)], "v array<struct<price string, compare_at_price string>>")
    got = [r[0] for r in variants.select(text.coerce_variants(F.col("v"))).collect()]
    assert [(g["price"], g["compare_at"]) for g in got] == [(Decimal("12.50"), Decimal("15.00")), (Decimal("12.50"), None), (None, None)]


def test_product_documents(spark, tmp_path):
    (tmp_path / "page1.json").write_text('{"products":[{"id":1,"title":"WWC Gold Torch $5","handle":"gold","product_type":"LPS","tags":["Coral","Frag-Pack"],"variants":[{"sku":"A-1","available":true,"price":"5.00","compare_at_price":"9.00"}],"images":[{"src":"u"}]},{"id":2,"title":"Shirt","handle":"shirt","product_type":"Merch","tags":[],"variants":[{"sku":"","available":false,"price":"5.00"}]},{"id":3,"title":"Bid","handle":"bid","product_type":"Other","tags":["Auction12"],"variants":[{"sku":"B","available":true,"price":"1.00"}]}]}')
    products = catalogues.read_products(spark, str(tmp_path))
    config = {"product_types": ["LPS"], "no_tags": ["frag pack"]}
    reasons = {r["handle"]: r["why"] for r in products.select("handle", catalogues.keep_reason(config).alias("why")).collect()}
    assert reasons == {"gold": "tag-denied", "shirt": "unavailable", "bid": "product-type"}
    assert products.where(catalogues.keep_reason({"no_sku_ends": ["A"]}).isNull()).select("handle").collect()[0][0] == "bid"
    got = {r["product_url"]: r for r in catalogues.to_listings(products, "https://x/", ("auction1",)).collect()}
    assert got["https://x/products/gold"]["compare_at_price"] == Decimal("9.00") and got["https://x/products/gold"]["category"] == "lps" and got["https://x/products/gold"]["lineage_flag"] == "vendor-named"
    assert got["https://x/products/bid"]["is_auction"] and got["https://x/products/bid"]["current_price"] is None
    assert not got["https://x/products/shirt"]["in_stock"] and got["https://x/products/shirt"]["vendor_sku"] is None
    with pytest.raises(ValueError):
        catalogues.keep_reason({"tags": [" "]})


def test_product_cards(spark):
    html = '<ul><li class="product"><article data-name="Gold" data-product-price="$5" data-entity-id="7"><a class="card-figure__link" href="/gold"></a><img class="card-image" src="i"></article></li></ul>'
    pages = spark.createDataFrame([("a", html), ("b", html), ("c", "<p data-no-products-notification></p>"), ("d", None)], "path string, html string")
    cards = catalogues.first_wins(catalogues.parse_cards(pages)).collect()
    assert [(c["path"], c["raw_title"], c["product_url"], c["image_url"]) for c in cards] == [("a", "Gold", "/gold", "i")]
    s = {r["path"]: r for r in catalogues.skeleton_hashes(pages).collect()}
    assert s["a"]["skeleton_hash"] == s["b"]["skeleton_hash"] != s["c"]["skeleton_hash"] and s["c"]["empty"] and s["d"]["tags"] == 0


def test_quantiles_occur_in_the_data(spark):
    rows = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4)], "k string, v double")
    row = health.nearest_rank(rows, ["k"], "v", (0.5, 0.9)).collect()[0]
    assert (row["p50"], row["p90"]) == (3.0, 4.0)
    assert health.nearest_rank(rows, ["k"], "v", (0.5,), half_even=False).collect()[0]["p50"] == 3.0


def test_carousel_spreads_vendors(spark):
    schema = "listing_id long, named_coral_id long, vendor_slug string, event_at timestamp_ntz, event string, current_price double"
    rows = spark.createDataFrame([(1, 7, "v1", at(14), "just-listed", 5.0), (2, 8, "v1", at(13), "back-in-stock", 5.0), (3, 5, "v2", at(12), "just-listed", 5.0), (4, 5, "v3", at(11), "just-listed", 5.0), (5, None, "v4", at(14), "just-listed", 5.0), (6, 9, "v4", at(14), "just-listed", None), (7, 9, "v4", at(14), "price-dropped", 5.0)], schema)
    assert [(r["listing_id"], r["total"]) for r in ranking.carousel(rows).collect()] == [(1, 6), (3, 6), (2, 6)]
    assert [tuple(r) for r in ranking.composition(rows).collect()] == [(6, "mixed")]
