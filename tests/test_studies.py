"""Studies, audits, rules, crawls, digests and charts: small cases with known answers, and loops where Spark has windows."""

import random
import re
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from test_scenarios import HISTORY, LISTING, NOW, RUN, at, listing

from tidemark.functions import chart, text
from tidemark.operators import market, studies
from tidemark.sources import catalogues


def log(spark, *rows):
    return spark.createDataFrame([(n, i, Decimal(9), s, t) for n, (i, s, t) in enumerate(rows, 1)], HISTORY)


def test_fast_goings(spark):
    rows = spark.createDataFrame([listing(1, coral=7, stock=False), listing(2), listing(3, coral=7), listing(4, coral=7), listing(5, coral=7), listing(6, coral=7), listing(7, 2, coral=7)], LISTING)
    history = log(
        spark, (1, True, at(3)), (1, False, at(3, 9)), (2, True, at(3)), (2, False, at(4)), (2, True, at(5)), (3, True, at(3)), (3, False, at(4, 0, 1)), (4, False, at(1)), (4, True, at(12)), (5, True, at(10, 9)), (6, True, at(11)), (6, False, at(11, 5)), (7, True, at(3, 10)), (1, False, at(3, 9))
    )
    runs = spark.createDataFrame([(1, 1, at(3, 9), at(3, 10), "success"), (2, 1, at(3, 8), at(3, 8), "success"), (3, 1, at(3, 9), None, "failed"), (4, 2, at(1), at(1), "success"), (5, 1, at(10, 1), at(10, 1), "success")], RUN)
    found = {r["listing_id"]: (r["first_oos_at"], r["relisted"], r["coral_reappeared"], r["run_id"]) for r in studies.fast_goings(history, rows, runs).collect()}
    # 3 went after 24 hours and a minute; 5 came exactly a week after 1 went; 4, first in stock on the 12th, is within a week of 6; 2 has no name and is in stock again
    assert found == {1: (at(3, 9), False, True, 3), 2: (at(4), True, None, 3), 6: (at(11, 5), False, True, 5)}
    assert {r["listing_id"]: r["transitions"] for r in studies.churn(history, rows).collect()} == {1: 1, 2: 2, 3: 1, 4: 1, 5: 0, 6: 1, 7: 0}
    assert {(r["vendor_id"], r["run_id"]): r["size"] for r in studies.going_clusters(history, rows, runs).collect()} == {(1, 3): 3, (1, 5): 1}


def test_verdict_of_a_vendor(spark):
    fast = "listing_id long, vendor_id long, first_oos_at timestamp_ntz, relisted boolean, coral_reappeared boolean, run_id long"
    rows = [(i, 1, at(1), False, False, i) for i in range(10)] + [(20, 1, at(13), True, True, 20)] + [(30 + i, 2, at(1), i == 0, None, 40) for i in range(10)]
    clusters = spark.createDataFrame([(1, i, 1) for i in range(10)] + [(1, 20, 11), (2, 40, 12)], "vendor_id long, run_id long, size long")
    changes = spark.createDataFrame([(v, i, i % 3) for v in (1, 2, 3) for i in range(12)], "vendor_id long, listing_id long, transitions long")
    newest = spark.createDataFrame([(datetime(2026, 6, 14),)], "at timestamp_ntz")
    got = {r["vendor_id"]: r for r in studies.going_verdicts(spark.createDataFrame(rows, fast), changes, clusters, newest).collect()}
    assert (got[1]["verdict"], got[1]["fast"], got[1]["relisted"], got[1]["fair"], got[1]["relist_rate"], got[1]["isolated"], got[1]["bulk"], got[1]["biggest_pass"]) == ("ship", 11, 1, 10, 0.0, 10, 1, 1)
    assert (got[2]["verdict"], got[2]["relist_rate"], got[2]["isolated_share"], got[2]["passes"], got[2]["biggest_share"], got[2]["cluster_median"]) == ("hold", 0.1, 0.0, 1, 1.0, 12)
    assert (got[3]["verdict"], got[3]["fast"], got[3]["churn_median"], got[3]["churn_p90"]) == ("none", 0, 1, 2)


def test_the_automaton_finds_what_pairs_of_texts_and_terms_show(spark):
    rng = random.Random(12)
    some = lambda n: "".join(rng.choice("ab -É") for _ in range(n))
    rows = [(i, i % 3, rng.choice([None, some(rng.randrange(12)), some(9).upper()])) for i in range(300)]
    terms = [(rng.choice([None, 0, 1, 2]), rng.choice(["contains", "prefix", "exact"]), some(rng.randrange(1, 5))) for _ in range(60)] + [(None, "contains", ""), (None, "contains", None)]
    want = set()
    for i, vendor, title in rows:
        for of, axis, term in terms:
            if title is not None and term and (of is None or of == vendor):
                low, t = title.lower(), term.lower()
                hit = {"contains": t in low, "prefix": low.startswith(t), "exact": bool(t.strip()) and low.strip() == t.strip()}[axis]
                if hit:
                    want.add((i, term, axis))
    table, held = spark.createDataFrame(rows, "id long, vendor_id long, raw_title string"), spark.createDataFrame(terms, "vendor_id long, axis string, term string")
    assert {tuple(r) for r in studies.term_hits(table, held).collect()} == want
    assert studies.term_hits(table, held.where("term = 'none'")).collect() == []


def test_false_kills_name_the_term(spark):
    rows = spark.createDataFrame([(1, 1, "WS - Torch"), (2, 1, "Torch WS - x"), (3, 1, "Old thing"), (4, 2, "ws - other"), (5, 1, "Frag $10 pack")], "id long, vendor_id long, raw_title string")
    old = spark.createDataFrame([(1, "contains", "old")], "vendor_id long, axis string, term string")
    new = old.unionByName(spark.createDataFrame([(1, "prefix", "WS - "), (1, "contains", "$10")], old.schema))
    assert {(r["id"], r["terms"]) for r in studies.false_kills(rows, old, new).collect()} == {(1, "prefix:WS - "), (5, "contains:$10")}
    assert {r["id"] for r in studies.within_only(rows, spark.createDataFrame([(1, "WS - ")], "vendor_id long, term string")).collect()} == {2}
    assert {r["id"] for r in studies.collisions(rows, spark.createDataFrame([(1, "torch", 1)], "vendor_id long, term string, id long")).collect()} == {2}


def test_a_repair_stops_unless_its_ids_are_the_expected_ones(spark):
    rows = spark.createDataFrame([listing(1), listing(2), listing(3, 2)], LISTING)
    ids = lambda *xs: spark.createDataFrame(xs, "vendor_id long, id long")
    runs = spark.createDataFrame([(1, 1, at(1), at(1), "failed"), (2, 1, at(2), at(2), "success"), (3, 2, at(2), at(2), "success"), (4, 2, at(3), None, "failed")], RUN)
    after, gained = studies.stock_bridge(rows, ids((1, 1), (1, 2)), ids((1, 2), (1, 1)), runs)
    assert {r["id"]: r["in_stock"] for r in after.collect()} == {1: False, 2: False, 3: True}
    assert {tuple(r) for r in gained.collect()} == {(1, Decimal("50.00"), False, 2), (2, Decimal("50.00"), False, 2)}
    for derived, expected, why in (([(1, 1)], [(1, 1), (1, 2)], "unexpected 0, absent 1"), ([(1, 1), (1, 2)], [(1, 1)], "unexpected 1, absent 0"), ([(2, 3)], [(2, 3)], "latest run not successful")):
        for part in studies.stock_bridge(rows, ids(*derived), ids(*expected), runs):
            with pytest.raises(Exception, match=why):
                part.collect()


def test_review_samples_can_be_merged(spark):
    rows = spark.createDataFrame([listing(i, 1 + i % 2, price=None if i == 4 else str(100 - i)) for i in range(60)], LISTING)
    whole = studies.review_sample(rows, F.lit(False), "s").collect()
    assert {r["id"] for r in whole if r["vendor_id"] == 1 and r["dear"]} == {0, 2, 6, 8, 10} and len([r for r in whole if r["drawn"]]) == 10
    parts = rows.where("id < 30"), rows.where("id >= 30")
    drawn = {r["id"] for p in parts for r in studies.review_sample(p, F.lit(False), "s", 0).collect()}
    merged = studies.review_sample(rows.where(F.col("id").isin(*drawn)), F.lit(False), "s", 0)
    assert {r["id"] for r in merged.collect()} == {r["id"] for r in whole if r["drawn"]}
    assert studies.review_sample(rows, F.col("vendor_id") == 2, "s").where("vendor_id = 2").count() == 30


def test_surfaces_that_differ(spark):
    one, two = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "k string, n long"), spark.createDataFrame([("a", 1), ("b", 3), ("d", 4), ("c", None)], "k string, n long")
    assert {tuple(r) for r in studies.reconcile(one, two, ["k"], "n").collect()} == {("b", 2, 3), ("d", None, 4)}
    assert {r["k"] for r in studies.reconcile(one, two, ["k"], "n", 1.0).collect()} == {"c", "d"}


def test_crawl_takes_pages_until_the_first_end(spark):
    schema = "vendor_id long, path string, page int, status int, error string, cards int, empty boolean"
    page = lambda path, n, cards=5, status=200, error=None, empty=False, vendor=1: (vendor, path, n, status, error, cards, empty)
    rows = [page("a", 1), page("a", 2), page("a", 3, 0), page("a", 4), page("b", 1, 0, empty=True), page("b", 2), page("c", 1), page("c", 2, None, 404), page("c", 3), page("d", 1, 0), page("e", 1), page("e", 2, None, 503, "http_5xx"), page("f", 1, None, 404), page("g", 1, empty=True)]
    got = {r["path"]: (r["pages"], r["n"], r["marked_empty"], r["missing"], r["end"]) for r in catalogues.crawl(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"a": (3, 10, False, False, "no-cards"), "b": (1, 0, True, False, "no-cards"), "c": (1, 5, False, False, "not-found"), "d": (1, 0, False, False, "no-cards"), "e": (1, 5, False, False, "failed"), "f": (0, 0, False, True, "not-found"), "g": (1, 5, False, False, None)}
    silent = lambda vendor, paths, none: [page(f"p{k}", 1, 0 if k < none else 4, vendor=vendor) for k in range(paths)]
    rows = silent(1, 3, 2) + silent(2, 3, 3) + silent(3, 21, 5) + silent(4, 21, 6) + silent(5, 4, 0) + silent(6, 13, 3) + [page("x", 1, None, 404, vendor=7), page("y", 1, vendor=7), page("x", 1, None, 403, "block", vendor=8), page("x", 1, None, 503, "http_5xx", vendor=9), page("x", 1, 0, empty=True, vendor=10)]
    verdicts = {r["vendor_id"]: r["verdict"] for r in catalogues.schema_change(catalogues.crawl(spark.createDataFrame(rows, schema))).collect()}
    assert verdicts == {1: "partial", 2: "html_schema_change", 3: "partial", 4: "html_schema_change", 5: "ok", 6: "html_schema_change", 7: "html_schema_change", 8: "block", 9: "fetch", 10: "html_schema_change"}


def test_rules_as_rows_judge_as_one_config_does(spark):
    rng, axes = random.Random(5), {"product_types": ["LPS", "", "SPS"], "tags": ["coral", "Live"], "no_tags": ["frag-pack", "Dry goods"], "no_title_parts": ["shirt", "ARID "], "no_title_starts": ["WS - "], "no_titles": ["gift card"], "no_sku_ends": ["-x", "A"]}
    products = [(i, rng.choice([None, "Gold Torch", "T-Shirt", "ws - thing", "Gift Card ", "an arid one", "arid"]), rng.choice([None, "", "LPS", "Other"]), rng.choice([None, [], ["Coral"], ["live", "Frag Pack"], ["Auction"], ["dry  goods"]]), rng.choice([None, [("k-x", True, None, None)], [("B", True, None, None), (None, False, None, None)], [("kA-2", True, None, None)]])) for i in range(80)]
    schema = "id long, title string, product_type string, tags array<string>, variants array<struct<sku string, available boolean, price string, compare_at_price string>>"
    rows = spark.createDataFrame(products, schema)
    for trial in range(3):
        config = {a: rng.sample(v, rng.randrange(1, len(v) + 1)) for a, v in axes.items() if rng.random() < 0.5}
        rules = spark.createDataFrame([(trial, a, e) for a, entries in config.items() for e in entries], "vendor_id long, axis string, entry string")
        want = {r["id"]: r["why"] for r in rows.select("id", catalogues.keep_reason(config).alias("why")).collect()}
        assert {r["id"]: r["why"] for r in catalogues.keep_reasons(rows.withColumn("vendor_id", F.lit(trial).cast("long")), rules).collect()} == want
    assert {r["why"] for r in catalogues.keep_reasons(rows.withColumn("vendor_id", F.lit(99).cast("long")), rules).collect()} == {None, "unavailable"}


def test_configs_that_cannot_match_are_refused():
    for config in ({"colour": ["red"]}, {"no_tags": "frag"}, {"no_tags": [" - "]}, {"tags": [" coral"]}, {"tags": [""]}, {"product_types": [" "]}, {"no_titles": [3]}, {"no_title_starts": ["  "]}):
        with pytest.raises(ValueError):
            catalogues.validate_axes(config)
    assert catalogues.validate_axes({"product_types": ["", " LPS"], "no_title_parts": ["ARID "], "tags": None, "no_tags": []}) == {"product_types": ["", " LPS"], "no_title_parts": ["ARID "]}


def test_digest_budget_is_what_the_loop_leaves(spark):
    """Blocks collapse from the quietest on until the text fits, as a loop over them does; marks in titles are escaped; 😀 counts twice."""
    rng = random.Random(9)
    schema = "listing_id long, display_name string, event string, precedence int, event_at timestamp_ntz, first_seen_at timestamp_ntz, raw_title string, product_url string, current_price decimal(10,2), prior_price decimal(10,2), compare_at_price decimal(10,2), category string, bulk_cluster boolean"
    for trial in range(3):
        rows = []
        for i in range(rng.randrange(1, 120)):
            kind = rng.randrange(1, 4)
            rows.append((i, rng.choice("abcdefgh") * 3, {1: "price-dropped", 2: "back-in-stock", 3: "just-listed"}[kind], kind, datetime(2026, 6, 14) - timedelta(hours=rng.randrange(90)), None, rng.choice(["Gold [WYSIWYG]", "a*b_c~d`e|f\\g", "😀 coral"]), rng.choice(["https://x/1", "http://x", None]), rng.choice([None, Decimal(50)]), rng.choice([None, Decimal(80)]), rng.choice([None, Decimal(60)]), rng.choice(["lps", "lps", "equipment"]), rng.random() < 0.1))
        table, before = spark.createDataFrame(rows, schema), "intro 😀\n\n"
        whole = {r["display_name"]: r for r in market.digest_blocks(table, NOW, "site", budget=10**9).collect()}
        short = {r["display_name"]: r for r in market.digest_blocks(table, NOW, "site", budget=0).collect()}
        order = sorted(whole, key=lambda v: whole[v]["place"])
        assert [v for v in order] == sorted(whole, key=lambda v: (-whole[v]["n"], v)) and all(r["collapsed"] for r in short.values())
        size = lambda t: len(t.encode("utf-16-le")) // 2
        for budget in (300, 900, 2000, 4096):
            blocks = [whole[v]["block"] for v in order]
            for k in range(len(order) - 1, -1, -1):
                if size(before + "\n\n".join(blocks)) <= budget:
                    break
                blocks[k] = short[order[k]]["block"]
            got = market.digest_blocks(table, NOW, "site", budget=budget, before=before)
            assert [r["block"] for r in got.orderBy("place").collect()] == blocks
            text_ = market.digest_text(got, budget, before).collect()[0]["text"]
            assert text_ == (t if size(t := before + "\n\n".join(blocks)) <= budget else t[: budget - 1] + "…")
        assert any("\\[WYSIWYG\\]" in r["block"] or "\\*" in r["block"] or "😀" in r["block"] for r in whole.values())
    assert market.digest_text(market.digest_blocks(table.where("listing_id < 0"), NOW, "site"), before="none").collect()[0]["text"] == "none"


def test_digest_sums_grow_with_the_vendors(spark):
    """No frame ends with its partition after beginning at a row, which Spark sums anew for each; of blocks that begin beyond the budget none is gathered."""
    schema = "listing_id long, display_name string, event string, precedence int, event_at timestamp_ntz, first_seen_at timestamp_ntz, raw_title string, product_url string, current_price decimal(10,2), prior_price decimal(10,2), compare_at_price decimal(10,2), category string, bulk_cluster boolean"
    blocks = market.digest_blocks(spark.createDataFrame([], schema), NOW, "site")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"RowFrame, (?!unboundedpreceding)[^,]*, unboundedfollowing", plan(blocks))
    text_ = market.digest_text(spark.range(1, 2_001).selectExpr("cast(id as int) as place", "'b' as block"), 9, "😀")
    assert text_.collect()[0]["text"] == "😀b\n\nb\n\nb…" and "<= 9)" in plan(text_)


def test_url_components(spark):
    got = spark.createDataFrame([("Az09-_.!~*'()",), ("a b+c/d=é&?",), ("",), (None,)], "t string").select(text.url_component(F.col("t"))).collect()
    assert [r[0] for r in got] == ["Az09-_.!~*'()", "a%20b%2Bc%2Fd%3D%C3%A9%26%3F", "", None]


def test_markdown_escape(spark):
    got = spark.createDataFrame([(r"a*b_c~d`e|f\g[h](i)",)], "t string").select(text.markdown_escape(F.col("t"))).first()[0]
    assert got == r"a\*b\_c\~d\`e\|f\\g\[h\](i)"


def test_end_labels_are_what_the_two_loops_give(spark):
    rng = random.Random(4)
    rows = [(c, f"l{i}", round(rng.uniform(20, 305), 2)) for c in range(20) for i in range(rng.randrange(1, 20))]
    got = {(r["c"], r["label"]): r["placed"] for r in chart.end_labels(spark.createDataFrame(rows, "c int, label string, y double"), ["c"]).collect()}
    for c in range(20):
        mine = sorted([y, label] for k, label, y in rows if k == c)
        for i in range(1, len(mine)):
            mine[i][0] = max(mine[i][0], mine[i - 1][0] + chart.LABEL_GAP)
        for i in range(len(mine) - 1, -1, -1):
            mine[i][0] = min(mine[i][0], chart.AXIS_Y)
            if i < len(mine) - 1:
                mine[i][0] = min(mine[i][0], mine[i + 1][0] - chart.LABEL_GAP)
        assert all(abs(got[c, label] - y) < 0.006 for y, label in mine)


def test_axes_of_few_prices(spark):
    rows = spark.createDataFrame([(1, 50.0), (2, 0.0), (3, 10.0), (3, 12.0), (4, 5.0), (4, 995.0)], "k int, price double")
    got = {r["k"]: (round(r["y_min"], 4), round(r["y_max"], 4), r["ticks"]) for r in chart.price_axis(rows, ["k"]).collect()}
    assert got == {1: (45.0, 55.0, [46.0, 48.0, 50.0, 52.0, 54.0]), 2: (-1.0, 1.0, [-1.0, -0.5, 0.0, 0.5, 1.0]), 3: (9.88, 12.12, [10.0, 10.5, 11.0, 11.5, 12.0]), 4: (-54.4, 1054.4, [0.0, 200.0, 400.0, 600.0, 800.0, 1000.0])}
    days = spark.createDataFrame([(1, datetime(2026, 6, 14).date()), (2, datetime(2026, 5, 1).date()), (3, datetime(2025, 1, 1).date()), (4, datetime(2026, 6, 15).date())], "k int, day date")
    got = {r["k"]: r["labels"] for r in chart.time_axis(days, ["k"], F.lit("2026-06-15 00:00:00")).collect()}
    assert got[1] == ["JUN 14", "JUN 14", "JUN 14", "JUN 15"] == got[4] and len(got[2]) == 5 and got[3][0] == "JAN '25" and len(got[3]) == 7


def test_prices_that_cards_state(spark):
    texts = {"$5": "5.00", " $1,234.50 ": "1234.50", ".5": "0.50", "NaN": None, "Infinity": None, "5 USD": None, "": None, "99999999999.99": None, "100000000": None, "-3": "-3.00", None: None}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", catalogues.price_of_text(F.col("t")).alias("p")).collect()
    assert {r["t"]: None if r["p"] is None else str(r["p"]) for r in rows} == texts
    html = '<article data-name="A" data-product-price="$10" data-entity-id="1"><span class="price price--non-sale"> $1<b>2</b>.50 </span>$9</article><article data-name="B" data-product-price="$10" data-entity-id="2"><s class="price--non-sale">$10</s></article><article data-name="C" data-entity-id="3"><s class="price--non-sale">$10</s></article>'
    got = catalogues.card_prices(catalogues.parse_cards(spark.createDataFrame([("p", html)], "path string, html string"))).collect()
    assert {r["vendor_sku"]: (r["current_price"], r["compare_at_price"]) for r in got} == {"1": (Decimal("10.00"), Decimal("12.50")), "2": (Decimal("10.00"), None), "3": (None, None)}


def test_guide_headings(spark):
    files = [("/g/old-one.mdx", "---\ntitle: Old one\nupdated: 2024-01-05\n---\nBody --- here\n---\n"), ("/g/new.mdx", "---\r\nupdated: '2025-02-03T00:00:00Z'\r\nkind: CARE\r\ndescription: \r\n---\r\nx"), ("/g/bare.mdx", "no heading"), ("/g/Bad_name.mdx", "---\n---\n"), ("/g/readme.md", "")]
    got = [tuple(r) for r in market.guides_of(spark.createDataFrame(files, "path string, content string")).collect()]
    assert got == [("new", "CARE", "new", "2025-02-03", None, "x"), ("old-one", "GUIDE", "Old one", "2024-01-05", None, "Body --- here\n---\n"), ("bare", "GUIDE", "bare", "", None, "no heading")]


def test_classes_of_fetches(spark):
    wall = "<title>Access denied</title>"
    cases = [(None, None, "network"), (200, "fine", None), (200, wall, "block"), (200, "x" * 5000 + wall, None), (403, wall, "block"), (403, "no", "other"), (429, wall, "http_429"), (503, wall, "http_5xx"), (404, wall, "other"), (204, wall, "other"), (301, "", "other"), (200, None, None)]
    rows = spark.createDataFrame([(i, s, b) for i, (s, b, _) in enumerate(cases)], "i int, s int, b string")
    assert [r[0] for r in rows.orderBy("i").select(catalogues.fetch_error(F.col("s"), F.col("b"))).collect()] == [c for *_, c in cases]


def test_fields_of_a_coral(spark):
    """A price of 0 is the cheapest on the page, not in a text; tied vendors newest first; labels where there are any; a coral without offers still has its own line."""
    rows = spark.createDataFrame([listing(1, 1, 1, "0.00", first=at(13)), listing(2, 2, 1, "5.00", first=at(12)), listing(3, 3, 1, "5.00", first=at(13, 6)), listing(4, 1, 1, None), listing(5, 1, 2, stock=False), *[listing(10 + v, v, 3, "7.00", first=at(v)) for v in range(1, 6)]], LISTING)
    shops = spark.createDataFrame([(v, f"s{v}", f"Shop {v}") for v in range(1, 6)], "id long, slug string, display_name string")
    corals = spark.createDataFrame([(1, "WWC", "sps"), (2, "", None), (3, "ORA", "Acropora tenuis")], "id long, origin_vendor string, coral_type string")
    labels = spark.createDataFrame([("s3", "S3")], "slug string, label string")
    got = {r["named_coral_id"]: (r["reference"], r["summary"], r["lineage"]) for r in market.reference_fields(rows, shops, corals, NOW, labels).collect()}
    assert got[1] == ("Cheapest now. $5.00 — Vendor. S3, Shop 2 — First seen. Jun 2026", "Price. $0.00 — Vendor. Shop 1 — Lineage. World Wide Corals — Listed. 1 day ago", "Type. SPS — Origin. World Wide Corals")
    assert got[2] == ("", "", "")
    assert got[3][1].startswith("Price. $7.00 — Vendor. Shop 5, Shop 4, S3 +2 — Lineage. ORA — Listed. Jun 5"[:50]) and got[3][2] == "Type. Acropora tenuis — Origin. ORA"
