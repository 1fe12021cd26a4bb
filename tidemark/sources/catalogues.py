"""Vendor catalogues: product documents as JSON, product cards as HTML, and the filter that keeps some of them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import PRICE_CEILING, coerce_variants, infer_category, lineage_flag, normal_tag, normalize_title, sku_ends_with

#: Every field may be missing.
PRODUCTS = """products array<struct<id bigint, title string, handle string, product_type string, tags array<string>,
  variants array<struct<sku string, available boolean, price string, compare_at_price string>>, images array<struct<src string>>>>"""
#: Tags of an auction where a vendor states none.
AUCTION_TAGS = ("auction", "auctions")
AXES = {"product_types", "tags", "no_tags", "no_title_parts", "no_title_starts", "no_titles", "no_sku_ends", "auction_tags"}


def read_products(spark: SparkSession, path: str) -> DataFrame:
    """One row for each product of the JSON pages under a path."""
    return spark.read.schema(PRODUCTS).json(path, multiLine=True).select(F.input_file_name().alias("page"), F.explode("products").alias("p")).select("page", "p.*")


def schema_sentinel(json: Column) -> Column:
    """SHA-256 of the sorted keys of a page's first product: it changes when the vendor's document does."""
    first = F.get_json_object(json, "$.products[0]")
    return F.sha2(F.array_join(F.array_sort(F.json_object_keys(first)), ","), 256)


def _never(axis: str, x: str) -> bool:
    """Whether an entry could never match, or would always: the axes compare differently."""
    if axis == "product_types":
        return x != "" and not x.strip()
    if axis == "tags":
        return not x or x != x.strip()
    return not (x.replace("-", " ") if axis == "no_tags" else x).strip()


def validate_axes(config: dict) -> dict:
    """The filter's axes without unset ones (null): each a list of texts that can match. filter_rules() says the same of a table of filters."""
    for axis, entries in config.items():
        if axis not in AXES:
            raise ValueError(f"config: no such axis: {axis}")
        if entries is not None and (not isinstance(entries, list) or not all(isinstance(x, str) and not _never(axis, x) for x in entries)):
            raise ValueError(f"config: {axis} is a list of texts that match something, but not everything")
    return {axis: entries for axis, entries in config.items() if entries}


def keep_reason(config: dict, available_only: bool = True, auction_tags: tuple[str, ...] | None = None) -> Column:
    """Why a product (title, product_type, tags, variants) goes, null if it stays. All axes must pass; one that isn't set passes. Auctions (by the vendor's tags, if it states any) pass the allow-lists."""
    c = validate_axes(config)
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    plain_tags, title = F.transform(tags, normal_tag), F.lower(F.coalesce("title", F.lit("")))
    lits = lambda xs: F.array(*[F.lit(x) for x in xs])
    out = F.when(~F.exists(F.coalesce("variants", F.expr("array()").cast("array<struct<sku:string,available:boolean,price:string,compare_at_price:string>>")), lambda v: F.coalesce(v["available"], F.lit(False))), "unavailable") if available_only else F.when(F.lit(False), "")
    auction = is_auction(auction_tags) if auction_tags is None or auction_tags else F.lit(False)
    if "product_types" in c:
        out = out.when(~auction & ~F.coalesce(F.col("product_type").isin(*c["product_types"]), F.lit(False)), "product-type")
    if "tags" in c:
        out = out.when(~auction & ~F.arrays_overlap(F.transform(tags, F.lower), lits([x.lower() for x in c["tags"]])), "tag-missing")
    if "no_tags" in c:
        out = out.when(F.arrays_overlap(plain_tags, F.transform(lits(c["no_tags"]), normal_tag)), "tag-denied")
    for axis, test in (("no_title_parts", title.contains), ("no_title_starts", title.startswith), ("no_titles", lambda x: F.trim(title) == x.strip())):
        for x in c.get(axis, ()):
            out = out.when(test(x.lower()), axis)
    for x in c.get("no_sku_ends", ()):
        out = out.when(_has_sku_end(x), "sku-denied")
    return out


def _has_sku_end(suffix: str) -> Column:
    return F.coalesce(F.exists("variants", lambda v: F.coalesce(sku_ends_with(v["sku"], suffix), F.lit(False))), F.lit(False))


def is_auction(auction_tags: tuple[str, ...] | None = None) -> Column:
    """By the vendor's tags, spelled in any case; where one of them is a numbered round (auction3), also by the tags of all other rounds."""
    wanted = [t.lower().replace("-", " ").strip() for t in (AUCTION_TAGS if auction_tags is None else auction_tags)]
    raw = F.coalesce("tags", F.array().cast("array<string>"))
    out = F.arrays_overlap(F.transform(raw, normal_tag), F.array(*map(F.lit, wanted)))
    rounds = any(t.startswith("auction") and t[7:].isdigit() for t in wanted)
    return out | F.exists(raw, lambda t: F.lower(F.trim(t)).rlike(r"^auctions?$|^auction\d+$")) if rounds else out


def filter_rules(configs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every vendor's filter as rows, from configs(vendor_id, filter), a JSON text: rules(vendor_id, axis, entry) and what is wrong with them, errors(vendor_id, axis, entry, problem).

    A missing filter, an axis that is null and an empty list are no rules. An axis that isn't known or isn't a list, an entry that isn't a text, and one that its axis could never match, or
    would always, are errors: blank ones everywhere but an empty product type, and white space at the ends of an allowed tag.
    """
    whole = configs.where("filter is not null").select("vendor_id", F.try_parse_json("filter").alias("v"))
    kind = F.schema_of_variant("v")
    bad = whole.where(F.col("v").isNull() | ~kind.startswith("OBJECT")).select("vendor_id", F.lit(None).cast("string").alias("axis"), F.lit(None).cast("string").alias("entry"), F.lit("not a mapping of axes").alias("problem"))
    axes = whole.where(F.col("v").isNotNull() & kind.startswith("OBJECT")).select("vendor_id", F.expr("cast(v as map<string, variant>)").alias("m")).select("vendor_id", F.explode("m").alias("axis", "v"))
    axes = axes.where(F.col("v").isNotNull() & ~F.is_variant_null("v"))
    text = F.expr("to_json(v)")
    known, listed = F.col("axis").isin(*AXES), kind.startswith("ARRAY")
    bad = bad.unionByName(axes.where(~known | ~listed).select("vendor_id", "axis", text.alias("entry"), F.when(~known, "no such axis").otherwise("not a list").alias("problem")))
    entries = axes.where(known & listed).select("vendor_id", "axis", F.explode(F.expr("cast(v as array<variant>)")).alias("v"))
    is_text = F.coalesce(kind.isin("STRING") & ~F.is_variant_null("v"), F.lit(False))
    entry = F.when(is_text, F.expr("try_variant_get(v, '$', 'string')"))
    rows = entries.select("vendor_id", "axis", is_text.alias("is_text"), F.when(is_text, entry).otherwise(text).alias("entry"))
    blank = F.trim(F.regexp_replace("entry", r"\s+", " ")) == ""
    never = F.when(F.col("axis") == "product_types", blank & (F.col("entry") != "")).when(F.col("axis") == "tags", blank | F.col("entry").rlike(r"^\s|\s$")).when(F.col("axis") == "no_tags", normal_tag(F.col("entry")) == "").otherwise(blank)
    rows = rows.withColumn("problem", F.when(~F.col("is_text"), "not a text").when(never, "matches nothing or everything"))
    return rows.where("problem is null").select("vendor_id", "axis", "entry"), bad.unionByName(rows.where("problem is not null").select("vendor_id", "axis", "entry", "problem"))


def keep_reasons(products: DataFrame, rules: DataFrame, available_only: bool = True) -> DataFrame:
    """The products(vendor_id, title, product_type, tags, variants, ...) of all vendors with `why` each goes by its own vendor's rules(vendor_id, axis, entry), null if it stays.

    The axes and their order are those of keep_reason(), with auction_tags as one more that only says which tags make an auction; a vendor without rules keeps what is available. A vendor's
    rules are few and meet its products as one row.
    """
    per = rules.groupBy("vendor_id", "axis").agg(F.collect_set("entry").alias("entries")).groupBy("vendor_id").agg(F.map_from_entries(F.collect_list(F.struct("axis", "entries"))).alias("_rules"))
    rows = products.join(per, "vendor_id", "left")
    own = lambda axis: F.try_element_at("_rules", F.lit(axis))
    each = lambda axis, test: F.coalesce(F.exists(own(axis), test), F.lit(False))
    raw = F.coalesce("tags", F.array().cast("array<string>"))
    title = F.lower(F.coalesce("title", F.lit("")))
    wanted = F.transform(F.coalesce(own("auction_tags"), F.array(*map(F.lit, AUCTION_TAGS))), lambda t: F.trim(F.replace(F.lower(t), F.lit("-"), F.lit(" "))))
    rounds = F.exists(wanted, lambda t: t.rlike(r"^auction\d+$"))
    auction = F.arrays_overlap(F.transform(raw, normal_tag), wanted) | rounds & F.exists(raw, lambda t: F.lower(F.trim(t)).rlike(r"^auctions?$|^auction\d+$"))
    auction = F.coalesce(auction, F.lit(False))
    available = F.coalesce(F.exists("variants", lambda v: F.coalesce(v["available"], F.lit(False))), F.lit(False))
    allowed = lambda axis, test: own(axis).isNotNull() & ~auction & ~F.coalesce(test, F.lit(False))
    why = F.when(~available, "unavailable") if available_only else F.when(F.lit(False), "")
    why = why.when(allowed("product_types", F.array_contains(own("product_types"), F.col("product_type"))), "product-type")
    why = why.when(allowed("tags", F.arrays_overlap(F.transform(raw, F.lower), F.transform(own("tags"), F.lower))), "tag-missing")
    why = why.when(F.coalesce(F.arrays_overlap(F.transform(raw, normal_tag), F.transform(own("no_tags"), normal_tag)), F.lit(False)), "tag-denied")
    why = why.when(each("no_title_parts", lambda e: title.contains(F.lower(e))), "no_title_parts").when(each("no_title_starts", lambda e: title.startswith(F.lower(e))), "no_title_starts")
    why = why.when(each("no_titles", lambda e: F.trim(title) == F.lower(F.trim(e))), "no_titles")
    skus = F.coalesce(F.transform("variants", lambda v: v["sku"]), F.array().cast("array<string>"))
    why = why.when(each("no_sku_ends", lambda e: F.exists(skus, lambda k: F.coalesce(sku_ends_with(k, e), F.lit(False)))), "sku-denied")
    return rows.withColumn("why", why).drop("_rules")


def to_listings(products: DataFrame, base_url: str, auction_tags: tuple[str, ...] | None = None) -> DataFrame:
    """(product_url, raw_title, normalized_title, current_price, compare_at_price, in_stock, vendor_sku, image_url, category, lineage_flag, is_auction); auctions have no price."""
    price = coerce_variants(F.col("variants"))
    auction = is_auction(auction_tags)
    return products.select(
        F.concat(F.lit(base_url.rstrip("/") + "/products/"), "handle").alias("product_url"),
        F.col("title").alias("raw_title"),
        normalize_title(F.col("title")).alias("normalized_title"),
        F.when(~auction, price["price"]).alias("current_price"),
        F.when(~auction, price["compare_at"]).alias("compare_at_price"),
        F.coalesce(F.exists("variants", lambda v: F.coalesce(v["available"], F.lit(False))), F.lit(False)).alias("in_stock"),
        F.get(F.filter("variants", lambda v: F.coalesce(v["sku"] != "", F.lit(False))), 0)["sku"].alias("vendor_sku"),
        F.get("images", 0)["src"].alias("image_url"),
        infer_category(F.col("product_type"), F.col("tags"), F.col("title")).alias("category"),
        lineage_flag(F.col("title")).alias("lineage_flag"),
        auction.alias("is_auction"),
    )


class Cards(HTMLParser):
    """Product cards of a listing page: elements article with data-name, and a skeleton of tags and classes."""

    def __init__(self):
        super().__init__()
        self.cards, self.skeleton, self.empty, self.was = [], [], False, None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        self.skeleton.append(tag + "." + ".".join(sorted(a.get("class", "").split())))
        if "data-no-products-notification" in a:
            self.empty = True
        if tag == "article" and "data-name" in a:
            self.cards.append({"raw_title": a["data-name"], "price_text": a.get("data-product-price"), "category_text": a.get("data-product-category"), "vendor_sku": a.get("data-entity-id"), "product_url": None, "image_url": None, "was_text": None})
        elif self.cards and "price--non-sale" in a.get("class", "").split() and self.cards[-1]["was_text"] is None:
            self.cards[-1]["was_text"], self.was = "", tag
        elif self.cards and tag == "a" and "card-figure__link" in a.get("class", "").split():
            self.cards[-1]["product_url"] = self.cards[-1]["product_url"] or a.get("href")
        elif self.cards and tag == "img" and "card-image" in a.get("class", "").split():
            self.cards[-1]["image_url"] = self.cards[-1]["image_url"] or a.get("data-src") or a.get("src")

    def handle_data(self, data: str) -> None:
        if self.was:
            self.cards[-1]["was_text"] += data.strip()

    def handle_endtag(self, tag: str) -> None:
        if tag == self.was:
            self.was = None


def price_of_text(text: Column) -> Column:
    """The price that a card's text states: a finite number below the ceiling, dollar signs and commas aside; else null."""
    plain = F.trim(F.regexp_replace(text, "[$,]", ""))
    number = F.when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), plain.try_cast("decimal(20,2)"))
    return F.when(number < PRICE_CEILING, number.cast("decimal(10,2)"))


def card_prices(cards: DataFrame) -> DataFrame:
    """The cards with current_price and compare_at_price: what was, where the card says so and it is more than what is; no comparison without a price."""
    price, was = price_of_text(F.col("price_text")), price_of_text(F.col("was_text"))
    return cards.withColumn("current_price", price).withColumn("compare_at_price", F.when(was > F.col("current_price"), was))


def parse_cards(pages: DataFrame) -> DataFrame:
    """(path, place, product_url, raw_title, price_text, category_text, vendor_sku, image_url, was_text) of pages(path, html); pages without cards give none."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, html in zip(batch["path"], batch["html"]):
                parser = Cards()
                parser.feed(html or "")
                rows += [{"path": path, "place": i, **card} for i, card in enumerate(parser.cards)]
            yield pd.DataFrame(rows, columns=["path", "place", "product_url", "raw_title", "price_text", "category_text", "vendor_sku", "image_url", "was_text"])

    return pages.select("path", "html").mapInPandas(run, "path string, place int, product_url string, raw_title string, price_text string, category_text string, vendor_sku string, image_url string, was_text string")


def first_wins(cards: DataFrame) -> DataFrame:
    """One card for each product_url: the first by path and place."""
    from ..operators.common import first_by

    return first_by(cards, ["product_url"], [F.col("path").asc(), F.col("place").asc()])


def skeleton_hashes(pages: DataFrame) -> DataFrame:
    """(path, tags, skeleton_hash, empty): the structure of each page of pages(path, html); it changes when the vendor's template does."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, html in zip(batch["path"], batch["html"]):
                parser = Cards()
                parser.feed(html or "")
                out.append((path, len(parser.skeleton), hashlib.sha256("\n".join(parser.skeleton).encode()).hexdigest(), parser.empty))
            yield pd.DataFrame(out, columns=["path", "tags", "skeleton_hash", "empty"])

    return pages.select("path", "html").mapInPandas(run, "path string, tags long, skeleton_hash string, empty boolean")


def crawl(pages: DataFrame) -> DataFrame:
    """(vendor_id, path, pages, counted, n, marked_empty, missing, end) of each path of pages(vendor_id, path, page, status, error, cards, empty): what taking them one by one until the first end gives.

    The first page that is not found (404), fails (`error`) or has no cards ends a path; what lies after it is never taken. `pages` were fetched well, the end's included unless it is a 404 or a
    failure; n cards were taken; `marked_empty` says that the first page has no cards and says so itself, `missing` that the first page is a 404; end is not-found, failed, no-cards, or null where pages ran out.
    """
    end = F.when(F.col("status") == 404, "not-found").when(F.col("error").isNotNull(), "failed").when(F.coalesce("cards", F.lit(0)) == 0, "no-cards")
    first = F.min(F.when(end.isNotNull(), F.col("page"))).over(Window.partitionBy("vendor_id", "path"))
    taken = pages.withColumn("_end", end).withColumn("_first", first).where("_first is null or page <= _first")
    fine = F.col("_end").isNull() | (F.col("_end") == "no-cards")
    one = F.col("page") == 1
    return taken.groupBy("vendor_id", "path").agg(
        F.count(F.when(fine, 1)).alias("pages"), F.coalesce(F.sum(F.when(F.col("_end").isNull(), F.col("cards"))), F.lit(0)).alias("n"),
        F.coalesce(F.max(one & (F.col("_end") == "no-cards") & F.col("empty")), F.lit(False)).alias("marked_empty"), F.coalesce(F.max(one & (F.col("_end") == "not-found")), F.lit(False)).alias("missing"), F.max("_end").alias("end"),
        F.max(F.when(F.col("_end") == "failed", F.col("error"))).alias("error"),
    )


def schema_change(paths: DataFrame) -> DataFrame:
    """(vendor_id, paths, pages, n, silent, verdict) of paths as crawl() gives them: blocked or fetch (a path failed), html_schema_change (a path is gone, nothing was found, or so many paths
    have no cards without saying so that the template must have changed: the larger of 3 and three tenths, rounded down), partial (some have) or ok."""
    silent = (F.col("n") == 0) & ~F.col("marked_empty")
    rows = paths.groupBy("vendor_id").agg(
        F.count("*").alias("paths"), F.sum("pages").alias("pages"), F.sum("n").alias("n"), F.count(F.when(silent, 1)).alias("silent"),
        F.max(F.coalesce(F.col("error") == "block", F.lit(False))).alias("_blocked"), F.max(F.coalesce(F.col("end") == "failed", F.lit(False))).alias("_failed"), F.max("missing").alias("_missing"),
    )
    changed = F.col("_missing") | (F.col("n") == 0) | (F.col("silent") >= F.greatest(F.lit(3), F.floor(F.col("paths") * 0.3)))
    verdict = F.when(F.col("_blocked"), "block").when(F.col("_failed"), "fetch").when(changed, "html_schema_change").when(F.col("silent") > 0, "partial").otherwise("ok")
    return rows.select("vendor_id", "paths", "pages", "n", "silent", verdict.alias("verdict"))


# Texts of a page that turns a visitor away.
BLOCK_SIGNATURES = (
    "Just a moment...",
    "cf-challenge",
    "Attention Required! | Cloudflare",
    "Access denied | Cloudflare",
    "<title>Access denied</title>",
)


def fetch_error(status: Column, body: Column) -> Column:
    """The class of a fetch after its last attempt: network, http_429, http_5xx, block (200 or 403 whose first 4096 characters turn a visitor away) or other (also a 403 that doesn't say so); null for a good one."""
    head = F.substring(F.coalesce(body, F.lit("")), 1, 4096)
    turned_away = F.lit(False)
    for x in BLOCK_SIGNATURES:
        turned_away = turned_away | head.contains(x)
    return (
        F.when(status.isNull(), "network")
        .when(status == 429, "http_429")
        .when((status >= 500) & (status < 600), "http_5xx")
        .when(turned_away & status.isin(200, 403), "block")
        .when(status != 200, "other")
    )


class Grid(HTMLParser):
    """Product cards of a shop grid: list items of class product-item, with a title link, price elements and a picture, and the numbers of the page's toolbar."""

    def __init__(self):
        super().__init__()
        self.cards, self.numbers, self.text, self.amount = [], [], None, None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        names = a.get("class", "").split()
        if tag == "li" and "product-item" in names:
            self.cards.append({"raw_title": "", "product_url": None, "final": None, "old": None, "any": None, "image": None})
        if tag == "span" and "toolbar-number" in names:
            self.amount = ""
        if not self.cards:
            return
        card = self.cards[-1]
        if tag == "a" and "product-item-link" in names and card["product_url"] is None:
            card["product_url"], self.text = a.get("href", "").strip(), ""
        if "data-price-amount" in a:
            kind = {"finalPrice": "final", "oldPrice": "old"}.get(a.get("data-price-type", ""))
            for k in {kind, "any"} - {None}:
                card[k] = card[k] if card[k] is not None else a["data-price-amount"].strip()
        if tag == "img" and card["image"] is None:
            card["image"] = a.get("data-original") or a.get("data-origsrc") or a.get("src") or ""

    def handle_data(self, data: str) -> None:
        if self.text is not None:
            self.text += data
        if self.amount is not None:
            self.amount += data

    def handle_endtag(self, tag: str) -> None:
        if tag == "a" and self.text is not None:
            self.cards[-1]["raw_title"], self.text = " ".join(self.text.split()), None
        if tag == "span" and self.amount is not None:
            digits = self.amount.strip()
            self.numbers += [int(digits)] if digits.isdigit() else []
            self.amount = None


def parse_grid(pages: DataFrame) -> DataFrame:
    """(path, place, product_url, raw_title, current_price, compare_at_price, image_url) of pages(path, html): cards without a title or link are left out.

    The old price counts only above the current one; prices that are no finite numbers are null; a picture without its size, and none that only holds the place.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, html in zip(batch["path"], batch["html"]):
                parser = Grid()
                parser.feed(html or "")
                for i, c in enumerate(x for x in parser.cards if x["raw_title"] and x["product_url"]):
                    picture = None if not c["image"] or "/static/" in c["image"] else c["image"].split("?")[0]
                    rows.append((path, i, c["product_url"], c["raw_title"], c["final"] if c["final"] is not None else c["any"], c["old"], picture))
            yield pd.DataFrame(rows, columns=["path", "place", "product_url", "raw_title", "final", "old", "image_url"])

    cards = pages.select("path", "html").mapInPandas(run, "path string, place int, product_url string, raw_title string, final string, old string, image_url string")
    price, old = F.col("final").try_cast("decimal(20,2)"), F.col("old").try_cast("decimal(20,2)")
    return cards.select(
        "path", "place", "product_url", "raw_title", price.cast("decimal(10,2)").alias("current_price"), F.when((old > price) & (old < PRICE_CEILING), old.cast("decimal(10,2)")).alias("compare_at_price"), "image_url"
    )


def last_page(pages: DataFrame) -> DataFrame:
    """(path, last) of pages(path, html): whether a grid's toolbar says that nothing follows; it shows from, to and total, or only the total."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, html in zip(batch["path"], batch["html"]):
                parser = Grid()
                parser.feed(html or "")
                n = parser.numbers
                out.append((path, len(n) < 2 or n[-2] >= n[-1]))
            yield pd.DataFrame(out, columns=["path", "last"])

    return pages.select("path", "html").mapInPandas(run, "path string, last boolean")
