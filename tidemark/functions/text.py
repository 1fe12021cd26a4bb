"""Column functions on titles, tags, prices and times. All but Unicode decomposition are built-in expressions."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .labels import CATEGORY_PATTERNS, CORAL_CATEGORIES, LINEAGE, LOOSE_PLATE, NO_ORIGINATOR, NOT_CORAL, NOT_PLATE, ORIGINATORS, PRICE_BANDS, TITLE_ENDS, TYPE_ACRONYMS, TYPE_WORDS

#: Prices from this on can't be stored.
PRICE_CEILING = 100_000_000


@F.pandas_udf(StringType())
def without_marks(text: pd.Series) -> pd.Series:
    """NFKD without combining marks; Spark has no such function."""
    return text.map(lambda x: x if x is None or x.isascii() else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))


def normalize_title(title: Column) -> Column:
    """Lower case, marks stripped, trailing prices, stock words, codes and dashes removed, white space collapsed; null stays null."""
    ends = F.regexp_replace(F.rtrim(without_marks(F.lower(title))), "(?i)" + TITLE_ENDS, "")
    return F.trim(F.regexp_replace(ends, r"\s+", " "))


@F.arrow_udf(StringType())
def _category(before: pa.Array, title: pa.Array) -> pa.Array:
    """Patterns of ours mean what they mean in SQL only to RE2: word boundaries and blanks are ASCII ones, and without regard to case k and s are also the Kelvin sign and the long s.

    One pattern says which rows have any of them; rows go on to the single ones while they are undecided.
    """

    def having(rows: np.ndarray, texts: pa.Array, pattern: str) -> np.ndarray:
        return rows[np.asarray(pc.match_substring_regex(texts.take(pa.array(rows)), "(?i)" + pattern)).astype(bool)]

    text = pc.binary_join_element_wise(before.cast(pa.large_string()), title.cast(pa.large_string()), pa.scalar(" ", pa.large_string()))
    out = np.full(len(text), None, object)
    rows = np.flatnonzero(np.asarray(pc.match_substring_regex(text, "(?i)" + "|".join([p for _, p in CATEGORY_PATTERNS] + [LOOSE_PLATE]))))
    for label, pattern in CATEGORY_PATTERNS:
        hit = having(rows, text, pattern)
        out[hit] = label
        if label in CORAL_CATEGORIES:
            out[having(hit, title, NOT_CORAL)] = "equipment"
        rows = np.setdiff1d(rows, hit, assume_unique=True)
    loose = having(rows, title, LOOSE_PLATE)
    out[np.setdiff1d(loose, having(loose, title, NOT_PLATE), assume_unique=True)] = "lps"
    return pa.array(out, pa.string())


def infer_category(product_type: Column, tags: Column, title: Column) -> Column:
    """The first category whose pattern is in type, tags or title; a coral one turns equipment if the title names a thing; else a loose plate is lps; else null."""
    before = F.concat_ws(" ", F.coalesce(product_type, F.lit("")), F.array_join(F.coalesce(tags, F.array().cast("array<string>")), " "))
    return _category(before, F.coalesce(title, F.lit("")))


def lineage_flag(title: Column) -> Column:
    return F.when(title.rlike(LINEAGE), "vendor-named").otherwise("unknown")


def trigrams(text: Column) -> Column:
    """The set of three-character pieces of the text with two spaces before and one after it; empty for an empty text."""
    padded = F.concat(F.lit("  "), text, F.lit(" "))
    pieces = F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substring(padded, i, 3))
    return F.when(F.length(text) > 0, F.array_distinct(pieces)).otherwise(F.array().cast("array<string>"))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two trigram sets; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def coerce_price(text: Column) -> Column:
    """A price text as decimal(10,2): null if it is no number, zero, or too large to store."""
    value = F.regexp_replace(text, r"[$,\s]", "").try_cast("decimal(20,2)")
    return F.when((value > 0) & (value < PRICE_CEILING), value.cast("decimal(10,2)"))


def coerce_variants(variants: Column) -> Column:
    """Struct (price, compare_at) of the first variant (array of struct<price string, compare_at_price string>) with a price; compare_at is of the same variant and null unless above it."""
    as_price = lambda x: x.try_cast("decimal(20,2)")
    usable = F.filter(variants, lambda v: F.coalesce((as_price(v["price"]) > 0) & (as_price(v["price"]) < PRICE_CEILING), F.lit(False)))
    first = F.get(usable, 0)
    price, compare = as_price(first["price"]), as_price(first["compare_at_price"])
    return F.struct(price.cast("decimal(10,2)").alias("price"), F.when((compare > price) & (compare < PRICE_CEILING), compare.cast("decimal(10,2)")).alias("compare_at"))


def drop_fraction(price: Column, prior: Column, compare: Column) -> Column:
    """How much of the first usable baseline (prior price, else compare-at) the price is below it, 0 to 1; null without a baseline."""
    base = F.coalesce(F.when(prior > 0, prior), F.when(compare > 0, compare)).cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (base - price.cast("double")) / base))


def drop_dollars(price: Column, prior: Column, compare: Column) -> Column:
    base = F.coalesce(F.when(prior > 0, prior), F.when(compare > 0, compare)).cast("double")
    return F.greatest(F.lit(0.0), base - price.cast("double"))


def superlative_pct(price: Column, prior: Column) -> Column:
    """Whole per cent off, rounded half to even."""
    return F.bround((prior.cast("double") - price.cast("double")) / prior.cast("double") * 100, 0).cast("long")


def price_text(price: Column) -> Column:
    return F.when(price.isNull(), "price on request").otherwise(F.concat(F.lit("$"), F.format_string("%.2f", price.cast("double"))))


def price_value(price: Column, in_stock: Column, prior: Column, compare: Column) -> Column:
    """What a listing shows, as struct (kind, value, old_value): out of stock, an observed drop, a vendor markdown of 5 % or more, or the bare price."""
    p, c = price.cast("double"), compare.cast("double")
    shown = lambda kind, old=None: F.struct(F.lit(kind).alias("kind"), price_text(price).alias("value"), (F.lit(None).cast("string") if old is None else price_text(old)).alias("old_value"))
    return (
        F.when(~in_stock, shown("invalidated"))
        .when(prior.isNotNull() & price.isNotNull(), shown("price-drop-new", prior))
        .when((p > 0) & (c - p >= p * 0.05 - 1e-9), shown("vendor-markdown", compare))
        .otherwise(shown("text"))
    )


def field_text(value: Column) -> Column:
    """The text of a price_value(): the old price, if there is one, before the new one."""
    return F.concat_ws(" ", value["old_value"], value["value"])


def relative_time(then: Column, now: Column) -> Column:
    """Minutes (one at least), hours, days, or the date from a week on; a time to come is now."""
    s = F.greatest(F.lit(0), F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(then.cast("timestamp")))

    def ago(n: Column, unit: str) -> Column:
        n = n.cast("long")
        return F.concat(n.cast("string"), F.when(n == 1, f" {unit} ago").otherwise(f" {unit}s ago"))

    return F.when(s < 3600, ago(F.greatest(F.lit(1), F.floor(s / 60)), "minute")).when(s < 86400, ago(F.floor(s / 3600), "hour")).when(s < 7 * 86400, ago(F.floor(s / 86400), "day")).otherwise(F.date_format(then, "MMM d"))


def price_band(price: Column) -> Column:
    out = F.lit(None).cast("string")
    for edge, label in PRICE_BANDS:
        out = F.when(price >= edge, label).otherwise(out)
    return out


def normal_tag(tag: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(F.lower(tag), F.lit("-"), F.lit(" ")), r"\s+", " "))


def sku_ends_with(sku: Column, suffix: str) -> Column:
    """Whether the code, without a trailing number, ends with the suffix."""
    return F.regexp_replace(sku, r"-\d+$", "").endswith(suffix)


def day_label(day: Column, today: Column) -> Column:
    """The heading of a past day; null for today and days to come."""
    n = F.datediff(today, day)
    return F.when(n == 1, "YESTERDAY").when((n > 1) & (n < 7), F.concat(n.cast("string"), F.lit(" DAYS AGO"))).when(n >= 7, F.upper(F.date_format(day, "MMM d")))


def day_divider(instant: Column, now: Column, *ties: Column) -> Column:
    """The heading before a row of a feed that is sorted from the newest instant on (ties by `ties`): that of its day for the day's first row, else null."""
    first = F.row_number().over(Window.partitionBy(F.to_date(instant)).orderBy(instant.desc(), *ties)) == 1
    return F.when(first, day_label(F.to_date(instant), F.to_date(now)))


def data_row(fields: Column) -> Column:
    """`Label. value — Label. value` of an array of struct (label, value); fields without a value are left out."""
    return F.array_join(F.transform(F.filter(fields, lambda f: f["value"].isNotNull()), lambda f: F.concat(f["label"], F.lit(". "), f["value"])), " — ")


def type_label(raw: Column) -> Column:
    """Struct (display, italic): acronyms in capitals, two-word scientific names in italics, known words as they are spelled, all else unchanged."""
    own = F.trim(raw)
    shown = lambda text, italic: F.struct(text.alias("display"), F.lit(italic).alias("italic"))
    out = F.when(F.upper(own).isin(*TYPE_ACRONYMS), shown(F.upper(own), False)).when(own.rlike(r"^[A-Z][a-z]+\s+[a-z]+$"), shown(own, True))
    return out.when(F.lower(own).isin(*[w.lower() for w in TYPE_WORDS]), shown(F.initcap(own), False)).otherwise(shown(own, False))


def originator(raw: Column) -> Column:
    """The full name of an entity's originator, or of each of several; null for the one that is not shown."""
    names = F.create_map(*[F.lit(x) for pair in ORIGINATORS.items() for x in pair])
    full = lambda x: F.coalesce(F.try_element_at(names, F.trim(x)), F.trim(x))
    return F.when(F.regexp_replace(F.lower(raw), r"\s+", "") != NO_ORIGINATOR, F.array_join(F.transform(F.split(raw, "/"), full), " / "))


def tied_vendors(names: Column, most: int = 3) -> Column:
    """The distinct names of an array in their order, `most` of them and how many more."""
    each = F.array_distinct(names)
    more = F.size(each) - most
    return F.concat(F.array_join(F.slice(each, 1, most), ", "), F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"))).otherwise(""))


def availability_state(total: Column, in_stock: Column, priced: Column) -> Column:
    return F.when(total == 0, "not-listed").when(in_stock == 0, "all-oos").when(priced == 0, "price-on-request").otherwise("available")


def set_fingerprint(urls: Column) -> Column:
    """SHA-256 of the sorted, comma-joined texts of an array; null if it is empty."""
    return F.when(F.size(urls) > 0, F.sha2(F.array_join(F.array_sort(urls), ","), 256))


# File endings of pictures.
PICTURE_ENDINGS = (".jpg", ".jpeg", ".png", ".webp", ".gif")


def _path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def url_handle(url: Column) -> Column:
    """The last part of a URL's path, in lower case and safe for a file name; `unknown` without one."""
    last = F.regexp_replace(F.lower(F.regexp_extract(_path_of(url), r"([^/]+)/*$", 1)), r"[^a-z0-9._-]", "-")
    return F.when(last == "", "unknown").otherwise(last)


def picture_ending(url: Column) -> Column:
    """The file ending of a picture's URL, .jpg if it has none that is known."""
    path = F.lower(_path_of(url))
    out = F.when(path.endswith(PICTURE_ENDINGS[0]), PICTURE_ENDINGS[0])
    for x in PICTURE_ENDINGS[1:]:
        out = out.when(path.endswith(x), x)
    return out.otherwise(PICTURE_ENDINGS[0])


def picture_type(ending: Column) -> Column:
    return F.concat(F.lit("image/"), F.when(ending.isin(".png", ".webp", ".gif"), F.substring(ending, 2, 9)).otherwise("jpeg"))


def html_escape(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def markdown_escape(text: Column) -> Column:
    """A backslash before each character that marks up a chat message."""
    return F.regexp_replace(text, r"([\\*_~`|\[\]])", r"\\$1")


def url_component(text: Column) -> Column:
    """A text as a part of a URL, as browsers encode it: letters, digits and -_.!~*'() stay, blanks are %20."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for code, mark in (("%21", "!"), ("%7E", "~"), ("%27", "'"), ("%28", "("), ("%29", ")")):
        out = F.replace(out, F.lit(code), F.lit(mark))
    return out


def signup_links(token: Column, origin: str) -> Column:
    """Struct (confirm, unsubscribe): the links of a signup's token; null without one."""
    link = lambda page: F.concat(F.lit(f"{origin.rstrip('/')}/{page}?t="), url_component(token))
    return F.struct(link("confirm").alias("confirm"), link("unsubscribe").alias("unsubscribe"))


def one_of(value: Column, allowed: tuple[str, ...], default: str | None = None) -> Column:
    """A request's value if it is allowed, else the default."""
    return F.when(value.isin(*allowed), value).otherwise(F.lit(default))


# Formats of content, and whether they set vendors against each other by price.
CONTENT_FORMATS = {
    "aggregate-activity": False,
    "most-restocked": False,
    "single-listing-drop": False,
    "velocity": False,
    "cheapest-across-vendors": True,
    "market-report": True,
}


def publishable(fmt: Column) -> Column:
    """Whether a format may go out without review: a known one that is not comparative."""
    return fmt.isin(*[k for k, comparative in CONTENT_FORMATS.items() if not comparative])
