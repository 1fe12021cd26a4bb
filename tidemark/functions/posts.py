"""Text of posts: names from titles, tags, fish nouns, captions and the files they belong to."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labels import BRANDED_NOTE, COMMON_TAGS, EDGE_WORDS, FISH_NOUNS, LINEAGE_NOTE, MECHANISM_WORDS, TYPE_NOUNS, UNTAGGED_NOUNS

#: A post has so many tags at most; a file's caption has so many characters at most.
MOST_TAGS, CAPTION_CHARS = 12, 1024
_EDGES = " -–—,"
MARKS = (",", ".", ";", ":")


def _words(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(x) for x in values])


def clean_title(title: Column) -> Column:
    """The vendor's words less those of the selling mechanism; empty if nothing is left or the title is null.

    What remains is cut at white space and at parentheses that have become empty; a mark of punctuation that stands alone joins the word before it.
    """
    rest = F.regexp_replace(F.coalesce(title, F.lit("")), "(?i)" + "|".join(MECHANISM_WORDS), "")
    tokens = F.filter(F.split(rest, r"\(\s*\)|\s+"), lambda t: t != "")
    joined = F.aggregate(tokens, F.lit(""), lambda text, t: F.concat(text, F.when(F.substring(t, 1, 1).isin(*MARKS) | (text == ""), "").otherwise(" "), t))
    return F.btrim(joined, F.lit(_EDGES))


def type_nouns(title: Column) -> Column:
    """The nouns of a title that name a kind of coral, in the singular, each once, in order of their first place."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    known = _words(TYPE_NOUNS)
    single = F.transform(tokens, lambda t: F.when(F.array_contains(known, t), t).otherwise(F.when(t.endswith("s"), F.substring(t, F.lit(1), F.length(t) - 1))))
    return F.array_distinct(F.filter(single, lambda t: F.array_contains(known, t)))


def descriptive_name(title: Column) -> Column:
    """The cleaned title if it still names a piece: no connecting word at an edge, and a known noun or two words; else null."""
    cleaned = clean_title(title)
    tokens = F.split(cleaned, r"\s+")
    edge = F.exists(F.array(F.element_at(tokens, 1), F.element_at(tokens, -1)), lambda t: F.btrim(F.lower(t), F.lit(",.;:")).isin(*EDGE_WORDS))
    named = (F.size(type_nouns(cleaned)) > 0) | (F.regexp_count(cleaned, F.lit("[A-Za-z]+")) >= 2)
    return F.when((cleaned != "") & ~edge & named, cleaned)


def type_tags(title: Column, families: Mapping[str, Sequence[str]] | None = None) -> Column:
    """The tags of a title's nouns, each once, in order; a noun without a family of tags gives its own."""
    nouns = F.filter(type_nouns(title), lambda t: ~t.isin(*UNTAGGED_NOUNS))
    own = lambda t: F.array(F.concat(F.lit("#"), t))
    if not families:
        return F.array_distinct(F.flatten(F.transform(nouns, own)))
    table = F.create_map(*[x for noun, tags in families.items() for x in (F.lit(noun), _words(tags))])
    return F.array_distinct(F.flatten(F.transform(nouns, lambda t: F.coalesce(F.try_element_at(table, t), own(t)))))


def post_tags(types: Column, lineage: Column, branded: Column, lineage_note: str = LINEAGE_NOTE, branded_note: str = BRANDED_NOTE, most: int = MOST_TAGS) -> Column:
    """A post's tags: those of its types, the common ones, the lineage's and the vendor's, each once.

    Where there are too many the last go in the order lineage, vendor, types, common. A null tag is left out.
    """
    one = lambda tag: F.filter(F.array(tag), lambda t: t.isNotNull())
    tiers = (one(lineage), one(branded), F.coalesce(types, F.array().cast("array<string>")), _words(COMMON_TAGS))
    taken, kept = F.array().cast("array<string>"), []
    for tier in tiers:
        fresh = F.array_except(tier, taken)
        kept.append(F.slice(fresh, F.lit(1), F.greatest(F.lit(most) - F.size(taken), F.lit(0))))
        taken = F.concat(taken, fresh)
    noted = lambda tags, note: F.transform(tags, lambda t: F.concat(t, F.lit(note)))
    return F.concat(kept[2], kept[3], noted(kept[0], lineage_note), noted(kept[1], branded_note))


def fish_terms(title: Column) -> Column:
    """The fish nouns that stand as words in a title, sorted, each once; none for null."""
    found = F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit(rf"\b(?:{'|'.join(FISH_NOUNS)})\b"), F.lit(0))
    return F.array_sort(F.array_distinct(found))


def caption_plan(caption: Column, most: int = CAPTION_CHARS) -> Column:
    """(attached, follow_up): a caption of `most` characters goes with the file, a longer one after it; blank or null gives neither."""
    text = F.nullif(F.regexp_replace(caption, r"^\s+|\s+$", ""), F.lit(""))
    return F.struct(F.when(F.length(text) <= most, text).alias("attached"), F.when(F.length(text) > most, text).alias("follow_up"))


def pair_files(files: DataFrame, folder: str, kind: str = "mp4", partner: str = "txt") -> DataFrame:
    """(path, partner): each file of a kind directly in the folder with the one of the same stem, or null. `files` has a column path."""
    name = F.expr(f"substring(path, {len(folder.rstrip('/')) + 2})")
    here = files.where(F.col("path").startswith(folder.rstrip("/") + "/") & ~name.contains("/")).select("path", F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.regexp_extract(name, r"\.([^.]*)$", 1).alias("kind"))
    partners = here.where(F.col("kind") == partner).select("stem", F.col("path").alias("partner"))
    return here.where(F.col("kind") == kind).join(partners, "stem", "left").select("path", "partner")
