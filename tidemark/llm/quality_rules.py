"""Quality rules with cross-document line frequency, with DataFrame functions only.

One pass over the texts measures each document and hashes its distinct normalised lines. Lines are counted by host (the
`source` column) and line, pre-aggregated; those in more documents of the host than its limit are removed, and a
document that keeps too few words is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACED_WORD, UPPER, cut

#: A line goes when more documents of its host have it than the larger of a number and a share of the host's documents.
LINE_DOCS, LINE_SHARE = 20, 0.01
#: A document goes when its remaining words are fewer than this number or this share of its words.
LEFT_WORDS, LEFT_SHARE = 10, 0.2
#: Base rule: words at least; words in repeated 5-word windows at most, in hundredths.
LEAST_WORDS, REPEATED = 10, 20
WINDOW = 5
_BLANK = "\x20\x09\x0a\x0b\x0c\x0d"


def let(value: Column, use) -> Column:
    """`use` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _windows(words: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(WINDOW)]))


def _repeated(hashes: Column) -> Column:
    """Words covered by windows that occur twice or more, from the hashes of all windows in order."""

    def starts(found: Column) -> Column:
        """Positions whose hash a neighbour in the sorted list shares."""
        return F.array_sort(
            F.transform(
                F.filter(found, lambda x, j: (F.get(found, j - 1)["h"] == x["h"]) | (F.get(found, j + 1)["h"] == x["h"])),
                lambda x: x["i"],
            )
        )

    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    covered = lambda at: F.aggregate(
        at,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + i + WINDOW - F.greatest(a["end"], i)).alias("n")),
        lambda a: a["n"],
    )
    return let(ordered, lambda found: covered(starts(found)))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, rid, host, the base measures, and lines: array of (h, words, copies) for the distinct normalised lines."""
    text = F.coalesce("text", F.lit(""))
    split = docs.select(
        "doc_id",
        F.coalesce("source", F.lit("")).alias("host"),
        text.alias("text"),
        F.regexp_extract_all(text, F.lit(SPACED_WORD), F.lit(0)).alias("words"),
        F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, _BLANK, "")) > 0).alias("raw"),
    )
    tidy = F.transform("raw", lambda x: F.trim(F.regexp_replace(F.translate(x, UPPER, LOWER), r"[\x20\x09-\x0D]+", " ")))
    lines = F.transform(tidy, lambda x: F.struct(F.xxhash64(x).alias("h"), (F.length(x) - F.length(F.translate(x, " ", "")) + 1).alias("words")))
    hashes = F.when(F.size("words") > WINDOW, let(F.col("words"), _windows)).otherwise(F.array().cast("array<long>"))
    return (
        split.select("doc_id", "host", "text", "words", "raw", lines.alias("lines"), hashes.alias("hashes"))
        .select(
            "doc_id",
            "host",
            F.size("words").cast("long").alias("n_words"),
            F.length(F.translate("text", _BLANK, "")).cast("long").alias("word_chars"),
            (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            (F.size("raw") - F.size(F.array_distinct("raw"))).cast("long").alias("n_dup_lines"),
            F.when(F.size(F.array_distinct("hashes")) == F.size("hashes"), F.lit(0)).otherwise(_repeated(F.col("hashes"))).cast("long").alias("n_repeat_words"),
            F.xxhash64("text").alias("rid"),
            "lines",
        )
        .withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words")))
    )


def frequent_lines(measured: DataFrame) -> DataFrame:
    """(host, h): lines in more documents of a host than its limit allows. Rows with one doc_id are one document; without a doc_id rows of one text are."""
    doc = ("host", "doc_id", F.when(F.col("doc_id").isNull(), F.col("rid")).alias("alt"))
    limits = measured.select(*doc).distinct().groupBy("host").agg(F.greatest(F.lit(LINE_DOCS), F.ceil(F.count("*") * LINE_SHARE)).alias("most"))
    counts = measured.select(*doc, F.explode(F.array_distinct(F.col("lines.h"))).alias("h")).distinct().groupBy("host", "h").agg(F.count("*").alias("docs"))
    return counts.where(F.col("docs") > LINE_DOCS).join(limits, "host").where("docs > most").select("host", "h")


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_line_words) for every row of docs(doc_id, text, source, ...).

    n_line_words counts words in lines that are too frequent at the document's host. Null texts are empty and fail; a null source is
    one host of its own name "". Null doc_id stays null; repeated rows stay repeated; rows with one doc_id count as one document of
    their host, those without one count by their text; further columns are ignored; no rows give no rows.
    """
    return _judged(cut(measure(docs), "measured"))


def _judged(measured: DataFrame) -> DataFrame:
    each = measured.select("doc_id", "rid", "host", F.explode("lines").alias("line")).select("doc_id", "rid", "host", "line.h", "line.words")
    gone = each.join(frequent_lines(measured), ["host", "h"]).groupBy("doc_id", "rid", "host").agg(F.sum("words").alias("w"))
    # rows that are equal in all of these share the sum
    copies = measured.groupBy("doc_id", "rid", "host").agg(F.count("*").alias("copies"))
    gone = gone.join(copies.where("copies > 1"), ["doc_id", "rid", "host"], "left").select("doc_id", "rid", "host", (F.col("w") / F.coalesce("copies", F.lit(1))).cast("long").alias("w"))
    g = gone.select(F.col("doc_id").alias("g_id"), F.col("rid").alias("g_rid"), F.col("host").alias("g_host"), "w")
    joined = measured.drop("lines").join(g, F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("rid") == F.col("g_rid")) & (F.col("host") == F.col("g_host")), "left")
    lost = F.coalesce("w", F.lit(0).cast("long"))
    left = F.col("n_words") - lost
    kept = ~F.col("base_failed") & (left >= LEFT_WORDS) & (left >= LEFT_SHARE * F.col("n_words"))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), lost.alias("n_line_words"))


ORACLE_SQL = f"""
with d as (select doc_id, coalesce(source, '') as host, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
l as (select doc_id, host, raw, trim(regexp_replace(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+', ' ', 'g')) as line
      from (select doc_id, host, unnest(string_split(t, chr(10))) as raw from d) where regexp_matches(raw, '[^\\x20\\x09-\\x0D]')),
win as (select doc_id, i, array_to_string(w[i:i + 4], ' ') as x from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from d)),
rep as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + 5)) as p from (select *, count(*) over (partition by doc_id, x) as c from win) where c > 1) group by doc_id),
dup as (select doc_id, count(*) - count(distinct raw) as n from l group by doc_id),
lim as (select host, greatest({LINE_DOCS}, ceil(count(distinct doc_id) * {LINE_SHARE}::double)) as most from d group by host),
freq as (select c.host, c.line from (select host, line, count(distinct doc_id) as docs from l group by host, line) c join lim on c.host = lim.host where c.docs > lim.most),
gone as (select l.doc_id, sum(len(string_split(l.line, ' '))) as w from l join freq on l.host = freq.host and l.line = freq.line group by l.doc_id),
m as (select d.doc_id, len(d.w)::bigint as n_words, length(array_to_string(d.w, ''))::bigint as word_chars,
      (length(d.t) - length(translate(d.t, '#*$%&|<>', '')))::bigint as n_symbols, coalesce(dup.n, 0)::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words, coalesce(gone.w, 0)::bigint as n_line_words
      from d left join dup on d.doc_id = dup.doc_id left join rep on d.doc_id = rep.doc_id left join gone on d.doc_id = gone.doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
       not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and n_words - n_line_words >= {LEFT_WORDS} and n_words - n_line_words >= {LEFT_SHARE} * n_words as kept, n_line_words
from m
"""
