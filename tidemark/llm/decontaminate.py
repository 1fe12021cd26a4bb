"""Benchmark decontamination with DataFrame functions only.

The benchmark's word windows are hashed into a table that is broadcast while its checked size allows it. Every
document is cut into words once; each position's window is hashed from the words in place, looked up
in the hash table, and a hit is verified by comparing the words themselves. Only hits are shuffled, by document, together
with one row for each document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ITEM_WORD, ascii_lower, keep_rows

#: Words in a window, and the most windows that are broadcast (64 bytes or so each).
WINDOW, BROADCAST_WINDOWS = 10, 2_000_000


def _words(col: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(col), F.lit(ITEM_WORD), F.lit(0))


def _at(words: str, start: Column, k: int) -> list[Column]:
    return [F.get(F.col(words), start + F.lit(j)) for j in range(k)]


def _key(words: str, start: Column, k: int) -> Column:
    return F.xxhash64(*_at(words, start, k))


def _by_length(lengths: list[int], make) -> Column:
    out = None
    for k in lengths:
        out = F.when(F.col("k") == k, make(k)) if out is None else out.when(F.col("k") == k, make(k))
    return out


def windows(benchmark: DataFrame, size: int = WINDOW) -> tuple[DataFrame, list[int]]:
    """(item_id, k, key, phrase) of every window of the items, and the window lengths that occur (`size` at most)."""
    items = benchmark.select("item_id", _words(F.col("text")).alias("words")).where(F.size("words") > 0).withColumn("k", F.least(F.size("words"), F.lit(size)))
    lengths = sorted(r["k"] for r in items.select("k").distinct().collect())  # `size` rows at most
    if not lengths:
        return items.select("item_id", "k", F.lit(0).cast("long").alias("key"), F.lit("").alias("phrase")), []
    at = items.select("item_id", "k", "words", F.explode(F.expr("sequence(0, size(words) - k)")).alias("i"))
    key = _by_length(lengths, lambda k: _key("words", F.col("i"), k))
    phrase = _by_length(lengths, lambda k: F.concat_ws(" ", *_at("words", F.col("i"), k)))
    return at.select("item_id", "k", key.alias("key"), phrase.alias("phrase")), lengths


def _positions(cut: DataFrame, lengths: list[int], size: int, first: int) -> DataFrame:
    """Each word position of cut(words, ...) from `first` on, with each window length k."""
    at = cut.select("*", F.explode(F.expr(f"case when size(words) > {first} then sequence({first}, size(words) - 1) else array() end")).alias("i"))
    if len(lengths) > 1:
        return at.select("*", F.explode(F.when(F.col("i") < 0, F.array(F.lit(lengths[0]))).otherwise(F.array(*map(F.lit, lengths)))).alias("k"))
    return at.withColumn("k", F.lit(lengths[0] if lengths else size))


def _key_at(lengths: list[int]) -> Column:
    """The key of the window of k words at i, null where the text ends before."""
    fits = (F.col("i") >= 0) & (F.col("i") + F.col("k") <= F.size("words"))
    return F.when(fits, _by_length(lengths, lambda k: _key("words", F.col("i"), k)))


def find_hits(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row for each distinct (doc_id, text): doc_id, rid, copies, n_words, spans (array of start and length), n_hit, item_ids (sorted strings).

    rid tells texts with the same doc_id apart; copies counts equal rows.
    """
    found, lengths = windows(benchmark, size)
    table = found.select("k", "key", "phrase").distinct().withColumn("wid", F.xxhash64("k", "phrase"))
    owners = found.where("item_id is not null").select(F.xxhash64("k", "phrase").alias("wid"), F.col("item_id").cast("string").alias("item")).distinct()
    small = found.count() <= BROADCAST_WINDOWS
    sized = F.broadcast if small else lambda df: df
    cut = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("rid"), _words(F.col("text")).alias("words"))
    if small:
        # position -1 stands for the document itself
        at = _positions(cut, lengths, size, -1)
        if lengths:
            left = at.select("doc_id", "rid", "words", "i", "k", _key_at(lengths).alias("key")).alias("d")
            right = F.broadcast(table.select(F.col("k").alias("wk"), F.col("key").alias("wkey"), "phrase", "wid")).alias("w")
            same = (F.col("d.key") == F.col("w.wkey")) & (F.col("d.k") == F.col("w.wk")) & (phrase_of(lengths, "d") == F.col("w.phrase"))
            hits = left.join(right, same, "left").where("i < 0 or wid is not null").select("doc_id", "rid", F.size("words").alias("n"), "i", "k", "wid")
        else:
            hits = at.where("i < 0").select("doc_id", "rid", F.size("words").alias("n"), "i", "k", F.lit(None).cast("long").alias("wid"))
        per_doc = hits.groupBy("doc_id", "rid").agg(
            F.sum(F.when(F.col("i") < 0, 1).otherwise(0)).alias("copies"),
            F.max("n").cast("long").alias("n_words"),
            F.collect_set(F.when(F.col("i") >= 0, F.struct("i", "k"))).alias("spans"),
            F.collect_set("wid").alias("wids"),
        )
    else:
        # keys alone are shuffled; of documents with a hit the words are joined once more and compared
        keys = _positions(cut, lengths, size, 0).select("doc_id", "rid", "i", "k", _key_at(lengths).alias("key")).where("key is not null")
        right = table.select(F.col("k").alias("wk"), F.col("key").alias("wkey"), "phrase", "wid")
        met = keys.join(right, (F.col("key") == F.col("wkey")) & (F.col("k") == F.col("wk"))).groupBy(F.col("doc_id").alias("m_id"), F.col("rid").alias("m_rid")).agg(F.collect_set(F.struct("i", "k", "wid", "phrase")).alias("met"))
        once = cut.groupBy("doc_id", "rid").agg(F.count("*").alias("copies"), F.first("words").alias("words"))
        joined = once.join(met, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("rid") == F.col("m_rid")), "left")
        true = F.filter(F.coalesce("met", F.array().cast(met.schema["met"].dataType)), lambda h: F.array_join(F.slice("words", h["i"] + 1, h["k"]), " ") == h["phrase"])
        per_doc = joined.select("doc_id", "rid", "copies", F.size("words").cast("long").alias("n_words"), true.alias("true")).select(
            "doc_id", "rid", "copies", "n_words", F.array_distinct(F.transform("true", lambda h: F.struct(h["i"].alias("i"), h["k"].alias("k")))).alias("spans"), F.array_distinct("true.wid").alias("wids")
        )
    covered = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, s: F.struct(F.greatest(a["end"], s["i"] + s["k"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["i"] + s["k"] - F.greatest(a["end"], s["i"]))).alias("n")),
        lambda a: a["n"].cast("long"),
    )
    per_doc = per_doc.withColumn("n_hit", covered)
    named = per_doc.select("*", F.explode_outer("wids").alias("wid")).join(sized(owners), "wid", "left")
    return named.groupBy("doc_id", "rid").agg(
        *(F.first(c).alias(c) for c in ("copies", "n_words", "spans", "n_hit")), F.array_sort(F.collect_set("item")).alias("item_ids")
    )


def phrase_of(lengths: list[int], side: str) -> Column:
    """The words of the window at d.i, joined by spaces."""
    out = None
    for k in lengths:
        made = F.concat_ws(" ", *[F.get(F.col(f"{side}.words"), F.col(f"{side}.i") + F.lit(j)) for j in range(k)])
        out = F.when(F.col(f"{side}.k") == k, made) if out is None else out.when(F.col(f"{side}.k") == k, made)
    return out if len(lengths) > 1 else F.concat_ws(" ", *[F.get(F.col(f"{side}.words"), F.col(f"{side}.i") + F.lit(j)) for j in range(lengths[0])])


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of docs(doc_id, text, ...).

    A window is `size` consecutive words of an item; an item of fewer words, but some, is one window. A document word
    inside any occurrence of a window is hit. Null or wordless texts have no words and no hits; null or wordless items and an
    empty benchmark have no windows; items with a null id hit words but are not listed. Null doc_id stays null, repeated rows stay
    repeated, ties between items are listed in string order, further columns are ignored, no rows give no rows.
    """
    rows = keep_rows(find_hits(docs, benchmark, size), "copies")
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, remove: str = "documents") -> DataFrame:
    """The rows of `docs` without contaminated documents, or (remove="spans") with the hit words and what follows them cut out.

    All columns stay, whatever their names; a null text stays null.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is documents or spans")
    hits = find_hits(docs, benchmark, size).where("n_hit > 0").select(F.col("doc_id").alias("_id"), F.col("rid").alias("_rid"), F.col("spans").alias("_spans"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_key"))
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_rid"))
    if remove == "documents":
        return rows.join(hits, same, "left_anti").select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
    text = F.col("_row").getField("text")
    words = F.regexp_extract_all(text, F.lit(r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"), F.lit(0))
    lead = F.when(F.regexp_like(text, F.lit(r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")), 1).otherwise(0)
    hit = F.array_distinct(F.flatten(F.transform("_spans", lambda s: F.sequence(s["i"], s["i"] + s["k"] - 1))))
    joined = rows.join(hits, same, "left").withColumns({"_words": words, "_lead": lead, "_hit": hit})
    kept = F.array_join(F.filter("_words", lambda x, j: ~F.array_contains(F.col("_hit"), j - F.col("_lead"))), "")
    shown = F.when(F.col("_spans").isNull(), text).otherwise(kept)
    return joined.select(*[shown.alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns])


ORACLE_SQL = """
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
bw as (select distinct item_id, k, array_to_string(w[i:i + k - 1], ' ') as phrase from (select *, unnest(range(1, len(w) - k + 2)) as i from (select *, least(len(w), 10) as k from b where len(w) > 0))),
ks as (select distinct k from bw),
dw as (select doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') as phrase from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d cross join ks)),
h as (select dw.doc_id, dw.i, dw.k, bw.item_id from dw join bw on dw.k = bw.k and dw.phrase = bw.phrase),
n as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from h) group by doc_id),
t as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item_id::varchar as item from h) group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n.n_hit, 0)::bigint as n_hit, coalesce(t.n_items, 0)::bigint as n_items,
       sha256(coalesce(t.items, '')) as items_sha256, coalesce(n.n_hit, 0) > 0 as contaminated
from d left join n on d.doc_id = n.doc_id left join t on d.doc_id = t.doc_id
"""
