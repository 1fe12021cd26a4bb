"""License scans by a positional rare-token index, with DataFrame functions only.

Clauses of licence texts and notices are templates. One pass counts in how many documents each of their words occurs; of each template's words outside its key phrase the
RARE_WORDS of highest IDF are indexed as postings (word, template, position), so that what they agree on is more than the phrase. A document's words are looked up in the broadcast index; a hit fixes
where the template would begin, and the postings of one template are intersected by that beginning. Where enough of them agree and the
template's mandatory key phrase stands in place word by word, its label is given. The base phrases of the contract count wherever they stand.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ITEM_WORD, ascii_lower, keep_rows

#: Phrases of the contract: label and words. Every place counts.
BASE = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
# Label, clause in lower case without punctuation, mandatory key phrase.
TEMPLATES = (
    ("mit", "released under the mit license", "the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "hereby granted free of charge"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "this permission notice shall be included"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license", "except in compliance with the license"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind", "distributed on an as is basis"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "general public license version 2"),
    ("gpl-3.0", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", "either version 3 of the license"),
    ("gpl-2.0", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", "either version 2 of the license"),
    ("lgpl", "modify it under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "modify it under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    ("agpl", "licensed under the gnu affero general public license", "gnu affero general public license"),
    ("bsd", "licensed under the bsd license", "the bsd license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "source and binary forms with or without modification"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "must retain the above copyright notice"),
    ("bsd-3-clause", "may be used to endorse or promote products derived from this software without specific prior written permission", "endorse or promote products derived from this software"),
    ("isc", "licensed under the isc license", "the isc license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("epl", "made available under the terms of the eclipse public license", "eclipse public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc", "licensed under a creative commons attribution license", "creative commons attribution"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software", "free to copy modify publish use compile sell or distribute"),
    ("boost", "distributed under the boost software license version 1 0", "boost software license"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "accompanying documentation covered by this license"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable"),
)
#: Words of a template that are indexed, and the share of them that must agree on its beginning, rounded up.
RARE_WORDS, AGREE = 4, 0.5


def _split() -> list[tuple[str, list[str], list[str], bool]]:
    """(label, words, key, base) of every template."""
    return [(label, re.findall(ITEM_WORD, text), re.findall(ITEM_WORD, key), base) for label, text, key, base in [*((x, p, p, True) for x, p in BASE), *((*t, False) for t in TEMPLATES)]]


def _indexed(words: list[str], key: list[str], base: bool) -> tuple[int, range, int, int]:
    """Of a template: where its key phrase is, what of it is not indexed, how many words are indexed, and how many must agree. A template without words outside its key is indexed under one of them."""
    key_at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
    left_out = range(0) if base or len(words) == len(key) else range(key_at, key_at + len(key))
    n = 1 if base else min(RARE_WORDS, len(words) - len(left_out))
    return key_at, left_out, n, math.ceil(n * AGREE)


def document_frequencies(cut: DataFrame) -> tuple[int, dict[str, int]]:
    """The number of rows of cut(words), and in how many of them each word of the templates occurs."""
    vocabulary = sorted({w for _, words, _, _ in _split() for w in words})
    known = F.array(*map(F.lit, vocabulary))
    counts = cut.select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect("words", known))).alias("w")).groupBy("w").agg(F.count("*").alias("df")).collect()  # a row for each word of the templates at most
    found = {r["w"]: r["df"] for r in counts}
    return found.pop("", 0), found


def index_rows(n: int, df: dict[str, int]) -> list[tuple]:
    """(word, template, at, label, words, weights, key, key_at, key_n, need, base) for the words of highest IDF of each template; of ties the first."""
    idf = lambda w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1
    rows = []
    for number, (label, words, key, base) in enumerate(_split()):
        key_at, left_out, n_indexed, need = _indexed(words, key, base)
        rarest = sorted((i for i in range(len(words)) if i not in left_out), key=lambda i: (df.get(words[i], 0), i))[:n_indexed]
        for i in rarest:
            rows.append((words[i], number, i, label, words, [idf(w) for w in words], " ".join(key), key_at, len(key), need, base))
    return rows


INDEX_SCHEMA = "word string, template int, at int, label string, t_words array<string>, weights array<double>, key string, key_at int, key_n int, need int, base boolean"


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row of docs(doc_id, text, ...).

    n_base counts the places of the base phrases, first_word and last_word are their smallest and largest starts (null without any); base_labels
    and labels (base ones, and those of templates of which enough postings agree and the key phrase is in place) are distinct, sorted and comma-joined, empty without any.
    score is the largest IDF-weighted share of a found template's wording that stands in place, to six places, 0 without any. Null or wordless texts have no
    words. Null doc_id stays null, repeated rows stay repeated (and count as documents), further columns are ignored, no rows give no rows.
    """
    spark: SparkSession = docs.sparkSession
    words = F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(ITEM_WORD), F.lit(0))
    cut = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("rid"), words.alias("words"))
    rows = index_rows(*document_frequencies(cut))
    index = F.broadcast(spark.createDataFrame(rows, INDEX_SCHEMA))  # RARE_WORDS rows for each template
    anchors = F.array(*[F.lit(w) for w in sorted({r[0] for r in rows})])
    # position -1 stands for the document itself; a document without a rare word needs no other
    last = F.when(F.arrays_overlap("words", anchors), F.size("words") - 1).otherwise(-1)
    at = cut.select("doc_id", "rid", "words", F.explode(F.sequence(F.lit(-1), last)).alias("i")).withColumn("w", F.when(F.col("i") >= 0, F.get("words", F.col("i"))))
    found = at.join(index, F.col("w") == F.col("word"), "left").where("i < 0 or template is not null")
    start = F.col("i") - F.col("at")
    key_start = start + F.col("key_at")
    key_there = F.when(key_start < 0, F.lit(False)).otherwise(F.array_join(F.slice("words", F.greatest(key_start + 1, F.lit(1)), F.col("key_n")), " ") == F.col("key"))
    weight = F.aggregate(F.sequence(F.lit(0), F.size("t_words") - 1), F.lit(0.0), lambda a, j: a + F.when((start + j >= 0) & (F.get("words", F.greatest(start + j, F.lit(0))) == F.get("t_words", j)), F.get("weights", j)).otherwise(0.0))
    whole = F.aggregate("weights", F.lit(0.0), lambda a, x: a + x)
    hits = found.select(
        "doc_id", "rid", "i", F.size("words").cast("long").alias("n"), "template", "label", "base", "at", "need",
        F.when(F.col("template").isNotNull(), start).alias("start"),
        F.when(F.col("template").isNotNull(), key_start).alias("place"),
        F.when(F.col("template").isNotNull(), weight / whole).alias("share"),
        F.when(F.col("template").isNotNull(), key_there).alias("ok"),
    ).where("i < 0 or ok")
    # the postings of one template that agree on its beginning, each counted once
    aligned = hits.groupBy("doc_id", "rid", "template", "start", "label", "base", "place", "need").agg(
        F.sum(F.when(F.col("i") < 0, 1).otherwise(0)).alias("copies"), F.max(F.when(F.col("i") < 0, F.col("n"))).alias("n"), F.max("share").alias("share"), F.bit_or(F.expr("shiftleft(1L, at)")).alias("postings")
    )
    aligned = aligned.where("template is null or bit_count(postings) >= need")
    per_doc = aligned.groupBy("doc_id", "rid").agg(
        F.sum("copies").alias("copies"),
        F.max("n").alias("n_words"),
        F.sum(F.when(F.col("base"), 1).otherwise(0)).cast("long").alias("n_base"),
        F.min(F.when(F.col("base"), F.col("place"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("place"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
    )
    return keep_rows(per_doc, "copies").select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", F.round(F.least("score", F.lit(1.0)), 6).alias("score"))


def _values() -> str:
    quote = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    return ", ".join(f"({i}, '{label}', {quote(words)}, {quote(key)}, {_indexed(words, key, base)[0]}, {_indexed(words, key, base)[2]}, {_indexed(words, key, base)[3]}, {_indexed(words, key, base)[1].start}, {_indexed(words, key, base)[1].stop}, {'true' if base else 'false'})" for i, (label, words, key, base) in enumerate(_split()))


ORACLE_SQL = f"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
t(template, label, tw, kw, key_at, indexed, need, out_from, out_to, base) as (values {_values()}),
vocab as (select distinct unnest(tw) as word from t),
df as (select word, count(*) as df from (select unnest(list_distinct(w)) as word from d) join vocab using (word) group by word),
pos as (select template, indexed, out_from, out_to, unnest(range(len(tw))) as j, unnest(tw) as word from t),
weighted as (select p.*, coalesce(df.df, 0) as df, ln(((select count(*) from d) + 1)::double / (coalesce(df.df, 0) + 1)) + 1 as weight, row_number() over (partition by template order by j >= out_from and j < out_to, coalesce(df.df, 0), j) as nth from pos p left join df using (word)),
whole as (select template, sum(weight) as total from weighted group by template),
first_words as (select template, kw[1] as word from t),
word_at as (select doc_id, unnest(w) as word, unnest(range(len(w))) as i from d),
places as (select a.doc_id, t.*, a.i as place, a.i - t.key_at as start from word_at a join first_words f using (word) join t using (template) join d using (doc_id) where d.w[a.i + 1:a.i + len(t.kw)] = t.kw),
shares as (select p.doc_id, p.template, p.start, sum(case when p.start + x.j >= 0 and d.w[greatest(p.start + x.j, 0) + 1] = x.word then x.weight else 0 end) / any_value(whole.total) as share,
             sum(case when x.nth <= x.indexed and p.start + x.j >= 0 and d.w[greatest(p.start + x.j, 0) + 1] = x.word then 1 else 0 end) as postings
           from places p join weighted x using (template) join whole using (template) join d using (doc_id) group by 1, 2, 3),
found as (select p.doc_id, p.label, p.base, p.place, s.share from places p join shares s on s.doc_id = p.doc_id and s.template = p.template and s.start = p.start where s.postings >= p.need),
g as (select doc_id, count(*) filter (where base) as n_base, min(place) filter (where base) as first_word, max(place) filter (where base) as last_word,
        string_agg(distinct label, ',' order by label) filter (where base) as base_labels, string_agg(distinct label, ',' order by label) as labels, max(share) as score from found group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(g.n_base, 0)::bigint as n_base, g.first_word::bigint as first_word, g.last_word::bigint as last_word,
       coalesce(g.base_labels, '') as base_labels, coalesce(g.labels, '') as labels, round(least(coalesce(g.score, 0), 1), 6)::double as score
from d left join g using (doc_id)
"""
