"""The queries over the text of posts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import posts
from ..functions.labels import EDGE_WORDS, FISH_NOUNS, MECHANISM_WORDS, TYPE_NOUNS
from ..operators.common import plain
from ..sources.adapters import Model
from .oracle import sql


def _in(values) -> str:
    return ", ".join(f"'{x}'" for x in values)


def _cleaned_sql() -> str:
    rest = f"regexp_replace(raw_title, '{'|'.join(MECHANISM_WORDS)}', '', 'gi')"
    spaced = f"array_to_string(list_filter(regexp_split_to_array(regexp_replace({rest}, '\\(\\s*\\)', ' ', 'g'), '\\s+'), lambda t: t <> ''), ' ')"
    for mark in ",.;:":
        spaced = f"replace({spaced}, ' {mark}', '{mark}')"
    return f"trim({spaced}, ' -–—,')"


CLEANED = f"cleaned as (select id, {_cleaned_sql()} as name from listings)"
TOKENS = "tokens as (select id, unnest(regexp_extract_all(lower(raw_title), '[a-z]+')) as t from listings)"
NOUNS = f"nouns as (select distinct id, case when t in ({_in(TYPE_NOUNS)}) then t else left(t, len(t) - 1) end as noun from tokens where t in ({_in(TYPE_NOUNS)}) or (t like '%s' and left(t, len(t) - 1) in ({_in(TYPE_NOUNS)})))"
PARTS = "parts as (select id, name, string_split(name, ' ') as w, regexp_extract_all(lower(name), '[a-z]+') as a from cleaned)"
EDGE = " or ".join(f"trim(lower(w[{i}]), ',.;:') in ({_in(EDGE_WORDS)})" for i in (1, -1))
HAS_NOUN = f"exists (select 1 from (select id, unnest(a) as t from parts) x where x.id = p.id and (t in ({_in(TYPE_NOUNS)}) or (t like '%s' and left(t, len(t) - 1) in ({_in(TYPE_NOUNS)}))))"

_Q = {
    "descriptive_names": (
        lambda m: m.listings.select("id", posts.clean_title(F.col("raw_title")).alias("cleaned"), posts.descriptive_name(F.col("raw_title")).alias("name")),
        sql(f"select id, name as cleaned, case when name <> '' and not ({EDGE}) and (len(a) >= 2 or {HAS_NOUN}) then name end as name from parts p", CLEANED, PARTS),
    ),
    "type_nouns": (
        lambda m: m.listings.select("id", F.array_join(F.array_sort(posts.type_nouns(F.col("raw_title"))), ",").alias("nouns")),
        sql("select l.id, coalesce(string_agg(noun, ',' order by noun), '') as nouns from listings l left join nouns n on n.id = l.id group by l.id", TOKENS, NOUNS),
    ),
    "fish_terms": (
        lambda m: m.listings.select("id", F.array_join(posts.fish_terms(F.col("raw_title")), ",").alias("terms")),
        sql(f"select l.id, coalesce(string_agg(distinct t, ',' order by t), '') as terms from listings l left join (select * from tokens where t in ({_in(FISH_NOUNS)})) n on n.id = l.id group by l.id", TOKENS),
    ),
    "caption_plan": (
        lambda m: m.listings.select("id", posts.caption_plan(F.repeat("raw_title", (F.col("id") % 100).cast("int"))).alias("plan")).select("id", "plan.*"),
        sql("select id, case when length(c) <= 1024 then nullif(c, '') end as attached, case when length(c) > 1024 then c end as follow_up from (select id, trim(repeat(raw_title, (id % 100)::int)) as c from listings)"),
    ),
}

QUERIES = {name: (lambda spark, folder, make=make: plain(make(Model(spark, folder)))) for name, (make, _) in _Q.items()}
ORACLE_SQL = {name: query for name, (_, query) in _Q.items() if query}
