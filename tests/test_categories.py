"""Categories of texts beyond ASCII against the second engine's patterns."""

import duckdb
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.plans.ingest import ORACLE_SQL


def test_words_end_at_letters_beyond_ascii(spark):
    """Word boundaries are ASCII ones, the vertical tab is no blank, the Kelvin sign is a k and the long s an s."""
    words = ["ñmillie", "millieé", "a millie", "amillie", "spſ", "ſps", "ſnail", "snailſ", "Kenya", "aKenya", "star polyp", "star\x0bpolyp", "star polyp", "torch́", "plate", "éplate", "plate – 5g", "torch – 5g", "torch –5g", "torch é5g", "torch §5g", "torch ·5g", "clam\U0001f41a", "𝐀clam", "", None]
    rows = [(i, w) for i, w in enumerate(words)]
    found = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", text.infer_category(F.lit(None), F.lit(None), F.col("text")).alias("category")).collect()
    con = duckdb.connect()
    con.sql("create table documents (doc_id bigint, source varchar, lang varchar, text varchar)")
    con.executemany("insert into documents values (?, null, null, ?)", rows)
    con.sql("create table events as select 0::bigint as event_id, 0::bigint as user_id, timestamp '2024-01-01' as ts, '' as event_type, 0::double as value where false")
    want = con.sql(ORACLE_SQL["inferred_categories"]).fetchall()
    assert sorted(map(tuple, found)) == sorted(want) and {"sps", "softie", "lps", "clam", None} <= {w[1] for w in want}


def test_all_patterns_are_sought_in_one_pass(spark):
    """Texts without a category, nearly all of a table of documents, are read once for all patterns, which Java would seek one after the other."""
    rows = spark.createDataFrame([(1, "reef tank " * 50_000), (2, "reef tank " * 50_000 + "torch")], "id long, text string").select("id", text.infer_category(F.lit("x"), F.array(F.lit(None).cast("string"), F.lit("y")), F.col("text")).alias("category"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan.upper() and plan.count("ArrowEvalPython") == 1
    assert [r["category"] for r in rows.orderBy("id").collect()] == [None, "lps"]
