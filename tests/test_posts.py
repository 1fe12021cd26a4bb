"""Known small cases of the text of posts."""

from pyspark.sql import functions as F

from tidemark.functions import posts


def one(spark, text, make):
    return spark.createDataFrame([(text,)], "t string").select(make(F.col("t")).alias("x")).first()["x"]


def test_names(spark):
    cases = {
        "Rainbow Showpiece WYSIWYG": "Rainbow Showpiece",
        "WYSIWYG Frag": None,
        "Frag Pack of Chalices": None,
        "Gold Torch (WYSIWYG) - ": "Gold Torch",
        "Eye of the Storm Chalice": "Eye of the Storm Chalice",
        "Pilot acan 3-pack": "Pilot acan",
        "Chalices": "Chalices",
        "WYSIWYG": None,
        "": None,
        None: None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", posts.descriptive_name(F.col("t")).alias("x")).collect()
    assert {r["t"]: r["x"] for r in rows} == cases


def test_nouns_and_fish(spark):
    assert one(spark, "Acans and Gold Torch acan coral", posts.type_nouns) == ["acan", "torch", "coral"]
    assert one(spark, None, posts.type_nouns) == []
    assert one(spark, "Clownfish & Anemone Tang, clownfish; Butterflyfish", posts.fish_terms) == ["butterflyfish", "clownfish", "tang"]
    assert one(spark, "Starfish", posts.fish_terms) == [] == one(spark, None, posts.fish_terms)


def test_tags(spark):
    tags = lambda lineage, branded, families=None: one(spark, "Torch Acan zoa coral torch", lambda c: posts.post_tags(posts.type_tags(c, families), F.lit(lineage).cast("string"), F.lit(branded).cast("string")))
    common = list(posts.COMMON_TAGS)
    assert tags(None, None) == ["#torch", "#acan", "#zoa", *common]
    assert tags("#acan", "#shop") == ["#torch", "#zoa", *common, "#acan[verify live tag-feed]", "#shop[verify vendor branded tag]"]
    many = {"torch": [f"#t{i}" for i in range(9)], "zoa": ["#t1", "#zoas"]}
    assert tags("#x", "#y", many) == [*many["torch"], "#acan", "#x[verify live tag-feed]", "#y[verify vendor branded tag]"]


def test_captions_and_files(spark):
    plan = lambda text: tuple(one(spark, text, posts.caption_plan))
    assert plan("a" * 1024) == ("a" * 1024, None) and plan("a" * 1025) == (None, "a" * 1025)
    assert plan(" \n") == plan(None) == (None, None) and plan(" b\n") == ("b", None)
    files = spark.createDataFrame([(f"/r/{x}",) for x in ("a.mp4", "a.txt", "b.c.mp4", "b.txt", "done/d.mp4", "e.txt")], "path string")
    assert sorted(map(tuple, posts.pair_files(files, "/r").collect())) == [("/r/a.mp4", "/r/a.txt"), ("/r/b.c.mp4", None)]
