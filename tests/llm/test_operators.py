"""Each corpus operator against a brute-force version, and on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import Counter
from math import log10
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from harness import differences, second_engine
from pyspark.sql import functions as F

from tidemark.llm import bpe, common, decontaminate, html_extract, license_scan, line_dedup, ngram_jaccard, quality_rules, queries, suffix_tree, token_counts, toxicity

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, words string, rid string, key string, _doc string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def spaced(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", lower(text or "")) if w]


def docs(spark, texts, first=1):
    rows = [(i, t, "en", "s", len(t or ""), "w", "r", "k", "d") for i, t in texts] if texts and isinstance(texts[0], tuple) else [(i, t, "en", "s", len(t or ""), "w", "r", "k", "d") for i, t in enumerate(texts, first)]
    return spark.createDataFrame(rows, DOCS)


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "null id " * 30), (None, None), (7, "Ä ß é x <|endoftext|> end 's"), (8, "a" * 40_000), (9, "word " * 30_000), (10, "\n".join("line %d of many" % (i % 50) for i in range(3_000))), (11, "released under the MIT License. gone")]


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


# fmt: off
OPERATORS = {
    "op2": lambda s, d: decontaminate.contamination(d, s.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, None), (3, "gone"), (None, "word word")], "item_id long, text string")),
    "op3": lambda s, d: suffix_tree.score(d), "op4": lambda s, d: bpe.encode(d), "op5": lambda s, d: license_scan.scan(d), "op6": lambda s, d: ngram_jaccard.near_duplicates(d), "op7": lambda s, d: quality_rules.judge(d),
    "op8": lambda s, d: toxicity.score(d, s.createDataFrame([(4, 0, 0), (9, 1, 1), (11, 1, None)], "doc_id long, quality int, toxic int")),
    "op9": lambda s, d: token_counts.count_tokens(d), "op10": lambda s, d: line_dedup.removed(d),
}
# fmt: on


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_and_empty_tables(spark, name):
    table = docs(spark, ODD)
    rows = OPERATORS[name](spark, table).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in ODD)
    assert OPERATORS[name](spark, table.where("doc_id < 0")).collect() == []


def test_pages(spark):
    html = """<html><head><title>t</title><style>p{}</style></head><body><nav><a href=/>Home</a> <a href=/x>News</a></nav><div class="sidebar"><p>Side</p></div>
    <div id=main><h1>Head &amp; line</h1><p>First   paragraph of the article, with <b>bold</b> words, and more of them.<p>Second one follows, and it is long enough too.</div><div class=comments><p>Nice!</p></div><footer>(c)</footer><script>x<1</script></body></html>"""
    pages = spark.createDataFrame([(1, "u", html, "n"), (2, None, None, "n"), (None, "v", "", "n"), (4, "w", "<p>" * 3000 + "deep", "n")], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in html_extract.extract(pages).collect()}
    assert got[1]["text"] == "Head & line First paragraph of the article, with bold words, and more of them. Second one follows, and it is long enough too."
    assert (got[2]["text"], got[None]["text"], got[4]["text"]) == ("", "", "deep") and got[1]["n_chars"] == len(got[1]["text"])
    assert html_extract.extract(pages.where("page_id < 0")).collect() == []


STORY = "A long paragraph of the story, with words that go on and on for a while, and then some more of them."
LAYOUTS = [
    ("<div id=wrap><ul>" + "".join(f"<li><a href=/{i}>Link number {i}</a></li>" for i in range(40)) + "</ul><div>" + f"<p>{STORY}</p>" * 3 + "</div></div>", [STORY] * 3),
    (f'<article><h1>T</h1><p>{STORY}</p><section id="discussion"><h2>Discussion</h2><p>{STORY}</p></section><section id="legal-notice-analysis"><p>{STORY}</p></section></article>', ["T", STORY, "Discussion", STORY, STORY]),
    (f'<article><div class="article-header"><h1>Head</h1><p>By X</p></div><p>{STORY}</p><p>{STORY}</p><div class=comments><p>{STORY}</p></div></article>', ["Head", "By X", STORY, STORY]),
    ("<div class=page><div class=part1>" + f"<p>{STORY}</p>" * 3 + "</div><div class=part2>" + f"<p>{STORY}</p>" * 2 + "</div><div class=side><p>Short</p><p>teaser</p></div></div>", [STORY] * 5),
    (f'<div class="site-header">Site</div><div id=c><p>{STORY}</p><p>{STORY}</p><p>Short end.</p></div><div class="cookie-notice"><p>{STORY}</p></div>', [STORY, STORY, "Short end."]),
    (f"<div><h1>Title</h1></div><div><p>{STORY}</p><p>{STORY}</p></div>", ["Title", STORY, STORY]),
    (f"<table><tr><td><a href=x>menu</a></td><td><p>{STORY}</p><p>{STORY}</p></td></tr></table>", [STORY, STORY]),
    (f'<body><div id="discussion"><p>Hi there</p></div><article><p>{STORY}</p><aside><p>{STORY}</p></aside><form><label>Mail</label></form></article>', [STORY]),
    ("Bare &amp; plain\n text", ["Bare & plain text"]),
    *[(f'<body><div class="ad">Buy</div><article><h1>T</h1><p>{STORY}</p><section id="{name}"><h2>H</h2><p>{STORY}</p><p>{STORY}</p></section></article>', ["T", STORY, "H", STORY, STORY]) for name in ("newsletter-history", "related-work", "share-prices", "comment-period", "widgetTheory")],
    (f'<body><article><p>{STORY}</p><p>{STORY}</p><div class="related-offers"><b><i>Buy</i></b> <b><i>now</i></b></div><div aria-hidden="true"><p>{STORY}</p></div><span aria-hidden="true"><i>*</i></span></article>', [STORY] * 3),
    (f'<body><form id="form1" action="."><div id=c><p>{STORY}</p><p>{STORY}</p><p>{STORY}</p></div><input name=q><button>Go</button></form></body>', [STORY] * 3),
    (f'<body><div><p>{STORY}</p><p>{STORY}</p></div><form class="mail"><p>Write to us, and say what you think of it.</p><input></form></body>', [STORY] * 2),
    (f'<body><main><p>{STORY}</p><p>{STORY}</p><form><p>{STORY}</p><textarea>x</textarea></form></main></body>', [STORY] * 2),
    (f"<body><article><header><h1>T</h1><p>{STORY}</p></header><p>{STORY}</p></article>", ["T", STORY, STORY]),
    (f"<body><article><header><h1>T</h1><span><i>by</i> <b>X</b></span> <span><i>at</i> <b>9</b></span></header><p>{STORY}</p><p>{STORY}</p></article>", ["T", STORY, STORY]),
    *[(f'<body><article><p>{STORY}</p><p>{STORY}</p><div class="{name}"><p>{STORY}</p></div></article>', [STORY] * 2) for name in ("comments", "post-comments", "related-posts", "ad-slot", "newsletter-signup", "sidebar-left")],
]


@pytest.mark.parametrize("case", range(len(LAYOUTS)))
def test_layouts(case):
    html, blocks = LAYOUTS[case]
    assert html_extract.main_text(html) == " ".join(blocks)


def test_density_alone_gives_the_same_texts(spark, monkeypatch):
    """On all pages of the small table the density sum and the body-path threshold choose the same blocks without the tags article and main (whose pages have no parts but marked ones to lose);
    on handmade layouts the result depends on densities."""
    pages = [r["html"] for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()]
    texts = [html_extract.main_text(p) for p in pages]
    assert [html_extract.main_text(p.replace("<article", "<div").replace("</article", "</div")) for p in pages] == texts
    measure = html_extract._measure

    def flat(root):
        measure(root)
        todo = [root]
        while todo:
            node = todo.pop()
            node.density = node.total = 0.0
            todo += html_extract._parts(node)

    monkeypatch.setattr(html_extract, "_measure", flat)
    assert sum(html_extract.main_text(html) != " ".join(blocks) for html, blocks in LAYOUTS) >= 5


def test_densities_against_their_definition():
    """Counts, densities and sums of random trees, each computed anew from the node's own subtree, and the core among all blocks."""
    rng = random.Random(5)

    def grow(depth):
        tag = rng.choice(["div", "section", "p", "ul", "a", "b", "span"])
        inner = "".join(rng.choice(["text %d " % rng.randrange(1000) * rng.randrange(1, 9), grow(depth - 1)]) for _ in range(rng.randrange(1, 5))) if depth else "leaf " * rng.randrange(1, 20)
        return f"<{tag}>{inner}</{tag}>"

    def below(node):
        return [y for x in node.items if not isinstance(x, str) for y in [x, *below(x)]]

    def chars(node, link=False):
        inside = link or node.tag == "a"
        own = sum(len(x.strip()) for x in node.items if isinstance(x, str))
        parts = [chars(x, inside) for x in node.items if not isinstance(x, str)]
        return own + sum(c for c, _ in parts), (own if inside else 0) + sum(n for _, n in parts)

    for _ in range(60):
        tree = html_extract.Tree()
        tree.feed("".join(grow(4) for _ in range(3)))
        tree.close()
        root = tree.root
        html_extract._measure(root)
        c0, l0 = chars(root)
        for node in [root, *below(root)]:
            c, links = chars(node)
            tags, link_tags = len(below(node)), sum(x.tag == "a" for x in [node, *below(node)] if x is not root)
            assert (node.chars, node.tags, node.link_chars) == (c, tags, links)
            t, lc, lt = max(tags, 1), max(links, 1), max(node.link_tags, 1)
            assert node.link_tags <= link_tags
            wanted = c / t * np.log(max(c / lc * t / lt, 1) + 1) / np.log(np.log(c * links / max(c - links, 1) + l0 / max(c0, 1) * c + np.e) + 1) if c else 0
            assert abs(node.density - wanted) < 1e-9 * max(1, wanted)
            kids = [x for x in node.items if not isinstance(x, str)]
            assert abs(node.total - (sum(x.density for x in kids) or node.density)) < 1e-9 * max(1, node.total)
        blocks = [x for x in below(root) if x.tag not in html_extract.INLINE and x.chars]
        core = html_extract._core(root)
        assert not blocks or max(x.total for x in blocks) <= max(root.total, *(x.total for x in [core, *(y for y in core.items if not isinstance(y, str))]))


def test_stray_end_tags_cost_their_number():
    import time

    took = []
    for n in (4_000, 16_000):
        began = time.process_time()
        assert html_extract.main_text("<div>" * n + "x" + "</span>" * n) == "x"
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.2


def test_pages_with_odd_columns_and_repeated_rows(spark):
    html = f"<article><p>{STORY}</p></article>"
    pages = spark.createDataFrame([(1, "u", html, "x", 5), (1, "u", html, "x", 5), (3, None, "<p>" + "word " * 300_000, "x", 5)], "page_id long, url string, html string, text string, n_chars long")
    got = sorted((r["page_id"], r["url"] or "", r["n_chars"]) for r in html_extract.extract(pages).collect())
    assert got == [(1, "u", len(STORY)), (1, "u", len(STORY)), (3, "", 1_499_999)]


def test_queries_with_sql(spark):
    con = second_engine(FOLDER)
    for name, text in queries.ORACLE_SQL.items():
        df = queries.QUERIES[name](spark, FOLDER)
        assert differences(df.collect(), df.columns, con, text) == "", name


def test_lm_scores(spark, real):
    rows = {r["doc_id"]: r for r in suffix_tree.score(real).collect()}
    texts = {r["doc_id"]: r["text"] for r in real.select("doc_id", "text").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    counts = Counter(w for i, t in texts.items() if not held[i] for w in [*spaced(t), ""])
    n, v = sum(counts.values()), len(counts)
    better = 0
    for i, t in texts.items():
        words, r = [*spaced(t), ""], rows[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(words), sum(w in counts for w in words), n)
        assert abs(r["base_score"] - sum(log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)) < 1e-6 * len(words) + 1e-6
        better += held[i] and r["score"] > r["base_score"]
    assert better > 0.7 * sum(held.values())


def test_lm_scores_against_a_tree_of_dictionaries(spark, monkeypatch):
    """All states, frequent and rare, from their definition: counts, leave-one-out gains, discounts, longest suffix states."""
    for name, value in (("WORD_SHARE", 60), ("CONTEXT_SHARE", 40), ("ENTRY_SHARE", 150)):
        monkeypatch.setattr(suffix_tree, name, value)
    rng = random.Random(11)
    kinds = [["the", "cat"], ["a", "dog"], ["the", "dog", "ran"], ["and"], *([f"r{k}", f"s{k}"] for k in range(9)), *([f"u{k}"] for k in range(9))]
    speak = lambda: " ".join(w for _ in range(rng.randrange(1, 12)) for w in kinds[min(int(rng.expovariate(0.2)), len(kinds) - 1)])
    texts = {i: speak() for i in range(120)}
    train = [[*t.split(), ""] for i, t in texts.items() if zlib.crc32(str(i).encode()) % 10]
    counts = Counter(w for t in train for w in t)
    n, v = sum(counts.values()), len(counts)
    whole, d = n + 0.1 * (v + 1), suffix_tree.DISCOUNT
    frequent = {w for w, c in counts.items() if w and c >= max(2, n / 60)}
    sym = lambda w: w if w in frequent or w == "" else "?"
    root = {w: (counts[w] + 0.1) / whole for w in [*frequent, ""]}
    root["?"] = 1 - sum(root.values())
    follow: dict = {}
    for t in train:
        for i in range(1, len(t)):
            one = sym(t[i - 1])
            follow.setdefault((one,), Counter())[sym(t[i])] += 1
            if one == "?":
                follow.setdefault(("rare", t[i - 1]), Counter())[sym(t[i])] += 1
            if i > 1:
                follow.setdefault((sym(t[i - 2]), one), Counter())[sym(t[i])] += 1
    pairs = {c for c in follow if len(c) == 2 and c[0] != "rare" and follow[(c[0],)][c[1]] >= max(2, n / 40)}

    def state(context, lower, least):
        """(probability of a symbol, whether the context is retained)."""
        seen, total = {w: c for w, c in follow[context].items() if c >= least}, sum(follow[context].values())
        weight = 1 - sum(max(c - d, 0) for c in seen.values()) / total
        p = lambda w: max(seen.get(w, 0) - d, 0) / total + weight * lower(w)
        gain = sum(c * np.log((max(c - 1 - d, 0) / max(total - 1, 1) + weight * lower(w)) / lower(w)) for w, c in seen.items()) + (total - sum(seen.values())) * np.log(max(weight, 1e-12))
        return p, gain > suffix_tree.DIVERGENCE * total

    least = max(2, n / 150)
    ones = {c: state(c, root.__getitem__, least) for c in follow if len(c) == 1 and c != ("",)}
    twos = {c: state(c, ones[c[1:]][0], least) for c in pairs}
    kept = {c for c, (_, keep) in ones.items() if keep} | {c[1:] for c, (_, keep) in twos.items() if keep}
    at = lambda one: ones[(one,)][0] if (one,) in kept else root.__getitem__
    rare = {c[1]: state(c, at("?"), 0) for c in follow if c[0] == "rare" and sum(follow[c].values()) >= suffix_tree.LEAST_CONTEXT}
    assert any(keep for _, keep in rare.values()) and any(keep for _, keep in twos.values())
    got = {r["doc_id"]: r["score"] for r in suffix_tree.score(docs(spark, list(texts.items()))).collect()}
    for i, t in texts.items():
        words, total = [*t.split(), ""], 0.0
        for k, w in enumerate(words):
            p = root.__getitem__
            if k:
                one = sym(words[k - 1])
                two = twos.get((sym(words[k - 2]), one), (None, False)) if k > 1 else (None, False)
                p = rare[words[k - 1]][0] if rare.get(words[k - 1], (None, False))[1] else two[0] if two[1] else at(one)
            inside = (counts[w] + 0.1) / whole / root["?"] if sym(w) == "?" else 1.0
            total += log10(p(sym(w)) * inside)
        assert abs(got[i] - total) < 1e-6 * len(words), (i, t, got[i], total)


def test_lm_scores_without_shares(spark, monkeypatch):
    """No context and no entry is dropped for being seldom: every state from its definition, with branches divided over many buckets and in one."""
    rng = random.Random(12)
    names = [f"w{k}" for k in range(40)] + ["once%d" % k for k in range(60)]
    speak = lambda: [names[min(int(rng.expovariate(0.08)), 99)] for _ in range(rng.randrange(0, 25))]
    texts = {i: speak() for i in range(150)}
    texts |= {i: [*texts[i - 150], *texts[i - 150][:3]] for i in range(150, 220)}  # copies make contexts of two
    train = [[*t, ""] for i, t in texts.items() if zlib.crc32(str(i).encode()) % 10]
    counts = Counter(w for t in train for w in t)
    n, v = sum(counts.values()), len(counts)
    whole, d = n + 0.1 * (v + 1), suffix_tree.DISCOUNT
    monkeypatch.setattr(suffix_tree, "WORD_SHARE", 100)
    frequent = {w for w, c in counts.items() if w and c >= n / 100}
    sym = lambda w: w if w in frequent or w == "" else "?"
    root = {w: (counts[w] + 0.1) / whole for w in [*frequent, ""]}
    root["?"] = 1 - sum(root.values())
    follow: dict = {}
    for t in train:
        for i in range(1, len(t)):
            for c in [(sym(t[i - 1]),), *([("rare", t[i - 1])] if sym(t[i - 1]) == "?" else []), *([(sym(t[i - 2]), sym(t[i - 1]))] if i > 1 else [])]:
                follow.setdefault(c, Counter())[sym(t[i])] += 1

    def state(context, lower):
        seen, total = follow[context], sum(follow[context].values())
        weight = 1 - sum(c - d for c in seen.values()) / total
        gain = sum(c * np.log((max(c - 1 - d, 0) / max(total - 1, 1) + weight * lower(w)) / lower(w)) for w, c in seen.items())
        return (lambda w: max(seen.get(w, 0) - d, 0) / total + weight * lower(w)), gain > suffix_tree.DIVERGENCE * total

    ones = {c: state(c, root.__getitem__) for c in follow if len(c) == 1}
    twos = {c: state(c, ones[c[1:]][0]) for c in follow if len(c) == 2 and c[0] != "rare"}
    kept = {c for c, (_, keep) in ones.items() if keep} | {c[1:] for c, (_, keep) in twos.items() if keep}
    at = lambda one: ones[(one,)][0] if (one,) in kept else root.__getitem__
    rare = {c[1]: state(c, at("?")) for c in follow if c[0] == "rare"}
    assert any(keep and sum(follow[c].values()) < 5 for c, (_, keep) in twos.items()) and any(keep and sum(follow["rare", w].values()) < 4 for w, (_, keep) in rare.items())
    wanted = {}
    for i, t in texts.items():
        wanted[i], words = 0.0, [*t, ""]
        for k, w in enumerate(words):
            p = root.__getitem__
            if k:
                two = twos.get((sym(words[k - 2]), sym(words[k - 1])), (None, False)) if k > 1 else (None, False)
                p = rare[words[k - 1]][0] if rare.get(words[k - 1], (None, False))[1] else two[0] if two[1] else at(sym(words[k - 1]))
            wanted[i] += log10(p(sym(w)) * ((counts[w] + 0.1) / whole / root["?"] if sym(w) == "?" else 1.0))
    table = docs(spark, [(i, " ".join(t)) for i, t in texts.items()])
    for bucket in (60, 1_000_000):
        monkeypatch.setattr(suffix_tree, "BUCKET", bucket)
        got = {r["doc_id"]: r["score"] for r in suffix_tree.score(table).collect()}
        assert got.keys() == wanted.keys() and all(abs(got[i] - wanted[i]) < 1e-6 * (len(texts[i]) + 1) for i in texts), bucket


def test_lm_places_of_a_frequent_pair_are_dealt_out(spark, monkeypatch):
    """No bucket has most places because two symbols stand together everywhere, counts travel in small batches, and scores don't depend on how places are dealt."""
    rng = random.Random(13)
    texts = [(i, " ".join(rng.choice(["new york", "new york city", "york new", "a b", f"rare{i}"]) for _ in range(20))) for i in range(400)]
    table = docs(spark, texts)
    wanted = {r["doc_id"]: r["score"] for r in suffix_tree.score(table).collect()}
    for name, value in (("BUCKET", 200), ("PACKED_BYTES", 500), ("GROWN", 100), ("COUNT_BYTES", 50)):
        monkeypatch.setattr(suffix_tree, name, value)
    got = {r["doc_id"]: r["score"] for r in suffix_tree.score(table).collect()}
    assert got.keys() == wanted.keys() and all(abs(got[i] - wanted[i]) < 1e-4 for i in wanted)
    keyed = table.select("doc_id", "text", F.lit(False).alias("held_out"))
    model = suffix_tree.train(keyed)[0]
    most = suffix_tree.packed(keyed, model).where(F.col("kind") == suffix_tree.PLACES).groupBy("bucket").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0]
    assert len(model.pairs) and most < 5 * suffix_tree.BUCKET, most


def test_tree_is_a_distribution():
    p = np.array([0.1, 0.2, 0.3, 0.25, 0.15])
    single = np.array([2, 3])
    c1 = [(0, 2, 7), (0, 3, 3), (0, 0, 2), (1, 2, 4), (1, 4, 6)]
    total1 = np.array([14.0, 12.0])
    c2 = [(0, 3, 4), (0, 4, 1)]
    as_arrays = lambda c: tuple(np.array(x, np.int64) for x in zip(*c))
    tree = suffix_tree._grow({}, p, single, np.array([(2 << 32) | 2]), as_arrays(c1), total1, as_arrays(c2), np.array([7.0]))
    for state in range(len(tree.back)):
        total = sum(10 ** tree.log10(np.array([state]), np.array([s]))[0] for s in range(5))
        assert total <= 1 + 1e-9 and total > 0.9, (state, total)


def test_bpe_and_counts_match_the_library(spark, real):
    from tokenizers import Tokenizer

    word, byte = Tokenizer.from_file(bpe.vocabulary_path()), Tokenizer.from_file(bpe.vocabulary_path("byte_bpe_50k.json"))
    for t in (word, byte):
        t.no_truncation(), t.no_padding()
    extra = docs(spark, [(i, t) for i, t in ODD if i is not None and i != 4] + [(50, "İstanbul ǅ ﬁ ½ \x1c\x1f x́ 日本語 👩‍👩‍👧 don't DON'T 12345 <|startoftext|>a<|endoftext|>")], 1000)
    table = real.select("doc_id", "text").unionByName(extra.selectExpr("doc_id + 100000 as doc_id", "text"))
    texts = {r["doc_id"]: r["text"] or "" for r in table.collect()}
    for r in bpe.encode(table, keep_text=True).collect():
        ids = word.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["decoded"] == word.decode(ids, skip_special_tokens=False)
        assert r["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
    for r in token_counts.count_tokens(table).collect():
        assert r["n_tokens"] == len(byte.encode(texts[r["doc_id"]], add_special_tokens=False).ids), r["doc_id"]
        assert r["n_bytes"] == len(texts[r["doc_id"]].encode()) and r["over_limit"] == (r["n_tokens"] > 512)


def test_licences(spark, real):
    texts = {r["doc_id"]: r["text"] for r in real.select("doc_id", "text").collect()}
    for r in license_scan.scan(real).collect():
        words = WORD.findall(lower(texts[r["doc_id"]] or ""))
        places = [(i, label) for i in range(len(words)) for label, phrase in license_scan.BASE if words[i : i + len(phrase.split())] == phrase.split()]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == (min(places)[0] if places else None, max(places)[0] if places else None)
        base = sorted({x for _, x in places})
        assert r["base_labels"] == ",".join(base) and set(base) <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1


def test_licence_texts(spark):
    """Whole clauses, whatever their case and punctuation, give their label; a key phrase alone, or postings that stand elsewhere, do not."""
    clause = {label: text for label, text, _ in license_scan.TEMPLATES}
    texts = [
        f"Header of a file. {clause['isc'].upper()}, and more.",
        "is subject to terms. Mozilla Public License, says someone",
        "permitted conditions source and binary forms, with or without modification. Redistribution following provided met",
        "Licensed under CC-BY-NC 4.0.",
        " ".join(f"{w}," for w in clause["bsd-3-clause"].split()),
        "under the terms of the MIT license " * 3,
        None,
    ]
    rows = sorted(license_scan.scan(docs(spark, texts)).collect(), key=lambda r: r["doc_id"])
    assert [r["labels"] for r in rows] == ["isc", "", "", "cc-by-nc", "bsd-3-clause", "mit", ""]
    assert rows[0]["score"] == rows[3]["score"] == 1.0 and rows[5]["n_base"] == 3 and (rows[5]["first_word"], rows[5]["last_word"]) == (5, 19)


def variants(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return out


def test_jaccard_join(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(25):
        base = [f"t{rng.randrange(3000)}" for _ in range(rng.choice([1, 3, 8, 60, 120]))]
        texts += [" ".join(variants(rng, base, rng.choice([0, 0, 1, 2, 4]))) for _ in range(rng.randrange(1, 6))]
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    label = list(range(len(texts)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if 100 * same >= 80 * (len(sets[i]) + len(sets[j]) - same):
                a, b = sorted((top(i), top(j)))
                label[b] = a
    table = docs(spark, texts, 0)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard.near_duplicates(table).collect()}
    assert got == {i: (len(sets[i]), top(i)) for i in range(len(texts))}
    assert {r["doc_id"] for r in ngram_jaccard.one_of_each(table).collect()} == {top(i) for i in range(len(texts))}


def test_spans_or_documents_go(spark):
    table = docs(spark, ["A clean text of some words", "Begin, a b c d e f g h i j end of it", None], 1)
    items = spark.createDataFrame([(1, "A B C D E F G H I J")], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.decontaminate(table, items).collect()} == {1, 3}
    cut = decontaminate.decontaminate(table, items, remove="spans")
    assert cut.columns == table.columns and {r["doc_id"]: r["text"] for r in cut.collect()} == {1: "A clean text of some words", 2: "Begin, end of it", 3: None}


def spelt(lines):
    return line_dedup.encoded(lines.letters(), lines.count).to_pylist()


def test_columns_that_clash(spark):
    """Input columns with the names of an operator's own stay as they are."""
    names = ["_words", "_lead", "_hit", "_spans", "_id", "_rid", "_doc", "_row", "_key", "p_toxic", "rest", "alt", "label"]
    table = docs(spark, ["Begin, a b c d e f g h i j end of it", "clean words\nsecond line", None], 1).drop("_doc", "key", "rid", "words")
    for c in names:
        table = table.withColumn(c, F.lit(c))
    items = spark.createDataFrame([(1, "A B C D E F G H I J")], "item_id long, text string")
    labels = spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int")
    for out, n in ((decontaminate.decontaminate(table, items), 2), (decontaminate.decontaminate(table, items, remove="spans"), 3), (toxicity.remove_toxic(table, labels), 3), (line_dedup.without_repeated_lines(table), 3), (ngram_jaccard.one_of_each(table), 3)):
        rows = out.collect()
        assert out.columns == table.columns and len(rows) == n and all(r[c] == c for r in rows for c in names)


def test_decontamination_beyond_the_broadcast(spark, real, monkeypatch):
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet").unionByName(spark.createDataFrame([(10**6, "the"), (None, "of the"), (10**6 + 1, None)], "item_id long, text string"))
    table = real.unionByName(docs(spark, [(i, t) for i, t in ODD]).select(*real.columns))
    wanted = Counter(tuple(r) for r in decontaminate.contamination(table, items).collect())
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    assert Counter(tuple(r) for r in decontaminate.contamination(table, items).collect()) == wanted and any(r[2] for r in wanted)


def test_repeated_rows_are_one_document_of_their_host(spark):
    common = "a line that many documents have in common"
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    many = quality_rules.LINE_DOCS + 1
    once = docs(spark, [(i, f"{common}\n{own(i)}") for i in range(many)])
    again = docs(spark, [(1 if i < 5 else i, f"{common}\n{own(i)}") for i in range(many)])
    assert {r["n_line_words"] for r in quality_rules.judge(once).collect()} == {8}
    assert {r["n_line_words"] for r in quality_rules.judge(again).collect()} == {0}


def test_cut_leaves_no_shuffle_files(spark):
    """However long the driver keeps what the plan refers to."""
    root = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f.name for d in root for f in Path(d).rglob("shuffle_*.data")}
    before, table = files(), spark.range(100_000).repartition(3, "id")
    kept = common.cut(table, "cut")
    end = time.monotonic() + 20
    while files() - before and time.monotonic() < end:
        time.sleep(0.2)
    assert not files() - before and kept.count() == 100_000
    assert spark.conf.get(common.CLEANUP) == "false"
    common.drop_cut(kept)


def test_tiles_in_waves(spark, monkeypatch):
    """Waves, each with a part of the tiles, find what all tiles at once find."""
    monkeypatch.setattr(ngram_jaccard, "TILE_SETS", 8)
    rng = random.Random(5)
    rows = sorted({(fp, rng.choice([1, 1, 2, fp]), comp) for fp in range(60) for comp in rng.sample(range(4), 2)})
    label = {fp: x for fp, x, _ in rows}
    members = spark.createDataFrame([(fp, label[fp], comp) for fp, _, comp in rows], "fp long, label long, comp long")
    sets = spark.createDataFrame([(fp, fp % 7) for fp in label], "fp long, rest long")

    def run(table):
        x = table.to_pylist()
        found = [(i["label"], j["label"]) for i in x for j in x if i["label"] < j["label"] and i["rest"] == j["rest"]]
        return pa.table({"src": pa.array([i for i, _ in found], pa.int64()), "dst": pa.array([j for _, j in found], pa.int64())})

    stored = []
    monkeypatch.setattr(ngram_jaccard, "cut", lambda df, name: stored.append(name) or common.cut(df, name))
    links = lambda **more: {tuple(r) for r in ngram_jaccard.tiled_links(members, sets, run, **more).collect()}
    whole = links()
    assert whole and links(at_once=100) == whole and stored.count("links") > 2


def test_line_dedup(spark):
    rng = random.Random(4)
    bases = [[f"l{rng.randrange(5000)}" for _ in range(rng.choice([1, 2, 6, 40, 150, 400]))] for _ in range(30)]
    texts = ["\n".join(" ".join(variants(rng, rng.choice(bases), rng.choice([0, 0, 0, 1, 3]))) + rng.choice(["", ".", "!"]) for _ in range(rng.randrange(1, 7))) + rng.choice(["", "\n\n---"]) for _ in range(40)]
    lines = line_dedup.Lines(pa.array(texts))
    letters = spelt(lines)
    plain = [WORD.findall(lower(texts[r].split("\n")[p])) for r, p in zip(lines.row, lines.place)]
    assert [len(x) for x in plain] == lines.count.tolist() and sum(len(WORD.findall(x)) > 0 for t in texts for x in t.split("\n")) == len(plain)
    by_key: dict = {}
    for k, words in zip(lines.key, plain):
        assert by_key.setdefault(int(k), words) == words
    label = list(range(len(plain)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(plain)):
        for j in range(i):
            linked = plain[i] == plain[j]
            if not linked:
                most = line_dedup.most_edits(len(plain[i]), len(plain[j]))
                linked = line_dedup.edits(letters[i], letters[j], most) <= most
            if linked:
                a, b = sorted((top(i), top(j)))
                label[b] = a
    seen, gone = set(), Counter()
    for i in sorted(range(len(plain)), key=lambda i: (lines.row[i], lines.place[i])):
        gone[int(lines.row[i])] += top(i) in seen
        seen.add(top(i))
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"]) for r in line_dedup.removed(docs(spark, texts, 0)).collect()}
    total = Counter(lines.row.tolist())
    assert got == {i: (total[i], gone[i]) for i in range(len(texts))}
    left = line_dedup.without_repeated_lines(docs(spark, texts, 0)).collect()
    assert {r["doc_id"] for r in left} == {i for i in range(len(texts)) if gone[i] < total[i] or not gone[i]} and all(r["n_chars"] == len(r["text"]) for r in left)


def test_line_dedup_finds_every_similar_line(spark):
    """Against plain word edit similarity, without a rule for candidates: edits spread over lines of frequent words, up to the most that are allowed."""
    rng = random.Random(7)
    spell = lambda: f"w{int(rng.paretovariate(0.7)) % 900}"
    plain = []
    for n in (4, 5, 6, 7, 9, 10, 15, 19, 30, 31, 60, 120):
        for _ in range(6):
            base = [spell() for _ in range(n)]
            plain.append(base)
            for share in (1, 0.5):
                line = list(base)
                step = max(1, len(line) // max(1, int(line_dedup.most_edits(n, n) * share)))
                for k in range(int(line_dedup.most_edits(n, n) * share)):
                    line[min(k * step + step // 2, n - 1)] = f"new{rng.randrange(10**6)}"
                plain.append(line)
            plain.append([*base, "more"])
    rng.shuffle(plain)
    letters = spelt(line_dedup.Lines(pa.array([" ".join(x) for x in plain])))
    label = list(range(len(plain)))
    for i in range(len(plain)):
        for j in range(i):
            most = line_dedup.most_edits(len(plain[i]), len(plain[j]))
            if label[i] != label[j] and line_dedup.edits(letters[i], letters[j], most) <= most:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.removed(docs(spark, [" ".join(x) for x in plain], 0)).collect()}
    assert got == {i: int(label[i] != i) for i in range(len(plain))}


def test_line_dedup_long_lists(spark, monkeypatch):
    """Lines that share a rare beginning meet in one long list; only some of them are similar. Several blocks to a list, and rows of one line in many batches."""
    from tidemark.llm import ngram_jaccard as other

    monkeypatch.setattr(other, "TILE_SETS", 16)
    monkeypatch.setattr(line_dedup, "HOT_ROWS", 1)
    rng = random.Random(9)
    start = "quite rare words begin this line".split()
    plain = []
    for _ in range(40):
        base = start + [f"w{rng.randrange(60)}" for _ in range(12)]
        plain += [variants(rng, base, rng.choice([0, 1, 2, 3])) for _ in range(rng.randrange(1, 5))]
    letters = spelt(line_dedup.Lines(pa.array([" ".join(x) for x in plain])))
    label = list(range(len(plain)))
    for i in range(len(plain)):
        for j in range(i):
            most = line_dedup.most_edits(len(plain[i]), len(plain[j]))
            if label[i] != label[j] and line_dedup.edits(letters[i], letters[j], most) <= most:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    table = docs(spark, [" ".join(x) for x in plain], 0).repartition(8)
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.removed(table).collect()}
    assert got == {i: int(label[i] != i) for i in range(len(plain))} and len(set(label)) > 20


def linked_by_edits(plain):
    """The smallest line of each connected group, from all pairs."""
    letters, label = spelt(line_dedup.Lines(pa.array([" ".join(x) for x in plain]))), list(range(len(plain)))
    for i in range(len(plain)):
        for j in range(i):
            most = line_dedup.most_edits(len(plain[i]), len(plain[j]))
            if label[i] != label[j] and line_dedup.edits(letters[i], letters[j], most) <= most:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


def test_line_dedup_places(spark):
    """Lines that share a phrase at places that the allowed edits cannot bring together never become pairs."""
    phrase = "six quite rare words stand here".split()
    plain = [[f"w{k}x{i % 3}" for i in range(60)] for k in range(6)]
    plain = [x[: 12 * k] + phrase + x[12 * k :] for k, x in enumerate(plain)]
    lines = line_dedup.line_table(docs(spark, [" ".join(x) for x in plain], 0)).persist()
    classes = lines.where("key is not null").groupBy("key").agg(F.count("letters").alias("batches"), F.sum(F.octet_length("letters") / 2).cast("long").alias("listings"))
    assert line_dedup.candidates(lines, classes).where("a <> b").isEmpty()
    lines.unpersist()


@pytest.mark.parametrize("long", [4096, 20])
def test_line_dedup_lists_at_places(spark, monkeypatch, long):
    """Long lists of lines with one phrase at many places, with words that come again and again, whole and (beyond `long` classes) in tiles."""
    monkeypatch.setattr(line_dedup, "LONG", long)
    monkeypatch.setattr(line_dedup, "LIST_ROWS", 30)
    monkeypatch.setattr(line_dedup, "SEEN", 2)
    rng = random.Random(11)
    phrase, plain = "quite rare words begin here".split(), []
    for k in range(30):
        base = [f"w{rng.randrange(40)}" for _ in range(k)] + phrase + [f"w{rng.randrange(40)}" for _ in range(rng.randrange(8, 30))]
        plain += [variants(rng, base, rng.choice([0, 1, 2, 3])) for _ in range(rng.randrange(1, 4))]
        again = ["over"] * (20 + k) + phrase + ["and"] * (10 + 2 * k)
        plain += [again, again[1:] + ["end"], [f"n{k}"] * 3 + again]
    label = linked_by_edits(plain)
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.removed(docs(spark, [" ".join(x) for x in plain], 0)).collect()}
    assert got == {i: int(label[i] != i) for i in range(len(plain))} and len(set(label)) > 20


@pytest.mark.parametrize("seed", range(3))
def test_edits(seed):
    rng = random.Random(seed)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(9))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
        for most in range(8):
            assert line_dedup.edits(a, b, most) == min(row[-1], most + 1), (a, b, most)


def newton(x, y, penalty=toxicity.PENALTY):
    """Ridge logistic regression by Newton's method: mean log loss plus half the penalty times the squared weights, intercept free."""
    x = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(x.shape[1]), np.diag([penalty] * (x.shape[1] - 1) + [1e-12])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) / len(x) + ridge, x.T @ (p - y) / len(x) + ridge @ w)
    return lambda z: 1 / (1 + np.exp(-np.column_stack([z, np.ones(len(z))]) @ w))


def test_chain_against_brute_force(spark):
    """Words by their definition, out-of-fold predictions and Newton's method, against the chain on a small table."""
    rng = random.Random(21)
    texts, quality, toxic = [], [], []
    for _ in range(240):
        bad, poor = rng.random() < 0.4, rng.random() < 0.5
        words = [f"plain{rng.randrange(30)}" for _ in range(12)]
        words += [rng.choice(["venom", "venomous", "spite"])] * (rng.random() < (0.85 if bad else 0.06)) + [rng.choice(["junkier", "junkiest"])] * (rng.random() < (0.8 if poor else 0.1))
        texts.append(" ".join(words))
        toxic.append(int(bad or poor and rng.random() < 0.3))
        quality.append(int(not poor))
    table = docs(spark, texts)
    labels = spark.createDataFrame([(i, q, t) for i, (q, t) in enumerate(zip(quality, toxic), 1)], "doc_id long, quality int, toxic int")
    fold = {r[0]: r[1] for r in labels.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(toxicity.FOLDS))).collect()}
    fold = np.array([fold[i] for i in range(1, len(texts) + 1)])
    sets = [set(t.split()) | {"^" + w[:k] for w in t.split() for k in toxicity.BEGINNINGS if len(w) > k} for t in texts]
    counts, targets, chosen = Counter(w for s in sets for w in s), {"low_quality": 1 - np.array(quality), "toxic": np.array(toxic)}, set()
    for y in targets.values():
        share = y.mean()
        far = {w: abs(sum(y[i] for i, s in enumerate(sets) if w in s) - n * share) / np.sqrt(n * share * (1 - share)) for w, n in counts.items() if n >= toxicity.WORD_DOCS}
        chosen |= {w for w, d in far.items() if d >= toxicity.DISTANCE}
    x = np.array([[w in s for w in sorted(chosen)] for s in sets], float)
    first = newton(x, targets["low_quality"])(x)
    out_of_fold = np.zeros(len(x))
    for k in range(toxicity.FOLDS):
        out_of_fold[fold == k] = newton(x[fold != k], targets["low_quality"][fold != k])(x[fold == k])
    second = newton(np.column_stack([x, out_of_fold]), targets["toxic"])(np.column_stack([x, first]))
    chain = toxicity.train(table, toxicity.from_quality(labels))
    assert set(chain.words) == chosen and len(chosen) >= 4
    got = {r["doc_id"]: r for r in chain.scored(table).collect()}
    assert max(abs(got[i]["p_low_quality"] - p) for i, p in enumerate(first, 1)) < 0.01
    assert max(abs(got[i]["p_toxic"] - p) for i, p in enumerate(second, 1)) < 0.01


def test_toxicity_on_unseen_documents(spark):
    folder = "/root/testdata/sf0.1"
    all_docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    seen = "pmod(doc_id, 3) <> 0"
    scored = toxicity.train(all_docs.where(seen), toxicity.from_quality(labels.where(seen))).scored(all_docs.where("pmod(doc_id, 3) = 0"))
    rows = scored.join(labels, "doc_id").select("p_toxic", "toxic").collect()
    right = sum((r["p_toxic"] >= toxicity.THRESHOLD) == (r["toxic"] == 1) for r in rows)
    assert right >= 0.95 * len(rows)
