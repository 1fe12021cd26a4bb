"""Spelling variants, web archives and whitening against brute force, and on nulls, empty and long values, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import gzip
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import archives, spelling, whitening
from tidemark.llm.common import drop_written

FOLDER = "/root/testdata/sf0.001"


def plain_variants(rows, times=10):
    """By its definition: every run, letter by letter."""
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            n[word if h % 31 else word[: h % len(word)] + word[h % len(word) + 1 :]] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    less = lambda w: {w[:i] + w[i + 1 :] for i in range(len(w))}
    near = lambda a, b: a in less(b) or b in less(a) or (len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1)
    friends, form = {w: [x for x in n if x != w and abs(len(x) - len(w)) < 2 and near(w, x)] for w in n}, {}
    for w, found in friends.items():
        best = min(found, key=lambda x: (-n[x], x), default=None)
        if best and n[best] >= times * n[w]:
            form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(friends[w]), n[form[w]] if w in form else None))
    return out


def variants(spark, rows, more=""):
    table = spark.createDataFrame([(*r, "w", "k") for r in rows], "doc_id long, text string, word string, id string")
    got = [tuple(r) for r in spelling.variants(table).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_variants_of_planted_words(spark):
    """Chains of forms, ties, exchanges at all places, runs of equal letters, anagrams that are not near, words on both sides of the letterwise limit, very long ones."""
    rng = random.Random(3)
    bases = ["barrelled", "aaaaaaaa", "straßenbahn", "Ünïcödé", "listenings", "x" * 64, "xy" * 32, "q" * 65, "".join(rng.choice("abc") for _ in range(400)), "".join(rng.choice("abÀ") for _ in range(5000))]
    words = []
    for base in bases:
        words += [base] * 130
        for k in range(12):
            at, other = rng.randrange(len(base)), rng.choice("abxyzé")
            near = [base[:at] + base[at + 1 :], base[:at] + other + base[at:], base[:at] + other + base[at + 1 :]][k % 3]
            words += [near] * rng.choice([2, 2, 12, 13])
            words += [near[:-1] + "z"] * 2
        words += ["".join(rng.sample(base, len(base)))[:60]] * 2
    rng.shuffle(words)
    rows = [(i, " ".join(words[i::40])) for i in range(40)]
    rows += [(50, None), (51, ""), (None, "barrelled barreled " * 3), (52, " 12 short "), rows[0]]
    assert variants(spark, rows) == plain_variants(rows)
    assert variants(spark, [(1, None), (2, "")]) == set()
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_variants_of_real_texts(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60).collect()]
    assert variants(spark, rows) == plain_variants(rows)


def test_keys_meet_exactly_at_one_letter():
    """Whatever letters: words whose lists meet as near_words says are those that differ by one letter, and each pair meets once."""
    rng = random.Random(8)
    for length in (8, 63, 64, 65, 66, 90):
        base = "".join(rng.choice("ab") for _ in range(length))
        others = {base} | {base[:i] + c + base[i + j :] for i in range(length) for c in ("", "a", "b") for j in (0, 1)}
        lists, met = defaultdict(list), Counter()
        for w in others:
            for key, rest, place, first in spelling.keys_of(w):
                lists[key, rest].append((w, place, first))
        for found in lists.values():
            for a, p, f in found:
                for b, q, g in found:
                    if a != b and (p == q >= 0 or p == -1 and q >= 0 and g or q == -1 and p >= 0 and f):
                        met[a, b] += 1
        less = {w: {w[:i] + w[i + 1 :] for i in range(len(w))} for w in others}
        want = {(a, b) for a in others for b in others if a != b and (a in less[b] or b in less[a] or len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1)}
        assert set(met) == want and set(met.values()) == {1}


def arc(records, version=1, name="a.arc"):
    body = f"{version} 0 Someone\n{archives.ARC_FIELDS[version]}\n".encode()
    middle = "" if version == 1 else f" 200 - - 0 {name}"
    out = f"filedesc://{name} 0.0.0.0 19960923142103 text/plain{middle} {len(body)}\n".encode() + body + b"\n"
    for url, date, kind, block in records:
        middle = "" if version == 1 else f" 404 c0ffee http://other.example/ 99 {name}"
        out += f"{url} 10.0.0.1 {date} {kind}{middle} {len(block)}\n".encode() + block + b"\n"
    return out


TRICKY = b"HTTP/1.0 200 OK\r\nX-Page-Id: 5\r\n\r\nhttp://x.example/ 1.2.3.4 19990101000000 text/html 10\nWARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\n"


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("packed", [bytes, gzip.compress])
def test_arc_lines_of_both_versions(version, packed):
    """Declared lengths decide, not what payloads look like; urls with blanks; dates of 12 digits; documents that are no HTTP responses."""
    records = [("http://a.example/with blank", "199611041421", "text/html", TRICKY), ("dns:a.example", "19961104142103", "text/dns", b"a 1 IN A"), ("http://empty.example/", "19961104142103", "text/plain", b"")]
    found = list(archives.arc_records(packed(arc(records, version)), "a"))
    assert [(r.fields["URL"], r.block) for r in found[1:]] == [(u, b) for u, _, _, b in records] and found[0].opens
    assert archives.warc_date(found[1].fields["Archive-date"]) == "1996-11-04T14:21:00Z"
    if version == 2:
        assert (found[1].fields["Result-code"], found[1].fields["Location"]) == ("404", "http://other.example/")
    warc = b"\r\n\r\n".join(archives.converted(r, "a", None) for r in found) + b"\r\n\r\n"
    again = list(archives.warc_records(packed(warc)))
    assert [f["warc-type"] for f, _ in again] == ["warcinfo", "response", "resource", "resource"]
    assert [b for _, b in again[1:]] == [b for *_, b in records]
    assert again[1][0]["warc-date"] == "1996-11-04T14:21:00Z" and again[2][0]["content-type"] == "text/dns" and again[1][0]["warc-ip-address"] == "10.0.0.1"
    assert len({f["warc-record-id"] for f, _ in again}) == 4


def test_bad_archives_are_named():
    with pytest.raises(archives.BadArchive, match="here: header line at"):
        list(archives.arc_records(arc([("http://a/", "1996", "t", b"x")]) + b"not a header\n", "here"))
    with pytest.raises(archives.BadArchive, match="version"):
        list(archives.arc_records(b"filedesc://x 0 1 text/plain 9\n7 0 Other\n"))
    with pytest.raises(archives.BadArchive, match="here: record at 0"):
        list(archives.warc_records(b"nonsense\r\n\r\n", "here"))
    assert list(archives.arc_records(b"")) == [] == list(archives.warc_records(b""))
    assert archives.split_http(b"HTTP/1.0 200 OK\nA: b\n\n\nbody") == (b"HTTP/1.0 200 OK\nA: b\n\n", b"\nbody")


def plain_archive(rows):
    of, out = defaultdict(list), Counter()
    for number, html in rows:
        of[(html or "").encode()].append(number)
    for payload, numbers in of.items():
        best = max((x for x in numbers if x is not None), default=None)
        left = list(numbers)
        if len(payload) >= 1000:
            left.remove(best)
        digest = hashlib.sha1(payload).hexdigest()
        for x in left:
            out[x, len(payload), digest, "response" if len(payload) < 1000 else "revisit", None if len(payload) < 1000 else best] += 1
        if len(payload) >= 1000:
            out[best, len(payload), digest, "response", None] += 1
    return out


def test_pages_through_both_formats(spark):
    long, edge = "wörd\r\n\r\nWARC/1.1\r\n" * 100, "e" * 999
    rows = [(i, "http://a b.example/\n%d" % i, long) for i in range(40)] + [(i, None, edge) for i in range(40, 45)] + [(i, "u", edge + "e") for i in range(45, 48)]
    rows += [(None, "filedesc://x", "n" * 1200), (None, "v", "n" * 1200), (60, "v", "n" * 1200), (60, "v", "n" * 1200), (61, "w", None), (62, "w", ""), (None, None, None), (63, "x", "\n" * 3), (64, "y", "z" * 300_000), (65, "y", "z" * 300_000)]
    rows += [(70, "null only", "k" * 2000), (71, "tab\there", "\x00\x1f\x8b binary " * 20)]
    pages = spark.createDataFrame([(*r, "t", "o") for r in rows], "page_id long, url string, html string, archive string, offset string").repartition(3)
    for most in (500, 100_000):
        got = archives.archive_pages(pages, most=most)
        assert Counter(tuple(r)[:5] for r in got.collect()) == plain_archive([(a, c) for a, _, c in rows])
        assert got.where("not intact").count() == 0 and got.select("record_id").distinct().count() == len(rows)
    assert archives.archive_pages(pages.where("page_id < 0")).collect() == []
    drop_written(spark)


def test_foreign_archives_convert(spark, tmp_path):
    """ARC files that others wrote, of both versions, plain and compressed: equal payloads are stored once, over archives."""
    block = lambda i, body: b"HTTP/1.1 200 OK\r\nX-Page-Id: %d\r\nContent-Length: %d\r\n\r\n" % (i, len(body)) + body
    one, two = b"\xff\xfe not utf-8 " * 100, b"other " * 300
    (tmp_path / "a.arc").write_bytes(arc([("http://a/", "20010101000000", "text/html", block(1, one)), ("http://b/", "20010101000000", "text/html", block(9, two))], 1))
    (tmp_path / "b.arc.gz").write_bytes(gzip.compress(arc([("http://c/", "20020202020202", "text/html", block(7, one)), ("dns:x", "20020202020202", "text/dns", b"x")], 2)))
    files = archives.read_archives(spark, str(tmp_path))
    warc = archives.write_warc(files, archives.repeated(archives.arc_rows(files)))
    got = {r["page_id"]: r for r in archives.resolved(archives.warc_rows(archives.read_archives(spark, warc))).collect()}
    assert {k: (r["record_type"], r["refers_to"], r["payload_bytes"], r["intact"]) for k, r in got.items()} == {
        "1": ("revisit", "7", len(one), True), "9": ("response", None, len(two), True), "7": ("response", None, len(one), True), None: ("resource", None, 1, True)
    }
    assert got["1"]["payload_digest"] == hashlib.sha1(one).hexdigest()


def plain_whitening(vectors, most=16):
    x = np.floor(64 * np.array(vectors, dtype=np.float64)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    values, components = np.linalg.eigh(centred.T @ centred / n)
    values, components = values[::-1], components[:, ::-1]
    return n, ((n * x - sums) ** 2).sum(1), (x - sums / n) @ components[:, :most] / np.sqrt(values[:most]), values[:most] / values.sum()


def check_whitening(got, vectors, ids):
    n, deviation, whitened, explained = plain_whitening(vectors)
    mine = np.zeros_like(whitened)
    for r in got:
        at, k = ids.index(r["vec_id"]), r["component"] - 1
        mine[at, k] = r["whitened"]
        assert (r["n"], r["deviation"]) == (n, deviation[at]) and abs(r["explained"] / explained[k] - 1) < 1e-6 and r["identity_error"] < 1e-9
    assert len(got) == whitened.size
    assert np.allclose(mine, whitened * np.sign((mine * whitened).sum(0)), atol=1e-7)


def test_whitening_of_real_and_odd_vectors(spark):
    rng = np.random.default_rng(4)
    mixing = rng.normal(size=(20, 20)) * np.geomspace(30, 0.5, 20)
    vectors = [[float(v) for v in row @ mixing] for row in rng.normal(size=(400, 20))]
    vectors += [vectors[0]] * 300
    bad = [(900, None), (901, []), (902, [1.0] * 3), (903, [None] + [1.0] * 19), (904, [float("nan")] * 20), (905, [float("inf")] + [0.0] * 19), (906, [1e300] * 20)]
    table = spark.createDataFrame([(i, v, "a", "b") for i, v in [*enumerate(vectors), *bad]], "vec_id long, embedding array<double>, x string, n string").repartition(70)
    check_whitening(whitening.whiten(table).collect(), vectors, list(range(len(vectors))))
    assert whitening.whiten(table.where("vec_id >= 900 and vec_id <> 902")).collect() == []
    real = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    rows = real.collect()
    check_whitening(whitening.whiten(real).collect(), [r["embedding"] for r in rows], [r["vec_id"] for r in rows])


def test_triangles_of_many_tasks_combine(spark):
    """A tree of several levels gives the R that one factorisation of all rows gives, but for signs."""
    rng = np.random.default_rng(2)
    x = rng.integers(-5000, 5000, size=(700, 5))
    table = spark.createDataFrame([(row.astype("<i8").tobytes(),) for row in x], "x binary").repartition(70)
    n, sums = whitening.totals(table, 5)
    assert (n, sums) == (700, x.sum(0).tolist())
    r = whitening.triangle(table, 5, whitening.Centre(n, sums))
    want = np.linalg.qr(x - x.mean(0), mode="r")
    assert r.shape == (5, 5) and np.allclose(np.abs(r), np.abs(want))


def test_whitening_where_vectors_do_not_differ(spark):
    one = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])]
    got = whitening.whiten(spark.createDataFrame(one, "vec_id long, embedding array<float>")).collect()
    assert len(got) == 6 and {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got} == {(1, 0, None, None, None)}
    line = [(i, [float(i), 2.0 * i, 5.0]) for i in range(9)]
    got = whitening.whiten(spark.createDataFrame(line, "vec_id long, embedding array<double>")).collect()
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in got) and got[0]["identity_error"] < 1e-12
    huge = [(i, [2.0**50 * i, 1.0]) for i in range(3)]
    got = whitening.whiten(spark.createDataFrame(huge, "vec_id long, embedding array<double>")).collect()
    assert {r["vec_id"]: r["deviation"] for r in got}[1] == 0 and {r["vec_id"]: r["deviation"] for r in got}[2] is None


def test_jacobi_keeps_small_deviations():
    """Singular values over 12 orders of magnitude keep their digits, which a covariance would lose."""
    rng = np.random.default_rng(1)
    for dims in (1, 2, 7, 24):
        u, v = np.linalg.qr(rng.normal(size=(dims, dims)))[0], np.linalg.qr(rng.normal(size=(dims, dims)))[0]
        want = np.geomspace(1, 1e-12, dims)
        components, values = whitening.one_sided_jacobi(np.linalg.qr(rng.normal(size=(dims, dims)))[0] @ np.diag(want) @ v.T if dims > 1 else np.array([[1.0]]))
        assert np.allclose(values, want, rtol=1e-3) and np.allclose(components.T @ components, np.eye(dims), atol=1e-12)
