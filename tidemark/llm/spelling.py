"""Spelling variants by anagram hashing: words whose keys differ by one letter's value, verified in their letters' order.

A word's key is the sum of a power of each of its letters, whatever their order. Two words that differ by one exchanged letter have equal keys once each
is taken its letter off (K1 - v(a) = K2 - v(b)); by one added or removed letter, once the longer one is (K1 = K2 - v(b)). So a word is listed under its key and under its key
less each letter, and one equality join of these lists finds every pair. A key alone does not decide: on 0.1 GB it joins 91 million pairs of which 1.5 million are near.
The order of the remaining letters is therefore verified in the join itself (they are part of its condition), and no list grows with the vocabulary:
words that leave the same letters are at most alphabet times length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut

LEAST_LETTERS, LEAST_COUNT, TIMES = 7, 2, 10
#: One in so many runs of a document loses a letter (the query's contract; `slips` None leaves all as they are).
SLIPS = 31
#: The power of a letter's code that its value is, modulo 2**64.
POWER = 5
#: Words up to so many letters are compared letter by letter; of longer ones the remaining letters are held as 127 bits, or their lists would grow with the square of the length.
LETTERWISE = 64
#: Distinct words that a task holds before it hands on their counts.
HELD_WORDS = 200_000
_MERSENNE, _BASE = (1 << 127) - 1, 0x5DEECE66D1B54A32D192ED03A1B2C3D5
KEYS = "key long, rest binary, place int, first boolean, id long, n long"


def _value(letter: str) -> int:
    return ord(letter) ** POWER


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def _counts(least: int, slips: int | None):
    """Per task: (word, n) of the runs of whole texts, counted in a table of bounded size."""
    long_run = re.compile(r"[A-Za-zÀ-ÿ]{%d,}" % least)  # greedy: a match is a whole run

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for doc, text in zip(batch.column("doc_id"), batch.column("text")):
                doc, text = doc.as_py(), text.as_py()
                if not text:
                    continue
                begun = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for run, n in Counter(long_run.findall(text)).items():
                    word = run.encode().lower()  # of bytes: A-Z only
                    if slips:
                        h = zlib.crc32(word, begun)
                        if h % slips == 0:
                            at = h % len(run)
                            if len(run) == least:
                                continue
                            letters = word.decode()
                            word = (letters[:at] + letters[at + 1 :]).encode()
                    held[word] += n
                if len(held) >= HELD_WORDS:
                    yield out()
        if held:
            yield out()

    return count


def vocabulary(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, slips: int | None = SLIPS) -> DataFrame:
    """(word, n) over all documents: runs of Latin letters, A-Z lower-cased, of so many letters and occurrences at least."""
    counts = docs.select("doc_id", "text").mapInArrow(_counts(least_letters, slips), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _rests_of_long(word: str) -> list[bytes]:
    """127 bits of the word (first) and of the word less each letter, in one pass from either end."""
    n = len(word)
    before, after, power = [0] * (n + 1), [0] * (n + 1), [1] * (n + 1)
    for i, c in enumerate(word):
        before[i + 1] = (before[i] * _BASE + ord(c)) % _MERSENNE
        power[i + 1] = power[i] * _BASE % _MERSENNE
    for i in range(n - 1, -1, -1):
        after[i] = (after[i + 1] + ord(word[i]) * power[n - 1 - i]) % _MERSENNE
    out = [before[n]] + [(before[i] * power[n - 1 - i] + after[i + 1]) % _MERSENNE for i in range(n)]
    return [b"\xff" + x.to_bytes(16, "little") for x in out]  # no word begins with this byte


def keys_of(word: str) -> Iterator[tuple[int, bytes, int, bool]]:
    """(key, remaining letters, place, first of its run of equal letters): the word itself at place -1, then the word less each letter."""
    total, n = sum(map(_value, word)), len(word)
    # a word of LETTERWISE + 1 letters meets one of LETTERWISE: what remains decides how it is held
    long = _rests_of_long(word) if n > LETTERWISE else None
    yield _signed(total), long[0] if n > LETTERWISE else word.encode(), -1, True
    for i, c in enumerate(word):
        rest = long[i + 1] if n - 1 > LETTERWISE else (word[:i] + word[i + 1 :]).encode()
        yield _signed(total - _value(c)), rest, i, i == 0 or word[i - 1] != c


def _keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()))], ["key", "rest", "place", "first", "id", "n"])

    rows: list[tuple] = []
    for batch in batches:
        for word, number, n in zip(*(batch.column(c).to_pylist() for c in ("word", "id", "n"))):
            for found in keys_of(word):
                rows.append((*found, number, n))
                if len(rows) >= 50_000:
                    yield out(rows)
                    rows = []
    if rows:
        yield out(rows)


def near_words(words: DataFrame) -> DataFrame:
    """(id, near_id, near_n): every ordered pair of words(word, id, n) that differ by one added, removed or exchanged letter, once.

    An exchange is met at its one place; an added letter at the first place of its run of equal letters.
    """
    keys = words.select("word", "id", "n").mapInArrow(_keys, KEYS)
    other = keys.select("key", "rest", *[F.col(c).alias(f"o_{c}") for c in ("place", "first", "id", "n")])
    exchanged = "place = o_place and place >= 0"
    longer, shorter = "place = -1 and o_place >= 0 and o_first", "o_place = -1 and place >= 0 and first"
    pairs = keys.join(other, ["key", "rest"]).where(f"id <> o_id and (({exchanged}) or ({longer}) or ({shorter}))")
    return pairs.select("id", F.col("o_id").alias("near_id"), F.col("o_n").alias("near_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """(id, root) from (id, form): each step doubles how far a word looks. Counts grow along a chain, so it has no circle and few steps."""
    roots = cut(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        next_ = roots.select(F.col("id").alias("root"), F.col("root").alias("further"))
        step = cut(roots.join(next_, "root", "left").select("id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        moved = step.where("moved").limit(1).count()
        drop_cut(roots)
        roots = step
        if not moved:
            return roots.select("id", "root")


def variants(docs: DataFrame, times: int = TIMES, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, slips: int | None = SLIPS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of `docs`(doc_id, text).

    A form is the near word of largest n (of equal ones the first in code-point order) if it has `times` the word's n at least, else null; a root is the last of a
    word's chain of forms, the word itself without one. Null and empty texts have no words; a null doc_id counts as an empty text where letters are left out; repeated rows
    count as often as they occur; other columns, whatever their names, are not read; an empty table gives no rows. Runs of any length are words.
    """
    # numbered in code-point order: a number is a word's tie-break, and 8 bytes in all that follows
    words = cut(vocabulary(docs, least_letters, least_count, slips).orderBy("word").withColumn("id", F.monotonically_increasing_id()), "words")
    best = near_words(words).groupBy("id").agg(F.count("*").alias("n_near"), F.max(F.struct("near_n", (-F.col("near_id")).alias("low"))).alias("best"))
    near = cut(best.select("id", "n_near", F.col("best.near_n").alias("form_n"), (-F.col("best.low")).alias("form")), "near")
    chosen = near.join(words.select("id", "n"), "id").where(F.col("form_n") >= times * F.col("n")).select("id", "form", "form_n")
    roots = _roots(chosen)
    named = lambda what: words.select(F.col("id").alias(f"{what}_id"), F.col("word").alias(what))
    links = chosen.join(roots.select("id", F.col("root").alias("root_id")), "id").withColumnRenamed("form", "form_id")
    links = links.join(named("form"), "form_id").join(named("root"), "root_id").select("id", "form", "root", "form_n")
    out = words.join(near.select("id", "n_near"), "id", "left").join(links, "id", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
