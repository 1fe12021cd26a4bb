"""Fuzzy line deduplication: rare word triples, SimHash distance, edit similarity, one occurrence per connected group.

A line's words (letters, digits, non-ASCII; A-Z as a-z) are its normalised form. Equal forms are one *line class*, known
by a 64-bit hash. Two classes are linked when their word edit similarity is SIMILARITY hundredths or more.

SimHash blocks alone cannot find these links (see README), so the pigeonhole argument is made on word triples: an edit changes three of
them at most, so of one more than three for each allowed edit, first in an order that all classes share, linked classes have one in
common. Each class is listed under so many of its rarest triples; the shortest lines are listed under pairs of words. How rare a triple is
comes from word counts in a table of fixed size and need not be exact: any order that all classes share will do.
Classes that meet are compared by their numbers of words and by the places of the shared words: as many edits as the places differ by before and
behind them are needed at least. Those that pass are compared by SimHash (BITS bits over single words, an even chance for each bit of unrelated lines, at most about one in
five for linked ones) and those within MOST_BITS by edit similarity. In a list of more than SHORT classes the smallest hash leads and the
others are verified against it; where that leaves several components, the list's classes are moved once and all pairs that lengths, places and components leave are
compared; lists of more than LONG classes are compared in tiles of bounded size. So no list of pairs of a large group is made. Of each connected group the occurrence
in the smallest doc_id stays, there the first.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import cut, drop_cut, pieces, release
from .components import components
from .hashing import ITEM, buffer_of, mix, rows_of, spans, word_hashes
from .ngram_jaccard import RANGE_KEYS, RANGES, tiled_links

#: SimHash bits; most that differ between linked lines (mean 53 of 256 and deviation 6.5 at a similarity of 0.8); least word edit similarity in hundredths.
BITS, MOST_BITS, SIMILARITY = 256, 96, 80
#: Smallest similarity at which linked lines share a word triple or pair for certain.
LEAST_SIMILARITY = 75
#: Classes of a list whose pairs are all candidates; classes of a list that is compared whole; rows of such lists in one group, on average.
SHORT, LONG, LIST_ROWS = 8, 4096, 10_000
#: Compared pairs that a group of lists remembers.
SEEN = 500_000
#: Largest number of words and place that travel with a code. Lines of so many words or more are not judged by places.
WIDE = 0xFFFF
#: Rows of one class (one for each batch) beyond which it is brought together before it is listed: a share of all rows, and a number.
HOT_SHARE, HOT_ROWS = 1 / 20_000, 16
#: A SimHash word is counted in 8-bit lanes of at most this many words.
LANE = 255
#: One code point stands for each word in the encoded line: this many, from this one on (three bytes of UTF-8).
LETTERS, FIRST_LETTER = 0xC000, 0x1000
#: Bins of words whose counts bound what two lines of a tile share.
BINS = 256
#: Lines of a tile that are compared with its other side at once.
PART = 128
#: Steps of a word's rarity for each doubling of its count, and the largest one.
RARITY_STEPS, RAREST = 2, 80

U64 = np.uint64
_LANES = np.array([sum(1 << (8 * i) for i in range(8) if v >> i & 1) for v in range(256)], np.uint64)
_SEEDS = mix(np.arange(1, BITS // 64 + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))


def _nth(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """How many times each 16-bit value has occurred in its row before."""
    both = row << 16 | value
    order = np.argsort(both, kind="stable")
    both = both[order]
    first = np.flatnonzero(np.append(True, both[1:] != both[:-1])[: len(both)])
    out = np.empty(len(value), np.int64)
    out[order] = np.arange(len(value)) - np.repeat(first, np.diff(np.append(first, len(value))))
    return out


class Lines:
    """The lines of a batch of texts that have words: text row, place among the row's lines, hash and words."""

    def __init__(self, column: pa.Array):
        data, offsets = buffer_of(column)
        breaks = np.flatnonzero(data == 10) + 1
        begins = np.union1d(breaks, offsets)  # an empty line more at a text's end, without words, is harmless
        starts, ends = spans(data, begins, ITEM)
        self.hashes = word_hashes(data, starts, ends, ITEM)
        bounds = rows_of(starts, begins)
        full = np.flatnonzero(np.diff(bounds)) if len(begins) > 1 else np.zeros(0, np.int64)
        self.first = bounds[full]
        self.count = np.diff(bounds)[full]
        self.row = np.searchsorted(offsets, begins[full], "right") - 1
        self.place = np.searchsorted(breaks, begins[full], "right") - np.searchsorted(breaks, offsets[self.row], "right")
        within = np.arange(len(self.hashes)) - np.repeat(self.first, self.count)
        with np.errstate(over="ignore"):
            spread = mix(self.hashes + within.astype(np.uint64) * U64(0xD1342543DE82EF95))
            self.key = mix(np.add.reduceat(spread, self.first) ^ self.count.astype(np.uint64)).view(np.int64) if len(full) else np.zeros(0, np.int64)

    def letters(self) -> np.ndarray:
        """A number under LETTERS for each word."""
        return (self.hashes % U64(LETTERS)).astype(np.uint16)


def line_count(column: pa.Array) -> np.ndarray:
    """Lines with a word of each text."""
    data, offsets = buffer_of(column)
    begins = np.union1d(np.flatnonzero(data == 10) + 1, offsets)
    begins = begins[begins < len(data)]
    full = np.logical_or.reduceat(~ITEM[data], begins) if len(begins) else np.zeros(0, bool)
    return np.diff(np.searchsorted(begins[full], offsets))


def _binaries(values: np.ndarray, begins: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Of a 16-bit array the stretches that begin there, as binary values."""
    at = np.repeat(begins - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    ends = np.concatenate([[0], np.cumsum(counts) * 2]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values[at]))])


def line_table(docs: DataFrame) -> DataFrame:
    """(key, doc_id, alt, times, letters, cells): one row for every text and distinct line with a word in it.

    alt tells texts without a doc_id apart. letters, two bytes for each word, are null where the batch had the line before. One row of each task has cells
    only: how often each letter occurred.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "doc_id", "alt", "times", "letters", "cells"]
        cells = np.zeros(LETTERS, np.int64)
        for part in pieces(batches, "text"):
            lines = Lines(part.column("text"))
            if not len(lines.key):
                continue
            letters = lines.letters()
            cells += np.bincount(letters, minlength=LETTERS)
            order = np.lexsort((lines.row, lines.key))
            key, row = lines.key[order], lines.row[order]
            another = np.append(True, key[1:] != key[:-1])
            each = np.flatnonzero(another | np.append(True, row[1:] != row[:-1]))
            chosen = order[another]
            place = np.full(len(each), -1)
            place[another[each]] = np.arange(len(chosen))
            spelled = _binaries(letters, lines.first[chosen], lines.count[chosen]).take(pa.array(place, mask=place < 0))
            rows = pa.array(row[each])
            times = np.diff(np.append(each, len(key))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(key[each]), part.column("doc_id").take(rows), part.column("alt").take(rows), pa.array(times), spelled, pa.nulls(len(each), pa.binary())], names=names)
        if cells.any():
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())), pa.array([cells.tobytes()], pa.binary())], names=names)

    return docs.select("doc_id", _alt().alias("alt"), "text").mapInArrow(run, "key long, doc_id long, alt long, times int, letters binary, cells binary")


def _alt() -> Column:
    """What tells documents without a doc_id apart: their text."""
    return F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))


def sequences(letters: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letter, first, count): all lines' letters, where each line begins and its words."""
    data, offsets = buffer_of(letters)
    return np.frombuffer(data.tobytes(), np.uint16), offsets[:-1] // 2, np.diff(offsets) // 2


def simhash(letter: np.ndarray, count: np.ndarray) -> np.ndarray:
    """(lines, BITS // 8) octets; a word that occurs again counts as another word, so that one edit changes one feature."""
    with np.errstate(over="ignore"):
        words = mix(letter.astype(np.uint64) * U64(1 << 20) + _nth(np.repeat(np.arange(len(count)), count), letter).astype(np.uint64) + U64(1))
    parts = -(-count // LANE)
    owner = np.repeat(np.arange(len(count)), parts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    at = (np.cumsum(count) - count)[owner] + nth * LANE
    head = np.cumsum(parts) - parts
    out = []
    for seed in _SEEDS:
        octets = mix(words ^ seed).view(np.uint8).reshape(-1, 8)
        for k in range(8):
            lanes = np.add.reduceat(_LANES[octets[:, k]], at).view(np.uint8).reshape(-1, 8)
            ones = lanes.astype(np.int64) if len(at) == len(count) else np.add.reduceat(lanes.astype(np.int64), head, axis=0)
            out.append(np.packbits(2 * ones > count[:, None], axis=1, bitorder="little"))
    return np.ascontiguousarray(np.concatenate(out, axis=1))


def encoded(letter: np.ndarray, count: np.ndarray) -> pa.Array:
    """The lines with one code point for each word."""
    letter = letter.astype(np.int64) + FIRST_LETTER
    raw = np.stack([0xE0 | letter >> 12, 0x80 | (letter >> 6 & 63), 0x80 | (letter & 63)], axis=1).astype(np.uint8)
    ends = np.concatenate([[0], np.cumsum(count) * 3]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(count), [None, pa.py_buffer(ends), pa.py_buffer(raw)])


def most_edits(a: int, b: int, similarity: int = SIMILARITY) -> int:
    """Word edits that leave two lines of a and b words similar enough."""
    return max(a, b) * (100 - similarity) // 100


def listed_runs(n: int, q: int, similarity: int = SIMILARITY) -> int:
    """Runs of q words of a line of n, first in any fixed order, that no line linked with it can be without; 0 if only equal lines are linked.

    An edit takes q of the line's runs, one that puts a word in q - 1.
    """
    m = np.arange(n, n * 100 // similarity + 1)
    most = m * (100 - similarity) // 100
    return int((q * most - (m - n)).max()) + 1 if most[-1] else 0


def least_for_triples(similarity: int = SIMILARITY) -> int:
    """Words from which on all lines have enough triples."""
    n = 400
    while listed_runs(n - 1, 3, similarity) <= n - 3:
        n -= 1
    return n


def _first_runs(value: np.ndarray, first: np.ndarray, count: np.ndarray, q: int, most: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(value, line) of the smallest values of each line's runs of q words, most[words] of them; value has one for each position."""
    values, owners = [], []
    order = np.argsort(count, kind="stable")
    sizes, at = np.unique(count[order], return_index=True)
    for n, a, b in zip(sizes.tolist(), at, np.append(at[1:], len(order))):
        take = min(most.get(n, 0), n - q + 1)
        if take > 0:
            rows = order[a:b]
            table = value[first[rows][:, None] + np.arange(n - q + 1)]
            if take < table.shape[1]:
                table = np.partition(table, take - 1, axis=1)[:, :take]
            values.append(table.ravel())
            owners.append(np.repeat(rows, take))
    return (np.concatenate(values), np.concatenate(owners)) if values else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def listed(letter: np.ndarray, first: np.ndarray, count: np.ndarray, rarity: np.ndarray, similarity: int = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """(value, line): what each line is listed under. The upper eight bits say how frequent its words are, the next 40 are the code, the last 16 the place in the line.

    Of equal runs the first ones are listed: so of the rarest run that edits leave, its first occurrence that they leave is listed on both sides.
    """
    triples = least_for_triples(similarity)
    pairs = (triples - 1) * 100 // similarity  # lines up to this length may be linked with one that has too few triples
    sizes = np.unique(count).tolist()
    rare, wide = rarity[letter].astype(np.uint64), letter.astype(np.uint64)
    place = np.minimum(np.arange(len(letter)) - np.repeat(first, count), WIDE).astype(np.uint64)
    found = []
    for q, chosen in ((2, [n for n in sizes if n <= pairs]), (3, [n for n in sizes if n >= triples])):
        if chosen and len(letter) >= q:
            k = len(letter) - q + 1
            code, total = wide[:k] | U64(q) << U64(60), rare[:k].copy()
            for i in range(1, q):
                code |= wide[i : i + k] << U64(16 * i)
                total += rare[i : i + k]
            found.append(_first_runs(mix(code) >> U64(24) << U64(16) | total << U64(56) | place[:k], first, count, q, {n: listed_runs(n, q, similarity) for n in chosen}))
    return (np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def rarity(lines: DataFrame) -> np.ndarray:
    """For each letter a small number that grows with its count: a table of fixed size, summed from line_table()."""
    # the words that share a letter count as one; each task gave one row
    parts = lines.where("cells is not null").select("cells")

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS, np.int64)
        for b in batches:
            for x in b.column("cells").to_pylist():
                total += np.frombuffer(x, np.int64)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], names=["letter", "n"])

    counts = parts.mapInArrow(add, "letter long, n long").groupBy("letter").agg(F.sum("n").alias("n")).collect()  # LETTERS rows at most
    out = np.zeros(LETTERS, np.uint8)
    for r in counts:
        out[r["letter"]] = min(RAREST, int(np.log2(r["n"] + 1) * RARITY_STEPS))
    return out


def fitting(x: np.ndarray, y: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray, similarity: int = SIMILARITY) -> np.ndarray:
    """Whether lengths and places allow rows x and y, the one with more words, to be linked.

    low and high are the first and last place of the shared run: whatever stands before it in one line and not in the other takes an edit for each word, and so behind it.
    """
    more = n[y] - n[x]
    beyond = np.maximum(0, np.maximum(low[y] - high[x] - more, low[x] - high[y]))
    return (n[x] * 100 >= n[y] * similarity) & ((more + 2 * beyond <= n[y] * (100 - similarity) // 100) | (n[y] >= WIDE))


def aligned(code: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray, similarity: int = SIMILARITY) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(x, y), step by step: fitting rows of one code, in rows sorted by code and words; at step d these are d rows apart."""
    x, d = np.arange(len(code)), 0
    while True:
        d += 1
        x = x[: np.searchsorted(x, len(code) - d)]
        y = x + d
        x = x[(code[x] == code[y]) & (n[x] * 100 >= n[y] * similarity)]  # lines further on are longer still
        if not len(x):
            return
        fit = fitting(x, x + d, n, low, high, similarity)
        yield x[fit], x[fit] + d


def candidates(lines: DataFrame, classes: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """(code, a, b, n, low, high): without a code, pairs of classes that are listed under the same one and may be linked by lengths and places: all such pairs of short lists, of
    long ones those with the smallest class. With a code, each class b of a long list with its words and the first and last place of the run in it.

    `classes` has the number of rows with letters for each key. Codes travel in packed rows, one for each batch and range of codes.
    """
    if similarity < LEAST_SIMILARITY:
        raise ValueError(f"linked lines share no word triple for certain below {LEAST_SIMILARITY}")
    total, rows = classes.agg(F.sum("listings"), F.sum("batches")).first()
    bits = max(RANGES.bit_length() - 1, int(np.ceil(np.log2(max(1, (total or 0) / RANGE_KEYS)))))
    shared = lines.sparkSession.sparkContext.broadcast(rarity(lines))
    spelled = lines.where("letters is not null").select("key", "letters")
    # a class that most batches have is listed once; at most 1 / HOT_SHARE of them
    hot = classes.where(F.col("batches") > max(HOT_ROWS, (rows or 0) * HOT_SHARE)).select("key")
    if not hot.isEmpty():
        spelled = spelled.join(F.broadcast(hot), "key", "left_anti").unionByName(spelled.join(F.broadcast(hot), "key", "left_semi").dropDuplicates(["key"]))

    names = ["codes", "keys", "sizes", "sizes_above", "places", "places_above"]

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = shared.value
        for part in pieces(batches, "letters"):
            key = np.asarray(part.column("key"))
            letter, begin, count = sequences(part.column("letters"))
            value, row = listed(letter, begin, count, rare, similarity)
            if not len(value):
                continue
            code = value >> U64(16) & U64((1 << 40) - 1)
            bucket = code & U64((1 << bits) - 1)
            order = np.argsort(bucket.astype(np.uint16) if bits <= 16 else bucket, kind="stable")
            code, row, bucket = code[order], row[order], bucket[order]
            found, first = np.unique(bucket, return_index=True)
            ends = np.append(first[1:], len(code))
            low = (code >> U64(bits)).astype(np.uint32)  # the next 32 bits: the range's number is in every row
            size, place = np.minimum(count, WIDE)[row], (value[order] & U64(WIDE)).astype(np.int64)
            # upper and lower octets apart: nearly all upper ones are zero
            fields = [low, key[row], *(x.astype(np.uint8) for x in (size & 255, size >> 8, place & 255, place >> 8))]
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), *(pa.array([x[a:b].tobytes() for a, b in zip(first, ends)], pa.binary()) for x in fields)], names=["bucket", *names])

    def meet(table: pa.Table) -> pa.Table:
        code, key, *octets = (np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in zip(names, (np.uint32, np.int64, *[np.uint8] * 4)))
        order = np.argsort(code)
        code = code[order]
        same = code[1:] == code[:-1]
        kept = np.append(same, False) | np.append(False, same)
        order, code = order[kept], code[kept].astype(np.int64)
        key, n0, n1, p0, p1 = key[order], *(x[order].astype(np.int64) for x in octets)
        n, place = n0 | n1 << 8, p0 | p1 << 8
        order = np.lexsort((key, n, code))
        code, key, n, place = code[order], key[order], n[order], place[order]
        new = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (key[1:] != key[:-1]))[: len(code)])
        low, high = (f.reduceat(place, new) if len(new) else place for f in (np.minimum, np.maximum))
        code, key, n = code[new], key[new], n[new]
        edge = np.flatnonzero(np.append(True, code[1:] != code[:-1]))[: len(code)]
        size = np.diff(np.append(edge, len(code)))
        long = np.repeat(size, size) > SHORT
        steps = [(x[~long[x]], y[~long[x]]) for _, (x, y) in zip(range(1, SHORT), aligned(code, n, low, high, similarity))]
        x, y = np.repeat(np.lexsort((key, code))[edge], size)[long], np.flatnonzero(long)  # the smallest class of each long list, and all its classes
        x, y = np.where(n[x] <= n[y], x, y), np.where(n[x] <= n[y], y, x)
        fit = fitting(x, y, n, low, high, similarity) & (x != y)
        steps.append((x[fit], y[fit]))
        pairs = [np.stack([np.minimum(key[x], key[y]), np.maximum(key[x], key[y])], axis=1) for x, y in steps]
        both = np.concatenate(pairs)
        both = both[np.lexsort(both.T)]
        both = both[np.append(True, (both[1:] != both[:-1]).any(axis=1))[: len(both)]]
        named = code[long] | table.column("bucket")[0].as_py() << 32
        none, k = np.full(len(both), -1), len(named)
        gone = np.append(np.zeros(len(both), bool), np.ones(k, bool))
        column = lambda x, y, mask, kind: pa.array(np.append(x, y), kind, mask=mask)
        return pa.table({"code": column(none, named, ~gone, pa.int64()), "a": column(both[:, 0], np.full(k, -1), gone, pa.int64()), "b": column(both[:, 1], key[long], None, pa.int64())} | {c: column(none, x[long], ~gone, pa.int32()) for c, x in (("n", n), ("low", low), ("high", high))})

    spread = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return spelled.mapInArrow(pack, f"bucket int, {', '.join(f'{c} binary' for c in names)}").repartition(spread, "bucket").groupBy("bucket").applyInArrow(meet, "code long, a long, b long, n int, low int, high int")


def edits(a: str, b: str, most: int) -> int:
    """Levenshtein distance of two encoded lines, or most + 1 if it is larger."""
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    a, b = a[start:], b[start:]
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return most + 1
    if not a:
        return len(b)
    # the columns of the distance table as differences of neighbours, a bit for each word (Myers; Hyyro for whole strings)
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    more, less, last, distance = full, 0, 1 << (len(a) - 1), len(a)
    for left, y in zip(range(len(b) - 1, -1, -1), b):
        equal = at.get(y, 0)
        diagonal = ((equal & more) + more ^ more) | equal | less
        up, down = less | ~(diagonal | more) & full, more & diagonal
        distance += 1 if up & last else -1 if down & last else 0
        if distance - left > most:
            return most + 1
        up, down = (up << 1 | 1) & full, down << 1 & full
        vertical = equal | less
        more, less = down | ~(vertical | up) & full, up & vertical
    return min(distance, most + 1)


class Links:
    """Links between labels, as many as it takes to join them: lines are compared only while their labels are not joined."""

    def __init__(self, letters: list[bytes], labels: np.ndarray):
        self.raw, self.labels = letters, labels.tolist()
        self.top: dict[int, int] = {}
        self.spelt: dict[int, tuple[str, list[str]]] = {}

    def find(self, x: int) -> int:
        while (up := self.top.get(x, x)) != x:
            x = up
        return x

    def line(self, i: int) -> tuple[str, list[str]]:
        """The line and its triples."""
        if i not in self.spelt:
            x = self.raw[i].decode("utf-16-le")
            self.spelt[i] = x, [x[k : k + 3] for k in range(len(x) - 2)]
        return self.spelt[i]

    def compare(self, x: int, y: int, most: int) -> None:
        if (one := self.find(self.labels[x])) == (two := self.find(self.labels[y])):
            return
        (a, triples), (b, others) = self.line(x), self.line(y)
        # so many edits leave at least so many of the triples
        if sum(map(set(others).__contains__, triples)) >= len(triples) - 3 * most and edits(a, b, most) <= most:
            self.top[two] = one

    def table(self) -> pa.Table:
        """Each label that was joined with the first of its component: no long ways."""
        return pa.table({"src": pa.array([self.find(x) for x in self.top], pa.int64()), "dst": pa.array(list(self.top), pa.int64())})


def _sims(table: pa.Table) -> np.ndarray:
    return np.stack([np.asarray(table.column(f"s{k}").combine_chunks()) for k in range(BITS // 64)], axis=1).view(np.uint64)


def _bins(letters: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Each line's words, and how many of them are in each bin."""
    sizes = np.array([len(x) // 2 for x in letters])
    words = np.frombuffer(b"".join(letters), np.uint16) % BINS
    return sizes, np.bincount(np.repeat(np.arange(len(sizes)) * BINS, sizes) + words, minlength=len(sizes) * BINS).reshape(-1, BINS).astype(np.uint16)


def _share_enough(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, bins: np.ndarray, similarity: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether the lines share enough words, those of a bin counting as one, and the most edits between them: each takes one word from what they share at most."""
    longer = np.maximum(sizes[x], sizes[y])
    most = longer * (100 - similarity) // 100
    parts = zip(np.array_split(x, 1 + len(x) // 4096), np.array_split(y, 1 + len(y) // 4096))
    return np.concatenate([np.minimum(bins[i], bins[j]).sum(axis=1) for i, j in parts]) >= longer - most, most


def _lists(similarity: int):
    """For some whole lists, rows (code, fp, label, n, low, high, s0 ..., letters): links between different labels, as many as it takes."""

    def run(table: pa.Table) -> pa.Table:
        code, n = (np.asarray(table.column(c).combine_chunks()).astype(np.int64) for c in ("code", "n"))
        order = np.lexsort((n, code))
        low, high, label = (np.asarray(table.column(c).combine_chunks()).astype(np.int64)[order] for c in ("low", "high", "label"))
        sims, letters = _sims(table)[order], table.column("letters").combine_chunks().take(pa.array(order)).to_pylist()
        name = np.asarray(table.column("fp").combine_chunks())[order].tolist()
        sizes, bins = _bins(letters)
        links, seen = Links(letters, label), set()
        for x, y in aligned(code[order], n[order], low, high, similarity):
            differ = label[x] != label[y]
            x, y = x[differ], y[differ]
            near = np.bitwise_count(sims[x] ^ sims[y]).sum(axis=1, dtype=np.uint16) <= MOST_BITS
            x, y = x[near], y[near]
            close, most = _share_enough(x, y, sizes, bins, similarity)
            for i, j, k in zip(x[close].tolist(), y[close].tolist(), most[close].tolist()):
                # most pairs are in several lists
                if (pair := (name[i], name[j])) not in seen and pair[::-1] not in seen:
                    seen.add(pair)
                    links.compare(i, j, k)
            if len(seen) > SEEN:
                seen.clear()
        return links.table()

    return run


def _tile(similarity: int):
    """For one tile: links between different labels, as many as it takes, between lines of its two blocks or inside its one block."""

    def run(table: pa.Table) -> pa.Table:
        of_b, labels = (np.asarray(table.column(c).combine_chunks()) for c in ("of_b", "label"))
        sims = _sims(table)
        raw = table.column("letters").to_pylist()
        sizes, bins = _bins(raw)
        links, left = Links(raw, labels), np.flatnonzero(~of_b)
        right = np.flatnonzero(of_b) if of_b.any() else left
        for part in np.array_split(right, -(-len(right) // PART)):
            near = np.bitwise_count(sims[part][:, None] ^ sims[left]).sum(axis=2, dtype=np.uint16) <= MOST_BITS
            i, j = part[:, None], left
            near &= (i > j) if right is left else True
            near &= (labels[i] != labels[j]) & (np.minimum(sizes[i], sizes[j]) * 100 >= np.maximum(sizes[i], sizes[j]) * similarity)
            i, j = np.nonzero(near)
            i, j = part[i], left[j]
            close, most = _share_enough(i, j, sizes, bins, similarity)
            for x, y, k in zip(i[close].tolist(), j[close].tolist(), most[close].tolist()):
                links.compare(x, y, k)
        return links.table()

    return run


def spelled(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """(fp, paired, n, sim, letters) of the classes in keys(key, paired): words, SimHash and encoded line."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "letters"):
            letter, _, count = sequences(part.column("letters"))
            longs = simhash(letter, count).view(np.int64)
            sims = pa.ListArray.from_arrays(pa.array(np.arange(len(longs) + 1, dtype=np.int32) * longs.shape[1]), pa.array(longs.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("paired"), pa.array(count.astype(np.int32)), sims, encoded(letter, count)], names=["fp", "paired", "n", "sim", "letters"])

    one = lines.where("letters is not null").join(keys.hint("merge"), "key").dropDuplicates(["key"])
    return one.select("key", "paired", "letters").mapInArrow(run, "fp long, paired boolean, n int, sim array<long>, letters string")


def verified(pairs: DataFrame, texts: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """(src, dst): those of distinct (a, b) that are linked."""
    texts = texts.select("fp", "n", "sim", "letters")
    one, two = texts.toDF("a", "n", "sim", "letters"), texts.toDF("b", "m", "other", "spelt")
    bits = " + ".join(f"bit_count(sim[{k}] ^ other[{k}])" for k in range(BITS // 64))
    # keys and texts grow with the corpus and are never broadcast, so the plan is the same at every size
    near = pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").where(f"least(n, m) * 100 >= greatest(n, m) * {similarity} and {bits} <= {MOST_BITS}")
    close = near.where(f"levenshtein(letters, spelt, int(greatest(n, m) * {100 - similarity} div 100)) >= 0")
    return close.select(F.col("a").alias("src"), F.col("b").alias("dst"))


def groups(lines: DataFrame, classes: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """(node, label): the connected group of each line class that is linked with another, from line_table() and its classes."""
    led = cut(candidates(lines, classes, similarity), "lists")
    release(lines.sparkSession)  # the shuffle of all listed triples is the largest
    pairs = cut(led.where("a is not null").select("a", "b").distinct(), "pairs")
    listed_under = led.where("code is not null")
    met = reduce(DataFrame.union, [x.select(c, F.lit(p)) for x, c, p in ((pairs, "a", True), (pairs, "b", True), (listed_under, "b", False))]).toDF("key", "paired")
    met = met.groupBy("key").agg(F.bool_or("paired").alias("paired"))
    texts = cut(spelled(lines, met), "lines")
    release(lines.sparkSession)
    links = cut(verified(pairs, texts.where("paired"), similarity), "links")
    drop_cut(pairs)
    release(lines.sparkSession)
    labels = components(links)
    # long lists whose classes are not in one component; lists of the same classes, equally far from each other, are one
    rows = listed_under.select("code", F.col("b").alias("node"), "n", "low", "high").join(labels.hint("merge"), "node", "left").select("code", F.col("node").alias("fp"), "n", "low", "high", F.coalesce("label", "node").alias("label"))
    weight = F.pmod(F.xxhash64("fp"), F.lit(1 << 20))
    far = [(F.sum(F.col(x) * weight) - F.min_by("low", "fp") * F.sum(weight)).alias(f"{x}s") for x in ("low", "high")]
    open_ = rows.groupBy("code").agg(F.min("label").alias("first"), F.max("label").alias("last"), F.bit_xor(F.xxhash64("fp")).alias("all"), F.count("*").alias("c"), F.min("fp").alias("hub"), *far).where("first <> last")
    open_ = cut(open_.groupBy("all", "c", "lows", "highs").agg(F.min("code").alias("code"), F.min("hub").alias("hub")).select("code", "c", "hub"), "open")
    # lists with one smallest class share most of their pairs and stay together, as far as their rows allow
    per_hub = open_.where(f"c <= {LONG}").groupBy("hub").agg(F.sum("c").alias("rows"))
    open_ = open_.join(per_hub.hint("merge"), "hub", "left").select("code", "c", F.expr(f"xxhash64(hub, pmod(xxhash64(code), ceil(rows / {LIST_ROWS})))").alias("bucket"))
    active = cut(rows.join(open_.hint("merge"), "code"), "active")
    drop_cut(led)
    whole, moved = active.agg(F.count_if(F.col("c") <= LONG), F.count("*")).first()
    if not moved:
        return labels
    release(lines.sparkSession)
    # two bytes for each word and no empty fields: these rows are most of what is moved here
    slim = texts.select("fp", *[F.col("sim")[k].alias(f"s{k}") for k in range(BITS // 64)], F.encode("letters", "UTF-16LE").alias("letters"))
    # a class is in as many lists as it has codes: each wave moves about as many rows as there are classes
    at_once, done = classes.count(), []
    waves, groups_of = max(1, -(-whole // max(1, 2 * at_once))), max(1, -(-whole // LIST_ROWS))
    for i in range(waves if whole else 0):
        full = active.where(f"c <= {LONG} and pmod(bucket, {waves}) = {i}").drop("c").join(slim.hint("merge"), "fp").withColumn("bucket", F.expr(f"pmod(xxhash64(bucket), {-(-groups_of // waves)})"))
        done.append(cut(full.groupBy("bucket").applyInArrow(_lists(similarity), "src long, dst long"), "links"))
    if whole < moved:
        done.append(tiled_links(active.where(f"c > {LONG}").select("fp", "label", F.col("code").alias("comp")), slim, _tile(similarity), ("fp",), at_once))
    rest = reduce(DataFrame.unionByName, done)
    drop_cut(texts)
    # of components, by their labels
    wider = components(rest).select(F.col("node").alias("label"), F.col("label").alias("wide"))
    old = labels.unionByName(wider.select(F.col("label").alias("node"), "label")).distinct()
    return cut(old.join(wider, "label", "left").select("node", F.coalesce("wide", "label").alias("label")), "labels")


def repeated_lines(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """(_id, _alt, _found): for each document its lines that have a partner, as structs of key, label of the group and whether the document owns the group."""
    lines = cut(line_table(docs), "lines")
    # a document without an id comes after all that have one
    classes = lines.where("key is not null").groupBy("key").agg(
        F.sum("times").alias("c"), F.min("doc_id").alias("low"), F.min(F.when(F.col("doc_id").isNull(), F.col("alt"))).alias("low_alt"), F.count("letters").alias("batches"), F.sum(F.octet_length("letters") / 2).cast("long").alias("listings")
    )
    classes = cut(classes, "classes")
    labels = groups(lines, classes, similarity)
    per_line = classes.select("key", "c", "low", "low_alt").join(labels.withColumnRenamed("node", "key"), "key", "left").where("c > 1 or label is not null").select("key", "low", "low_alt", F.coalesce("label", "key").alias("label"))
    per_line = cut(per_line, "repeated")
    owners = per_line.groupBy("label").agg(F.min("low").alias("low"), F.min("low_alt").alias("low_alt"))
    found = per_line.select("key", "label").join(owners, "label")
    own = F.col("doc_id").eqNullSafe(F.col("low")) & (F.col("doc_id").isNotNull() | (F.col("alt") == F.col("low_alt")))
    each = lines.where("key is not null").select("key", "doc_id", "alt").join(found, "key").select("doc_id", "alt", F.struct("key", "label", own.alias("own")).alias("line"))
    decided = each.groupBy("doc_id", "alt").agg(F.collect_set("line").alias("_found"))
    out = cut(decided.select(F.col("doc_id").alias("_id"), F.col("alt").alias("_alt"), "_found"), "decided")
    for used in (lines, classes, per_line):
        drop_cut(used)
    return out


def _deduped(docs: DataFrame, similarity: int) -> DataFrame:
    """(row, text, lines, lost): each row of `docs` as a struct without its text, so that no name of it can clash; the text less its repeated lines, its lines with a word, and those that went."""
    decided = repeated_lines(docs, similarity)
    others = [c for c in docs.columns if c != "text"]
    keyed = docs.select(F.struct(*others).alias("row"), "text", "doc_id", _alt().alias("alt"))
    joined = keyed.join(decided, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("alt") == F.col("_alt")), "left")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            total = line_count(part.column("text"))
            lost = np.zeros(part.num_rows, np.int64)
            found, texts = part.column("_found"), part.column("text")
            some = np.flatnonzero(found.is_valid())
            if len(some):
                given = texts.take(pa.array(some))
                lines, spelt = Lines(given), texts.to_pylist()
                edge = np.searchsorted(lines.row, np.arange(len(some) + 1))
                for k, r in enumerate(some.tolist()):
                    groups_of = {x["key"]: (x["label"], x["own"]) for x in found[r].as_py()}
                    seen, gone = set(), set()
                    for i in range(edge[k], edge[k + 1]):
                        group, own = groups_of.get(int(lines.key[i]), (None, True))
                        if group is None:
                            continue
                        if not own or group in seen:
                            gone.add(int(lines.place[i]))
                        seen.add(group)
                    if gone:
                        spelt[r] = "\n".join(x for j, x in enumerate(spelt[r].split("\n")) if j not in gone)
                        lost[r] = len(gone)
                texts = pa.array(spelt, pa.string())
            yield pa.RecordBatch.from_arrays([part.column("row"), texts, pa.array(total.astype(np.int64)), pa.array(lost)], names=["row", "text", "lines", "lost"])

    schema = StructType([StructField("row", keyed.schema["row"].dataType), StructField("text", StringType()), StructField("lines", LongType()), StructField("lost", LongType())])
    return joined.select("row", "text", "_found").mapInArrow(run, schema)


def _columns(docs: DataFrame, **more: Column) -> list[Column]:
    """The columns of `docs` again from _deduped(); those in `more` are replaced."""
    return [more[c].alias(c) if c in more else F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]


def dedup_lines(docs: DataFrame, similarity: int = SIMILARITY, counts: tuple[str, str] = ("_n_lines", "_n_removed")) -> DataFrame:
    """The rows of `docs` with text less its repeated lines, and two columns named as in `counts`: lines with a word, and those that went.

    Of each connected group one occurrence stays: the first in the document with the smallest doc_id. Lines without a word (blank, or
    punctuation only) stay. Null text stays null and has no lines; rows with one doc_id count as one document, each with its own first
    occurrence; without a doc_id rows of one text count as one document, and come after all others. All other columns stay, whatever their names; one that has a
    name of `counts` is an error; no rows give no rows. Lines are handled whole, however long.
    """
    if clash := {c.lower() for c in docs.columns} & {c.lower() for c in counts}:
        raise ValueError(f"the table has columns named as the counts: {', '.join(sorted(clash))}")
    return _deduped(docs, similarity).select(*_columns(docs), F.col("lines").alias(counts[0]), F.col("lost").alias(counts[1]))


def removed(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """(doc_id, n_lines, n_removed, text_sha256) for every row of docs(doc_id, text, ...): the digest of dedup_lines(), a null text's hash being null."""
    out = _deduped(docs.select("doc_id", "text"), similarity)
    return out.select(F.col("row.doc_id").alias("doc_id"), F.col("lines").alias("n_lines"), F.col("lost").alias("n_removed"), F.sha2("text", 256).alias("text_sha256"))


def without_repeated_lines(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """The rows of `docs` less their repeated lines; those that had lines and lost all of them go. n_chars follows the text where there is one."""
    out, more = _deduped(docs, similarity).where("lost = 0 or lines > lost"), {}
    if "n_chars" in docs.columns:
        more["n_chars"] = F.when(F.col("lost") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row").getField("n_chars"))
    return out.select(*_columns(docs, **more))
