"""N-gram Jaccard join by prefix trees: classes of documents whose shingle sets overlap enough.

1. Each text becomes a set of hashed word shingles. Equal sets are one *text class* (a 64-bit
   fingerprint with the set's size); copies are never compared with each other.
2. Document frequencies: the sets are dealt by hash range in packed rows; each range counts its
   shingles and sends back those that two classes or more have. Their frequency gives the global
   order, rarest first. A class with fewer shared shingles than the threshold needs drops out.
3. Each remaining class is listed under the shared shingles of its prefix: two sets with enough
   overlap must meet there. Under every shingle the class with the smallest fingerprint leads;
   the others are verified against it and links are contracted to components. Only lists with several
   components are open; their classes are compared in tiles of bounded size, and never inside one
   component. No list of pairs of a group of near copies is ever made.
4. Verification puts sets in a trie in the global order and walks it with another set: classes below a
   node share its partial overlap, and a subtree whose remaining lengths cannot reach the least
   overlap is skipped.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, pieces
from .components import components
from .hashing import mix, row_sets

#: Words in a shingle; least similarity in hundredths.
SHINGLE_WORDS, SIMILARITY = 5, 80
#: Key ranges of the frequency count at least, and keys in one of them at most, on average.
RANGES, RANGE_KEYS = 256, 4_000_000
#: Rows of copies of one text above this share of all documents are cut before the shuffle.
HOT_SHARE = 1 / 2000
#: Sets in one trie.
TRIE_SETS = 256
#: Sets of one side of a tile, on average.
TILE_SETS = 256


def least_shared(n: int, similarity: int = SIMILARITY) -> int:
    """Shingles of a set of n that any set linked with it must have."""
    return -(-n * similarity // 100)


def least_overlap(a: int, b: int, similarity: int = SIMILARITY) -> int:
    """Smallest i with 100 * i >= similarity * (a + b - i)."""
    return -(-similarity * (a + b) // (100 + similarity))


def fingerprint(keys: np.ndarray) -> int:
    """A signed 64-bit fingerprint of a set and its size."""
    with np.errstate(over="ignore"):
        total = mix(keys).sum(dtype=np.uint64)
        return int(mix(np.array([total ^ (np.uint64(len(keys)) * np.uint64(0xD6E8FEB86659FD93))])).view(np.int64)[0])


def classes(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, rid, fp, n): a hash of the text, the fingerprint (null without words) and the size of each document's set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            sets = row_sets(part.column("text"), size)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("rid"), pa.array([fingerprint(s) if len(s) else None for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())],
                names=["doc_id", "rid", "fp", "n"],
            )

    return docs.select("doc_id", F.xxhash64("text").alias("rid"), "text").mapInArrow(run, "doc_id long, rid long, fp long, n long")


def _packed(docs: DataFrame, size: int, bits: int, hot: dict[int, tuple[int, int]]) -> DataFrame:
    """Rows (bucket, fps, counts, keys): the sets of a batch, cut by hash range. Of hot copies only the chosen one goes on."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, held, amount = shared.value, {}, 0
        for part in pieces(batches, "text"):
            ids = part.column("doc_id").to_pylist()
            for doc_id, keys in zip(ids, row_sets(part.column("text"), size)):
                if not len(keys):
                    continue
                fp = fingerprint(keys)
                if fp in held or (fp in hot and hot[fp] != doc_id):
                    continue
                held[fp] = keys
                amount += len(keys)
            if amount > 500_000:
                yield _deal(held, bits)
                held, amount = {}, 0
        if held:
            yield _deal(held, bits)

    return docs.select("doc_id", "text").mapInArrow(run, "bucket int, fps binary, counts binary, keys binary")


def _deal(held: dict[int, np.ndarray], bits: int) -> pa.RecordBatch:
    fps = np.fromiter(held, np.int64, len(held))
    lengths = np.fromiter((len(x) for x in held.values()), np.int64, len(held))
    keys = np.concatenate(list(held.values()))
    owner = np.repeat(np.arange(len(fps)), lengths)
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
    order = np.lexsort((owner, bucket))
    keys, owner, bucket = keys[order], owner[order], bucket[order]
    found, first = np.unique(bucket, return_index=True)
    out = ([], [], [])
    short = ((keys >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    for a, b in zip(first, np.append(first[1:], len(keys))):
        who, count = np.unique(owner[a:b], return_counts=True)
        out[0].append(fps[who].tobytes())
        out[1].append(count.astype(np.uint32).tobytes())
        out[2].append(short[a:b].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), *(pa.array(x, pa.binary()) for x in out)], names=["bucket", "fps", "counts", "keys"])


def _shared(bits: int, back: int):
    """For one key range: the keys that two classes or more have, dealt by class as packed rows."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        join = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
        fps, keys = np.repeat(join("fps", np.int64), join("counts", np.uint32)), join("keys", np.uint32)
        order = np.lexsort((fps, keys))
        fps, keys = fps[order], keys[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (fps[1:] != fps[:-1])
        fps, keys = fps[new], keys[new]
        edge = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        df = np.diff(np.append(edge, len(keys)))
        each = np.repeat(df, df)
        fps, keys, each = fps[each > 1], keys[each > 1], each[each > 1]
        # the order's code: frequency class (in sixteenths of a doubling), then the key
        rank = np.minimum(np.log2(np.maximum(each, 1)) * 16, 1023).astype(np.uint64)
        code = (rank << np.uint64(54)) | (((np.uint64(bucket) << np.uint64(32)) | keys.astype(np.uint64)) & np.uint64((1 << 54) - 1))
        to = (mix(fps.view(np.uint64)) % np.uint64(back)).astype(np.int64)
        order = np.lexsort((fps, to))
        fps, code, to = fps[order], code[order], to[order]
        found, first = np.unique(to, return_index=True)
        out = ([], [], [])
        for a, b in zip(first, np.append(first[1:], len(code))):
            who, count = np.unique(fps[a:b], return_counts=True)
            out[0].append(who.tobytes())
            out[1].append(count.astype(np.uint32).tobytes())
            out[2].append(code[a:b].tobytes())
        return pa.table({"to": pa.array(found, pa.int32()), "fps": pa.array(out[0], pa.binary()), "counts": pa.array(out[1], pa.binary()), "codes": pa.array(out[2], pa.binary())})

    return run


def _candidates(similarity: int):
    """For one group of classes: each with its size and its shared shingles in the global order, if it has enough of them."""

    def run(left: pa.Table, sizes: pa.Table) -> pa.Table:
        join = lambda name, kind: np.frombuffer(b"".join(left.column(name).to_pylist()), kind)
        fps, codes = np.repeat(join("fps", np.int64), join("counts", np.uint32)), join("codes", np.uint64)
        order = np.lexsort((codes, fps))
        fps, codes = fps[order], codes[order]
        who, first, count = np.unique(fps, return_index=True, return_counts=True)
        n_of = dict(zip(sizes.column("fp").to_pylist(), sizes.column("n").to_pylist()))
        out = [(int(fp), n_of[int(fp)], codes[a : a + c].tobytes()) for fp, a, c in zip(who, first, count) if c >= least_shared(n_of[int(fp)], similarity)]
        return pa.table({"fp": pa.array([x[0] for x in out], pa.int64()), "n": pa.array([x[1] for x in out], pa.int64()), "codes": pa.array([x[2] for x in out], pa.binary())})

    return run


def shared_sets(docs: DataFrame, texts: DataFrame, size: int = SHINGLE_WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """(fp, n, codes): the classes that have enough shared shingles to be linked at all.

    `texts` is what classes() made of `docs`.
    """
    stats = texts.where("fp is not null").agg(F.sum("n").alias("keys"), F.count("*").alias("docs")).first()
    total, count = stats["keys"] or 0, stats["docs"] or 0
    bits = max(RANGES.bit_length() - 1, int(np.ceil(np.log2(max(1, total / RANGE_KEYS)))))
    sizes = texts.where("fp is not null").groupBy("fp").agg(F.max("n").alias("n"), F.count("*").alias("copies"), F.min("doc_id").alias("first"))
    # at most 1 / HOT_SHARE rows
    hot = {r["fp"]: r["first"] for r in sizes.where(F.col("copies") > max(8, count * HOT_SHARE)).where("first is not null").select("fp", "first").collect()}
    back = max(16, 1 << int(np.ceil(np.log2(max(1, count / 2000)))))
    spread = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = _packed(docs, size, bits, hot).repartition(int(spread), "bucket")
    returned = dealt.groupBy("bucket").applyInArrow(_shared(bits, back), "to int, fps binary, counts binary, codes binary")
    # the same place for a class's size and its shared shingles; xxhash-free, so that numpy and Spark agree
    placed = _place(sizes.select("fp", "n"), back)
    return returned.groupBy("to").cogroup(placed.groupBy("to")).applyInArrow(_candidates(similarity), "fp long, n long, codes binary")


def _place(sizes: DataFrame, back: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.asarray(b.column("fp")).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((mix(fp.view(np.uint64)) % np.uint64(back)).astype(np.int32)), b.column("fp"), b.column("n")], names=["to", "fp", "n"])

    return sizes.mapInArrow(run, "to int, fp long, n long")


def prefixes(sets: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """(code, fp, n): each class under the shared shingles of its prefix. Shingles that it has alone come first and find nobody."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for fp, n, raw in zip(*(b.column(c).to_pylist() for c in ("fp", "n", "codes"))):
                codes = np.frombuffer(raw, np.uint64)
                listed = codes[: len(codes) - least_shared(n, similarity) + 1].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(listed), pa.array(np.full(len(listed), fp)), pa.array(np.full(len(listed), n))], names=["code", "fp", "n"])

    def batched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in run(batches):
            held.append(b)
            rows += b.num_rows
            if rows > 50_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return sets.mapInArrow(batched, "code long, fp long, n long")


class Trie:
    """A compressed trie of ordered sets."""

    __slots__ = ("part", "below", "ends", "least", "longest")

    def __init__(self, part: np.ndarray):
        self.part, self.below, self.ends = part, {}, []
        self.least, self.longest = 1 << 62, 0  # smallest set size and most codes after this node, over all below

    def add(self, codes: np.ndarray, name: int, n: int) -> None:
        node, at = self, 0
        while True:
            node.least, node.longest = min(node.least, n), max(node.longest, len(codes) - at)
            if at == len(codes):
                node.ends.append((name, n))
                return
            first = int(codes[at])
            child = node.below.get(first)
            if child is None:
                child = node.below[first] = Trie(codes[at:])
                child.least, child.longest = n, 0
                child.ends.append((name, n))
                return
            m = min(len(child.part), len(codes) - at)
            differ = np.flatnonzero(child.part[:m] != codes[at : at + m])
            same = int(differ[0]) if len(differ) else m
            if same < len(child.part):
                upper = Trie(child.part[:same])
                upper.least, upper.longest = child.least, child.longest + len(child.part) - same
                child.part = child.part[same:]
                upper.below[int(child.part[0])] = child
                node.below[first] = child = upper
            node, at = child, at + same

    def linked(self, query: np.ndarray, n: int, similarity: int) -> Iterator[int]:
        """Names of the sets whose overlap with the query is enough."""
        todo = [(self, 0)]
        while todo:
            node, overlap = todo.pop()
            left = len(query)
            if len(node.part):
                at = np.searchsorted(query, node.part)
                overlap += int((query[np.minimum(at, len(query) - 1)] == node.part).sum())
                left = len(query) - int(np.searchsorted(query, node.part[-1], "right"))
            if overlap + min(left, node.longest) < least_overlap(n, node.least, similarity):
                continue
            for name, size in node.ends:
                if overlap >= least_overlap(n, size, similarity):
                    yield name
            todo += [(child, overlap) for child in node.below.values()]


def _verify(similarity: int):
    """Rows sorted by (hub, salt), the hub's own set first: the classes that are linked with their hub."""

    def flush(hub, held):
        trie = Trie(np.zeros(0, np.uint64))
        for fp, n, codes in held:
            trie.add(codes, fp, n)
        return [(hub[0], fp) for fp in trie.linked(hub[2], hub[1], similarity)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, held = None, []
        for b in batches:
            out = []
            for name, own, fp, n, raw in zip(*(b.column(c).to_pylist() for c in ("hub", "own", "fp", "n", "codes"))):
                codes = np.frombuffer(raw, np.uint64)
                if own == 0:
                    if held:
                        out += flush(hub, held)
                    hub, held = (name, n, codes), []
                else:
                    held.append((fp, n, codes))
                    if len(held) >= TRIE_SETS:
                        out += flush(hub, held)
                        held = []
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["src", "dst"])
        out = flush(hub, held) if held else []
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["src", "dst"])

    return run


def verify(pairs: DataFrame, sets: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """Of distinct (hub, fp): those that are linked, as (src, dst). A hub with many partners is salted over tasks."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(1 << 20)))
    per_hub = pairs.groupBy("hub").agg(F.count("*").alias("partners"))
    salted = salted.join(per_hub, "hub").withColumn("salt", F.expr(f"int(salt % ceil(partners / {TRIE_SETS}))"))
    right = salted.select("hub", "salt", "fp").join(sets, "fp").select("hub", "salt", F.lit(1).alias("own"), "fp", "n", "codes")
    own = salted.select("hub", "salt").distinct().join(sets.withColumnRenamed("fp", "hub"), "hub")
    own = own.select("hub", "salt", F.lit(0).alias("own"), F.col("hub").alias("fp"), "n", "codes")
    spread = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    together = own.unionByName(right).repartition(spread, "hub", "salt").sortWithinPartitions("hub", "salt", "own", "codes")
    return together.mapInArrow(_verify(similarity), "src long, dst long")


def _tile(similarity: int):
    """For one tile: the links between the sets of its two blocks, or inside its one block, over different labels."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("of_b", "fp", "label", "n", "codes"))), key=lambda r: r[4])
        trie, of = Trie(np.zeros(0, np.uint64)), {}
        for of_b, fp, label, n, raw in rows:
            if not of_b:
                trie.add(np.frombuffer(raw, np.uint64), fp, n)
                of[fp] = label
        one, out = len(of) == len(rows), []
        for of_b, fp, label, n, raw in rows:
            if of_b or one:
                out += [(fp, other) for other in trie.linked(np.frombuffer(raw, np.uint64), n, similarity) if of[other] != label]
        return pa.table({"src": pa.array([x[0] for x in out], pa.int64()), "dst": pa.array([x[1] for x in out], pa.int64())})

    return run


def tiled_links(members: DataFrame, sets: DataFrame, run, unused: tuple[str, ...] = (), at_once: int | None = None) -> DataFrame:
    """(src, dst): all links between classes of one group with different labels, from members(fp, label, comp) and sets(fp, ...).

    `run` finds the links of one tile, a table (a, b, of_b, fp, label, ...) of the rows of its blocks a and b; of_b is true for those of b, and in a tile of one block for none.
    Columns in `unused` are not moved. With `at_once` the tiles are done in waves of about so many rows, each stored before the next, so what lies on disk at a time is
    bounded however often a class is in a tile.

    A group is cut into blocks: classes of a frequent label among themselves, whole rare labels pooled. Two blocks make a tile unless both are of the
    same frequent label, so a large group in which nearly all are linked already costs its size times its rest.
    """
    per_label = members.groupBy("comp", "label").agg(F.count("*").alias("c"))
    own = F.col("c") > TILE_SETS // 2
    pooled = per_label.where(~own).groupBy("comp").agg(F.sum("c").alias("pool"))
    placed = (
        members.join(per_label, ["comp", "label"])
        .join(pooled, "comp", "left")
        .select("comp", "fp", "label", F.when(own, F.col("label")).alias("owner"), F.when(own, F.xxhash64("comp", "label", F.expr(f"pmod(xxhash64(fp), ceil(c / {TILE_SETS}))"))).otherwise(F.xxhash64("comp", F.lit("pool"), F.expr(f"pmod(xxhash64(label), ceil(pool / {TILE_SETS}))"))).alias("block"))
    )
    placed = cut(placed, "blocks")
    blocks = placed.groupBy("comp", "block", "owner").agg(F.count("*").alias("k"))
    a, b = (blocks.select("comp", F.col("block").alias(x), F.col("owner").alias(f"o{x}"), F.col("k").alias(f"k{x}")) for x in "ab")
    tiles = a.join(b, "comp").where("a <= b and (oa is null or ob is null or oa <> ob)").select("a", "b", F.when(F.col("a") == F.col("b"), F.col("ka")).otherwise(F.col("ka") + F.col("kb")).alias("moved"))

    def linked(tiles: DataFrame) -> DataFrame:
        sides = tiles.select("a", "b", F.col("a").alias("block")).unionByName(tiles.where("a <> b").select("a", "b", F.col("b").alias("block")))
        full = sides.join(placed, "block").join(sets, "fp").select("a", "b", (F.col("block") != F.col("a")).alias("of_b"), "fp", "label", *[c for c in sets.columns if c != "fp"])
        return full.drop(*unused).groupBy("a", "b").applyInArrow(run, "src long, dst long")

    if at_once is None:
        return linked(tiles)
    waves = max(1, -(-(tiles.agg(F.sum("moved")).first()[0] or 0) // max(1, at_once)))
    done = [cut(linked(tiles.where(f"pmod(xxhash64(b, a), {waves}) = {i}")), "links") for i in range(waves)]
    return reduce(DataFrame.unionByName, done)


def links(sets: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """(node, label): the components of the classes in `sets` that have a link."""
    under = cut(prefixes(sets, similarity), "prefixes")
    leaders = under.groupBy("code").agg(F.min(F.struct("fp", "n")).alias("lead"), F.count("*").alias("c")).where("c > 1")
    listed = cut(under.join(leaders.select("code", F.col("lead.fp").alias("hub"), F.col("lead.n").alias("m")), "code"), "lists")
    drop_cut(under)
    pairs = listed.where("fp <> hub").where(f"least(n, m) * 100 >= greatest(n, m) * {similarity}").select("hub", "fp").distinct()
    led = cut(verify(pairs, sets, similarity), "links")
    labels = components(led)
    # lists whose classes are in one component are done
    rows = listed.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    open_ = rows.groupBy("code").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("code")
    active = cut(rows.join(open_, "code").select("fp", "hub", "label").distinct(), "active")
    drop_cut(listed)
    groups = components(active.select("fp", "hub"), "fp", "hub")
    members = active.select("fp", "label").distinct().join(groups.select(F.col("node").alias("fp"), F.col("label").alias("comp")), "fp")
    rest = tiled_links(members, sets, _tile(similarity))
    out = components(led.unionByName(rest))
    for used in (led, labels, active, groups):
        drop_cut(used)
    return out


def _labelled(docs: DataFrame, size: int, similarity: int) -> DataFrame:
    """(doc_id, rid, n, component_id) for every row; component_id is null only where no row of the component has an id."""
    texts = cut(classes(docs, size), "classes")
    sets = cut(shared_sets(docs, texts, size, similarity), "sets")
    labels = links(sets, similarity)
    drop_cut(sets)
    full = texts.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    smallest = full.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("low"), F.count("*").alias("c")).where("c > 1").drop("c")
    return full.join(smallest, "label", "left").select("doc_id", "rid", "n", F.coalesce("low", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE_WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs(doc_id, text, ...).

    Words are runs of anything but ASCII white space, with A-Z as a-z. Two documents are linked when the
    Jaccard similarity of their sets of `size`-word shingles is `similarity` hundredths or more;
    component_id is the smallest doc_id of those reachable by links. A text with fewer words has its whole sequence as
    one shingle. Null, empty and wordless texts have an empty set, are linked with nothing and keep their own id. Rows with
    a null doc_id take part and never give a component its id unless all its ids are null. Repeated rows stay
    repeated. Further columns are ignored; no rows give no rows.
    """
    return _labelled(docs, size, similarity).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, size: int = SHINGLE_WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """The rows of `docs`, with all their columns, less near duplicates: of each component the smallest doc_id stays.

    Rows that share this doc_id all stay; of rows with a null doc_id those stay that are linked with no row that has one. Empty texts stay.
    """
    gone = _labelled(docs, size, similarity).where("component_id is not null and (doc_id is null or doc_id <> component_id)")
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("rid").alias("_rid")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_id"]) & (F.xxhash64(docs["text"]) == gone["_rid"]), "left_anti")
