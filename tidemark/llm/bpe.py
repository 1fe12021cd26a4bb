"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A pre-token's symbols are leaves; a leaf holds the merge rank of its symbol with the next one, an inner node the
smaller of its two children and, of equal ones, the left. The root is the leftmost lowest-rank merge.
A merge changes two leaves, so it costs a logarithm of the length; it ends when the root has no rank.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import pieces

#: White space of the splitter, inside a character class.
SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Pre-tokens that a worker remembers, and the longest that it remembers.
REMEMBERED, REMEMBERED_LENGTH = 700_000, 64
NO_RANK = 1 << 60


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """A tokenizer file of byte-level BPE with word ends: normaliser, splitter, ranks and special tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in (self.ids | self.special).items()}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        #: rank of a pair, keyed by both ids in one integer; the token a rank makes
        self.ranks, self.merged = {}, []
        for rank, (a, b) in enumerate(pairs):
            self.ranks.setdefault(self.ids[a] << 20 | self.ids[b], rank)
            self.merged.append(self.ids[a + b])
        self.normal = Tokenizer.from_file(path).normalizer
        letters = _byte_letters()
        self.inner = [self.ids.get(letters[b]) for b in range(256)]
        self.last = [self.ids.get(letters[b] + self.suffix) for b in range(256)]
        self.split = regex.compile(_pattern(spec["pre_tokenizer"]))
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.known_ids = Known(lambda piece: np.array(self.word(piece), "<u4").tobytes())
        self.known_names = Known(lambda piece: self.decode(np.frombuffer(self.known_ids[piece], "<u4").tolist()))

    def merge(self, symbols: list[int]) -> list[int]:
        """The symbols after all merges."""
        n = len(symbols)
        if n < 2:
            return symbols
        rank, merged, none = self.ranks.get, self.merged, NO_RANK
        leaves = 1 << (n - 2).bit_length()
        tree = [none] * (2 * leaves)
        k, a = leaves, symbols[0]
        for b in symbols[1:]:
            tree[k] = rank(a << 20 | b, none)
            k, a = k + 1, b
        for k in range(leaves - 1, 0, -1):
            x, y = tree[2 * k], tree[2 * k + 1]
            tree[k] = x if x <= y else y
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(k: int, value: int) -> None:
            tree[k] = value
            while k > 1:
                other = tree[k ^ 1]
                if other < value:
                    value = other
                k >>= 1
                if tree[k] == value:
                    return
                tree[k] = value

        low = tree[1]
        while low != none:
            k = 1
            while k < leaves:
                k <<= 1
                if tree[k] != low:
                    k += 1
            i = k - leaves
            j = after[i]
            symbols[i] = new = merged[low]
            symbols[j] = -1
            after[i] = end = after[j]
            if j < n - 1:
                put(leaves + j, none)
            if end < n:
                before[end] = i
                put(k, rank(new << 20 | symbols[end], none))
            else:
                put(k, none)
            if i:
                h = before[i]
                put(leaves + h, rank(symbols[h] << 20 | new, none))
            low = tree[1]
        return [s for s in symbols if s >= 0]

    def word(self, piece: str) -> list[int]:
        """Ids of one pre-token."""
        raw = piece.encode()
        symbols = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        return self.merge([s for s in symbols if s is not None])

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens of the ids, special ones too, joined by a space, as a tokenizer without a decoder does."""
        names = self.names
        return " ".join([names[i] for i in ids if i in names])

    def normalise(self, text: str) -> str:
        """The text as the splitter wants it. Latin-1 texts are composed already, and the splitter drops white space."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.normal.normalize_str(text)
        return text.lower()

    def encode(self, text: str) -> tuple[bytes, str]:
        """The ids as little-endian 32-bit integers, and their decoded text."""
        ids, names = [], []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                ids.append(np.array([self.special[part]], "<u4").tobytes())
                names.append(part)
            elif part:
                words = self.split.findall(self.normalise(part))
                if words:
                    ids.append(b"".join(map(self.known_ids.__getitem__, words)))
                    names.append(" ".join(map(self.known_names.__getitem__, words)))
        if len(self.known_ids) > REMEMBERED:
            self.known_ids.clear()
            self.known_names.clear()
        return b"".join(ids), " ".join(names)


class Known(dict):
    """Pre-token -> its ids or names, made where missing and kept unless long."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, piece: str):
        out = self.make(piece)
        if len(piece) <= REMEMBERED_LENGTH:
            self[piece] = out
        return out


def _pattern(spec: dict) -> str:
    for part in spec.get("pretokenizers", [spec]):
        if part["type"] == "Split":
            # the regex module counts \x1c-\x1f as white space, the file's library does not
            return part["pattern"]["Regex"].replace(r"\s", SPACE)
    raise ValueError("the vocabulary has no splitter")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """Each worker reads the file once."""
    return Vocabulary(path)


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Where this machine has a vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, path: str | None = None, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), and with keep_text (ids, decoded), for every row of docs(doc_id, text, ...).

    Whole texts are encoded, null as empty: no ids and an empty decoded text. Strings of special tokens in a text become
    these tokens. Null doc_id stays null, repeated rows stay repeated, further columns are ignored, no rows give no rows.
    `path` names the vocabulary file on the executors; by default each finds its own copy.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path or vocabulary_path())
        for part in pieces(batches, "text"):
            made = [vocab.encode(x or "") for x in part.column("text").to_pylist()]
            columns = [
                part.column("doc_id"),
                pa.array([len(a) // 4 for a, _ in made], pa.int64()),
                pa.array([hashlib.sha256(a).hexdigest() for a, _ in made], pa.string()),
                pa.array([hashlib.sha256(b.encode()).hexdigest() for _, b in made], pa.string()),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_text:
                columns += [pa.array([np.frombuffer(a, "<u4").astype(np.int32) for a, _ in made], pa.list_(pa.int32())), pa.array([b for _, b in made], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_text
    return docs.select("doc_id", "text").mapInArrow(run, schema)
