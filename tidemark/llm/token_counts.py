"""Token counts without token ids: pieces per distinct pre-token, joined to per-document pre-token frequencies.

A batch of texts becomes a table (document, pre-token, frequency); its distinct pre-tokens form the other
side of the join, each counted once by the tokenizer's merges; products are summed by document. Both sides live in one task, so
the join moves no text between machines, and a worker keeps the counts of short pre-tokens for its next batches.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .bpe import REMEMBERED, REMEMBERED_LENGTH, SPACE, vocabulary_path
from .common import pieces

#: Tokens above which a document is over the limit.
TOKEN_LIMIT = 512


class PieceCounts(dict):
    """Pre-token -> number of its pieces."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(regex.escape(t) for t in sorted(special, key=len, reverse=True))) if special else None
        self.split = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")

    def words(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a text and the number of special tokens in it."""
        if self.special is None or not self.special.search(text):
            return self.split.findall(text), 0
        parts = self.special.split(text)
        return [w for part in parts for w in self.split.findall(part)], len(parts) - 1

    def of(self, distinct: list[str]) -> np.ndarray:
        """Pieces of each of the distinct pre-tokens."""
        out = np.array([self.get(w, -1) for w in distinct], np.int64)
        unknown = np.flatnonzero(out < 0)
        if len(unknown):
            made = self.model.encode_batch_fast([distinct[i] for i in unknown], add_special_tokens=False)
            if len(self) + len(unknown) > REMEMBERED:
                self.clear()
            for i, e in zip(unknown, made):
                out[i] = len(e)
                if len(distinct[i]) <= REMEMBERED_LENGTH and len(self) < REMEMBERED:
                    self[distinct[i]] = len(e)
        return out


@lru_cache(maxsize=2)
def piece_counts(path: str) -> PieceCounts:
    return PieceCounts(path)


def batch_counts(texts: list[str], counts: PieceCounts) -> list[int]:
    """Tokens of each text of a batch."""
    place: dict[str, int] = {}
    who, which, special = [], [], []
    for text in texts:
        words, extra = counts.words(text)
        ids = np.fromiter((place.setdefault(w, len(place)) for w in words), np.int64, len(words))
        which.append(ids)
        who.append(len(ids))
        special.append(extra)
    pieces_of = counts.of(list(place))
    out = []
    for ids, extra in zip(which, special):
        distinct, frequency = np.unique(ids, return_counts=True)
        out.append(int((pieces_of[distinct] * frequency).sum()) + extra)
    return out


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = TOKEN_LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs(doc_id, text, ...).

    Whole texts count, null as empty (no bytes, no tokens); a special token's string in a text is one token; over_limit is
    n_tokens > `limit`. Null doc_id stays null, repeated rows stay repeated, further columns are ignored, no rows give no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = piece_counts(path or vocabulary_path("byte_bpe_50k.json"))
        for part in pieces(batches, "text"):
            texts = [x or "" for x in part.column("text").to_pylist()]
            n = batch_counts(texts, counts)
            size = [len(x.encode()) for x in texts]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
