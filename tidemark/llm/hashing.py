"""Words, shingles and their 64-bit hashes of many texts at once, in numpy.

A word's hash is a polynomial over random 64-bit values of its bytes; a shingle's hash combines
the mixed hashes of its words. All arithmetic is modulo 2**64 and the same on every machine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

U64 = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
for _c in range(65, 91):
    _BYTE[_c] = _BYTE[_c + 32]
_BASE = 0x9E3779B97F4A7C15
_PLACE = _rng.integers(1, 2**63, 16, dtype=np.uint64) * U64(2) + U64(1)
_GROUP = 1 << 20

#: ASCII white space: space, tab to carriage return.
SPACED = np.zeros(256, bool)
SPACED[[32, 9, 10, 11, 12, 13]] = True
#: ASCII but digits and letters.
ITEM = np.zeros(256, bool)
ITEM[:128] = True
ITEM[48:58] = ITEM[65:91] = ITEM[97:123] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all others."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    if n > 1:
        out[1:] = U64(_BASE)
        np.multiply.accumulate(out, out=out)
    return out


_POW = _powers(4096)


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; null is empty."""
    column = pa.compute.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words. No word goes over a row's end."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~separators[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, separators: np.ndarray) -> np.ndarray:
    """A hash of each word with A-Z as a-z."""
    global _POW
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    lengths = ends - starts
    if lengths.max() > len(_POW):
        _POW = _powers(int(lengths.max()))
    values = _BYTE.copy()
    values[separators] = 0
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + _GROUP)))
        lo, hi = starts[at], ends[to - 1]
        begin = starts[at:to] - lo
        span = np.diff(np.append(begin, hi - lo))
        place = np.arange(hi - lo) - np.repeat(begin, span)
        np.minimum(place, len(_POW) - 1, out=place)
        out[at:to] = np.add.reduceat(values[data[lo:hi]] * _POW[place], begin)
        at = to
    return mix(out + lengths.astype(np.uint64))


def rows_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each row, where its words begin in the list of words; one more entry at the end."""
    return np.searchsorted(starts, offsets)


def shingles(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `size` words of each row, and where each row's runs begin.

    A row with fewer words, but some, has the whole sequence as its one shingle.
    """
    counts = np.diff(bounds)
    runs = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out_bounds = np.concatenate([[0], np.cumsum(runs)])
    out = np.empty(out_bounds[-1], np.uint64)
    if len(words) >= size:
        whole = np.zeros(len(words) - size + 1, np.uint64)
        for k in range(size):
            whole += mix(words[k : k + len(whole)] ^ _PLACE[k]) * _PLACE[k]
        whole = mix(whole)
    for r in np.flatnonzero(runs):
        a, b = bounds[r], bounds[r + 1]
        if b - a >= size:
            out[out_bounds[r] : out_bounds[r + 1]] = whole[a : b - size + 1]
        else:
            short = words[a:b]
            total = (mix(short ^ _PLACE[: len(short)]) * _PLACE[: len(short)]).sum(dtype=np.uint64)
            out[out_bounds[r]] = mix(np.array([total + U64(len(short))]))[0]
    return out, out_bounds


def row_sets(column: pa.Array, size: int = 5, separators: np.ndarray = SPACED) -> list[np.ndarray]:
    """The set of word shingles of each row, as sorted hashes."""
    data, offsets = buffer_of(column)
    starts, ends = spans(data, offsets, separators)
    hashed, bounds = shingles(word_hashes(data, starts, ends, separators), rows_of(starts, offsets), size)
    return [np.unique(hashed[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
