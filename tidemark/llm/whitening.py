"""Whitening of embeddings: blockwise TSQR of the centred rows, one-sided Jacobi on R's columns, projection on the components.

R of a QR factorisation has the rows' covariance (R'R = X'X) without forming it, so that small deviations keep their digits. Every task reduces its rows to one R of
dimension times dimension, these are combined in a tree of small groups, and the last one is worked on where it lies in memory: what leaves the tasks is bounded by the
dimension, never by the rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut

#: The query's contract: an entry c is floor(SCALE * c) + SHIFT, and so many components are returned.
SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Entries from here on have no such long; vectors that hold one are left out like those with non-finite entries.
LIMIT = float(2**56)
#: Rows of one QR step, and triangles that one group combines.
BLOCK, FAN = 4096, 8
SWEEPS, CLOSE = 60, 1e-15


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The rows of a column of packed vectors."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<i8").reshape(-1, dims)


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is no null, not empty and holds finite entries only, of the length that most of these have (of equal ones the larger)."""
    as_double = F.col(vector).cast("array<double>")
    return df.withColumn(vector, as_double).where(F.col(vector).isNotNull() & (F.size(vector) > 0)).where(F.forall(vector, lambda c: F.coalesce(F.abs(c) < LIMIT, F.lit(False))))


def quantised(rows: DataFrame, vector: str) -> DataFrame:
    """The rows with `x`, the vector's entries as little-endian longs, in place of the vector."""
    fields = [f for f in rows.schema.fields if f.name != vector]
    kept = [f.name for f in fields]

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(vector)
            entries = lists.flatten().to_numpy(zero_copy_only=False)
            x = (np.floor(entries * SCALE).astype(np.int64) + SHIFT).astype("<i8").tobytes()
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]) * 8
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array([x[a:b] for a, b in zip(ends[:-1], ends[1:])], pa.binary())], [*kept, "x"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "x binary"])
    return rows.mapInArrow(pack, schema)


def totals(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """(n, S): rows and exact sums for each dimension. High and low halves are summed apart, so nothing overflows."""

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for batch in batches:
            x = _matrix(batch.column("x"), dims)
            n, high, low = n + len(x), high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()), pa.array(high), pa.array(low)], ["dim", "n", "high", "low"])

    sums = fit.mapInArrow(partial, "dim int, n long, high long, low long").groupBy("dim")
    rows = sums.agg(F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]).collect()
    by_dim = {r["dim"]: (int(r["high"]) << 32) + int(r["low"]) for r in rows}
    return (rows[0]["n"] if rows else 0), [by_dim.get(d, 0) for d in range(dims)]


class Centre:
    """The mean S/n as a whole part, taken off exactly, and a rest below 1."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.whole = n, np.array([s // n for s in sums], np.int64)
        self.over = [s % n for s in sums]  # S - n * whole
        self.rest = np.array([r / n for r in self.over])

    def rows(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n*x - S)^2, exact; null where no long holds them."""
        off = x - self.whole
        size = (np.abs(off.astype(np.float64)).max(1, initial=0.0) + 1) * self.n
        if size.max(initial=0.0) ** 2 * x.shape[1] < 2.0**62:
            return ((off * self.n - np.array(self.over, np.int64)) ** 2).sum(1).tolist()
        exact = [sum((int(v) * self.n - o) ** 2 for v, o in zip(row, self.over)) for row in off]
        return [e if e < 2**63 else None for e in exact]


def triangle(fit: DataFrame, dims: int, centre: Centre) -> np.ndarray:
    """R of the centred rows: one for each task, then FAN at a time until one is left."""

    def reduce(blocks: Iterable[np.ndarray]) -> np.ndarray:
        r = np.zeros((0, dims))
        for block in blocks:
            r = np.linalg.qr(np.concatenate([r, block]), mode="r")
        return r

    def record(part: int, r: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([r.astype("<f8").tobytes()], pa.binary())], ["part", "r"])

    def of_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = reduce(centre.rows(_matrix(b.column("x").slice(i, BLOCK), dims)) for b in batches for i in range(0, b.num_rows, BLOCK))
        if len(r):
            yield record(TaskContext.get().partitionId(), r)

    def combined(key, table):
        parts = sorted(zip(table.column("part").to_pylist(), table.column("r").to_pylist()))
        return pa.Table.from_batches([record(key[0].as_py(), reduce(np.frombuffer(r, "<f8").reshape(-1, dims) for _, r in parts))])

    left, out = fit.rdd.getNumPartitions(), fit.mapInArrow(of_task, "part long, r binary")
    while left > 1:
        grouped = out.withColumn("group", F.floor(F.col("part") / FAN)).groupBy("group")
        out, left = grouped.applyInArrow(combined, "part long, r binary"), -(-left // FAN)
    return reduce(np.frombuffer(r["r"], "<f8").reshape(-1, dims) for r in out.collect())  # one row


def one_sided_jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(components as columns, singular values), falling: plane rotations from the right until all columns of `r` are orthogonal.

    A sweep meets every pair of columns once, in rounds of disjoint pairs that turn together. Each component's largest entry is positive.
    """
    dims = r.shape[1]
    even = dims + dims % 2
    a, v = np.zeros((max(len(r), 1), even)), np.eye(even)
    a[: len(r), :dims] = r
    least = (np.linalg.norm(a) * np.finfo(float).eps) ** 2
    order = np.arange(even)
    for _ in range(SWEEPS):
        turned = False
        for _ in range(even - 1):
            p, q = order[: even // 2].copy(), order[even // 2 :][::-1].copy()
            x, y = a[:, p], a[:, q]
            alpha, beta, gamma = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            turn = (np.abs(gamma) > CLOSE * np.sqrt(alpha * beta)) & (np.maximum(alpha, beta) > least) & (np.minimum(alpha, beta) > 0)
            order[1:] = np.roll(order[1:], 1)
            if not turn.any():
                continue
            turned = True
            p, q, alpha, beta, gamma = p[turn], q[turn], alpha[turn], beta[turn], gamma[turn]
            zeta = (beta - alpha) / (2 * gamma)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            s = c * t
            for m in (a, v):
                x, y = m[:, p], m[:, q]
                m[:, p], m[:, q] = c * x - s * y, s * x + c * y
        if not turned:
            break
    values = np.linalg.norm(a, axis=0)
    real = np.abs(v[:dims]).max(0) > 0  # not the column that made the number even
    values, v = values[real][:], v[:dims, real]
    falling = np.argsort(-values, kind="stable")[:dims]
    values, v = values[falling], v[:, falling]
    return v * np.where(v[np.abs(v).argmax(0), np.arange(v.shape[1])] < 0, -1.0, 1.0), values


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) for each usable row of `df` and component, most important first.

    Components are those of the distinct quantised vectors. Left out: rows whose vector is null, empty, of another length than most, or holds an entry that is null, not finite
    or of 2**56 and more. Rows with one key, or none, are rows of their own; repeated vectors count once in the fit; columns but these two are not read, whatever their names.
    There are no more components than dimensions; those along which the vectors don't differ (also with one distinct vector) have a null `whitened` and an `explained` of 0, or
    null if nothing differs, and are no part of `identity_error`. A deviation that no long holds is null. An empty table gives no rows.
    """
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = usable(df.select(key, vector), vector)
    length = rows.groupBy(F.size(vector).alias("dims")).count().orderBy(F.col("count").desc(), F.col("dims").desc()).limit(1).collect()
    if not length:
        return df.sparkSession.createDataFrame([], schema)
    dims = length[0]["dims"]
    rows = quantised(rows.where(F.size(vector) == dims), vector)
    fit = cut(rows.select("x").distinct(), "vectors")
    n, sums = totals(fit, dims)
    centre = Centre(n, sums)
    vectors, values = one_sided_jacobi(triangle(fit, dims, centre))
    vectors, energy = vectors[:, :most], values**2 / n
    trace, k = float(energy.sum()), min(most, dims)
    differs = values[:k] > values[0] * dims * np.finfo(float).eps
    scaled = vectors / np.where(differs, np.sqrt(np.where(differs, energy[:k], 1.0)), 1.0)
    scaled[:, ~differs] = 0.0
    explained = [float(e / trace) if trace > 0 else None for e in energy[:k]]

    def products(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            w = centre.rows(_matrix(batch.column("x"), dims)) @ scaled
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(k * k), pa.int32()), pa.array(total.ravel())], ["cell", "v"])

    cells = {r["cell"]: r["v"] for r in fit.mapInArrow(products, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()}
    drop_cut(fit)
    covariance = np.array([cells[i] for i in range(k * k)]).reshape(k, k)[np.ix_(differs, differs)] / n
    error = float(np.abs(covariance - np.eye(len(covariance))).max()) if differs.any() else None

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                x, m = _matrix(batch.column("x"), dims), batch.num_rows
                w = centre.rows(x) @ scaled
                each = pa.array(np.repeat(np.arange(m), k))
                values = pa.array(w.ravel(), mask=np.tile(~differs, m))
                columns = [batch.column(key).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), pa.array(centre.deviations(x), pa.int64()).take(each), values]
                columns += [pa.array(explained * m, pa.float64()), pa.array([error] * (m * k), pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, schema)
