"""Whitening of embeddings: leading eigenvectors of their covariance, and every vector projected on them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .blocks import batch_of

SCALE, SHIFT = 1024.0, 100_000
BLOCK_CELLS = 1 << 20
SUM_KEYS = 32
EPS = np.finfo(np.float64).eps
LONGEST = 1 << 62


# -- the eigenproblem of a symmetric matrix, on the driver: its size is the dimension of a vector ---------------------


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, reflectors) of an orthogonally similar tridiagonal matrix, by Householder reflections."""
    a = np.array(matrix, dtype=np.float64)
    n = len(a)
    mirrors = []
    for k in range(n - 2):
        v = a[k + 1:, k].copy()
        length = np.linalg.norm(v)
        if length > 0:
            v[0] += np.copysign(length, v[0])
            v /= np.linalg.norm(v)
            rest = a[k + 1:, k + 1:]
            p = rest @ v
            q = p - (v @ p) * v
            rest -= 2 * (np.outer(v, q) + np.outer(q, v))
            a[k + 1, k] = -np.copysign(length, a[k + 1, k])
        mirrors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of a tridiagonal matrix lie below each value of ``at``: negative pivots of T - at * I."""
    squares = off ** 2
    tiny = max(EPS ** 2 * float(squares.max(initial=0.0)), np.finfo(np.float64).tiny)
    pivot = diagonal[0] - at
    below = (pivot < 0).astype(np.int64)
    for i in range(1, len(diagonal)):
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        pivot = diagonal[i] - at - squares[i - 1] / pivot
        below += pivot < 0
    return below


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` greatest eigenvalues, falling: each is halved out of the Gershgorin interval by Sturm counts."""
    n = len(diagonal)
    reach = np.abs(np.concatenate((off, [0]))) + np.abs(np.concatenate(([0], off)))
    low = np.full(count, (diagonal - reach).min())
    high = np.full(count, (diagonal + reach).max())
    slack = EPS * n * max(abs(low[0]), abs(high[0])) + np.finfo(np.float64).tiny
    low, high = low - slack, high + slack
    rank = n - 1 - np.arange(count)  # eigenvalues counted from the least
    for _ in range(200):
        middle = low + (high - low) / 2
        if np.all((middle <= low) | (middle >= high)):
            break
        above = sturm_counts(diagonal, off, middle) <= rank
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    return low + (high - low) / 2


def _factored(diagonal: np.ndarray, off: np.ndarray, value: float, least: float):
    """T - value * I as row-pivoted triangular factors."""
    n = len(diagonal)
    d, up, up2 = diagonal - value, np.concatenate((off, [0.0])), np.zeros(n)
    times, swapped = np.zeros(n), np.zeros(n, dtype=bool)
    for i in range(n - 1):
        under = off[i]
        if abs(under) > abs(d[i]):
            swapped[i] = True
            times[i] = d[i] / under
            d[i], up[i], d[i + 1], up2[i] = under, d[i + 1], up[i] - times[i] * d[i + 1], up[i + 1]
            up[i + 1] = -times[i] * up[i + 1]
        else:
            d[i] = d[i] if abs(d[i]) >= least else np.copysign(least, d[i])
            times[i] = under / d[i]
            d[i + 1] -= times[i] * up[i]
    d[n - 1] = d[n - 1] if abs(d[n - 1]) >= least else np.copysign(least, d[n - 1])
    return d, up, up2, times, swapped


def _solved(factors, right: np.ndarray) -> np.ndarray:
    d, up, up2, times, swapped = factors
    n, b = len(d), right.copy()
    for i in range(n - 1):
        if swapped[i]:
            b[i], b[i + 1] = b[i + 1], b[i]
        b[i + 1] -= times[i] * b[i]
    for i in range(n - 1, -1, -1):
        if i + 1 < n:
            b[i] -= up[i] * b[i + 1]
        if i + 2 < n:
            b[i] -= up2[i] * b[i + 2]
        b[i] /= d[i]
    return b


def inverse_iteration(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray, rounds: int = 6) -> np.ndarray:
    """Unit eigenvectors (columns) of a tridiagonal matrix for falling eigenvalues.

    Vectors whose eigenvalues lie within a thousandth of the matrix's size of each other form a cluster, in which each new one is kept
    orthogonal to those before it.
    """
    n = len(diagonal)
    size = float(np.max(np.abs(diagonal) + np.abs(np.concatenate((off, [0]))) + np.abs(np.concatenate(([0], off)))))
    least = max(EPS * size, np.finfo(np.float64).tiny)
    rng = np.random.default_rng(0)
    out = np.zeros((n, len(values)))
    first, shifted = 0, np.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > 1e-3 * size:
            first = j
        shifted = min(float(value), shifted - 10 * least)  # equal eigenvalues are told apart
        factors = _factored(diagonal, off, shifted, least)
        v = rng.standard_normal(n)
        for _ in range(rounds):
            v /= np.abs(v).max()
            v = _solved(factors, v)
            v /= np.linalg.norm(v)
            for _ in range(2):
                v -= out[:, first:j] @ (out[:, first:j].T @ v)
                v /= np.linalg.norm(v)
        out[:, j] = v
    return out


def leading_eigenpairs(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The greatest eigenvalues (falling) of a symmetric matrix and their unit eigenvectors (columns)."""
    n = len(matrix)
    count = min(count, n)
    scale = float(np.abs(matrix).max(initial=0.0))
    if not count or scale == 0:
        return np.zeros(count), np.eye(n)[:, :count]
    diagonal, off, mirrors = tridiagonal(matrix / scale)
    values = leading_eigenvalues(diagonal, off, count)
    vectors = inverse_iteration(diagonal, off, values)
    for k in range(len(mirrors) - 1, -1, -1):
        v = mirrors[k]
        vectors[k + 1:] -= 2 * np.outer(v, v @ vectors[k + 1:])
    return values * scale, vectors / np.linalg.norm(vectors, axis=0)


# -- vectors as whole numbers, sums over all tasks ---------------------------------------------------------------------


def integers(lists: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, x) of the vectors of this dimension without null or non-finite entries; x = floor(1024 c) + 100000."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    whole = (size == dimension) & pc.is_valid(lists).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    values = pc.cast(flat, pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    c = values[np.repeat(whole, size)].reshape(-1, dimension)
    fine = np.isfinite(c).all(axis=1)
    x = np.clip(np.floor(SCALE * c[fine]), -LONGEST, LONGEST).astype(np.int64) + SHIFT
    return np.flatnonzero(whole)[fine], x


def _slices(batches: Iterable[pa.RecordBatch], column: int, dimension: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    step = max(1, BLOCK_CELLS // dimension)
    for batch in batches:
        for i in range(0, batch.num_rows, step):
            part = batch.slice(i, step)
            rows, x = integers(part.column(column), dimension)
            if len(rows):
                yield part, rows, x


def _summed(vectors: DataFrame, dimension: int, kind: type, shape: tuple[int, ...], add: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``add(x)`` over all vectors: one array per task, added up by ``SUM_KEYS`` tasks, then on the driver."""
    schema = pa.schema([("key", pa.int32()), ("data", pa.binary())])

    def inside(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(shape, dtype=kind)
        for _, _, x in _slices(batches, 0, dimension):
            total += add(x)
        if total.any():
            yield batch_of(schema, [TaskContext.get().partitionId() % SUM_KEYS], [total.tobytes()])

    def across(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(shape, dtype=kind), False
        for batch in batches:
            for data in batch.column(1):
                total, some = total + np.frombuffer(data.as_buffer(), dtype=kind).reshape(shape), True
        if some:
            yield batch_of(schema, [0], [total.tobytes()])

    ddl = "key int, data binary"
    got = vectors.mapInArrow(inside, ddl).repartition(SUM_KEYS, "key").mapInArrow(across, ddl).toArrow()
    total = np.zeros(shape, dtype=kind)
    for data in got["data"].to_pylist():
        total += np.frombuffer(data, dtype=kind).reshape(shape)
    return total


# -- the operator ------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Whitening:
    """What a fit leaves: counts and exact sums of the whole numbers x, components (columns) and their eigenvalues."""

    n: int
    sums: np.ndarray       # long, per dimension
    trace: float
    values: np.ndarray     # falling
    components: np.ndarray  # (dimension, count)

    @property
    def dimension(self) -> int:
        return len(self.sums)

    @property
    def floor_mean(self) -> np.ndarray:
        return self.sums // max(1, self.n)

    def project(self, x: np.ndarray) -> np.ndarray:
        """(x - mean) on each component, over the root of its eigenvalue."""
        low = self.floor_mean
        part = (self.sums - self.n * low) / max(1, self.n)  # the mean's rest, in [0, 1)
        return ((x - low) - part) @ self.components / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n * x - sums) ** 2, exactly; None beyond a 64-bit integer."""
        low = self.floor_mean
        rest = self.sums - self.n * low
        y = x - low
        reach = self.n * (int(np.abs(y).max(initial=0)) + 1)
        if reach * reach * self.dimension < 1 << 63:
            return ((self.n * y - rest) ** 2).sum(axis=1).tolist()
        exact = [sum((self.n * int(a) - int(r)) ** 2 for a, r in zip(row, rest)) for row in y]
        return [v if v < 1 << 63 else None for v in exact]


def common_dimension(vectors: DataFrame, column: str) -> int:
    """The length that most vectors have (of equally frequent ones the greater; 0 without vectors)."""
    sizes = vectors.where(F.col(column).isNotNull()).groupBy(F.size(column).alias("d")).count()
    top = sizes.orderBy(F.desc("count"), F.desc("d")).first()
    return top["d"] if top else 0


def fit(vectors: DataFrame, column: str = "embedding", components: int = 8) -> Whitening:
    """Sums and covariance over all vectors, and the leading eigenpairs of the covariance.

    A first pass gives n and the sums, a second the centred products: x less the whole part of the mean, which is exact, and the
    rest of the mean taken off the d x d sums. Tasks hand over d x d numbers each. Directions without variance are left out.
    """
    only = vectors.select(column)
    d = common_dimension(vectors, column)
    if not d:
        return Whitening(0, np.zeros(0, np.int64), 0.0, np.zeros(0), np.zeros((0, 0)))
    first = _summed(only, d, np.int64, (d + 1,), lambda x: np.concatenate(([len(x)], x.sum(axis=0))))
    n, sums = int(first[0]), first[1:]
    if not n:
        return Whitening(0, sums, 0.0, np.zeros(0), np.zeros((d, 0)))
    low = sums // n
    part = (sums - n * low) / n

    def products(x: np.ndarray) -> np.ndarray:
        y = (x - low).astype(np.float64)
        return y.T @ y

    covariance = _summed(only, d, np.float64, (d, d), products) / n - np.outer(part, part)
    values, vectors_ = leading_eigenpairs(covariance, components)
    trace = float(np.trace(covariance))
    real = values > 1e-12 * trace
    return Whitening(n, sums, trace, values[real], vectors_[:, real])


def identity_error(vectors: DataFrame, model: Whitening, column: str = "embedding") -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, over all vectors."""
    k = len(model.values)
    if not k:
        return 0.0

    def moments(x: np.ndarray) -> np.ndarray:
        z = model.project(x)
        return np.vstack((z.sum(axis=0), z.T @ z))

    got = _summed(vectors.select(column), model.dimension, np.float64, (k + 1, k), moments) / model.n
    return float(np.abs(got[1:] - np.outer(got[0], got[0]) - np.eye(k)).max())


OUT = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()),
                 ("explained", pa.float64()), ("identity_error", pa.float64())])
OUT_DDL = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, column: str = "embedding", components: int = 8) -> DataFrame:
    """For each vector and component (vec_id, component, n, deviation, whitened, explained, identity_error).

    Rows whose vector is null or holds null or non-finite entries take no part, nor do vectors of another length than most have.
    Repeated rows count and come out each time, null ids too; other columns are ignored. Entries beyond 2 ** 62 are taken as that.
    There are fewer than ``components`` rows for a vector where it has fewer dimensions or where the rest of them have no variance; none
    without any variance, or from an empty table. ``deviation`` is null beyond a 64-bit integer.

    Every pass is a map over the rows; the model that is sent to the tasks holds components x d numbers.
    """
    model = fit(vectors, column, components)
    k = len(model.values)
    if not k:
        return vectors.sparkSession.createDataFrame([], OUT_DDL)
    error = identity_error(vectors, model, column)
    sent = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        explained = held.values / held.trace
        for part, rows, x in _slices(batches, 1, held.dimension):
            m = len(rows)
            ids = part.column(0).take(pa.array(rows)).take(pa.array(np.repeat(np.arange(m), k)))
            deviation = pa.array(held.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
            yield batch_of(OUT, ids, np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, held.n), deviation, held.project(x).ravel(),
                           np.tile(explained, m), np.full(m * k, error))

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), column).mapInArrow(run, OUT_DDL)
