"""Whitening of embeddings by leading principal components.

Three passes over the vectors, each a helper over Arrow batches whose partial sums Spark adds up: the sums of each
dimension; the products of centred entries; the check of the whitened vectors' covariance. Entries are integers, and the
first two passes add integers exactly, so their results do not depend on how rows are dealt. The centre of the products is the integer next to
the mean, and what is left of the mean, under half a unit, is taken off exactly. The driver holds one matrix of the vectors' dimension: it is made
tridiagonal by Householder reflections, the leading eigenvalues are bisected by Sturm counts, inverse iteration gives the
eigenvectors, made orthogonal within clusters of near eigenvalues. The components are broadcast for the projection.

Defined cases: rows whose vector is null or empty or holds null or non-finite entries are dropped, and so are vectors whose length is
not the most frequent one (of equally frequent lengths the smallest counts); null and repeated ids are rows like others;
an entry beyond a long's range takes the nearest long; a component without variance (eigenvalue not above the rounding of the largest) is none, so a single
row, or rows that are all equal, give no rows, as does an empty table; a squared deviation beyond a long is null; equal eigenvalues give any basis of their space.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64.0, 1_000_000
#: Components at most.
COMPONENTS = 32
#: Rows that a task turns to numbers at once.
ROWS = 4096
#: Eigenvalues nearer than this part of the largest are one cluster, whose vectors are made orthogonal to each other.
CLUSTER = 1e-3
#: Split of exact sums into two columns, so that no partial sum leaves a long or a decimal.
LIMB = 62


def dimension(vectors: DataFrame, column: str) -> int:
    """The most frequent length of usable vectors, 0 if there is none."""
    v = F.col(column)
    usable = vectors.where(F.size(v) > 0).where(~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    row = usable.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return row["n"] if row else 0


def entries(batch: pa.RecordBatch, column: str, d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The usable rows of a batch, ``ROWS`` at most a time, and their entries as integers."""
    for start in range(0, batch.num_rows, ROWS):
        part = batch.slice(start, ROWS)
        part = part.filter(pc.fill_null(pc.equal(pc.list_value_length(part.column(column)), d), False))
        if not part.num_rows:
            continue
        values = part.column(column).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, d)
        fine = np.isfinite(values).all(axis=1)
        part, scaled = part.filter(pa.array(fine)), np.floor(SCALE * values[fine])
        if part.num_rows:
            inside = np.abs(scaled) < 2.0**62
            x = np.where(inside, scaled, 0).astype(np.int64) + SHIFT
            if not inside.all():  # adding in Python integers, then the nearest long
                top = 2**63 - 1
                for i, j in zip(*np.nonzero(~inside), strict=True):
                    x[i, j] = max(-top - 1, min(top, int(scaled[i, j]) + SHIFT)) if np.isfinite(scaled[i, j]) else (top if scaled[i, j] > 0 else -top - 1)
            yield part, x


def _limbs(values: list[int]) -> tuple[pa.Array, pa.Array]:
    """Integers of any size as value = high * 2^62 + low."""
    from decimal import Decimal

    low = [v - ((v >> LIMB) << LIMB) for v in values]
    return pa.array([Decimal(v >> LIMB) for v in values], pa.decimal128(38, 0)), pa.array(low, pa.int64())


def _added(vectors: DataFrame, column: str, d: int, partial: Callable[[np.ndarray], list[int]]) -> tuple[list[int], int]:
    """The sum of ``partial`` (a list of integers of fixed length) over all blocks of rows, and the number of rows; exact."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for batch in batches:
            for _, x in entries(batch, column, d):
                part = partial(x)
                total, n = part if total is None else list(map(int.__add__, total, part)), n + len(x)
        if total is not None:
            high, low = _limbs([*total, n])
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total) + 1), pa.int32()), high, low], names=["place", "high", "low"])

    parts = vectors.select(column).mapInArrow(run, "place int, high decimal(38,0), low long")
    rows = parts.groupBy("place").agg(F.sum("high").alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low")).collect()
    sums = [0] * len(rows)
    for r in rows:
        sums[r["place"]] = (int(r["high"]) << LIMB) + int(r["low"])
    return (sums[:-1], sums[-1]) if rows else ([], 0)


def _column_sums(x: np.ndarray) -> list[int]:
    small = int(np.abs(x.astype(np.float64)).max()) < 2**62 // len(x)
    return [int(v) for v in (x.sum(axis=0) if small else x.astype(object).sum(axis=0))]


def _products(x: np.ndarray, centre: list[int]) -> list[int]:
    """The upper triangle of the sum of products of ``x - centre``. A product of floats is exact as long as no sum reaches 2^53."""
    y = x.astype(object) - np.array(centre, object) if max(map(abs, centre)) >= 2**61 or np.abs(x.astype(np.float64)).max() >= 2.0**61 else x - np.array(centre, np.int64)
    at = np.triu_indices(x.shape[1])
    if int(np.abs(y).max()) ** 2 * len(y) < 2**53:
        f = y.astype(np.float64)
        return [int(v) for v in (f.T @ f)[at]]
    y = y.astype(object)
    return [int(v) for v in (y.T @ y)[at]]


def covariance(vectors: DataFrame, column: str, d: int) -> tuple[np.ndarray, list[int], int]:
    """(covariance, sums of each dimension, rows); divisor is the number of rows, every entry correctly rounded."""
    sums, n = _added(vectors, column, d, _column_sums)
    if not n:
        return np.zeros((d, d)), [0] * d, 0
    centre = [(2 * s + n) // (2 * n) for s in sums]
    products, _ = _added(vectors, column, d, lambda x: _products(x, centre))
    rest = [s - n * c for s, c in zip(sums, centre, strict=True)]
    v = np.zeros((d, d))
    for i, j, m in zip(*(a.tolist() for a in np.triu_indices(d)), products, strict=True):
        v[i, j] = v[j, i] = float(Fraction(n * m - rest[i] * rest[j], n * n))
    return v, sums, n


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, side diagonal, reflections): Householder reflections u, I - 2uu', that make the symmetric ``a`` tridiagonal."""
    a, reflections = a.copy(), []
    for k in range(len(a) - 2):
        x = a[k + 1:, k]
        size = np.abs(x).max()
        u = np.zeros_like(x)
        if size > 0 and np.any(x[1:]):
            u = x / size
            u[0] += np.copysign(np.linalg.norm(u), u[0])
            u /= np.linalg.norm(u)
            p = a[k + 1:, k + 1:] @ u
            q = 2 * (p - (u @ p) * u)
            a[k + 1:, k + 1:] -= np.outer(u, q) + np.outer(q, u)
            x = x - 2 * (u @ x) * u
            a[k + 1:, k] = a[k, k + 1:] = x
        reflections.append(u)
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflections


def below(diagonal: np.ndarray, side: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sturm counts: the number of eigenvalues below each of ``x``."""
    tiny = np.finfo(float).tiny
    count, q = np.zeros(len(x), int), np.ones(len(x))
    for i, value in enumerate(diagonal):
        q = value - x - (side[i - 1] ** 2 / q if i else 0)
        q = np.where(q == 0, -tiny, q)
        q = np.where(np.abs(q) < tiny, np.copysign(tiny, q), q)
        count += q < 0
    return count


def leading(diagonal: np.ndarray, side: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, each bisected until its bounds are neighbours."""
    edge = np.abs(np.concatenate([[0], side])) + np.abs(np.concatenate([side, [0]]))
    low, high = np.full(k, (diagonal - edge).min()), np.full(k, (diagonal + edge).max())
    width = max(np.abs(low).max(), np.abs(high).max(), np.finfo(float).tiny)
    low, high = low - 1e-15 * width, high + 1e-15 * width
    place = len(diagonal) - 1 - np.arange(k)  # so many lie below the wanted one
    while True:
        middle = low + (high - low) / 2
        open_ = (middle > low) & (middle < high)
        if not open_.any():
            return high
        under = below(diagonal, side, middle) <= place
        low, high = np.where(open_ & under, middle, low), np.where(open_ & ~under, middle, high)


def _solve(diagonal: np.ndarray, side: np.ndarray, shift: float, right: np.ndarray, least: float) -> np.ndarray:
    """Solve (T - shift) y = right by elimination with row exchanges; a vanishing pivot becomes ``least``."""
    n = len(diagonal)
    rows = np.zeros((n, 3))
    rows[:, 0] = diagonal - shift
    rows[:-1, 1] = side
    y = right.copy()
    for i in range(n - 1):
        below_ = np.array([side[i], rows[i + 1, 0], rows[i + 1, 1]])
        if abs(below_[0]) > abs(rows[i, 0]):
            below_, rows[i] = rows[i].copy(), below_
            y[i], y[i + 1] = y[i + 1], y[i]
        if abs(rows[i, 0]) < least:
            rows[i, 0] = np.copysign(least, rows[i, 0])
        factor = below_[0] / rows[i, 0]
        rows[i + 1, 0], rows[i + 1, 1] = below_[1] - factor * rows[i, 1], below_[2] - factor * rows[i, 2]
        y[i + 1] -= factor * y[i]
    if abs(rows[-1, 0]) < least:
        rows[-1, 0] = np.copysign(least, rows[-1, 0])
    for i in range(n - 1, -1, -1):
        known = rows[i, 1] * y[i + 1] if i + 1 < n else 0.0
        known += rows[i, 2] * y[i + 2] if i + 2 < n else 0.0
        y[i] = (y[i] - known) / rows[i, 0]
        if abs(y[i]) > 1e200:
            y *= 1e-200
    return y


def eigenvectors(diagonal: np.ndarray, side: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (columns) of the tridiagonal matrix by inverse iteration from fixed starts."""
    n, scale = len(diagonal), max(np.abs(values).max(), np.finfo(float).tiny)
    out, draw, first = np.zeros((n, len(values))), np.random.default_rng(11), 0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * scale:
            first = j
        y = draw.standard_normal(n)
        near = out[:, first:j]
        for _ in range(5):
            y = _solve(diagonal, side, value, y / np.linalg.norm(y), np.finfo(float).eps * scale)
            y /= np.abs(y).max()
            for _ in range(2):  # twice is enough to lose what the first time left
                y -= near @ (near.T @ y)
        out[:, j] = y / np.linalg.norm(y)
    return out


def components(v: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of the symmetric matrix ``v``: those with variance, ``most`` at most, falling."""
    scale = np.abs(v).max() if v.size else 0
    if not scale > 0:
        return np.zeros(0), np.zeros((len(v), 0))
    diagonal, side, reflections = tridiagonal(v / scale)
    values = leading(diagonal, side, min(most, len(v)))
    values = values[values > len(v) * np.finfo(float).eps * max(values[0], 0)]
    vectors = eigenvectors(diagonal, side, values)
    for k in range(len(reflections) - 1, -1, -1):
        u = reflections[k]
        vectors[k + 1:] -= 2 * np.outer(u, u @ vectors[k + 1:])
    return values * scale, vectors


class Whitening:
    """A fitted projection: fixed size, of the vectors' dimension times ``most``."""

    def __init__(self, sums: list[int], n: int, values: np.ndarray, vectors: np.ndarray, trace: float) -> None:
        self.sums, self.n, self.values, self.vectors = sums, n, values, vectors
        self.explained = values / trace if trace else values
        self.centre = [s // n for s in sums]
        self.rest = np.array([float(Fraction(s - n * c, n)) for s, c in zip(sums, self.centre, strict=True)])
        self.error = 0.0

    def whitened(self, x: np.ndarray) -> np.ndarray:
        y = (x.astype(object) - np.array(self.centre, object)).astype(np.float64) if np.abs(x.astype(np.float64)).max() >= 2.0**61 else (
            x - np.array(self.centre, np.int64)).astype(np.float64)
        return (y - self.rest) @ self.vectors / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S)^2; exact, null beyond a long."""
        largest = int(np.abs(x.astype(np.float64)).max()) + max(map(abs, self.centre)) + 1
        if self.n * largest < 2**61:
            away = x * self.n - np.array(self.sums, np.int64)
            if int(np.abs(away).max()) ** 2 * x.shape[1] < 2**62:
                return (away * away).sum(axis=1).tolist()
        away = x.astype(object) * self.n - np.array(self.sums, object)
        return [s if s < 2**63 else None for s in (away * away).sum(axis=1).tolist()]


def fit(vectors: DataFrame, column: str = "embedding", most: int = COMPONENTS) -> Whitening | None:
    """Fit on all usable vectors and measure how far the whitened covariance is from the identity; None without a component."""
    d = dimension(vectors, column)
    if not d:
        return None
    v, sums, n = covariance(vectors, column, d)
    values, axes = components(v, most)
    if not len(values):
        return None
    model, k = Whitening(sums, n, values, axes, float(np.trace(v))), len(values)
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            for _, x in entries(batch, column, d):
                w = np.hstack([shared.value.whitened(x), np.ones((len(x), 1))])
                total += w.T @ w
        if total[k, k]:
            yield pa.RecordBatch.from_arrays([pa.array(range((k + 1) ** 2), pa.int32()), pa.array(total.ravel())], names=["place", "part"])

    rows = vectors.select(column).mapInArrow(run, "place int, part double").groupBy("place").agg(F.sum("part").alias("part")).collect()
    total = np.zeros((k + 1) ** 2)
    for r in rows:
        total[r["place"]] = r["part"] / n
    total = total.reshape(k + 1, k + 1)
    model.error = float(np.abs(total[:k, :k] - np.outer(total[:k, k], total[k, :k]) - np.eye(k)).max())
    shared.unpersist()
    return model


FIELDS = [T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
          T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType())]


def whiten(vectors: DataFrame, column: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """One row for each usable vector and component: the other columns of ``vectors`` (those named like a result are replaced) and
    component, n, deviation, whitened, explained, identity_error."""
    names = [f.name for f in FIELDS]
    others = [c for c in vectors.columns if c != column and c not in names]
    schema = T.StructType([*vectors.select(*others).schema, *FIELDS])
    model = fit(vectors, column, most)
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    k, d = len(model.values), len(model.sums)
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part, x in entries(batch, column, d):
                n = len(x)
                row = pa.array(np.repeat(np.arange(n), k))
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c).take(row) for c in others], pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                     pa.array(np.full(n * k, m.n)), pa.array(m.deviation(x), pa.int64()).take(row), pa.array(m.whitened(x).ravel()),
                     pa.array(np.tile(m.explained, n)), pa.array(np.full(n * k, m.error))], names=schema.names)

    return vectors.select(*others, column).mapInArrow(run, schema)
