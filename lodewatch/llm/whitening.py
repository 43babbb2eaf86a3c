"""Whitening of embeddings: Welford states of partitions, merged in parallel, then a symmetric QR.

Each partition streams its vectors into one state (count, exact sums, means, sum of outer products of
deviations) by rank-one updates. States are merged by the parallel update formula, some at a time in
tasks of their own, until one is left: it has the size of the dimension squared, however many rows
there are, and is all that the driver sees. Its covariance is brought to tridiagonal form by
reflections and solved by implicit QR steps. A second pass projects the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import settle, table
from .words import give_back

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Scaled entries are held within this, so that a row's numbers stay exact.
BOUND = float(1 << 50)
#: States that one task merges.
MERGE = 16
#: An eigenvalue counts as 0 below this share of the largest.
TINY = 1e-12

STATE = "part long, n long, sums array<long>, mean array<double>, m2 array<double>"


@dataclass
class State:
    """m2: the sum over rows of the outer product of x - mean with itself."""

    n: int
    sums: np.ndarray
    mean: np.ndarray
    m2: np.ndarray

    @classmethod
    def empty(cls, dims: int) -> State:
        return cls(0, np.zeros(dims, np.int64), np.zeros(dims), np.zeros((dims, dims)))

    def add(self, row: np.ndarray) -> None:
        """One rank-one update."""
        self.n += 1
        delta = row - self.mean
        self.mean += delta / self.n
        self.m2 += np.outer(delta * ((self.n - 1) / self.n), delta)

    def merge(self, other: State) -> None:
        if not other.n:
            return
        n = self.n + other.n
        delta = other.mean - self.mean
        self.m2 += other.m2 + np.outer(delta, delta) * (self.n * other.n / n)
        self.mean += delta * (other.n / n)
        self.sums = self.sums + other.sums
        self.n = n

    def columns(self) -> dict:
        return {"n": self.n, "sums": self.sums.tolist(), "mean": self.mean.tolist(), "m2": self.m2.ravel().tolist()}

    @classmethod
    def of(cls, row) -> State:
        d = len(row.mean)
        return cls(int(row.n), np.array(row.sums, np.int64), np.array(row.mean, float), np.array(row.m2, float).reshape(d, d))


def householder(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, subdiagonal and Q of a symmetric matrix: Q.T a Q is tridiagonal."""
    a, d = a.copy(), len(a)
    q = np.eye(d)
    for k in range(d - 2):
        x = a[k + 1 :, k]
        size = np.linalg.norm(x)
        if size == 0 or not x[1:].any():
            continue
        v = x.copy()
        v[0] += np.copysign(size, x[0])
        v /= np.linalg.norm(v)
        a[k + 1 :] -= 2 * np.outer(v, v @ a[k + 1 :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def symmetric_qr(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, by implicit QR steps with Wilkinson's shift.

    Each vector's largest entry (the first of equals) is positive.
    """
    size = np.abs(matrix).max() if matrix.size else 0.0
    if size == 0:
        return np.zeros(len(matrix)), np.eye(len(matrix))
    d, e, q = householder((matrix + matrix.T) / (2 * size))
    v = np.ascontiguousarray(q.T)  # rows are the vectors, so that a rotation touches two rows
    end = len(d) - 1
    eps = np.finfo(float).eps
    while end > 0:
        small = np.abs(e[:end]) <= eps * (np.abs(d[:end]) + np.abs(d[1 : end + 1]))
        e[:end][small] = 0
        if e[end - 1] == 0:
            end -= 1
            continue
        zeros = np.flatnonzero(e[:end] == 0)
        start = zeros[-1] + 1 if len(zeros) else 0
        half = (d[end - 1] - d[end]) / 2
        shift = d[end] - e[end - 1] ** 2 / (half + np.copysign(np.hypot(half, e[end - 1]), half or 1.0))
        x, z = d[start] - shift, e[start]
        for k in range(start, end):
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > start:
                e[k - 1] = r
            a, b, f = d[k], d[k + 1], e[k]
            d[k], d[k + 1] = c * c * a + 2 * c * s * f + s * s * b, s * s * a - 2 * c * s * f + c * c * b
            e[k] = c * s * (b - a) + (c * c - s * s) * f
            if k < end - 1:
                z, e[k + 1] = s * e[k + 1], c * e[k + 1]
                x = e[k]
            v[k], v[k + 1] = c * v[k] + s * v[k + 1], c * v[k + 1] - s * v[k]
    order = np.argsort(-d, kind="stable")
    vectors = v[order].T
    largest = vectors[np.argmax(np.abs(vectors) > np.abs(vectors).max(axis=0) * (1 - 1e-9), axis=0), np.arange(len(d))]
    return d[order] * size, vectors * np.where(largest < 0, -1.0, 1.0)


def scaled(embedding: Column) -> Column:
    """x of a vector, as longs; null where the vector is null or has a null, infinite or NaN entry."""
    fine = F.forall(embedding, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    held = lambda c: F.least(F.greatest(F.floor(SCALE * c.cast("double")).cast("double"), F.lit(-BOUND)), F.lit(BOUND))
    return F.when(fine, F.transform(embedding, lambda c: held(c).cast("long") + SHIFT))


def matrix_of(column: pa.Array, dims: int, kind: type) -> np.ndarray:
    """Rows of lists as a matrix; what a shorter list lacks is SHIFT, the x of 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    if (sizes == dims).all():
        return flat.astype(kind).reshape(-1, dims)
    out = np.full((len(sizes), dims), SHIFT, kind)
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


def states(rows: DataFrame, column: str, dims: int) -> DataFrame:
    """One state a partition that has rows, of a column of number lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        state = State.empty(dims)
        for batch in batches:
            exact = matrix_of(batch.column(column), dims, np.float64)
            for row in exact:
                state.add(row)
            if pa.types.is_integer(batch.schema.field(column).type.value_type):
                state.sums = state.sums + matrix_of(batch.column(column), dims, np.int64).sum(axis=0)
        if state.n:
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), **state.columns()}], schema=arrow_state)
        give_back()

    return rows.select(column).mapInArrow(run, STATE)


arrow_state = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.int64())), ("mean", pa.list_(pa.float64())), ("m2", pa.list_(pa.float64()))])


def merged(parts: DataFrame) -> State | None:
    """The one state of all: MERGE neighbours a task, in the order of their partitions, until one is left."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        total = State.empty(len(rows["mean"].iloc[0]))
        for row in rows.itertuples():
            total.merge(State.of(row))
        return pd.DataFrame([{"part": int(rows["part"].iloc[0]) // MERGE, **total.columns()}])

    parts = settle(parts)
    most = parts.agg(F.max("part")).first()[0]
    while most is not None and most > 0:
        parts = settle(parts.groupBy(F.expr(f"part div {MERGE}").alias("group")).applyInPandas(run, STATE))
        most //= MERGE
    row = parts.first()
    return State.of(row) if row else None


@dataclass
class Whitening:
    """n, sums, e and trace of the fit list; components: as columns, each over the root of its eigenvalue."""

    n: int
    sums: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    components: np.ndarray


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """vectors: (x array<long>), no nulls. None where there is no row or no dimension."""
    dims = vectors.agg(F.max(F.size("x"))).first()[0]
    if not dims:
        return None
    state = merged(states(vectors, "x", dims))
    values, axes = symmetric_qr(state.m2 / state.n)
    values, axes = np.maximum(values[:components], 0.0), axes[:, :components]
    roots = np.sqrt(np.where(values > values[0] * TINY, values, np.inf))
    return Whitening(state.n, state.sums, np.where(np.isinf(roots), 0.0, values), float(np.trace(state.m2) / state.n), axes / roots)


def projected(rows: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, deviation, whitened array<double>) a row of (vec_id, x)."""
    dims, n = len(model.sums), model.n
    quotient, rest = np.divmod(model.sums, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix_of(batch.column("x"), dims, np.int64)
            white = ((x - quotient).astype(float) - rest / n) @ model.components
            off = n * (x - quotient).astype(object) - rest.astype(object) if needs_big(x, quotient, n) else n * (x - quotient) - rest
            sums = (off * off).sum(axis=1)
            deviation = pa.array([int(v) if int(v) < 1 << 63 else None for v in sums], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), deviation, pa.array(list(white), pa.list_(pa.float64()))], names=["vec_id", "deviation", "whitened"])
        give_back()

    return rows.mapInArrow(run, "vec_id long, deviation long, whitened array<double>")


def needs_big(x: np.ndarray, quotient: np.ndarray, n: int) -> bool:
    """Whether the sum of squares may leave a long."""
    return x.size > 0 and float(np.abs(x - quotient).max() + 1) * n * np.sqrt(x.shape[1]) > 2.0**31


def whiten(embeddings: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row per remaining vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Null vectors and vectors with null, infinite or NaN entries are dropped. A null vec_id stays,
    repeated rows count and come back as often as they stand there, other columns are ignored. A
    shorter vector than the longest counts as filled up with zeros. No vectors, or only empty ones,
    give no rows; with fewer dimensions than `components` there are as many components. A component
    without variance has whitened and explained 0 and is left out of identity_error. Entries are
    held within BOUND after scaling. A deviation beyond a long is null.
    """
    x = scaled(F.col(f"`{vector}`"))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where("x is not null")
    model = fit(rows.select("x"), components)
    if model is None:
        kinds = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return embeddings.sparkSession.createDataFrame([], kinds)
    white = settle(projected(rows, model))
    check = merged(states(white, "whitened", len(model.eigenvalues)))
    wanted = np.diag((model.eigenvalues > 0).astype(float))
    error = float(np.abs(check.m2 / check.n - wanted).max())
    explained = F.array(*[F.lit(float(e / model.trace) if model.trace else 0.0) for e in model.eigenvalues])
    each = white.select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return each.select("vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("k")).alias("explained"), F.lit(error).alias("identity_error"))


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    """See whiten: null or non-finite vectors give no rows, empty tables none."""
    return whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
