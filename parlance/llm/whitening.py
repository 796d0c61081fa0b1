"""Whitening of vectors by a cyclic Jacobi eigendecomposition of their scatter.

The fit takes two scans: sums by dimension, then the scatter of the vectors centred on the nearest whole numbers to the
means.  Both add whole numbers, so they are exact in any order of tasks; what the whole centre leaves of the mean is taken off in
whole numbers too, and each entry of the covariance is rounded once.  The driver holds one d x d matrix and rotates away its
off-diagonal entries, one pair of dimensions after another, sweep by sweep, which keeps small eigenvalues accurate.  A third
scan measures how far the whitened rows' covariance is from the identity.  No row leaves its task: a task sends d rows, then d * d.

Edge cases: rows whose vector is null, empty or holds a null or non-finite entry give nothing.  Covariances need one length:
where lengths differ, the most frequent one counts (of equally frequent ones the longer) and rows of others give nothing.
Whole-number components beyond 2^40 in size count as 2^40.  Components whose eigenvalue is not above 1e-11 of the greatest don't
exist to double precision and give no rows (all of them where all vectors are equal).  A deviation that doesn't fit a long is null.
Null and repeated ids and repeated rows are kept; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import EXACT, exact, finite, floored

SCALE, SHIFT, LIMIT = 64, 1_000_000, 1 << 40
COMPONENTS = 32
LEAST_EIGENVALUE = 1e-11
_LONG = (1 << 63) - 1


class Whitening(NamedTuple):
    n: int
    sums: list[int]  # by dimension
    eigenvalues: np.ndarray  # of the components, falling
    vectors: np.ndarray  # unit eigenvectors, one a column
    explained: list[float]


def jacobi(matrix: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of a symmetric matrix, by rotations over all pairs in turn."""
    a, d = np.array(matrix, float), len(matrix)
    vectors = np.eye(d)
    for sweep in range(sweeps):
        turned = False
        for p in range(d - 1):
            for q in range(p + 1, d):
                apq = a[p, q]
                if apq == 0 or abs(apq) <= 1e-17 * np.sqrt(abs(a[p, p] * a[q, q])) or sweep > 3 and abs(apq) < 1e-300:
                    continue
                turned = True
                theta = (a[q, q] - a[p, p]) / (2 * apq)
                t = (1.0 if theta >= 0 else -1.0) / (abs(theta) + np.hypot(theta, 1.0))
                c = 1 / np.hypot(t, 1.0)
                s = t * c
                rows_p, rows_q = a[p].copy(), a[q].copy()
                new_p, new_q = c * rows_p - s * rows_q, s * rows_p + c * rows_q
                new_p[p], new_q[q], new_p[q], new_q[p] = rows_p[p] - t * apq, rows_q[q] + t * apq, 0.0, 0.0
                a[p], a[q], a[:, p], a[:, q] = new_p, new_q, new_p, new_q
                vp, vq = vectors[:, p].copy(), vectors[:, q].copy()
                vectors[:, p], vectors[:, q] = c * vp - s * vq, s * vp + c * vq
        if not turned:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], vectors[:, order]


def _rows(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            yield batch, floored(batch["v"], dims, SCALE, SHIFT, LIMIT)


def _sums(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    """A task's sums by dimension; dimension -1 has the number of its rows."""
    total = [0] * (dims + 1)
    for _, x in _rows(batches, dims):
        total = [a + int(b) for a, b in zip(total, [len(x), *x.sum(0)], strict=True)]
    if total[0]:
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, dims), pa.int32()), exact(total)], ["dim", "total"])


def _products(y: np.ndarray) -> np.ndarray:
    """Exact y^T y; float products are exact while all sums stay below 2^53."""
    peak = int(np.abs(y).max(initial=0))
    if peak * peak * len(y) < 1 << 53:
        y = y.astype(float)
        return (y.T @ y).astype(np.int64).astype(object)
    y = y.astype(object)
    return y.T @ y


def _scatter(batches: Iterator[pa.RecordBatch], dims: int, centre: list[int]) -> Iterator[pa.RecordBatch]:
    """A task's scatter around a whole centre."""
    middle, total, any_row = np.array(centre, np.int64), np.zeros((dims, dims), object), False
    for _, x in _rows(batches, dims):
        total, any_row = total + _products(x - middle), True
    if any_row:
        i, j = np.divmod(np.arange(dims * dims), dims)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), exact(total.ravel())], ["i", "j", "total"])


def _whitened(x: np.ndarray, model: Whitening) -> np.ndarray:
    centre = [(2 * s + model.n) // (2 * model.n) for s in model.sums]
    rest = np.array([(s - m * model.n) / model.n for s, m in zip(model.sums, centre, strict=True)])
    return ((x - np.array(centre, np.int64)) - rest) @ (model.vectors / np.sqrt(model.eigenvalues))


def _moments(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """A task's sums of whitened values (j = -1) and of their products."""
    model = model.value
    k, any_row = len(model.eigenvalues), False
    total = np.zeros((k, k + 1))
    for _, x in _rows(batches, len(model.sums)):
        w = _whitened(x, model)
        total[:, 0] += w.sum(0)
        total[:, 1:] += w.T @ w
        any_row = True
    if any_row:
        i, j = np.divmod(np.arange(total.size), k + 1)
        yield pa.RecordBatch.from_pydict({"i": i.astype(np.int32), "j": (j - 1).astype(np.int32), "total": total.ravel()})


def _deviations(x: np.ndarray, model: Whitening) -> list[int | None]:
    centre = [(2 * s + model.n) // (2 * model.n) for s in model.sums]
    rest = [s - m * model.n for s, m in zip(model.sums, centre, strict=True)]
    y = x - np.array(centre, np.int64)
    peak = model.n * (int(np.abs(y).max(initial=0)) + 1)
    if peak * peak * len(centre) > _LONG:
        y = y.astype(object)
    apart = y * model.n - np.array(rest, y.dtype)
    return [v if v <= _LONG else None for v in (apart * apart).sum(1).tolist()]


def _applied(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    model = model.value
    k = len(model.eigenvalues)
    for batch, x in _rows(batches, len(model.sums)):
        w = _whitened(x, model)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, k), pa.int32()), pa.array(w.ravel()))
        yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(_deviations(x, model), pa.int64()), lists], ["vec_id", "deviation", "whitened"])


def _given(vectors: DataFrame) -> DataFrame:
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.where((F.size("v") > 0) & finite(F.col("v")))


def fitted(vectors: DataFrame, components: int = COMPONENTS) -> tuple[Whitening, float] | None:
    """The whitening of rows (vec_id, embedding) and its measured identity error; None without rows."""
    given = _given(vectors)
    length = given.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not length:
        return None
    dims = length[0].d
    rows = given.where(F.size("v") == dims).select("v")
    total = rows.mapInArrow(partial(_sums, dims=dims), f"dim int, total {EXACT}").groupBy("dim").agg(F.sum("total").alias("total"))
    found = {r.dim: int(r.total) for r in total.collect()}  # dims + 1 rows
    n, sums = found[-1], [found[d] for d in range(dims)]
    centre = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - m * n for s, m in zip(sums, centre, strict=True)]
    scatter = rows.mapInArrow(partial(_scatter, dims=dims, centre=centre), f"i int, j int, total {EXACT}").groupBy("i", "j").agg(F.sum("total").alias("total"))
    covariance = np.zeros((dims, dims))
    for r in scatter.collect():  # dims * dims rows
        covariance[r.i, r.j] = (int(r.total) * n - rest[r.i] * rest[r.j]) / (n * n)
    values, columns = jacobi(covariance)
    k = min(components, int((values > LEAST_EIGENVALUE * max(values[0], 0)).sum()))
    model = Whitening(n, sums, values[:k], columns[:, :k], [float(e / np.trace(covariance)) for e in values[:k]])
    shared = vectors.sparkSession.sparkContext.broadcast(model)
    moments = rows.mapInArrow(partial(_moments, model=shared), "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total"))
    of = {(r.i, r.j): r.total / n for r in moments.collect()} if k else {}  # k * (k + 1) rows
    return model, max((abs(of[i, j] - of[i, -1] * of[j, -1] - (i == j)) for i in range(k) for j in range(k)), default=0.0)


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each row and component."""
    found = fitted(vectors, components)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if found is None or not len(found[0].eigenvalues):
        return vectors.sparkSession.createDataFrame([], schema)
    model, error = found
    rows = _given(vectors).where(F.size("v") == len(model.sums))
    out = rows.mapInArrow(partial(_applied, model=vectors.sparkSession.sparkContext.broadcast(model)), "vec_id long, deviation long, whitened array<double>")
    each = out.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "value"))
    share = F.element_at(F.array(*map(F.lit, model.explained)), F.col("at") + 1)
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", F.col("value").alias("whitened"), share.alias("explained"), F.lit(error).alias("identity_error"))
