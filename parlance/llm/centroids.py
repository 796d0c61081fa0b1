"""Centroid clustering of whole-number vectors by partial-distance search.

A vector is compared with the centroids in the order of their numbers.  Squared differences are summed over a few
dimensions at a time, those of greatest variance first; a centroid is abandoned as soon as its partial sum is strictly
above the least whole distance so far, and what survives finishes all dimensions.  So the nearest centroid is exact and
of equally near ones the smaller number wins, whatever the order of the dimensions.

Every pass is one narrow scan: tasks hold the centroids, a batch of vectors and one sum for each centroid and dimension, and
only these sums are shuffled, so equal vectors or one crowded cluster cost no more than others.  The driver holds k centroids.

Edge cases: a vector is kept if it has exactly ``dims`` components, none null or non-finite; others give no row.
Components beyond 2^27 in size count as 2^27, beyond which a squared distance wouldn't fit a long.  A null id is hashed as an
empty one.  Repeated rows give a row each.  Fewer kept vectors than centroids give as many centroids as there are vectors
(equal ones too; the greater number then stays empty), none give no rows.  An inertia that doesn't fit a long is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .vectors import EXACT, finite, floored

DIMS = 64
SCALE = 64
LIMIT = 1 << 27
#: Dimensions whose squares are added before a centroid may be abandoned.
STEP = 8
_LONG = (1 << 63) - 1


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of each row of ``x``; ``order``: dimensions, widest first."""
    best, label = np.full(len(x), _LONG), np.zeros(len(x), np.int32)
    columns = np.ascontiguousarray(x[:, order].T)
    for number, centre in enumerate(centroids[:, order]):
        alive, part = np.arange(len(x)), np.zeros(len(x), np.int64)
        for at in range(0, len(order), step):
            apart = columns[at : at + step, alive] - centre[at : at + step, None]
            part = part + np.einsum("ij,ij->j", apart, apart)
            stays = part <= best[alive]
            if not stays.all():
                alive, part = alive[stays], part[stays]
                if not len(alive):
                    break
        nearer = part < best[alive]
        best[alive[nearer]], label[alive[nearer]] = part[nearer], number
    return label, best


def _vectors(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            yield batch, floored(batch["v"], dims, SCALE, 0, LIMIT)


def _spread(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    """A task's rows, sums and sums of squares by dimension; they only order the dimensions."""
    rows, total, squares = 0, np.zeros(dims), np.zeros(dims)
    for _, x in _vectors(batches, dims):
        x = x.astype(float)
        rows, total, squares = rows + len(x), total + x.sum(0), squares + (x * x).sum(0)
    if rows:
        yield pa.RecordBatch.from_pydict({"dim": pa.array(range(dims), pa.int32()), "n": pa.array([rows] * dims, pa.int64()), "total": total, "squares": squares})


def _sums(batches: Iterator[pa.RecordBatch], dims: int, model) -> Iterator[pa.RecordBatch]:
    """A task's sums by centroid and dimension; dimension -1 has the number of its vectors."""
    centroids, order = model.value
    total, rows = np.zeros((len(centroids), dims + 1), np.int64), 0
    for _, x in _vectors(batches, dims):
        label, _ = nearest(x, centroids, order)
        rows += len(x)
        for number in np.unique(label):
            own = label == number
            total[number, 0] += own.sum()
            total[number, 1:] += x[own].sum(0)
    if rows:
        number, dim = np.divmod(np.arange(total.size), dims + 1)
        yield pa.RecordBatch.from_pydict({"cluster": number.astype(np.int32), "dim": (dim - 1).astype(np.int32), "total": total.ravel()})


def _assigned(batches: Iterator[pa.RecordBatch], dims: int, model) -> Iterator[pa.RecordBatch]:
    centroids, order = model.value
    for batch, x in _vectors(batches, dims):
        label, distance = nearest(x, centroids, order)
        yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(label), pa.array(distance)], ["vec_id", "cluster", "distance"])


def _kept(vectors: DataFrame, dims: int) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    return vectors.select(F.col("vec_id").cast("long"), v.alias("v")).where((F.size("v") == dims) & finite(F.col("v")))


def fitted(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = DIMS) -> tuple[np.ndarray, np.ndarray]:
    """(centroids after ``rounds`` rounds, dimensions from the widest) of rows (vec_id, embedding)."""
    kept, context = _kept(vectors, dims), vectors.sparkSession.sparkContext
    first = kept.select("v", F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256).alias("digest")).orderBy("digest", "v").limit(k).select("v").toArrow()
    centroids = floored(first["v"].combine_chunks(), dims, SCALE, 0, LIMIT) if first.num_rows else np.zeros((0, dims), np.int64)
    if not len(centroids):
        return centroids, np.arange(dims)
    spread = kept.select("v").mapInArrow(partial(_spread, dims=dims), "dim int, n long, total double, squares double").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"))
    variance = {r.dim: r.squares / r.n - (r.total / r.n) ** 2 for r in spread.collect()}  # dims rows
    order = np.array(sorted(range(dims), key=lambda d: (-variance[d], d)))
    for _ in range(rounds):
        model = context.broadcast((centroids, order))
        sums = kept.select("v").mapInArrow(partial(_sums, dims=dims, model=model), "cluster int, dim int, total long").groupBy("cluster", "dim").agg(F.sum(F.col("total").cast(EXACT)).alias("total"))
        found = {(r.cluster, r.dim): int(r.total) for r in sums.collect()}  # k * (dims + 1) rows
        centroids = np.array([[found[c, d] // found[c, -1] if found[c, -1] else int(old[d]) for d in range(dims)] for c, old in enumerate(centroids)], np.int64)
        model.unpersist()
    return centroids, order


def assigned(vectors: DataFrame, centroids: np.ndarray, order: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of each kept row."""
    model = vectors.sparkSession.sparkContext.broadcast((centroids, order))
    return _kept(vectors, len(order)).mapInArrow(partial(_assigned, dims=len(order), model=model), "vec_id long, cluster int, distance long")


def clustered(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = DIMS) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each kept row."""
    spark = vectors.sparkSession
    centroids, order = fitted(vectors, k, rounds, dims)
    rows = assigned(vectors, centroids, order) if len(centroids) else spark.createDataFrame([], "vec_id long, cluster int, distance long")
    rows = stored(rows, "assigned")
    own = {r.cluster: int(r.total) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast(EXACT)).alias("total")).collect()}  # k rows at most
    fits = lambda x: x if x <= _LONG else None
    about = [(c, fits(total), fits(sum(own.values())), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, total in own.items()]
    table = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows are broadcast
