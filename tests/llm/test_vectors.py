"""Centroid clustering and whitening against plain versions."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from parlance.llm import centroids, queries, whitening

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>"


def plain_clusters(rows, k=16, rounds=3, dims=64):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    middles = [v for _, v in order[:k]]
    for left in range(rounds, -1, -1):
        near = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), number) for number, c in enumerate(middles)) for _, v in kept]
        if left:
            for number in range(len(middles)):
                own = [v for (_, v), (_, c) in zip(kept, near, strict=True) if c == number]
                if own:
                    middles[number] = [sum(column) // len(own) for column in zip(*own, strict=True)]
    inertia = Counter()
    for d, c in near if kept else ():
        inertia[c] += d
    return Counter((i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, middles[c])).encode()).hexdigest()) for (i, _), (d, c) in (zip(kept, near, strict=True) if kept else ()))


def test_op12_equals_plain(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert Counter(map(tuple, queries.op12_centroids(spark, SF).collect())) == plain_clusters(rows)


AWKWARD = [
    (1, [1.5, -0.3]), (1, [1.5, -0.3]), (2, [1.5, -0.3]), (None, [0.0, 0.01]), (3, None), (4, [1.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [1.0, 2.0, 3.0]),
    (9, []), (10, [-7.25, 3.0]), (11, [0.015, 0.017]), (12, [2.0, 2.0]), (13, [-2.0, 2.0]),
]


def awkward(spark, rows=AWKWARD):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", cluster int, v string")


@pytest.mark.parametrize("k", [1, 3, 16])
def test_awkward_clusters(spark, k):
    got = centroids.clustered(awkward(spark).repartition(5), k=k, dims=2)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert Counter(map(tuple, got.collect())) == plain_clusters(AWKWARD, k=k, dims=2)


def test_no_vectors(spark):
    for rows in ([], [(1, None), (2, [1.0])]):
        assert centroids.clustered(spark.createDataFrame(rows, SCHEMA), dims=2).count() == 0
    assert whitening.whitened(spark.createDataFrame([], SCHEMA)).count() == whitening.whitened(spark.createDataFrame([(1, None), (2, [])], SCHEMA)).count() == 0


def test_huge_components_are_held(spark):
    got = centroids.clustered(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [1e300, 0.0])], SCHEMA), k=1, dims=2).collect()
    assert {r.vec_id: r.cluster for r in got} == {1: 0, 2: 0, 3: 0} and all(0 <= r.distance < 1 << 62 for r in got)


def test_partial_distances_are_exact():
    rng = np.random.default_rng(3)
    x, c = rng.integers(-9, 9, (500, 64)), rng.integers(-9, 9, (20, 64))
    c[7] = c[3]
    whole = ((x[:, None] - c[None]) ** 2).sum(2)
    for step in (1, 7, 64):
        label, distance = centroids.nearest(x, c, rng.permutation(64), step)
        assert (label == whole.argmin(1)).all() and (distance == whole.min(1)).all() and 7 not in label


def plain_whitening(rows):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows], dtype=object)
    n, sums = len(x), x.sum(0)
    apart = n * x - sums
    covariance = (apart.T @ apart).astype(float) / n / n / n
    values, vectors = np.linalg.eigh(covariance)
    return n, [int(d) for d in (apart * apart).sum(1)], values[::-1], vectors[:, ::-1], apart.astype(float) / n


def compare(rows, got, components):
    n, deviation, values, vectors, centred = plain_whitening(rows)
    want = centred @ vectors[:, :components] / np.sqrt(values[:components])
    by = {(r.vec_id, r.component): r for r in got}
    assert len(got) == len(rows) * components
    for c in range(components):
        own = np.array([by[i, c + 1].whitened for i, _ in rows])
        assert min(np.abs(own - want[:, c]).max(), np.abs(own + want[:, c]).max()) < 1e-6
        for (i, _), d in zip(rows, deviation, strict=True):
            r = by[i, c + 1]
            assert (r.n, r.deviation) == (n, d) and abs(r.explained / (values[c] / values.sum()) - 1) < 1e-6 and r.identity_error < 1e-6


def test_op13_equals_plain(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    compare(rows, queries.op13_whitening(spark, SF).collect(), 32)


def test_awkward_whitening(spark):
    kept = [(i, v) for i, v in AWKWARD if v is not None and len(v) == 2 and all(x is not None and math.isfinite(x) for x in v)]
    got = whitening.whitened(awkward(spark).repartition(5)).collect()
    names = {None: -1}
    shown = [(names.get(i, i), v) for i, v in kept]
    assert Counter(r.vec_id for r in got) == Counter(i for i, _ in kept for _ in range(2))
    n, deviation, *_ = plain_whitening(shown)
    assert {(r.vec_id, r.n, r.deviation) for r in got} == {(i, n, d) for (i, _), d in zip(kept, deviation, strict=True)} and all(r.identity_error < 1e-9 for r in got)


def test_flat_and_huge_vectors(spark):
    """A dimension that never changes has no component; a deviation beyond a long is null."""
    flat = [(i, [float(i % 7), 3.0, float(i % 5)]) for i in range(40)]
    got = whitening.whitened(spark.createDataFrame(flat, SCHEMA)).collect()
    assert {r.component for r in got} == {1, 2} and all(r.identity_error < 1e-9 for r in got)
    assert whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0])] * 3, SCHEMA)).count() == 0
    far = whitening.whitened(spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 5.0]), (3, [0.5, 2.0])], SCHEMA)).collect()
    assert {r.deviation for r in far if r.vec_id == 1} == {None} and len(far) >= 3


@pytest.mark.parametrize("d", [1, 2, 9, 40])
def test_jacobi(d):
    rng = np.random.default_rng(d)
    a = rng.normal(size=(d, d)) * 10.0 ** rng.integers(-4, 1, d)
    a = a.T @ a
    values, vectors = whitening.jacobi(a)
    assert np.allclose(vectors.T @ vectors, np.eye(d), atol=1e-12) and np.allclose(vectors @ np.diag(values) @ vectors.T, a, atol=1e-12 * np.trace(a)) and (np.diff(values) <= 0).all()
    scaled = np.diag(10.0 ** -np.arange(d, dtype=float))
    assert np.allclose(whitening.jacobi(scaled)[0], np.diag(scaled), rtol=1e-14)
