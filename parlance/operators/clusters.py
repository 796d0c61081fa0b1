"""Clusters, and what is reported about them."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kmeans_scan(vectors: DataFrame, ks: tuple[int, ...], seed: int = 1) -> DataFrame:
    """(k, silhouette, inertia) of k-means by cosine distance for several k; ``vectors`` has an array ``v``."""
    rows = vectors.select(array_to_vector(F.col("v").cast("array<double>")).alias("features")).cache()
    out = []
    for k in ks:
        model = KMeans(k=k, seed=seed, distanceMeasure="cosine").fit(rows)
        score = ClusteringEvaluator(distanceMeasure="cosine").evaluate(model.transform(rows))
        out.append((k, float(score), float(model.summary.trainingCost)))
    rows.unpersist()
    return vectors.sparkSession.createDataFrame(out, "k int, silhouette double, inertia double")


def described(rows: DataFrame, cluster: str, flags: dict[str, Column], least: float = 0.04) -> DataFrame:
    """For each cluster its size, share, whether that is large enough, and each flag's rate and lift over all rows."""
    whole = rows.agg(F.count("*").alias("_n"), *(F.avg(c.cast("double")).alias(f"_{n}") for n, c in flags.items()))
    per = rows.groupBy(cluster).agg(F.count("*").alias("n"), *(F.avg(c.cast("double")).alias(n) for n, c in flags.items()))
    j = per.crossJoin(whole)  # one row of totals
    share = F.col("n") / F.col("_n")
    return j.select(cluster, "n", F.round(share, 6).alias("share"), (share >= least).alias("large"), *(x for n in flags for x in (F.round(n, 6).alias(f"{n}_rate"), F.round(F.try_divide(F.col(n), F.col(f"_{n}")), 6).alias(f"{n}_lift"))))


def merge_candidates(per: DataFrame, cluster: str, tolerances: dict[str, float]) -> DataFrame:
    """Pairs of clusters, of a table with one row each, whose rates differ by no more than the tolerances."""
    a, b = per.alias("a"), per.alias("b")
    on = F.col(f"a.{cluster}") < F.col(f"b.{cluster}")
    for name, most in tolerances.items():
        on = on & (F.abs(F.col(f"a.{name}") - F.col(f"b.{name}")) <= most)
    return a.join(b, on).select(F.col(f"a.{cluster}").alias("a"), F.col(f"b.{cluster}").alias("b"))
