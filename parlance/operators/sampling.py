"""Reproducible samples: draws in the order of a salted digest, with inclusion probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def draw_key(salt: str, key: Column) -> Column:
    """A digest that orders rows the same in every engine."""
    return F.md5(F.concat(F.lit(salt), key.cast("string")))


def draw(df: DataFrame, key: str, k: int, salt: str, stratum: str, within: list[str] | None = None) -> DataFrame:
    """k rows a group in digest order, with the group's size, the probability k/n and its inverse as weight; without groups as ``take``."""
    if not within:
        return take(df, key, k, salt, stratum)
    w = Window.partitionBy(*within)
    ranked = df.withColumn("_n", F.row_number().over(w.orderBy(draw_key(salt, F.col(key)), key)))
    sizes = df.groupBy(*within).agg(F.count("*").alias("eligible"))
    top = ranked.where(F.col("_n") <= k).drop("_n")
    top = top.join(sizes, within)
    p = F.least(F.lit(1.0), k / F.col("eligible"))
    return top.withColumn("stratum", F.lit(stratum)).withColumn("inclusion_prob", p).withColumn("design_weight", 1 / p)


def take(df: DataFrame, key: str, k: int, salt: str, stratum: str) -> DataFrame:
    """k rows of a whole table: a limit in digest order, so no task holds more than k rows of a partition."""
    n = df.agg(F.count("*").alias("eligible"))
    top = df.withColumn("_d", draw_key(salt, F.col(key))).orderBy("_d", key).limit(k).drop("_d").crossJoin(n)
    p = F.least(F.lit(1.0), k / F.col("eligible"))
    return top.withColumn("stratum", F.lit(stratum)).withColumn("inclusion_prob", p).withColumn("design_weight", 1 / p)


def sequential_plan(df: DataFrame, key: str, steps: list[tuple[str, Column, int]], salt: str) -> DataFrame:
    """Ordered strata without replacement: each step draws from its rows that no earlier step chose."""
    out = None
    for n, (name, mask, k) in enumerate(steps):
        pool = df.where(mask)
        if out is not None:
            pool = pool.join(out.select(key), key, "left_anti")
        part = take(pool.select(key), key, k, f"{salt}{n}:", name)
        out = part if out is None else out.unionByName(part)
    return out


def blind_ids(df: DataFrame, key: str, salt: str, prefix: str) -> DataFrame:
    """Shuffles a sample by digest and numbers it G001, G002, ..."""
    w = Window.orderBy(draw_key(salt, F.col(key)), key)
    return df.withColumn("blind_id", F.concat(F.lit(prefix), F.lpad(F.row_number().over(w).cast("string"), 3, "0")))
