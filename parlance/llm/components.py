"""Connected components of a link table by alternating large-star and small-star steps.

Both steps are an aggregation and a join on node ids, so nothing is gathered on the driver;
the number of rounds grows with the logarithm of the longest path.  Each round is written
to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    rest = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of a link table (u, v); component is the least node reached.

    Nulls and self-links are ignored; repeated links and either direction are fine; an empty
    table gives an empty one.  Nodes without links do not appear.
    """
    now = stored(
        edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = None
    for _ in range(rounds):
        after = stored(_small_star(_large_star(now).distinct()).distinct(), "links")
        drop_stored(now)
        now = after
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (seen.n, seen.s) == state:
            least = now.groupBy("v").agg(F.lit(True).alias("x")).select(F.col("v").alias("node"), F.col("v").alias("component"))
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(least)
        state = (seen.n, seen.s)
    raise RuntimeError("components did not settle")
