"""Running sums and row numbers in a total order, without bringing the rows of a group to one task.

Rows are cut into ranges of their order and kept; each range's sums are added up, and what the ranges before one hold is joined
back as a constant.  Only the sums of ranges, one row for each range and group that meet, pass through a window of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import stored


def running_before(rows: DataFrame, by: list[str], order: list[str], sums: list[str]) -> DataFrame:
    """``rows`` with ``<name>_before``: for each of ``sums`` its total over the rows of the group that come before.

    ``order`` must tell the rows of a group apart.  Nulls come first and count as 0 in sums.
    """
    ranged = stored(rows.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy(*by, "_part").agg(*(F.sum(F.coalesce(c, F.lit(0))).alias(f"_{c}") for c in sums))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range and group
    offsets = totals.select(*by, "_part", *(F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}") for c in sums))
    inside = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    here = ranged.select("*", *(F.coalesce(F.sum(F.coalesce(c, F.lit(0))).over(inside), F.lit(0)).alias(f"{c}_before") for c in sums))
    left, right = here.alias("l"), offsets.alias("r")
    same = F.col("l._part") == F.col("r._part")
    for c in by:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return left.join(right, same).select(*(F.col(f"l.{c}") for c in rows.columns), *((F.col(f"l.{c}_before") + F.col(f"r._{c}")).alias(f"{c}_before") for c in sums))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``name``, their place from 0 in the order, which must tell them apart."""
    return running_before(rows.withColumn("_one", F.lit(1).cast("long")), [], order, ["_one"]).withColumnRenamed("_one_before", name).drop("_one")
