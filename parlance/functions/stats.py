"""Statistics as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963985


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def rate(flag: Column) -> Column:
    """The share of rows with the flag, as a percentage with two decimals."""
    return F.round(100 * F.avg(flag.cast("double")), 2)


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval; (0, 0) for n = 0."""
    k, n = k.cast("double"), n.cast("double")
    p = k / n
    centre, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    low, high = (centre - spread) / (1 + z * z / n), (centre + spread) / (1 + z * z / n)
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), low)), F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), high))


_SMALL = [math.lgamma(n + 1) for n in range(16)]


def log_factorial(n: Column) -> Column:
    """ln n!: a short table, and Stirling's series from 16 on (its error is below 1e-13 there)."""
    x = F.greatest(n, F.lit(16)).cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    return F.when(n < 16, F.element_at(F.array(*(F.lit(v) for v in _SMALL)), F.least(F.greatest(n, F.lit(0)), F.lit(15)).cast("int") + 1)).otherwise(series)


def mcnemar_p(b: Column, c: Column) -> Column:
    """Two-sided exact p of discordant counts b and c, 1 where there are none.

    The last binomial term comes from logarithms and each one before it from its successor.  Terms fall at least as
    a normal density does, so those more than 20 roots of n back are below the last bit and aren't visited.
    """
    n, least = (b + c).cast("long"), F.least(b, c).cast("long")
    last = F.exp(log_factorial(n) - log_factorial(least) - log_factorial(n - least) - n * F.log(F.lit(2.0)))
    first = F.greatest(F.lit(1).cast("long"), least - F.ceil(20 * F.sqrt(n.cast("double")) + 50))
    down = F.when(least > 0, F.sequence(least, first, F.lit(-1).cast("long"))).otherwise(F.array().cast("array<long>"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(s: Column, k: Column) -> Column:
        term = s["term"] * k / (n - k + 1)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * last * F.aggregate(down, start, step, lambda s: s["sum"])))
