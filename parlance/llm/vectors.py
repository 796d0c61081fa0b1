"""Vector columns: which are whole, and their rows as numpy matrices inside tasks."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sums of whole numbers over all rows are added as these, so that no size of table overflows them.
EXACT = "decimal(38,0)"


def finite(column: Column) -> Column:
    """True where an array of doubles is given and holds neither null nor non-finite entries."""
    return F.coalesce(F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def floored(column: pa.Array, dims: int, scale: int, shift: int, limit: int) -> np.ndarray:
    """Rows of ``floor(scale * x) + shift`` as long, each held between -limit and limit."""
    with np.errstate(over="ignore"):
        values = np.floor(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims) * float(scale))
    return (np.clip(values, -limit - shift, limit - shift)).astype(np.int64) + shift


def exact(values) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))
