"""Making the package importable in Python workers, wherever the driver was started."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Sends the package's sources to all executors, once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_parlance_shipped", False):
        return
    top = Path(__file__).resolve().parent
    path = f"{tempfile.mkdtemp()}/parlance.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(top.rglob("*.py")):
            out.write(source, f"parlance/{source.relative_to(top)}")
    context.addPyFile(path)
    context._parlance_shipped = True
