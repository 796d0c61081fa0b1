"""Profiles of all brands at once: one grouped pass instead of a loop over brands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import rate
from ..lexicon import PII


def brand_profiles(docs: DataFrame, brand: str) -> DataFrame:
    n = F.col("n_chars").cast("double")
    return docs.groupBy(brand).agg(
        F.count("*").alias("n"), F.median(n).alias("median_chars"), F.round(F.percentile(n, 0.9), 6).alias("p90_chars"), rate(F.col("text").rlike(PII)).alias("pii_pct"),
        F.round(1 - F.count_distinct(F.md5("text")) / F.count("*"), 6).alias("dup_rate"), rate(F.col("lang") == "en").alias("english_pct"))
