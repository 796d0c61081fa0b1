"""Messages as a stream.  The batch operators without joins apply to streams as they are.

The windowed counts are an extension: the batch analytics have no event-time windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..lexicon import FAMILIES, INTENT_FALLBACK, REASON_RULES
from ..operators.decisions import decision, reasons


def decided(stream: DataFrame, families: dict[str, str] = FAMILIES, must: tuple[str, ...] = ("licence", "insult")) -> DataFrame:
    """Adds intent, decision and reason to messages (text), row by row."""
    out = stream.withColumn("intent", t.first_match(F.col("text"), families, "other_unclear"))
    out = out.withColumn("decision", decision(F.col("intent").isin(*must)))
    return out.withColumn("reason", reasons(F.col("text"), F.col("decision"), F.col("intent"), REASON_RULES, INTENT_FALLBACK)["reason"])


def decision_counts(stream: DataFrame, at: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Decisions by event-time window; rows later than ``late`` are dropped."""
    return stream.withWatermark(at, late).groupBy(F.window(at, window), "decision").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "decision", "n")
