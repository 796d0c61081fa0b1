"""Reply graphs: edges, thread roots, openers with their first reply, time splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import discard, stored

MAX_JUMPS = 63  # doubling steps, so threads up to 2**63 deep


def resolve_edges(messages: DataFrame) -> DataFrame:
    """Adds ``up``, the parent where it exists, and ``dangling``, a parent that doesn't."""
    ids = messages.select(F.col("id").alias("up"))
    joined = messages.join(ids, F.col("parent") == F.col("up"), "left")
    return joined.withColumn("dangling", F.col("parent").isNotNull() & F.col("up").isNull())


def thread_roots(messages: DataFrame) -> DataFrame:
    """(id, root) by pointer doubling; a message whose parent is missing starts its own thread.

    Only the pointers are joined, never texts, and each step is kept in the shared folder.
    A cycle doesn't settle within MAX_JUMPS and raises.
    """
    now = stored(resolve_edges(messages.select("id", "parent")).select("id", F.coalesce("up", "id").alias("root")), "pointers")
    for _ in range(MAX_JUMPS):
        further = now.select(F.col("id").alias("at"), F.col("root").alias("to"))
        after = stored(now.join(further, F.col("root") == F.col("at")).select("id", F.col("to").alias("root"), (F.col("to") != F.col("root")).alias("moved")), "pointers")
        discard(now)
        now = after
        if after.where("moved").isEmpty():
            return now.select("id", "root")
    raise RuntimeError("the reply graph has a cycle")


def threads(messages: DataFrame) -> DataFrame:
    """Messages with ``thread`` and ``is_root``."""
    return messages.join(thread_roots(messages).withColumnRenamed("root", "thread"), "id").withColumn("is_root", F.col("thread") == F.col("id"))


def brand_threads(frame: DataFrame, author: str) -> DataFrame:
    """All messages of threads in which ``author`` wrote."""
    return frame.join(frame.where(F.col("author") == author).select("thread").distinct(), "thread", "left_semi")


def first_replies(frame: DataFrame) -> DataFrame:
    """(thread, reply_id, reply, reply_at): the earliest outbound message of each thread."""
    first = F.min_by(F.struct(F.col("id").alias("reply_id"), F.col("text").alias("reply"), F.col("created_at").alias("reply_at")), F.struct("created_at", "id"))
    return frame.where(~F.col("inbound")).groupBy("thread").agg(first.alias("r")).select("thread", "r.*")


def split_of(at: Column, splits: tuple[tuple[str, str, str], ...]) -> Column:
    """The half-open window a time falls in, or 'outside'."""
    out = None
    for name, start, end in splits:
        inside = (at >= F.lit(start).cast("timestamp_ntz")) & (at < F.lit(end).cast("timestamp_ntz"))
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out.otherwise("outside")


def opener_pairs(frame: DataFrame, splits: tuple[tuple[str, str, str], ...]) -> DataFrame:
    """Inbound roots with the first reply of their thread, if any, and their split."""
    openers = frame.where(F.col("is_root") & F.col("inbound")).select("thread", "id", "author", "created_at", "text")
    return openers.join(first_replies(frame), "thread", "left").withColumn("split", split_of(F.col("created_at"), splits))


def straddling(rows: DataFrame, group: str) -> DataFrame:
    """(group, splits) of groups whose rows are in more than one split."""
    return rows.groupBy(group).agg(F.count_distinct("split").alias("splits")).where("splits > 1")


def missing_either_way(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one of two tables has, and which."""
    left, right = a.select(key).distinct().withColumn("in_a", F.lit(True)), b.select(key).distinct().withColumn("in_b", F.lit(True))
    return left.join(right, key, "full_outer").where("in_a is null or in_b is null").select(key, F.when(F.col("in_a"), "a").otherwise("b").alias("only_in"))
