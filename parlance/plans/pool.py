"""The candidate pool of a labelled sample, the sample drawn from it, and the checks it must pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import stripped
from ..operators import dedup, evaluation, sampling
from ..sources.tables import stored

KEYS = ("thread", "author", "id")  # what a row must not share with one that was shown before


def prepared(pairs: DataFrame) -> DataFrame:
    """(id, thread, author, text, clean) of openers."""
    return pairs.select("id", "thread", "author", "text", stripped(F.col("text")).alias("clean"))


def build_pool(openers: DataFrame, shown: DataFrame, percent: int = 80, n: int = 3) -> tuple[DataFrame, DataFrame]:
    """(pool, trace) of ``openers`` as ``prepared``: what may still be drawn after ``shown``, prepared too, was.

    Blank texts go, then rows that share a thread, an author or an id with a shown one, then repeats by thread,
    author and text, one after another, then near copies of an earlier row that stays and near copies of a shown
    text.  Exclusions come before repeats, so that a shown author never takes another row's place.
    """
    p = openers.select("id", "thread", "author", "clean")
    for key in KEYS:
        p = p.join(shown.select(key).distinct().withColumn(f"_{key}", F.lit(True)), key, "left")
    steps: list[tuple[str, str | None, Column | None]] = [("not_blank", None, F.col("clean") != "")]
    steps += [(f"{key}_not_shown", None, F.col(f"_{key}").isNull()) for key in KEYS]
    steps += [(key, key, None) for key in ("thread", "author", "clean")]
    rows = stored(dedup.marked(p, steps, "id"), "pool")
    left = rows.where(F.col("_left") == len(steps)).select("id", "thread", "author", "clean")
    texts = left.select("id", F.col("clean").alias("text"))
    alone = left.join(dedup.collapsed(texts, percent, n).where("kept"), "id", "left_semi")
    near = dedup.similar(alone.select("id", F.col("clean").alias("text")), shown.select("id", F.col("clean").alias("text")), percent, n)
    gone = near.left.join(near.pairs.select(F.col("a").alias("rep")), "rep", "left_semi")
    pool = stored(alone.join(gone.select("id"), "id", "left_anti"), "pool")
    trace = dedup.counted(rows, [name for name, _, _ in steps])
    for name, df in (("near_copy", alone), ("near_shown", pool)):
        trace = trace.unionByName(df.agg(F.lit(name).alias("step"), F.count("*").alias("rows")))
    return pool, trace


ANSWERS = ("intent", "escalation", "reason", "confidence", "notes")  # what raters fill in


def drawn(pool: DataFrame, texts: DataFrame, steps: list[tuple[str, Column, int]], salt: str, prefix: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, key, manifest): blank sheets under blind numbers, what they stand for, and how each stratum was drawn.

    Only the key knows stratum, id, thread and author of an item.
    """
    sample = sampling.blind_ids(sampling.sequential_plan(pool, "id", steps, salt), "id", f"{salt}:", prefix)
    key = stored(sample.join(pool.select("id", "thread", "author"), "id").select("blind_id", "id", "thread", "author", "stratum", "eligible", "inclusion_prob", "design_weight"), "key")
    items = key.select("blind_id", "id").join(texts.select("id", "text"), "id").select("blind_id", "text", *(F.lit("").alias(a) for a in ANSWERS))
    wanted = {name: k for name, _, k in steps}
    asked = F.create_map(*(x for name, k in wanted.items() for x in (F.lit(name), F.lit(k))))
    manifest = key.groupBy("stratum").agg(F.count("*").alias("drawn"), F.max("eligible").alias("eligible")).withColumn("requested", asked[F.col("stratum")].cast("long"))
    return items, key, manifest


def verified(items: DataFrame, key: DataFrame, manifest: DataFrame, openers: DataFrame, shown: DataFrame) -> DataFrame:
    """(check, violations, passed) of a drawn sample, recomputed from all ``openers`` (id, thread, author, text, inbound)."""
    many = lambda df, c: df.groupBy(c).agg(F.count("*").alias("n")).where("n > 1")
    either = items.select("blind_id").join(key.select("blind_id", F.lit(True).alias("known")), "blind_id", "full_outer")
    known = openers.select("id", F.col("text").alias("told"), "inbound")
    sheet = items.join(key.select("blind_id", "id"), "blind_id").join(known, "id", "left")
    strata = key.select(F.col("stratum").alias("s")).distinct()
    filled = F.lit(False)
    for a in ANSWERS:
        filled = filled | (F.trim(F.coalesce(a, F.lit(""))) != "")
    said = items.select("blind_id", F.explode(F.array(*ANSWERS)).alias("s"))
    counts = manifest.agg(F.sum("drawn").alias("n")).crossJoin(items.agg(F.count("*").alias("found")))  # one row each
    hidden = [c for c in items.columns if c not in ("blind_id", "text", *ANSWERS)]
    return evaluation.assertions({
        "row_count": counts.where("not (n <=> found) and not (n is null and found = 0)"), "ids_unique": many(items, "blind_id"),
        "ids_match_key": either.where("known is null").unionByName(key.select("blind_id", F.lit(True).alias("known")).join(items.select("blind_id"), "blind_id", "left_anti")),
        "opener_of_window": sheet.where("told is null"), "no_shown_thread": key.join(shown, "thread", "left_semi"), "no_shown_author": key.join(shown, "author", "left_semi"),
        "no_shown_id": key.join(shown, "id", "left_semi"), "one_per_thread": many(key, "thread"), "one_per_author": many(key, "author"),
        "exact_text": sheet.where("not (text <=> told)"), "inbound_only": sheet.where("not coalesce(inbound, false)"),
        "strata_hidden": said.join(strata, "s", "left_semi").select("blind_id").unionByName(items.select("blind_id").where(F.lit(bool(hidden)))),
        "answers_blank": items.where(filled), "no_byte_order_mark": items.where(F.startswith("text", F.lit("\ufeff")))})


def retest_verified(items: DataFrame, key: DataFrame, first: DataFrame, built: str, now: str, delay_days: int = 5) -> DataFrame:
    """(check, violations, passed) of a second, blind pass over items of a first one, and whether it is due.

    ``items`` (blind_id, text, ANSWERS), ``key`` (blind_id, first_id), ``first`` (first_id, text).  A delay gate that has
    not passed counts as one violation: the sheets are ready, the second pass isn't due yet.
    """
    many = lambda df, c: df.groupBy(c).agg(F.count("*").alias("n")).where("n > 1")
    sheet = items.join(key, "blind_id", "left").join(first.select("first_id", F.col("text").alias("told")), "first_id", "left")
    filled = F.lit(False)
    for a in ANSWERS:
        filled = filled | (F.trim(F.coalesce(a, F.lit(""))) != "")
    whole = F.concat_ws(" ", *(c for c in items.columns))
    words = items.select("blind_id", F.explode(F.split(whole, " ")).alias("first_id")).join(first.select(F.col("first_id").cast("string")), "first_id", "left_semi")
    due = F.lit(now).cast("timestamp_ntz") >= F.lit(built).cast("timestamp_ntz") + F.make_dt_interval(F.lit(delay_days))
    return evaluation.assertions({
        "ids_unique": many(items, "blind_id"), "ids_in_key": sheet.where("first_id is null"), "one_item_each": many(key, "first_id"), "item_of_first_pass": key.join(first, "first_id", "left_anti"),
        "exact_text": sheet.where("not (text <=> told)"), "answers_blank": items.where(filled), "blind": words, "due": items.sparkSession.range(1).where(~due)})
