"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

With token shares p of the sources the weights are p**a / sum(p**a).  The exponent a in [0, 1] is
the smallest, found by bisection, that keeps both a repetition limit (no source is used more than
``max_repeats`` times) and, if given, an entropy of at most ``max_entropy`` nats; a = 1 keeps the
shares as they are, a = 0 makes them equal.  The budget is ``budget`` tokens or, by default, the
least at which every source is used at least once, so that mixing drops nothing.

A source whose share of the budget is e + f times its tokens is used in e whole passes and a part
pass.  Each pass permutes the documents by a keyed digest; the leading bits of the key cut the
permutation into BLOCKS blocks.  Whole blocks are taken until the next one would pass the budget,
and in that one documents in key order.  Block sums are aggregated before anything is ordered, so a
source of any size sorts its blocks and the rows of one block only.  What remains is one cut-off key
for each source, so choosing the copies of a row needs no shuffle of texts.

The same keys realise the order.  A copy in pass p with key k (as a fraction) stands at (p + k) / uses of
the whole run, where uses are its source's passes, the part pass included.  RUN_BLOCKS equal intervals of
the run are its blocks: each holds every source at about its weight, as the copies of a source are spread
evenly, and is itself permuted by another digest.  ``scheduled`` gives each copy its block and place key;
sorting by them is the training order, and it too needs no shuffle.

More than PLAN_ROWS sources are planned by aggregations over a table of sources and joined by a shuffle.

Edge cases: a null source is a source of its own; null and blank texts have no tokens, and a source
without tokens is used once; rows with equal id and source share a key and are taken together; a
null id is the empty text in the key; other columns are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import stored

BLOCKS = 4096
RUN_BLOCKS = 256
PLAN_ROWS = 100_000  # sources up to which the plan is made on the driver and broadcast
MAX_REPEATS = 2.0
SEED = "mix-1"
SALTS = 64
_BITS = 52


def _source_key() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def exponent(tokens: list[int], max_repeats: float = MAX_REPEATS, max_entropy: float | None = None, budget: float | None = None) -> float:
    """The smallest exponent within the limits, or 1 where none is."""

    def fits(a: float) -> bool:
        w, total = weights(tokens, a), budget
        if total is None:
            total = whole_budget(tokens, w)
        return all(total * x <= max_repeats * t * (1 + 1e-12) for x, t in zip(w, tokens, strict=True)) and (max_entropy is None or -sum(x * math.log(x) for x in w if x > 0) <= max_entropy)

    if not tokens or fits(0.0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if fits(mid) else (mid, high)
    return high


def weights(tokens: list[int], a: float) -> list[float]:
    total = sum(tokens)
    raw = [(t / total) ** a for t in tokens]
    whole = sum(raw)
    return [x / whole for x in raw]


def whole_budget(tokens: list[int], w: list[float]) -> float:
    """The least budget at which every source is used once."""
    return max(t / x for t, x in zip(tokens, w, strict=True))


PLAN = T.StructType([T.StructField(n, t) for n, t in (("mix_key", T.StringType()), ("tokens", T.LongType()), ("weight", T.DoubleType()), ("passes", T.LongType()), ("part", T.LongType()))])


def _large_plan(sources: DataFrame, max_repeats: float, max_entropy: float | None, budget: float | None) -> DataFrame:
    """As ``plan``, for a table of sources (mix_key, t) of any length: every step of the bisection is an aggregation."""
    used = sources.where("t > 0")
    tokens = used.agg(F.sum("t").alias("n")).first().n or 0
    share = F.col("t") / tokens

    def tried(a: float) -> tuple[float, float, float]:
        """Sum of the powers, the budget, and the entropy at exponent ``a``."""
        total = used.agg(F.sum(F.pow(share, F.lit(a))).alias("s")).first().s
        w = F.pow(share, F.lit(a)) / total
        r = used.agg(F.max(F.col("t") / w).alias("b"), F.sum(F.when(w > 0, -w * F.log(w))).alias("e")).first()
        return total, budget if budget is not None else r.b, r.e

    def fits(a: float) -> bool:
        total, run, entropy = tried(a)
        most = used.agg(F.max(run * F.pow(share, F.lit(a)) / total / F.col("t")).alias("m")).first().m
        return most <= max_repeats * (1 + 1e-12) and (max_entropy is None or entropy <= max_entropy)

    if not tokens:
        return sources.select("mix_key", F.lit(0).cast("long").alias("tokens"), F.lit(0.0).alias("weight"), F.lit(1).cast("long").alias("passes"), F.lit(0).cast("long").alias("part"))
    low, high = 0.0, 1.0
    if fits(0.0):
        high = 0.0
    for _ in range(60 if high else 0):
        mid = (low + high) / 2
        low, high = (low, mid) if fits(mid) else (mid, high)
    total, run, _ = tried(high)
    some = F.col("t") > 0
    weight = F.when(some, F.pow(share, F.lit(high)) / total).otherwise(0.0)
    want = F.rint(run * F.col("weight")).cast("long")
    return sources.withColumn("weight", weight).select("mix_key", F.col("t").alias("tokens"), "weight", F.when(some, F.floor(want / F.col("t"))).otherwise(1).cast("long").alias("passes"), F.when(some, want % F.col("t")).otherwise(0).cast("long").alias("part"))


def plan(docs: DataFrame, max_repeats: float = MAX_REPEATS, max_entropy: float | None = None, budget: float | None = None) -> tuple[DataFrame, bool]:
    """For each source: tokens, weight, whole passes and the tokens of the part pass; and whether that is short enough to broadcast.

    ``docs`` has mix_key and n_tokens.
    """
    sources = stored(docs.groupBy("mix_key").agg(F.sum("n_tokens").alias("t")), "mix-sources")
    if sources.count() > PLAN_ROWS:
        return stored(_large_plan(sources, max_repeats, max_entropy, budget), "mix-plan"), False
    rows = sorted((r.mix_key, int(r.t)) for r in sources.collect())
    used = [(k, t) for k, t in rows if t]
    tokens = [t for _, t in used]
    out = [(k, 0, 0.0, 1, 0) for k, t in rows if not t]
    if used:
        w = weights(tokens, exponent(tokens, max_repeats, max_entropy, budget))
        total = budget if budget is not None else whole_budget(tokens, w)
        for (k, t), x in zip(used, w, strict=True):
            want = round(total * x)
            out.append((k, t, x, want // t, want % t))
    return docs.sparkSession.createDataFrame(out, PLAN), True


def _with_plan(docs: DataFrame, planned: DataFrame, short: bool) -> DataFrame:
    """``docs`` joined with one row of its source.  A long plan is dealt under salts, as one source may hold a third of all rows."""
    if short:
        return docs.join(F.broadcast(planned), "mix_key")  # at most PLAN_ROWS rows
    salted = planned.withColumn("mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return docs.withColumn("mix_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["mix_key", "mix_salt"]).drop("mix_salt")


def _key(passes: Column) -> Column:
    digest = F.md5(F.concat_ws(":", F.lit(SEED), passes.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, _BITS // 4), 16, 10).cast("long")


def choices(docs: DataFrame, **limits) -> tuple[DataFrame, bool]:
    """(mix_key, weight, passes, cut, uses): a row of ``docs`` is used ``passes`` times, and once more if its key is at most ``cut``."""
    narrow = stored(docs.select("doc_id", _source_key().alias("mix_key"), words(F.col("text")).alias("n_tokens")), "mix-tokens")
    planned, short = plan(narrow, **limits)
    keyed = _with_plan(narrow, planned.where("part > 0").select("mix_key", "passes", "part"), short).withColumn("key", _key(F.col("passes")))
    block = F.shiftright("key", _BITS - int(math.log2(BLOCKS))).alias("block")
    totals = keyed.groupBy("mix_key", "part", block).agg(F.sum("n_tokens").alias("n"))
    running = totals.withColumn("upto", F.sum("n").over(Window.partitionBy("mix_key").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)))
    edge = running.where("upto > part").groupBy("mix_key").agg(F.min(F.struct("block", (F.col("upto") - F.col("n")).alias("before"), "part")).alias("e")).select("mix_key", "e.*")
    inside = keyed.select("mix_key", "n_tokens", "key", block).join(F.broadcast(edge) if short else edge, ["mix_key", "block"])  # one row a source
    upto = inside.withColumn("upto", F.col("before") + F.sum("n_tokens").over(Window.partitionBy("mix_key").orderBy("key").rangeBetween(Window.unboundedPreceding, 0)))
    shift = F.shiftleft(F.col("block").cast("long"), _BITS - int(math.log2(BLOCKS))) - 1
    cuts = upto.groupBy("mix_key").agg(F.max(F.when(F.col("upto") <= F.col("part"), F.col("key"))).alias("last"), F.min(shift).alias("start")).select("mix_key", F.coalesce("last", "start").alias("cut"))
    cut = F.coalesce("cut", F.lit(-1).cast("long"))
    return planned.join(cuts, "mix_key", "left").select("mix_key", "weight", "passes", cut.alias("cut"), (F.col("passes") + (cut + 1) / F.lit(float(1 << _BITS))).alias("uses")), short


def _chosen(docs: DataFrame, limits: dict) -> DataFrame:
    """``docs`` as a struct ``_doc``, its source's choices, and the number of times it is used; no name of docs can clash."""
    chosen, short = choices(docs, **limits)
    rows = docs.select(F.struct("*").alias("_doc"), "doc_id", _source_key().alias("mix_key"))
    joined = _with_plan(rows, stored(chosen, "mix-choices"), short)
    return joined.withColumn("copies", F.col("passes") + (_key(F.col("passes")) <= F.col("cut")).cast("long"))


def with_copies(docs: DataFrame, **limits) -> DataFrame:
    """``docs`` with ``mix_weight`` and ``mix_copies``, the number of times a row is used."""
    return _chosen(docs, limits).select("_doc.*", F.col("weight").alias("mix_weight"), F.col("copies").alias("mix_copies"))


def _position(passes: Column) -> Column:
    """Where in the run, from 0 to 1, the copy of this pass stands."""
    return (passes + _key(passes) / F.lit(float(1 << _BITS))) / F.col("uses")


def block_of(position: Column) -> Column:
    return F.least(F.lit(RUN_BLOCKS - 1), F.floor(position * RUN_BLOCKS).cast("int"))


def scheduled(docs: DataFrame, **limits) -> DataFrame:
    """One row for each use of a row of ``docs``, with its columns and ``mix_pass``, ``mix_block`` and ``mix_place``.

    Sorted by block and place, this is the order of the run.
    """
    each = _chosen(docs, limits).where("copies > 0").withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    place = F.md5(F.concat_ws(":", F.lit(SEED), F.lit("place"), F.col("p").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "mix_key"))
    return each.select("_doc.*", F.col("p").alias("mix_pass"), block_of(_position(F.col("p"))).alias("mix_block"), place.alias("mix_place"))


def blocks(docs: DataFrame, **limits) -> DataFrame:
    """(_doc, weight, copies, blocks): each row of ``docs`` with the blocks of the run its copies are in."""
    chosen = _chosen(docs, limits)
    upto = F.when(F.col("copies") > 0, F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).otherwise(F.array().cast("array<long>"))
    return chosen.select("_doc", "weight", "copies", F.transform(upto, lambda p: block_of(_position(p))).alias("blocks"))


def mixed(docs: DataFrame, **limits) -> DataFrame:
    """The rows of ``docs``, each as often as it is used, with its own columns only."""
    return scheduled(docs, **limits).select(*docs.columns)
