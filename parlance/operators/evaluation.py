"""Evaluation of predictions against gold: all systems of a long table at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats import mcnemar_p, share, wilson
from .prefix import running_before


def with_interval(df: DataFrame, k: str, n: str) -> DataFrame:
    """Adds the rate and its Wilson bounds, six decimals each."""
    low, high = wilson(F.col(k), F.col(n))
    return df.withColumn("rate", F.round(share(F.col(k), F.col(n)), 6)).withColumn("low", F.round(low, 6)).withColumn("high", F.round(high, 6))


def distribution(rows: DataFrame, group: str, value: str, domain: list[str]) -> DataFrame:
    """(group, value, k, n, rate, low, high) of every value of the domain and of every other that occurs, in each group."""
    counts = rows.groupBy(group, F.col(value).alias("value")).agg(F.count("*").alias("k"))
    total = counts.groupBy(group).agg(F.sum("k").alias("n"))
    values = counts.select("value").unionByName(rows.sparkSession.createDataFrame([(v,) for v in domain], "value string")).where("value is not null").distinct()
    each = total.crossJoin(F.broadcast(values)).join(counts, [group, "value"], "left")  # one row a value
    return with_interval(each.select(group, "value", F.coalesce("k", F.lit(0)).alias("k"), "n"), "k", "n")


def per_class(rows: DataFrame, classes: list[str], gold: str = "gold", pred: str = "pred") -> DataFrame:
    """(system, class, tp, fp, fn, precision, recall, f1); a row counts for its gold and for its predicted class."""
    counts = rows.groupBy("system", gold, pred).agg(F.count("*").alias("n"))
    each = counts.select("*", F.explode(F.array(*(F.lit(c) for c in classes))).alias("class"))
    is_gold, is_pred = F.col(gold) == F.col("class"), F.col(pred) == F.col("class")
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    out = each.groupBy("system", "class").agg(count(is_gold & is_pred).alias("tp"), count(~is_gold & is_pred).alias("fp"), count(is_gold & ~is_pred).alias("fn"))
    p, r = share(F.col("tp"), F.col("tp") + F.col("fp")), share(F.col("tp"), F.col("tp") + F.col("fn"))
    return out.withColumn("precision", p).withColumn("recall", r).withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def macro_f1(classes: DataFrame) -> DataFrame:
    """Mean F1 of the classes that occur in gold."""
    return classes.where("tp + fn > 0").groupBy("system").agg(F.avg("f1").alias("macro_f1"))


def subsets(flags: dict[str, Column]) -> Column:
    """Overlapping subsets of a row, to be grouped by."""
    return F.explode(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in flags.items()))))


def top_confusions(rows: DataFrame, k: int) -> DataFrame:
    n = rows.where("gold <> pred").groupBy("system", "gold", "pred").agg(F.count("*").alias("n"))
    w = Window.partitionBy("system").orderBy(F.desc("n"), "gold", "pred")
    return n.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def pairwise_mcnemar(rows: DataFrame) -> DataFrame:
    """(a, b, b_only, c_only, p) for each pair of systems; ``rows`` has (system, id, correct).

    Rows are first brought to one map of systems an item, so no item is joined with itself.
    """
    items = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("system", "correct"))).alias("s"))
    n = F.size("s")
    pairs = F.flatten(F.transform("s", lambda x, i: F.transform(F.slice("s", i + 2, F.greatest(n - i - 1, F.lit(0))), lambda y: F.struct(x.system.alias("a"), y.system.alias("b"), x.correct.alias("x"), y.correct.alias("y")))))
    each = items.where(n > 1).select(F.explode(pairs).alias("p")).select("p.*")
    out = each.groupBy("a", "b").agg(F.count_if(F.col("x") & ~F.col("y")).alias("a_only"), F.count_if(~F.col("x") & F.col("y")).alias("b_only"))
    return out.withColumn("p", F.round(mcnemar_p(F.col("a_only"), F.col("b_only")), 6))


def unsafe_auto(rows: DataFrame) -> DataFrame:
    """(system, n, auto, unsafe, coverage, unsafe_rate): how much is answered automatically, and how much of that should not be."""
    auto = F.col("decision") == "AUTO_OK"
    out = rows.groupBy("system").agg(F.count("*").alias("n"), F.count_if(auto).alias("auto"), F.count_if(auto & (F.col("escalation") == "ESCALATE")).alias("unsafe"))
    return out.withColumn("coverage", F.round(share(F.col("auto"), F.col("n")), 6)).withColumn("unsafe_rate", F.round(share(F.col("unsafe"), F.col("auto")), 6))


def without_constants(rows: DataFrame, column: str = "decision") -> DataFrame:
    """The rows of systems that give more than one value: against a constant only the base rate would be measured."""
    varied = rows.groupBy("system").agg(F.min(column).alias("_low"), F.max(column).alias("_high")).where("_low < _high").select("system")
    return rows.join(varied, "system", "left_semi")


def risk_coverage(rows: DataFrame) -> DataFrame:
    """(system, threshold, auto, unsafe, coverage, risk, scored) at 0, every distinct score and 1.0001; auto means score below threshold.

    ``scored`` counts the rows that have just this score.  Running sums over ranges of the distinct scores give every point, so
    one system's scores are no single task's.
    """
    bad = F.count_if(F.col("escalation") == "ESCALATE")
    per = rows.groupBy("system", "score").agg(F.count("*").alias("n"), bad.alias("bad"))
    ends = rows.select("system").distinct().select("system", F.explode(F.array(F.lit(0.0), F.lit(1.0001))).alias("score"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("bad"))
    points = per.unionByName(ends).groupBy("system", "score").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    out = running_before(points, ["system"], ["score"], ["n", "bad"]).select("system", F.col("score").alias("threshold"), F.col("n_before").alias("auto"), F.col("bad_before").alias("unsafe"), F.col("n").alias("scored"))
    total = rows.groupBy("system").agg(F.count("*").alias("total"))
    out = out.join(F.broadcast(total), "system")  # one row a system
    return out.select("system", "threshold", "auto", "unsafe", F.round(F.col("auto") / F.col("total"), 6).alias("coverage"), F.round(share(F.col("unsafe"), F.col("auto")), 6).alias("risk"), "scored")


def scored_systems(curve: DataFrame) -> DataFrame:
    """(system) of those whose rows have more than two distinct scores; the added ends of a curve are none."""
    return curve.where("scored > 0").groupBy("system").agg(F.count("*").alias("scores")).where("scores > 2").select("system")


def _nearest(target: Column) -> Column:
    """The point of a curve nearest to a coverage; ties go to the lowest threshold."""
    return F.min_by(F.struct("threshold", "coverage", "risk", "auto", "unsafe"), F.struct(F.round(F.abs(F.col("coverage") - target), 6), "threshold"))


def matched_coverage(curve: DataFrame, targets: list[float]) -> DataFrame:
    """(system, target, threshold, coverage, risk): the curve's point nearest to each target coverage, for systems of more than two scores."""
    each = curve.join(scored_systems(curve), "system", "left_semi").select("*", F.explode(F.array(*(F.lit(x) for x in targets))).alias("target"))
    return each.groupBy("system", "target").agg(_nearest(F.col("target")).alias("b")).select("system", "target", "b.threshold", "b.coverage", "b.risk")


def matched_systems(curve: DataFrame, others: DataFrame) -> DataFrame:
    """Each scored system's point nearest to the coverage of every system of ``others`` (system, auto, unsafe, coverage, unsafe_rate) that has no curve.

    ``others`` has one row a system.
    """
    scored = scored_systems(curve)
    plain = others.join(scored, "system", "left_anti").select(F.col("system").alias("other"), F.col("coverage").alias("other_coverage"), F.col("unsafe_rate").alias("other_risk"))
    each = curve.join(scored, "system", "left_semi").join(F.broadcast(plain))  # one row a system without a curve
    best = each.groupBy("system", "other", "other_coverage", "other_risk").agg(_nearest(F.col("other_coverage")).alias("b"))
    return best.select("system", "other", "other_coverage", "other_risk", "b.threshold", "b.coverage", "b.risk")


def kappa(rows: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """(by, n, agree, kappa) of two raters; 1 where chance agreement is 1."""
    cells = rows.groupBy(*by, a, b).agg(F.count("*").alias("n"))
    total = cells.groupBy(*by).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col(a) == F.col(b), F.col("n"))), F.lit(0)).alias("agree"))
    left = cells.groupBy(*by, F.col(a).alias("v")).agg(F.sum("n").alias("na"))
    right = cells.groupBy(*by, F.col(b).alias("v")).agg(F.sum("n").alias("nb"))
    chance = left.join(right, [*by, "v"]).groupBy(*by).agg(F.sum(F.col("na") * F.col("nb")).alias("both"))
    j = (total.join(chance, by, "left") if by else total.crossJoin(chance)).withColumn("pe", F.coalesce("both", F.lit(0)) / (F.col("n") * F.col("n"))).withColumn("po", F.col("agree") / F.col("n"))
    return j.select(*by, "n", "agree", F.round(F.when(F.col("pe") == 1, 1.0).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe"))), 6).alias("kappa"))


def rated(rows: DataFrame, dimensions: tuple[str, ...], key: str) -> DataFrame:
    """(key, field, a, b) of people's answers ``human_*`` and a judge's ``judge_*``, for rows that a person rated.

    'acceptable' is yes or no by how the answer begins (y; a judge's t); dimensions are compared as written, where both rated.
    """
    starts = lambda c, x: F.when(F.startswith(F.lower(F.trim(c)), F.lit(x)), "yes").otherwise("no")
    done = rows.where(F.trim(F.coalesce("human_acceptable", F.lit(""))) != "")
    pairs = [F.struct(F.lit("acceptable").alias("field"), starts(F.col("human_acceptable"), "y").alias("a"), starts(F.col("judge_acceptable"), "t").alias("b"))]
    pairs += [F.struct(F.lit(d).alias("field"), F.trim(f"human_{d}").alias("a"), F.trim(f"judge_{d}").alias("b")) for d in dimensions]
    return done.select(key, F.explode(F.array(*pairs)).alias("x")).select(key, "x.*").where("a <> '' and b <> ''")


def assertions(checks: dict[str, DataFrame]) -> DataFrame:
    """(check, violations, passed) of named tables of violations."""
    out = None
    for name, df in checks.items():
        row = df.agg(F.lit(name).alias("check"), F.count("*").alias("violations")).withColumn("passed", F.col("violations") == 0)
        out = row if out is None else out.unionByName(row)
    return out
