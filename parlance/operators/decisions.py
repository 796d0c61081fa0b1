"""Rule intents, escalation policies, reasons, templates and routes."""

from __future__ import annotations

import numpy as np
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..lexicon import REASONS, template
from ..sources.tables import discard, stored
from . import logistic, search
from .prefix import numbered


def lookup_policy(pred: DataFrame, roles: dict[str, str], default: str, always: str = "independent") -> DataFrame:
    """Escalates where the predicted intent's role is ``always``; a missing prediction counts as ``default``."""
    dim = pred.sparkSession.createDataFrame(list(roles.items()), "pred string, role string")  # one row an intent
    known = pred.withColumn("pred", F.coalesce("pred", F.lit(default)))
    return known.join(F.broadcast(dim), "pred", "left").withColumn("decision", decision(F.col("role") == always))


def decision(flag: Column) -> Column:
    return F.when(F.coalesce(flag, F.lit(False)), "ESCALATE").otherwise("AUTO_OK")


def majority(rows: DataFrame, group: str, value: str) -> DataFrame:
    """The most frequent value of each group; ties go to the one that sorts first."""
    n = rows.groupBy(group, value).agg(F.count("*").alias("_n"))
    return n.groupBy(group).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias("majority"))


def reasons(text: Column, chosen: Column, intent: Column, rules: dict[str, str], fallback: dict[str, str]) -> Column:
    """struct(reason, source): the first rule that matches, else what the intent implies, else 'ambiguous'; blank where nothing escalates."""
    implied = F.lit("ambiguous")
    for name, reason in fallback.items():
        implied = F.when(intent == name, reason).otherwise(implied)
    out = F.when(chosen != "ESCALATE", F.struct(F.lit("").alias("reason"), F.lit("").alias("source")))
    for name, pattern in rules.items():
        out = out.when(t.has(text, pattern), F.struct(F.lit(name).alias("reason"), F.lit(f"rule:{name}").alias("source")))
    return out.otherwise(F.struct(implied.alias("reason"), F.concat(F.lit("fallback:"), implied).alias("source")))


def templates(spark) -> DataFrame:
    """(reason, template_id, reply); ids number the reasons in order."""
    return spark.createDataFrame([(r, f"HANDOFF-{i:02d}-{r}", template(r)) for i, r in enumerate(sorted(REASONS), 1)], "reason string, template_id string, reply string")


def sparse_vectors(docs: DataFrame, min_df: int = 2) -> tuple[DataFrame, int]:
    """((id, features), size of the vocabulary): sublinear TF-IDF of ``docs`` (id, text) over all terms in ``min_df`` texts, of length 1.

    Terms are numbered in the cluster by their order, so no vocabulary passes through the driver; a text without terms has no entry.
    """
    counted = stored(search.bags(docs), "bags")
    table = stored(numbered(search.vocabulary(counted, counted.count(), min_df).withColumnRenamed("idf", "_idf"), ["term"], "number"), "vocabulary")
    size = max(table.count(), 1)
    v = search.vectors(counted, table.select("term", F.col("_idf").alias("idf")))
    each = v.select("id", "norm", F.explode(F.arrays_zip("terms", "raw")).alias("x")).select("id", F.col("x.terms").alias("term"), (F.col("x.raw") / F.col("norm")).alias("w"))
    entries = each.join(table.select("term", "number"), "term").groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.col("number").cast("int").alias("i"), "w"))).alias("e"))
    packed = F.udf(lambda i, w: Vectors.sparse(size, i or [], w or []), VectorUDT())  # a text's entries, once a text
    rows = docs.select("id").join(entries, "id", "left")
    return rows.select("id", packed(F.col("e.i"), F.col("e.w")).alias("features")), size


def distant_lr(docs: DataFrame, label: str) -> DataFrame:
    """(doc_id, predicted, max_proba, probabilities) of a balanced multinomial logistic regression over sublinear TF-IDF, fitted on rule labels.

    ``probabilities`` is a map with every class.  The penalty is half the squared length of the coefficients against the sum of
    losses, as of a plain fit with C = 1; intercepts are free.  Fitted in the cluster (``logistic``).
    """
    labels = stored(docs.select(F.col("doc_id").cast("long").alias("id"), F.col(label).alias("label")).where(F.col("label").isNotNull()), "labels")  # made once
    sizes = {r.label: r["count"] for r in labels.groupBy("label").count().collect()}  # one row a class
    names = sorted(sizes)
    if not names:
        return docs.select("doc_id", F.col(label).alias("predicted"), F.lit(None).cast("double").alias("max_proba"), F.lit(None).cast("map<string,double>").alias("probabilities"))
    weights = np.array([sum(sizes.values()) / (len(names) * sizes[name]) for name in names])
    every = F.array(*(F.lit(x) for x in names))  # one a class
    x = logistic.matrix(docs.select(F.col("doc_id").alias("id"), "text"))
    p = logistic.fitted(x, labels.select("id", (F.array_position(every, F.col("label")) - 1).cast("int").alias("y")).dropDuplicates(["id"]), weights)
    discard(labels, x.texts, x.terms, x.norms)
    return p.select(F.col("id").alias("doc_id"), every[(F.array_position("p", F.array_max("p")) - 1).cast("int")].alias("predicted"), F.array_max("p").alias("max_proba"), F.map_from_arrays(every, "p").alias("probabilities"))


def class_score(probabilities: dict[str, Column], roles: dict[str, str], always: str = "independent") -> Column:
    """The probability of the classes whose role is ``always``: the score of an escalation."""
    return sum((p for name, p in probabilities.items() if roles.get(name) == always), F.lit(0.0))


def normalised_intent(said: Column, vocabulary: list[str], otherwise: str = "other_unclear") -> Column:
    """A provider's answer as a name of the vocabulary: case, space and surrounding marks don't matter; anything else is ``otherwise``."""
    name = F.regexp_replace(F.lower(said), r"^[^a-z0-9_]+|[^a-z0-9_]+$", "")
    return F.when(name.isin(*vocabulary), name).otherwise(otherwise)


def codebook_prompt(intents: DataFrame, rules: DataFrame) -> DataFrame:
    """(prompt): instructions made of a codebook alone, from intents (name, definition, confusable) and rules (id, test), in their order."""
    near = F.when(F.size("confusable") > 0, F.concat(F.lit("\n  not to be mixed up with: "), F.array_join("confusable", ", "))).otherwise("")
    lines = lambda df, key, line: df.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), line.alias("line")))), lambda x: x.line), "\n").alias("lines"))
    names = lines(intents, "place", F.concat(F.lit("* "), "name", F.lit(": "), "definition", near))
    tests = lines(rules, "place", F.concat(F.lit("* "), "id", F.lit(": "), "test"))
    text = F.concat(F.lit("Name the one intent of the message.\n\nIntents:\n"), names.lines, F.lit("\n\nRules, the first that applies decides:\n"), tests.lines, F.lit("\n\nIf none is clear, answer other_unclear. Answer with the name only.\n\nMessage:\n{message}"))
    return names.crossJoin(tests).select(text.alias("prompt"))  # two single rows


def score_policy(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    return rows.withColumn("decision", decision(F.col("score") >= threshold))
