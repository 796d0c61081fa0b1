"""The analytics concepts over the stored tables: messages, gold labels, predictions, ledgers.

Each has the same definition as a DuckDB common table expression in ``CTE``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

SPLITS = (("train", "2024-01-01", "2024-01-15"), ("dev", "2024-01-15", "2024-01-22"), ("test", "2024-01-22", "2024-01-29"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as messages; the parents of some are ids that no message has, so that they dangle."""
    c = table(spark, sf_dir, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    parent = F.when(F.col("id") % 17 == 0, -F.col("id")).otherwise(F.col("id") - 1)
    minutes = (F.col("conv_id") * 7 % 720) * 60 + F.col("turn") * (5 + F.col("conv_id") % 7)
    return c.select(
        "id", F.when(F.col("turn") > 0, parent).alias("parent"), (F.col("role") == "user").alias("inbound"),
        F.when(F.col("role") == "user", F.concat(F.lit("c"), (F.col("conv_id") % 40).cast("string"))).otherwise(F.concat(F.lit("b"), (F.col("conv_id") % 5).cast("string"))).alias("author"),
        (F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), minutes.cast("int"), F.lit(0))).alias("created_at"), "text")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, intent, escalation, reason and stratum of labelled documents."""
    label = table(spark, sf_dir, "labels")
    quality, toxic = F.col("quality") == 1, F.col("toxic") == 1
    return label.select(
        F.col("doc_id").alias("id"),
        F.when(toxic & quality, "complaint").when(toxic, "abuse").when(quality, "question").otherwise("other").alias("intent"),
        F.when(toxic | (F.col("doc_id") % 7 == 0), "ESCALATE").otherwise("AUTO_OK").alias("escalation"),
        F.when(toxic, F.when(quality, "high_frustration").otherwise("safety_abuse")).when(F.col("doc_id") % 7 == 0, "ambiguous").otherwise("").alias("reason"),
        F.when(F.col("doc_id") % 5 == 0, "targeted:complaint").when(F.col("doc_id") % 5 == 1, "boundary:question|other").otherwise("core").alias("stratum"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """system, id, pred, decision, score and reason of three rule systems over the labelled documents."""
    d = documents(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("doc_id", "n_chars", "lang")
    score = F.col("n_chars") % 100 / F.lit(100.0)
    of = {
        "length": F.when(F.col("n_chars") < 600, "complaint").when(F.col("n_chars") > 4000, "other").otherwise("question"),
        "language": F.when(F.col("lang") == "en", "question").when(F.col("lang") == "de", "abuse").otherwise("complaint"),
        "modulo": F.when(F.col("doc_id") % 9 == 0, "abuse").when(F.col("doc_id") % 4 == 0, "complaint").otherwise("question"),
    }
    out = None
    for system, pred in of.items():
        one = d.select(
            F.lit(system).alias("system"), F.col("doc_id").alias("id"), pred.alias("pred"), score.alias("score"))
        out = one if out is None else out.unionByName(one)
    decision = F.when(F.col("pred").isin("complaint", "abuse") | (F.col("score") >= 0.9), "ESCALATE").otherwise("AUTO_OK")
    out = out.withColumn("decision", decision)
    reason = F.when(F.col("decision") == "AUTO_OK", "").when(F.col("pred") == "abuse", "safety_abuse").when(F.col("pred") == "complaint", "high_frustration").otherwise("ambiguous")
    return out.withColumn("reason", reason)


CTE = {
    "messages": """messages AS (
        SELECT id, CASE WHEN turn > 0 THEN CASE WHEN id % 17 = 0 THEN -id ELSE id - 1 END END AS parent, role = 'user' AS inbound,
               CASE WHEN role = 'user' THEN 'c' || (conv_id % 40) ELSE 'b' || (conv_id % 5) END AS author,
               TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST((conv_id * 7 % 720) * 60 + turn * (5 + conv_id % 7) AS INTEGER)) AS created_at, text
        FROM (SELECT *, conv_id * 1000 + turn AS id FROM conversations))""",
    "resolved": """resolved AS (
        SELECT m.*, p.id AS up FROM messages m LEFT JOIN (SELECT id FROM messages) p ON m.parent = p.id)""",
    "roots": """roots AS (
        SELECT id, id AS root FROM resolved WHERE up IS NULL
        UNION ALL SELECT m.id, r.root FROM resolved m JOIN roots r ON m.up = r.id)""",
    "threads": """threads AS (SELECT m.*, r.root AS thread, r.root = m.id AS is_root FROM messages m JOIN roots r USING (id))""",
    "replies": """replies AS (
        SELECT thread, id AS reply_id, text AS reply, created_at AS reply_at FROM threads WHERE NOT inbound
        QUALIFY row_number() OVER (PARTITION BY thread ORDER BY created_at, id) = 1)""",
    "pairs": """pairs AS (
        SELECT t.thread, t.id, t.author, t.created_at, t.text, r.reply_id, r.reply, r.reply_at,
               CASE WHEN created_at >= TIMESTAMP '2024-01-01' AND created_at < TIMESTAMP '2024-01-15' THEN 'train'
                    WHEN created_at >= TIMESTAMP '2024-01-15' AND created_at < TIMESTAMP '2024-01-22' THEN 'dev'
                    WHEN created_at >= TIMESTAMP '2024-01-22' AND created_at < TIMESTAMP '2024-01-29' THEN 'test' ELSE 'outside' END AS split
        FROM threads t LEFT JOIN replies r ON t.thread = r.thread WHERE t.is_root AND t.inbound)""",
    "gold": """gold AS (
        SELECT doc_id AS id, CASE WHEN toxic = 1 AND quality = 1 THEN 'complaint' WHEN toxic = 1 THEN 'abuse' WHEN quality = 1 THEN 'question' ELSE 'other' END AS intent,
               CASE WHEN toxic = 1 OR doc_id % 7 = 0 THEN 'ESCALATE' ELSE 'AUTO_OK' END AS escalation,
               CASE WHEN toxic = 1 AND quality = 1 THEN 'high_frustration' WHEN toxic = 1 THEN 'safety_abuse' WHEN doc_id % 7 = 0 THEN 'ambiguous' ELSE '' END AS reason,
               CASE WHEN doc_id % 5 = 0 THEN 'targeted:complaint' WHEN doc_id % 5 = 1 THEN 'boundary:question|other' ELSE 'core' END AS stratum
        FROM labels)""",
    "predictions": """predictions AS (
        SELECT *, CASE WHEN decision = 'AUTO_OK' THEN '' WHEN pred = 'abuse' THEN 'safety_abuse' WHEN pred = 'complaint' THEN 'high_frustration' ELSE 'ambiguous' END AS reason
        FROM (SELECT *, CASE WHEN pred IN ('complaint', 'abuse') OR score >= 0.9 THEN 'ESCALATE' ELSE 'AUTO_OK' END AS decision
              FROM (SELECT s.system, d.doc_id AS id, n_chars % 100 / 100.0::DOUBLE AS score,
                           CASE s.system
                             WHEN 'length' THEN CASE WHEN n_chars < 600 THEN 'complaint' WHEN n_chars > 4000 THEN 'other' ELSE 'question' END
                             WHEN 'language' THEN CASE WHEN lang = 'en' THEN 'question' WHEN lang = 'de' THEN 'abuse' ELSE 'complaint' END
                             ELSE CASE WHEN d.doc_id % 9 = 0 THEN 'abuse' WHEN d.doc_id % 4 = 0 THEN 'complaint' ELSE 'question' END END AS pred
                    FROM documents d CROSS JOIN (VALUES ('length'), ('language'), ('modulo')) s(system)
                    WHERE d.doc_id IN (SELECT doc_id FROM labels))))""",
}
_NEEDS = {"resolved": ("messages",), "roots": ("resolved",), "threads": ("roots", "messages"), "replies": ("threads",), "pairs": ("replies", "threads")}


def with_ctes(body: str, *names: str) -> str:
    """``body`` after the named common table expressions and what they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, ()):
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return "WITH RECURSIVE " + ",\n".join(CTE[n] for n in order) + "\n" + body
