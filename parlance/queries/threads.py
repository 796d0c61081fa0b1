"""Thread reconstruction and the joins around it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import threads as op
from ..registry import query
from ..sources.bindings import SPLITS, messages, with_ctes


def frame(spark, sf_dir):
    return op.threads(messages(spark, sf_dir))


def pairs(spark, sf_dir):
    return op.opener_pairs(frame(spark, sf_dir), SPLITS)


@query(with_ctes("SELECT id, coalesce(parent, -1) AS parent, coalesce(up, -1) AS up, parent IS NOT NULL AND up IS NULL AS dangling FROM resolved", "resolved"))
def edge_resolution(spark, sf_dir):
    return op.resolve_edges(messages(spark, sf_dir)).select("id", F.coalesce("parent", F.lit(-1).cast("long")).alias("parent"), F.coalesce("up", F.lit(-1).cast("long")).alias("up"), "dangling")


@query(with_ctes("SELECT id, root, id = root AS is_root FROM roots", "roots"))
def thread_roots(spark, sf_dir):
    return op.thread_roots(messages(spark, sf_dir)).withColumn("is_root", F.col("id") == F.col("root"))


@query(with_ctes("""SELECT count(*) AS messages, count(parent) AS refs, count(up) AS resolved, count(*) FILTER (WHERE parent IS NOT NULL AND up IS NULL) AS dangling,
                    (SELECT count(DISTINCT root) FROM roots) AS threads FROM resolved""", "roots"))
def thread_stats(spark, sf_dir):
    """One thread for each message without a resolved parent, so roots need not be found to count them."""
    return op.resolve_edges(messages(spark, sf_dir)).agg(
        F.count("*").alias("messages"), F.count("parent").alias("refs"), F.count("up").alias("resolved"), F.count_if("dangling").alias("dangling"), F.count_if(F.col("up").isNull()).alias("threads"))


@query(with_ctes("SELECT id, thread, inbound, author FROM threads WHERE thread IN (SELECT thread FROM threads WHERE author = 'b1')", "threads"))
def brand_threads(spark, sf_dir):
    return op.brand_threads(frame(spark, sf_dir), "b1").select("id", "thread", "inbound", "author")


@query(with_ctes("SELECT * FROM replies", "replies"))
def first_reply(spark, sf_dir):
    return op.first_replies(frame(spark, sf_dir))


@query(with_ctes("SELECT thread, id, author, created_at, text, coalesce(reply_id, -1) AS reply_id, reply, split FROM pairs", "pairs"))
def opener_pairs(spark, sf_dir):
    return pairs(spark, sf_dir).drop("reply_at").withColumn("reply_id", F.coalesce("reply_id", F.lit(-1).cast("long")))


@query("""SELECT event_id, CASE WHEN ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-15' THEN 'train'
                                WHEN ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-22' THEN 'dev'
                                WHEN ts >= TIMESTAMP '2024-01-22' AND ts < TIMESTAMP '2024-01-29' THEN 'test' ELSE 'outside' END AS split FROM events""")
def temporal_split(spark, sf_dir):
    from ..sources.tables import table

    return table(spark, sf_dir, "events").select("event_id", op.split_of(F.col("ts"), SPLITS).alias("split"))


@query(with_ctes("""SELECT p.id, p.text, b.text AS reply, strlen(b.text) > 200 AS long_reply
                    FROM pairs p JOIN (SELECT * FROM threads WHERE author = 'b1' QUALIFY row_number() OVER (PARTITION BY thread ORDER BY created_at, id) = 1) b ON p.thread = b.thread
                    WHERE p.split = 'train'""", "pairs"))
def train_openers(spark, sf_dir):
    """Only the brand's own first answer counts here, and openers without one are left out."""
    f = frame(spark, sf_dir)
    own = op.first_replies(f.where("author = 'b1'")).select("thread", "reply")
    p = op.opener_pairs(f, SPLITS).where("split = 'train'").select("thread", "id", "text")
    return p.join(own, "thread").select("id", "text", "reply", (F.octet_length("reply") > 200).alias("long_reply"))


@query("""SELECT user_id, count(DISTINCT split) AS splits FROM (SELECT user_id, CASE WHEN ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-15' THEN 'train'
          WHEN ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-22' THEN 'dev' WHEN ts >= TIMESTAMP '2024-01-22' AND ts < TIMESTAMP '2024-01-29' THEN 'test' ELSE 'outside' END AS split FROM events)
          GROUP BY user_id HAVING count(DISTINCT split) > 1""")
def straddle_check(spark, sf_dir):
    """Groups that lie in more than one split.  Openers of one thread can't, so the check runs over users' events."""
    from ..sources.tables import table

    return op.straddling(table(spark, sf_dir, "events").withColumn("split", op.split_of(F.col("ts"), SPLITS)), "user_id")


@query(with_ctes("""
    , train AS (SELECT * FROM pairs WHERE split = 'train'), a AS (SELECT * FROM pairs WHERE split <> 'train'),
      b AS (SELECT * FROM a WHERE thread NOT IN (SELECT thread FROM train)), c AS (SELECT * FROM b WHERE author NOT IN (SELECT author FROM train)),
      d AS (SELECT * FROM c WHERE text NOT IN (SELECT text FROM train))
    SELECT * FROM (VALUES ('start', (SELECT count(*) FROM a)), ('thread', (SELECT count(*) FROM b)), ('customer', (SELECT count(*) FROM c)), ('text', (SELECT count(*) FROM d))) t(step, rows)""", "pairs"))
def exclusion_trace(spark, sf_dir):
    """Rows left after each of three exclusions against the training split."""
    from ..operators.dedup import traced
    from ..sources.tables import stored

    p = stored(pairs(spark, sf_dir).select("id", "thread", "author", "text", "split"), "pairs")
    train, rest = p.where("split = 'train'"), p.where("split <> 'train'")
    steps = (("thread", "thread"), ("customer", "author"), ("text", "text"))
    for name, key in steps:
        rest = rest.join(train.select(key).distinct().withColumn(f"in_{name}", F.lit(True)), key, "left")
    return traced(rest, [(name, None, F.col(f"in_{name}").isNull()) for name, _ in steps], "id")


@query(with_ctes("""
    , train AS (SELECT * FROM pairs WHERE split = 'train'), test AS (SELECT * FROM pairs WHERE split <> 'train')
    SELECT count(DISTINCT author) AS customers, count(DISTINCT author) FILTER (WHERE author IN (SELECT author FROM train)) AS seen_customers,
           count(reply) AS replies, count(reply) FILTER (WHERE reply IN (SELECT reply FROM train WHERE reply IS NOT NULL)) AS seen_replies FROM test""", "pairs"))
def leakage_overlap(spark, sf_dir):
    """How many later customers and replies the training split already holds."""
    p = pairs(spark, sf_dir)
    train, test = p.where("split = 'train'"), p.where("split <> 'train'")
    who = train.select("author").distinct().withColumn("seen_author", F.lit(True))
    said = train.where("reply is not null").select("reply").distinct().withColumn("seen_reply", F.lit(True))
    return test.join(who, "author", "left").join(said, "reply", "left").agg(
        F.count_distinct("author").alias("customers"), F.count_distinct(F.when(F.col("seen_author"), F.col("author"))).alias("seen_customers"),
        F.count("reply").alias("replies"), F.count("seen_reply").alias("seen_replies"))


@query("""SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'a' ELSE 'b' END AS only_in
          FROM (SELECT doc_id FROM documents WHERE doc_id % 5 <> 0) d FULL JOIN (SELECT doc_id FROM labels) l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL""")
def id_mismatch(spark, sf_dir):
    from ..sources.tables import table

    return op.missing_either_way(table(spark, sf_dir, "documents").where("doc_id % 5 <> 0"), table(spark, sf_dir, "labels"), "doc_id")
