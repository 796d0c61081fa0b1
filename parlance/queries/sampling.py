"""Duplicates and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import masked
from ..operators import dedup, sampling as op
from ..registry import query
from ..sources.bindings import documents, with_ctes
from ..sources.tables import stored, table
from .governance import MARKS as _MARKS, marks
from .retrieval import sql_near, sql_shingled
from .text import SHINGLE_CTE, _MASKED, _STRIPPED
from .threads import pairs

_CHAIN = f"""
    , p AS (SELECT id, thread, author, {_MASKED} AS clean FROM pairs),
      a AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY thread ORDER BY id) = 1),
      b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY author ORDER BY id) = 1),
      c AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY clean ORDER BY id) = 1)"""


def _chain(spark, sf_dir):
    p = pairs(spark, sf_dir).select("id", "thread", "author", masked(F.col("text")).alias("clean"))
    return p, dedup.keep_first(p, ["thread", "author", "clean"], "id")


@query(with_ctes(_CHAIN + " SELECT id, thread, author FROM c", "pairs"))
def dedup_chain(spark, sf_dir):
    """Three successive removals, not one by all keys."""
    return _chain(spark, sf_dir)[1][-1][1].select("id", "thread", "author")


@query(with_ctes(_CHAIN + " SELECT * FROM (VALUES ('start', (SELECT count(*) FROM p)), ('thread', (SELECT count(*) FROM a)), ('author', (SELECT count(*) FROM b)), ('clean', (SELECT count(*) FROM c))) t(step, rows)", "pairs"))
def dedup_trace(spark, sf_dir):
    return dedup.traced(_chain(spark, sf_dir)[0], [(k, k, None) for k in ("thread", "author", "clean")], "id")


def _docs(spark, sf_dir):
    return documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")


_CLASSES = """cls AS (SELECT id, n, min(id) OVER (PARTITION BY id >= 0, gs) AS rep FROM (SELECT id, count(*) AS n, list_sort(list(g)) AS gs FROM sh GROUP BY id)),
    rs AS (SELECT sh.*, n FROM sh JOIN cls ON cls.id = sh.id AND cls.rep = sh.id)"""
_CLASSED = f"WITH src AS (SELECT doc_id AS id, text FROM documents), {SHINGLE_CTE}, {_CLASSES}"
_PAIRS = f"""{_CLASSED} SELECT a.id AS a, b.id AS b, count(*) AS common, any_value(a.n) AS size_a, any_value(b.n) AS size_b FROM rs a JOIN rs b ON a.g = b.g AND a.id < b.id GROUP BY a.id, b.id"""
_MEMBERS = "SELECT rep AS a, id AS b, n AS common, n AS size_a, n AS size_b FROM cls WHERE id <> rep"


@query(f"{_CLASSED} SELECT id AS doc_id, rep, n AS shingles FROM cls")
def neardup_members(spark, sf_dir):
    """The class of texts with equal shingles that a document is in, by its least id; documents without words are in none."""
    return dedup.similar(_docs(spark, sf_dir), None, 80).left.select(F.col("id").alias("doc_id"), "rep", F.col("n").alias("shingles"))


@query(f"{_PAIRS} HAVING count(*) * 180 >= 80 * (any_value(a.n) + any_value(b.n)) UNION ALL {_MEMBERS}")
def neardup_pairs(spark, sf_dir):
    """All similar documents: similar classes by their representatives, and each further member of a class with its representative."""
    return dedup.similar(_docs(spark, sf_dir), None, 80).linked()


@query(f"SELECT a, b, round(common / (size_a + size_b - common), 6) AS jaccard FROM ({_PAIRS} HAVING count(*) * 160 >= 60 * (any_value(a.n) + any_value(b.n)) UNION ALL {_MEMBERS})")
def jaccard_pairs(spark, sf_dir):
    """Similarities of at least 0.6: of classes of documents by their representatives, and of each further member of a class with its representative (1)."""
    p = dedup.similar(_docs(spark, sf_dir), None, 60).linked()
    return p.select("a", "b", F.round(F.col("common") / (F.col("size_a") + F.col("size_b") - F.col("common")), 6).alias("jaccard"))


@query(f"""WITH src AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT -1 - item_id, text FROM benchmark), {SHINGLE_CTE}, n AS (SELECT id, count(*) AS n FROM sh GROUP BY id)
    SELECT a.id AS doc_id, -1 - b.id AS item_id, count(*) AS common FROM sh a JOIN sh b ON a.g = b.g AND a.id >= 0 AND b.id < 0
    JOIN n na ON na.id = a.id JOIN n nb ON nb.id = b.id GROUP BY a.id, b.id HAVING count(*) * 120 >= 20 * (any_value(na.n) + any_value(nb.n))""")
def neardup_cross(spark, sf_dir):
    """Every document against every reference passage at a similarity of 0.2 or more, copies too."""
    refs = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return dedup.similar(_docs(spark, sf_dir), refs, 20).expanded().select(F.col("a").alias("doc_id"), F.col("b").alias("item_id"), "common")


_ALL_PAIRS = f"""WITH src AS (SELECT doc_id AS id, text FROM documents), {SHINGLE_CTE}, n AS (SELECT id, count(*) AS n FROM sh GROUP BY id)
    SELECT a.id AS a, b.id AS b FROM sh a JOIN sh b ON a.g = b.g AND a.id < b.id JOIN n na ON na.id = a.id JOIN n nb ON nb.id = b.id GROUP BY a.id, b.id"""
_GREEDY = """near AS MATERIALIZED (SELECT b AS id, list(a) AS earlier, row_number() OVER (ORDER BY b) AS rn FROM links GROUP BY b),
    g AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS gone UNION ALL
          SELECT i + 1, CASE WHEN len(list_filter(earlier, lambda x: NOT list_contains(gone, x))) > 0 THEN list_append(gone, id) ELSE gone END FROM g JOIN near ON rn = i + 1),
    dropped AS (SELECT unnest(gone) AS id FROM g WHERE i = (SELECT max(i) FROM g))"""


@query(f"WITH RECURSIVE links AS MATERIALIZED ({_ALL_PAIRS} HAVING count(*) * 180 >= 80 * (any_value(na.n) + any_value(nb.n))), {_GREEDY} SELECT doc_id, doc_id NOT IN (SELECT id FROM dropped) AS kept FROM documents")
def neardup_collapse(spark, sf_dir):
    """In the order of ids a row goes if it is similar to an earlier one that stays; the SQL walks the rows one by one."""
    return dedup.collapsed(_docs(spark, sf_dir), 80).select(F.col("id").alias("doc_id"), "kept")


_POOL = f"""
    , prepared AS (SELECT id, thread, author, split, reply, text, {_STRIPPED} AS clean FROM pairs),
      shown AS (SELECT * FROM prepared ORDER BY md5('shown:' || id), id LIMIT 12),
      s0 AS (SELECT id, thread, author, clean FROM prepared WHERE split <> 'train' AND reply IS NOT NULL), s1 AS (SELECT * FROM s0 WHERE clean <> ''),
      s2 AS (SELECT * FROM s1 WHERE thread NOT IN (SELECT thread FROM shown)), s3 AS (SELECT * FROM s2 WHERE author NOT IN (SELECT author FROM shown)), s4 AS (SELECT * FROM s3 WHERE id NOT IN (SELECT id FROM shown)),
      s5 AS (SELECT * FROM s4 QUALIFY row_number() OVER (PARTITION BY thread ORDER BY id) = 1), s6 AS (SELECT * FROM s5 QUALIFY row_number() OVER (PARTITION BY author ORDER BY id) = 1),
      s7 AS (SELECT * FROM s6 QUALIFY row_number() OVER (PARTITION BY clean ORDER BY id) = 1),
      {sql_shingled('left_sh', 'SELECT id, clean AS text FROM s7')}, {sql_shingled('shown_sh', 'SELECT id, clean AS text FROM shown')},
      links AS MATERIALIZED (SELECT x.id AS a, y.id AS b FROM left_sh x JOIN left_sh y ON x.id < y.id AND {sql_near('x.sh', 'y.sh')}), {_GREEDY},
      s8 AS (SELECT * FROM s7 WHERE id NOT IN (SELECT id FROM dropped)),
      s9 AS (SELECT * FROM s8 WHERE id NOT IN (SELECT x.id FROM left_sh x JOIN shown_sh y ON {sql_near('x.sh', 'y.sh')}))"""
_POOL_STEPS = ("start", "not_blank", "thread_not_shown", "author_not_shown", "id_not_shown", "thread", "author", "clean", "near_copy", "near_shown")


def _pool(spark, sf_dir):
    """(openers, shown, pool, trace): answered openers after the training window, and twelve openers that were shown before."""
    from ..plans import pool

    p = stored(pairs(spark, sf_dir), "pairs")
    openers = pool.prepared(p.where("split <> 'train' and reply is not null"))
    shown = stored(op.take(pool.prepared(p), "id", 12, "shown:", "shown").select("id", "thread", "author", "clean"), "shown")
    return p, openers, shown, *pool.build_pool(openers, shown)


@query(with_ctes(_POOL + " SELECT * FROM (VALUES " + ", ".join(f"('{name}', (SELECT count(*) FROM s{i}))" for i, name in enumerate(_POOL_STEPS)) + ") t(step, rows)", "pairs"))
def pool_trace(spark, sf_dir):
    return _pool(spark, sf_dir)[4]


@query(with_ctes(_POOL + " SELECT id, thread, author FROM s9", "pairs"))
def pool_members(spark, sf_dir):
    return _pool(spark, sf_dir)[3].select("id", "thread", "author")


_GOLDEN = _POOL + """
    , g1 AS (SELECT id, 'core' AS stratum, count(*) OVER () AS n, row_number() OVER (ORDER BY md5('golden0:' || id), id) AS r FROM s9), d1 AS (SELECT id, stratum, n FROM g1 WHERE r <= 6),
      g2 AS (SELECT id, 'targeted:long' AS stratum, count(*) OVER () AS n, row_number() OVER (ORDER BY md5('golden1:' || id), id) AS r FROM s9 WHERE length(clean) > 200 AND id NOT IN (SELECT id FROM d1)),
      d2 AS (SELECT * FROM d1 UNION ALL SELECT id, stratum, n FROM g2 WHERE r <= 4)"""
_GOLDEN_CHECKS = (
    "row_count", "ids_unique", "ids_match_key", "opener_of_window", "no_shown_thread", "no_shown_author", "no_shown_id", "one_per_thread", "one_per_author", "exact_text", "inbound_only", "strata_hidden", "answers_blank", "no_byte_order_mark")


def _golden(spark, sf_dir):
    """(items, key, manifest, openers, shown) of a sample drawn from the pool: a core and long texts."""
    from ..plans import pool

    p, openers, shown, members, _ = _pool(spark, sf_dir)
    steps = [("core", F.lit(True), 6), ("targeted:long", F.length("clean") > 200, 4)]
    return *pool.drawn(members, p, steps, "golden", "G"), openers.withColumn("inbound", F.lit(True)), shown


@query(with_ctes(_GOLDEN + " SELECT 'G' || lpad(CAST(row_number() OVER (ORDER BY md5('golden:' || id), id) AS VARCHAR), 3, '0') AS blind_id, id, stratum, n AS eligible, round(greatest(1.0, n / CASE stratum WHEN 'core' THEN 6 ELSE 4 END), 6) AS design_weight FROM d2", "pairs"))
def golden_key(spark, sf_dir):
    return _golden(spark, sf_dir)[1].select("blind_id", "id", "stratum", "eligible", F.round("design_weight", 6).alias("design_weight"))


@query(with_ctes(_GOLDEN + " SELECT stratum, count(*) AS drawn, max(n) AS eligible, CAST(CASE stratum WHEN 'core' THEN 6 ELSE 4 END AS BIGINT) AS requested FROM d2 GROUP BY stratum", "pairs"))
def golden_manifest(spark, sf_dir):
    return _golden(spark, sf_dir)[2]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{c}', CAST(0 AS BIGINT), true)" for c in _GOLDEN_CHECKS) + ') t("check", violations, passed)')
def golden_verify(spark, sf_dir):
    """The checks of a freshly drawn sample, all of which must hold; a test plants a fault for each."""
    from ..plans.pool import verified

    return verified(*_golden(spark, sf_dir))


@query("""SELECT doc_id, source, 'core' AS stratum, n AS eligible, round(least(1.0, 5 / n), 6) AS inclusion_prob
          FROM (SELECT doc_id, source, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY md5('core:' || doc_id), doc_id) AS r FROM documents) WHERE r <= 5""")
def stratified_draw(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", "source")
    return op.draw(d, "doc_id", 5, "core:", "core", ["source"]).select("doc_id", "source", "stratum", "eligible", F.round("inclusion_prob", 6).alias("inclusion_prob"))


_PLAN = """WITH a AS (SELECT doc_id, 'core' AS stratum, count(*) OVER () AS n, row_number() OVER (ORDER BY md5('plan0:' || doc_id), doc_id) AS r FROM documents),
    s1 AS (SELECT doc_id, stratum, n FROM a WHERE r <= 40),
    b AS (SELECT doc_id, 'boundary:short' AS stratum, count(*) OVER () AS n, row_number() OVER (ORDER BY md5('plan1:' || doc_id), doc_id) AS r FROM documents WHERE n_chars < 500 AND doc_id NOT IN (SELECT doc_id FROM s1)),
    s2 AS (SELECT * FROM s1 UNION ALL SELECT doc_id, stratum, n FROM b WHERE r <= 20),
    c AS (SELECT doc_id, 'targeted:es' AS stratum, count(*) OVER () AS n, row_number() OVER (ORDER BY md5('plan2:' || doc_id), doc_id) AS r FROM documents WHERE lang = 'es' AND doc_id NOT IN (SELECT doc_id FROM s2)),
    s3 AS (SELECT * FROM s2 UNION ALL SELECT doc_id, stratum, n FROM c WHERE r <= 20)"""
_KS = "CASE stratum WHEN 'core' THEN 40 ELSE 20 END"


def _plan(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", "n_chars", "lang")
    return op.sequential_plan(d, "doc_id", [("core", F.lit(True), 40), ("boundary:short", F.col("n_chars") < 500, 20), ("targeted:es", F.col("lang") == "es", 20)], "plan")


@query(_PLAN + " SELECT doc_id, stratum, n AS eligible FROM s3")
def sample_plan(spark, sf_dir):
    return _plan(spark, sf_dir).select("doc_id", "stratum", "eligible")


@query(_PLAN + f" SELECT stratum, count(*) AS drawn, round(sum(greatest(1.0, n / {_KS})), 4) AS weight FROM s3 GROUP BY stratum")
def design_weights(spark, sf_dir):
    return _plan(spark, sf_dir).groupBy("stratum").agg(F.count("*").alias("drawn"), F.round(F.sum("design_weight"), 4).alias("weight"))


@query(_PLAN + " SELECT doc_id, 'G' || lpad(CAST(row_number() OVER (ORDER BY md5('blind:' || doc_id), doc_id) AS VARCHAR), 3, '0') AS blind_id FROM s3")
def blind_ids(spark, sf_dir):
    return op.blind_ids(_plan(spark, sf_dir), "doc_id", "blind:", "G").select("doc_id", "blind_id")


# Pools of a second pass, in the order they are drawn: name, SQL condition, rows.  The random one comes first and is unbiased.
_RETEST = (("random", "true", 12), ("low_confidence", "confidence = 'low'", 7), ("unclear_confident", "intent = 'other' AND confidence <> 'low'", 5), ("boundary", "stratum LIKE 'boundary:%'", 3), ("escalation_deviant", "escalation <> usual", 3))


def _retest_sql() -> str:
    parts = [f""", {_MARKS}, usual AS (SELECT intent, arg_min(escalation, (-n, escalation)) AS usual FROM (SELECT intent, escalation, count(*) AS n FROM gold GROUP BY ALL) GROUP BY intent),
        rated AS (SELECT * FROM marks JOIN usual USING (intent)), t0 AS (SELECT id, '' AS pool, CAST(0 AS BIGINT) AS n FROM rated WHERE false)"""]
    for i, (name, where, k) in enumerate(_RETEST):
        parts.append(f"""p{i} AS (SELECT id, '{name}' AS pool, count(*) OVER () AS n, row_number() OVER (ORDER BY md5('retest{i}:' || id), id) AS r FROM rated WHERE {where} AND id NOT IN (SELECT id FROM t{i})),
            t{i + 1} AS (SELECT * FROM t{i} UNION ALL SELECT id, pool, n FROM p{i} WHERE r <= {k})""")
    return ",\n".join(parts)


def _retest(spark, sf_dir):
    from ..operators.decisions import majority
    from ..sources.bindings import gold

    g = gold(spark, sf_dir)
    rated = marks(spark, sf_dir).join(F.broadcast(majority(g, "intent", "escalation").withColumnRenamed("majority", "usual")), "intent")  # one row an intent
    chosen = op.sequential_plan(stored(rated, "rated"), "id", [(name, F.expr(where), k) for name, where, k in _RETEST], "retest")
    return op.blind_ids(chosen, "id", "retest:", "R")


@query(with_ctes(_retest_sql() + f" SELECT id, pool, n AS eligible, 'R' || lpad(CAST(row_number() OVER (ORDER BY md5('retest:' || id), id) AS VARCHAR), 3, '0') AS blind_id FROM t{len(_RETEST)}", "gold"))
def retest_draw(spark, sf_dir):
    """Five overlapping pools, drawn one after another without replacement, then shuffled and numbered blindly."""
    return _retest(spark, sf_dir).select("id", F.col("stratum").alias("pool"), "eligible", "blind_id")


_RETEST_CHECKS = ("ids_unique", "ids_in_key", "one_item_each", "item_of_first_pass", "exact_text", "answers_blank", "blind", "due")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{c}', CAST({int(c == 'due')} AS BIGINT), {c != 'due'})" for c in _RETEST_CHECKS) + ') t("check", violations, passed)')
def retest_verify(spark, sf_dir):
    """The checks of a fresh second pass three days after it was built: all hold but the delay of five days."""
    from ..plans.pool import ANSWERS, retest_verified

    key = stored(_retest(spark, sf_dir).select("blind_id", F.concat(F.lit("first-"), F.col("id").cast("string")).alias("first_id"), "id"), "retest")
    texts = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")
    items = key.join(texts, "id").select("blind_id", "text", *(F.lit("").alias(a) for a in ANSWERS))
    first = texts.select(F.concat(F.lit("first-"), F.col("id").cast("string")).alias("first_id"), "text")
    return retest_verified(items, key.select("blind_id", "first_id"), first, "2024-02-01 00:00:00", "2024-02-04 00:00:00")


@query("""SELECT source, doc_id, n FROM (SELECT source, doc_id, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY md5('ex:' || doc_id), doc_id) AS r FROM documents) WHERE r <= 3""")
def group_examples(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", "source")
    return op.draw(d, "doc_id", 3, "ex:", "", ["source"]).select("source", "doc_id", F.col("eligible").alias("n"))
