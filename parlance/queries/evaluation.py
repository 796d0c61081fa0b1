"""Metrics of predictions, decisions, reasons, raters and judges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as op, replies
from ..registry import query
from ..sources.bindings import gold, predictions, with_ctes
from ..sources.tables import table
from .decisions import SQL_REASONED, SQL_ROUTED, reasoned, routed
from .profile import sql_wilson

CLASSES = ["abuse", "complaint", "other", "question"]
_J = "j AS (SELECT p.*, g.intent AS gold, g.escalation, g.reason AS gold_reason, g.stratum FROM predictions p JOIN gold g USING (id))"


def joined(spark, sf_dir):
    g = gold(spark, sf_dir).select("id", F.col("intent").alias("gold"), "escalation", F.col("reason").alias("gold_reason"), "stratum")
    return predictions(spark, sf_dir).join(g, "id")


def q(body: str) -> str:
    return with_ctes(f", {_J} {body}", "predictions", "gold")


_PRF = """, c AS (SELECT system, k AS class, count(*) FILTER (WHERE gold = k AND pred = k) AS tp, count(*) FILTER (WHERE gold <> k AND pred = k) AS fp, count(*) FILTER (WHERE gold = k AND pred <> k) AS fn
        FROM j CROSS JOIN (VALUES ('abuse'), ('complaint'), ('other'), ('question')) v(k) GROUP BY system, k),
    f AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp)::DOUBLE END AS precision, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn)::DOUBLE END AS recall FROM c),
    g AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM f),
    m AS (SELECT system, round(avg(f1), 6) AS macro_f1 FROM g WHERE tp + fn > 0 GROUP BY system)"""


@query(q(_PRF.replace(" g AS", " f1s AS").replace("FROM g WHERE", "FROM f1s WHERE") + " SELECT f1s.system, class, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, macro_f1 FROM f1s JOIN m USING (system)"))
def prf_macro(spark, sf_dir):
    c = op.per_class(joined(spark, sf_dir), CLASSES)
    m = op.macro_f1(c).withColumn("macro_f1", F.round("macro_f1", 6))
    return c.join(F.broadcast(m), "system").select("system", "class", "tp", "fp", "fn", *(F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")), "macro_f1")  # one row a system


@query(q(f""", s AS (SELECT system, unnest(list_filter(['full', CASE WHEN stratum = 'core' THEN 'core' ELSE 'targeted' END, CASE WHEN gold <> 'other' THEN 'valid' END], lambda x: x IS NOT NULL)) AS subset, gold = pred AS ok FROM j)
    SELECT system, subset, count(*) AS n, count(*) FILTER (WHERE ok) AS k, round(count(*) FILTER (WHERE ok) / count(*), 6) AS rate, {sql_wilson('count(*) FILTER (WHERE ok)', 'count(*)')[0]} AS low,
           {sql_wilson('count(*) FILTER (WHERE ok)', 'count(*)')[1]} AS high FROM s GROUP BY system, subset"""))
def accuracy_subsets(spark, sf_dir):
    core = F.col("stratum") == "core"
    s = joined(spark, sf_dir).select("system", op.subsets({"full": F.lit(True), "core": core, "targeted": ~core, "valid": F.col("gold") != "other"}).alias("subset"), (F.col("gold") == F.col("pred")).alias("ok"))
    return op.with_interval(s.groupBy("system", "subset").agg(F.count("*").alias("n"), F.count_if("ok").alias("k")), "k", "n")


@query(q("SELECT system, gold, pred, n, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY system ORDER BY n DESC, gold, pred) AS place FROM (SELECT system, gold, pred, count(*) AS n FROM j WHERE gold <> pred GROUP BY ALL)) WHERE place <= 5"))
def confusion_topn(spark, sf_dir):
    return op.top_confusions(joined(spark, sf_dir), 5)


@query(q("SELECT system, split_part(stratum, ':', 1) AS family, count(*) AS n, count(*) FILTER (WHERE gold = pred) AS k FROM j GROUP BY ALL"))
def accuracy_by_family(spark, sf_dir):
    return joined(spark, sf_dir).groupBy("system", F.split("stratum", ":")[0].alias("family")).agg(F.count("*").alias("n"), F.count_if(F.col("gold") == F.col("pred")).alias("k"))


_P = "round(CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda k: exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) - (b + c) * ln(2.0::DOUBLE))))) END, 6)"


def _mcnemar_sql(where: str) -> str:
    return q(f""", d AS (SELECT x.system AS sa, y.system AS sb, count(*) FILTER (WHERE x.gold = x.pred AND y.gold <> y.pred) AS b, count(*) FILTER (WHERE x.gold <> x.pred AND y.gold = y.pred) AS c
        FROM j x JOIN j y ON x.id = y.id AND x.system < y.system GROUP BY ALL) SELECT sa AS a, sb AS b, d.b AS a_only, d.c AS b_only, {_P.replace('b, c', 'd.b, d.c').replace('b + c', 'd.b + d.c')} AS p FROM d {where}""")


@query(_mcnemar_sql("WHERE sa = 'language' AND sb = 'length'"))
def mcnemar(spark, sf_dir):
    j = joined(spark, sf_dir).where("system in ('length', 'language')")
    return op.pairwise_mcnemar(j.select("system", "id", (F.col("gold") == F.col("pred")).alias("correct")))


@query(_mcnemar_sql(""))
def mcnemar_pairwise(spark, sf_dir):
    return op.pairwise_mcnemar(joined(spark, sf_dir).select("system", "id", (F.col("gold") == F.col("pred")).alias("correct")))


@query(q("""SELECT system, count(*) AS n, count(*) FILTER (WHERE decision = 'AUTO_OK') AS auto, count(*) FILTER (WHERE decision = 'AUTO_OK' AND escalation = 'ESCALATE') AS unsafe,
    round(count(*) FILTER (WHERE decision = 'AUTO_OK') / count(*), 6) AS coverage,
    CASE WHEN count(*) FILTER (WHERE decision = 'AUTO_OK') = 0 THEN 0.0 ELSE round(count(*) FILTER (WHERE decision = 'AUTO_OK' AND escalation = 'ESCALATE') / count(*) FILTER (WHERE decision = 'AUTO_OK'), 6) END AS unsafe_rate FROM j GROUP BY system"""))
def unsafe_auto(spark, sf_dir):
    return op.unsafe_auto(joined(spark, sf_dir))


_CURVE = """, th AS (SELECT DISTINCT system, score AS t FROM j UNION SELECT DISTINCT system, 0.0::DOUBLE FROM j UNION SELECT DISTINCT system, 1.0001::DOUBLE FROM j),
    curve AS (SELECT th.system, t AS threshold, count(*) FILTER (WHERE score < t) AS auto, count(*) FILTER (WHERE score < t AND escalation = 'ESCALATE') AS unsafe, round(count(*) FILTER (WHERE score < t) / count(*), 6) AS coverage,
        CASE WHEN count(*) FILTER (WHERE score < t) = 0 THEN 0.0 ELSE round(count(*) FILTER (WHERE score < t AND escalation = 'ESCALATE') / count(*) FILTER (WHERE score < t), 6) END AS risk
        FROM th JOIN j ON th.system = j.system GROUP BY th.system, t)"""


@query(q(_CURVE + " SELECT * FROM curve"))
def risk_coverage(spark, sf_dir):
    return op.risk_coverage(joined(spark, sf_dir)).drop("scored")


@query(q(_CURVE + """, rich AS (SELECT system FROM j GROUP BY system HAVING count(DISTINCT score) > 2) SELECT system, target, threshold, coverage, risk FROM (SELECT *, row_number() OVER (PARTITION BY system, target ORDER BY round(abs(coverage - target), 6), threshold) AS r
    FROM curve SEMI JOIN rich USING (system) CROSS JOIN (VALUES (0.1::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE), (0.9::DOUBLE), (1.0::DOUBLE)) v(target)) WHERE r = 1"""))
def matched_coverage(spark, sf_dir):
    return op.matched_coverage(op.risk_coverage(joined(spark, sf_dir)), [0.1, 0.25, 0.5, 0.75, 0.9, 1.0])


_CONSTANTS = {"always-escalate": "ESCALATE", "never-escalate": "AUTO_OK"}
_PLAIN = """, plain AS (SELECT system || ':decision' AS system, id, decision, escalation FROM j UNION ALL SELECT 'always-escalate', id, 'ESCALATE', escalation FROM gold UNION ALL SELECT 'never-escalate', id, 'AUTO_OK', escalation FROM gold)"""


def _plain(spark, sf_dir):
    """The decisions of all systems without their scores, and of the two constant policies."""
    out = joined(spark, sf_dir).select(F.concat("system", F.lit(":decision")).alias("system"), "id", "decision", "escalation")
    for name, value in _CONSTANTS.items():
        out = out.unionByName(gold(spark, sf_dir).select(F.lit(name).alias("system"), "id", F.lit(value).alias("decision"), "escalation"))
    return out


@query(q(_CURVE + _PLAIN + """, rich AS (SELECT system FROM j GROUP BY system HAVING count(DISTINCT score) > 2),
    others AS (SELECT system AS other, round(count(*) FILTER (WHERE decision = 'AUTO_OK') / count(*), 6) AS other_coverage,
        CASE WHEN count(*) FILTER (WHERE decision = 'AUTO_OK') = 0 THEN 0.0 ELSE round(count(*) FILTER (WHERE decision = 'AUTO_OK' AND escalation = 'ESCALATE') / count(*) FILTER (WHERE decision = 'AUTO_OK'), 6) END AS other_risk FROM plain GROUP BY system)
    SELECT system, other, other_coverage, other_risk, threshold, coverage, risk FROM (SELECT *, row_number() OVER (PARTITION BY system, other ORDER BY round(abs(coverage - other_coverage), 6), threshold) AS r
    FROM curve SEMI JOIN rich USING (system) CROSS JOIN others) WHERE r = 1"""))
def matched_systems(spark, sf_dir):
    """What each scored system risks at the coverage of every plain one."""
    return op.matched_systems(op.risk_coverage(joined(spark, sf_dir)), op.unsafe_auto(_plain(spark, sf_dir)))


@query(q(_PLAIN + f""", varied AS (SELECT system FROM plain GROUP BY system HAVING min(decision) < max(decision)), v AS (SELECT *, decision = escalation AS ok FROM plain SEMI JOIN varied USING (system)),
    d AS (SELECT x.system AS sa, y.system AS sb, count(*) FILTER (WHERE x.ok AND NOT y.ok) AS b, count(*) FILTER (WHERE NOT x.ok AND y.ok) AS c FROM v x JOIN v y ON x.id = y.id AND x.system < y.system GROUP BY ALL)
    SELECT sa AS a, sb AS b, d.b AS a_only, d.c AS b_only, {_P.replace('b, c', 'd.b, d.c').replace('b + c', 'd.b + d.c')} AS p FROM d"""))
def mcnemar_escalation(spark, sf_dir):
    """Pairs of policies on the correctness of their decisions; constant ones aren't paired."""
    varied = op.without_constants(_plain(spark, sf_dir))
    return op.pairwise_mcnemar(varied.select("system", "id", (F.col("decision") == F.col("escalation")).alias("correct")))



@query(q("""SELECT system, count(*) FILTER (WHERE decision = 'ESCALATE' AND reason = '') AS missing, count(*) FILTER (WHERE decision = 'ESCALATE' AND reason NOT IN ('', 'safety_abuse', 'high_frustration')) AS illegal,
    count(*) FILTER (WHERE contains(reason, ';')) AS multi, count(*) FILTER (WHERE decision = 'AUTO_OK' AND reason <> '') AS stray FROM j GROUP BY system"""))
def reason_invariants(spark, sf_dir):
    """Breaches of: every escalation has one legal reason, nothing else has any ('ambiguous' counts as illegal here)."""
    esc = F.col("decision") == "ESCALATE"
    return joined(spark, sf_dir).groupBy("system").agg(
        F.count_if(esc & (F.col("reason") == "")).alias("missing"), F.count_if(esc & ~F.col("reason").isin("", "safety_abuse", "high_frustration")).alias("illegal"),
        F.count_if(F.contains("reason", F.lit(";"))).alias("multi"), F.count_if(~esc & (F.col("reason") != "")).alias("stray"))


@query(f"WITH {SQL_REASONED} SELECT count(*) AS escalated, count(*) FILTER (WHERE source LIKE 'rule:%') AS by_rule, round(count(*) FILTER (WHERE source LIKE 'rule:%') / count(*), 6) AS coverage FROM reasoned WHERE decision = 'ESCALATE'")
def rule_coverage(spark, sf_dir):
    by = F.count_if(F.startswith("source", F.lit("rule:")))
    return reasoned(spark, sf_dir).where("decision = 'ESCALATE'").agg(F.count("*").alias("escalated"), by.alias("by_rule"), F.round(by / F.count("*"), 6).alias("coverage"))


@query(q("SELECT system, gold_reason, reason, count(*) AS n, gold_reason = reason AS agree FROM j WHERE decision = 'ESCALATE' AND escalation = 'ESCALATE' GROUP BY ALL"))
def reason_agreement(spark, sf_dir):
    both = joined(spark, sf_dir).where("decision = 'ESCALATE' and escalation = 'ESCALATE'")
    return both.groupBy("system", "gold_reason", "reason").agg(F.count("*").alias("n")).withColumn("agree", F.col("gold_reason") == F.col("reason"))


@query(q("SELECT DISTINCT s.system, x.gold_reason AS reason FROM (SELECT DISTINCT gold_reason FROM j WHERE gold_reason <> '') x CROSS JOIN (SELECT DISTINCT system FROM j) s WHERE NOT EXISTS (SELECT 1 FROM j WHERE j.system = s.system AND j.reason = x.gold_reason)"))
def reason_gaps(spark, sf_dir):
    """Reasons that people gave and a system never does."""
    j = joined(spark, sf_dir)
    used = j.select("system", "reason").distinct()
    human = j.where("gold_reason <> ''").select(F.col("gold_reason").alias("reason")).distinct()
    return used.select("system").distinct().crossJoin(F.broadcast(human)).join(used, ["system", "reason"], "left_anti")  # one row a reason


SQL_ACCEPTED = "NOT (regexp_matches(reply, '[0-9]+\\.[0-9]{2}') OR length(reply) < 50 OR starts_with(lower(reply), 'you should'))"
SQL_PARSED = "substr(sha256(reply), 1, 1) <> '0'"


@query(f"""WITH {SQL_REASONED}, {SQL_ROUTED} SELECT route, count(*) AS n, count(*) FILTER (WHERE l.toxic = 1) AS unsafe, count(*) FILTER (WHERE {SQL_PARSED}) AS judged, count(*) FILTER (WHERE {SQL_PARSED} AND {SQL_ACCEPTED}) AS acceptable
    FROM routed r JOIN labels l USING (doc_id) JOIN (SELECT doc_id, text AS reply FROM documents) d USING (doc_id) GROUP BY route""")
def draft_eval(spark, sf_dir):
    """Routes with how many of each should have escalated and how many a judge, whose answers are parsed, accepts."""
    texts = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("reply"))
    j = routed(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").join(texts, "doc_id")
    v = replies.verdict(replies.mock_verdict(F.col("reply")))["acceptable"]
    return j.withColumn("v", v).groupBy("route").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("unsafe"), F.count("v").alias("judged"), F.count_if("v").alias("acceptable"))


_PROBED = f"""a AS (SELECT r.doc_id, d.text FROM routed r JOIN documents d USING (doc_id) WHERE route = 'auto_reply'),
    o AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS other FROM a),
    planted AS (SELECT doc_id, d AS defect, CASE d WHEN 'wrong_intent' THEN other WHEN 'fabricated_fact' THEN text || ' The sum of 83.10 went back to your card last Tuesday.'
            WHEN 'missing_escalation' THEN 'All good, nothing more is needed from you.' ELSE 'You should have read the manual first. ' || text END AS reply
          FROM o CROSS JOIN (VALUES ('wrong_intent'), ('fabricated_fact'), ('missing_escalation'), ('hostile_tone')) k(d)),
    probed AS (SELECT doc_id, defect, CASE WHEN {SQL_PARSED} THEN {SQL_ACCEPTED} END AS acceptable FROM planted)"""


@query(f"WITH {SQL_REASONED}, {SQL_ROUTED}, {_PROBED} SELECT defect, count(acceptable) AS n, count(*) FILTER (WHERE NOT acceptable) AS k, CASE WHEN count(acceptable) = 0 THEN 0.0 ELSE round(count(*) FILTER (WHERE NOT acceptable) / count(acceptable), 6) END AS rate, {sql_wilson('count(*) FILTER (WHERE NOT acceptable)', 'count(acceptable)')[0]} AS low, {sql_wilson('count(*) FILTER (WHERE NOT acceptable)', 'count(acceptable)')[1]} AS high FROM probed GROUP BY defect")
def probe_detection(spark, sf_dir):
    """Four defects planted in each automatic reply, judged, parsed: those that a judge rejects, among those whose verdict could be read."""
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    drafts = routed(spark, sf_dir).where("route = 'auto_reply'").select("doc_id").join(texts, "doc_id")
    planted = replies.corrupted(drafts, "doc_id", "text")
    v = planted.withColumn("acceptable", replies.verdict(replies.mock_verdict(F.col("reply")))["acceptable"])
    return op.with_interval(v.groupBy("defect").agg(F.count("acceptable").alias("n"), F.count_if(~F.col("acceptable")).alias("k")), "k", "n")


# What was labelled twice, in plain SQL of both engines: the first answer and the second.
_TWICE = {
    "intent": ("intent", "CASE WHEN id % 6 = 0 THEN 'other' ELSE intent END"), "conversation_state": ("CASE WHEN n_chars < 600 THEN 'new' ELSE 'ongoing' END", "CASE WHEN n_chars < 700 THEN 'new' ELSE 'ongoing' END"),
    "urgency": ("CASE WHEN n_chars % 3 = 0 THEN 'high' ELSE 'low' END", "CASE WHEN n_chars % 6 = 0 THEN 'high' ELSE 'low' END"), "frustration": ("CASE WHEN reason = '' THEN 'low' ELSE 'high' END", "CASE WHEN escalation = 'ESCALATE' AND id % 11 > 0 THEN 'high' ELSE 'low' END"),
    "language": ("coalesce(lang, '')", "CASE WHEN id % 13 = 0 THEN 'en' ELSE coalesce(lang, '') END"), "escalation": ("escalation", "CASE WHEN id % 8 = 0 THEN 'AUTO_OK' ELSE escalation END"),
    "reason": ("reason", "CASE WHEN id % 9 = 1 THEN '' ELSE reason END"), "confidence": ("CASE WHEN id % 9 = 0 THEN 'low' ELSE 'high' END", "CASE WHEN id % 5 = 0 THEN 'low' ELSE 'high' END"),
}
_SECOND = "two AS (SELECT g.*, d.lang, d.n_chars FROM gold g JOIN documents d ON d.doc_id = g.id)"
_FIELDS = "f AS (" + " UNION ALL ".join(f"SELECT id, stratum, '{k}' AS field, {x} AS a, {y} AS b FROM two" for k, (x, y) in _TWICE.items()) + ")"
_KAPPA = """, n AS (SELECT {by} count(*) AS n, count(*) FILTER (WHERE a = b) AS agree FROM f GROUP BY ALL), l AS (SELECT {by} a AS v, count(*) AS na FROM f GROUP BY ALL), r AS (SELECT {by} b AS v, count(*) AS nb FROM f GROUP BY ALL),
    c AS (SELECT {by} sum(na * nb) AS by_chance FROM l JOIN r USING ({by} v) GROUP BY ALL)"""


def _relabelled(spark, sf_dir):
    """Labels given twice, one row for each of eight fields."""
    g = gold(spark, sf_dir).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "n_chars"), "id")
    return g.select("id", "stratum", F.explode(F.array(*(F.struct(F.lit(k).alias("field"), F.expr(x).alias("a"), F.expr(y).alias("b")) for k, (x, y) in _TWICE.items()))).alias("x")).select("id", "stratum", "x.*")


_K = "round(CASE WHEN by_chance = n * n THEN 1.0 ELSE (agree / n - coalesce(by_chance, 0) / (n * n)::DOUBLE) / (1 - coalesce(by_chance, 0) / (n * n)::DOUBLE) END, 6)"


@query(with_ctes(f", {_SECOND}, {_FIELDS}{_KAPPA.format(by='field,')} SELECT field, n, agree, {_K} AS kappa FROM n LEFT JOIN c USING (field)", "gold"))
def cohen_kappa(spark, sf_dir):
    return op.kappa(_relabelled(spark, sf_dir), ["field"], "a", "b")


@query(with_ctes(f", {_SECOND}, {_FIELDS}{_KAPPA.format(by='field, stratum,')} SELECT field, stratum, n, agree, {_K} AS kappa, round(agree / n, 6) AS rate, {sql_wilson('agree', 'n')[0]} AS low, {sql_wilson('agree', 'n')[1]} AS high FROM n LEFT JOIN c USING (field, stratum)", "gold"))
def self_agreement(spark, sf_dir):
    return op.with_interval(op.kappa(_relabelled(spark, sf_dir), ["field", "stratum"], "a", "b"), "agree", "n")


@query(with_ctes(f", {_SECOND}, {_FIELDS} SELECT id, field, a, b FROM f WHERE a <> b", "gold"))
def label_diffs(spark, sf_dir):
    return _relabelled(spark, sf_dir).where("a <> b").select("id", "field", "a", "b")


_RATED = """asked AS (SELECT *, CASE WHEN doc_id % 11 = 0 THEN '' WHEN doc_id % 5 = 0 THEN 'n' WHEN doc_id % 2 = 0 THEN ' Yes' ELSE 'y' END AS h FROM labels),
    f AS (SELECT 'acceptable' AS field, CASE WHEN upper(substr(trim(h), 1, 1)) = 'Y' THEN 'yes' ELSE 'no' END AS a, CASE WHEN quality = 1 THEN 'yes' ELSE 'no' END AS b FROM asked WHERE h <> ''
          UNION ALL SELECT d, CAST(1 + (doc_id + i) % 5 AS VARCHAR), CAST(1 + (doc_id + i * quality) % 5 AS VARCHAR) FROM asked CROSS JOIN (VALUES ('addresses_need', 0), ('grounded', 1), ('routing', 2), ('tone', 3)) v(d, i) WHERE h <> '' AND (doc_id + i) % 6 > 0)"""


@query(f"WITH {_RATED}{_KAPPA.format(by='field,')} SELECT field, n, agree, {_K} AS kappa, round(agree / n, 6) AS rate, {sql_wilson('agree', 'n')[0]} AS low, {sql_wilson('agree', 'n')[1]} AS high FROM n LEFT JOIN c USING (field)")
def judge_agreement(spark, sf_dir):
    """A judge against people: yes or no in any spelling, and four dimensions that must agree exactly; some answers are blank."""
    i = F.col("doc_id")
    human = F.when(i % 11 == 0, "").when(i % 5 == 0, "n").when(i % 2 == 0, " Yes").otherwise("y")
    rows = table(spark, sf_dir, "labels").select("doc_id", human.alias("human_acceptable"), F.when(F.col("quality") == 1, "True").otherwise("False").alias("judge_acceptable"), *(
        c for k, d in enumerate(replies.DIMENSIONS) for c in (
            F.when((i + k) % 6 > 0, F.concat(((i + k) % 5 + 1).cast("string"), F.lit(" "))).otherwise("").alias(f"human_{d}"), ((i + k * F.col("quality")) % 5 + 1).cast("string").alias(f"judge_{d}"))))
    return op.with_interval(op.kappa(op.rated(rows, replies.DIMENSIONS, "doc_id"), ["field"], "a", "b"), "agree", "n")


@query("""SELECT count(*) AS judged, count(tone) AS parsed, count(*) FILTER (WHERE acceptable) AS acceptable, round(avg(tone), 6) AS mean_tone
    FROM (SELECT CASE WHEN event_id % 3 <> 0 THEN CAST(1 + event_id % 5 AS DOUBLE) END AS tone, event_id % 3 <> 0 AND event_id % 2 = 0 AS acceptable FROM events)""")
def judge_summary(spark, sf_dir):
    from .text import judge_parse

    v = judge_parse(spark, sf_dir)
    return v.agg(F.count("*").alias("judged"), F.count_if("parsed").alias("parsed"), F.count_if("acceptable").alias("acceptable"), F.round(F.avg(F.when(F.col("parsed"), F.col("tone").cast("double"))), 6).alias("mean_tone"))


@query("""SELECT * FROM (VALUES
    ('unique_ids', (SELECT count(*) FROM (SELECT doc_id FROM documents GROUP BY doc_id HAVING count(*) > 1))),
    ('labels_known', (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))),
    ('label_domain', (SELECT count(*) FROM labels WHERE quality NOT IN (0, 1) OR toxic NOT IN (0, 1))),
    ('one_label', (SELECT count(*) FROM (SELECT doc_id FROM labels GROUP BY doc_id HAVING count(*) > 1))),
    ('no_blank', (SELECT count(*) FROM documents WHERE NOT regexp_matches(text, '[^\\s]'))),
    ('length_true', (SELECT count(*) FROM documents WHERE n_chars <> length(text))),
    ('no_exact_copies', (SELECT count(*) FROM (SELECT text FROM documents GROUP BY text HAVING count(*) > 1))),
    ('labels_late', (SELECT count(*) FROM events WHERE ts < TIMESTAMP '2024-01-01'))) t(\"check\", violations), LATERAL (SELECT violations = 0 AS passed)""")
def integrity_checks(spark, sf_dir):
    d, l, e = (table(spark, sf_dir, x) for x in ("documents", "labels", "events"))  # noqa: E741
    many = lambda df, k: df.groupBy(k).agg(F.count("*").alias("n")).where("n > 1")
    return op.assertions({
        "unique_ids": many(d, "doc_id"), "labels_known": l.join(d.select("doc_id"), "doc_id", "left_anti"), "label_domain": l.where("quality not in (0, 1) or toxic not in (0, 1)"),
        "one_label": many(l, "doc_id"), "no_blank": d.where(~F.col("text").rlike(r"[^\s]")), "length_true": d.where(F.col("n_chars") != F.length("text")),
        "no_exact_copies": many(d.select(F.md5("text").alias("t")), "t"), "labels_late": e.where("ts < timestamp_ntz'2024-01-01 00:00:00'")})
