"""Distributions, validation and ledgers of labels and calls."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import codebook, evaluation as ev
from ..operators.decisions import lookup_policy, majority
from ..registry import query
from ..sources.bindings import gold, with_ctes
from ..sources.tables import table
from .profile import sql_wilson

_DOMAIN = ["abuse", "complaint", "other", "question", "praise"]


@query(with_ctes(f"""
    , s AS (SELECT unnest(['full', CASE WHEN stratum = 'core' THEN 'core' ELSE 'targeted' END]) AS subset, intent FROM gold),
      cells AS (SELECT subset, value, count(s.intent) AS k FROM (SELECT DISTINCT subset AS sub FROM s) CROSS JOIN (SELECT value FROM (VALUES ('abuse'), ('complaint'), ('other'), ('question'), ('praise')) d(value) UNION SELECT DISTINCT intent FROM s) v LEFT JOIN s ON s.subset = sub AND s.intent = value, LATERAL (SELECT sub AS subset) GROUP BY ALL),
      t AS (SELECT subset, count(*) AS n FROM s GROUP BY subset)
    SELECT subset, value, k, n, round(k / n, 6) AS rate, {sql_wilson('k', 'n')[0]} AS low, {sql_wilson('k', 'n')[1]} AS high FROM cells JOIN t USING (subset)""".replace("SELECT subset, value, count(s.intent) AS k FROM", "SELECT sub AS subset, value, count(s.intent) AS k FROM").replace(", LATERAL (SELECT sub AS subset) GROUP BY ALL", " GROUP BY sub, value"), "gold"))
def label_distribution(spark, sf_dir):
    """Every value of the domain in each overlapping subset, those that never occur with 0, and values that occur outside the domain."""
    core = F.col("stratum") == "core"
    s = gold(spark, sf_dir).select(ev.subsets({"full": F.lit(True), "core": core, "targeted": ~core}).alias("subset"), "intent")
    return ev.distribution(s, "subset", "intent", _DOMAIN)


@query(with_ctes(""", u AS (SELECT 'intent' AS field, intent AS v FROM gold UNION ALL SELECT 'escalation', escalation FROM gold UNION ALL SELECT 'reason', reason FROM gold),
    n AS (SELECT field, v, count(*) AS n FROM u GROUP BY ALL) SELECT field, round(max(n) / sum(n), 6) AS modal_share, max(n) / sum(n) >= 0.9 AS near_constant FROM n GROUP BY field""", "gold"))
def near_constant(spark, sf_dir):
    """Fields whose most frequent value has 90% or more of the rows."""
    u = gold(spark, sf_dir).select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("v")) for c in ("intent", "escalation", "reason")))).alias("x")).select("x.*")
    n = u.groupBy("field", "v").agg(F.count("*").alias("n")).groupBy("field").agg((F.max("n") / F.sum("n")).alias("s"))
    return n.select("field", F.round("s", 6).alias("modal_share"), (F.col("s") >= 0.9).alias("near_constant"))


@query(with_ctes(", n AS (SELECT intent, escalation, count(*) AS n FROM gold GROUP BY ALL) SELECT intent, CAST(sum(n) AS BIGINT) AS n, round(max(n) / sum(n), 6) AS purity, arg_min(escalation, (-n, escalation)) AS majority FROM n GROUP BY intent", "gold"))
def majority_lookup(spark, sf_dir):
    """Decision counts by intent: purity and the majority."""
    g = gold(spark, sf_dir)
    n = g.groupBy("intent", "escalation").agg(F.count("*").alias("c"))
    return n.groupBy("intent").agg(F.sum("c").alias("n"), F.round(F.max("c") / F.sum("c"), 6).alias("purity")).join(majority(g, "intent", "escalation"), "intent")


@query(with_ctes("""SELECT split_part(stratum, ':', 1) AS family, count(*) AS n, count(*) FILTER (WHERE list_contains(string_split(split_part(stratum, ':', 2), '|'), intent)) AS agree FROM gold WHERE stratum <> 'core' GROUP BY ALL""", "gold"))
def proxy_agreement(spark, sf_dir):
    """How often an item drawn for a label, or for one of a pair, was given it."""
    g = gold(spark, sf_dir).where("stratum <> 'core'").select(F.split("stratum", ":").alias("s"), "intent")
    return g.groupBy(F.col("s")[0].alias("family")).agg(F.count("*").alias("n"), F.count_if(F.array_contains(F.split(F.col("s")[1], r"\|"), F.col("intent"))).alias("agree"))


MARKS = "marks AS (SELECT *, CASE WHEN id % 9 = 0 THEN 'low' ELSE 'high' END AS confidence, CASE WHEN id % 14 = 0 THEN 'y' ELSE '' END AS cannot, CASE WHEN id % 4 = 0 THEN 'note' ELSE '' END AS notes FROM gold)"


def marks(spark, sf_dir):
    i = F.col("id")
    return gold(spark, sf_dir).withColumns({"confidence": F.when(i % 9 == 0, "low").otherwise("high"), "cannot": F.when(i % 14 == 0, "y").otherwise(""), "notes": F.when(i % 4 == 0, "note").otherwise("")})


@query(with_ctes(f""", {MARKS} SELECT 'low_confidence' AS entry, id FROM marks WHERE confidence = 'low' UNION ALL SELECT 'cannot_represent', id FROM marks WHERE cannot = 'y'
    UNION ALL SELECT 'incoherent', id FROM marks WHERE escalation = 'AUTO_OK' AND intent = 'abuse' UNION ALL SELECT 'noted', id FROM marks WHERE notes <> ''""", "gold"))
def ambiguity_register(spark, sf_dir):
    when = {"low_confidence": F.col("confidence") == "low", "cannot_represent": F.col("cannot") == "y", "incoherent": (F.col("escalation") == "AUTO_OK") & (F.col("intent") == "abuse"), "noted": F.col("notes") != ""}
    return marks(spark, sf_dir).select(ev.subsets(when).alias("entry"), "id")


@query(with_ctes(f""", {MARKS} SELECT id, 'intent_domain' AS error FROM marks WHERE intent NOT IN ('abuse', 'complaint', 'question') UNION ALL SELECT id, 'reason_missing' FROM marks WHERE escalation = 'ESCALATE' AND reason = ''
    UNION ALL SELECT id, 'reason_stray' FROM marks WHERE escalation = 'AUTO_OK' AND reason <> '' UNION ALL SELECT id, 'needs_note' FROM marks WHERE cannot = 'y' AND notes = ''""", "gold"))
def schema_validation(spark, sf_dir):
    """One row for each broken rule of a row: domains and rules across fields."""
    esc = F.col("escalation") == "ESCALATE"
    rules = {"intent_domain": ~F.col("intent").isin("abuse", "complaint", "question"), "reason_missing": esc & (F.col("reason") == ""), "reason_stray": ~esc & (F.col("reason") != ""), "needs_note": (F.col("cannot") == "y") & (F.col("notes") == "")}
    return marks(spark, sf_dir).select("id", ev.subsets(rules).alias("error"))


#: A codebook of the stored labels, in the form of ``operators.codebook``.
CODEBOOK = {
    "version": "1",
    "intents": [
        {"name": "abuse", "definition": "insults or threats", "escalation_role": "independent", "confusable_with": ["complaint"]}, {"name": "complaint", "definition": "something went wrong", "escalation_role": "dependent", "confusable_with": ["abuse", "question"]},
        {"name": "question", "definition": "asks for something", "escalation_role": "none", "confusable_with": []}, {"name": "other", "definition": "none of these", "escalation_role": "none", "confusable_with": None},
    ],
    "boundary_rules": [{"id": "R1", "test": "a threat is abuse whatever else it is"}, {"id": "R2", "test": "a complaint that asks is a complaint"}],
    "fields": [
        {"name": "intent", "values": ["abuse", "complaint", "question", "other"]}, {"name": "conversation_state", "values": ["opener", "followup", "unclear"]}, {"name": "urgency", "values": ["low", "normal", "high"]},
        {"name": "frustration", "values": ["low", "normal", "high"]}, {"name": "language", "values": ["en", "de", "fr", "es"]}, {"name": "escalation", "values": ["ESCALATE", "AUTO_OK"]},
        {"name": "escalation_reason", "values": ["none", "safety_abuse", "high_frustration", "ambiguous"], "blank_if": {"field": "escalation", "value": "AUTO_OK"}}, {"name": "confidence", "values": ["low", "medium", "high"]},
    ],
    "cross_rules": [
        {"id": "auto_has_no_reason", "field": "escalation", "value": "AUTO_OK", "other": "escalation_reason", "allowed": ["none", ""]}, {"id": "escalation_has_reason", "field": "escalation", "value": "ESCALATE", "other": "escalation_reason", "refused": ["none"]},
    ],
}
#: Annotations of all labelled documents, some of them faulty, in plain SQL of both engines.
_ANNOTATED = {
    "intent": "CASE WHEN id % 29 = 0 THEN '' WHEN id % 31 = 1 THEN 'praise' ELSE intent END", "conversation_state": "CASE WHEN id % 29 = 0 THEN '' WHEN id % 3 = 0 THEN 'followup' ELSE 'opener' END", "urgency": "CASE WHEN id % 29 = 0 OR id % 23 = 2 THEN ' ' ELSE 'low' END",
    "frustration": "CASE WHEN id % 29 = 0 THEN '' WHEN reason = 'high_frustration' THEN ' high ' ELSE 'normal' END", "language": "CASE WHEN id % 29 = 0 THEN '' ELSE coalesce(lang, '') END", "escalation": "CASE WHEN id % 29 = 0 THEN '' ELSE escalation END",
    "escalation_reason": "CASE WHEN id % 29 = 0 THEN '' WHEN id % 13 = 3 THEN 'none' WHEN id % 17 = 4 THEN 'ambiguous' ELSE reason END", "confidence": "CASE WHEN id % 29 = 0 THEN '' WHEN id % 19 = 5 THEN 'sure' ELSE 'high' END",
}


def _codebook(spark):
    return codebook.parsed(spark.createDataFrame([(json.dumps(CODEBOOK),)], "json string"))


def _sql_violations() -> str:
    """The same checks, written out from the codebook."""
    listed = lambda values: "(" + ", ".join(f"'{v}'" for v in values) + ")"
    out = []
    for f in CODEBOOK["fields"]:
        spared = f" AND trim({f['blank_if']['field']}) <> '{f['blank_if']['value']}'" if "blank_if" in f else ""
        out += [("empty", f["name"], f"trim({f['name']}) = ''{spared}"), ("domain", f["name"], f"trim({f['name']}) <> '' AND trim({f['name']}) NOT IN {listed(f['values'])}")]
    for r in CODEBOOK["cross_rules"]:
        test = f"NOT IN {listed(r['allowed'])}" if "allowed" in r else f"IN {listed(r['refused'])}"
        out.append((r["id"], r["other"], f"trim({r['field']}) = '{r['value']}' AND trim({r['other']}) {test}"))
    return " UNION ALL ".join(f"SELECT id, '{name}' AS field, '{error}' AS error FROM annotated WHERE {wrong}" for error, name, wrong in out)


@query(with_ctes(f""", annotated AS (SELECT id, {', '.join(f'{x} AS a_{name}' for name, x in _ANNOTATED.items())} FROM gold JOIN (SELECT doc_id AS id, lang FROM documents) USING (id)),
    filled AS (SELECT * FROM annotated WHERE {' OR '.join(f"trim(a_{name}) <> ''" for name in _ANNOTATED)}) {_sql_violations().replace('FROM annotated', 'FROM (SELECT id, ' + ', '.join(f'a_{name} AS {name}' for name in _ANNOTATED) + ' FROM filled)')}""", "gold"))
def codebook_violations(spark, sf_dir):
    """Everything that is wrong with the annotations, by rules that the codebook states: emptiness and domain of eight fields, two cross rules."""
    g = gold(spark, sf_dir).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang"), "id")
    return codebook.violations(g.select("id", *(F.expr(x).alias(name) for name, x in _ANNOTATED.items())), _codebook(spark), "id")


@query(with_ctes(", m AS (SELECT id, intent, CASE intent " + " ".join(f"WHEN '{i['name']}' THEN '{i['escalation_role']}'" for i in CODEBOOK["intents"]) + " END AS role FROM gold) SELECT id, intent, role, CASE WHEN role = 'independent' THEN 'ESCALATE' ELSE 'AUTO_OK' END AS decision FROM m", "gold"))
def codebook_roles(spark, sf_dir):
    """Decisions by the role that the codebook gives the intent."""
    rows = gold(spark, sf_dir).select("id", F.col("intent").alias("pred"))
    return lookup_policy(rows, codebook.roles(_codebook(spark)), "other").select("id", F.col("pred").alias("intent"), "role", "decision")


_LEDGER = "ledger AS (SELECT 'mock:' || event_type AS model, event_id % 4 = 0 AS cached, CAST(coalesce(props ->> 'k', '0') AS BIGINT) AS tokens_in, event_id % 50 AS tokens_out FROM events)"


def _ledger(spark, sf_dir):
    k = F.coalesce(F.get_json_object("props", "$.k"), F.lit("0")).cast("long")
    return table(spark, sf_dir, "events").select(F.concat(F.lit("mock:"), "event_type").alias("model"), (F.col("event_id") % 4 == 0).alias("cached"), k.alias("tokens_in"), (F.col("event_id") % 50).alias("tokens_out"))


@query(f"WITH {_LEDGER} SELECT model, count(*) AS calls, count(*) FILTER (WHERE cached) AS cached, CAST(coalesce(sum(tokens_in) FILTER (WHERE NOT cached), 0) AS BIGINT) AS tokens_in, CAST(coalesce(sum(tokens_out) FILTER (WHERE NOT cached), 0) AS BIGINT) AS tokens_out FROM ledger GROUP BY model")
def usage_summary(spark, sf_dir):
    """Cached calls count as calls and add no tokens."""
    fresh = lambda c: F.coalesce(F.sum(F.when(~F.col("cached"), F.col(c))), F.lit(0))
    return _ledger(spark, sf_dir).groupBy("model").agg(F.count("*").alias("calls"), F.count_if("cached").alias("cached"), fresh("tokens_in").alias("tokens_in"), fresh("tokens_out").alias("tokens_out"))


@query(f"""WITH {_LEDGER} SELECT model, round(sum(tokens_in * coalesce(p_in, 0) + tokens_out * coalesce(p_out, 0)) / 1e6, 9) AS usd FROM ledger LEFT JOIN (VALUES ('mock:click', 1.0::DOUBLE, 5.0::DOUBLE), ('mock:view', 0.25::DOUBLE, 1.25::DOUBLE)) p(model, p_in, p_out) USING (model)
    WHERE NOT cached GROUP BY model""")
def usage_cost(spark, sf_dir):
    """Tokens times price; a model without a price costs nothing."""
    prices = spark.createDataFrame([("mock:click", 1.0, 5.0), ("mock:view", 0.25, 1.25)], "model string, p_in double, p_out double")
    zero = F.lit(0.0)
    cost = F.col("tokens_in") * F.coalesce("p_in", zero) + F.col("tokens_out") * F.coalesce("p_out", zero)
    return _ledger(spark, sf_dir).where("not cached").join(F.broadcast(prices), "model", "left").groupBy("model").agg(F.round(F.sum(cost) / 1e6, 9).alias("usd"))  # one row a model
