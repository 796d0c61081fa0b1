"""Normalisation, shingles, flags and guardrails over texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..lexicon import FAMILIES, PII
from ..operators import replies as rp
from ..registry import query
from ..sources.bindings import documents, messages, with_ctes
from ..sources.tables import table


def sql_has(column: str, pattern: str) -> str:
    return f"regexp_matches(lower({column}), '{t.bounded(pattern).replace(chr(39), chr(39) * 2)}')"


_MASKED = r"""lower(trim(regexp_replace(regexp_replace(regexp_replace(text, 'https?://[^\s]+', '<URL>', 'g'), '@[\p{L}\p{N}_]+', '<USER>', 'g'), '\s+', ' ', 'g')))"""
_STRIPPED = r"""lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, 'https?://[^\s]+', ' ', 'g'), '@[\p{L}\p{N}_]+', ' ', 'g'),
    '^\s+|\s+$', '', 'g'), '([\^~*\-/]\s?[A-Za-z]{1,3}|-\s?[A-Z][a-z]{2,10})\s*$', ''), '\s+', ' ', 'g')))"""


@query(f"SELECT doc_id, md5({_MASKED}) AS norm FROM documents")
def norm_masked(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.md5(t.masked(F.col("text"))).alias("norm"))


@query(f"SELECT doc_id, md5({_STRIPPED}) AS norm FROM documents")
def norm_stripped(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.md5(t.stripped(F.col("text"))).alias("norm"))


@query(r"""SELECT count(*) AS n, round(100 * avg(CAST(regexp_matches(text, '([\^~*\-/]\s?[A-Za-z]{1,3}|-\s?[A-Z][a-z]{2,10})\s*$') AS INT)), 2) AS signed,
    round(100 * avg(CAST(regexp_matches(text, 'https?://[^\s]+') AS INT)), 2) AS linked, round(100 * avg(CAST(""" + sql_has("text", t.PRIVATE + "|with") + r""" AS INT)), 2) AS private FROM conversations WHERE role = 'assistant'""")
def reply_character(spark, sf_dir):
    """Shares of replies with a sign-off, a link and a private-channel word (here also 'with')."""
    from ..functions.stats import rate

    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return c.agg(F.count("*").alias("n"), rate(F.col("text").rlike(t.SIGN_OFF)).alias("signed"), rate(F.col("text").rlike(t.URL)).alias("linked"), rate(t.has(F.col("text"), t.PRIVATE + "|with")).alias("private"))


SHINGLE_CTE = r"""toks AS (SELECT id, CASE WHEN s = '' THEN [] ELSE string_split(s, ' ') END AS tk FROM (SELECT id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM src)),
    sh AS (SELECT DISTINCT id, CASE WHEN len(tk) < 3 THEN array_to_string(tk, ' ') ELSE array_to_string(tk[i:i+2], ' ') END AS g
           FROM toks, unnest(range(1, CASE WHEN len(tk) = 0 THEN 1 ELSE greatest(len(tk) - 1, 2) END)) r(i))"""


@query(f"WITH src AS (SELECT doc_id AS id, text FROM documents), {SHINGLE_CTE} SELECT id AS doc_id, count(*) AS n, md5(string_agg(md5(g), '' ORDER BY md5(g))) AS digest FROM sh GROUP BY id")
def shingles(spark, sf_dir):
    """The distinct shingles of each row, made and counted within the row."""
    sets = documents(spark, sf_dir).select("doc_id", t.shingle_set(F.col("text")).alias("s")).where("size(s) > 0")
    return sets.select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join(F.array_sort(F.transform("s", F.md5)), "")).alias("digest"))


@query("SELECT doc_id, len(list_filter(string_split(regexp_replace(trim(text), '\\s+', ' ', 'g'), ' '), lambda x: x <> '')) AS n_tokens, len(list_filter(string_split(regexp_replace(trim(text), '\\s+', ' ', 'g'), ' '), lambda x: x <> '')) <= 6 AS is_short FROM documents")
def short_text(spark, sf_dir):
    n = F.size(t.tokens(F.col("text"))).cast("long")
    return documents(spark, sf_dir).select("doc_id", n.alias("n_tokens"), (n <= 6).alias("is_short"))


@query("SELECT doc_id, " + ", ".join(f"{sql_has('text', p)} AS {n}" for n, p in FAMILIES.items()) + " FROM documents")
def topic_flags(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", *(c.alias(n) for n, c in t.matches(F.col("text"), FAMILIES).items()))


@query("SELECT doc_id, CAST(" + " + ".join(f"CAST({sql_has('text', p)} AS INT)" for p in FAMILIES.values()) + " AS BIGINT) AS n_families FROM documents")
def n_families(spark, sf_dir):
    total = sum((c.cast("long") for c in t.matches(F.col("text"), FAMILIES).values()), F.lit(0).cast("long"))
    return documents(spark, sf_dir).select("doc_id", total.alias("n_families"))


PAIRED = """SELECT a.id, a.text AS customer, CASE WHEN a.id % 3 = 0 THEN 'You wrote: ' || a.text ELSE b.text END AS reply FROM messages a JOIN messages b ON b.parent = a.id"""


def paired(spark, sf_dir):
    """A message and an answer to it; every third answer quotes it."""
    m = messages(spark, sf_dir)
    answers = m.select(F.col("parent").alias("id"), F.col("text").alias("answer"))
    return m.select("id", "text").join(answers, "id").select("id", F.col("text").alias("customer"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("You wrote: "), "text")).otherwise(F.col("answer")).alias("reply"))


SQL_ECHO = r"""(len(list_filter(range(1, len(tk) - 4), lambda i: contains(lower(reply), array_to_string(tk[i:i+5], ' ')))) > 0)"""
SQL_TK = r"""string_split(trim(regexp_replace(lower(customer), '\s+', ' ', 'g')), ' ') AS tk"""


@query(with_ctes(f"SELECT id, {SQL_ECHO} AS echoed FROM (SELECT *, {SQL_TK} FROM ({PAIRED}))", "messages"))
def echo_check(spark, sf_dir):
    return paired(spark, sf_dir).select("id", t.echoes(F.col("reply"), F.col("customer")).alias("echoed"))


SQL_GUARDS = {
    "no_url": "NOT regexp_matches(lower(reply), 'https?://|www\\.')",
    "no_long_digit_run": "NOT regexp_matches(reply, '[0-9]{7,}')",
    "no_unfilled_placeholder": "NOT regexp_matches(reply, '[{<]\\s*[\\p{L}\\p{N}_]+\\s*[}>]')",
    "within_length_cap": "length(reply) <= 280",
    "no_outcome_promise": "NOT (" + " OR ".join(f"contains(lower(reply), '{b.replace(chr(39), chr(39) * 2)}')" for b in rp.BANNED) + ")",
    "non_empty": "regexp_matches(reply, '[^\\s]')",
}
SQL_PRIVATE = sql_has("reply", "dms?|direct message|privately|private")


@query(with_ctes("SELECT id, " + ", ".join(f"{v} AS {k}" for k, v in SQL_GUARDS.items()) + f", {SQL_PRIVATE} AS routes_to_private_channel, NOT {SQL_ECHO} AS no_customer_text_echoed FROM (SELECT *, {SQL_TK} FROM ({PAIRED}))", "messages"))
def guardrails(spark, sf_dir):
    return paired(spark, sf_dir).select("id", *(c.alias(n) for n, c in rp.guardrails(F.col("reply"), F.col("customer")).items()))


SQL_INVENTED = r"""regexp_matches(regexp_replace(reply, '@[0-9]+($|[^\p{L}\p{N}_])', ' \1', 'g'), '[$£€]\s?[0-9]|(^|[^\p{L}\p{N}_])[0-9]{4,}($|[^\p{L}\p{N}_])|(?i:(^|[^\p{L}\p{N}_])(order|ref|reference)\s*#?[0-9])')"""


@query(with_ctes("SELECT id, " + ", ".join(f"{v} AS {k}" for k, v in SQL_GUARDS.items()) + f", NOT {SQL_ECHO} AS no_customer_text_echoed, NOT {SQL_INVENTED} AS no_invented_number FROM (SELECT *, {SQL_TK} FROM ({PAIRED}))", "messages"))
def draft_guardrails(spark, sf_dir):
    return paired(spark, sf_dir).select("id", *(c.alias(n) for n, c in rp.draft_guardrails(F.col("reply"), F.col("customer")).items()))


@query(f"SELECT doc_id, regexp_matches(text, '{PII}') AS has_pii, CAST(len(regexp_extract_all(text, '{PII}')) AS BIGINT) AS n_pii FROM documents")
def pii_flags(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.col("text").rlike(PII).alias("has_pii"), F.regexp_count("text", F.lit(PII)).cast("long").alias("n_pii"))


@query("""SELECT doc_id, d AS defect, md5(CASE d WHEN 'wrong_intent' THEN other WHEN 'fabricated_fact' THEN text || ' The sum of 83.10 went back to your card last Tuesday.'
            WHEN 'missing_escalation' THEN 'All good, nothing more is needed from you.' ELSE 'You should have read the manual first. ' || text END) AS reply
          FROM (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS other FROM documents)
          CROSS JOIN (VALUES ('wrong_intent'), ('fabricated_fact'), ('missing_escalation'), ('hostile_tone')) k(d)""")
def corruption_probes(spark, sf_dir):
    """Four planted defects of each text; 'wrong_intent' takes the text of the next id."""
    d = documents(spark, sf_dir).select("doc_id", "text")
    return rp.corrupted(d, "doc_id", "text").select("doc_id", "defect", F.md5("reply").alias("reply"))


@query("SELECT doc_id, CAST(('0x' || substr(sha256(text), 1, 8)) AS BIGINT) % 8 AS intent FROM documents")
def mock_intent(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", rp.mock_choice(F.col("text"), 8).alias("intent"))


@query("""SELECT source, 'Label:' || chr(10) || string_agg('- ' || lang || ': ' || n, chr(10) ORDER BY lang) AS prompt
          FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang) GROUP BY source""")
def prompt_build(spark, sf_dir):
    n = documents(spark, sf_dir).groupBy("source", "lang").count()
    line = F.concat(F.lit("- "), "lang", F.lit(": "), F.col("count").cast("string"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("lang", line.alias("line")))), lambda x: x.line)
    return n.groupBy("source").agg(F.concat(F.lit("Label:\n"), F.array_join(lines, "\n")).alias("prompt"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE CAST(1 + event_id % 5 AS BIGINT) END AS tone, event_id % 3 <> 0 AS parsed, event_id % 3 <> 0 AND event_id % 2 = 0 AS acceptable FROM events""")
def judge_parse(spark, sf_dir):
    """Verdicts as a judge writes them: fenced, with prose, and every third one out of range, mistyped or cut."""
    e = table(spark, sf_dir, "events").select("event_id")
    n = (F.col("event_id") % 5 + 1).cast("string")
    good = F.concat(F.lit('{"addresses_need": 3, "grounded": 3, "routing": 3, "tone": '), n, F.lit(', "acceptable": '), F.when(F.col("event_id") % 2 == 0, "true").otherwise("false"), F.lit("}"))
    bad = F.when(F.col("event_id") % 9 == 0, F.regexp_replace(good, '"tone": [0-9]', '"tone": 9')).when(F.col("event_id") % 9 == 3, F.regexp_replace(good, "true|false", '"yes"')).otherwise(F.substring(good, 1, 40))
    said = F.when(F.col("event_id") % 3 == 0, bad).when(F.col("event_id") % 3 == 1, F.concat(F.lit("```json\n"), good, F.lit("\n```"))).otherwise(F.concat(F.lit("Here: "), good))
    v = rp.verdict(said)
    return e.select("event_id", F.coalesce(v["tone"], F.lit(-1).cast("long")).alias("tone"), v["acceptable"].isNotNull().alias("parsed"), F.coalesce(v["acceptable"], F.lit(False)).alias("acceptable"))
