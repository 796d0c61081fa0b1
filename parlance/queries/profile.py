"""Profiles of threads, replies, openers and splits."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import stats, text as t
from ..lexicon import FAMILIES, MUST_FAMILIES, PII
from ..plans.brand import brand_profiles
from ..registry import query
from ..sources.bindings import documents, with_ctes
from ..sources.tables import table
from .text import sql_has
from .threads import frame, pairs

_DM = "with|dm|direct message"
SQL_DM = sql_has("reply", _DM)


def _rate(sql: str) -> str:
    return f"round(100 * avg(CAST({sql} AS DOUBLE)), 2)"


@query(with_ctes("SELECT author, count(*) AS n FROM messages WHERE NOT inbound GROUP BY author ORDER BY n DESC, author LIMIT 10", "messages"))
def top_authors(spark, sf_dir):
    from ..sources.bindings import messages

    return messages(spark, sf_dir).where("not inbound").groupBy("author").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "author").limit(10)


@query(with_ctes("""SELECT count(*) AS threads, median(n) AS median_size, round(avg(n), 4) AS mean_size, round(quantile_cont(n, 0.9), 6) AS p90_size, """ + _rate("n = 2") + """ AS pairs_pct,
    """ + _rate("root_in") + """ AS root_is_customer, round(100 * avg(CAST(inbound_n > 1 AS DOUBLE)) FILTER (WHERE inbound_n >= 1), 2) AS follow_up_pct
    FROM (SELECT thread, CAST(count(*) AS DOUBLE) AS n, bool_or(is_root AND inbound) AS root_in, count(*) FILTER (WHERE inbound) AS inbound_n FROM threads GROUP BY thread)""", "threads"))
def thread_structure(spark, sf_dir):
    per = frame(spark, sf_dir).groupBy("thread").agg(F.count("*").cast("double").alias("n"), F.bool_or(F.col("is_root") & F.col("inbound")).alias("root_in"), F.count_if("inbound").alias("inbound_n"))
    return per.agg(
        F.count("*").alias("threads"), F.median("n").alias("median_size"), F.round(F.avg("n"), 4).alias("mean_size"), F.round(F.percentile("n", 0.9), 6).alias("p90_size"), stats.rate(F.col("n") == 2).alias("pairs_pct"),
        stats.rate(F.col("root_in")).alias("root_is_customer"), F.round(100 * F.avg(F.when(F.col("inbound_n") >= 1, (F.col("inbound_n") > 1).cast("double"))), 2).alias("follow_up_pct"))


@query(r"""SELECT source, round(1 - count(DISTINCT lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) / count(*), 6) AS masked, round(1 - count(DISTINCT text) / count(*), 6) AS exact FROM documents GROUP BY source""")
def dup_rate(spark, sf_dir):
    """Shares of repeated texts under two normalisations, by digests rather than whole texts."""
    d = documents(spark, sf_dir).select("source", F.md5(t.masked(F.col("text"))).alias("m"), F.md5("text").alias("e"))
    return d.groupBy("source").agg(F.round(1 - F.count_distinct("m") / F.count("*"), 6).alias("masked"), F.round(1 - F.count_distinct("e") / F.count("*"), 6).alias("exact"))


@query("""WITH n AS (SELECT source, md5(text) AS tpl, count(*) AS n FROM documents GROUP BY source, text), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, tpl) AS r FROM n)
          SELECT source, count(*) AS templates, round(sum(n) FILTER (WHERE r <= 10) / sum(n), 6) AS top10, round(sum(n) FILTER (WHERE r <= 3) / sum(n), 6) AS top3 FROM r GROUP BY source""")
def reply_templates(spark, sf_dir):
    n = documents(spark, sf_dir).groupBy("source", F.md5("text").alias("tpl")).agg(F.count("*").alias("n"))
    r = n.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "tpl")))
    top = lambda k: F.round(F.sum(F.when(F.col("r") <= k, F.col("n"))) / F.sum("n"), 6)
    return r.groupBy("source").agg(F.count("*").alias("templates"), top(10).alias("top10"), top(3).alias("top3"))


@query(with_ctes(f"SELECT count(*) AS n, {_rate(SQL_DM)} AS private_pct, {_rate('contains(reply, chr(10))')} AS multiline_pct FROM replies", "replies"))
def first_action(spark, sf_dir):
    from ..operators.threads import first_replies

    r = first_replies(frame(spark, sf_dir))
    return r.agg(F.count("*").alias("n"), stats.rate(t.has(F.col("reply"), _DM)).alias("private_pct"), stats.rate(F.contains("reply", F.lit("\n"))).alias("multiline_pct"))


@query(with_ctes("SELECT count(m) AS n, median(m) AS median_min, round(quantile_cont(m, 0.9), 6) AS p90_min FROM (SELECT epoch(reply_at - created_at) / 60.0 AS m FROM pairs WHERE reply_at IS NOT NULL)", "pairs"))
def latency(spark, sf_dir):
    p = pairs(spark, sf_dir).where("reply_at is not null").select((F.timestamp_diff("SECOND", F.col("created_at"), F.col("reply_at")) / 60.0).alias("m"))
    return p.agg(F.count("m").alias("n"), F.median("m").alias("median_min"), F.round(F.percentile("m", 0.9), 6).alias("p90_min"))


@query(with_ctes(f"""SELECT count(*) AS n, median(CAST(length(text) AS DOUBLE)) AS median_chars, {_rate("regexp_matches(text, 'https?://[^ ]+')")} AS link_pct, {_rate('k > 1')} AS repeat_pct, {_rate('reply IS NOT NULL')} AS replied_pct
    FROM (SELECT *, count(*) OVER (PARTITION BY author) AS k FROM pairs)""", "pairs"))
def opener_metrics(spark, sf_dir):
    p = pairs(spark, sf_dir)
    p = p.join(p.groupBy("author").agg(F.count("*").alias("k")), "author")
    return p.agg(
        F.count("*").alias("n"), F.median(F.length("text").cast("double")).alias("median_chars"), stats.rate(F.col("text").rlike("https?://[^ ]+")).alias("link_pct"),
        stats.rate(F.col("k") > 1).alias("repeat_pct"), stats.rate(F.col("reply").isNotNull()).alias("replied_pct"))


@query(with_ctes(f"SELECT split, count(*) AS n, count(reply) AS replied, {_rate(SQL_DM)} AS private_pct FROM pairs GROUP BY split", "pairs"))
def split_drift(spark, sf_dir):
    return pairs(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n"), F.count("reply").alias("replied"), stats.rate(t.has(F.col("reply"), _DM)).alias("private_pct"))


def sql_wilson(k: str, n: str) -> tuple[str, str]:
    z, p = "1.959963985::DOUBLE", f"({k} / {n}::DOUBLE)"
    centre, spread = f"{p} + {z} * {z} / (2 * {n})", f"{z} * sqrt({p} * (1 - {p}) / {n} + {z} * {z} / (4.0::DOUBLE * {n} * {n}))"
    low, high = f"(({centre}) - {spread}) / (1 + {z} * {z} / {n})", f"(({centre}) + {spread}) / (1 + {z} * {z} / {n})"
    return f"CASE WHEN {n} = 0 THEN 0.0 ELSE round(greatest(0.0, {low}), 6) END", f"CASE WHEN {n} = 0 THEN 0.0 ELSE round(least(1.0, {high}), 6) END"


_ANY = " OR ".join(sql_has("text", FAMILIES[k]) for k in MUST_FAMILIES)


@query(f"""WITH m AS (SELECT {_rate(_ANY)} AS any_pct, avg(CAST({_ANY} AS DOUBLE)) AS p FROM documents)
    SELECT size, any_pct, CAST(round(p * size) AS BIGINT) AS n_must, {sql_wilson('(0.9 * round(p * size))', 'round(p * size)')[0]} AS low, {sql_wilson('(0.9 * round(p * size))', 'round(p * size)')[1]} AS high FROM m CROSS JOIN (VALUES (160), (200)) s(size)""")
def must_power(spark, sf_dir):
    """Expected rows of the families that must escalate in samples of two sizes, and the interval around a 90% rate on them."""
    flag = F.lit(False)
    for k in MUST_FAMILIES:
        flag = flag | t.has(F.col("text"), FAMILIES[k])
    m = documents(spark, sf_dir).agg(stats.rate(flag).alias("any_pct"), F.avg(flag.cast("double")).alias("p"))
    m = m.withColumn("size", F.explode(F.array(F.lit(160), F.lit(200))))
    n = F.round(F.col("p") * F.col("size"))
    low, high = stats.wilson(0.9 * n, n)
    return m.select("size", "any_pct", n.cast("long").alias("n_must"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("SELECT family, n, pct FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS family, count(*) FILTER (WHERE {sql_has('text', p)}) AS n, {_rate(sql_has('text', p))} AS pct FROM documents" for n, p in FAMILIES.items()) + ")")
def topic_prevalence(spark, sf_dir):
    """One pass gives all families; the row is then turned into rows."""
    flags = t.matches(F.col("text"), FAMILIES)
    one = documents(spark, sf_dir).agg(*(F.struct(F.count_if(c).alias("n"), stats.rate(c).alias("pct")).alias(n) for n, c in flags.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("family"), F.col(f"{n}.n").alias("n"), F.col(f"{n}.pct").alias("pct")) for n in flags))).alias("x")).select("x.*")


@query(f"""SELECT source, count(*) AS n, median(n_chars::DOUBLE) AS median_chars, round(quantile_cont(n_chars::DOUBLE, 0.9), 6) AS p90_chars, {_rate(f"regexp_matches(text, '{PII}')")} AS pii_pct,
    round(1 - count(DISTINCT md5(text)) / count(*), 6) AS dup_rate, {_rate("lang = 'en'")} AS english_pct FROM documents GROUP BY source""")
def brand_profile(spark, sf_dir):
    return brand_profiles(documents(spark, sf_dir), "source")


@query(f"""SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 100000) AS k, count(*) AS n, {sql_wilson('count(*) FILTER (WHERE o_totalprice > 100000)', 'count(*)')[0]} AS low,
    {sql_wilson('count(*) FILTER (WHERE o_totalprice > 100000)', 'count(*)')[1]} AS high FROM orders GROUP BY o_orderstatus""")
def wilson_ci(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count_if(F.col("o_totalprice") > 100000).alias("k"), F.count("*").alias("n"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return o.select("o_orderstatus", "k", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))
