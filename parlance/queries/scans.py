"""Scans, lookups, caches and keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from ..sources.bindings import documents, messages, with_ctes
from ..sources.tables import fingerprint, parsed_time, table


@query(with_ctes("SELECT id, coalesce(parent, -1) AS parent, inbound, author = 'b1' AS by_brand FROM messages", "messages"))
def scan_structure(spark, sf_dir):
    return messages(spark, sf_dir).select("id", F.coalesce("parent", F.lit(-1).cast("long")).alias("parent"), "inbound", (F.col("author") == "b1").alias("by_brand"))


@query(with_ctes("SELECT id, created_at, text FROM messages WHERE id IN (SELECT parent FROM messages WHERE author = 'b1')", "messages"))
def late_materialise(spark, sf_dir):
    """The narrow scan finds the ids; only then are the texts of those read."""
    m = messages(spark, sf_dir)
    wanted = m.where("author = 'b1' and parent is not null").select(F.col("parent").alias("id")).distinct()
    return m.select("id", "created_at", "text").join(wanted, "id", "left_semi")


@query("""SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN date_trunc('second', ts) END AS parsed FROM events""")
def parse_ts(spark, sf_dir):
    raw = F.when(F.col("event_id") % 11 == 0, F.lit("no date")).otherwise(F.concat(F.date_format("ts", "EEE MMM dd HH:mm:ss"), F.lit(" +0000 "), F.date_format("ts", "yyyy")))
    return table(spark, sf_dir, "events").select("event_id", parsed_time(raw).alias("parsed"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'null' WHEN doc_id % 3 = 1 THEN '' ELSE text END AS text
          FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)""")
def raw_lookup(spark, sf_dir):
    """Texts such as 'null' and the empty text come through as they are."""
    d = documents(spark, sf_dir).withColumn("text", F.when(F.col("doc_id") % 3 == 0, "null").when(F.col("doc_id") % 3 == 1, "").otherwise(F.col("text")))
    return d.select("doc_id", "text").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")


@query(with_ctes("""SELECT id, stratum, CASE WHEN stratum = 'core' THEN 'core' ELSE 'targeted' END AS subset, split_part(stratum, ':', 1) AS family FROM gold""", "gold"))
def stratum_family(spark, sf_dir):
    from ..sources.bindings import gold

    g = gold(spark, sf_dir)
    return g.select("id", "stratum", F.when(F.col("stratum") == "core", "core").otherwise("targeted").alias("subset"), F.split("stratum", ":")[0].alias("family"))


@query("""SELECT event_id, k AS name, CAST(props ->> k AS VARCHAR) AS value FROM events, unnest(json_keys(props)) u(k)""")
def json_explode(spark, sf_dir):
    parsed = F.from_json("props", "map<string,string>")
    return table(spark, sf_dir, "events").select("event_id", F.explode(parsed).alias("name", "value"))


@query("""SELECT doc_id, md5(text) AS canonical, md5(CASE WHEN doc_id % 13 = 0 THEN text || '!' ELSE text END) AS found
          FROM documents WHERE doc_id % 13 = 0""")
def text_drift(spark, sf_dir):
    """Rows whose text differs between two copies, or that one copy lacks."""
    a = documents(spark, sf_dir).select("doc_id", F.md5("text").alias("canonical"))
    b = documents(spark, sf_dir).select("doc_id", F.md5(F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("found"))
    return a.join(b, "doc_id", "full_outer").where(~F.col("canonical").eqNullSafe(F.col("found")))


_KEY = "substr(sha256('mock' || chr(31) || 'm1' || chr(31) || 'prompt' || chr(31) || '{}' || chr(31) || text), 1, 32)"


def cache_key_of(provider, model, prompt, params, message):
    """The content address of a response: 32 hex digits."""
    return F.substring(F.sha2(F.concat_ws("\x1f", provider, model, prompt, params, message), 256), 1, 32)


def _keyed(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", cache_key_of(F.lit("mock"), F.lit("m1"), F.lit("prompt"), F.lit("{}"), F.col("text")).alias("cache_key"))


@query(f"SELECT doc_id, {_KEY} AS cache_key FROM documents")
def cache_key(spark, sf_dir):
    return _keyed(spark, sf_dir)


@query(f"""WITH k AS (SELECT doc_id, {_KEY} AS key FROM documents), held AS (SELECT DISTINCT key FROM k WHERE doc_id % 4 = 0)
           SELECT count(*) AS calls, count(*) FILTER (WHERE held.key IS NOT NULL) AS hits, count(DISTINCT k.key) FILTER (WHERE held.key IS NULL) AS to_fetch
           FROM k LEFT JOIN held USING (key)""")
def cache_hit_miss(spark, sf_dir):
    """A read-through cache: calls, hits, and distinct keys that must be fetched."""
    k = _keyed(spark, sf_dir)
    held = k.where("doc_id % 4 = 0").select("cache_key").distinct().withColumn("held", F.lit(True))
    return k.join(held, "cache_key", "left").agg(
        F.count("*").alias("calls"), F.count("held").alias("hits"), F.count_distinct(F.when(F.col("held").isNull(), F.col("cache_key"))).alias("to_fetch"))


@query()
def source_fingerprint(spark, sf_dir):
    """Only the size is stable between places, so there is no SQL for it."""
    return fingerprint(documents(spark, sf_dir)).groupBy().agg(F.count("*").alias("files"), F.sum("file_size").alias("bytes"))


@query("""SELECT doc_id, regexp_matches(text, 'sk-[A-Za-z0-9]{16,}|AKIA[0-9A-Z]{16}|token = [^ ]+') AS has_secret FROM documents""")
def secret_scan(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.col("text").rlike(r"sk-[A-Za-z0-9]{16,}|AKIA[0-9A-Z]{16}|token = [^ ]+").alias("has_secret"))
