"""TF-IDF, guarded search, clusters."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as t
from ..functions.stats import rate
from ..lexicon import FAMILIES
from ..operators import clusters, factors, retrieval as op, search
from ..registry import query
from ..sources.bindings import documents, with_ctes
from ..sources.tables import stored, table
from .text import _STRIPPED, sql_has
from .threads import pairs

K = 3


def sql_terms(name: str, source: str) -> str:
    """Common table expression with (id, term, tf) of ``source`` (id, text)."""
    return f"""{name}_k AS (SELECT id, regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS tk FROM {source}),
    {name} AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(list_concat(tk, list_transform(range(1, len(tk)), lambda i: tk[i] || ' ' || tk[i + 1]))) AS term FROM {name}_k) GROUP BY id, term)"""


def sql_weights(name: str, tf: str, idf: str) -> str:
    return f"""{name}_r AS (SELECT id, term, (1 + ln(tf::DOUBLE)) * idf AS w FROM {tf} JOIN {idf} USING (term)),
    {name}_n AS (SELECT id, sqrt(sum(w * w)) AS norm FROM {name}_r GROUP BY id), {name} AS (SELECT id, term, w / norm AS w FROM {name}_r JOIN {name}_n USING (id))"""


def sql_idf(tf: str, n: str, least: int) -> str:
    return f"(SELECT term, ln((1 + {n})::DOUBLE / (1 + count(*))) + 1 AS idf FROM {tf} GROUP BY term HAVING count(*) >= {least})"


_INDEX = f"src AS (SELECT doc_id AS id, text FROM documents), {sql_terms('dt', 'src')}, idf AS {sql_idf('dt', '(SELECT count(*) FROM src)', 2)}, {sql_weights('dw', 'dt', 'idf')}"


def sql_search(queries: str, top: int, where: str = "", index: str | None = None) -> str:
    return f"""{index or _INDEX}, qs AS ({queries}), {sql_terms('qt', 'qs')}, {sql_weights('qw', 'qt', 'idf')},
    scored AS (SELECT qw.id AS q, dw.id AS id, round(sum(qw.w * dw.w), 6) AS cosine FROM qw JOIN dw USING (term) {where} GROUP BY qw.id, dw.id),
    hits AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY cosine DESC, id) AS place FROM scored QUALIFY place <= {top})"""


def _index(spark, sf_dir):
    return documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")


def _searched(spark, sf_dir):
    """The index of all documents, kept for the queries that search it."""
    return search.kept(documents(spark, sf_dir), "documents", lambda d: d.select(F.col("doc_id").alias("id"), "text"))


@query(f"WITH {_INDEX} SELECT id AS doc_id, count(*) AS terms, round(sum(w), 6) AS total, round(max(w), 6) AS top FROM dw GROUP BY id")
def tfidf_weights(spark, sf_dir):
    index = _index(spark, sf_dir)
    counted = stored(search.bags(index), "bags")
    v = search.vectors(counted, search.vocabulary(counted, counted.count(), 2))
    total = F.aggregate("raw", F.lit(0.0), lambda a, x: a + x)
    return v.select(F.col("id").alias("doc_id"), F.size("raw").cast("long").alias("terms"), F.round(total / F.col("norm"), 6).alias("total"), F.round(F.array_max("raw") / F.col("norm"), 6).alias("top"))


_BENCH = "SELECT item_id AS id, text FROM benchmark"


def sql_shingled(name: str, source: str) -> str:
    """Common table expression with (id, sh): the distinct three-word shingles of ``source`` (id, text)."""
    return f"""{name}_t AS (SELECT id, list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda x: x <> '') AS tk FROM ({source})),
    {name} AS (SELECT id, list_distinct(CASE WHEN len(tk) = 0 THEN [] WHEN len(tk) < 3 THEN [array_to_string(tk, ' ')] ELSE list_transform(range(1, len(tk) - 1), lambda i: tk[i] || ' ' || tk[i + 1] || ' ' || tk[i + 2]) END) AS sh FROM {name}_t)"""


def sql_near(a: str, b: str) -> str:
    """Whether two lists of shingles have a similarity of 0.8."""
    return f"(len(list_intersect({a}, {b})) > 0 AND len(list_intersect({a}, {b})) >= 0.8 * len(list_distinct(list_concat({a}, {b}))))"


_GUARDED = f"""{sql_search(_BENCH, 40)}, {sql_shingled('qsh', 'SELECT id, text FROM qs')}, {sql_shingled('hsh', 'SELECT doc_id AS id, text FROM documents WHERE doc_id IN (SELECT id FROM hits)')},
    g AS (SELECT h.*, CASE WHEN h.id = h.q THEN 'self' WHEN source = 'src' || (h.q % 20) THEN 'customer' WHEN h.id // 10 = h.q THEN 'thread' WHEN {sql_near('qsh.sh', 'hsh.sh')} THEN 'near_dup' ELSE '' END AS guard
      FROM hits h JOIN documents d ON d.doc_id = h.id JOIN hsh ON hsh.id = h.id JOIN qsh ON qsh.id = h.q),
    seen AS (SELECT * FROM (SELECT *, coalesce(count(*) FILTER (WHERE guard = '') OVER (PARTITION BY q ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS passed FROM g) WHERE passed < {K})"""


def _hits(spark, sf_dir):
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    hits = search.search(queries, _searched(spark, sf_dir), op.oversample(K))
    texts = hits.join(documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "source", "text"), "id").join(queries.select(F.col("id").alias("q"), F.col("text").alias("asked")), "q")
    return texts.select("q", "id", "cosine", "place", "source", op.near_duplicate(F.col("asked"), F.col("text")).alias("near"))


def _guarded(hits):
    guards = {"self": F.col("id") == F.col("q"), "customer": F.col("source") == F.concat(F.lit("src"), (F.col("q") % 20).cast("string")), "thread": F.floor(F.col("id") / 10) == F.col("q"), "near_dup": F.col("near")}
    return op.guarded(hits, guards, K)


@query(f"WITH {_GUARDED} SELECT q, id, cosine, place FROM seen WHERE guard = ''")
def guarded_topk(spark, sf_dir):
    return _guarded(_hits(spark, sf_dir)).where("guard = ''").select("q", "id", "cosine", "place")


@query(f"WITH {_GUARDED} SELECT guard, count(*) AS n FROM seen GROUP BY guard")
def guard_counts(spark, sf_dir):
    return _guarded(_hits(spark, sf_dir)).groupBy("guard").agg(F.count("*").alias("n"))


@query(f"""WITH {_GUARDED}, best AS (SELECT q, max(cosine) AS c FROM seen WHERE guard = '' GROUP BY q)
    SELECT count(*) AS answered, (SELECT count(*) FROM seen WHERE guard <> '') AS blocked, (SELECT count(*) FROM g WHERE guard <> '' AND place <= {K}) AS unguarded_leaks,
           round(min(c), 6) AS low, round(quantile_cont(c, 0.1), 6) AS p10, round(quantile_cont(c, 0.5), 6) AS p50, round(quantile_cont(c, 0.9), 6) AS p90 FROM best""")
def retrieval_audit(spark, sf_dir):
    """Blocked hits with guards, leaks without them, and the spread of the best remaining similarity."""
    hits = stored(_hits(spark, sf_dir), "hits")
    seen = _guarded(hits)
    best = seen.where("guard = ''").groupBy("q").agg(F.max("cosine").alias("c"))
    p = lambda x: F.round(F.percentile("c", x), 6)
    all_guards = op.guarded(hits.where(F.col("place") <= K), {"any": (F.col("id") == F.col("q")) | (F.col("source") == F.concat(F.lit("src"), (F.col("q") % 20).cast("string"))) | (F.floor(F.col("id") / 10) == F.col("q")) | F.col("near")}, K + 1)
    one = best.agg(F.count("*").alias("answered"), F.round(F.min("c"), 6).alias("low"), p(0.1).alias("p10"), p(0.5).alias("p50"), p(0.9).alias("p90"))
    return one.crossJoin(seen.agg(F.count_if(F.col("guard") != "").alias("blocked"))).crossJoin(all_guards.agg(F.count_if(F.col("guard") != "").alias("unguarded_leaks")))


_NEAREST = sql_search("SELECT doc_id AS id, text FROM documents WHERE doc_id % 100 = 0", 1, "WHERE qw.id <> dw.id")


def _nearest(spark, sf_dir):
    """The query set is every document whose id is divisible by 100."""
    hits = search.search(_index(spark, sf_dir).where("id % 100 = 0"), _searched(spark, sf_dir), 2).where("q <> id")
    return hits.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy("place"))).where("place = 1")


@query(f"WITH {_NEAREST} SELECT q, id, cosine FROM hits")
def nn1_cosine(spark, sf_dir):
    return _nearest(spark, sf_dir).select("q", "id", "cosine")


_PROBE = f"""WITH {_NEAREST}, two AS (SELECT q AS key, a.text AS l, b.text AS r, cosine, a.text = b.text AS same FROM hits JOIN documents a ON a.doc_id = q JOIN documents b ON b.doc_id = hits.id),
    both_ AS (SELECT 'l' || key AS id, l AS text FROM two UNION ALL SELECT 'r' || key, r FROM two), {sql_terms('bt', 'both_')}, bi AS {sql_idf('bt', '(SELECT count(*) FROM both_)', 1)}, {sql_weights('bw', 'bt', 'bi')},
    dots AS (SELECT substr(x.id, 2) AS key, sum(x.w * y.w) AS c FROM bw x JOIN bw y ON x.term = y.term AND x.id = 'l' || substr(x.id, 2) AND y.id = 'r' || substr(x.id, 2) GROUP BY x.id)
    SELECT count(*) AS n, round(avg(CAST(cosine >= 0.9 AS DOUBLE)), 6) AS high_share, round(avg(CAST(same AS DOUBLE)), 6) AS same_share, round(median(cosine), 6) AS median_cosine,
           round(median(round(coalesce(c, 0), 6)), 6) AS median_reply_cosine FROM two LEFT JOIN dots ON dots.key = CAST(two.key AS VARCHAR)"""


@query(_PROBE)
def retrieval_probe(spark, sf_dir):
    d = documents(spark, sf_dir)
    near = _nearest(spark, sf_dir).join(d.select(F.col("doc_id").alias("q"), F.col("text").alias("a")), "q").join(d.select(F.col("doc_id").alias("id"), F.col("text").alias("b")), "id")
    near = stored(near, "nearest")
    replies = op.rowwise_cosine(near.select(F.col("q").alias("key"), F.col("a").alias("left"), F.col("b").alias("right"))).withColumnRenamed("cosine", "reply_cosine")
    j = near.join(replies, near.q == replies.key)
    return j.agg(
        F.count("*").alias("n"), F.round(F.avg((F.col("cosine") >= 0.9).cast("double")), 6).alias("high_share"), F.round(F.avg((F.col("a") == F.col("b")).cast("double")), 6).alias("same_share"),
        F.round(F.median("cosine"), 6).alias("median_cosine"), F.round(F.median("reply_cosine"), 6).alias("median_reply_cosine"))


# ---------------------------------------------------------------- evidence from answered openers

_CORPUS = f"""corpus AS (SELECT * FROM (SELECT *, {_STRIPPED} AS clean FROM pairs WHERE split = 'train' AND reply IS NOT NULL) WHERE clean <> ''),
    asked AS (SELECT id, thread, author, text, {_STRIPPED} AS clean FROM pairs WHERE split <> 'train')"""
_CORPUS_INDEX = f"src AS (SELECT id, clean AS text FROM corpus), {sql_terms('dt', 'src')}, idf AS {sql_idf('dt', '(SELECT count(*) FROM src)', 2)}, {sql_weights('dw', 'dt', 'idf')}"
_EVIDENCE = f"""
    , {_CORPUS}, {sql_search("SELECT id, clean AS text FROM asked", 40, index=_CORPUS_INDEX)}, {sql_shingled('qsh', 'SELECT id, clean AS text FROM asked')}, {sql_shingled('hsh', 'SELECT id, clean AS text FROM corpus')},
    g AS (SELECT h.q, h.id, h.cosine, h.place, c.text AS opener, c.reply, CASE WHEN h.id = h.q THEN 'self' WHEN c.author = a.author THEN 'customer' WHEN c.thread = a.thread THEN 'thread' WHEN {sql_near('qsh.sh', 'hsh.sh')} THEN 'near_dup' ELSE '' END AS guard
          FROM hits h JOIN corpus c ON c.id = h.id JOIN asked a ON a.id = h.q JOIN qsh ON qsh.id = h.q JOIN hsh ON hsh.id = h.id),
    seen AS (SELECT * FROM (SELECT *, coalesce(count(*) FILTER (WHERE guard = '') OVER (PARTITION BY q ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS passed FROM g) WHERE passed < {K})"""


def _evidence(spark, sf_dir):
    """(asked, hits): later openers, and for each the answered training openers looked at, with the guard that blocks them.

    The guards of an opener, its author, thread and own id, are columns of its row: the key that a search must exclude.
    """
    p = stored(pairs(spark, sf_dir), "pairs")
    corpus = op.answered(p).select("id", "author", "thread", "clean", F.col("text").alias("opener"), "reply")
    asked = p.where("split <> 'train'").select(F.col("id").alias("q"), F.col("author").alias("of_author"), F.col("thread").alias("of_thread"), "text", t.stripped(F.col("text")).alias("asked"))
    index = search.kept(table(spark, sf_dir, "conversations"), "evidence", lambda _: corpus.select("id", F.col("clean").alias("text")))
    hits = search.search(asked.select(F.col("q").alias("id"), F.col("asked").alias("text")), index, op.oversample(K))
    known = hits.join(corpus, "id").join(asked.drop("text"), "q")
    guards = {"self": F.col("id") == F.col("q"), "customer": F.col("author") == F.col("of_author"), "thread": F.col("thread") == F.col("of_thread"), "near_dup": op.near_duplicate(F.col("asked"), F.col("clean"))}
    return asked, op.guarded(known, guards, K)


@query(with_ctes(f", {_CORPUS} SELECT id, thread, author, clean, reply FROM corpus", "pairs"))
def retrieval_corpus(spark, sf_dir):
    """Answered openers of the training split: nothing later may be cited."""
    return op.answered(pairs(spark, sf_dir)).select("id", "thread", "author", "clean", "reply")


@query(with_ctes(_EVIDENCE + " SELECT q, id, cosine, place FROM seen WHERE guard = ''", "pairs"))
def evidence_topk(spark, sf_dir):
    return _evidence(spark, sf_dir)[1].where("guard = ''").select("q", "id", "cosine", "place")


@query(with_ctes(_EVIDENCE + " SELECT guard, count(*) AS n FROM seen GROUP BY guard", "pairs"))
def evidence_guards(spark, sf_dir):
    return _evidence(spark, sf_dir)[1].groupBy("guard").agg(F.count("*").alias("n"))


@query(with_ctes(_EVIDENCE + f""", kept AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY place) AS n FROM seen WHERE guard = ''),
    cases AS (SELECT q, string_agg('Case ' || n || chr(10) || 'customer: ' || opener || chr(10) || 'answer: ' || reply, chr(10) || chr(10) ORDER BY n) AS cases FROM kept WHERE n <= {K} GROUP BY q)
    SELECT id AS q, md5('Answer the message with these cases alone.' || chr(10) || chr(10) || coalesce(cases, '(no earlier case is similar)') || chr(10) || chr(10) || 'Message:' || chr(10) || text) AS prompt
    FROM asked LEFT JOIN cases ON cases.q = asked.id""", "pairs"))
def evidence_prompts(spark, sf_dir):
    asked, hits = _evidence(spark, sf_dir)
    prompts = op.evidence_prompt(asked, op.evidence(hits.where("guard = ''"), K))
    return prompts.select("q", F.md5("prompt").alias("prompt"))


@query()
def kmeans_scan(spark, sf_dir):
    return clusters.kmeans_scan(table(spark, sf_dir, "embeddings").select(F.col("embedding").alias("v")), (4, 8))


@query()
def topics(spark, sf_dir):
    return factors.topics(_index(spark, sf_dir), 4)[0]


@query()
def topic_error(spark, sf_dir):
    """The reconstruction error after each round; it never rises."""
    errors = factors.topics(_index(spark, sf_dir), 4)[2]
    return spark.createDataFrame([(i, round(e, 6)) for i, e in enumerate(errors)], "round int, error double")


@query()
def topic_assign(spark, sf_dir):
    return factors.topics(_index(spark, sf_dir), 4)[1]


_EN, _RO = sql_has("text", FAMILIES["english"]), sql_has("text", FAMILIES["romance"])


@query(f"""WITH f AS (SELECT source, CAST({_EN} AS DOUBLE) AS e, CAST({_RO} AS DOUBLE) AS r FROM documents), w AS (SELECT count(*) AS n, avg(e) AS e, avg(r) AS r FROM f)
    SELECT source, count(*) AS n, round(count(*) / any_value(w.n), 6) AS share, count(*) / any_value(w.n) >= 0.04 AS large, round(avg(f.e), 6) AS english_rate, round(avg(f.e) / any_value(w.e), 6) AS english_lift,
           round(avg(f.r), 6) AS romance_rate, round(avg(f.r) / any_value(w.r), 6) AS romance_lift FROM f CROSS JOIN w GROUP BY source""")
def cluster_profile(spark, sf_dir):
    return clusters.described(documents(spark, sf_dir), "source", {n: t.has(F.col("text"), FAMILIES[n]) for n in ("english", "romance")})


@query(f"""WITH p AS (SELECT source, round(100 * avg(CAST({_EN} AS DOUBLE)), 2) AS e, round(100 * avg(CAST({_RO} AS DOUBLE)), 2) AS r FROM documents GROUP BY source)
    SELECT a.source AS a, b.source AS b FROM p a JOIN p b ON a.source < b.source AND abs(a.e - b.e) <= 4.0 AND abs(a.r - b.r) <= 6.0""")
def merge_candidates(spark, sf_dir):
    per = documents(spark, sf_dir).groupBy("source").agg(rate(t.has(F.col("text"), FAMILIES["english"])).alias("e"), rate(t.has(F.col("text"), FAMILIES["romance"])).alias("r"))
    return clusters.merge_candidates(per, "source", {"e": 4.0, "r": 6.0})


@query(" UNION ALL ".join(f"SELECT '{n}' AS state, round(avg(CAST({_EN} AS DOUBLE)) FILTER (WHERE {sql_has('text', p)}), 6) AS present, round(avg(CAST({_EN} AS DOUBLE)) FILTER (WHERE NOT {sql_has('text', p)}), 6) AS absent FROM documents" for n, p in FAMILIES.items() if n != "english"))
def conditional_rates(spark, sf_dir):
    """The rate of one flag where another is present and where it is absent."""
    hit = t.has(F.col("text"), FAMILIES["english"]).cast("double")
    flags = {n: t.has(F.col("text"), p) for n, p in FAMILIES.items() if n != "english"}
    one = documents(spark, sf_dir).agg(*(F.struct(F.round(F.avg(F.when(c, hit)), 6).alias("present"), F.round(F.avg(F.when(~c, hit)), 6).alias("absent")).alias(n) for n, c in flags.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("state"), F.col(f"{n}.present").alias("present"), F.col(f"{n}.absent").alias("absent")) for n in flags))).alias("x")).select("x.*")
