"""Edge cases of the operators, on small frames."""

import hashlib
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.functions import stats, text as t
from parlance.lexicon import MUST, REASONS, TOPICS, seeds, template
from parlance.operators import clusters, codebook, decisions, dedup, evaluation, factors, prefix, replies, sampling, threads
from parlance.plans import pool
from parlance.sources import tables


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'long'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


def test_thread_roots(spark):
    rows = [(1, None), (2, 1), (3, 2), (4, 3), (5, 4), (6, 5), (7, 99), (8, 7), (9, None)]
    m = spark.createDataFrame(rows, "id long, parent long")
    got = {r.id: r.root for r in threads.thread_roots(m).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 7, 8: 7, 9: 9}
    assert {r.id for r in threads.resolve_edges(m).where("dangling").collect()} == {7}


def test_cycle_is_reported(spark, monkeypatch):
    monkeypatch.setattr(threads, "MAX_JUMPS", 3)
    with pytest.raises(RuntimeError):
        threads.thread_roots(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "id long, parent long"))


def test_first_reply_ties_and_nulls(spark):
    rows = [(1, 1, True, "2024-01-01 00:00:00", "q"), (2, 1, False, "2024-01-01 00:05:00", None), (3, 1, False, "2024-01-01 00:05:00", "b"), (4, 4, True, "2024-01-02 00:00:00", "alone")]
    f = spark.createDataFrame(rows, "id long, thread long, inbound boolean, created_at string, text string").withColumn("created_at", F.to_timestamp_ntz("created_at"))
    got = threads.first_replies(f).collect()
    assert [(r.thread, r.reply_id, r.reply) for r in got] == [(1, 2, None)]


def test_split_is_half_open(spark):
    df = spark.sql("select timestamp_ntz'2024-01-15 00:00:00' as a, timestamp_ntz'2024-01-14 23:59:59' as b, timestamp_ntz'2030-01-01 00:00:00' as c")
    s = (("train", "2024-01-01", "2024-01-15"), ("dev", "2024-01-15", "2024-01-22"))
    assert tuple(df.select(*(threads.split_of(F.col(c), s) for c in "abc")).first()) == ("dev", "train", "outside")


@pytest.mark.parametrize(("raw", "masked", "stripped"), [("Hi @Bob_1  see https://x.y/z ok", "hi <user> see <url> ok", "hi see ok"), ("", "", ""), ("https://a.b", "<url>", ""), ("Thanks ^JD", "thanks ^jd", "thanks"), ("éa\n b", "éa b", "éa b")])
def test_normalisation(spark, raw, masked, stripped):
    assert one(spark, t.masked(F.col("s")), s=raw) == masked
    assert one(spark, t.stripped(F.col("s")), s=raw) == stripped


@pytest.mark.parametrize(("raw", "want"), [("", []), ("  ", []), ("a", ["a"]), ("a b", ["a b"]), ("a b c", ["a b c"]), ("a b c a b c", ["a b c", "b c a", "c a b"])])
def test_shingles(spark, raw, want):
    assert sorted(one(spark, t.shingle_set(F.col("s")), s=raw)) == want
    rows = dedup.shingle_rows(spark.createDataFrame([(1, raw)], "id long, text string"), 3).collect()
    assert sorted(r.shingle for r in rows) == want


def test_word_bounds(spark):
    assert one(spark, t.has(F.col("s"), "sue"), s="they SUE us")
    assert not one(spark, t.has(F.col("s"), "sue"), s="ésue tissue")
    assert one(spark, t.has(F.col("s"), MUST["account_access"]), s="I can't log in")


@pytest.mark.parametrize(("k", "n"), [(0, 0), (0, 10), (10, 10), (3, 7)])
def test_wilson(spark, k, n):
    low, high = spark.range(1).select(*stats.wilson(F.lit(k), F.lit(n))).first()
    if not n:
        assert (low, high) == (0, 0)
        return
    z, p = stats.Z95, k / n
    mid, spread = (p + z * z / 2 / n) / (1 + z * z / n), z * math.sqrt(p * (1 - p) / n + z * z / 4 / n / n) / (1 + z * z / n)
    assert low == pytest.approx(max(0, mid - spread)) and high == pytest.approx(min(1, mid + spread))


@pytest.mark.parametrize(("b", "c", "p"), [(0, 0, 1.0), (41, 25, 0.0640), (27, 38, 0.2145), (11, 6, 0.3323), (5, 0, 0.0625), (900, 900, 1.0)])
def test_mcnemar(spark, b, c, p):
    assert spark.range(1).select(stats.mcnemar_p(F.lit(b), F.lit(c))).first()[0] == pytest.approx(p, abs=5e-5)


def test_kappa_constant_and_empty(spark):
    same = spark.createDataFrame([("x", "x")] * 3, "a string, b string")
    assert evaluation.kappa(same, [], "a", "b").first().kappa == 1.0


def test_risk_coverage_ties(spark):
    rows = spark.createDataFrame([("s", 0.5, "ESCALATE"), ("s", 0.5, "AUTO_OK"), ("s", 0.2, "AUTO_OK")], "system string, score double, escalation string")
    got = sorted((r.threshold, r.auto, r.unsafe) for r in evaluation.risk_coverage(rows).collect())
    assert got == [(0.0, 0, 0), (0.2, 0, 0), (0.5, 1, 0), (1.0001, 3, 1)]


def test_greedy_collapse(spark):
    rng = random.Random(3)
    for _ in range(3):
        n = 14
        pairs = [(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.2]
        kept = []
        for i in range(n):
            if not any((k, i) in pairs for k in kept):
                kept.append(i)
        got = dedup.greedy_collapse(spark.createDataFrame([(i,) for i in range(n)], "id long"), spark.createDataFrame(pairs, "a long, b long"))
        assert sorted(r.id for r in got.where("kept").collect()) == kept


def test_similar_pairs_at_the_threshold(spark):
    # 9 shared of 10 and 9 of 9 three-word shingles: 9 / 10; and exactly 8 / 10
    base = [f"w{i}" for i in range(11)]
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join([*base, "x"])), (3, " ".join(base[:-1])), (4, ""), (5, None)], "id long, text string")
    got = {(r.a, r.b): r.common for r in dedup.similar(docs, None, 80).pairs.collect()}
    assert got == {(1, 2): 9, (1, 3): 8, (2, 3): 8}


def test_equal_texts_are_one_class(spark):
    """800 equal texts are 800 rows of membership and no pair; all pairs come on demand and equal brute force."""
    many = spark.range(800).selectExpr("id", "'one text that is written again and again' as text")
    found = dedup.similar(many, None, 80)
    assert found.pairs.count() == 0 and {(r.rep, r.n) for r in found.left.collect()} == {(0, 6)} and found.left.count() == 800
    assert found.expanded().count() == 319_600
    rng = random.Random(4)
    texts = [(i, " ".join(f"w{rng.randrange(4)}" for _ in range(rng.randrange(0, 9)))) for i in range(60)] + [(60, None), (61, "  "), (62, "w1\t w2\n\x0bw3 "), (63, "w1 w2 w3")]
    sets = {i: {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if (w := (t or "").split()) else set() for i, t in texts}
    like = lambda a, b: len(sets[a] & sets[b]) * 160 >= 60 * (len(sets[a]) + len(sets[b])) and sets[a] & sets[b]
    docs = spark.createDataFrame(texts, "id long, text string")
    got = [(r.a, r.b, r.common, r.size_a, r.size_b) for r in dedup.similar(docs, None, 60).expanded().collect()]
    assert sorted(got) == [(a, b, len(sets[a] & sets[b]), len(sets[a]), len(sets[b])) for a in range(64) for b in range(a + 1, 64) if like(a, b)]
    left, right = docs.where("id % 2 = 0"), docs.where("id % 2 = 1")
    assert sorted((r.a, r.b) for r in dedup.similar(left, right, 60).expanded().collect()) == [(a, b) for a in range(0, 64, 2) for b in range(1, 64, 2) if like(a, b)]
    kept = []
    for i in range(64):
        if not any(like(k, i) for k in kept):
            kept.append(i)
    assert sorted(r.id for r in dedup.collapsed(docs, 60).where("kept").collect()) == kept


def test_running_sums_over_ranges(spark):
    """Several tasks share one group; sums and numbers are as in a window over the whole."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(5000).selectExpr("if(id % 3 = 0, null, id % 2) as g", "(id * 7919) % 5000 as k", "if(id % 11 = 0, null, id % 13) as x")
        got = prefix.running_before(rows, ["g"], ["k"], ["x"])
        assert got.select(F.spark_partition_id()).distinct().count() > 1
        want, run = {}, {}
        for g, k, x in sorted(map(tuple, rows.collect()), key=lambda r: r[1]):
            want[k] = run.get(g, 0)
            run[g] = want[k] + (x or 0)
        assert {r.k: r.x_before for r in got.collect()} == want
        assert {r.k: r.place for r in prefix.numbered(rows, ["k"], "place").collect()} == {k: k for k in range(5000)}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_curves_of_few_scores(spark):
    """Three scores are enough, 0.0 among them or not; two aren't."""
    rows = [(s, x, "ESCALATE" if x > 0.4 else "AUTO_OK") for s, of in (("zero", (0.0, 0.3, 0.6)), ("three", (0.1, 0.3, 0.6)), ("two", (0.0, 1.0, 1.0))) for x in of]
    curve = evaluation.risk_coverage(spark.createDataFrame(rows, "system string, score double, escalation string"))
    got = {(r.system, r.target): (r.threshold, r.coverage) for r in evaluation.matched_coverage(curve, [0.5, 1.0]).collect()}
    assert got == {("zero", 0.5): (0.3, 0.333333), ("zero", 1.0): (1.0001, 1.0), ("three", 0.5): (0.3, 0.333333), ("three", 1.0): (1.0001, 1.0)}
    others = spark.createDataFrame([("always", 0.0, 0.0), ("three", 0.3, 0.0), ("plain", 0.7, 0.2)], "system string, coverage double, unsafe_rate double")
    near = {(r.system, r.other): (r.threshold, r.risk) for r in evaluation.matched_systems(curve, others).collect()}
    assert near == {("zero", "always"): (0.0, 0.0), ("zero", "plain"): (0.6, 0.0), ("three", "always"): (0.0, 0.0), ("three", "plain"): (0.6, 0.0)}


def test_constant_policies_are_left_out(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "x"), ("b", 2, "x"), ("c", 1, None), ("c", 2, "x")], "system string, id long, decision string")
    assert {r.system for r in evaluation.without_constants(rows).collect()} == {"a"}


def test_samples(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 2)
    first = sampling.take(df, "id", 10, "s", "core")
    assert first.count() == 10 and first.select("inclusion_prob").distinct().first()[0] == pytest.approx(0.1)
    plan = sampling.sequential_plan(df, "id", [("a", F.lit(True), 30), ("b", F.col("g") == 0, 100)], "p")
    assert plan.count() == plan.select("id").distinct().count()
    assert plan.where("stratum = 'b'").count() == 50 - plan.where("stratum = 'a' and id % 2 = 0").count()
    assert sampling.take(df.where("false"), "id", 3, "s", "x").count() == 0


BAD = [
    ("see www.x.com, dm us", "no_url"), ("ref 12345678 dm", "no_long_digit_run"), ("hi {name} dm", "no_unfilled_placeholder"), ("dm " + "x" * 300, "within_length_cap"),
    ("we will refund you, dm", "no_outcome_promise"), ("   ", "non_empty"), ("hello there", "routes_to_private_channel"),
]


@pytest.mark.parametrize(("reply", "check"), BAD)
def test_guardrails(spark, reply, check):
    assert check in one(spark, replies.failed(replies.guardrails(F.col("s"))), s=reply).split(";")


def test_guardrails_pass_and_echo(spark):
    for reason in REASONS:
        assert one(spark, replies.failed(replies.guardrails(F.col("s"))), s=template(reason)) == ""
    g = replies.guardrails(F.col("s"), F.col("c"), private=False)["no_customer_text_echoed"]
    assert one(spark, g, s="as you say One two three four five six!", c="one two three four five six seven") is False
    assert one(spark, g, s="short", c="one two") is True


@pytest.mark.parametrize(("reply", "ok"), [("hi @115888 sorry", True), ("hi @115888, order 99", False), ("it costs $5", False), ("call 8842190", False), ("in 2 days", True)])
def test_invented_numbers(spark, reply, ok):
    assert one(spark, replies.draft_guardrails(F.col("s"), F.lit("x"))["no_invented_number"], s=reply) is ok


FINE = '{"addresses_need": 4, "grounded": 5, "routing": 1, "tone": 2, "acceptable": true, "why": "x"}'


@pytest.mark.parametrize(("said", "ok"), [(FINE, True), (f"```json\n{FINE}\n```", True), (f"Sure: {FINE} done", True), (FINE.replace("4", "9"), False), (FINE.replace("4", "4.0"), False), (FINE.replace("true", '"yes"'), False), (FINE.replace('"tone": 2, ', ""), False), ("no json", False), ("{", False)])
def test_verdicts(spark, said, ok):
    v = replies.verdict(F.col("s"))
    got = one(spark, F.struct(v["tone"].alias("t"), v["acceptable"].alias("a")), s=said)
    assert tuple(got) == ((2, True) if ok else (None, None))


def test_reasons_order_and_fallback(spark):
    rules = {"a": "x", "b": "y"}
    why = lambda s, d, i: tuple(one(spark, decisions.reasons(F.col("s"), F.lit(d), F.lit(i), rules, {"int": "c"}), s=s))
    assert why("y x", "ESCALATE", "int") == ("a", "rule:a")
    assert why("z", "ESCALATE", "int") == ("c", "fallback:c")
    assert why("z", "ESCALATE", "other") == ("ambiguous", "fallback:ambiguous")
    assert why("x", "AUTO_OK", "int") == ("", "")


def test_message_file(spark, tmp_path):
    (tmp_path / "m.csv").write_text(
        'tweet_id,author_id,inbound,created_at,text,response_tweet_id,in_response_to_tweet_id\n1,77,True,Tue Oct 31 22:10:47 +0000 2017,"two\nlines, ""quoted""",2,\n2,brand,False,not a date,null,,1.0\n', encoding="utf-8")
    rows = {r.id: r for r in tables.read_messages(spark, f"file://{tmp_path}/m.csv").collect()}
    assert rows[1].text == 'two\nlines, "quoted"' and rows[1].inbound and str(rows[1].created_at) == "2017-10-31 22:10:47" and rows[1].parent is None
    assert rows[2].text == "null" and rows[2].created_at is None and rows[2].parent == 1


def test_prediction_files(spark, tmp_path):
    for system in ("rule", "two-words"):
        (tmp_path / f"intent_{system}_golden.csv").write_text("id,pred\n1,a\n")
    from pyspark.sql import types as T

    got = tables.read_predictions(spark, f"file://{tmp_path}/*.csv", T.StructType([T.StructField("id", T.LongType()), T.StructField("pred", T.StringType())]))
    assert {r.system for r in got.collect()} == {"rule", "two-words"}
    tables.write_predictions(got.drop("system"), f"file://{tmp_path}/out", system="rule")
    assert spark.read.json(f"file://{tmp_path}/out.meta").first().system == "rule"


def test_distant_lr_equals_a_plain_fit(spark):
    """Probabilities of every class against gradient descent over all terms, balanced, with free intercepts."""
    rng, n = random.Random(2), 60
    texts = [(i, " ".join(rng.choice(("red green blue", "one two three four", "sun moon rain")[i % 3 if rng.random() < 0.8 else 0].split()) for _ in range(rng.randrange(1, 9))), ("c", "a", "b")[i % 3] if i > 20 else "a") for i in range(n)] + [(99, None, "b"), (98, "unheardof", "c")]
    counts = []
    for _, text, _ in texts:
        w = (text or "").split()
        c = {}
        for x in w + [" ".join(p) for p in zip(w, w[1:], strict=False)]:
            c[x] = c.get(x, 0) + 1
        counts.append(c)
    df = {x: sum(x in c for c in counts) for c in counts for x in c}
    vocabulary = sorted(x for x in df if df[x] >= 2)
    x = np.array([[(1 + math.log(c[v])) * (math.log((1 + len(texts)) / (1 + df[v])) + 1) if v in c else 0.0 for v in vocabulary] for c in counts])
    x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)
    classes = ["a", "b", "c"]
    y = np.array([[float(k == label) for k in classes] for *_, label in texts])
    weight = (len(texts) / (3 * y.sum(0)))[y.argmax(1)][:, None]
    coef, free = np.zeros((len(vocabulary), 3)), np.zeros(3)
    for _ in range(30_000):
        z = x @ coef + free
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = weight * (p - y)
        coef -= 0.02 * (x.T @ g + coef)
        free -= 0.02 * g.sum(0)
    got = {r.doc_id: r for r in decisions.distant_lr(spark.createDataFrame(texts, "doc_id long, text string, intent string"), "intent").collect()}
    for (i, *_), want in zip(texts, p, strict=True):
        r = got[i]
        assert [r.probabilities[k] for k in classes] == pytest.approx(want, abs=2e-3) and r.predicted == classes[int(np.argmax(list(r.probabilities[k] for k in classes)))] and r.max_proba == max(r.probabilities.values())


def test_terms_are_numbered_without_gaps(spark):
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} w{i % 3}") for i in range(40)], "id long, text string")
    rows, size = decisions.sparse_vectors(docs)
    used = {int(i) for r in rows.collect() for i in r.features.indices}
    assert used == set(range(size)) and all(abs(sum(v * v for v in r.features.values) - 1) < 1e-9 for r in rows.collect())


def test_distant_lr(spark):
    docs = spark.createDataFrame([(i, "alpha beta gamma" if i % 2 else "delta epsilon zeta", "a" if i % 2 else "b") for i in range(20)], "doc_id long, text string, intent string")
    got = decisions.distant_lr(docs, "intent").collect()
    assert all(r.predicted == ("a" if r.doc_id % 2 else "b") and 0.5 <= r.max_proba <= 1 for r in got)


def test_provider_hook(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, prompt string")
    assert {r.response for r in replies.with_provider(df, lambda xs: [x.upper() for x in xs]).collect()} == {"A", "B"}


@pytest.mark.parametrize(("said", "intent"), [
    ("I can't log in on my Android", "account_access"), ("I was charged for the family plan", "billing_subscription"), ("is there a student discount", "plans_eligibility"), ("why is it not on Acme yet", "content_availability"),
    ("please add a sleep timer", "product_feature_feedback"), ("bluetooth drops", "app_device_technical"), ("shuffle is broken", "playback_playlist"), ("hello", "other_unclear"), ("", "other_unclear")])
def test_seed_order(spark, said, intent):
    assert one(spark, t.first_match(F.col("s"), seeds("acme"), "other_unclear"), s=said) == intent


def test_topics(spark):
    flags = t.matches(F.col("s"), TOPICS)
    assert one(spark, F.array_join(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in flags.items()))), ","), s="Thanks, my bag is stuck") == "technical/bug,praise,baggage"


def test_cached_copy_follows_files_and_version(spark):
    docs = tables.table(spark, "/root/testdata/sf0.001", "documents")
    build = lambda d: d.groupBy("lang").count()
    hits = [tables.cached(docs, "langs", version, build)[1] for version in ("v1", "v1", "v2", "v1")]
    assert hits == [False, True, False, False] and tables.cached(docs, "langs", "v1", build)[0].count() == 4


def test_export_refuses_changed_texts(spark, tmp_path):
    told = spark.createDataFrame([(1, "a"), (2, None)], "id long, text string")
    assert tables.guarded_export(told, f"file://{tmp_path}/out", told, "id") == 2
    with pytest.raises(ValueError):
        tables.guarded_export(told.withColumn("text", F.lit("b")), f"file://{tmp_path}/no", told, "id")
    assert not (tmp_path / "no").exists()


def test_answers_are_kept_by_prompt(spark, tmp_path):
    asked = tmp_path / "asked"

    def complete(prompts):
        with asked.open("a") as f:
            f.writelines(f"{p}\n" for p in prompts)
        return [p.upper() for p in prompts]

    of = lambda *p: spark.createDataFrame([(i, x) for i, x in enumerate(p)], "id long, prompt string")
    folder = f"file://{tmp_path}/answers"
    with pytest.raises(PermissionError):
        replies.read_through(of("a"), folder, complete, "paid", billed=True).collect()
    got = sorted(tuple(r) for r in replies.read_through(of("a", "b", "a"), folder, complete, "free").collect())
    assert got == [(0, "a", "A", False), (1, "b", "B", False), (2, "a", "A", False)] and sorted(asked.read_text().split()) == ["a", "b"]
    got = sorted(tuple(r) for r in replies.read_through(of("b", "c"), folder, complete, "free").collect())
    assert got == [(0, "b", "B", True), (1, "c", "C", False)] and sorted(asked.read_text().split()) == ["a", "b", "c"]
    assert replies.read_through(of("a"), folder, complete, "free", billed=True).first().cached


def test_provider_is_asked_again(spark, tmp_path):
    failed = tmp_path / "failed"

    def complete(prompts):
        if not failed.exists():
            failed.touch()
            raise OSError("busy")
        return prompts

    df = spark.createDataFrame([(1, "a")], "id long, prompt string").coalesce(1)
    assert replies.with_provider(df, complete, attempts=2, wait=0.01).first().response == "a"


def test_pool_leaves_out_what_was_shown(spark):
    say = "one two three four five six seven eight nine ten eleven twelve"
    rows = [
        (1, 1, "a", "first words here"), (2, 2, "b", ""), (3, 3, "shown", "second"), (4, 99, "c", "third"), (5, 5, "a", "again a"), (6, 6, "d", "First  words here"),
        (7, 7, "e", say), (8, 8, "f", say + " thirteen"), (9, 9, "g", "a text that was shown before and comes back once more"), (77, 77, "h", "fourth"), (10, 10, "i", "fifth"),
    ]
    schema = "id long, thread long, author string, text string"
    openers = pool.prepared(spark.createDataFrame(rows, schema))
    shown = pool.prepared(spark.createDataFrame([(77, 99, "shown", "a text that was shown before and comes back once more now")], schema))
    left, trace = pool.build_pool(openers, shown)
    assert sorted(r.id for r in left.collect()) == [1, 7, 10]
    assert [r.rows for r in trace.collect()] == [11, 10, 9, 8, 7, 7, 6, 5, 4, 3]


def test_every_check_of_a_sample_sees_its_fault(spark):
    schema = "id long, thread long, author string, text string"
    openers = spark.createDataFrame([(i, i, f"a{i}", f"text {i}") for i in range(20)], schema).withColumn("inbound", F.col("id") < 19)
    members, shown = pool.prepared(openers), pool.prepared(openers).where("id = 0")
    items, key, manifest = pool.drawn(members.where("id between 1 and 18"), openers, [("core", F.lit(True), 5)], "s", "G")
    bad = lambda *a: {r.check for r in pool.verified(*a).collect() if not r.passed}
    assert bad(items, key, manifest, openers, shown) == set()
    blank = {a: "" for a in pool.ANSWERS}
    more = lambda **v: spark.createDataFrame([v], "blind_id string, text string, " + ", ".join(f"{a} string" for a in pool.ANSWERS))
    of = lambda blind, i, thread, author: spark.createDataFrame([(blind, i, thread, author, "core", 18, 0.1, 10.0)], key.schema)
    assert bad(items.unionByName(more(blind_id="G900", text="x", **blank)), key, manifest, openers, shown) == {"row_count", "ids_match_key"}
    assert bad(items.unionByName(items.limit(1)), key, manifest, openers, shown) == {"row_count", "ids_unique"}
    assert bad(items.withColumn("text", F.concat(F.lit("\ufeff"), "text")), key, manifest, openers, shown) == {"exact_text", "no_byte_order_mark"}
    assert bad(items.withColumn("reason", F.lit("core")), key, manifest, openers, shown) == {"answers_blank", "strata_hidden"}
    assert "strata_hidden" in bad(items.withColumn("stratum", F.lit("x")), key, manifest, openers, shown)
    assert {"no_shown_id", "no_shown_thread", "no_shown_author"} <= bad(items.unionByName(more(blind_id="G900", text="text 0", **blank)), key.unionByName(of("G900", 0, 0, "a0")), manifest, openers, shown)
    assert {"one_per_thread", "one_per_author", "inbound_only"} <= bad(items.unionByName(more(blind_id="G900", text="text 19", **blank)), key.unionByName(of("G900", 19, 7, "a7")).unionByName(of("G901", 8, 7, "a7")), manifest, openers, shown)
    assert "opener_of_window" in bad(items.unionByName(more(blind_id="G900", text="x", **blank)), key.unionByName(of("G900", 500, 500, "z")), manifest, openers, shown)


def test_every_check_of_a_second_pass_sees_its_fault(spark):
    blank = {a: F.lit("") for a in pool.ANSWERS}
    first = spark.createDataFrame([(f"first-{i}", f"text {i}") for i in range(4)], "first_id string, text string")
    items = spark.createDataFrame([(f"R{i}", f"text {i}") for i in range(3)], "blind_id string, text string").withColumns(blank)
    key = spark.createDataFrame([(f"R{i}", f"first-{i}") for i in range(3)], "blind_id string, first_id string")
    built, later = "2024-01-01 00:00:00", "2024-01-06 00:00:00"
    bad = lambda i, k, now=later: {r.check for r in pool.retest_verified(i, k, first, built, now).collect() if not r.passed}
    assert bad(items, key) == set() and bad(items, key, "2024-01-05 23:59:59") == {"due"}
    assert bad(items.withColumn("notes", F.lit("see first-1")), key) == {"answers_blank", "blind"}
    assert bad(items.withColumn("text", F.lit("text 1")), key) == {"exact_text"}
    assert bad(items.unionByName(items.limit(1)), key) == {"ids_unique"}
    assert "ids_in_key" in bad(items, key.where("blind_id <> 'R1'"))
    assert {"one_item_each"} <= bad(items, spark.createDataFrame([("R0", "first-0"), ("R1", "first-0"), ("R2", "first-9")], key.schema)) >= {"item_of_first_pass"}


def test_stub_verdicts_are_read(spark):
    seen = lambda s: one(spark, replies.verdict(replies.mock_verdict(F.col("s")))["acceptable"], s=s)
    fine = "thank you for writing, we will look at this and come back to you soon"
    assert seen(fine) in (True, None) and seen("You should know. " + fine) in (False, None) and seen(fine + " 12.50") in (False, None)
    assert {seen(f"{fine} {'x' * i}") for i in range(1, 60)} == {True, None}


def test_clusters_of_planted_vectors(spark):
    rng = random.Random(5)
    at = [[1.0, 0, 0, 0], [0, 1.0, 0, 0], [0, 0, 1.0, 0], [0, 0, 0, 1.0]]
    vectors = spark.createDataFrame([([x + rng.random() / 20 for x in at[i % 4]],) for i in range(80)], "v array<float>")
    by = {r.k: r for r in clusters.kmeans_scan(vectors, (2, 4)).collect()}
    assert by[4].silhouette > 0.9 > by[2].silhouette and by[4].inertia < by[2].inertia


def test_topics_of_planted_words(spark):
    rng = random.Random(6)
    groups = [["apple", "pear", "plum", "cherry", "melon"], ["piston", "gear", "valve", "engine", "brake"]]
    rows = [(i, " ".join(rng.choices(groups[i % 2], k=30))) for i in range(60)] + [(60, ""), (61, "unseen")]
    terms, assigned, _ = factors.topics(spark.createDataFrame(rows, "id long, text string"), 2, top=5, max_df=0.9)
    topic = {r.id: r.topic for r in assigned.collect()}
    assert set(topic) == set(range(62)) and topic[60] == topic[61] == -1
    assert len({topic[i] for i in range(0, 60, 2)}) == len({topic[i] for i in range(1, 60, 2)}) == 1 and topic[0] != topic[1]
    of = {}
    for r in terms.collect():
        of.setdefault(r.topic, set()).add(r.term)
        assert r.weight > 0
    assert of == {topic[0]: set(groups[0]), topic[1]: set(groups[1])}


def test_ratings_in_any_spelling(spark):
    rows = spark.createDataFrame([(1, " Yes", "True", "4", "4"), (2, "n", "true", "", "3"), (3, "", "True", "1", "1"), (4, "Y", "False", "2", "5")], "id long, human_acceptable string, judge_acceptable string, human_tone string, judge_tone string")
    got = sorted((r.id, r.field, r.a, r.b) for r in evaluation.rated(rows, ("tone",), "id").collect())
    assert got == [(1, "acceptable", "yes", "yes"), (1, "tone", "4", "4"), (2, "acceptable", "no", "yes"), (4, "acceptable", "yes", "no"), (4, "tone", "2", "5")]


def test_values_outside_the_domain_are_shown(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "odd"), ("b", "x"), ("b", None)], "g string, v string")
    got = {(r.g, r.value): (r.k, r.n) for r in evaluation.distribution(rows, "g", "v", ["x", "y", "never"]).collect()}
    assert got == {("a", "x"): (1, 3), ("a", "y"): (1, 3), ("a", "odd"): (1, 3), ("a", "never"): (0, 3), ("b", "x"): (1, 2), ("b", "y"): (0, 2), ("b", "odd"): (0, 2), ("b", "never"): (0, 2)}


def test_other_texts_go_round(spark):
    got = replies.corrupted(spark.createDataFrame([(5, "a"), (9, "b"), (70, "c")], "id long, text string"), "id", "text").where("defect = 'wrong_intent'").collect()
    assert {r.id: r.reply for r in got} == {5: "b", 9: "c", 70: "a"}
    assert replies.corrupted(spark.createDataFrame([], "id long, text string"), "id", "text").count() == 0


def test_a_codebook_file_drives_prompt_roles_and_checks(spark, tmp_path):
    book = {
        "version": "2", "intents": [{"name": "b", "definition": "second", "escalation_role": "independent", "confusable_with": ["a"]}, {"name": "a", "definition": "first", "escalation_role": "none"}], "boundary_rules": [{"id": "R", "test": "b wins"}],
        "fields": [{"name": "intent", "values": ["a", "b"]}, {"name": "why", "values": ["none", "x"], "blank_if": {"field": "out", "value": "no"}}, {"name": "out", "values": ["yes", "no"]}],
        "cross_rules": [{"id": "no_reason", "field": "out", "value": "no", "other": "why", "allowed": ["none", ""]}, {"id": "a_reason", "field": "out", "value": "yes", "other": "why", "refused": ["none"]}],
    }
    (tmp_path / "codebook.json").write_text(json.dumps(book, indent=1))
    read = codebook.read_codebook(spark, f"file://{tmp_path}/codebook.json")
    assert codebook.roles(read) == {"b": "independent", "a": "none"}
    said = decisions.codebook_prompt(*codebook.prompt_parts(read)).first().prompt
    assert "* b: second\n  not to be mixed up with: a\n* a: first\n\nRules" in said and "* R: b wins" in said
    rows = [(1, "a", "none", "no"), (2, "a", "", "no"), (3, "b", "", "yes"), (4, "c", "x", "no"), (5, None, "none", "yes"), (6, "", None, " "), (7, " b ", "x", "yes"), (8, "a", "zzz", "maybe")]
    got = sorted(map(tuple, codebook.violations(spark.createDataFrame(rows, "id long, intent string, why string, out string"), read, "id").collect()))
    assert got == [(3, "why", "empty"), (4, "intent", "domain"), (4, "why", "no_reason"), (5, "intent", "empty"), (5, "why", "a_reason"), (8, "out", "domain"), (8, "why", "domain")]
    (tmp_path / "bad.json").write_text("{not json")
    with pytest.raises(Exception, match="(?i)malformed"):
        codebook.read_codebook(spark, f"file://{tmp_path}/bad.json").collect()


def test_whole_file_digests_and_reports(spark, tmp_path):
    (tmp_path / "one.bin").write_bytes(b"abc" * 1000)
    (tmp_path / "two.bin").write_bytes(b"")
    got = {r.file_name: r.sha256 for r in tables.file_digests(spark, f"file://{tmp_path}/*.bin").collect()}
    assert got == {"one.bin": hashlib.sha256(b"abc" * 1000).hexdigest()}
    rows = tables.report(spark.createDataFrame([(1, "a", None), (2, None, [1.5])], "n long, s string, x array<double>")).collect()
    assert [json.loads(r.json) for r in rows] == [{"n": 1, "s": "a"}, {"n": 2, "x": [1.5]}]
