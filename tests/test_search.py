"""The search index against sums over all texts."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from parlance.operators import retrieval, search


def terms(text):
    words = re.findall(r"[^\W]{2,}", (text or "").lower().translate(str.maketrans("äöüé", "aoue")))
    return Counter(words) + Counter(" ".join(p) for p in zip(words, words[1:], strict=False))


def vector(counts, idf):
    raw = {t: (1 + math.log(c)) * idf[t] for t, c in counts.items() if t in idf}
    norm = math.sqrt(sum(w * w for w in raw.values()))
    return {t: w / norm for t, w in raw.items()}


def brute(queries, docs, top, min_df=2):
    counts = {i: terms(t) for i, t in docs}
    df = Counter(t for c in counts.values() for t in c)
    idf = {t: math.log((1 + len(docs)) / (1 + n)) + 1 for t, n in df.items() if n >= min_df}
    vectors = {i: vector(c, idf) for i, c in counts.items()}
    out = {}
    for q, text in queries:
        asked = vector(terms(text), idf)
        scores = [(-round(sum(w * v.get(t, 0) for t, w in asked.items()), 6), i) for i, v in vectors.items() if v.keys() & asked.keys()]
        out[q] = [(i, -s) for s, i in sorted(scores)[:top]]
    return {q: hits for q, hits in out.items() if hits}


def corpus(rng, n, words=150):
    """Words as uneven as those of texts, copies, texts without a known word."""
    word = lambda: f"w{min(int(rng.paretovariate(0.6)), words)}"
    docs = [(i, " ".join(word() for _ in range(rng.randrange(1, 60)))) for i in range(n)]
    docs += [(n + i, docs[i % 7][1]) for i in range(30)] + [(2 * n, None), (2 * n + 1, ""), (2 * n + 2, "x y ! unheardof"), (2 * n + 3, "Ähre öl über café " * 3), (2 * n + 4, "ahre ol uber cafe")]
    return docs


def hits(frame):
    got = defaultdict(list)
    for r in sorted(frame.collect(), key=lambda r: r.place):
        got[r.q].append((r.id, r.cosine))
    return dict(got)


@pytest.mark.parametrize("bounds", [{}, {"shard_postings": 300, "block": 4, "first": 2, "block_terms": 200}, {"vocabulary": 0, "shard_texts": 17, "block": 2, "first": 1, "slice_terms": 50, "counted": 64, "known_words": 10}])
def test_hits_equal_sums_over_all_texts(spark, bounds):
    rng = random.Random(len(bounds))
    docs = corpus(rng, 200)
    queries = [(1000 + k, docs[k][1]) for k in range(0, 200, 9)] + [(1, "uber AHRE"), (2, ""), (3, None), (4, "unknown words only"), (5, "w1 " * 50 + "w77 w2")]
    schema = "id long, text string"
    small = search.Bounds(**bounds)
    index = search.build(spark.createDataFrame(docs, schema).repartition(3), bounds=small)
    for top in (1, 7, 1000):
        got = hits(search.search(spark.createDataFrame(queries, schema), index, top, small))
        want = brute(queries, docs, top)
        assert got.keys() == want.keys()
        for q in want:
            assert [i for i, _ in got[q]] == [i for i, _ in want[q]] and [c for _, c in got[q]] == pytest.approx([c for _, c in want[q]], abs=1.1e-6)


def test_frequent_postings_are_skipped(spark):
    """A few rare words decide; the postings of words that all texts share are hardly read."""
    small = search.Bounds(first=4)
    rng, n = random.Random(7), 3000
    common = [f"common{i}" for i in range(40)]
    rare = [[f"rare{rng.randrange(n)}" for _ in range(30)] for _ in range(n // 6)]
    docs = [(i, " ".join([*rng.sample(common, 40), *rare[i // 6][: 30 - i % 6]])) for i in range(n)]
    schema = "id long, text string"
    index = search.build(spark.createDataFrame(docs, schema).coalesce(1))
    queries = spark.createDataFrame([(i, docs[i][1]) for i in range(0, n, 300)], schema)
    total = search.reads(queries, index, 5, small).agg({"read": "sum", "postings": "sum"}).first()
    assert total["sum(read)"] < 0.3 * total["sum(postings)"]
    got, want = hits(search.search(queries, index, 5, small)), brute([tuple(r) for r in queries.collect()], docs, 5)
    assert {q: [i for i, _ in h] for q, h in got.items()} == {q: [i for i, _ in h] for q, h in want.items()}


def test_an_index_is_built_once_for_its_files(spark, tmp_path, monkeypatch):
    schema, builds, real = "id long, text string", [], search.build
    monkeypatch.setattr(search, "build", lambda *a: builds.append(1) or real(*a))
    spark.createDataFrame(corpus(random.Random(1), 50), schema).write.parquet(f"{tmp_path}/docs")
    ask = spark.createDataFrame([(1, "w1 w2 w3")], schema)
    first, again = (hits(search.search(ask, search.kept(spark.read.parquet(f"{tmp_path}/docs"), "tested", lambda d: d), 5)) for _ in range(2))
    assert first == again and len(builds) == 1
    spark.createDataFrame([(999, "w1 w2 w3"), (998, "w1 w2 w3")], schema).write.mode("append").parquet(f"{tmp_path}/docs")
    later = hits(search.search(ask, search.kept(spark.read.parquet(f"{tmp_path}/docs"), "tested", lambda d: d), 5))
    assert len(builds) == 2 and {i for i, _ in later[1]} >= {998, 999}


def test_no_texts(spark):
    schema = "id long, text string"
    empty, some = spark.createDataFrame([], schema), spark.createDataFrame([(1, "a few words")] * 2 + [(2, "a few words")], schema)
    assert search.search(some, search.build(empty), 3).count() == search.search(empty, search.build(some), 3).count() == 0


def test_rowwise_cosine(spark):
    rows = [(1, "one two three", "one two three"), (2, "one two", "four five"), (3, "", None), (4, "one two three four", "three four")]
    got = {r.key: r.cosine for r in retrieval.rowwise_cosine(spark.createDataFrame(rows, "key long, left string, right string")).collect()}
    texts = [(2 * k + s, t) for k, *both in rows for s, t in enumerate(both)]
    df = Counter(t for _, text in texts for t in terms(text))
    idf = {t: math.log((1 + len(texts)) / (1 + n)) + 1 for t, n in df.items()}
    for k, a, b in rows:
        x, y = (vector(terms(t), idf) if terms(t) else {} for t in (a, b))
        assert got[k] == pytest.approx(sum(w * y.get(t, 0) for t, w in x.items()), abs=1e-6)
