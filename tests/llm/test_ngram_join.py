"""The join against an inverted index in plain Python."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parlance.llm import ngram_join as nj
from parlance.llm.components import components

from .conftest import build


def brute(rows, n, percent):
    sets = {}
    for i, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode()))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    index, common, label = defaultdict(list), defaultdict(int), {i: i for i in sets}
    for i, s in sets.items():
        for x in s:
            index[x].append(i)
    for held in index.values():
        for a in held:
            for b in held:
                common[a, b] += a < b

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for (a, b), c in common.items():
        if c and c * (100 + percent) >= percent * (len(sets[a]) + len(sets[b])):
            x, y = find(a), find(b)
            label[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("seed", "percent", "bounds"), [(1, 80, {}), (2, 60, {"REPEATS": 1, "CELL_ROWS": 2}), (3, 90, {"REPEATS": 2, "FREQUENT": 40, "CELL_ROWS": 3}), (4, 80, {"REPEATS": 99, "COUNTED": 20, "CELL_ROWS": 1}), (5, 80, {"REPEATS": 99, "CELL_ROWS": 2, "ROUNDS": 0})])
def test_components_equal_brute_force(spark, monkeypatch, seed, percent, bounds):
    """Copies edited again and again, a shared passage, short texts; bounds so small that every path is taken."""
    for name, value in (("SALT_ROWS", 5), ("BLOCK", 3), ("QUERY_ROWS", 2), ("LEADERS", 3), ("CENTRES", 1), *bounds.items()):
        monkeypatch.setattr(nj, name, value)
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    passage = [word() for _ in range(30)]
    rows = []
    for base in range(12):
        text = [word() for _ in range(rng.randrange(3, 70))] + (passage if base % 2 else [])
        for _ in range(rng.randrange(1, 14)):
            text = list(text)
            for _ in range(rng.randrange(0, 4)):
                text[rng.randrange(len(text))] = word()
            rows.append((len(rows), " ".join(text)))
    rng.shuffle(rows)
    got = nj.ngram_components(build(spark, [(i, t, "en", "s") for i, t in rows]), 5, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 5, percent)


def test_crowded_cells_are_handed_on_and_split():
    """Batches cut cells anywhere; what a cell's rows allow is the same however often it is split."""
    rng = random.Random(9)
    rows = sorted((t, c, rng.randrange(4), 1, i, (rng.randrange(5, 7) << 32) | rng.randrange(2), 3) for i in range(300) for t, c in {(rng.randrange(3), 0), (7, 0)})
    rows = sorted(rows, key=lambda r: r[:3])

    def run(rows, most, size=23):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[a : a + size]], pa.int64() if k < 6 else pa.int8()) for k in range(7)], [*nj._ROWS]) for a in range(0, len(rows), size)]
        return [tuple(r.values()) for batch in nj._candidates(iter(batches), 80, most) for r in batch.to_pylist()]

    want = {(r[4], r[2]) for r in run(rows, None, 10_000)}
    for most, size in ((1000, 23), (120, 23), (120, 400), (10, 7)):
        out = run(rows, most, size)
        pairs, crowded = {(r[4], r[2]) for r in out if r[0] is None}, [r for r in out if r[0] is not None]
        again = []
        for token in {r[0] for r in crowded}:
            held = [r for r in crowded if r[0] == token]
            assert len(held) > most and sorted(held) == sorted(r for r in rows if r[0] == token)
            for x in range(3):
                for y in range(3):
                    again += [(token, 1 + 3 * x + y, *r[2:6], role) for r in held for role, band in ((2, x), (1, y)) if r[4] % 3 == band]
        pairs |= {(r[4], r[2]) for r in run(sorted(again, key=lambda r: r[:3]), None, size)}
        assert pairs == want


def test_frequent_shingles(spark, monkeypatch):
    """Whole tasks are counted, not batches, and the list keeps the most frequent."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    rows = [(i, f"a b c d e x{i} y{i} z{i} u{i} v{i}" + (" k l m n o" if i % 2 else "")) for i in range(40)]
    docs = build(spark, [(i, t, "en", "s") for i, t in rows]).coalesce(1)
    token, count = nj.frequent(docs, 5)
    assert sorted(count.tolist()) == [20, 40] and (token[1:] > token[:-1]).all()
    monkeypatch.setattr(nj, "FREQUENT", 1)
    assert nj.frequent(docs, 5)[1].tolist() == [40]
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert nj.frequent(docs.where("false"), 5)[1].tolist() == []


def test_a_crowded_class_of_counts_is_cut_not_left_out(spark, monkeypatch):
    rows = [(i, " ".join(f"{w}{k}" for w in ("a b c d e f g h i j k l m n".split()) for k in range(5))) for i in range(8)]
    docs = build(spark, [(i, t, "en", "s") for i, t in rows]).coalesce(1)
    assert len(nj.frequent(docs, 5)[0]) == 66
    monkeypatch.setattr(nj, "FREQUENT", 33)
    assert 10 < len(nj.frequent(docs, 5)[0]) < 56


def test_unlisted_shingle_of_many_rows(spark, monkeypatch):
    """No task saw the shared shingle often enough to list it; its 100,000 rows are counted as they come, and it is listed."""
    import resource

    monkeypatch.setattr(nj, "frequent", lambda docs, n: (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    n, seen = 100_000, []
    shared = min((f"same first five words {k}" for k in range(999)), key=lambda x: next(nj.shingle_sets(pa.array([x]), 5))[0])  # early in the order
    texts = F.concat(F.lit(shared + " "), F.concat_ws(" ", *(F.concat(F.lit(c), F.col("id").cast("string")) for c in "pqrs")))
    pairs = spark.range(0, n, 50).select((F.col("id") + n).alias("id"), texts.alias("text"))  # exact copies of some
    docs = spark.range(n).select("id", texts.alias("text")).union(pairs).withColumnRenamed("id", "doc_id")
    real = nj._relisted

    def relisted(asked, order):
        seen.append(asked.where("token is not null").count())
        return real(asked, order)

    monkeypatch.setattr(nj, "_relisted", relisted)
    whole = nj._candidates

    def measured(batches, percent, most):
        yield from whole(batches, percent, most)
        assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < 500 << 10  # of the worker, in KB

    monkeypatch.setattr(nj, "_candidates", measured)
    got = nj.ngram_components(docs).groupBy((F.col("component_id") == F.pmod("doc_id", F.lit(n))).alias("ok"), "n_shingles").count().collect()
    assert [(r.ok, r.n_shingles, r["count"]) for r in got] == [(True, 5, n + n // 50)]
    assert 0.9 * n < seen[0] <= n and seen[1:] == [0]  # once listed it is in no prefix


def test_sets_are_worked_on_by_slices_not_row_by_row(monkeypatch):
    calls = {"mix": 0, "_pairs": 0}

    def counting(name):
        real = getattr(nj, name)

        def counted(*args):
            calls[name] += 1
            return real(*args)

        monkeypatch.setattr(nj, name, counted)

    counting("mix")
    counting("_pairs")
    texts = [None, "", " \t", "a b", *(f"a b c d e f{i} g{i}" for i in range(2000))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    rows = next(nj._summaries(iter([batch]), 5)).to_pylist()
    assert [r["n"] for r in rows] == [0, 0, 0, 1] + [3] * 2000 and [len(r["keys"]) for r in rows[:5]] == [0, 0, 0, 5, 5]
    assert len({(r["d1"], r["d2"]) for r in rows}) == 2002 and calls["mix"] <= 2 * (2 + len(nj._KEYS))
    cells = [(t, 0, t * 3 + g, 1, t * 3 + g, (5 << 32) | 0, 3) for t in range(3000) for g in range(1 + t % 3)]
    asked = pa.RecordBatch.from_arrays([pa.array([r[k] for r in cells], pa.int64() if k < 6 else pa.int8()) for k in range(7)], [*nj._ROWS])
    found = [(r["doc_id"], r["grp"]) for out in nj._candidates(iter([asked]), 80, 100) for r in out.to_pylist()]
    assert sorted(found) == [(t * 3 + g, t * 3 + h) for t in range(3000) for g in range(1 + t % 3) for h in range(g)]
    assert calls["_pairs"] <= 2


@pytest.mark.parametrize("listed", [0, 3, 40])
def test_prefixes_follow_counts_then_hashes(listed):
    rng = random.Random(listed)
    texts = ["", None, *(" ".join(f"w{rng.randrange(30)}" for _ in range(rng.randrange(1, 60))) for _ in range(80))]
    sets = list(nj.shingle_sets(pa.array(texts), 1))
    token = np.array(sorted(rng.sample(sorted({int(x) for s in sets for x in s}), min(listed, 29))), np.uint64)
    often = {int(t): rng.randrange(4, 9) for t in token}
    ids = pa.array(range(len(texts)), pa.int64())
    summary = next(nj._summaries(iter([pa.RecordBatch.from_arrays([ids, pa.array(texts)], ["doc_id", "text"])]), 1))
    d1 = summary["d1"].to_numpy().copy()
    d1[5] += 1  # a row with another's id
    batch = pa.RecordBatch.from_arrays([ids, pa.array(texts), pa.array(d1), ids, ids], ["doc_id", "text", "d1", "grp", "members"])
    order = type("order", (), {"value": (token, np.array([often[int(t)] for t in token], np.int64))})
    got = sorted((r["doc_id"], r["np"] & 0xFFFFFFFF, r["np"] >> 32, r["token"] % 2**64) for out in nj._prefixes(iter([batch]), 1, 60, order, 4096) for r in out.to_pylist())
    want = []
    for i, s in enumerate(sets):
        if len(s) and i != 5:
            kept = sorted((often.get(int(x), 0), int(x)) for x in s)[: nj.probing(len(s), 60)]
            want += [(i, k, len(s), x) for k, (_, x) in enumerate(kept)]
    assert got == want


def test_no_block_is_met_twice_where_a_query_has_few(spark, monkeypatch):
    rows = [(i, " ".join([f"a{i}w{k}" for k in range(9)] + [f"s{i // 2}w{k}" for k in range(20)]), "en", "s") for i in range(40)]
    met, real = [], nj._far

    def far(docs, placed, sizes, wanted, n, percent):
        met.extend((r.doc_id, r.grp, r.part) for r in wanted.collect())
        return real(docs, placed, sizes, wanted, n, percent)

    monkeypatch.setattr(nj, "_far", far)
    got = nj.ngram_components(build(spark, rows), 5, 60).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: c for i, (_, c) in brute([r[:2] for r in rows], 5, 60).items()}
    assert met and len(met) == len(set(met))


def test_threshold_is_exact(spark):
    # ten shingles against nine of them and one other: 9 / 11 links at 80, 8 / 12 does not
    base = [f"a{i}" for i in range(14)]
    rows = [(1, " ".join(base)), (2, " ".join([*base[1:], "x"])), (3, " ".join(["p", "q", *base[2:]]))]
    got = {r.doc_id: r.component_id for r in nj.ngram_components(build(spark, [(i, t, "en", "s") for i, t in rows])).collect()}
    want = {i: c for i, (_, c) in brute(rows, 5, 80).items()}
    assert got == want == {1: 1, 2: 1, 3: 3}


def test_prefixes_are_sufficient():
    for percent in (50, 60, 80, 90, 100):
        for n in range(1, 200):
            assert nj.probing(n, percent) == n - -(-percent * n // 100) + 1
            assert nj.indexing(n, percent) == n - -(-2 * percent * n // (100 + percent)) + 1


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (7, 8)], "u long, v long")
    assert {r.component for r in components(edges).collect()} == {0}
    assert components(edges.where("false")).count() == 0


def test_one_of_each_is_the_same_however_rows_are_dealt(spark):
    rows = [(1, "a b c d e f", "en", "s"), (1, "a b c d e f", "de", "s"), (2, "a b c d e f", "en", "s"), (3, "p q r s t", "en", "s"), (3, "u v w x y", "en", "s"), (4, None, "en", "s"), (None, "a b c d e f", "en", "s")]
    kept = [sorted((r.doc_id or 0, r.text or "") for r in nj.one_of_each(build(spark, of)).collect()) for of in (rows, rows[::-1])]
    assert kept[0] == kept[1] and [i for i, _ in kept[0]] == [0, 1, 3, 4]
