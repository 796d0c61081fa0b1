"""Classifiers, the language model, counts, packing, mixing, shards and media against plain Python."""

import hashlib
import itertools
import math
import random
import re
import struct
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from parlance.llm import kneser_ney as kn
from parlance.llm import langid, mixing, mpeg_audio as mp, packing, quality, sharding, token_counts, toxicity
from parlance.llm.common import new_path, slices, word_hashes, word_spans

from .conftest import LONG, TEXTS, build


def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def test_words_of_slices(monkeypatch):
    texts = ["", None, " a  B\tc\x0bd\x0ce\rf\ng ", "é\x1f\x85x", "tail"]
    data, offs = next(iter(slices(pa.array(texts))))[2:]
    s, e, b = word_spans(data, offs)
    got = [[data[x:y].tobytes() for x, y in zip(s[i:j], e[i:j], strict=True)] for i, j in zip(b[:-1], b[1:], strict=True)]
    assert got == [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]
    h = word_hashes(*[np.frombuffer(b"Ab aB ba", np.uint8), np.array([0, 3, 6]), np.array([2, 5, 8])])
    assert h[0] == h[1] != h[2]


def test_toxicity_learns_words(spark):
    rng = random.Random(1)
    rows = [(i, " ".join([f"w{rng.randrange(300)}" for _ in range(40)] + (["vile"] if i % 4 == 0 else [])), "en", "s") for i in range(600)]
    docs = build(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    held = [r for r in got if r.held_out]
    assert held and all(r.predicted == (r.doc_id % 4 == 0) for r in held) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 for r in got)


def test_toxicity_sees_words_under_punctuation(spark):
    rng = random.Random(1)
    rows = [(i, " ".join([f"w{rng.randrange(300)}" for _ in range(40)] + (["vile"] if i % 4 == 0 else [])), "en", "s") for i in range(600)]
    held = [i for i in range(600, 800) if zlib.crc32(str(i).encode()) % 5 == 0]
    forms = ["vile!!", "##Vile", "(vile),", "vile***"]
    rows += [(i, " ".join([f"w{rng.randrange(300)}" for _ in range(40)] + [forms[i % 4]]), "en", "s") for i in held]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.toxicity(build(spark, rows), labels).collect()}
    assert held and all(got[i] for i in held)


def test_bare_words_have_the_slots_of_their_words():
    sets = [set(slot.tolist()) for x in ("one two three", "(one) two!! ##three", "--- !! ---") for _, slot, _ in toxicity.features(pa.array([x], pa.string()))]
    assert sets[0] < sets[1] and len(sets[2]) == 5
    text = ["a! b", None, "", "c", "!d. e f", "é! ü"]
    together = next(iter(toxicity.features(pa.array(text))))
    for i, x in enumerate(text):
        alone = next(iter(toxicity.features(pa.array([x], pa.string()))))
        assert sorted(together[1][together[0] == i]) == sorted(alone[1])


def test_language_accuracy(spark):
    docs = documents(spark)
    lang = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in langid.identify(docs).collect() if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def test_bundles_are_sums():
    enc = langid.Encoder(256)
    keys, counts = langid.gram_counts("Abc abd é 12 \U00010400")
    assert np.array_equal(enc.encode("Abc abd é 12 \U00010400"), sum(c * enc.bound(int(k)).astype(float) for k, c in zip(keys, counts, strict=True)))


def test_model_equals_plain_python(spark):
    docs = documents(spark)
    text = {r.doc_id: r.text for r in docs.collect()}
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    toks = {i: [*re.findall(rb"[^\x20\x09-\x0D]+", t.encode().translate(low)), "end"] for i, t in text.items()}
    train = [i for i in toks if zlib.crc32(str(i).encode()) % 7 != 2]
    one, two = Counter(w for i in train for w in toks[i]), Counter(p for i in train for p in zip(["start", *toks[i]], toks[i], strict=False))
    n, v = sum(one.values()), len(one)
    follows, total = Counter(b for _, b in two), Counter()
    for (a, _), c in two.items():
        total[a] += c
    of = lambda cs: kn.discounts(*(sum(c == k for c in cs.values()) for k in (1, 2, 3, 4)))
    d1, d2 = of(follows), of(two)
    cut = lambda d, c: d[min(c, 3) - 1] if c else 0
    kept = Counter()
    for (a, _), c in two.items():
        if c >= kn.MIN_COUNT:
            kept[a] += (c - cut(d2, c)) / total[a]
    types = sum(follows.values())
    spare = sum(cut(d1, c) for c in follows.values()) / types

    def p(a, b):
        p1 = max(follows[b] - cut(d1, follows[b]), 0) / types + spare / (v + 1)
        if not total[a]:
            return p1
        c = two[a, b] if two[a, b] >= kn.MIN_COUNT else 0
        return max(c - cut(d2, c), 0) / total[a] + (1 - kept[a]) * p1

    assert sum(p(b"the", w) for w in one) + p(b"the", b"never seen") == pytest.approx(1)
    for r in kn.scored(docs).collect():
        w = toks[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(one[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w))
        assert r.score == pytest.approx(sum(math.log10(p(a, b)) for a, b in zip(["start", *w], w, strict=False)))


def test_pairs_seen_once_are_stored(spark):
    texts = [f"a{i} b{i} c{i % 3} d" for i in range(40)]
    model = kn.train(build(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]))
    two = Counter(p for t in texts for p in zip(["start", *t.split()], [*t.split(), "end"], strict=True))
    assert sum(two.values()) - len(two) and sum(len(kn.arrays(model["folder"], f"pairs-{b}", "u8", "u4")[0]) for b in range(model["buckets"])) == len(two)
    # b5 and b6 occur alike, so only the pair (a5 b5), once after the only a5, tells the two texts apart
    seen, never = (kn.score_slice(model, np.frombuffer(x, np.uint8), np.array([0, len(x)]))[3][0] for x in (b"a5 b5", b"a5 b6"))
    assert 0 < model["d2"][0] < 1 and 10 ** (never - seen) < model["d2"][0]


def test_piece_counts():
    vocabulary = [b"ab", b"abcd", b"bc", b"bcde", b"cdx", "é".encode(), token_counts.MARK + b"ab"]
    pieces = {*vocabulary, *(bytes([b]) for b in range(256))}

    def greedy(word):
        n = at = 0
        while at < len(word):
            at += max(k for k in range(1, 9) if word[at : at + k] in pieces and at + k <= len(word))
            n += 1
        return n

    automaton, rng = token_counts.Automaton(vocabulary), random.Random(2)
    for _ in range(5000):
        word = bytes(rng.choice(b"abcdex\xc3\xa9") for _ in range(rng.randrange(20)))
        assert automaton.count(word) == greedy(word)
    assert automaton.count(b"abcd" * 100_000) == 100_000


def counts(text):
    text = text or ""
    w, seen, dup = re.findall(r"[^\x20\x09-\x0D]+", text), set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams, cover = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7)), set()
    for i in range(len(w) - 7):
        if grams[tuple(w[i : i + 8])] > 1:
            cover.update(range(i, i + 8))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)


def test_quality_counts():
    texts = [t for _, t, _, _ in TEXTS] + ["a\n a\na \na\r\na\na", "\n\n\n", "x y z a b c d e " * 3, "end\nno newline"]
    got = quality.text_counts(pa.array(texts))
    assert [tuple(int(got[k][i]) for k in quality.COUNTS) for i in range(len(texts))] == [counts(t) for t in texts]


def test_outliers_go_and_clean_rows_stay(spark):
    rng = random.Random(5)
    clean = [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(40, 400))), "en", "s") for i in range(500)]
    bad = [(1000 + i, " ".join(f"{rng.randrange(10**6)}###&&&" for _ in range(60)), "en", "s") for i in range(60)]
    got = {r.doc_id: r.kept for r in quality.assessed(build(spark, clean + bad)).collect()}
    assert all(got[i] for i in range(500)) and not any(got[1000 + i] for i in range(60))


def test_least_determinant_against_every_subset(spark):
    """Of fourteen rows eleven are kept; the least determinant of all subsets of eleven is found, or nearly."""
    names, near = [f"x{i}" for i in range(6)], 0
    sets = {f"g{seed}": np.random.default_rng(seed).normal(0, 0.3, (14, 6)) + np.array([5, 5, 0.2, 0.2, 0.1, 0.1]) for seed in range(6)}
    for x in sets.values():
        x[:3, :2] += 6
    rows = spark.createDataFrame([(g, *map(float, r)) for g, x in sets.items() for r in x], ["g", *names])
    found = {r.g: r for r in quality.concentrated(rows).collect()}
    scale = quality.HALF / quality.chi2_cdf(quality.chi2_quantile(quality.HALF, 6), 8)
    size = lambda scatter: np.linalg.slogdet(scatter + quality._LEAST)[1]
    for g, x in sets.items():
        least = min(size(np.cov(x[list(c)].T, bias=True) * scale) for c in itertools.combinations(range(14), 11))
        got = size(quality._square(found[g].scatter))
        assert got - least < 0.3 and found[g].mean[0] < 6
        near += abs(got - least) < 1e-6
    assert near >= 3


def test_a_small_group_borrows_from_a_large_one():
    mean, scatter, wide = np.zeros(6), np.eye(6), np.full(6, 3.0)
    for rows, share in ((0, 0.0), (200, 0.5), (10**9, 1.0)):
        m, s = quality._drawn(rows, mean, scatter, wide, 2 * np.eye(6), 200.0)
        assert m == pytest.approx((1 - share) * wide, abs=1e-5) and s[0, 0] == pytest.approx(share + 2 * (1 - share) + 9 * share * (1 - share), abs=1e-4)


def test_chi_squared():
    assert quality.chi2_cdf(quality.chi2_quantile(0.975, 6), 6) == pytest.approx(0.975)
    assert quality.chi2_quantile(0.95, 2) == pytest.approx(-2 * math.log(0.05))


def test_packing_is_whole_and_tight(spark):
    tokenizers = pytest.importorskip("tokenizers")
    docs = documents(spark).select("doc_id", "text")
    got = packing.packed(docs).collect()
    bpe = tokenizers.Tokenizer.from_file(packing.default_path())
    ids = {r.doc_id: [*bpe.encode(r.text, add_special_tokens=False).ids, 0] for r in docs.collect()}
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
    for doc, of in {d: sorted((r for r in got if r.doc_id == d), key=lambda r: r.piece) for d in ids}.items():
        assert [r.piece for r in of] == list(range(len(of))) and sum(r.length for r in of) == len(ids[doc]) and all(r.length == 2048 for r in of[1:])
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert b[0][0] == 0 and all(x + n == y for (x, n), (y, _) in zip(b[:-1], b[1:], strict=True)) and sum(n for _, n in b) <= 2048
    assert len(bins) <= -(-sum(map(len, ids.values())) // 2048) + 2


def test_special_text_has_the_tokenizers_ids():
    tokenizers = pytest.importorskip("tokenizers")
    bpe = tokenizers.Tokenizer.from_file(packing.default_path())
    for text in ("a<|endoftext|>b", "", " \n\t x", "日本語 😀", LONG[:2000]):
        assert packing.token_ids(text, packing.default_path()).tolist() == bpe.encode(text, add_special_tokens=False).ids


def fewest(sizes, capacity):
    """The least number of bins, by trying every packing."""
    best = len(sizes)

    def place(rest, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if not rest:
            best = len(bins)
            return
        for i in {b: i for i, b in enumerate(bins) if b + rest[0] <= capacity}.values():
            place(rest[1:], [*bins[:i], bins[i] + rest[0], *bins[i + 1 :]])
        place(rest[1:], [*bins, rest[0]])

    place(sorted(sizes, reverse=True), [])
    return best


def test_packing_against_every_packing():
    rng = random.Random(1)
    for _ in range(300):
        capacity = rng.choice([10, 20, 30])
        sizes = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 9))]
        bins = packing.pack(sizes, capacity)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes))) and max(sum(sizes[i] for i in b) for b in bins) <= capacity
        assert packing.least_bins(sizes, capacity) <= fewest(sizes, capacity) <= len(bins) <= len(packing.best_fit(sizes, capacity))


@pytest.mark.parametrize(("bins", "capacity"), [
    ([[4, 3], [4, 3], [2, 1]], 10),  # two moves
    ([[6, 3], [7, 2], [4, 1, 1]], 12),  # pieces of the last bin find room one by one
    ([[5, 3], [6, 2], [4]], 10),  # the four goes for the three or the two, which then find room
    ([[6, 3], [2, 2]], 13),  # a move and an exchange
    ([[8], [7, 1], [2, 2]], 10),  # a two goes in, the other goes for the one
])
def test_exchanges_empty_a_bin(bins, capacity):
    sizes = [x for b in bins for x in b]
    numbers = iter(range(len(sizes)))
    first = [[next(numbers) for _ in b] for b in bins]
    after = packing.local_search(first, sizes, capacity)
    assert len(after) == fewest(sizes, capacity) < len(bins) and sorted(i for b in after for i in b) == list(range(len(sizes)))


def test_many_short_pieces_end():
    sizes = [1025] * 40 + [2] * 10_000
    start = time.process_time()
    assert len(packing.pack(sizes, 2048)) == 40 and time.process_time() - start < 5


def test_squared_fill_grows(monkeypatch):
    seen = []
    listed = packing.Bins.list
    monkeypatch.setattr(packing.Bins, "list", lambda self, b: (listed(self, b), seen.append(sum(f * f for f in self.fill)))[0])
    sizes = np.random.default_rng(3).integers(300, 900, 300).tolist()
    packing.pack(sizes, 2048)
    assert len(set(seen)) > 20 and seen == sorted(seen)


def test_local_search_gains():
    sizes = np.random.default_rng(1).integers(500, 1000, 1500).tolist()
    first = packing.best_fit(sizes, 2048)
    before = len(first)
    bins = packing.local_search(first, sizes, 2048)
    assert len(bins) < before and sorted(i for b in bins for i in b) == list(range(1500)) and max(sum(sizes[i] for i in b) for b in bins) <= 2048


def test_mixing_equals_plain_python(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text))) for r in docs.collect()]
    share = Counter()
    for _, s, n in rows:
        share[s] += n
    names = sorted(share)
    w = mixing.weights([share[s] for s in names], mixing.exponent([share[s] for s in names], 1.4))
    budget = mixing.whole_budget([share[s] for s in names], w)
    want = {}
    for s, x in zip(names, w, strict=True):
        passes, part = divmod(round(budget * x), share[s])
        key = lambda d: int(hashlib.md5(f"{mixing.SEED}:{passes}:{d}".encode()).hexdigest()[:13], 16)  # noqa: B023, E731
        total, open_ = 0, True
        for d, _, n in sorted((r for r in rows if r[1] == s), key=lambda r: key(r[0])):
            open_ = open_ and total + n <= part
            total += n
            want[d] = passes + open_
    assert {r.doc_id: r.mix_copies for r in mixing.with_copies(docs, max_repeats=1.4).collect()} == want


def test_mixing_order(spark, monkeypatch):
    """Every block of the run holds each source at about its weight, and later passes stand later."""
    monkeypatch.setattr(mixing, "RUN_BLOCKS", 8)
    rows = [(i, "w " * 10, "en", f"s{min(i % 16, 2)}") for i in range(4000)]
    docs = build(spark, rows)
    run = mixing.scheduled(docs, max_repeats=3.0).collect()
    share = {r.source: r.mix_weight for r in mixing.with_copies(docs, max_repeats=3.0).collect()}
    assert Counter(r.doc_id for r in run) == {r.doc_id: r.mix_copies for r in mixing.with_copies(docs, max_repeats=3.0).collect()}
    for block in range(8):
        held = Counter(r.source for r in run if r.mix_block == block)
        assert sum(held.values()) == pytest.approx(len(run) / 8, rel=0.1)
        assert all(held[k] / sum(held.values()) == pytest.approx(w, rel=0.25) for k, w in share.items())
    for of in {d: sorted((r.mix_pass, r.mix_block) for r in run if r.doc_id == d) for d in range(0, 4000, 97)}.values():
        assert [p for p, _ in of] == list(range(len(of))) and [b for _, b in of] == sorted(b for _, b in of)  # later passes stand later
    keys = {(r.mix_pass, r.mix_place) for r in run}
    assert len(keys) == len(run)
    for r in mixing.blocks(docs, max_repeats=3.0).select("_doc.doc_id", "blocks").collect()[:50]:
        assert sorted(r.blocks) == sorted(x.mix_block for x in run if x.doc_id == r.doc_id)


@pytest.mark.parametrize("limits", [{"max_repeats": 1.4}, {"max_repeats": 1e9, "max_entropy": 2.5, "budget": 5e4}])
def test_mixing_by_table_equals_mixing_on_the_driver(spark, monkeypatch, limits):
    docs = documents(spark)
    want = {r.doc_id: (r.mix_copies, round(r.mix_weight, 9)) for r in mixing.with_copies(docs, **limits).collect()}
    monkeypatch.setattr(mixing, "PLAN_ROWS", 3)
    monkeypatch.setattr(mixing, "SALTS", 2)
    assert {r.doc_id: (r.mix_copies, round(r.mix_weight, 9)) for r in mixing.with_copies(docs, **limits).collect()} == want


def test_many_sources_on_the_driver():
    """50,000 sources take about as long as 50 times 1,000."""
    tokens = [1 + (i * i) % 9973 for i in range(50_000)]
    start = time.process_time()
    w = mixing.weights(tokens, mixing.exponent(tokens, 2.0))
    assert time.process_time() - start < 5 and sum(w) == pytest.approx(1)


def test_exponent_limits():
    t = [1000, 100, 10]
    a = mixing.exponent(t, 2.0)
    w = mixing.weights(t, a)
    assert max(mixing.whole_budget(t, w) * x / n for x, n in zip(w, t, strict=True)) == pytest.approx(2.0)
    a = mixing.exponent(t, 1e9, max_entropy=0.8)
    assert -sum(x * math.log(x) for x in mixing.weights(t, a)) == pytest.approx(0.8)
    assert mixing.exponent(t, 1e9) == 0 and mixing.exponent([], 2) == 0


def shard_store(spark):
    df = spark.range(4000).selectExpr("id", "repeat(md5(cast(id as string)), 3) as text")
    return df, sharding.ShardStore(spark, new_path(spark, "shards"), df.schema, target_bytes=150_000)


def test_shards(spark):
    df, store = shard_store(spark)
    for a in range(4):
        store.append(df.where(f"id % 4 = {a}").coalesce(2))
    old = store.version()
    before = store.shards(old)
    after = store.shards(store.settle())
    assert sum(s.files for s in after) < sum(s.files for s in before) and sum(s.rows for s in after) == 4000 and not store.tiers(after)
    assert store.read(old).count() == 4000  # older versions still read
    with pytest.raises(sharding.Conflict):
        store.commit(before, old)
    store.vacuum()
    assert store.read(old).count() == 4000  # within the grace
    store.vacuum(grace=-3600)
    assert store.versions() == [store.version()]
    with pytest.raises(sharding.Conflict):
        store.commit(before, old - 1)  # its number stays taken
    assert sorted(map(tuple, store.read().collect())) == sorted(map(tuple, df.collect())) and store.settle() == store.version()


def test_vacuum_spares_a_writer_before_its_commit(spark):
    df, store = shard_store(spark)
    for a in range(3):
        store.append(df.where(f"id % 4 = {a}").repartition(2))
    other = sharding.ShardStore(spark, store.root, df.schema, store.target)
    written = other._written(df.where("id % 4 = 3"), 0)
    store.settle()
    store.vacuum()
    now, live = other.newest()
    other.commit([*live, *written], now)
    assert sorted(map(tuple, store.read().collect())) == sorted(map(tuple, df.collect()))
    lost = other._written(df.limit(3), 0)[0].path
    store.vacuum(grace=3600)
    assert spark.read.parquet(lost).count() == 3
    store.vacuum(grace=-3600)
    assert not store._fs().exists(store._path(lost)) and store.read().count() == 4000


def test_commits_and_a_vacuum_between_check_and_rename(spark, monkeypatch):
    """Writer A looks, B commits twice and vacuums, A renames: A's rows must not end in a version that nobody reads."""
    df, a = shard_store(spark)
    a.append(df.where("id % 4 = 0"))
    b, looked, real = sharding.ShardStore(spark, a.root, df.schema, a.target), [], a.version

    def version():
        now = real()
        if len(looked) < 2:
            looked.append(now)
            if len(looked) == 2:  # the check before the rename has its answer
                b.append(df.where("id % 4 = 1"))
                b.append(df.where("id % 4 = 2"))
                b.vacuum()
        return now

    monkeypatch.setattr(a, "version", version)
    assert a.append(df.where("id % 4 = 3")) == 4 and looked == [1, 1]
    assert sorted(map(tuple, b.read().collect())) == sorted(map(tuple, df.collect())) and b.version() == 4
    b.vacuum()
    assert b.read().count() == 4000


def test_settle_tries_again_after_another_commit(spark, monkeypatch):
    df, store = shard_store(spark)
    for a in range(3):
        store.append(df.where(f"id % 4 = {a}").repartition(2))
    real, other = store.commit, sharding.ShardStore(spark, store.root, df.schema, store.target)

    def late(shards, after):
        if store.version() == 3:
            other.append(df.where("id % 4 = 3"))
        return real(shards, after)

    monkeypatch.setattr(store, "commit", late)
    store.settle()
    assert store.version() > 4 and not store.tiers(store.newest()[1])
    assert sorted(map(tuple, store.read().collect())) == sorted(map(tuple, df.collect()))


def frame(kbits, padding=0, protected=True, body=b""):
    index = mp.KBITS[1, 3].index(kbits)
    word = bytes([0xFF, 0xFA if protected else 0xFB, index << 4 | padding << 1, 0xC0])
    h = mp.parse_header(word)
    head = word + (struct.pack(">H", mp.crc16(word[2:] + bytes(17))) if protected else b"") + bytes(17)
    return (head + body).ljust(h.length, b"\0")


def test_audio_reader():
    assert mp.parse_header(b"\xff\xfb\x90\x00").length == 417 and mp.parse_header(b"\xff\xfb\x92\x00").length == 418 and mp.parse_header(b"\xff\xff\x90\x00").layer == 1
    frames = [frame(128), frame(192, 1), frame(64, protected=False), frame(320)]
    xing = frame(128, body=b"Xing" + struct.pack(">IIII", 11, 4, 9, 55))
    data = b"ID3\x04\0\0" + bytes([0, 0, 0, 14]) + b"TIT2" + bytes([0, 0, 0, 4, 0, 0]) + b"\x03abc" + xing + frames[0] + b"\xff\xfbnoise\xff" + b"".join(frames[1:]) + b"TAG" + bytes(125)
    s = mp.read_stream(data)
    assert s.tags["TIT2"] == "abc" and len(s.offsets) == 4 and s.table["frames"] == 4 and s.table["quality"] == 55
    assert s.samples == 4 * 1152 and s.micros == 4 * 1152 * 1_000_000 // 44100 and s.skipped == 8 and (s.checked, s.failed) == (4, 0)
    broken = bytearray(data)
    broken[s.offsets[0] + 10] ^= 1
    assert mp.read_stream(bytes(broken)).failed == 1
    vbri = frame(128, protected=False)
    body = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, 999, 3, 2, 10, 2, 1) + struct.pack(">HH", 5, 6)
    vbri = vbri[:36] + body + vbri[36 + len(body) :]
    assert mp.read_stream(vbri + frames[2]).table == {"kind": "VBRI", "frames": 3, "bytes": 999, "quality": 75, "seek": [50, 60], "per_entry": 1}
    for junk in (b"", b"\xff", b"ID3", b"\xff\xfb\x90", bytes(1000), b"\xff" * 999):
        assert mp.read_stream(junk).offsets == []


def test_letters_of_a_tag_inside_the_last_frame_are_payload():
    text = b"x" * 1097 + b"TAG" + b"y" * 52
    payload = mp.padded(text)
    media = mp.write_stream(payload, len(text))
    assert media[-128:-125] == b"TAG" and len(payload) == len(text)
    s = mp.read_stream(media)
    assert mp.payload_of(media, s) == payload and s.skipped == 0 and s.table["frames"] == len(s.offsets) and "TIT2" not in s.tags
    tagged = mp.read_stream(media + b"TAG" + b"song".ljust(125, b"\0"))
    assert tagged.offsets == s.offsets and tagged.skipped == 0 and tagged.tags["TIT2"] == "song"
    cut = mp.read_stream(media[:-100] + b"TAG" + b"song".ljust(125, b"\0"))
    assert cut.offsets == s.offsets[:-1] and cut.tags["TIT2"] == "song"


@pytest.mark.parametrize("text", [b"", b"a", b"\xff\xfb\x90\xc0" * 300, "é日".encode() * 500, b"x" * 576])
def test_audio_round_trip(text):
    payload = mp.padded(text)
    media = mp.write_stream(payload, len(text))
    s = mp.read_stream(media)
    assert mp.payload_of(media, s) == payload and len(payload) % 576 == 0 and s.tags["n_bytes"] == str(len(text)) and s.skipped == s.failed == 0
    assert s.table["frames"] == len(s.offsets) == len(payload) // 576 and s.micros == len(s.offsets) * 24_000
