"""The pipeline against the effect of each stage, told from its input and output, and run() against plain Python."""

from collections import Counter, defaultdict

import pytest

from . import plain

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    from parlance.llm import langid, mixing, ngram_join, packing, toxicity
    from parlance.llm.common import read, stored

    docs = read(spark, SF, "documents")
    columns = docs.columns
    bad = {r.doc_id for r in toxicity.toxicity(docs, read(spark, SF, "labels")).collect() if r.predicted}
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stored(stage(spark, docs, SF), f"test-{number}")
        before, after = {r.doc_id for r in docs.select("doc_id").collect()}, [r.doc_id for r in out.select("doc_id").collect()]
        assert set(after) <= before
        if number < 4:
            assert out.columns == columns
        if number == 0:
            assert before - set(after) == bad
        if number == 1:
            told = {r.doc_id: r.lang for r in docs.collect()}
            gone = {r.doc_id for r in langid.identify(docs).collect() if r.lang_pred == "und" or (told[r.doc_id] and r.lang_pred != told[r.doc_id] and r.score >= 0.5)}
            assert before - set(after) == gone
        if number == 2:
            assert sorted(after) == sorted(r.doc_id for r in ngram_join.ngram_components(docs).where("component_id = doc_id").collect())
        if number == 3:
            assert set(after) == before
            assert {i: after.count(i) for i in before} == {r.doc_id: r.mix_copies for r in mixing.with_copies(docs).collect()}
        if number == 4:
            assert set(after) == before and out.columns == packing.packed(docs).columns
        docs = out
    assert [f for _, f in corpus_pipeline.STAGES] and corpus_pipeline.ORACLE_SQL is None


def test_run_equals_plain_python(spark, tmp_path):
    """All stages over a whole small table, each in plain Python from the rows that the plain stage before it kept."""
    import public_tokenizers
    from tokenizers import Tokenizer

    table = spark.read.parquet(f"{SF}/documents.parquet")
    told = table.collect()
    long = next(d.text for d in told if d.text and len(d.text) > 2000)
    more = [(10_001, None, "en", "src1", 0), (10_002, "", None, None, 0), (10_003, " 12 34 ", "en", "src1", 7), (10_004, long, None, None, len(long)), (10_005, long + " tail", None, "src1", len(long) + 5), (10_006, "two words", "en", None, 9)]
    spark.createDataFrame([*map(tuple, told), *more], table.schema).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")

    rows = [(d.doc_id, d.text, d.lang, d.source) for d in told] + [m[:4] for m in more]
    scores = plain.toxic_scores([r[:2] for r in rows], labels)
    kept = [r for r, score in zip(rows, scores, strict=True) if score < 0.5]
    assert len(kept) < len(rows)
    model = plain.Languages([r[:3] for r in kept])
    guessed = [(r, *model.guess(r[1])) for r in kept]
    spoken = [r for r, lang, cosine in guessed if lang is not None and (r[2] is None or lang == r[2] or cosine < 0.5)]
    assert len(spoken) < len(kept)
    first = plain.component_of([r[:2] for r in spoken])
    alone = [r for r in spoken if first[r[0]] == r[0]]
    assert len(alone) < len(spoken)
    used = plain.copies([(r[0], r[1], r[3]) for r in alone])
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r, n in zip(alone, used, strict=True):
        for piece in plain.pieces(r[0], r[1], lambda t: encode.encode(t, add_special_tokens=False).ids):
            want[piece] += n

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    short = sum(n * p[3] for p, n in want.items() if p[3] < 2048)
    whole = sum(n for p, n in want.items() if p[3] == 2048)
    assert len(sequences) <= whole + -(-short // 2048) + 1
