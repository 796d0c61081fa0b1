"""Every operator and stage on awkward rows, and on none."""

from collections import Counter

import pytest

from parlance.llm import kneser_ney, langid, mixing, mpeg_audio, ngram_join, packing, quality, sharding, token_counts, toxicity
from parlance.llm.common import new_path

from .conftest import CLASHING, TEXTS


def labels(spark, rows=((4, 1), (7, 0), (8, 0), (10, 1), (99, 1), (None, 1), (5, None))):
    return spark.createDataFrame(list(rows), "doc_id long, toxic int")


BY_ROW = {
    "components": lambda d: ngram_join.ngram_components(d),
    "toxicity": lambda d: toxicity.toxicity(d, labels(d.sparkSession)),
    "tokens": lambda d: token_counts.token_counts(d),
    "model": lambda d: kneser_ney.scored(d),
    "quality": lambda d: quality.assessed(d),
    "language": lambda d: langid.identify(d),
    "audio": lambda d: mpeg_audio.media_features(mpeg_audio.media_table(d)),
    "mixing": lambda d: mixing.with_copies(d),
}


@pytest.mark.parametrize("name", BY_ROW)
def test_one_row_for_each(spark, edge, none, name):
    ids = Counter(r.doc_id for r in BY_ROW[name](edge).select("doc_id").collect())
    assert ids == Counter(t[0] for t in TEXTS)
    assert BY_ROW[name](none).count() == 0


def test_packing(edge, none):
    got = packing.packed(edge).collect()
    assert {r.doc_id for r in got} == {t[0] for t in TEXTS} and sum(r.doc_id == 8 for r in got) == 2
    assert all(r.length == 1 for r in got if r.doc_id in (1, 2))
    assert packing.packed(none).count() == 0


@pytest.mark.parametrize("number", range(4))
def test_stages_keep_the_columns(spark, edge, none, tmp_path, number):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    stage = corpus_pipeline.STAGES[number][1]
    out = stage(spark, edge, str(tmp_path))
    assert out.columns == edge.columns and out.count() >= 6
    assert stage(spark, none, str(tmp_path)).count() == 0


def test_last_stage(spark, edge, none, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    stage = corpus_pipeline.STAGES[4][1]
    assert Counter(r.doc_id for r in stage(spark, edge, str(tmp_path)).where("piece = 0").collect()) == Counter(t[0] for t in TEXTS)
    assert stage(spark, none, str(tmp_path)).count() == 0


def test_sharding_keeps_everything(spark, edge, none):
    store = sharding.ShardStore(spark, new_path(spark, "edge"), edge.schema)
    assert store.read().count() == 0
    store.append(none)
    store.append(edge)
    store.settle()
    assert Counter(map(tuple, store.read().collect())) == Counter(map(tuple, edge.collect())) and len(CLASHING) > 5


def test_defined_values(edge):
    comp = {(r.doc_id, r.n_shingles): r.component_id for r in ngram_join.ngram_components(edge).collect()}
    assert comp[1, 0] == 1 and comp[2, 0] == 2 and comp[8, 5] == 7 and comp[None, 5] == 7 and comp[None, 4] is None and comp[4, 1] == 4
    lang = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(edge).collect()}
    assert lang[1] == lang[2] == lang[3] == lang[9] == ("und", 0.0)
    q = {r.doc_id: r for r in quality.assessed(edge).collect()}
    assert q[1].n_words == 0 and q[1].base_failed and not q[1].kept and q[11].n_dup_lines == 1 and q[11].n_symbols == 1
    audio = {r.doc_id: r for r in mpeg_audio.media_features(mpeg_audio.media_table(edge)).collect()}
    assert audio[1].payload == audio[2].payload == b"\xff" * 576 and audio[1].n_bytes == 0
