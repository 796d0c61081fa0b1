"""Pair queries are whole: every text that differs from another is linked in the result itself."""

from parlance.operators import dedup
from parlance.queries import sampling


def test_links_within_a_class_are_in_the_result(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a  b\tc d"), (3, "a b c d a b c d e"), (5, "a b c d "), (4, None), (6, " ")], "id long, text string")
    got = sorted(tuple(r) for r in dedup.similar(docs, None, 80).linked().collect())
    assert got == [(1, 2, 2, 2, 2), (1, 5, 2, 2, 2)]


def test_every_copy_is_crossed(spark, tmp_path):
    passage = "one two three four five six"
    spark.createDataFrame([(1, passage), (2, passage), (3, "other words altogether here")], "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, passage), (8, passage + " ")], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    got = sorted(tuple(r) for r in sampling.neardup_cross(spark, f"file://{tmp_path}").collect())
    assert got == [(1, 7, 4), (1, 8, 4), (2, 7, 4), (2, 8, 4)]
    assert sorted((r.a, r.b, r.jaccard) for r in sampling.jaccard_pairs(spark, f"file://{tmp_path}").collect()) == [(1, 2, 1.0)]


def test_shingles_are_not_shuffled_for_their_order(spark):
    """Sets come from rare to frequent, in one order for both sides, from a fixed number of counts."""
    docs = spark.createDataFrame([(i, f"same words here x{i} y{i} z{i}") for i in range(30)], "id long, text string")
    sets = dedup.shingle_sets(docs)
    left, right = dedup._rare_first([sets.where("id % 2 = 0"), sets.where("id % 2 = 1")])
    rows = [r.s for r in left.unionByName(right).collect()]
    assert len({s[-1] for s in rows}) == 1 and all(len(s) == 4 for s in rows)
    assert "Exchange" not in left._jdf.queryExecution().executedPlan().toString()
