"""A kept table is the one that was built, not a copy of it."""

from parlance.sources import tables


def test_kept_copy_is_moved(spark, tmp_path):
    spark.range(5).write.parquet(f"file://{tmp_path}/in")
    source, made = spark.read.parquet(f"file://{tmp_path}/in"), []
    build = lambda d: made.append(tables.stored(d, "moved")) or made[0]
    got, hit = tables.cached(source, "moved-test", "1", build, move=True)
    again, twice = tables.cached(source, "moved-test", "1", build, move=True)
    assert not hit and twice and len(made) == 1 and got.count() == again.count() == 5
    assert not tables.exists(spark, made[0].inputFiles()[0].rpartition("/")[0])
