import pytest
from pyspark.sql import types as T

# columns named like those the operators use inside
CLASHING = ("n", "grp", "token", "score", "block", "key", "salt", "_rows", "mix_key", "g", "x0")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *(T.StructField(c, T.StringType()) for c in CLASHING)])

LONG = " ".join(f"w{i % 997}q{i % 13}" for i in range(30_000))
TEXTS = [
    (1, None, "en", "s1"), (2, "", None, "s1"), (3, " \n\t ", "en", None), (4, "one two", None, None), (5, LONG, "en", "s1"), (6, LONG + " more", "de", "s2"), (7, "the quick brown fox jumps over the lazy dog", "en", "s2"),
    (8, "The Quick brown fox jumps over the lazy dog", "en", "s2"), (8, "The Quick brown fox jumps over the lazy dog", "en", "s2"), (None, "the quick brown fox jumps over the lazy dog", "en", "s1"), (None, "no id and no twin at all here", "en", "s1"),
    (9, "1234 5678 !!", "en", "s1"), (10, "der hund und die katze sind im haus und der garten", "de", "s2"), (11, "line one here\nline one here\nother\x1fline € ünï #tag", "de", "s2"),
]


def build(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t), *("1",) * len(CLASHING)) for i, t, lang, src in rows], SCHEMA)


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names."""
    return build(spark, TEXTS)


@pytest.fixture(scope="session")
def none(spark):
    return build(spark, [])
