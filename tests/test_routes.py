"""Routes of drafts and what is made of them against their SQL, on texts that the tables hardly have."""

import duckdb
import pytest

from parlance import registry

from .test_queries import rows

TEXTS = ["", " ", "\n\t", "\x0b", "{\x0bname}", "{ name }", "<name>", "PROM\u0130SE", "so it is guaranteed then", "we'll refund you", "answered within 24 hours", "I promise", "see www.x.org", "call 1234567", "x" * 280, "x" * 281, "plain", None]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    data = [(2 * i + 1, x, "en", "src1", len(x or "")) for i, x in enumerate(TEXTS)] + [(2 * i, x, "en", "src1", len(x or "")) for i, x in enumerate(TEXTS)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    return folder, con


@pytest.mark.parametrize("name", ["draft_routing", "probe_detection"])
def test_equals_sql_on_odd_texts(spark, odd, name):
    folder, con = odd
    df = registry.queries()[name](spark, folder)
    want = con.execute(registry.oracle_sql()[name])
    assert rows(df.columns, df.collect()) == rows([c[0] for c in want.description], want.fetchall())
