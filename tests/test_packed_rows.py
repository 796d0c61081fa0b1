"""Packed rows of terms come back as they were, in fewer bytes."""

import numpy as np
import pyarrow as pa
import pytest

from parlance.operators import search


@pytest.mark.parametrize("n", [0, 1, 50_000])
def test_rows_are_small_and_whole(n):
    rng = np.random.default_rng(1)
    term = np.sort(rng.integers(-(2**63), 2**63 - 1, n))
    tf, ids, idf = rng.integers(1, 3, n).astype(np.int32), rng.integers(0, 60_000, n), rng.choice([9.5, 8.25, 7.125], n)
    row = search._rows(["block", "ids", "terms", "tfs", "idfs"], [(3, ids, term, tf, idf)] * 2)
    table = pa.Table.from_batches([row])
    for name, kind, x in (("ids", np.int64, ids), ("terms", np.int64, term), ("tfs", np.int32, tf), ("idfs", float, idf)):
        assert np.array_equal(search._joined(table, name, kind), np.concatenate([x, x]))
    assert not n or n < 100 or row.nbytes < 2 * n * 11  # 28 bytes an entry as they are


def test_frequencies_are_shuffled_packed(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 11}" for j in range(i % 7))) for i in range(40)], "id long, text string").repartition(3)
    bags = search.bags(docs)
    small = search.USUAL._replace(packed=30, counted=20)
    df = {}
    for r in bags.collect():
        for term in r.terms:
            df[term] = df.get(term, 0) + 1
    found = search.vocabulary(bags, 40, 2, small)
    assert {r.term: round(r.idf, 12) for r in found.collect()} == {t: round(float(np.log(41 / (1 + n)) + 1), 12) for t, n in df.items() if n >= 2}
    assert "FlatMapGroupsInArrow" in found._jdf.queryExecution().analyzed().toString() and search.vocabulary(bags.where("id < 0"), 0, 2).count() == 0
