"""A vocabulary too long for a broadcast gives the same vectors, from packed rows."""

import random

from parlance.operators import search


def test_long_vocabulary(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i * 2, " ".join(f"w{rng.randrange(30)}" for _ in range(rng.randrange(0, 20)))) for i in range(60)], "id long, text string").repartition(3)
    bags = search.bags(docs)
    table = search.vocabulary(bags, 60, 2)
    small = search.USUAL._replace(vocabulary=0, packed=40, counted=25)
    plan = search.vectors(bags, table, small)._jdf.queryExecution().analyzed().toString()
    assert "explode" not in plan.lower() and "collect_list" not in plan.lower()
    of = lambda bounds: {r.id: (r.terms, r.tf, [round(x, 12) for x in r.raw], round(r.norm, 12)) for r in search.vectors(bags, table, bounds).collect()}
    assert of(small) == of(search.USUAL) and len(of(small)) > 50
