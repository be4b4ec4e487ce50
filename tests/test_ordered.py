import random

import pytest

from lexiloom.operators import ordered


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_lag_across_parts(spark, partitions):
    rng = random.Random(partitions)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), i, rng.choice(["x", "y", None])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, at int, v string").repartition(4)
    got = {(r["k"], r["at"]): (r["prev1"], r["prev2"]) for r in ordered.lagged(df, "k", ["at"], "v", 2, "<s>", partitions=partitions).collect()}
    want, seen = {}, {}
    for k, at, v in rows:
        past = seen.setdefault(k, [])
        want[k, at] = tuple(past[-j] if len(past) >= j else "<s>" for j in (1, 2))
        past.append(v)
    assert got == want


def test_empty(spark):
    assert ordered.lagged(spark.createDataFrame([], "k string, at int, v string"), "k", ["at"], "v", 1).count() == 0
