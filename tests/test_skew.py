"""Hot keys and long groups against plain models."""

import random

import pytest

from sievework.operators import skew


@pytest.mark.parametrize("hot", [0, 3, 10_000])
def test_join_with_hot_keys(spark, hot):
    r = random.Random(1)
    rows = [(i, r.choice(["a", "a", "a", "b", "c", "z", None])) for i in range(300)]
    side = [("a", 1), ("b", 2), ("c", None), ("d", 4), (None, 5)]
    got = skew.join_unique(spark.createDataFrame(rows, "i long, k string"), spark.createDataFrame(side, "k string, v int"), ["k"], hot)
    want = sorted((k, i, dict(side)[k]) for i, k in rows if k in ("a", "b", "c"))
    assert sorted((x["k"], x["i"], x["v"]) for x in got.collect()) == want
    assert skew.join_unique(spark.createDataFrame([], "i long, k string"), spark.createDataFrame(side, "k string, v int"), ["k"]).count() == 0


def test_numbers_within_groups(spark):
    r = random.Random(2)
    rows = [(r.randrange(10**6), i) for i in range(2000)] + [(None, 5000), (None, 5001)]
    df = spark.createDataFrame([(None if t is None else t // 300_000, t, i) for t, i in rows], "g long, t long, i long").repartition(6)
    got = {x["i"]: x["n"] for x in skew.numbered(df, "g", ["t", "i"]).collect()}
    groups = {}
    for t, i in rows:
        groups.setdefault(None if t is None else t // 300_000, []).append((t or 0, i))
    assert got == {i: k for g in groups.values() for k, (_, i) in enumerate(sorted(g), 1)}
    assert skew.numbered(df.limit(0), "g", ["t", "i"]).count() == 0
