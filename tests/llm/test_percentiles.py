import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.llm import percentiles as P


def _error(v, d, qs=P.QUANTILES):
    return max(max(0.0, (v < x).mean() - q, q - (v <= x).mean()) for x, q in zip(P.quantile(d, qs), qs, strict=True))


@pytest.mark.parametrize("kind", ["lognormal", "uniform", "heap", "small", "constant", "two"])
def test_rank_error_is_bounded_after_merging(kind):
    r = np.random.default_rng(3)
    v = {"lognormal": np.floor(r.lognormal(4, 2, 60_000)), "uniform": r.random(50_000), "heap": np.where(r.random(50_000) < 0.6, 0.0, r.random(50_000)), "small": r.random(57), "constant": np.ones(999), "two": np.array([1.0, 2.0])}[kind]
    parts = [P.digest(x) for x in np.array_split(v, 13)]
    for d in (P.merged(parts), P.merged([P.merged(parts[:5]), P.merged(parts[5:])])):
        assert d[1].sum() == len(v) and len(d[0]) <= P.COMPRESSION
        assert _error(v, d) <= 4 / P.COMPRESSION


def test_nothing():
    nothing = P.merged([])
    assert np.isnan(P.quantile(nothing, [0.5])).all() and not len(P.digest(np.zeros(0))[0])


def test_groups_are_clustered_at_once():
    r = np.random.default_rng(8)
    code, v = r.integers(0, 40, 30_000), r.normal(size=30_000)
    codes, d = P.cluster(code, (v, np.ones(len(v)), v, v))
    for g in range(40):
        one, alone = tuple(x[codes == g] for x in d), P.digest(v[code == g])
        assert all(np.array_equal(a, b) for a, b in zip(one, alone, strict=True)) and _error(v[code == g], one) <= 2 / P.COMPRESSION


SCHEMA = "grp string, x double, y long, n long"


def _x():
    return {"x": (F.col("x"), -np.inf, np.inf)}


def _checked(out, rows, groups):
    for o in out:
        col = 1 if o["metric"] == "x" else 2
        of = [t for t in rows if all(t[i] == o[g] for g, i in groups.items())]
        v = np.array([t[col] for t in of if t[col] is not None and np.isfinite(t[col]) and (col == 1 or t[col] >= 0)], float)
        assert o["n"] == len(v) and o["n"] + o["n_invalid"] == len(of)
        if not len(v):
            assert o["value"] is None and o["rank_error"] is None
            continue
        assert o["n_below"] == (v < o["value"]).sum() and o["n_upto"] == (v <= o["value"]).sum()
        assert o["rank_error"] == pytest.approx(max(0, o["n_below"] / len(v) - o["q"], o["q"] - o["n_upto"] / len(v)))
        assert o["rank_error"] <= 0.01


@pytest.mark.parametrize("broadcast_groups", [P.BROADCAST_GROUPS, 0])
def test_certified_against_brute_force(spark, broadcast_groups):
    r = np.random.default_rng(5)
    rows = [(["a", "b", None][i % 3], float(r.normal()), int(r.integers(0, 5)), 7) for i in range(3000)]
    rows += [("a", float("nan"), None, 7), ("a", None, -1, 7), ("a", float("inf"), 3, 7), ("c", None, None, 7)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = P.certified(df, {"grp": "grp"}, {**_x(), "y": (F.col("y"), 0, np.inf)}, broadcast_groups=broadcast_groups).collect()
    assert len(out) == 4 * 2 * len(P.QUANTILES) and {o["grouping"] for o in out} == {"all"}
    _checked(out, rows, {"grp": 0})


def test_coarser_groups_come_from_finer_digests(spark, monkeypatch):
    r = np.random.default_rng(6)
    rows = [(["a", "b", None][int(r.integers(0, 3))], float(r.lognormal()), 0, int(r.integers(0, 50))) for _ in range(20_000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("n", "k").repartition(7)
    out = P.certified(df, {"grp": "grp", "k": "k"}, _x(), {"whole": (), "grp": ("grp",), "both": ("grp", "k")}).collect()
    by = {k: [o for o in out if o["grouping"] == k] for k in ("whole", "grp", "both")}
    assert {k: len(v) // len(P.QUANTILES) for k, v in by.items()} == {"whole": 1, "grp": 3, "both": 150}
    assert all(o["n"] != o["n_invalid"] for o in out) and max(o["rank_error"] for o in out) <= 0.01
    assert sum(o["n"] for o in by["both"]) == 20_000 * len(P.QUANTILES)


def test_more_groups_than_a_task_holds():
    held = P.Held(["g"], P.COMPRESSION)
    keys = [(str(i),) for i in range(5)]
    for k in range(30):
        v = np.random.default_rng(k).normal(size=100_000)
        codes = held.numbers(keys)[np.arange(len(v)) % 5]
        held.invalid[:5] += 1
        held.add(codes, (v, np.ones(len(v)), v, v))
        assert held.size <= P.HELD + len(v)
    out = held.rows()
    assert out["weight"].sum() == 3_000_000 + 150 and out["mean"].isna().sum() == 5 and not held.number


def test_the_last_group_is_kept_back():
    held = P.Held(["g"], P.COMPRESSION)
    for g, bad in (("a", 1), ("b", 2), ("c", 0)):
        i = held.numbers([(g,)])
        held.invalid[i] += bad
        held.add(np.repeat(i, 3), (np.arange(3.0), np.ones(3), np.arange(3.0), np.arange(3.0)))
    done = held.keep(("b",)).estimates([0.5])
    assert done["g"].tolist() == ["a", "c"] and done["n_invalid"].tolist() == [1, 0] and done["n"].tolist() == [3, 3]
    rest = held.estimates([0.5])
    assert rest["g"].tolist() == ["b"] and rest["n_invalid"].tolist() == [2] and rest["est"][0][0] == 1


@pytest.mark.parametrize("fan_in", [P.FAN_IN, 2])
def test_days_combine(spark, monkeypatch, fan_in):
    monkeypatch.setattr(P, "FAN_IN", fan_in)
    df = spark.createDataFrame([(str(i % 2), float(i), i, 0) for i in range(400)], SCHEMA).repartition(6)
    days = P.digests(df, {"grp": "grp", "d": F.col("y") % 4}, _x())
    both = {r["g_grp"]: r for r in P.estimates(P.combine(days, ["g_grp", "g_d", "metric"]), ["g_grp", "metric"], [0.5]).collect()}
    assert both["0"]["n"] == 200 and abs(both["0"]["est"][0] - 199) <= 3


def test_empty_table_and_no_groups(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert P.certified(empty, {"grp": "grp"}, _x()).count() == 0
    one = spark.createDataFrame([("a", float(i), 0, 0) for i in range(11)], SCHEMA)
    out = P.certified(one, {}, _x(), quantiles=[0.5]).collect()
    assert len(out) == 1 and out[0]["value"] == pytest.approx(5, abs=0.5)
