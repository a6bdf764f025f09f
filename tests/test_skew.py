"""Helpers for hot groups against brute force, with limits small enough to split everything."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelcohort.operators import cohort, sequences
from voxelcohort.operators.quantiles import quantiles
from voxelcohort.operators.skew import global_position, hot_groups, in_order, self_pairs


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(7)
    out = [("hot", rnd.randint(0, 60), n) for n in range(300)] + [("same", 5, n) for n in range(40)]
    return out + [(f"g{n % 9}", rnd.randint(0, 9), n) for n in range(60)]


@pytest.mark.parametrize("limit", [10, 1000])
def test_in_order(spark, rows, limit):
    df = spark.createDataFrame(rows, "g string, k int, id long")
    got = in_order(df, ["g"], "k", ["id"], "pos", {"id": "before", "k": "k_before"}, {"id": "after"}, "n", rows_per_split=limit)
    groups = {}
    for g, k, n in rows:
        groups.setdefault(g, []).append((k, n))
    want = set()
    for g, items in groups.items():
        items.sort()
        for p, (k, n) in enumerate(items):
            prev = items[p - 1] if p else (None, None)
            want.add((g, k, n, p + 1, len(items), prev[1], prev[0], items[p + 1][1] if p + 1 < len(items) else None))
    assert {tuple(r) for r in got.select("g", "k", "id", "pos", "n", "before", "k_before", "after").collect()} == want


def test_in_order_sketches_hot_groups_only(spark, rows, monkeypatch):
    df = spark.createDataFrame([*rows, *[(None, 3, 900 + n) for n in range(50)]], "g string, k int, id long")
    sketched, sketch = [], F.percentile_approx

    def count(*a):
        sketched.append(1)
        return sketch(*a)

    monkeypatch.setattr(F, "percentile_approx", count)
    assert in_order(df, ["g"], "k", ["id"], "pos").count() == len(rows) + 50 and not sketched
    last = in_order(df, ["g"], "k", ["id"], "pos", rows_per_split=30).groupBy("g").agg(F.max("pos").alias("n"), F.count_distinct("pos").alias("m"))
    got = {r["g"]: (r["n"], r["m"]) for r in last.collect()}
    assert sketched and (got["hot"], got["same"], got[None]) == ((300, 300), (40, 40), (50, 50))


def test_hot_groups_reports_none_without_hot_keys(spark, rows):
    df = spark.createDataFrame(rows, "g string, k int, id long")
    assert hot_groups(df, ["g"], 10_000) is None
    assert {r["g"] for r in hot_groups(df, ["g"], 39).collect()} == {"hot", "same"}


@pytest.mark.parametrize("tile", [3, 1000])
def test_self_pairs(spark, tile):
    rows = [("hot", n) for n in range(40)] + [(f"g{n % 5}", n) for n in range(12)]
    df = spark.createDataFrame(rows, "g string, id long")
    got = [tuple(r) for r in self_pairs(df, ["g"], "id", rows_per_tile=tile).select("g", "a_id", "b_id").collect()]
    want = {(g, a, b) for g, a in rows for h, b in rows if g == h and a < b}
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("limit", [5, 100_000])
def test_quantiles(spark, limit):
    rng = np.random.default_rng(3)
    data = {"spike": np.r_[np.zeros(200), rng.normal(size=100)], "flat": np.full(50, 2.0), "wide": rng.exponential(size=333) ** 4, "one": np.array([1.5]), "far": np.r_[rng.normal(size=300), 1e300, -1e200, np.inf], "nan": np.r_[np.full(20, np.nan), np.arange(300.0)]}
    df = spark.createDataFrame([(g, float(x)) for g, xs in data.items() for x in xs] + [("spike", None)], "g string, v double")
    ps = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    got = {r["g"]: r["q"] for r in quantiles(df, ["g"], "v", ps, rows_per_group=limit).collect()}
    assert got.keys() == data.keys()
    for g, xs in data.items():
        if g == "nan":  # NaN is above everything
            np.testing.assert_allclose(got[g][:4], np.interp(np.array(ps[:4]) * 319, np.arange(300), np.arange(300)))
            assert np.isnan(got[g][4:]).all()
            continue
        want = np.append(np.quantile(xs, ps[:-1]), xs.max())
        np.testing.assert_allclose(got[g], want, rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("limit", [2, 1000])
def test_weighted_and_ungrouped_quantiles(spark, limit):
    df = spark.createDataFrame([(1.0, 3), (2.0, 1), (7.0, 2), (9.0, 0)], "v double, w long")
    got = quantiles(df, [], "v", [0.5, 0.9], weight="w", rows_per_group=limit).first()["q"]
    np.testing.assert_allclose(got, np.quantile([1, 1, 1, 2, 7, 7], [0.5, 0.9]))


def test_global_position(spark):
    df = spark.range(1000).withColumn("h", F.xxhash64("id"))
    got = global_position(df, ["h", "id"], "pos", buckets=16).orderBy("pos").collect()
    assert [r["pos"] for r in got] == list(range(1, 1001))
    assert [r["h"] for r in got] == sorted(r["h"] for r in got)


def test_list_masks_has_one_shape(spark):
    rows = [("hot", f"p{n:03d}") for n in range(50)] + [("few", "b"), ("few", "a"), (None, "z"), (None, "y"), ("none", None)]
    df = spark.createDataFrame(rows, "s string, path string").repartition(7)
    got = {(r["s"], r["position"], r["path"]) for r in cohort.list_masks(df, ["s"]).collect()}
    assert got == {("hot", n + 1, f"p{n:03d}") for n in range(50)} | {("few", 1, "a"), ("few", 2, "b"), (None, 1, "y"), (None, 2, "z")}
    text = {r["s"]: r["all_masks"] for r in cohort.list_masks(df, ["s"], joined=True).collect()}
    assert text["few"] == "a; b" and text[None] == "y; z" and text["hot"].count("; ") == 49


@pytest.mark.parametrize("limit", [2, 100])
def test_in_order_with_null_keys_and_outliers(spark, limit):
    rows = [("g", None, 1), ("g", None, 2), ("g", -1e12, 3), ("g", 1.0, 4), ("g", 1.5, 5), ("g", 2.0, 6), ("g", 2.5, 7), ("g", float("nan"), 8), (None, 1.0, 9), (None, None, 10), (None, 2.0, 11)]
    df = spark.createDataFrame(rows, "g string, k double, id long")
    got = in_order(df, ["g"], "k", ["id"], "pos", {"id": "before"}, {"id": "after"}, "n", rows_per_split=limit)
    order = {"g": [1, 2, 3, 4, 5, 6, 7, 8], None: [10, 9, 11]}
    want = {(g, i, p + 1, len(o), o[p - 1] if p else None, o[p + 1] if p + 1 < len(o) else None) for g, o in order.items() for p, i in enumerate(o)}
    assert {(r["g"], r["id"], r["pos"], r["n"], r["before"], r["after"]) for r in got.collect()} == want


def test_history_of_a_hot_patient(spark):
    df = spark.createDataFrame([("p", f"s{n:02d}", float(n // 2)) for n in range(30)], "patient_id string, scan_id string, day double")
    got = sequences.history_pairs(df, rows_per_split=4).orderBy("step").collect()
    assert [(r["step"], r["history_len"], r["target_scan"]) for r in got] == [(n, n + 1, f"s{n + 1:02d}" if n < 29 else None) for n in range(30)]
    assert [r["valid"] for r in got] == [True] * 29 + [False]
