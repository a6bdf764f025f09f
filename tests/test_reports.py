"""Placement thresholds, sequences, experiments and graph on micro-tables."""

import math

import pytest

from voxelcohort.operators import experiments as E
from voxelcohort.operators import graph as N
from voxelcohort.operators import placement as P
from voxelcohort.operators import reports as R
from voxelcohort.operators import sequences as S

GOOD = {"placed_voxels": 10, "centroid_offset_mm": 0.0, "retained_fraction": 1.0, "worst_clipping": 1.0, "placed_to_seg_ratio": 1.0,
        "monotone_growth": True, "confidence": 0.5, "score_margin": 0.5, "low_confidence": False, "strategy_agreement": True}
DDL = ("case_id string, placed_voxels long, centroid_offset_mm double, retained_fraction double, worst_clipping double, placed_to_seg_ratio double,"
       " monotone_growth boolean, confidence double, score_margin double, low_confidence boolean, strategy_agreement boolean")


@pytest.mark.parametrize("change, codes", [
    ({}, []), ({"placed_voxels": 0}, ["empty_output"]), ({"centroid_offset_mm": 1.5}, ["centroid_offset_warn"]), ({"centroid_offset_mm": 3.0}, ["centroid_offset_fail"]),
    ({"centroid_offset_mm": math.inf}, ["centroid_offset_fail"]), ({"retained_fraction": 0.95}, ["retained_fraction_warn"]), ({"retained_fraction": 0.80}, ["retained_fraction_fail"]),
    ({"worst_clipping": 0.90}, ["worst_clipping_warn"]), ({"worst_clipping": 0.75}, ["worst_clipping_fail"]), ({"monotone_growth": False}, ["non_monotone_growth"]),
    ({"confidence": 0.08}, ["orientation_low_confidence"]), ({"low_confidence": True}, ["orientation_low_confidence"]), ({"strategy_agreement": False}, ["strategy_disagreement"]),
    ({"placed_to_seg_ratio": 0.20}, ["placed_to_seg_ratio_warn"]), ({"placed_to_seg_ratio": 1.80}, ["placed_to_seg_ratio_warn"]),
    ({"placed_to_seg_ratio": 0.10}, ["placed_to_seg_ratio_fail"]), ({"placed_to_seg_ratio": 2.50}, ["placed_to_seg_ratio_fail"])])
def test_threshold_edges(spark, change, codes):
    df = spark.createDataFrame([("c", *{**GOOD, **change}.values())], DDL)
    assert [f["code"] for f in P.validate(df).first()["findings"]] == codes


def test_thresholds_can_be_changed(spark):
    df = spark.createDataFrame([("c", *{**GOOD, "centroid_offset_mm": 4.0}.values())], DDL)
    assert P.validate(df, {"centroid_offset_warn_mm": 5.0, "centroid_offset_fail_mm": 10.0}).first()["findings"] == []


def test_reports_without_completed_cases(spark):
    flat = R.flatten_cases(P.validate(spark.createDataFrame([], DDL)))
    failed = spark.createDataFrame([("x", "ValueError", 'a "b"')], "case_id string, exception_type string, exception_message string")
    cases = R.with_exceptions(flat, failed)
    row = R.batch_summary(cases).first()
    assert (row["total_cases"], row["exception_count"], row["hard_failure_count"], row["clipping_frequency"]) == (1, 1, 1, None)
    assert cases.first()["hard_failures"] == '["a \\"b\\""]'
    assert [tuple(r) for r in R.problem_cases(cases).collect()] == [("exception", "x", 'a "b"')]


def test_monotone_tolerates_small_drops(spark):
    df = spark.createDataFrame([("a", 0, 100), ("a", 1, 98), ("a", 2, 120), ("b", 0, 100), ("b", 1, 97), ("c", 0, 0), ("c", 1, 0)], "case_id string, tp long, placed_voxels long")
    assert {r["case_id"]: r["monotone_growth"] for r in P.monotone(df).collect()} == {"a": True, "b": False, "c": True}


def test_equal_scores_take_the_stable_sign(spark):
    df = spark.createDataFrame([("a", "s", 1, -3.0, 1.0, 0.0, 0.5), ("a", "s", -1, 3.0, -1.0, 0.0, 0.5), ("b", "s", 1, -3.0, 1.0, 0.0, 0.9), ("b", "s", -1, 3.0, -1.0, 0.0, 0.5)],
                               "case_id string, strategy string, sign int, ax double, ay double, az double, score double")
    got = {r["case_id"]: (r["axis"], r["tie"]) for r in P.best_candidate(df).collect()}
    assert got == {"a": ([3.0, -1.0, 0.0], True), "b": ([-3.0, 1.0, 0.0], False)}


# --- sequences ------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def lengths(spark):
    return spark.createDataFrame([(f"p{n}", 1 + n * n % 5) for n in range(101)], "patient_id string, seq_len long")


@pytest.mark.parametrize("limit", [7, 1000])
def test_batches_cover_each_sequence_once(lengths, limit):
    got = S.length_batches(lengths, 4, 1, rows_per_split=limit).collect()
    sizes = {}
    for r in got:
        sizes.setdefault((r["batch"], r["seq_len"]), []).append(r["patient_id"])
    assert sorted(p for ps in sizes.values() for p in ps) == sorted(f"p{n}" for n in range(101))
    assert all(len(ps) <= 4 for ps in sizes.values()) and len(sizes) == S.n_batches(lengths, 4).first()[0]
    again = S.length_batches(lengths, 4, 1).collect()
    assert {(r["patient_id"], r["batch"]) for r in again} == {(r["patient_id"], r["batch"]) for r in got}
    assert {(r["patient_id"], r["batch"]) for r in S.length_batches(lengths, 4, 2).collect()} != {(r["patient_id"], r["batch"]) for r in got}


def test_epoch_order_is_a_new_permutation_each_epoch(lengths):
    batches = S.length_batches(lengths, 4, 1)
    orders = [[r["batch"] for r in S.epoch_order(batches, 42, e).orderBy("place").collect()] for e in (0, 0, 1)]
    assert orders[0] == orders[1] != orders[2] and sorted(orders[0]) == sorted(orders[2])


def test_single_scan_and_equal_days(spark):
    df = spark.createDataFrame([("a", "a1", 5.0), ("b", "b2", 3.0), ("b", "b1", 3.0), ("b", "b3", 363.0)], "patient_id string, scan_id string, day double")
    rows = S.time_deltas(df)
    assert {r["scan_id"]: r["delta"] for r in rows.collect()} == {"a1": None, "b1": None, "b2": 0.0, "b3": 360.0}
    from pyspark.sql import functions as F

    grid = S.fill_last_delta(rows.withColumn("batch", F.lit(0)), "batch")
    assert {(r["patient_id"], r["pos"], r["delta"]) for r in grid.collect()} == {("a", 1, 0.0), ("a", 2, 0.0), ("b", 1, 0.0), ("b", 2, 360.0)}


def test_unknown_aggregation(spark):
    with pytest.raises(ValueError, match="unknown aggregation"):
        S.aggregate_sequence(spark.range(1), "median")


# --- experiments ------------------------------------------------------------------------------------------

def test_grid_order(spark):
    values = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "1"), ("b", 1, "2"), ("b", 2, "3")], "param string, pos int, value string")
    assert [(r["item"], r["a"], r["b"]) for r in E.param_grid(values).orderBy("item").collect()] == [
        (1, "x", "1"), (2, "x", "2"), (3, "x", "3"), (4, "y", "1"), (5, "y", "2"), (6, "y", "3")]


def test_kfold(spark):
    df = spark.range(23)
    got = E.kfold(df, "id", 5, 42).collect()
    sizes = [sum(r["fold"] == f for r in got) for f in range(5)]
    assert sizes == [5, 5, 5, 4, 4] and len({r["id"] for r in got}) == 23
    views = E.fold_views(E.kfold(df, "id", 5, 42), 5)
    assert views.filter("part = 'val'").count() == 23 and views.filter("part = 'train'").count() == 92


def loop_stop(values, patience, delta, alpha):
    s, best, idle = 0.0, float("inf"), 0
    for n, x in enumerate(values):
        s = alpha * x + (1 - alpha) * s
        if s < best - delta:
            best, idle = s, 0
        else:
            idle += 1
            if idle > patience:
                return n, best
    return None, best


@pytest.mark.parametrize("patience", [0, 3])
def test_early_stop(spark, patience):
    runs = {"flat": [1.0] * 12, "down": [1 / (n + 1) for n in range(12)], "spike": [1, 0.5, 9, 0.4, 0.3, 0.2, 0.1, 0.05], "one": [3.0]}
    df = spark.createDataFrame([(r, n, float(x)) for r, xs in runs.items() for n, x in enumerate(xs)], "run_id string, epoch int, value double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {r["run_id"]: (r["stop_epoch"], r["best"]) for r in E.early_stop(df, patience, 0.0, 0.9).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for r, xs in runs.items():
        stop, best = loop_stop(xs, patience, 0.0, 0.9)
        assert got[r][0] == stop and got[r][1] == pytest.approx(best)


def test_composite_first_value_and_zero_spread(spark):
    df = spark.createDataFrame([(0, 0, e, m, v) for e, pair in enumerate([(0.2, 3.0), (0.1, 3.0), (0.4, 5.0)]) for m, v in zip(("dice", "hd"), pair)],
                               "run_id int, fold int, epoch int, metric string, value double")
    got = [r["score"] for r in E.composite_score(df, {"dice": 0.5, "hd": 0.5}, ["hd"]).orderBy("epoch").collect()]
    z = (5 - 11 / 3) / ((sum((x - 11 / 3) ** 2 for x in (3, 3, 5)) / 3) ** 0.5)
    assert got[0] == pytest.approx(0.6) and got[1] is None and got[2] == pytest.approx(0.2 + 0.5 / (1 + math.exp(-z)))


def test_best_epoch_must_beat_one(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 1, 0.9), (1, 2, 0.9), (2, 0, 1.0)], "run_id int, epoch int, score double")
    assert [tuple(r) for r in E.best_epoch(df).collect()] == [(1, 1, 0.9)]


# --- graph ----------------------------------------------------------------------------------------------------

def test_labels_spread_along_a_chain(spark):
    nodes = spark.createDataFrame([("a", "G"), ("b", None), ("c", None), ("d", None), ("alone", None), ("x", "H"), ("y", "A"), ("tie", None)], "id string, group string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "c"), ("c", "ghost"), ("tie", "x"), ("y", "tie")], "source string, target string")
    got = {r["id"]: r["group"] for r in N.propagate_labels(nodes, edges, "rest").collect()}
    assert got == {"a": "G", "b": "G", "c": "G", "d": "G", "alone": "rest", "x": "H", "y": "A", "tie": "A"}


def test_labels_spread_along_a_long_chain(spark):
    nodes = spark.createDataFrame([(n, "G" if n == 0 else None) for n in range(12)], "id long, group string")
    edges = spark.createDataFrame([(n, n + 1) for n in range(11)], "source long, target long")
    assert {r["group"] for r in N.propagate_labels(nodes, edges, "rest").collect()} == {"G"}


def test_labels_spread_along_a_chain_with_a_plan_of_constant_size(spark):
    plans = []
    for n in (5, 40):
        nodes = spark.createDataFrame([(f"n{i:03d}", "G" if i == 0 else None) for i in range(n)], "id string, group string")
        edges = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(n - 1)], "source string, target string")
        done = N.propagate_labels(nodes, edges, "rest")
        assert {r["group"] for r in done.collect()} == {"G"} and done.count() == n
        plans.append(len(done._jdf.queryExecution().optimizedPlan().toString().splitlines()))
    assert plans[0] == plans[1]


def test_adjacency_drops_duplicates_and_unknown_ends(spark):
    nodes = spark.createDataFrame([("a", "A"), ("b", "B")], "id string, label string")
    edges = spark.createDataFrame([("a", "b", "r", "c"), ("a", "b", "r", "c"), ("a", "z", "r", "c")], "source string, target string, relation string, confidence string")
    got = {(r["id"], r["direction"], r["other"], r["other_label"]) for r in N.adjacency(nodes, edges).collect()}
    assert got == {("a", "outgoing", "b", "B"), ("b", "incoming", "a", "A")} and N.adjacency(nodes, edges).count() == 2


def test_rules_give_groups_and_hints_follow(spark):
    nodes = spark.createDataFrame([("a", "An Experiment", None, "code"), ("b", "x", "src/b.py", "code"), ("c", "y", "", "document"), ("d", "z", "lib/d", "code")], "id string, label string, source_file string, file_type string")
    rules = [(3, "label", "EXPERIMENT", "trial", ("one", "src")), (1, "prefix", "src/", "src"), (2, "type", "document", "docs"), (4, "prefix", "lib/", "lib", ("src",))]
    told = N.classify(nodes, rules)
    assert {r["id"]: (r["group"], r["secondary"]) for r in told.collect()} == {"a": ("trial", ["one", "src"]), "b": ("src", []), "c": ("docs", []), "d": ("lib", ["src"])}
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a"), ("d", "a"), ("c", "b")], "source string, target string")
    got = sorted(map(tuple, N.secondary_groups(told, edges).collect()), key=str)
    assert got == sorted([("a", 1, "one", None), ("a", 2, "src", None), ("a", 3, "docs", 1), ("c", 1, "src", 1), ("c", 2, "trial", 1), ("d", 1, "src", None)], key=str)


def test_secondary_groups_join_the_valid_edges_once(spark, tmp_path, monkeypatch):
    from voxelcohort.workload import REGISTERED, network
    from voxelcohort.workload import tables as T

    rows = {
        "customer": ([(1, "A", 0, 6000.0, "BUILDING"), (2, "B", 1, -1.0, "HOUSEHOLD"), (3, "C", 2, 2000.0, "X"), (4, "D", 2, 500.0, "X"), (5, "E", 2, 9000.0, "MACHINERY")],
                     "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "supplier": ([(1, "s1"), (2, "s2"), (3, "s3")], "s_suppkey long, s_name string"),
        "orders": ([(n, 1 + n % 5, "LOW") for n in range(10)] + [(90, 77, "LOW"), (91, None, "LOW")], "o_orderkey long, o_custkey long, o_orderpriority string"),
        "lineitem": ([(n % 10, n, 1 + n % 3, 5.0) for n in range(40)] + [(90, 1, 1, 5.0), (91, 1, 2, 5.0), (3, 1, 9, 5.0), (3, None, None, 5.0)],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double"),
    }
    for name, (data, ddl) in rows.items():
        spark.createDataFrame(data, ddl).write.parquet(f"{tmp_path}/{name}.parquet")
    plain = sorted(map(tuple, N.secondary_groups(network._spread(spark, tmp_path), T.edges(spark, tmp_path)).collect()), key=str)
    calls, valid = [], N.valid_edges
    monkeypatch.setattr(N, "valid_edges", lambda *a: calls.append(1) or valid(*a))
    got = REGISTERED["N05_secondary_groups"][0](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == plain and any(r[3] for r in plain)
    assert len(calls) == 1


def test_names_stay_unique(spark):
    df = spark.createDataFrame([(0, 1, "a b"), (1, 1, "a_b"), (2, 2, "a b"), (3, None, "a b"), (4, 1, "a  b")], "n int, community int, id string")
    got = {r["n"]: (r["folder"], r["note"]) for r in N.unique_names(df, "n").collect()}
    assert got == {0: ("community_001", "a_b"), 1: ("community_001", "a_b__2"), 2: ("community_002", "a_b"), 3: ("community_unassigned", "a_b"), 4: ("community_001", "a_b__3")}
