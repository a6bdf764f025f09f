"""Anchors, incremental plans and review flags on micro-tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelcohort.operators import anchors as A
from voxelcohort.operators import incremental as I
from voxelcohort.operators import qc as R
from voxelcohort.plans.cohort import close_run, plan_cohort

DDL = "patient_id string, timepoint string, row_id string, study_type string, metric double, coreg_image string, coreg_seg string, version string"


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([
        ("p", "p1", "a", "T1", 9.0, None, None, None), ("p", "p1", "b", "T2", 5.0, "x", None, "1"), ("p", "p2", "c", "T2", 7.0, None, None, None),
        ("q", "q1", "d", "T1", 3.0, "x", "s", "2"), ("q", "q1", "e", "T1", None, "x", "s", "1")], DDL)


def test_anchor_order(rows):
    pick = lambda **how: {r["patient_id"]: r["row_id"] for r in A.select_anchor(rows, ["patient_id"], **how).collect()}
    assert pick() == {"p": "a", "q": "d"}
    assert pick(ascending=True) == {"p": "b", "q": "d"}
    assert pick(modality="T2") == {"p": "c", "q": "d"}
    assert pick(modality="T2", prefer_coreg=True) == {"p": "b", "q": "d"}


def test_roles_and_chains(rows):
    told = A.transform_chain(A.anchor_roles(A.with_anchors(rows)))
    got = {r["row_id"]: (r["anchor"], r["chain"]) for r in told.collect()}
    assert got["a"] == ("patient_anchor", ["template", "a"])
    assert got["b"] == (None, ["template", "a", "b"])
    assert got["c"] == ("timepoint_anchor", ["template", "a", "c"])


def test_failed_attempts(spark, rows):
    outcomes = spark.createDataFrame([("a", False), ("c", False), ("b", True), ("d", False), ("e", False)], "row_id string, ok boolean")
    got = {r["row_id"] for r in A.failed_attempts(A.anchor_candidates(rows, ["patient_id"]), outcomes, ["patient_id"]).collect()}
    assert got == {"a", "c", "d", "e"}


def test_composed_chain_is_the_matrix_product(spark, rows):
    rng = np.random.default_rng(1)
    told = A.with_anchors(rows)
    edges = {(r["fixed"], r["moving"]): rng.normal(size=(4, 4)) for r in A.chain_edges(told).collect()}
    df = spark.createDataFrame([(f, m, [float(x) for x in v.ravel()]) for (f, m), v in edges.items()], "fixed string, moving string, m array<double>")
    got = {r["row_id"]: np.reshape(r["m"], (4, 4)) for r in A.compose_chain(told, df).collect()}
    for r in A.transform_chain(told).collect():
        want = np.eye(4)
        for hop in zip(r["chain"], r["chain"][1:]):
            want = want @ edges[hop]
        np.testing.assert_allclose(got[r["row_id"]], want)


def test_resume_template(rows):
    got = {r["row_id"]: r["template"] for r in A.resume_template(rows).collect()}
    assert got == {"a": None, "b": None, "c": None}


@pytest.mark.parametrize("mode, want", [
    ("skip_all", {"done": [], "old": [], "none": ["f", "g"], "mixed": ["h", "i", "j"]}),
    ("process_new", {"done": [], "old": [], "none": ["f", "g"], "mixed": ["i"]}),
    ("smart", {"done": [], "old": ["d"], "none": ["f", "g"], "mixed": ["h", "i"]}),
    ("force_reprocess", {"done": ["a", "b"], "old": ["c", "d"], "none": ["f", "g"], "mixed": ["h", "i", "j"]})])
def test_modes(spark, mode, want):
    df = spark.createDataFrame([
        ("done", "a", "x", "2"), ("done", "b", "x", "2"), ("old", "c", "x", "2"), ("old", "d", "x", None), ("none", "f", None, None), ("none", "g", None, "2"),
        ("mixed", "h", "x", "1"), ("mixed", "i", None, None), ("mixed", "j", "x", "2")], "patient_id string, row_id string, coreg_image string, version string")
    got = {p: [] for p in want}
    for r in I.plan_incremental(df, mode, "2").filter("process").orderBy("row_id").collect():
        got[r["patient_id"]].append(r["row_id"])
    assert got == want
    with pytest.raises(ValueError, match="unknown mode"):
        I.plan_incremental(df, "sometimes", "2")


def test_plan_todo(spark):
    df = spark.createDataFrame([("a", "in/a.nii.gz"), ("b", "in/b.nii"), ("c", "in/c.dcm"), ("d", "in/d.nii.gz")], "row_id string, image_path string")
    outputs = spark.createDataFrame([("a_mask.nii.gz",), ("a_bet.nii.gz",), ("c_bet.nii.gz",)], "name string")
    there = spark.createDataFrame([("in/b.nii",)], "path string")
    plan = I.plan_todo(df, outputs, there)
    assert {r["row_id"]: (r["reason"], r["matched"]) for r in plan.collect()} == {
        "a": ("already_processed", "a_bet.nii.gz;a_mask.nii.gz"), "b": (None, None), "c": ("unsupported_extension", None), "d": ("missing_file", None)}


def test_updates_last_write_wins_and_null_overwrites(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "row_id string, n int, t string")
    ups = spark.createDataFrame([("a", 1, "n", "5"), ("a", 3, "n", None), ("a", 2, "n", "7"), ("b", 1, "t", "z"), ("q", 1, "n", "0")], "row_id string, seq int, column string, value string")
    assert {tuple(r) for r in I.apply_updates(df, ups, ["n", "t"]).collect()} == {("a", None, "x"), ("b", 2, "z")}


def test_error_grains(spark):
    df = spark.createDataFrame([("p", "t1", "a"), ("p", "t1", "b"), ("p", "t2", "c"), ("q", "t1", "d")], "patient_id string, timepoint string, row_id string")
    errors = spark.createDataFrame([("patient", "p", "p", "P"), ("timepoint", "p", "t1", "T"), ("row", "p", "a", "R")], "grain string, patient_id string, key string, message string")
    assert {r["row_id"]: r["error_details"] for r in I.attribute_errors(df, errors).collect()} == {"a": "R", "b": "T", "c": "P", "d": None}


def test_a_run_keeps_flags_and_errors_with_their_patient(spark):
    rows = [(p, f"{p}_{t}", s, f"{p}-{t}-{s}", m) for p in ("1", "2") for t in ("0_0", "1_30") for s, m in (("T2", 2.0), ("T1", 1.0))]
    manifest = spark.createDataFrame([(*r, None, None, None) for r in rows], "patient string, tracker string, study_type string, row_id string, metric double, coreg_image string, coreg_seg string, version string")
    plan = plan_cohort(manifest, ["T1", "T2"], "force_reprocess", "A", modality="T2")
    errors = spark.createDataFrame([("timepoint", "1", "1_30", "late")], "grain string, patient_id string, key string, message string")
    none = spark.createDataFrame([], "row_id string, seq long, column string, value string")
    done, _ = close_run(plan, none, errors, ["coreg_image"])
    assert {r["row_id"] for r in done.filter("error_details is not null").collect()} == {"1-1_30-T2", "1-1_30-T1"}
    flagged = R.propagate_flags(done.withColumn("flagged", F.col("row_id") == "1-1_30-T2"))
    assert {r["row_id"] for r in flagged.filter("manual").collect()} == {"1-1_30-T2", "1-1_30-T1"}


def test_flags_spread_from_anchors_only(spark):
    df = spark.createDataFrame([
        ("p", "t1", "a", "patient_anchor", True), ("p", "t2", "b", None, False), ("q", "t3", "c", "timepoint_anchor", True), ("q", "t3", "d", None, False),
        ("q", "t4", "e", None, True), ("q", "t4", "f", None, False)], "patient_id string, timepoint string, row_id string, anchor string, flagged boolean")
    told = R.propagate_flags(df)
    assert {r["row_id"] for r in told.filter("manual").collect()} == {"a", "b", "c", "d", "e"}
    assert tuple(R.flag_sources(df).first()) == (3, 1, 1, 1)
    assert {r["category"]: r["n_rows"] for r in R.category_share(told).collect()} == {"manual_correction": 5, "acceptable": 1}


def test_plans_of_two_modes_share_the_exchange_of_the_rows(spark):
    rows = [("p", 1, "a", "x", "A"), ("p", 1, "b", None, "A"), ("p", 2, "c", "x", "B"), ("q", 1, "d", "x", "A")]
    df = spark.createDataFrame(rows, "patient_id string, timepoint long, row_id string, coreg_image string, version string")
    plan = lambda mode: I.plan_incremental(df, mode, "A", ["patient_id", "timepoint"]).select(F.lit(mode).alias("mode"), "row_id", "skipped", "process")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        both = plan("process_new").unionByName(plan("smart"))
        text = both._jdf.queryExecution().executedPlan().toString()
        got = {(r["mode"], r["row_id"]): (r["skipped"], r["process"]) for r in both.collect()}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert "ReusedExchange" in text
    assert got == {
        ("process_new", "a"): (False, False), ("process_new", "b"): (False, True), ("process_new", "c"): (True, False), ("process_new", "d"): (True, False),
        ("smart", "a"): (False, False), ("smart", "b"): (False, True), ("smart", "c"): (False, True), ("smart", "d"): (True, False)}


def test_registrations_of_a_chain_do_not_read_the_lines_again(spark, tmp_path, monkeypatch):
    """The registrations are made from the stored rows: one read of the lines, and a matrix is made after its metric has come."""
    from voxelcohort.workload import REGISTERED, hierarchy

    spark.createDataFrame([(n, 1 + n % 2) for n in range(6)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(n % 6, n, n, n, 100.0 * n, "F" if n % 3 else "O", "AFN"[n % 3].replace("F", "R"), 0.0) for n in range(1, 30)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_linestatus string, l_returnflag string, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    plans, cut = [], hierarchy.cut_lineage
    monkeypatch.setattr(hierarchy, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    got = REGISTERED["A07_compose_chain"][0](spark, str(tmp_path)).collect()
    rows = {r["row_id"]: r for r in hierarchy.anchored(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) == 29
    for r in got:
        a = rows[r["row_id"]]
        hops = list(dict.fromkeys([a["patient_anchor"], a["timepoint_anchor"], a["row_id"]]))
        scale, shift = 1.0, 0.0
        for h in hops:
            s, t = 1 + rows[h]["metric"] / 200000, rows[h]["metric"] / 10000
            scale, shift = scale * s, shift + scale * t
        assert (r["scale"], r["shift"]) == pytest.approx((scale, shift), abs=2e-6)
    assert "l_orderkey" in plans[0] and not any("l_orderkey" in p for p in plans[1:])
