"""Whole lifecycles, and what their physical plans look like."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from voxelcohort.operators import anchors as A
from voxelcohort.operators import cohort as C
from voxelcohort.plans.cohort import close_run, plan_cohort
from voxelcohort.plans.overlap import review_overlap
from voxelcohort.plans.placement import validate_batch
from voxelcohort.workload import tables as T

# reasoned exceptions: none of them joins two tables without a key
PLANS = ["L04_split_by_existence", "L12_link_timeline", "C09_pick_best_mask", "A01_select_anchor", "A05_anchor_roles", "I01_plan_incremental", "I03_plan_todo",
         "Q01_propagate_flags", "V02_entropy", "V05_standardise", "M01_dice", "M03_pairwise_dice", "G13_resample_trilinear", "T03_assemble", "T06_time_deltas", "P03_monotone",
         "E01_param_grid", "E03_fold_views", "N02_adjacency", "I12_error_report"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLANS)
def test_no_join_without_a_key(name, spark, sf):
    plan = plan_of(entry.queries()[name](spark, sf))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_top_rows_are_cut_before_the_exchange(spark, sf):
    for df in (A.select_anchor(T.review(spark, sf), ["patient_id"]), C.pick_best_mask(T.mask_rows(spark, sf), ["accession"])):
        plan = plan_of(df)
        assert plan.index("WindowGroupLimit") < plan.index("Exchange hashpartitioning") < plan.rindex("WindowGroupLimit")


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = plan_of(T.table(spark, sf, "lineitem").filter("l_discount >= 0.1").groupBy("l_suppkey").agg(F.count(F.lit(1))))
    assert "GreaterThanOrEqual(l_discount,0.1)" in plan and "ReadSchema: struct<l_suppkey:bigint,l_discount:double>" in plan


def test_queries_can_be_listed_without_a_session():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_cohort_lifecycle(spark, sf):
    s = T.series(spark, sf).withColumnsRenamed({"series_id": "row_id", "file_size_mb": "metric", "preprocessing_version": "version"}).drop("patient_id", "timepoint")
    plan = plan_cohort(s, ["T1_post", "t2_thin"], "smart", "v3", modality="t2")
    assert plan.roles.filter("study_type NOT IN ('T1_post', 't2_thin')").isEmpty()
    todo = plan.todo
    assert todo.filter("coreg_image IS NOT NULL AND version = 'v3'").isEmpty() and todo.count() > 0
    updates = todo.select("row_id", F.lit(1).alias("seq"), F.lit("coreg_image").alias("column"), F.concat(F.lit("new/"), "row_id").alias("value"))
    errors = spark.createDataFrame([("patient", "1", "1", "lost")], "grain string, patient_id string, key string, message string")
    done, summary = close_run(plan, updates, errors, ["coreg_image"])
    row = summary.first()
    assert row["n_rows"] == row["n_coreg_images"] == plan.roles.count()
    assert row["n_patient_anchors"] == plan.roles.select("patient_id").distinct().count()
    assert row["n_errors"] == done.filter("patient_id = '1'").count()


def test_placement_lifecycle(spark, sf):
    tp, cand = T.case_tp(spark, sf), T.candidates(spark, sf)
    flat = validate_batch(tp, cand, "late")
    assert flat.count() == tp.select("case_id").distinct().join(cand.select("case_id").distinct(), "case_id").count()


def test_overlap_lifecycle(spark, sf):
    review = review_overlap(T.volumes(spark, sf), T.masks(spark, sf))
    pairs = review.counts.agg(F.sum("n_pairs")).first()[0]
    assert review.per_study.agg(F.sum("n_comparisons")).first()[0] == 2 * pairs
    assert review.pairs.filter("dice <= 0 OR dice > 1").isEmpty()
