"""Registered queries: placement validation and batch reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelcohort.operators import geometry as G
from voxelcohort.operators import placement as P
from voxelcohort.operators import reports as R
from voxelcohort.session import cut_lineage
from voxelcohort.workload import tables as T
from voxelcohort.workload.tables import CTE, with_sql

Q: dict[str, tuple] = {}


def q(name, sql=None):
    def add(fn):
        Q[name] = (fn, sql)
        return fn

    return add


def _r(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


CTE["tp_metrics"] = (("case_tp",), """
  SELECT *, CAST(source_voxels AS DOUBLE) AS source_mm3, CAST(placed_voxels AS DOUBLE) AS placed_mm3, placed_voxels / greatest(source_voxels, 1e-8) AS retained,
    source_voxels > 0 AND placed_voxels < source_voxels AS clipped FROM case_tp""")
CTE["rollup"] = (("tp_metrics",), """
  SELECT case_id, max(placed_voxels) AS max_placed_voxels, max(placed_mm3) AS max_placed_mm3, min(retained) AS worst_clipping, max(placed_mm3) / greatest(max(seg_mm3), 1e-8) AS placed_to_seg_ratio,
    any_value(tp) FILTER (rn = 1) AS primary_tp, any_value(placed_voxels) FILTER (rn = 1) AS placed_voxels, any_value(offset_mm) FILTER (rn = 1) AS centroid_offset_mm, any_value(retained) FILTER (rn = 1) AS retained_fraction
  FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY source_voxels, tp) AS rn FROM tp_metrics) GROUP BY case_id""")
CTE["mono"] = (("case_tp",), """
  SELECT case_id, bool_and(NOT coalesce(prev > 0 AND placed_voxels < prev * 0.98, false)) AS monotone_growth FROM (
    SELECT *, lag(placed_voxels) OVER (PARTITION BY case_id ORDER BY tp) AS prev FROM case_tp) GROUP BY case_id""")
CTE["conf"] = (("candidates",), """
  SELECT *, score_margin < 0.05 OR confidence < 0.05 AS low_confidence FROM (
    SELECT case_id, strategy, max(score) AS best_score, min(score) AS worst_score, max(score) - min(score) AS score_margin,
      (max(score) - min(score)) / (abs(max(score)) + abs(min(score)) + 1e-8) AS confidence FROM candidates GROUP BY ALL)""")
CTE["best"] = (("candidates",), """
  SELECT case_id, strategy, score, tie, CASE WHEN tie AND lead < 0 THEN -ax ELSE ax END AS ax, CASE WHEN tie AND lead < 0 THEN -ay ELSE ay END AS ay, CASE WHEN tie AND lead < 0 THEN -az ELSE az END AS az FROM (
    SELECT case_id, strategy, max(score) AS score, abs(max(score) - min(score)) <= 1e-6 + 1e-5 * abs(min(score)) AS tie, arg_max(ax, (score, sign)) AS ax, arg_max(ay, (score, sign)) AS ay, arg_max(az, (score, sign)) AS az,
      arg_max(CASE WHEN abs(ax) >= abs(ay) AND abs(ax) >= abs(az) THEN ax WHEN abs(ay) >= abs(az) THEN ay ELSE az END, (score, sign)) AS lead FROM candidates GROUP BY ALL)""")
CTE["agree"] = (("best",), """
  SELECT l.case_id, abs(l.ax / l.n - m.ax / m.n) <= 1e-6 + 1e-5 * abs(l.ax / l.n) AND abs(l.ay / l.n - m.ay / m.n) <= 1e-6 + 1e-5 * abs(l.ay / l.n) AND abs(l.az / l.n - m.az / m.n) <= 1e-6 + 1e-5 * abs(l.az / l.n) AS strategy_agreement
  FROM (SELECT *, sqrt(ax ^ 2 + ay ^ 2 + az ^ 2) AS n FROM best WHERE strategy = 'late') l JOIN (SELECT *, sqrt(ax ^ 2 + ay ^ 2 + az ^ 2) AS n FROM best WHERE strategy = 'mid') m USING (case_id)""")
CTE["cases"] = (("rollup", "mono", "conf", "agree", "candidates"), """
  SELECT r.*, monotone_growth, confidence, score_margin, low_confidence, strategy_agreement
  FROM rollup r JOIN mono USING (case_id)
  JOIN (SELECT *, row_number() OVER (ORDER BY case_id) AS slot FROM conf WHERE strategy = 'late') c ON c.case_id = CAST(CAST(r.case_id AS BIGINT) % (SELECT count(*) FROM part) AS VARCHAR)
  JOIN agree a ON a.case_id = c.case_id""")

_RULES = [
    ("placed_voxels <= 0", "hard_failure", "empty_output"),
    ("centroid_offset_mm >= 3.0", "hard_failure", "centroid_offset_fail"),
    ("centroid_offset_mm >= 1.5 AND centroid_offset_mm < 3.0", "warning", "centroid_offset_warn"),
    ("retained_fraction <= 0.8", "hard_failure", "retained_fraction_fail"),
    ("retained_fraction <= 0.95 AND retained_fraction > 0.8", "warning", "retained_fraction_warn"),
    ("worst_clipping <= 0.75", "hard_failure", "worst_clipping_fail"),
    ("worst_clipping <= 0.9 AND worst_clipping > 0.75", "warning", "worst_clipping_warn"),
    ("NOT monotone_growth", "warning", "non_monotone_growth"),
    ("low_confidence OR confidence <= 0.08", "warning", "orientation_low_confidence"),
    ("NOT strategy_agreement", "warning", "strategy_disagreement"),
    ("placed_to_seg_ratio <= 0.1 OR placed_to_seg_ratio >= 2.5", "hard_failure", "placed_to_seg_ratio_fail"),
    ("(placed_to_seg_ratio <= 0.2 OR placed_to_seg_ratio >= 1.8) AND NOT (placed_to_seg_ratio <= 0.1 OR placed_to_seg_ratio >= 2.5)", "warning", "placed_to_seg_ratio_warn"),
]
_MESSAGES = {
    "centroid_offset_fail": "printf('Centroid offset %.2f mm exceeds failure threshold.', centroid_offset_mm)",
    "retained_fraction_fail": "printf('Retained fraction %.3f is too low.', retained_fraction)",
    "non_monotone_growth": "'Placed mask voxel counts are not monotone non-decreasing across timepoints.'",
}
CTE["findings"] = (("cases",), " UNION ALL ".join(
    f"SELECT case_id, '{sev}' AS severity, '{code}' AS code, {_MESSAGES.get(code, 'NULL')} AS message FROM cases WHERE {cond}" for cond, sev, code in _RULES))
CTE["failed"] = ((), "SELECT 'x' || s_suppkey AS case_id, 'ValueError' AS exception_type, 'no mask for ' || s_name AS exception_message FROM supplier WHERE s_acctbal < 0")
CTE["flat"] = (("cases", "findings", "failed"), """
  SELECT case_id, 'completed' AS status, centroid_offset_mm, retained_fraction, placed_to_seg_ratio, worst_clipping, confidence, strategy_agreement,
    coalesce(w, 0) AS warning_count, coalesce(h, 0) AS hard_failure_count, NULL AS exception_message
  FROM cases LEFT JOIN (SELECT case_id, count(*) FILTER (severity = 'warning') AS w, count(*) FILTER (severity = 'hard_failure') AS h FROM findings GROUP BY 1) USING (case_id)
  UNION ALL SELECT case_id, 'exception', NULL, NULL, NULL, NULL, NULL, NULL, 0, 1, exception_message FROM failed""")


def _orientation(spark, d):
    c = T.candidates(spark, d)
    sure = P.confidence(c).filter("strategy = 'late'").select("case_id", "confidence", "score_margin", "low_confidence")
    agree = P.strategies_agree(P.best_candidate(c), "late")
    return sure.join(agree, "case_id")


def _cases(spark, d):
    tp = cut_lineage(T.case_tp(spark, d))
    roll = P.case_summary(P.placement_metrics(tp))
    n_parts = T.table(spark, d, "part").agg(F.count(F.lit(1))).scalar()
    slot = (F.col("case_id").cast("long") % n_parts).cast("string")
    return roll.withColumn("_slot", slot).join(_orientation(spark, d).withColumnRenamed("case_id", "_slot"), "_slot").drop("_slot")


def _failed(spark, d):
    s = T.table(spark, d, "supplier").filter("s_acctbal < 0")
    return s.select(F.concat(F.lit("x"), "s_suppkey").alias("case_id"), F.lit("ValueError").alias("exception_type"), F.concat(F.lit("no mask for "), "s_name").alias("exception_message"))


def _flat(spark, d):
    return R.with_exceptions(R.flatten_cases(P.validate(_cases(spark, d))), _failed(spark, d))


@q("P01_placement_metrics", with_sql("SELECT case_id, tp, source_mm3, placed_mm3, round(retained, 6) + 0.0 AS retained, clipped FROM tp_metrics", "tp_metrics"))
def _(spark, d):
    return _r(P.placement_metrics(T.case_tp(spark, d)), "retained").select("case_id", "tp", "source_mm3", "placed_mm3", "retained", "clipped")


@q("P02_case_rollup", with_sql("""
  SELECT case_id, max_placed_voxels, max_placed_mm3, round(worst_clipping, 6) + 0.0 AS worst_clipping, round(placed_to_seg_ratio, 6) + 0.0 AS placed_to_seg_ratio, primary_tp, placed_voxels,
    round(centroid_offset_mm, 6) + 0.0 AS centroid_offset_mm, round(retained_fraction, 6) + 0.0 AS retained_fraction FROM rollup""", "rollup"))
def _(spark, d):
    return _r(P.case_rollup(P.placement_metrics(T.case_tp(spark, d))), "worst_clipping", "placed_to_seg_ratio", "centroid_offset_mm", "retained_fraction")


@q("P03_monotone", with_sql("SELECT * FROM mono", "mono"))
def _(spark, d):
    return P.monotone(T.case_tp(spark, d))


@q("P04_validate", with_sql("SELECT case_id, severity, code, message FROM findings WHERE code IN ('centroid_offset_fail', 'retained_fraction_fail', 'non_monotone_growth') UNION ALL SELECT case_id, severity, code, NULL FROM findings WHERE code NOT IN ('centroid_offset_fail', 'retained_fraction_fail', 'non_monotone_growth')", "findings"))
def _(spark, d):
    f = P.validate(_cases(spark, d)).select("case_id", F.inline("findings"))
    told = F.col("code").isin("centroid_offset_fail", "retained_fraction_fail", "non_monotone_growth")
    return f.withColumn("message", F.when(told, F.col("message")))


@q("P05_confidence", with_sql("SELECT case_id, strategy, round(best_score, 6) + 0.0 AS best_score, round(worst_score, 6) + 0.0 AS worst_score, round(score_margin, 6) + 0.0 AS score_margin, round(confidence, 6) + 0.0 AS confidence, low_confidence FROM conf", "conf"))
def _(spark, d):
    return _r(P.confidence(T.candidates(spark, d)), "best_score", "worst_score", "score_margin", "confidence")


@q("P06_best_candidate", with_sql("SELECT case_id, strategy, round(score, 6) + 0.0 AS score, tie, ax + 0.0 AS ax, ay + 0.0 AS ay, az + 0.0 AS az FROM best", "best"))
def _(spark, d):
    return _r(P.best_candidate(T.candidates(spark, d)), "score").select("case_id", "strategy", "score", "tie", *[(F.get("axis", n) + 0.0).alias(f"a{c}") for n, c in enumerate("xyz")])


@q("P07_strategies_agree", with_sql("SELECT * FROM agree", "agree"))
def _(spark, d):
    return P.strategies_agree(P.best_candidate(T.candidates(spark, d)), "late")


_CONE = "(pi() * 10.0 / 3.0 * (3.5 ^ 2 + 3.5 * 2.0 + 2.0 ^ 2))"


@q("P08_expected_radius", f"""
  SELECT o_orderkey, round(greatest(0, o_totalprice / 500 - {_CONE}), 6) + 0.0 AS bulb_mm3,
    round(CASE WHEN o_totalprice / 500 > {_CONE} THEN (3.0 * (o_totalprice / 500 - {_CONE}) / (4.0 * pi())) ^ (1.0 / 3.0) ELSE 3.5 END, 6) + 0.0 AS radius_mm FROM orders""")
def _(spark, d):
    o = T.table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 500).alias("seg_mm3"))
    return _r(P.expected_radius(o), "bulb_mm3", "radius_mm").select("o_orderkey", "bulb_mm3", "radius_mm")


@q("P09_centroid_offset", with_sql("""
  SELECT a_id, b_id, round(sqrt((a.i - b.i) ^ 2 + (a.j - b.j) ^ 2 + (a.k - b.k) ^ 2), 6) + 0.0 AS offset_vox, round(sqrt((a.i - b.i) ^ 2 * 0.25 + (a.j - b.j) ^ 2 * 0.25 + (a.k - b.k) ^ 2 * 9), 6) + 0.0 AS offset_mm
  FROM follow JOIN (SELECT volume_id, avg(i) AS i, avg(j) AS j, avg(k) AS k FROM masks GROUP BY 1) a ON a.volume_id = a_id JOIN (SELECT volume_id, avg(i) AS i, avg(j) AS j, avg(k) AS k FROM masks GROUP BY 1) b ON b.volume_id = b_id""", "follow", "masks"))
def _(spark, d):
    vols = T.volumes(spark, d)
    return _r(P.centroid_offset(T.follow(spark, d), G.centroid(T.masks(spark, d), vols), vols), "offset_vox", "offset_mm")


@q("R01_flatten_cases", with_sql("SELECT case_id, status, warning_count, hard_failure_count, round(worst_clipping, 6) + 0.0 AS worst_clipping, strategy_agreement FROM flat WHERE status = 'completed'", "flat"))
def _(spark, d):
    flat = R.flatten_cases(P.validate(_cases(spark, d)))
    return _r(flat, "worst_clipping").select("case_id", "status", "warning_count", "hard_failure_count", "worst_clipping", "strategy_agreement")


@q("R02_with_exceptions", with_sql("SELECT case_id, status, warning_count, hard_failure_count, round(centroid_offset_mm, 6) + 0.0 AS centroid_offset_mm, exception_message FROM flat", "flat"))
def _(spark, d):
    return _r(_flat(spark, d), "centroid_offset_mm").select("case_id", "status", "warning_count", "hard_failure_count", "centroid_offset_mm", "exception_message")


@q("R03_batch_summary", with_sql("""
  SELECT *, round(clipping_case_count / completed_cases, 6) + 0.0 AS clipping_frequency, round(strategy_disagreement_count / completed_cases, 6) + 0.0 AS strategy_disagreement_frequency FROM (
    SELECT count(*) AS total_cases, count(*) FILTER (status = 'completed') AS completed_cases, count(*) FILTER (status = 'exception') AS exception_count,
      count(*) FILTER (status = 'completed' AND hard_failure_count = 0) AS success_count, count(*) FILTER (status = 'completed' AND warning_count > 0) AS warning_count,
      count(*) FILTER (hard_failure_count > 0) AS hard_failure_count, count(*) FILTER (status = 'completed' AND worst_clipping < 0.999999) AS clipping_case_count,
      count(*) FILTER (NOT strategy_agreement) AS strategy_disagreement_count FROM flat)""", "flat"))
def _(spark, d):
    return _r(R.batch_summary(_flat(spark, d)), "clipping_frequency", "strategy_disagreement_frequency")


_METRICS = ("confidence", "centroid_offset_mm", "retained_fraction", "placed_to_seg_ratio")


@q("R04_numeric_summary", with_sql(" UNION ALL ".join(f"""
  SELECT '{m}' AS metric, round(avg({m}), 6) + 0.0 AS mean, round(min({m}), 6) + 0.0 AS min, round(quantile_cont({m}, 0.25), 6) + 0.0 AS p25, round(quantile_cont({m}, 0.5), 6) + 0.0 AS median, round(quantile_cont({m}, 0.75), 6) + 0.0 AS p75, round(max({m}), 6) + 0.0 AS max
  FROM flat WHERE status = 'completed'""" for m in _METRICS), "flat"))
def _(spark, d):
    cases = cut_lineage(_flat(spark, d))
    return _r(R.numeric_summary(cases, _METRICS), "mean", "min", "p25", "median", "p75", "max")


@q("R05_worst_cases", with_sql("""
  SELECT 'confidence' AS metric, case_id, round(confidence, 6) + 0.0 AS value FROM (SELECT * FROM flat WHERE status = 'completed' ORDER BY confidence NULLS LAST, case_id LIMIT 5)
  UNION ALL SELECT 'worst_clipping', case_id, round(worst_clipping, 6) + 0.0 FROM (SELECT * FROM flat WHERE status = 'completed' ORDER BY worst_clipping NULLS LAST, case_id LIMIT 5)""", "flat"))
def _(spark, d):
    cases = cut_lineage(_flat(spark, d))
    part = lambda m: R.worst_cases(cases, m).select(F.lit(m).alias("metric"), "case_id", F.round(m, 6).alias("value"))
    return part("confidence").unionByName(part("worst_clipping"))


@q("R06_problem_cases", with_sql("""
  SELECT 'warning' AS problem, case_id FROM flat WHERE status = 'completed' AND warning_count > 0 UNION ALL SELECT 'hard_failure', case_id FROM flat WHERE status = 'completed' AND hard_failure_count > 0
  UNION ALL SELECT 'strategy_disagreement', case_id FROM flat WHERE NOT strategy_agreement UNION ALL SELECT 'exception', case_id FROM flat WHERE status = 'exception'""", "flat"))
def _(spark, d):
    return R.problem_cases(_flat(spark, d)).select("problem", "case_id")
