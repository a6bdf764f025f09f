"""Validation of placed masks against thresholds."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelcohort.operators.geometry import norm
from voxelcohort.operators.skew import in_order

# fixed values: warning and failure limits
THRESHOLDS: Mapping[str, float] = {
    "centroid_offset_warn_mm": 1.5,
    "centroid_offset_fail_mm": 3.0,
    "retained_fraction_warn": 0.95,
    "retained_fraction_fail": 0.80,
    "worst_clipping_warn": 0.90,
    "worst_clipping_fail": 0.75,
    "orientation_confidence_warn": 0.08,
    "placed_to_seg_ratio_warn_low": 0.20,
    "placed_to_seg_ratio_warn_high": 1.80,
    "placed_to_seg_ratio_fail_low": 0.10,
    "placed_to_seg_ratio_fail_high": 2.50,
    "monotone_drop_warn_fraction": 0.02,
}

# fixed values: severity and message of each finding
FINDINGS: Mapping[str, tuple[str, str]] = {
    "empty_output": ("hard_failure", "Primary placed mask is empty."),
    "centroid_offset_fail": ("hard_failure", "Centroid offset %.2f mm exceeds failure threshold."),
    "centroid_offset_warn": ("warning", "Centroid offset %.2f mm exceeds warning threshold."),
    "retained_fraction_fail": ("hard_failure", "Retained fraction %.3f is too low."),
    "retained_fraction_warn": ("warning", "Retained fraction %.3f is below the warning threshold."),
    "worst_clipping_fail": ("hard_failure", "Worst retained fraction %.3f indicates severe clipping."),
    "worst_clipping_warn": ("warning", "Worst retained fraction %.3f indicates clipping."),
    "non_monotone_growth": ("warning", "Placed mask voxel counts are not monotone non-decreasing across timepoints."),
    "orientation_low_confidence": ("warning", "Orientation confidence %.4f is low (margin %.4f)."),
    "strategy_disagreement": ("warning", "Orientation strategies disagree on the selected signed axis."),
    "placed_to_seg_ratio_fail": ("hard_failure", "Placed/seg volume ratio %.3f is implausible."),
    "placed_to_seg_ratio_warn": ("warning", "Placed/seg volume ratio %.3f is outside the warning band."),
}


def placement_metrics(tp: DataFrame, voxel_mm3: float = 1.0) -> DataFrame:
    """Adds volumes in mm3, the retained fraction and whether the mask was clipped.

    Source voxels are 1 mm3 each; ``voxel_mm3`` is the target's voxel volume.
    """
    placed = F.col("placed_voxels") * F.lit(float(voxel_mm3))
    source = F.col("source_voxels").cast("double")
    return tp.withColumns({
        "source_mm3": source, "placed_mm3": placed, "retained": placed / F.greatest(source, F.lit(1e-8)),
        "clipped": (F.col("source_voxels") > 0) & (F.col("placed_voxels") < F.col("source_voxels")),
    })


def _rollup(metrics: DataFrame, *more: Column) -> DataFrame:
    small = F.min_by(
        F.struct("source_voxels", "placed_voxels", "source_mm3", "placed_mm3", "offset_mm", "tp"), F.struct("source_voxels", "tp")
    )
    per = metrics.groupBy("case_id").agg(
        F.max("placed_voxels").alias("max_placed_voxels"), F.max("placed_mm3").alias("max_placed_mm3"), F.min("retained").alias("worst_clipping"),
        F.max("seg_mm3").alias("seg_mm3"), small.alias("_p"), *more,
    )
    known = {"case_id", "max_placed_voxels", "max_placed_mm3", "worst_clipping", "seg_mm3", "_p"}
    return per.select(
        "case_id", "max_placed_voxels", "max_placed_mm3", "worst_clipping",
        (F.col("max_placed_mm3") / F.greatest("seg_mm3", F.lit(1e-8))).alias("placed_to_seg_ratio"),
        F.col("_p.tp").alias("primary_tp"), F.col("_p.placed_voxels").alias("placed_voxels"), F.col("_p.offset_mm").alias("centroid_offset_mm"),
        (F.col("_p.placed_mm3") / F.greatest("_p.source_mm3", F.lit(1e-8))).alias("retained_fraction"),
        *[c for c in per.columns if c not in known],
    )


def case_rollup(metrics: DataFrame) -> DataFrame:
    """One row per case: largest placement, ratio to the segmentation, worst retention, smallest timepoint."""
    return _rollup(metrics)


def _growth(tolerance: float) -> Column:
    drop = (F.col("_before") > 0) & (F.col("placed_voxels") < F.col("_before") * (1.0 - tolerance))
    return (~F.bool_or(F.coalesce(drop, F.lit(False)))).alias("monotone_growth")


def _with_previous(tp: DataFrame) -> DataFrame:
    return in_order(tp, ["case_id"], "tp", lag={"placed_voxels": "_before"})


def monotone(tp: DataFrame, tolerance: float = THRESHOLDS["monotone_drop_warn_fraction"]) -> DataFrame:
    """Whether placed voxels never drop by more than the tolerance from one timepoint to the next."""
    return _with_previous(tp).groupBy("case_id").agg(_growth(tolerance))


def case_summary(metrics: DataFrame, tolerance: float = THRESHOLDS["monotone_drop_warn_fraction"]) -> DataFrame:
    """:func:`case_rollup` and :func:`monotone` of the same timepoints, ordered and grouped once."""
    return _rollup(_with_previous(metrics), _growth(tolerance))


def confidence(candidates: DataFrame, group=("case_id", "strategy")) -> DataFrame:
    """Score margin and normalised gap of each candidate set; low when either is below 0.05."""
    best, worst = F.col("best_score"), F.col("worst_score")
    per = candidates.groupBy(*group).agg(F.max("score").alias("best_score"), F.min("score").alias("worst_score"))
    margin = best - worst
    gap = margin / (F.abs(best) + F.abs(worst) + 1e-8)
    return per.withColumns({"score_margin": margin, "confidence": gap, "low_confidence": (margin < 0.05) | (gap < 0.05)})


def best_candidate(candidates: DataFrame, group=("case_id", "strategy"), tie_break: bool = True, tolerance: float = 1e-6) -> DataFrame:
    """Axis of the best-scoring candidate.

    Two candidates with equal scores leave the sign open: the axis is then the
    one whose dominant component is positive.
    """
    axis = F.array("ax", "ay", "az")
    per = candidates.groupBy(*group).agg(
        F.max_by(F.struct(axis.alias("axis"), "sign"), F.struct("score", "sign")).alias("_b"),
        F.max("score").alias("score"), F.min("score").alias("_lo"), F.count(F.lit(1)).alias("_n"))
    top = F.array_max(F.transform("_b.axis", F.abs))
    lead = F.get(F.filter("_b.axis", lambda x: F.abs(x) == top), 0)
    stable = F.when(lead < 0, F.transform("_b.axis", lambda x: -x)).otherwise(F.col("_b.axis"))
    close = F.abs(F.col("score") - F.col("_lo")) <= tolerance + 1e-5 * F.abs("_lo")
    tie = (F.col("_n") == 2) & close if tie_break else F.lit(False)
    return per.select(*group, "score", F.when(tie, stable).otherwise(F.col("_b.axis")).alias("axis"), tie.alias("tie"))


def strategies_agree(best: DataFrame, reference: str) -> DataFrame:
    """Whether all strategies of a case chose the direction of the ``reference`` strategy (1e-6 + 1e-5 relative)."""
    unit = best.select("case_id", "strategy", F.transform("axis", lambda x: x / norm("axis")).alias("u"))
    ref = unit.filter(F.col("strategy") == reference).select("case_id", F.col("u").alias("r"))
    near = F.forall(F.zip_with("u", "r", lambda x, y: F.abs(x - y) <= 1e-6 + 1e-5 * F.abs(y)), lambda ok: ok)
    return unit.join(ref, "case_id").groupBy("case_id").agg(F.bool_and(near).alias("strategy_agreement"))


def validate(cases: DataFrame, thresholds: Mapping[str, float] = THRESHOLDS) -> DataFrame:
    """Adds ``findings`` (severity, code, message); each metric reports its gravest breach, edges included."""
    t = {**THRESHOLDS, **thresholds}
    offset, kept, clip = F.col("centroid_offset_mm"), F.col("retained_fraction"), F.col("worst_clipping")
    ratio, sure = F.col("placed_to_seg_ratio"), F.col("confidence")

    def finding(code, *args):
        severity, text = FINDINGS[code]
        message = F.format_string(text, *args) if args else F.lit(text)
        return F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), message.alias("message"))

    def graded(name, value, breach):
        """Failure before warning on one metric."""
        return F.when(breach("fail"), finding(f"{name}_fail", value)).when(breach("warn"), finding(f"{name}_warn", value))

    rules = [
        F.when(F.col("placed_voxels") <= 0, finding("empty_output")),
        graded("centroid_offset", offset, lambda g: offset >= t[f"centroid_offset_{g}_mm"]),
        graded("retained_fraction", kept, lambda g: kept <= t[f"retained_fraction_{g}"]),
        graded("worst_clipping", clip, lambda g: clip <= t[f"worst_clipping_{g}"]),
        F.when(~F.col("monotone_growth"), finding("non_monotone_growth")),
        F.when(F.col("low_confidence") | (sure <= t["orientation_confidence_warn"]), finding("orientation_low_confidence", sure, F.col("score_margin"))),
        F.when(~F.col("strategy_agreement"), finding("strategy_disagreement")),
        graded("placed_to_seg_ratio", ratio, lambda g: (ratio <= t[f"placed_to_seg_ratio_{g}_low"]) | (ratio >= t[f"placed_to_seg_ratio_{g}_high"])),
    ]
    return cases.withColumn("findings", F.array_compact(F.array(*rules)))


def expected_radius(df: DataFrame, seg_mm3: str = "seg_mm3", canal_mm: float = 10.0, base_r_mm: float = 3.5, apex_r_mm: float = 2.0) -> DataFrame:
    """Volume of the canal (truncated cone) and the radius of the sphere holding the rest of the segmentation."""
    cone = math.pi * canal_mm / 3.0 * (base_r_mm**2 + base_r_mm * apex_r_mm + apex_r_mm**2)
    bulb = F.greatest(F.lit(0.0), F.col(seg_mm3) - cone)
    radius = F.when(bulb > 0, F.pow(3.0 * bulb / (4.0 * math.pi), F.lit(1.0 / 3.0))).otherwise(base_r_mm)
    return df.withColumns({"canal_mm3": F.lit(cone), "bulb_mm3": bulb, "radius_mm": radius})


def centroid_offset(pairs: DataFrame, centroids: DataFrame, volumes: DataFrame) -> DataFrame:
    """Distance between two masks' centroids in voxels and mm; infinite when either is empty.

    ``centroids`` has ``(volume_id, ci, cj, ck)``; mm use the spacing of ``b``.
    """
    out = pairs.select("a_id", "b_id")
    for side in "ab":
        out = out.join(centroids.select(F.col("volume_id").alias(f"{side}_id"), F.array("ci", "cj", "ck").alias(f"_{side}")), f"{side}_id", "left")
    out = out.join(volumes.select(F.col("volume_id").alias("b_id"), "spacing"), "b_id")
    delta = F.zip_with("_a", "_b", lambda x, y: x - y)
    far = F.lit(float("inf"))
    return out.withColumn("_d", delta).select(
        "a_id", "b_id", F.coalesce(norm("_d"), far).alias("offset_vox"),
        F.coalesce(norm(F.zip_with("_d", "spacing", lambda x, s: x * s)), far).alias("offset_mm"))
