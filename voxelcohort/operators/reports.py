"""Batch reports over validated cases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelcohort.operators.quantiles import quantiles

CASE_COLUMNS = (
    "centroid_offset_mm", "retained_fraction", "placed_to_seg_ratio", "worst_clipping", "confidence", "score_margin",
    "low_confidence", "strategy_agreement", "monotone_growth",
)


def _messages(severity: str):
    return F.transform(F.filter("findings", lambda f: f["severity"] == severity), lambda f: f["message"])


def flatten_cases(validated: DataFrame) -> DataFrame:
    """One flat row per validated case; message lists become counts and JSON text."""
    warnings, failures = _messages("warning"), _messages("hard_failure")
    return validated.select(
        "case_id", F.lit("completed").alias("status"), *CASE_COLUMNS,
        F.size(warnings).alias("warning_count"), F.size(failures).alias("hard_failure_count"),
        F.to_json(warnings).alias("warnings"), F.to_json(failures).alias("hard_failures"),
    )


def with_exceptions(flat: DataFrame, failed: DataFrame) -> DataFrame:
    """Add cases that ended in an exception: ``(case_id, exception_type, exception_message)``."""
    rows = failed.select(
        "case_id", F.lit("exception").alias("status"), F.lit(0).alias("warning_count"), F.lit(1).alias("hard_failure_count"),
        F.lit("[]").alias("warnings"), F.to_json(F.array("exception_message")).alias("hard_failures"), "exception_type", "exception_message",
    )
    return flat.unionByName(rows, allowMissingColumns=True)


def batch_summary(cases: DataFrame) -> DataFrame:
    """Counts and frequencies of a batch in one row; frequencies are null when no case completed."""
    done, failed = F.col("status") == "completed", F.col("status") == "exception"
    clipped = done & (F.coalesce("worst_clipping", F.lit(1.0)) < 0.999999)
    differ = done & (F.col("strategy_agreement") == F.lit(False))
    out = cases.agg(
        F.count(F.lit(1)).alias("total_cases"), F.count_if(done).alias("completed_cases"), F.count_if(failed).alias("exception_count"),
        F.count_if(done & (F.col("hard_failure_count") == 0)).alias("success_count"), F.count_if(done & (F.col("warning_count") > 0)).alias("warning_count"),
        F.count_if(failed | (F.col("hard_failure_count") > 0)).alias("hard_failure_count"),
        F.count_if(clipped).alias("clipping_case_count"), F.count_if(differ).alias("strategy_disagreement_count"),
    )
    share = lambda c: F.when(F.col("completed_cases") > 0, F.col(c) / F.col("completed_cases"))
    return out.withColumns({"clipping_frequency": share("clipping_case_count"), "strategy_disagreement_frequency": share("strategy_disagreement_count")})


def numeric_summary(cases: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(metric, mean, min, p25, median, p75, max)`` of each column over completed cases."""
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in cols])
    long = cases.filter(F.col("status") == "completed").select(F.inline(pairs))
    base = long.groupBy("metric").agg(F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"))
    qs = quantiles(long, ["metric"], "value", [0.25, 0.5, 0.75])
    return base.join(qs, "metric", "left").select(
        "metric", "mean", "min", F.get("q", 0).alias("p25"), F.get("q", 1).alias("median"), F.get("q", 2).alias("p75"), "max")


def worst_cases(cases: DataFrame, metric: str, n: int = 5) -> DataFrame:
    """The ``n`` completed cases with the lowest metric, missing ones last."""
    return cases.filter(F.col("status") == "completed").orderBy(F.asc_nulls_last(metric), "case_id").limit(n)


def problem_cases(cases: DataFrame) -> DataFrame:
    """``(problem, case_id, detail)``: a case appears once under each problem it has."""
    done = F.col("status") == "completed"
    item = lambda cond, name, detail: F.when(cond, F.struct(F.lit(name).alias("problem"), "case_id", detail.alias("detail")))
    kinds = F.array_compact(F.array(
        item(done & (F.col("warning_count") > 0), "warning", F.col("warnings")),
        item(done & (F.col("hard_failure_count") > 0), "hard_failure", F.col("hard_failures")),
        item(done & (F.col("strategy_agreement") == F.lit(False)), "strategy_disagreement", F.lit(None).cast("string")),
        item(F.col("status") == "exception", "exception", F.col("exception_message")),
    ))
    return cases.select(F.inline(kinds))
