"""Review flags through the anchor hierarchy and their reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def propagate_flags(df: DataFrame) -> DataFrame:
    """Adds ``manual``: flagged anchors spread to their patient or timepoint, other flags stay on the row.

    A timepoint is named by its patient too, as patients share timepoint names.
    """
    hit = df.filter(F.col("flagged"))
    patients = hit.filter(F.col("anchor") == "patient_anchor").select("patient_id", F.lit(True).alias("_p")).distinct()
    points = hit.filter(F.col("anchor") == "timepoint_anchor").select("patient_id", "timepoint", F.lit(True).alias("_t")).distinct()
    own = F.col("flagged") & F.col("anchor").isNull()
    return (
        df.join(patients, "patient_id", "left").join(points, ["patient_id", "timepoint"], "left")
        .withColumn("manual", F.coalesce("_p", "_t", own, F.lit(False)))
        .drop("_p", "_t")
    )


def category():
    return F.when(F.col("manual"), "manual_correction").otherwise("acceptable")


def route(df: DataFrame, path: str = "coreg_image") -> DataFrame:
    """Adds the category and the path of each result below it."""
    rel = F.regexp_replace(path, "^[^/]*/", "")
    return df.withColumn("category", category()).withColumn("dest", F.concat_ws("/", "category", rel)).withColumn(
        "dest", F.when(F.col(path).isNotNull(), F.col("dest")))


def flag_sources(df: DataFrame) -> DataFrame:
    hit = df.filter(F.col("flagged"))
    return hit.agg(
        F.count(F.lit(1)).alias("n_flagged"),
        F.count_if(F.col("anchor") == "patient_anchor").alias("n_patient_anchor"),
        F.count_if(F.col("anchor") == "timepoint_anchor").alias("n_timepoint_anchor"),
        F.count_if(F.col("anchor").isNull()).alias("n_individual"),
    )


def category_share(df: DataFrame) -> DataFrame:
    n_manual, n = F.count_if("manual"), F.count(F.lit(1))
    one = df.agg(n_manual.alias("m"), n.alias("n"))
    rows = F.array(
        F.struct(F.lit("manual_correction").alias("category"), F.col("m").alias("k")),
        F.struct(F.lit("acceptable").alias("category"), (F.col("n") - F.col("m")).alias("k")),
    )
    return one.select("n", F.inline(rows)).select("category", F.col("k").alias("n_rows"), (F.col("k") * 100.0 / F.col("n")).alias("percent"))


def category_by_type(df: DataFrame) -> DataFrame:
    """Counts per study type plus the grand total (study type null)."""
    return df.rollup("study_type").agg(
        F.count_if(~F.col("manual")).alias("acceptable"), F.count_if("manual").alias("manual_correction"), F.count(F.lit(1)).alias("total")
    )


def manual_per_patient(df: DataFrame) -> DataFrame:
    per = df.filter("manual").groupBy("patient_id").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("n_patients"), F.min("n").alias("min_rows"), F.max("n").alias("max_rows"), F.avg("n").alias("mean_rows"))


def missing_by_kind(df: DataFrame, files: DataFrame) -> DataFrame:
    """Result paths that are named but not on disk, by kind."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("path")) for k, c in (("image", "coreg_image"), ("seg", "coreg_seg"), ("overlay", "overlay"))])
    named = df.select(F.inline(kinds)).filter(F.coalesce(F.col("path"), F.lit("")) != "")
    return named.join(files.select("path").distinct(), "path", "left_anti").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
