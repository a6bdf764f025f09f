"""Cohort filters, mask selection and presence matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelcohort.operators.skew import range_position


def keep_types(df: DataFrame, types: Sequence[str], col: str = "study_type") -> DataFrame:
    return df.filter(F.col(col).isin(*types))


def require_labels(df: DataFrame, labels: Sequence[str], col: str = "study_labels") -> DataFrame:
    for label in labels:
        df = df.filter(F.lower(col).contains(label.lower()))
    return df


def exclude_labels(df: DataFrame, labels: Sequence[str], col: str = "study_labels") -> DataFrame:
    for label in labels:
        df = df.filter(~F.coalesce(F.lower(col).contains(label.lower()), F.lit(False)))
    return df


def exclude_values(df: DataFrame, values: Sequence[str], col: str = "study_labels") -> DataFrame:
    return df.filter(F.col(col).isNull() | ~F.col(col).isin(*values))


def exclude_regex(df: DataFrame, pattern: str, col: str = "image_path") -> DataFrame:
    return df.filter(F.col(col).isNotNull() & ~F.col(col).rlike(f"(?i){pattern}"))


def split_kind(df: DataFrame, col: str = "file_type") -> tuple[DataFrame, DataFrame]:
    """Images and masks of one manifest."""
    return df.filter(F.col(col) == "MRI"), df.filter(F.col(col) == "mask")


def flag_multiple(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds the number of masks of the row's series and whether there are several."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_masks"))
    return df.join(counts, list(keys)).withColumn("multiple_masks", F.col("n_masks") > 1)


def mask_priority(user: str = "mask_user", labels: str = "study_labels"):
    """Smaller is better: checked admin masks, then numbered users, then the rest."""
    who = F.lower(F.trim(F.coalesce(user, F.lit(""))))
    checked = F.lower(F.coalesce(labels, F.lit(""))).contains("qc1")
    number = F.regexp_extract(who, r"(?:uva)?user(\d+)", 1)
    return (
        F.when((who == "admin") & checked, 0)
        .when(number != "", 100 + F.coalesce(F.nullif(number, F.lit("")), F.lit("0")).cast("int"))
        .otherwise(9999)
    )


def pick_best_mask(df: DataFrame, keys: Sequence[str], path: str = "path") -> DataFrame:
    """The preferred mask of each series; ties go to the smallest path."""
    w = Window.partitionBy(*keys).orderBy("_priority", path)
    ranked = df.withColumn("_priority", mask_priority()).withColumn("_rn", F.row_number().over(w))
    return ranked.filter(F.col("_rn") <= 1).drop("_rn", "_priority")


def list_masks(df: DataFrame, keys: Sequence[str], path: str = "path", joined: bool = False) -> DataFrame:
    """All masks of each series in path order, one row a mask: ``keys``, ``position`` from 1, ``path``.

    Null paths are no masks. With ``joined`` a series is one row with the sorted
    paths as one text ``all_masks`` instead; ask for it only where a series'
    masks fit into one value.
    """
    keys = list(keys)
    named = df.filter(F.col(path).isNotNull()).select(*keys, path)
    if joined:
        return named.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(path)), "; ").alias("all_masks"))
    return range_position(named, keys, [path], "position")


def attach_masks(images: DataFrame, masks: DataFrame, keys: Sequence[str]) -> DataFrame:
    return images.join(masks, list(keys), "left")


def limit_patients(df: DataFrame, n: int, patient: str = "patient_id") -> DataFrame:
    """All rows of the first ``n`` patients in id order."""
    first = df.select(patient).distinct().orderBy(patient).limit(n)
    return df.join(first, patient, "left_semi")


def limit_rows(df: DataFrame, n: int, key: str) -> DataFrame:
    return df.orderBy(key).limit(n)


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), col)


def n_distinct(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.agg(*[F.countDistinct(c).alias(f"n_{c}") for c in cols])


def presence_matrix(df: DataFrame, types: Sequence[str], with_seg: bool = False, key: str = "tracker") -> DataFrame:
    """One row per timepoint with ``has_<type>`` flags, and ``seg_<type>`` when asked.

    The types are given, so one aggregate does it without a job to list them.
    """
    def flag(t, cond):
        return F.coalesce(F.max((F.col("study_type") == t) & cond), F.lit(False))

    cols = [flag(t, F.lit(True)).alias(f"has_{t}") for t in types]
    if with_seg:
        cols += [flag(t, F.col("seg_path").isNotNull()).alias(f"seg_{t}") for t in types]
    return df.groupBy(key).agg(*cols)


def with_both(matrix: DataFrame, a: str, b: str) -> DataFrame:
    return matrix.filter(F.col(a) & F.col(b))
