"""Incremental processing: what to redo, what to skip, how results come back."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelcohort.functions import paths as P

MODES = ("skip_all", "process_new", "smart", "force_reprocess")


def plan_incremental(df: DataFrame, mode: str, version: str, group: Sequence[str] = ("patient_id",)) -> DataFrame:
    """Adds ``skipped`` (the whole group is done) and ``process`` (this row is to be done).

    ``skip_all`` and ``process_new`` skip a group whose rows are all registered,
    ``smart`` also wants them current; of the other groups ``process_new`` takes
    the new rows, ``smart`` the new and outdated ones, the rest takes everything.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; must be one of {MODES}")
    old = ~F.col("version").eqNullSafe(F.lit(version))
    new = F.col("coreg_image").isNull()
    if mode == "force_reprocess":
        return df.withColumns({"skipped": F.lit(False), "process": F.lit(True)})
    # modes look at the same columns, so plans of several modes share the exchange of the rows
    rows = df.withColumn("_todo", F.when(new, 2).when(old, 1).otherwise(0))
    todo = F.col("_todo")
    row_done = todo == 0 if mode == "smart" else todo < 2
    todo_row = {"skip_all": todo >= 0, "process_new": todo == 2, "smart": todo > 0}[mode]
    state = rows.groupBy(*group).agg(F.bool_and(row_done).alias("skipped"))
    return rows.join(state, list(group)).withColumn("process", ~F.col("skipped") & todo_row).drop("_todo")


def outdated(df: DataFrame, version: str) -> DataFrame:
    return df.filter(F.col("coreg_image").isNotNull() & ~F.col("version").eqNullSafe(F.lit(version)))


def plan_todo(df: DataFrame, outputs: DataFrame, inputs: DataFrame, row_id: str = "row_id", path: str = "image_path") -> DataFrame:
    """Adds ``reason`` (null = to do) and the matching outputs of finished rows.

    Reasons in order: ``unsupported_extension``, ``already_processed``,
    ``missing_file``. ``outputs`` has file names, ``inputs`` has paths.
    """
    name = P.base_name(path)
    asked = df.select(row_id, F.explode(P.expected_names(P.strip_ext(name))).alias("name"))
    hits = (
        asked.join(outputs.select("name").distinct(), "name")
        .groupBy(row_id).agg(F.array_join(F.array_sort(F.collect_set("name")), ";").alias("matched"))  # at most 3 names
    )
    present = inputs.select(F.col("path").alias(path), F.lit(True).alias("_present")).distinct()
    reason = (
        F.when(~name.rlike(P.NIFTI_EXT), "unsupported_extension")
        .when(F.col("matched").isNotNull(), "already_processed")
        .when(F.col("_present").isNull(), "missing_file")
    )
    out = df.join(hits, row_id, "left").join(present, path, "left").withColumn("reason", reason)
    return out.withColumn("matched", F.when(F.col("reason") == "already_processed", F.col("matched"))).drop("_present")


def skip_reasons(plan: DataFrame) -> DataFrame:
    return plan.filter(F.col("reason").isNotNull()).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def pending(plan: DataFrame, outputs: DataFrame, excluded: DataFrame, row_id: str = "row_id", path: str = "image_path") -> DataFrame:
    """Planned rows without any finished output and not excluded."""
    done = plan.select(row_id, F.explode(P.expected_names(P.strip_ext(P.base_name(path)))).alias("name")).join(
        outputs.select("name"), "name", "left_semi")
    return plan.join(done, row_id, "left_anti").join(excluded.select(row_id), row_id, "left_anti")


def apply_updates(df: DataFrame, updates: DataFrame, columns: Sequence[str], row_id: str = "row_id") -> DataFrame:
    """Apply ``(row_id, seq, column, value)`` updates; the last write to a cell wins, a null too.

    Updates of unknown rows have no effect.
    """
    cells = updates.filter(F.col("column").isin(*columns)).groupBy(row_id).agg(*[
        F.max(F.when(F.col("column") == c, F.struct("seq", "value"))).alias(f"_u_{c}") for c in columns
    ])
    out = df.join(cells, row_id, "left")
    types = dict(df.dtypes)
    new = {c: F.when(F.col(f"_u_{c}").isNotNull(), F.col(f"_u_{c}.value").cast(types[c])).otherwise(F.col(c)) for c in columns}
    return out.withColumns(new).drop(*[f"_u_{c}" for c in columns])


def overlay_checkpoint(df: DataFrame, saved: DataFrame, columns: Sequence[str], row_id: str = "row_id") -> DataFrame:
    """Take the saved values, nulls included, of every row the checkpoint holds."""
    back = saved.select(row_id, F.lit(True).alias("_saved"), *[F.col(c).alias(f"_s_{c}") for c in columns])
    out = df.join(back, row_id, "left")
    new = {c: F.when(F.col("_saved"), F.col(f"_s_{c}")).otherwise(F.col(c)) for c in columns}
    return out.withColumns(new).drop("_saved", *[f"_s_{c}" for c in columns])


def remaining_groups(df: DataFrame, saved: DataFrame, group: str = "patient_id") -> DataFrame:
    return df.join(saved.select(group).distinct(), group, "left_anti")


# fixed values: finest grain first
GRAINS: Mapping[str, int] = {"row": 0, "timepoint": 1, "patient": 2}


def attribute_errors(df: DataFrame, errors: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Adds ``error_details``: an error of the row, else of its timepoint, else of its patient.

    ``errors`` has ``(grain, patient_id, key, message)``; ``key`` is the id of the
    row or patient or the name of the timepoint, and ``patient_id`` says whose
    timepoint it is. Several messages of one key keep the greatest text.
    """

    def part(grain, *cols):
        own = errors.filter(F.col("grain") == grain)
        own = own.select(*[F.col(c).cast("string").alias(k) for c, k in zip(("key", "patient_id"), cols)], "message")
        return own.groupBy(*cols).agg(F.max("message").alias(f"_{grain}"))

    out = df.withColumns({"_r": F.col(row_id).cast("string"), "_t": F.col("timepoint").cast("string"), "_p": F.col("patient_id").cast("string")})
    for grain, cols in (("row", ["_r"]), ("timepoint", ["_t", "_p"]), ("patient", ["_p"])):
        out = out.join(part(grain, *cols), cols, "left")
    return out.withColumn("error_details", F.coalesce(*[f"_{g}" for g in sorted(GRAINS, key=GRAINS.get)])).drop(
        "_r", "_t", "_p", *[f"_{g}" for g in GRAINS])


def run_summary(df: DataFrame) -> DataFrame:
    role = F.col("anchor")
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(role == "patient_anchor").alias("n_patient_anchors"),
        F.count_if(role == "timepoint_anchor").alias("n_timepoint_anchors"),
        F.count("coreg_image").alias("n_coreg_images"),
        F.count("coreg_seg").alias("n_coreg_segs"),
        F.count("error_details").alias("n_errors"),
    )


def outcome_counts(results: DataFrame) -> DataFrame:
    kind = F.when(F.col("skipped"), "skipped").when(F.col("error_details").isNotNull(), "error").otherwise("success")
    return results.groupBy(kind.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def error_report(df: DataFrame) -> DataFrame:
    """Rows with an error, each with the number of errors and of all rows."""
    n_errors, n_total = df.agg(F.count("error_details")).scalar(), df.agg(F.count(F.lit(1))).scalar()
    return df.filter(F.col("error_details").isNotNull()).withColumns({"n_errors": n_errors, "n_total": n_total})
