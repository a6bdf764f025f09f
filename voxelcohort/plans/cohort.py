"""From a manifest to a processing plan and a run summary."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelcohort.operators import anchors as A
from voxelcohort.operators import cohort as C
from voxelcohort.operators import incremental as I
from voxelcohort.operators import linkage as L


@dataclass(frozen=True)
class CohortPlan:
    """Rows to process with their anchors and transform chains, and all rows with roles."""

    todo: DataFrame
    roles: DataFrame


def plan_cohort(
    manifest: DataFrame, types: Sequence[str], mode: str, version: str, finished: DataFrame | None = None, metric: str = "metric",
    modality: str | None = None, prefer_coreg: bool = False, row_id: str = "row_id",
) -> CohortPlan:
    """Filter a manifest, leave out checkpointed patients, decide what to redo and place it in the anchor hierarchy.

    ``manifest`` has a ``tracker`` (patient_order_days) plus the columns the anchor
    and incremental operators read.
    """
    kept = C.keep_types(L.split_patient_timepoint(manifest), types)
    if finished is not None:
        kept = I.remaining_groups(kept, finished)
    planned = I.plan_incremental(kept, mode, version)
    how = {"metric": metric, "modality": modality, "prefer_coreg": prefer_coreg, "row_id": row_id}
    roles = A.transform_chain(A.anchor_roles(A.with_anchors(planned, **how), row_id), row_id)
    return CohortPlan(todo=roles.filter("process"), roles=roles)


def close_run(plan: CohortPlan, updates: DataFrame, errors: DataFrame, columns: Sequence[str], row_id: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """Fold the workers' updates and errors back in: the finished table and its one-row summary."""
    done = I.attribute_errors(I.apply_updates(plan.roles, updates, columns, row_id), errors, row_id)
    return done, I.run_summary(done).withColumn("version_run", F.current_date())
