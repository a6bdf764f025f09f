"""From placed timepoints to a validated batch."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from voxelcohort.operators import placement as P
from voxelcohort.operators import reports as R
from voxelcohort.session import cut_lineage


def validate_batch(
    tp: DataFrame, candidates: DataFrame, main_strategy: str, failed: DataFrame | None = None, thresholds: Mapping[str, float] = P.THRESHOLDS, voxel_mm3: float = 1.0
) -> DataFrame:
    """Flat case rows of a batch, exceptions included.

    Stored once, because every report of the batch reads it.
    """
    sure = P.confidence(candidates).filter(f"strategy = '{main_strategy}'").select("case_id", "confidence", "score_margin", "low_confidence")
    agree = P.strategies_agree(P.best_candidate(candidates), main_strategy)
    cases = P.case_summary(P.placement_metrics(tp, voxel_mm3)).join(sure, "case_id").join(agree, "case_id")
    flat = R.flatten_cases(P.validate(cases, thresholds))
    return cut_lineage(flat if failed is None else R.with_exceptions(flat, failed))
