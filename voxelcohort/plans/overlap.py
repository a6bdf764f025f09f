"""From series and masks to an overlap review."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from voxelcohort.operators import overlap as M
from voxelcohort.session import cut_lineage


@dataclass(frozen=True)
class OverlapReview:
    pairs: DataFrame
    counts: DataFrame
    per_study: DataFrame
    by_type: DataFrame


def review_overlap(series: DataFrame, masks: DataFrame) -> OverlapReview:
    """Pairs, their counts and the summaries; masks are joined once and the pairs stored for all readers."""
    pairs = cut_lineage(M.pairwise_dice(series, masks))
    per_study = cut_lineage(M.dice_per_study(series, masks, pairs))
    return OverlapReview(pairs, M.pair_counts(series, masks, pairs), per_study, M.dice_by_type(per_study))
