"""Distances between the surfaces of mask pairs, in voxels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelcohort.operators.distance import nearest_squared
from voxelcohort.operators.geometry import AXES, surface
from voxelcohort.operators.quantiles import quantiles
from voxelcohort.session import cut_lineage

PAIR = ["a_id", "b_id", "side"]


def _distances(pairs: DataFrame, shell: DataFrame) -> DataFrame:
    """Distance of every surface point to the nearest one of the other mask, in both directions of each pair."""
    both = F.array(
        F.struct(F.lit("a").alias("side"), F.col("a_id").alias("_m"), F.col("b_id").alias("_o")),
        F.struct(F.lit("b").alias("side"), F.col("b_id").alias("_m"), F.col("a_id").alias("_o")),
    )
    asked = pairs.select("a_id", "b_id", F.inline(both))
    asks = asked.join(shell.withColumnRenamed("volume_id", "_m"), "_m").select(*PAIR, *AXES)
    found = asked.join(shell.withColumnRenamed("volume_id", "_o"), "_o").select(*PAIR, *AXES)
    return nearest_squared(asks, found, PAIR).select(*PAIR, F.sqrt("d2").alias("d"))


def surface_distances(pairs: DataFrame, masks: DataFrame) -> DataFrame:
    """``(a_id, b_id, side, d)``: distance of every surface point to the nearest one of the other mask.

    Exact, by the distance transform of ``nearest_squared`` over the box of
    both surfaces. Pairs with an empty side have no rows.
    """
    return _distances(pairs, cut_lineage(surface(masks)))


def hausdorff95(pairs: DataFrame, masks: DataFrame, q: float = 0.95) -> DataFrame:
    """95th percentile surface distance, the larger of both directions; null when a mask is empty."""
    per = quantiles(surface_distances(pairs, masks), ["a_id", "b_id", "side"], "d", [q])
    worst = per.groupBy("a_id", "b_id").agg(F.max(F.get("q", 0)).alias("hd95"))
    return pairs.select("a_id", "b_id").join(worst, ["a_id", "b_id"], "left")


def surface_dice(pairs: DataFrame, masks: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Share of surface points within ``tolerance`` of the other surface; null when both are empty."""
    shell = cut_lineage(surface(masks))
    close = _distances(pairs, shell).filter(F.col("d") <= tolerance).groupBy("a_id", "b_id").agg(F.count(F.lit(1)).alias("_c"))
    sizes = shell.groupBy("volume_id").agg(F.count(F.lit(1)).alias("n"))
    out = pairs.select("a_id", "b_id").join(close, ["a_id", "b_id"], "left")
    for side in "ab":
        out = out.join(sizes.withColumnsRenamed({"volume_id": f"{side}_id", "n": f"_n{side}"}), f"{side}_id", "left")
    out = out.fillna(0, ["_c", "_na", "_nb"])
    total = F.col("_na") + F.col("_nb")
    return out.select("a_id", "b_id", F.when(total > 0, F.col("_c") / total).alias("surface_dice"))
