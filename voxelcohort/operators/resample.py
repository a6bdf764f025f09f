"""Resampling and placement on voxel rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelcohort.operators.geometry import AXES, bounding_box


def resample_trilinear(voxels: DataFrame, volumes: DataFrame, shape: Sequence[int]) -> DataFrame:
    """Trilinear resampling of dense volumes to ``shape`` (half-voxel centres, edges clamped).

    Every source voxel spreads its weighted value to the target voxels it takes
    part in; sums are combined before the one exchange, no corner is joined.
    """
    out = voxels.join(volumes.select("volume_id", "shape"), "volume_id").withColumn("_w", F.lit(1.0))
    for n, (a, size) in enumerate(zip(AXES, shape)):
        dim = F.get("shape", n)
        scale = dim / F.lit(size)
        lo = F.greatest(F.floor((F.col(a) - 0.5) / scale - 0.5), F.lit(0)).cast("int")
        hi = F.least(F.ceil((F.col(a) + 1.5) / scale - 0.5), F.lit(size - 1)).cast("int")
        # the first and last source voxel also serve the clamped targets
        lo = F.when(F.col(a) == 0, 0).otherwise(lo)
        hi = F.when(F.col(a) == dim - 1, size - 1).otherwise(hi)
        out = out.withColumn("_t", F.explode(F.when(lo <= hi, F.sequence(lo, hi))))
        at = F.greatest((F.col("_t") + 0.5) * scale - 0.5, F.lit(0.0))
        i0 = F.least(F.floor(at).cast("int"), dim - 1)
        i1 = F.least(i0 + 1, dim - 1)
        part = at - i0
        w = F.when(F.col(a) == i0, 1 - part).otherwise(0.0) + F.when(F.col(a) == i1, part).otherwise(0.0)
        out = out.withColumn("_w", F.col("_w") * w).filter(F.col("_w") > 0).withColumn(f"t_{a}", F.col("_t")).drop("_t")
    target = [F.col(f"t_{a}").alias(a) for a in AXES]
    return out.groupBy("volume_id", *target).agg(F.sum(F.col("_w") * F.col("value")).alias("value"))


def place_nearest(masks: DataFrame, placements: DataFrame) -> DataFrame:
    """Place masks into a target grid by nearest neighbour under an affine map.

    ``placements`` has ``(volume_id, m, offset, target_shape)``: the source
    coordinate of target voxel t is ``m t + offset`` (``m`` row-major 3x3).
    Target voxels are listed only inside the box the source's foreground maps to.
    """
    def minor(r, c):
        (r0, r1), (c0, c1) = [x for x in range(3) if x != r], [x for x in range(3) if x != c]
        sign = "-" if (r + c) % 2 else ""
        return f"{sign}(m[{3 * r0 + c0}] * m[{3 * r1 + c1}] - m[{3 * r0 + c1}] * m[{3 * r1 + c0}])"

    det = " + ".join(f"m[{c}] * {minor(0, c)}" for c in range(3))
    inverse = ", ".join(f"{minor(c, r)} / ({det})" for r in range(3) for c in range(3))
    box = bounding_box(masks).join(placements, "volume_id").withColumn("_inv", F.expr(f"array({inverse})"))
    ends = (("min", "- 0.5"), ("max", "+ 0.5"))
    corners = [
        [f"({ends[b >> n & 1][0]}_{a} {ends[b >> n & 1][1]} - offset[{n}])" for n, a in enumerate(AXES)] for b in range(8)
    ]
    ranges = {}
    for r, a in enumerate(AXES):
        reach = [F.expr(" + ".join(f"_inv[{3 * r + c}] * {p[c]}" for c in range(3))) for p in corners]
        lo = F.greatest(F.floor(F.least(*reach)) - 1, F.lit(0)).cast("int")
        hi = F.least(F.ceil(F.greatest(*reach)) + 1, F.get("target_shape", r) - 1).cast("int")
        ranges[a] = F.when(lo <= hi, F.sequence(lo, hi))
    targets = box
    for a in AXES:
        targets = targets.withColumn(f"t_{a}", F.explode(ranges[a]))
    # ties go up, as floor(x + 0.5)
    source = {
        a: F.floor(sum(F.get("m", 3 * n + c) * F.col(f"t_{x}") for c, x in enumerate(AXES)) + F.get("offset", n) + 0.5).cast("int")
        for n, a in enumerate(AXES)
    }
    placed = targets.select("volume_id", *[F.col(f"t_{a}") for a in AXES], *[e.alias(a) for a, e in source.items()])
    hit = placed.join(masks.select("volume_id", *AXES), ["volume_id", *AXES], "left_semi")
    return hit.select("volume_id", *[F.col(f"t_{a}").alias(a) for a in AXES])
