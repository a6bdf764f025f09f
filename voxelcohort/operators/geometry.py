"""Geometry of sparse masks ``(volume_id, i, j, k)``: components, moments, boxes, crops, windows."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelcohort.operators.distance import groups, nearest_squared, within
from voxelcohort.operators.windows import cut_boxes, shift
from voxelcohort.session import cut_lineage

AXES = ("i", "j", "k")


# --- connected components --------------------------------------------------------------------------

def _label_block(points: np.ndarray) -> np.ndarray:
    """Component of each point (rows of distinct integer coordinates in order), named by the place of its first point.

    Neighbours along each axis are linked; every round hooks each root to the smallest it touches and
    follows the hooks to their ends, all points at once.
    """
    span = points.max(0) - points.min(0) + 2  # a gap, so that no line runs into the next
    place = ((points - points.min(0)) * np.array([span[1] * span[2], span[2], 1])).sum(1)
    ends = []
    for hop in (span[1] * span[2], span[2], 1):
        at = np.minimum(np.searchsorted(place, place + hop), len(place) - 1)
        near = np.flatnonzero(place[at] == place + hop)
        ends.append((near, at[near]))
    u, v = (np.concatenate(x) for x in zip(*ends))
    root = np.arange(len(points))
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return root
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def _labelled_blocks(masks: DataFrame, edge: int) -> DataFrame:
    """Voxels with the first voxel ``(ri, rj, rk)`` of their component inside their block of ``edge`` voxels a side."""
    cell = [F.floor(F.col(a) / edge).cast("long").alias(f"b{a}") for a in AXES]
    own = masks.select("volume_id", *[F.col(a).cast("long").alias(a) for a in AXES], *cell).distinct()
    keys = ["volume_id", *[f"b{a}" for a in AXES]]
    schema = T.StructType([T.StructField("volume_id", masks.schema["volume_id"].dataType), *(T.StructField(c, T.LongType()) for c in (*AXES, "ri", "rj", "rk"))])

    def label(batches):
        for table in groups(batches, keys):
            points = np.stack([table[a].to_numpy() for a in AXES], 1)
            first = points[_label_block(points)]
            yield pa.RecordBatch.from_arrays([table["volume_id"].combine_chunks(), *(pa.array(points[:, n]) for n in range(3)), *(pa.array(first[:, n]) for n in range(3))], names=schema.names)

    return own.repartition(*keys).sortWithinPartitions(*keys, *AXES).mapInArrow(label, schema)


def components(masks: DataFrame, edge: int = 64) -> DataFrame:
    """Adds ``component`` (6-neighbour connectivity), numbered by its first voxel.

    Blocks of ``edge`` voxels a side are labelled one by one on arrays. Only voxels on the
    faces between blocks travel after that: they link components of neighbouring blocks. Every round hooks
    each root to its smallest neighbour, follows the hooks to their ends by
    doubling and keeps only links between different roots. Each round is stored.
    """
    voxels = cut_lineage(_labelled_blocks(masks, edge).withColumn("n", F.struct(F.col("ri").alias("i"), F.col("rj").alias("j"), F.col("rk").alias("k"))).drop("ri", "rj", "rk"))
    links = None
    for a in AXES:  # a voxel on the last plane of its block, and the next one along the axis
        last = voxels.filter(F.pmod(F.col(a), F.lit(edge)) == edge - 1).select("volume_id", *[(F.col(x) + int(x == a)).alias(x) for x in AXES], F.col("n").alias("u"))
        first = voxels.filter(F.pmod(F.col(a), F.lit(edge)) == 0).select("volume_id", *AXES, F.col("n").alias("v"))
        met = last.join(first, ["volume_id", *AXES]).select("volume_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        links = met if links is None else links.unionByName(met)
    links = cut_lineage(links.distinct())
    parent = links.select("volume_id", F.explode(F.array("u", "v")).alias("n")).distinct().withColumn("root", F.col("n"))
    while not links.isEmpty():  # every round merges all roots that have a smaller neighbour
        hook = links.groupBy("volume_id", F.col("v").alias("root")).agg(F.min("u").alias("to"))
        while True:  # jump until every hook ends at a root; path lengths halve each time
            hook = cut_lineage(hook)
            up = hook.select("volume_id", F.col("root").alias("to"), F.col("to").alias("further"))
            jump = hook.join(up, ["volume_id", "to"])
            if jump.isEmpty():
                break
            hook = hook.join(up, ["volume_id", "to"], "left").select("volume_id", "root", F.coalesce("further", "to").alias("to"))
        parent = parent.join(hook, ["volume_id", "root"], "left").select("volume_id", "n", F.coalesce("to", "root").alias("root"))
        for end in ("u", "v"):
            links = links.join(hook.withColumnRenamed("root", end), ["volume_id", end], "left").withColumn(end, F.coalesce("to", end)).drop("to")
        links = links.filter(F.col("u") != F.col("v")).select("volume_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        links, parent = cut_lineage(links.distinct()), cut_lineage(parent)
    root = F.coalesce("root", "n")
    named = voxels.join(parent, ["volume_id", "n"], "left").withColumn("component", F.concat_ws(",", root["i"], root["j"], root["k"]))
    return named.select("volume_id", *[F.col(a).cast(masks.schema[a].dataType).alias(a) for a in AXES], "component")


def component_sizes(labelled: DataFrame) -> DataFrame:
    first = F.min(F.struct(*AXES)).alias("first")
    return labelled.groupBy("volume_id", "component").agg(F.count(F.lit(1)).alias("n_voxels"), first)


def largest_component(masks: DataFrame) -> DataFrame:
    """Voxels of the largest component; of equal ones the first in row-major order."""
    labelled = components(masks)
    best = component_sizes(labelled).groupBy("volume_id").agg(
        F.min_by("component", F.struct(-F.col("n_voxels"), F.col("first"))).alias("component"))
    return labelled.join(best, ["volume_id", "component"], "left_semi").select("volume_id", *AXES)


# --- moments and axes -------------------------------------------------------------------------------

def centroid(masks: DataFrame, volumes: DataFrame) -> DataFrame:
    """Mean voxel index and its position in mm."""
    mean = masks.groupBy("volume_id").agg(*[F.avg(a).alias(f"c{a}") for a in AXES])
    return mean.join(volumes.select("volume_id", "spacing"), "volume_id").select(
        "volume_id", *[f"c{a}" for a in AXES], *[(F.col(f"c{a}") * F.get("spacing", n)).alias(f"mm_{a}") for n, a in enumerate(AXES)])


def inertia(masks: DataFrame, volumes: DataFrame) -> DataFrame:
    """Inertia tensor (trace times identity minus covariance) in voxel and mm space, row-major arrays."""
    pairs = [(a, b) for n, a in enumerate(AXES) for b in AXES[n:]]
    cov = masks.groupBy("volume_id").agg(*[F.covar_pop(a, b).alias(f"{a}{b}") for a, b in pairs])
    told = cov.join(volumes.select("volume_id", "spacing"), "volume_id")

    def tensor(scale):
        def cell(a, b):
            x, y = sorted((a, b))
            return F.col(f"{x}{y}") * scale(x) * scale(y)

        trace = cell("i", "i") + cell("j", "j") + cell("k", "k")
        return F.array(*[(trace - cell(a, b)) if a == b else -cell(a, b) for a in AXES for b in AXES])

    return told.select("volume_id", "spacing", tensor(lambda a: F.lit(1.0)).alias("tensor_vox"),
                       tensor(lambda a: F.get("spacing", AXES.index(a))).alias("tensor_mm"))


def _cross(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [a[(n + 1) % 3] * b[(n + 2) % 3] - a[(n + 2) % 3] * b[(n + 1) % 3] for n in range(3)]


def _long_axis(df: DataFrame, tensor: str, out: str) -> DataFrame:
    """Adds ``out``, the unit eigenvector of the smallest eigenvalue of a symmetric 3x3 tensor, dominant component positive.

    Eigenvalues of a symmetric 3x3 matrix have a closed trigonometric form. The
    rows of the tensor less the eigenvalue span the plane across the axis, so the
    longest of their cross products points along it. Where that plane is a line
    or a point (equal smallest eigenvalues) any vector across it serves: the one
    with most of the first possible coordinate axis.
    """
    cell = lambda r, c: (F.get(tensor, 3 * r + c) + F.get(tensor, 3 * c + r)) / 2
    mean = (cell(0, 0) + cell(1, 1) + cell(2, 2)) / 3
    df = df.withColumns({"_m": mean, "_size": F.sqrt(sum((cell(r, c) - (mean if r == c else 0)) ** 2 for r in range(3) for c in range(3)) / 6)})
    df = df.withColumn("_b", F.array(*[F.when(F.col("_size") > 0, (cell(r, c) - (F.col("_m") if r == c else 0)) / F.col("_size")).otherwise(0.0) for r in range(3) for c in range(3)]))
    b = [[F.get("_b", 3 * r + c) for c in range(3)] for r in range(3)]
    half = sum(x * y for x, y in zip(b[0], _cross(b[1], b[2]))) / 2
    angle = F.acos(F.least(F.greatest(half, F.lit(-1.0)), F.lit(1.0))) / 3
    df = df.withColumn("_l", 2 * F.cos(angle + 2 * math.pi / 3))
    rows = [[b[r][c] - (F.col("_l") if r == c else 0) for c in range(3)] for r in range(3)]
    unit = [[F.lit(float(r == c)) for c in range(3)] for r in range(3)]
    length = lambda v: v[0] * v[0] + v[1] * v[1] + v[2] * v[2]
    pick = lambda vs: F.array_max(F.array(*[F.struct(length(v).alias("n"), F.lit(-k).alias("k"), F.array(*v).alias("v")) for k, v in enumerate(vs)]))
    df = df.withColumn("_c", pick([_cross(rows[0], rows[1]), _cross(rows[0], rows[2]), _cross(rows[1], rows[2])])).withColumn("_r", pick(rows))
    row = [F.get("_r.v", n) for n in range(3)]
    across = pick([_cross(row, _cross(u, row)) for u in unit])
    tiny = F.lit(1e-12)
    v = F.when(F.col("_c.n") > tiny, F.col("_c.v")).when(F.col("_r.n") > tiny, across["v"]).otherwise(F.array(*unit[0]))
    df = df.withColumn("_v", v)
    lead = F.array_max(F.transform("_v", lambda x, n: F.struct(F.abs(x).alias("a"), (-n).alias("n"), x.alias("x"))))["x"]
    scale = F.signum(lead) / F.sqrt(F.aggregate("_v", F.lit(0.0), lambda acc, x: acc + x * x))
    return df.withColumn(out, F.transform("_v", lambda x: x * scale)).drop("_m", "_size", "_b", "_l", "_c", "_r", "_v")


def principal_axes(tensors: DataFrame) -> DataFrame:
    """Long axis of each volume in voxel and mm space: unit length, dominant component positive."""
    both = _long_axis(_long_axis(tensors, "tensor_vox", "axis_vox"), "tensor_mm", "axis_mm")
    return both.select("volume_id", "axis_vox", "axis_mm")


def _dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a) -> Column:
    return F.sqrt(_dot(a, a))


def angle_deg(a, b) -> Column:
    """Unsigned angle between two directions."""
    return F.degrees(F.acos(F.least(F.abs(_dot(a, b)) / (norm(a) * norm(b)), F.lit(1.0))))


def axis_to_mm(axis, spacing) -> Column:
    """Voxel direction as a unit direction in mm; null for a zero-length one."""
    scaled = F.zip_with(axis, spacing, lambda x, s: x * s)
    return F.when(norm(scaled) > 0, F.transform(scaled, lambda x: x / norm(scaled)))


# --- boxes, slices, crops ------------------------------------------------------------------------------

def bounding_box(masks: DataFrame) -> DataFrame:
    return masks.groupBy("volume_id").agg(*[f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("min", F.min), ("max", F.max))])


def max_area_slices(masks: DataFrame, volumes: DataFrame) -> DataFrame:
    """``(volume_id, axis, slice, area)``: the slice with most foreground per axis, the middle one without any."""
    per = masks.select("volume_id", F.inline(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("slice")) for a in AXES])))
    areas = per.groupBy("volume_id", "axis", "slice").agg(F.count(F.lit(1)).alias("area"))
    best = areas.groupBy("volume_id", "axis").agg(F.min_by(F.struct("slice", "area"), F.struct(-F.col("area"), F.col("slice"))).alias("_b"))
    frame = volumes.select("volume_id", F.inline(F.array(*[
        F.struct(F.lit(a).alias("axis"), F.floor(F.get("shape", n) / 2).cast("int").alias("_mid")) for n, a in enumerate(AXES)])))
    out = frame.join(best, ["volume_id", "axis"], "left")
    return out.select("volume_id", "axis", F.coalesce("_b.slice", "_mid").alias("slice"), F.coalesce("_b.area", F.lit(0)).alias("area"))


def _boxes(starts: DataFrame, sizes: Sequence[Column]) -> DataFrame:
    return starts.select("volume_id", F.array(*[F.col(f"s_{a}").cast("int") for a in AXES]).alias("lo"), F.array(*[n.cast("int") for n in sizes]).alias("size"))


def foreground_boxes(masks: DataFrame, margin: int = 16, multiple: int = 16) -> DataFrame:
    """Foreground boxes ``(volume_id, lo, size)`` with a margin, each size rounded up to a ``multiple``, the foreground kept centred."""
    box = bounding_box(masks)
    for a in AXES:
        lo, hi = F.col(f"min_{a}") - margin, F.col(f"max_{a}") + margin + 1
        size = F.ceil((hi - lo) / F.lit(multiple)) * multiple
        box = box.withColumns({f"s_{a}": lo - F.floor((size - (hi - lo)) / 2), f"n_{a}": size})
    return _boxes(box, [F.col(f"n_{a}") for a in AXES])


def crop_foreground(chunks: DataFrame, masks: DataFrame, margin: int = 16, multiple: int = 16) -> DataFrame:
    """Chunk pieces of the foreground box of :func:`foreground_boxes`; parts of the box outside the volume have no values."""
    return cut_boxes(chunks, foreground_boxes(masks, margin, multiple))


def _centres(volumes: DataFrame, masks: DataFrame, fallback) -> DataFrame:
    mean = masks.groupBy("volume_id").agg(*[F.avg(a).alias(f"c_{a}") for a in AXES])
    head = volumes.select("volume_id", *[F.get("shape", n).alias(f"n_{a}") for n, a in enumerate(AXES)])
    out = head.join(mean, "volume_id", "left")
    return out.withColumns({f"c_{a}": F.coalesce(f"c_{a}", fallback(F.col(f"n_{a}"))) for a in AXES})


def crop_center(chunks: DataFrame, volumes: DataFrame, masks: DataFrame, roi: Sequence[int]) -> DataFrame:
    """Crop around the mask's centroid, clamped to ``[half, dim - half]``; without a mask the middle."""
    c = _centres(volumes, masks, lambda n: F.floor(n / 2).cast("double"))
    for a, r in zip(AXES, roi):
        centre = F.greatest(F.lit(float(r // 2)), F.least(F.col(f"c_{a}"), (F.col(f"n_{a}") - r // 2).cast("double")))
        c = c.withColumn(f"s_{a}", F.greatest(F.floor(centre) - r // 2, F.lit(0)))
    return cut_boxes(chunks, _boxes(c, [F.lit(r) for r in roi]))


def crop_center_k(chunks: DataFrame, volumes: DataFrame, masks: DataFrame, roi: Sequence[int], multiple: int | None = None) -> DataFrame:
    """Like :func:`crop_center` with the centre rounded (half to even) and the start floored to a ``multiple``."""
    c = _centres(volumes, masks, lambda n: n / 2.0)
    for a, r in zip(AXES, roi):
        half = r // 2
        centre = F.bround(F.col(f"c_{a}"), 0)
        if multiple:
            centre = F.floor((centre - half) / multiple) * multiple + half
        centre = F.least(F.greatest(centre.cast("int"), F.lit(half)), F.col(f"n_{a}") - half - 1)
        c = c.withColumn(f"s_{a}", F.greatest(centre - half, F.lit(0)))
    return cut_boxes(chunks, _boxes(c, [F.lit(r) for r in roi]))


def pad_to(chunks: DataFrame, volumes: DataFrame, size: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """Pad symmetrically to a minimum size: moved chunk pieces and new headers.

    Padding itself is not written: a place without a value has the pad value.
    """
    pads = [F.greatest(F.lit(s) - F.get("shape", n), F.lit(0)) for n, s in enumerate(size)]
    head = volumes.withColumns({f"_p_{a}": p for a, p in zip(AXES, pads)})
    left = head.select("volume_id", F.array(*[F.floor(F.col(f"_p_{a}") / 2).cast("int") for a in AXES]).alias("by"))
    shape = F.array(*[F.get("shape", n) + F.col(f"_p_{a}") for n, a in enumerate(AXES)])
    return shift(chunks, left), head.withColumn("shape", shape).drop(*[f"_p_{a}" for a in AXES])


# --- sliding windows -------------------------------------------------------------------------------------

def _starts(dim: Column, r: int, overlap: float) -> Column:
    step = max(int(r * (1 - overlap)), 1)
    last = F.greatest(dim - r, F.lit(0))
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.ceil(last / F.lit(step)).cast("int")), lambda n: F.least(n * step, last)))


def patch_windows(volumes: DataFrame, roi: Sequence[int], overlap: float) -> DataFrame:
    """Overlapping windows ``(volume_id, wi, wj, wk)`` by their start; the last one is flush with the edge."""
    out = volumes.select("volume_id", "shape")
    for n, (a, r) in enumerate(zip(AXES, roi)):
        out = out.withColumn(f"w{a}", F.explode(_starts(F.get("shape", n), r, overlap)))
    return out.drop("shape")


# --- growth ------------------------------------------------------------------------------------------------

def neighbour_counts(masks: DataFrame) -> DataFrame:
    """``(volume_id, i, j, k, inside, n)``: for each mask voxel and 6-neighbour of one, whether it is
    in the mask and how many of its neighbours are. One exchange, combined before it."""
    hops = [(0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
    to = F.array(*[F.struct(*[(F.col(a) + s).alias(a) for a, s in zip(AXES, h)], F.lit(int(not any(h))).alias("me")) for h in hops])
    return masks.select("volume_id", F.inline(to)).groupBy("volume_id", *AXES).agg(
        (F.max("me") == 1).alias("inside"), F.sum(1 - F.col("me")).alias("n"))


def surface(masks: DataFrame) -> DataFrame:
    """Mask voxels with a background 6-neighbour."""
    return neighbour_counts(masks).filter(F.col("inside") & (F.col("n") < 6)).select("volume_id", *AXES)


def _inside_shape(shape: str = "shape") -> Column:
    ok = F.lit(True)
    for n, a in enumerate(AXES):
        ok = ok & (F.col(a) >= 0) & (F.col(a) < F.get(shape, n))
    return ok


def dilate(masks: DataFrame, volumes: DataFrame, mm: float) -> DataFrame:
    """Grow masks by a ball of ceil(mm / smallest spacing) voxels, cut at the volume's edge.

    Distances are those to surface voxels: a voxel nearest to a point outside is on the surface.
    """
    shell = surface(masks)
    head = volumes.select("volume_id", "shape", F.ceil(F.lit(float(mm)) / F.array_min("spacing")).cast("long").alias("_r"))
    box = shell.groupBy("volume_id").agg(*[f(a).alias(f"_{n}{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))]).join(head, "volume_id")
    for n, a in enumerate(AXES):
        box = box.withColumn(f"{a}0", F.least(F.greatest(F.col(f"_lo{a}") - F.col("_r"), F.lit(0)), F.col(f"_lo{a}")).cast("long"))
        box = box.withColumn(f"{a}1", F.greatest(F.least(F.col(f"_hi{a}") + F.col("_r"), F.get("shape", n) - 1), F.col(f"_hi{a}")).cast("long"))
    grown = within(shell, box.withColumn("limit", (F.col("_r") * F.col("_r")).cast("double")), ["volume_id"])
    grown = grown.join(head, "volume_id").filter(_inside_shape()).select("volume_id", *[F.col(a).cast("int").alias(a) for a in AXES])
    return grown.unionByName(masks.select("volume_id", *AXES)).distinct()


def inner_distance(masks: DataFrame, volumes: DataFrame, cap_mm: float) -> DataFrame:
    """Distance in mm of each mask voxel to the nearest background voxel of the volume, at most ``cap_mm``.

    The nearest background voxel touches the mask, so only those count.
    """
    head = volumes.select("volume_id", "shape", F.col("spacing").alias("steps"))
    shell = neighbour_counts(masks).filter(~F.col("inside")).join(head, "volume_id").filter(_inside_shape())
    near = nearest_squared(masks, shell, ["volume_id"], head).select("volume_id", *[F.col(a).cast("int").alias(a) for a in AXES], F.sqrt("d2").alias("_d"))
    return masks.select("volume_id", *AXES).join(near.distinct(), ["volume_id", *AXES], "left").select(
        "volume_id", *AXES, F.least(F.coalesce("_d", F.lit(float(cap_mm))), F.lit(float(cap_mm))).alias("dist_mm"))


def feather_alpha(dist: DataFrame, width_mm: float) -> DataFrame:
    """Blend weight: smoothstep of distance over width; a width of 0 keeps the mask hard."""
    if width_mm <= 0:
        return dist.withColumn("alpha", F.lit(1.0))
    t = F.least(F.greatest(F.col("dist_mm") / width_mm, F.lit(0.0)), F.lit(1.0))
    return dist.withColumn("alpha", t * t * (3.0 - 2.0 * t))

