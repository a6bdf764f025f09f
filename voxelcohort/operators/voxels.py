"""Intensity operators on chunked volumes.

``chunks`` rows hold one block of a volume: ``volume_id, shape, spacing, unit,
bi, bj, bk, origin, dims, data``; ``data`` is row-major (third axis fastest).
Value maps stay on the arrays, per-volume statistics are joined to chunk rows,
and voxels are exploded only where a histogram or a coordinate join needs them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelcohort.operators.distance import group_starts, groups, whole_groups
from voxelcohort.operators.windows import cut_own_boxes, lists_of

# fixed values: largest finite float32, and cubic unit names
FLOAT32_MAX = 3.4028234663852886e38
CUBIC_UNITS = {"mm": "mm³", "um": "um³", "cm": "cm³", "pixels": "pixels³"}

#: Rows, one a chunk and percentile, that a batch of bounded values has at most.
SELECTED_ROWS = 1 << 16


def explode_voxels(chunks: DataFrame) -> DataFrame:
    """``(volume_id, i, j, k, value)``, one row per voxel."""
    dj, dk = F.get("dims", 1), F.get("dims", 2)
    pos = F.col("pos")
    flat = chunks.select("volume_id", "origin", "dims", F.posexplode("data").alias("pos", "v"))
    return flat.select(
        "volume_id",
        (F.get("origin", 0) + F.floor(pos / (dj * dk))).cast("int").alias("i"),
        (F.get("origin", 1) + F.floor(pos / dk) % dj).cast("int").alias("j"),
        (F.get("origin", 2) + pos % dk).cast("int").alias("k"),
        F.col("v").cast("double").alias("value"),
    )


def to_mask(voxels: DataFrame, threshold: float = 0.0) -> DataFrame:
    return voxels.filter(F.col("value") > threshold).select("volume_id", "i", "j", "k")


def map_values(chunks: DataFrame, fn) -> DataFrame:
    """Apply a column function to every value of every chunk."""
    return chunks.withColumn("data", F.transform(F.col("data").cast("array<double>"), fn))


def _values(chunks: DataFrame, *keep: str) -> DataFrame:
    return chunks.select("volume_id", *keep, F.explode("data").alias("v")).withColumn("v", F.col("v").cast("double"))


def value_range(chunks: DataFrame) -> DataFrame:
    """Minimum, maximum and number of the non-missing values per volume."""
    ok = F.filter("data", lambda v: v.isNotNull() & ~F.isnan(v))
    per = chunks.select("volume_id", F.array_min(ok).cast("double").alias("lo"), F.array_max(ok).cast("double").alias("hi"), F.size(ok).alias("n"))
    return per.groupBy("volume_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))


def bin_of(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Equal bins over [lo, hi], the last one closed."""
    return F.when(hi > lo, F.least(F.floor((v - lo) / (hi - lo) * bins), F.lit(bins - 1))).otherwise(0).cast("int")


def histogram(chunks: DataFrame, bins: int) -> DataFrame:
    """``(volume_id, lo, hi, bin, n)`` over the volume's own range, missing values left out."""
    binned = _values(chunks.join(value_range(chunks), "volume_id"), "lo", "hi").filter(F.col("v").isNotNull() & ~F.isnan("v"))
    return binned.groupBy("volume_id", "lo", "hi", bin_of(F.col("v"), F.col("lo"), F.col("hi"), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def entropy(chunks: DataFrame, bins: int = 256, integer: bool = False) -> DataFrame:
    """Shannon entropy in bits over a histogram; 0 for constant or empty volumes.

    With ``integer`` a range of at most ``bins`` values gets one bin per integer.
    """
    rng = value_range(chunks)
    flat = F.col("lo").isNull() | (F.col("hi") - F.col("lo") <= F.lit(1e-8) + F.lit(1e-5) * F.abs("lo"))
    equal = bin_of(F.col("v"), F.col("lo"), F.col("hi"), bins)
    spot = F.when(F.col("hi") - F.col("lo") + 1 <= bins, (F.col("v") - F.col("lo")).cast("int")).otherwise(equal) if integer else equal
    binned = _values(chunks.join(rng.filter(~flat), "volume_id"), "lo", "hi", "n").filter(F.col("v").isNotNull() & ~F.isnan("v"))
    counts = binned.groupBy("volume_id", "n", spot.alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    p = F.col("c") / F.col("n")
    bits = counts.groupBy("volume_id").agg((-F.sum(p * F.log2(p))).alias("entropy"))
    return rng.select("volume_id").join(bits, "volume_id", "left").withColumn("entropy", F.coalesce("entropy", F.lit(0.0)))


def _sorted_values(batch: pa.RecordBatch, name: str = "data") -> Iterator[np.ndarray]:
    """The values of each chunk of a batch in order, without the missing ones."""
    data = batch.column(batch.schema.get_field_index(name))
    values = data.values.to_numpy(zero_copy_only=data.values.null_count == 0)
    at = data.offsets.to_numpy()
    for lo, hi in zip(at[:-1], at[1:]):
        x = np.sort(values[lo:hi].astype(np.float64))
        yield x[: np.searchsorted(x, np.nan)]  # NaN is last


def rank_bounds(sizes: np.ndarray, knots: list[np.ndarray], ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each rank of all chunks together, a value that it is above and one that it is not above.

    ``knots`` are evenly spaced order statistics of each chunk. Between two knots of a
    chunk the number of its values up to some value is known up to their distance.
    """
    every = np.unique(np.concatenate(knots))
    least, most = np.zeros(len(every), np.int64), np.zeros(len(every), np.int64)
    for n, own in zip(sizes.tolist(), knots):
        place = _places(n, len(own))
        upto = np.searchsorted(own, every, "right")  # knots up to each value
        least += np.where(upto > 0, place[np.maximum(upto - 1, 0)] + 1, 0)
        most += np.where(upto < len(own), place[np.minimum(upto, len(own) - 1)], n)
    below = np.searchsorted(most, ranks, "right") - 1
    lo = np.where(below >= 0, every[np.maximum(below, 0)], -np.inf)
    return np.where(below >= 0, lo, np.nan), every[np.searchsorted(least, ranks + 1, "left")]


def _places(n: int, knots: int) -> np.ndarray:
    return np.round(np.linspace(0, n - 1, knots)).astype(np.int64)


def percentiles(chunks: DataFrame, ps: Sequence[float], knots: int | None = None) -> DataFrame:
    """Array ``q`` of exact percentiles (0..100) per volume, linearly interpolated; missing values are left out.

    Chunks are read twice and no value becomes a row. First each chunk gives ``knots`` order statistics (16 for each percentile, 256 at least); those
    of a volume bound the values at the wanted ranks. Then each chunk gives the number of its values
    below those bounds and the values inside them, which are ordered for each volume and percentile.
    """
    ps, most = [float(p) for p in ps], knots or min(8192, max(256, 16 * len(ps)))
    own = T.StructField("volume_id", chunks.schema["volume_id"].dataType)
    schema = lambda text: T.StructType([own, *T._parse_datatype_string(text).fields])

    def sketch(batches):
        for batch in batches:
            found = [(n, x) for n, x in enumerate(_sorted_values(batch)) if len(x)]
            if found:
                rows = [x[_places(len(x), min(most, len(x)))] for _, x in found]
                sizes = pa.array([len(x) for _, x in found], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([n for n, _ in found])), sizes, lists_of(rows, pa.list_(pa.float64()))], names=["volume_id", "n", "knots"])

    def bound(batches):
        for table in groups(batches, ["volume_id"]):
            sizes = table["n"].to_numpy()
            knots = table["knots"].combine_chunks()
            at, flat = np.concatenate([[0], np.cumsum(knots.value_lengths().to_numpy())]), knots.flatten().to_numpy()
            rank = (int(sizes.sum()) - 1) * np.array(ps) / 100
            lists = [flat[a:b] for a, b in zip(at[:-1], at[1:])]
            lo, _ = rank_bounds(sizes, lists, np.floor(rank).astype(np.int64))
            _, hi = rank_bounds(sizes, lists, np.ceil(rank).astype(np.int64))
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([table["volume_id"].slice(0, 1).combine_chunks(), pa.array([int(sizes.sum())]), lists_of([lo], kind), lists_of([hi], kind)], names=["volume_id", "n", "lo", "hi"])

    def select(batches):
        step = max(1, SELECTED_ROWS // max(1, len(ps)))
        for batch in (whole.slice(k, step) for whole in batches for k in range(0, whole.num_rows, step)):
            column = lambda c: batch.column(batch.schema.get_field_index(c))
            los, his = (column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(ps)) for c in ("lo", "hi"))
            below, ends, values = [], [], []
            for x, lo, hi in zip(_sorted_values(batch), los, his):
                first = np.where(np.isnan(lo), 0, np.searchsorted(x, lo, "right"))  # no lower bound: from the first on
                last = np.searchsorted(x, hi, "right")
                below.append(first)
                ends.append(last)
                width = np.maximum(last - first, 0)
                values.append(x[np.repeat(first - np.cumsum(width) + width, width) + np.arange(width.sum())])
            if not below:
                continue
            below, ends = np.concatenate(below), np.concatenate(ends)
            offsets = np.concatenate([[0], np.cumsum(np.maximum(ends - below, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values)), type=pa.list_(pa.float64()))
            rows = pa.array(np.repeat(np.arange(batch.num_rows), len(ps)))
            at = pa.array(np.tile(np.arange(len(ps), dtype=np.int32), batch.num_rows))
            yield pa.RecordBatch.from_arrays([column("volume_id").take(rows), at, pa.array(below.astype(np.int64)), column("n").take(rows), lists], names=["volume_id", "at", "below", "n", "values"])

    def pick(batches):
        for table in whole_groups(batches, ["volume_id", "at"]):
            starts = group_starts(table, ["volume_id", "at"])
            at, n, below = (table[c].to_numpy() for c in ("at", "n", "below"))
            lists = table["values"].combine_chunks()
            flat, ends = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            values = []
            for a, b in zip(starts, [*starts[1:], len(table)]):
                x, rank = np.sort(flat[ends[a] : ends[b]]), (int(n[a]) - 1) * ps[at[a]] / 100
                before = int(below[a:b].sum())
                low, high = (float(x[int(f(rank)) - before]) for f in (np.floor, np.ceil))
                values.append(low if low == high else low + (high - low) * (rank - np.floor(rank)))
            yield pa.RecordBatch.from_arrays([table["volume_id"].combine_chunks().take(pa.array(starts)), pa.array(at[starts]), pa.array(values)], names=["volume_id", "at", "v"])

    data = chunks.select("volume_id", "data")
    told = data.mapInArrow(sketch, schema("n long, knots array<double>")).repartition("volume_id").sortWithinPartitions("volume_id")
    bounds = told.mapInArrow(bound, schema("n long, lo array<double>, hi array<double>"))
    inside = data.join(bounds, "volume_id").mapInArrow(select, schema("at int, below long, n long, values array<double>"))
    found = inside.repartition("volume_id", "at").sortWithinPartitions("volume_id", "at").mapInArrow(pick, schema("at int, v double"))
    each = found.groupBy("volume_id").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("q"))  # one row a percentile
    return each.select("volume_id", F.transform("q", lambda x: x["v"]).alias("q"))


def standardise(chunks: DataFrame, low: float = 1, high: float = 99, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """Clip to the low and high percentile and rescale to [lo, hi]; no rescale when both coincide."""
    q = percentiles(chunks, [low, high]).select("volume_id", F.get("q", 0).alias("_p0"), F.get("q", 1).alias("_p1"))
    width = F.col("_p1") - F.col("_p0")

    def one(v):
        clipped = F.greatest(F.least(v, F.col("_p1")), F.col("_p0"))
        return F.when(width > 0, (clipped - F.col("_p0")) / width * (hi - lo) + lo).otherwise(clipped)

    return map_values(chunks.join(q, "volume_id"), one).select(*chunks.columns)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _interp(data: pd.Series, xs: pd.Series, ys: pd.Series) -> pd.Series:
    return pd.Series([np.interp(np.asarray(d, dtype="f8"), x, y) for d, x, y in zip(data, xs, ys)])


def histogram_match(
    source: DataFrame, reference: DataFrame, pairs: DataFrame, mask: DataFrame | None = None, points: int = 256, edge: Sequence[int] = (64, 64, 64)
) -> DataFrame:
    """Map each source volume onto the intensity distribution of its reference volume.

    ``pairs`` has ``volume_id`` and ``reference_id``. Quantile knots are taken
    inside ``mask`` (the whole volume where it is empty); values between knots
    are interpolated and clamped at the ends. ``edge`` is the chunk grid's block size.
    """
    ps = [100 * n / (points - 1) for n in range(points)]

    def knots(chunks, name):
        if mask is None:
            return percentiles(chunks, ps).select("volume_id", F.col("q").alias(name))
        masked = percentiles(inside_mask(chunks, mask, edge), ps)
        bare = chunks.join(masked.select("volume_id"), "volume_id", "left_anti")
        return masked.unionByName(percentiles(bare, ps)).select("volume_id", F.col("q").alias(name))

    wanted = reference.join(pairs.select(F.col("reference_id").alias("volume_id")).distinct(), "volume_id", "left_semi")
    xs = knots(source, "_xs")
    ys = knots(wanted, "_ys").withColumnRenamed("volume_id", "reference_id")
    told = source.join(pairs, "volume_id").join(xs, "volume_id").join(ys, "reference_id")
    return told.withColumn("data", _interp("data", "_xs", "_ys")).select(*source.columns)


def sanitise(chunks: DataFrame) -> DataFrame:
    """NaN to 0, infinities to the largest float32 of their sign."""

    def one(v):
        return (
            F.when(F.isnan(v), 0.0).when(v == F.lit(float("inf")), FLOAT32_MAX).when(v == F.lit(float("-inf")), -FLOAT32_MAX).otherwise(v)
        )

    return map_values(chunks, one)


def repair_spacing(volumes: DataFrame) -> DataFrame:
    """Replace impossible spacings by the median of the valid ones, or 1.0."""

    def good(x):
        return x.isNotNull() & ~F.isnan(x) & (x >= 1e-6) & (x <= 100)

    ok = F.array_sort(F.filter("spacing", good))
    n = F.size(ok)
    mid = F.floor((n - 1) / 2).cast("int")
    median = F.when(n == 0, 1.0).otherwise((F.get(ok, mid) + F.get(ok, F.floor(n / 2).cast("int"))) / 2)
    return volumes.withColumn("_m", median).withColumn(
        "spacing", F.transform("spacing", lambda x: F.when(good(x), x).otherwise(F.col("_m")))).drop("_m")


def valid_header(volumes: DataFrame) -> DataFrame:
    """Adds ``valid``: all spacings finite and positive, all dimensions positive."""

    def positive(x):
        return x.isNotNull() & ~F.isnan(x) & (x > 0) & (x < F.lit(float("inf")))

    return volumes.withColumn("valid", F.forall("spacing", positive) & F.forall("shape", lambda n: n > 0))


def voxel_volume(volumes: DataFrame) -> DataFrame:
    """Adds ``voxel_volume``; a 2-D spacing has depth 1, an unknown spacing (null or NaN) gives null."""
    return volumes.withColumn("voxel_volume", F.aggregate("spacing", F.lit(1.0), lambda acc, x: acc * F.when(~F.isnan(x), x)))


def cubic_unit(col: str) -> Column:
    names = F.create_map(*[F.lit(x) for kv in CUBIC_UNITS.items() for x in kv])
    return F.when(F.trim(col) != "", F.coalesce(F.try_element_at(names, F.lower(F.trim(col))), F.concat(F.col(col), F.lit("³"))))


def segmentation_volume(masks: DataFrame, volumes: DataFrame) -> DataFrame:
    """Foreground voxels times the voxel volume; 0 for volumes without foreground."""
    counts = masks.groupBy("volume_id").agg(F.count(F.lit(1)).alias("n_voxels"))
    head = voxel_volume(volumes).select("volume_id", "voxel_volume")
    out = head.join(counts, "volume_id", "left").withColumn("n_voxels", F.coalesce("n_voxels", F.lit(0)))
    return out.select("volume_id", "n_voxels", (F.col("n_voxels") * F.col("voxel_volume")).alias("segmentation_volume"))


def file_size_mb(files: DataFrame) -> DataFrame:
    return files.withColumn("file_size_mb", F.col("length") / 1048576)


def mutual_information(a: DataFrame, b: DataFrame, pairs: DataFrame, bins: int = 32) -> DataFrame:
    """Mutual information (nats) of aligned volume pairs ``(a_id, b_id)`` from the joint histogram.

    Chunks of both volumes meet on their block position; volumes on different
    grids are an error. A voxel that either volume lacks (null, NaN or in a chunk
    that is not there) counts in neither.
    """

    def side(chunks, ids, name):
        needed = chunks.join(pairs.select(F.col(ids).alias("volume_id")).distinct(), "volume_id", "left_semi")
        with_range = needed.join(value_range(needed), "volume_id")
        spots = F.transform("data", lambda v: F.when(~F.isnan(v), bin_of(v, F.col("lo"), F.col("hi"), bins)))
        here = with_range.select(F.col("volume_id").alias(ids), "bi", "bj", "bk", F.struct("shape", "origin", "dims").alias(f"{name}_grid"), spots.alias(name))
        return pairs.select("a_id", "b_id").distinct().join(here, ids)

    joint = side(a, "a_id", "x").join(side(b, "b_id", "y"), ["a_id", "b_id", "bi", "bj", "bk"])
    odd = F.raise_error(F.lit("volumes of a pair are chunked on different grids"))
    met = F.when(F.col("x_grid") == F.col("y_grid"), F.arrays_zip("x", "y")).otherwise(F.array(F.struct(odd.cast("int").alias("x"), F.lit(0).alias("y"))))
    known = joint.select("a_id", "b_id", F.explode(met).alias("z")).filter("z.x is not null and z.y is not null")
    cells = known.groupBy("a_id", "b_id", "z.x", "z.y").agg(F.count(F.lit(1)).alias("c"))
    # at most bins * bins rows per pair from here on
    w = lambda *by: Window.partitionBy("a_id", "b_id", *by)
    total = F.sum("c").over(w())
    cells = cells.withColumns({"p": F.col("c") / total, "px": F.sum("c").over(w("x")) / total, "py": F.sum("c").over(w("y")) / total})
    return cells.groupBy("a_id", "b_id").agg(F.sum(F.col("p") * F.ln(F.col("p") / (F.col("px") * F.col("py")))).alias("mi"))


def mi_gain(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.withColumnRenamed("mi", "mi_before").join(after.withColumnRenamed("mi", "mi_after"), ["a_id", "b_id"]).withColumn(
        "gain", F.col("mi_after") - F.col("mi_before"))


def coverage_guard(masks: DataFrame, volumes: DataFrame, min_pct: float = 10.0) -> DataFrame:
    """Mask coverage in percent; ``use_all`` marks volumes whose mask is too small to trust."""
    size = F.aggregate("shape", F.lit(1).cast("long"), lambda acc, n: acc * n)
    counts = masks.groupBy("volume_id").agg(F.count(F.lit(1)).alias("_c"))
    out = volumes.select("volume_id", size.alias("_n")).join(counts, "volume_id", "left")
    pct = F.when(F.col("_n") == 0, F.raise_error(F.lit("volume without voxels")).cast("double")).otherwise(F.coalesce("_c", F.lit(0)) * 100.0 / F.col("_n"))
    return out.select("volume_id", pct.alias("coverage_pct")).withColumn("use_all", F.col("coverage_pct") < min_pct)


def by_chunk(cells: DataFrame, edge: Sequence[int], *values: str) -> DataFrame:
    """Sparse voxel rows gathered per chunk: local positions on the full ``edge`` grid and their values.

    A gathered list holds at most the voxels of one chunk.
    """
    ei, ej, ek = edge
    spot = ((F.col("i") % ei) * ej + F.col("j") % ej) * ek + F.col("k") % ek
    at = [F.floor(F.col(c) / e).cast("int").alias(f"b{c}") for c, e in zip("ijk", edge)]
    lists = F.collect_list(F.struct(spot.cast("int").alias("_spots"), *values))
    return cells.groupBy("volume_id", *at).agg(lists.alias("_l")).select("volume_id", "bi", "bj", "bk", *[f"_l.{c}" for c in ("_spots", *values)])


CHUNK_KEY = ["volume_id", "bi", "bj", "bk"]


def inside_mask(chunks: DataFrame, masks: DataFrame, edge: Sequence[int] = (64, 64, 64)) -> DataFrame:
    """Chunks reduced to the values inside the mask; chunks without foreground are left out."""
    grid = tuple(int(e) for e in edge)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def pick(data: pd.Series, dims: pd.Series, spots: pd.Series) -> pd.Series:
        return pd.Series([
            np.asarray(d, dtype="f8").reshape(tuple(n))[np.unravel_index(np.asarray(s, dtype="i8"), grid)] for d, n, s in zip(data, dims, spots)
        ])

    return chunks.join(by_chunk(masks, grid), CHUNK_KEY).withColumn("data", pick("data", "dims", "_spots")).drop("_spots")


def apply_mask(chunks: DataFrame, masks: DataFrame, edge: Sequence[int] = (64, 64, 64)) -> DataFrame:
    """Zero the voxels outside the mask; ``edge`` is the chunk grid's block size."""
    grid = tuple(int(e) for e in edge)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def keep(data: pd.Series, dims: pd.Series, spots: pd.Series) -> pd.Series:
        out = []
        for d, n, s in zip(data, dims, spots):
            block = np.zeros(tuple(n))
            if s is not None and len(s):
                at = np.unravel_index(np.asarray(s, dtype="i8"), grid)
                block[at] = np.asarray(d, dtype="f8").reshape(tuple(n))[at]
            out.append(block.ravel())
        return pd.Series(out)

    told = chunks.join(by_chunk(masks, grid), CHUNK_KEY, "left")
    return told.withColumn("data", keep("data", "dims", "_spots")).select(*chunks.columns)


def composite(chunks: DataFrame, overlay: DataFrame, alpha: DataFrame, low: DataFrame, edge: Sequence[int] = (64, 64, 64)) -> DataFrame:
    """Blend overlay voxels into chunks where ``alpha`` has rows; overlay values in [0, 1] are scaled to [p1, p99].

    ``overlay`` and ``alpha`` are sparse voxel rows (a missing overlay value is
    0), ``low`` has ``(volume_id, p1, p99)`` of the base volumes. The sparse
    rows travel to their chunk; the dense volume is not exploded.
    """
    grid = tuple(int(e) for e in edge)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def blend(data: pd.Series, dims: pd.Series, spots: pd.Series, weights: pd.Series, values: pd.Series) -> pd.Series:
        out = []
        for d, n, s, w, v in zip(data, dims, spots, weights, values):
            block = np.array(d, dtype="f8").reshape(tuple(n))
            if s is not None and len(s):
                at, w = np.unravel_index(np.asarray(s, dtype="i8"), grid), np.asarray(w, dtype="f8")
                block[at] = (1 - w) * block[at] + w * np.asarray(v, dtype="f8")
            out.append(block.ravel())
        return pd.Series(out)

    key = ["volume_id", "i", "j", "k"]
    cells = alpha.select(*key, "alpha").join(overlay.select(*key, F.col("value").alias("_o")), key, "left").join(low, "volume_id")
    cells = cells.withColumn("_v", F.coalesce("_o", F.lit(0.0)) * (F.col("p99") - F.col("p1")) + F.col("p1"))
    told = chunks.join(by_chunk(cells, grid, "alpha", "_v"), CHUNK_KEY, "left")
    return told.withColumn("data", blend("data", "dims", "_spots", "alpha", "_v")).select(*chunks.columns)


def otsu_threshold(chunks: DataFrame, bins: int = 256) -> DataFrame:
    """Threshold per volume that maximises the between-class variance of its histogram."""
    hist = histogram(chunks, bins)
    centre = F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins
    w = Window.partitionBy("volume_id")  # at most `bins` rows
    upto = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    h = hist.withColumn("_m", F.col("n") * centre).withColumns({
        "_n0": F.sum("n").over(upto), "_s0": F.sum("_m").over(upto), "_n": F.sum("n").over(w), "_s": F.sum("_m").over(w),
    })
    n1 = F.col("_n") - F.col("_n0")
    gap = F.col("_s0") / F.col("_n0") - (F.col("_s") - F.col("_s0")) / n1
    between = F.when(n1 > 0, F.col("_n0") * n1 * gap * gap)
    edge = F.col("lo") + (F.col("bin") + 1) * (F.col("hi") - F.col("lo")) / bins
    # the smallest edge among equal variances; the grid of 9 digits keeps float noise from choosing
    return h.withColumns({"_b": F.round(between, 9), "_e": edge}).groupBy("volume_id").agg(
        F.max_by("_e", F.struct(F.coalesce("_b", F.lit(-1.0)), -F.col("bin"))).alias("threshold"))


def otsu_mask(chunks: DataFrame, bins: int = 256) -> DataFrame:
    told = chunks.join(otsu_threshold(chunks, bins), "volume_id")
    flagged = told.withColumn("data", F.transform("data", lambda v: (v.cast("double") >= F.col("threshold")).cast("double")))
    return to_mask(explode_voxels(flagged), 0.5)


def normalise_nonzero(chunks: DataFrame) -> DataFrame:
    """z-score of the non-zero values (population deviation); zeros stay, a zero deviation only shifts."""
    stats = _values(chunks).filter(F.col("v") != 0).groupBy("volume_id").agg(F.avg("v").alias("_m"), F.stddev_pop("v").alias("_s"))

    def one(v):
        return F.when((v == 0) | F.col("_m").isNull(), v).otherwise((v - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0))

    return map_values(chunks.join(stats, "volume_id", "left"), one).select(*chunks.columns)


def crop_range(chunks: DataFrame, axis: str, start: int, end: int) -> DataFrame:
    """Chunk pieces of ``[start, end)`` of one axis, moved to 0."""
    at = "ijk".index(axis)
    lo = F.array(*[F.lit(start if n == at else 0) for n in range(3)])
    size = F.array(*[F.lit(max(end - start, 0)) if n == at else F.get("shape", n) for n in range(3)])
    # the box follows from the shape that every chunk carries, so the chunks stay where they are
    return cut_own_boxes(chunks.select("volume_id", "origin", "dims", "data", lo.alias("lo"), size.alias("size")).filter("volume_id is not null"))


def intensity_profile(chunks: DataFrame, bins: int = 50) -> tuple[DataFrame, DataFrame]:
    """Mean of the positive values and the maximum per volume, and its histogram."""
    stats = _values(chunks).groupBy("volume_id").agg(F.avg(F.when(F.col("v") > 0, F.col("v"))).alias("mean_positive"), F.max("v").alias("max_value"))
    return stats, histogram(chunks, bins).select("volume_id", "bin", "n")
