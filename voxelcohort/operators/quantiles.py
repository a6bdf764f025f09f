"""Exact linear-interpolated quantiles per group, whatever the group size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelcohort.operators.skew import hot_groups
from voxelcohort.session import cut_lineage

ROWS_PER_GROUP = 250_000
ROWS_PER_BIN = 10_000
MIN_BINS, MAX_BINS = 4_096, 1_048_576
# bounds of finite arithmetic: a large double, and the asinh beyond which all values share the last bin
BIG, REACH = 1e150, 720.0


def _array(ps: Sequence[float]) -> str:
    return "array(" + ", ".join(f"{float(p)!r}D" for p in ps) + ")"


def quantiles(
    df: DataFrame, group: Sequence[str], value: str, ps: Sequence[float], weight: str | None = None,
    out: str = "q", rows_per_group: int = ROWS_PER_GROUP, sizes: DataFrame | None = None,
) -> DataFrame:
    """One row per group with ``out``, the array of quantiles at ``ps``; null values are ignored.

    A group's distinct values must fit one task for the built-in aggregate, so
    only groups up to ``rows_per_group`` use it. For larger ones a histogram
    finds the bins that hold the wanted ranks, and only rows in those bins are
    ordered. Bins are even in asinh((value - median) / spread), so outliers and
    infinities do not crowd the rest into one; NaN is above everything.
    ``weight`` is an integer column of repetitions. ``sizes``, rows ``(group, _n)``
    with upper bounds of the groups' rows, spares a pass that counts them.
    """
    group = list(group)
    w = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    d = df.select(*group, F.col(value).cast("double").alias("_v"), w.alias("_w")).filter(F.col("_v").isNotNull() & (F.col("_w") > 0))
    if not group:
        return quantiles(d.withColumn("_all", F.lit(1)), ["_all"], "_v", ps, "_w", out, rows_per_group).drop("_all")
    stats = (F.sum("_w").alias("_total"), F.percentile_approx("_v", [0.25, 0.5, 0.75]).alias("_q"))
    if sizes is None:
        hot = hot_groups(d, group, rows_per_group, *stats)
    else:
        large = cut_lineage(sizes.filter(F.col("_n") > rows_per_group).select(*group))
        hot = None if large.isEmpty() else hot_groups(d.join(large, group, "left_semi"), group, rows_per_group, *stats)
    small = d if hot is None else d.join(hot.select(*group), group, "left_anti")
    few = small.groupBy(*group).agg(F.expr(f"percentile(_v, {_array(ps)}, _w)").alias(out))
    if hot is None:
        return few
    big = d.join(hot.select(*group, F.col("_total").alias("_n"), "_q"), group)
    return few.unionByName(_narrowed(big, group, ps, out))


def _narrowed(d: DataFrame, group: list[str], ps: Sequence[float], out: str) -> DataFrame:
    bins = F.least(F.greatest(F.ceil(F.col("_n") / F.lit(ROWS_PER_BIN)), F.lit(MIN_BINS)), F.lit(MAX_BINS))
    finite = lambda k: F.greatest(F.least(F.coalesce(F.nanvl(F.get("_q", k), F.lit(0.0)), F.lit(0.0)), F.lit(BIG)), F.lit(-BIG))
    spread = finite(2) - finite(0)
    even = F.asinh((F.col("_v") - finite(1)) / F.when(spread > 0, spread).otherwise(1.0))
    # most of a group lies within a few spreads; half of the bins are for asinh up to 4, the rest for what is beyond
    near = F.least(F.greatest(even, F.lit(-REACH)), F.lit(REACH))
    inner = F.floor((F.least(F.greatest(near, F.lit(-4.0)), F.lit(4.0)) + 4.0) / 8.0 * bins / 2)
    outer = F.floor((near + REACH) / (2 * REACH) * bins / 2)
    d = d.withColumn("_bin", F.when(F.isnan("_v"), bins + 1).otherwise(inner + outer).cast("int"))
    at = F.transform(F.expr(_array(ps)), lambda p: (F.col("_n") - 1) * p)
    ranks = F.array_distinct(F.concat(F.transform(at, lambda x: F.floor(x).cast("long")), F.transform(at, lambda x: F.ceil(x).cast("long"))))
    hist = d.groupBy(*group, "_n", "_bin").agg(F.sum("_w").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hist = hist.withColumn("_before", before)
    wanted = hist.filter(F.exists(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_c"))))
    inside = d.join(wanted.select(*group, "_bin", "_before"), [*group, "_bin"])
    steps = inside.groupBy(*group, "_n", "_bin", "_before", "_v").agg(F.sum("_w").alias("_c"))
    w = Window.partitionBy(*group, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("_from", F.col("_before") + F.coalesce(F.sum("_c").over(w), F.lit(0)))

    covered = F.filter(ranks, lambda r: (r >= F.col("_from")) & (r < F.col("_from") + F.col("_c")))
    found = steps.select(*group, "_n", "_v", F.explode(covered).alias("_r"))
    # one value per wanted rank: at most twice the number of quantiles
    known = found.groupBy(*group, "_n").agg(F.map_from_entries(F.collect_list(F.struct("_r", "_v"))).alias("_known"))

    def mixed(p):
        at = (F.col("_n") - 1) * p
        low, high = (F.try_element_at("_known", f(at).cast("long")) for f in (F.floor, F.ceil))
        return F.when(low == high, low).otherwise(low + (high - low) * (at - F.floor(at)))  # infinities have no difference

    return known.select(*group, F.transform(F.expr(_array(ps)), mixed).alias(out))
