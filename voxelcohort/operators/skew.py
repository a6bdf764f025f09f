"""Ordering and pairing inside groups, safe when one group holds much of the data.

A plain window puts a whole group into one task. The helpers here look for
groups above a row limit first (one partial aggregate) and split only those, so
ordinary groups pay a single exchange and a hot group is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelcohort.session import cut_lineage

ROWS_PER_SPLIT = 1_000_000
ROWS_PER_TILE = 4_096
# ranges that a hot group is cut into
PIECES = 200


def hot_groups(df: DataFrame, keys: Sequence[str], limit: int, *stats: Column, size: Column | None = None) -> DataFrame | None:
    """Groups of more than ``limit`` rows with their size ``_n`` and ``stats``; None when there are none.

    One pass over the key columns with partial aggregation. The result has at
    most rows/limit rows and is stored, so the planner knows its size: it is
    broadcast where that is small and joined by shuffle where it is not.
    """
    n = F.count(F.lit(1)) if size is None else size
    hot = cut_lineage(df.groupBy(*keys).agg(n.alias("_n"), *stats).filter(F.col("_n") > limit))
    return None if hot.isEmpty() else hot


def range_position(df: DataFrame, group: Sequence[str], order: Sequence[str], position: str) -> DataFrame:
    """1-based position of each row in its group, for order columns of any type.

    The frame is sorted by ranges of (group, order), so a group may span many
    tasks; the ranges are stored, and a row's place is its number in its range
    plus the rows before that range, less those of the groups before. Only one
    count a range and one a group travel besides. Equal rows may swap places.
    """
    group = list(group)
    done = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("_id", F.monotonically_increasing_id())
    done = cut_lineage(done).withColumn("_part", F.shiftright("_id", 33)).withColumn("_id", F.col("_id").bitwiseAND((1 << 33) - 1))
    parts = done.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"))
    before = parts.select("_part", (F.sum("_c").over(Window.orderBy("_part")) - F.col("_c")).alias("_before"))
    placed = done.join(before, "_part").withColumn("_at", F.col("_id") + F.col("_before"))
    first = placed.groupBy(*group).agg(F.min("_at").alias("_first")).withColumnsRenamed({g: f"_g_{g}" for g in group})
    same = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group]
    return placed.join(first, same).select(*df.columns, (F.col("_at") - F.col("_first") + 1).cast("long").alias(position))


def in_order(
    df: DataFrame,
    group: Sequence[str],
    key: str,
    ties: Sequence[str] = (),
    position: str | None = None,
    lag: Mapping[str, str] | None = None,
    lead: Mapping[str, str] | None = None,
    size: str | None = None,
    rows_per_split: int = ROWS_PER_SPLIT,
) -> DataFrame:
    """Number the rows of each group and read their neighbours.

    Rows are ordered by the numeric column ``key``, then by ``ties``, which must
    make the order total. ``position`` is 1-based; ``lag`` and ``lead`` map a
    source column to the name of its previous/next value; ``size`` is the group
    size. A group above ``rows_per_split`` rows is cut into ranges of ``key`` of
    about equal counts (approximate quantiles only choose the cuts); each range
    is its own window partition and small per-range edge rows carry counts and
    neighbours across the cuts. Null keys come first, NaN last.
    """
    lag, lead = dict(lag or {}), dict(lead or {})
    group, order = list(group), [key, *ties]
    num = F.col(key).cast("double")
    hot = hot_groups(df, group, rows_per_split)
    if hot is not None:
        # a sketch of the order is made for the hot groups only, not for each of many small ones
        cuts = F.percentile_approx(num, F.lit([k / PIECES for k in range(1, PIECES)]), 100 * PIECES)
        cuts = df.join(hot.select(*group), group, "left_semi").groupBy(*group).agg(cuts.alias("_cuts"))
        hot = cut_lineage(hot.join(cuts, group, "left"))
    split = [] if hot is None else ["_split"]
    data = df
    if hot is not None:
        # a null group key meets no cuts and stays one range; a null order key is a range of its own, the first
        ranged = F.size(F.filter("_cuts", lambda c: c <= num))
        cut = F.when(F.col("_cuts").isNull(), F.lit(0)).when(num.isNull(), F.lit(-1)).otherwise(ranged).cast("long")
        data = df.join(hot, group, "left").withColumn("_split", cut)

    w = Window.partitionBy(*group, *split).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pos, cnt = F.row_number().over(w), F.count(F.lit(1)).over(whole)
    if hot is None:
        out = [F.col(c) for c in df.columns]
        out += [pos.cast("long").alias(position)] if position else []
        out += [cnt.cast("long").alias(size)] if size else []
        out += [F.lag(src).over(w).alias(name) for src, name in lag.items()]
        out += [F.lead(src).over(w).alias(name) for src, name in lead.items()]
        return df.select(*out)

    rank = F.struct(*order)
    ends = data.filter(F.col("_n").isNotNull()).groupBy(*group, "_split").agg(
        F.count(F.lit(1)).alias("_c"),
        F.max_by(F.struct(F.lit(True), *lag), rank).alias("_last"),
        F.min_by(F.struct(F.lit(True), *lead), rank).alias("_first"),
    )
    along = Window.partitionBy(*group).orderBy("_split")  # a few rows per hot group
    edges = ends.select(
        *group, "_split",
        F.sum("_c").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.lag("_last").over(along).alias("_prev"), F.lead("_first").over(along).alias("_next"),
    )
    data = data.withColumns({
        "_rn": pos, "_cnt": cnt,
        **{f"_lag_{name}": F.lag(src).over(w) for src, name in lag.items()},
        **{f"_lead_{name}": F.lead(src).over(w) for src, name in lead.items()},
    }).join(edges, [*group, "_split"], "left")
    out = [F.col(c) for c in df.columns]
    if position:
        out.append((F.col("_rn") + F.coalesce("_before", F.lit(0))).cast("long").alias(position))
    if size:
        out.append(F.coalesce("_n", "_cnt").cast("long").alias(size))
    for src, name in lag.items():
        out.append(F.when(F.col("_rn") == 1, F.col(f"_prev.{src}")).otherwise(F.col(f"_lag_{name}")).alias(name))
    for src, name in lead.items():
        out.append(F.when(F.col("_rn") == F.col("_cnt"), F.col(f"_next.{src}")).otherwise(F.col(f"_lead_{name}")).alias(name))
    return data.select(*out)


def global_position(df: DataFrame, order: Sequence[str], position: str, buckets: int = 65_536) -> DataFrame:
    """1-based position in one total order over the whole frame.

    The order must start with a column that spreads evenly (a hash). Rows are
    numbered inside fixed hash ranges; the ranges' counts, at most ``buckets``
    rows, turn that into a global number.
    """
    lead = F.col(order[0])
    # arithmetic shift keeps the order of the 64-bit hash
    data = df.withColumn("_b", F.shiftright(lead, 64 - (buckets.bit_length() - 1)))
    counts = data.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.select(
        "_b",
        F.coalesce(
            F.sum("_c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
    )
    local = F.row_number().over(Window.partitionBy("_b").orderBy(*order))
    return (
        data.withColumn("_rn", local)
        .join(F.broadcast(before), "_b")  # at most `buckets` rows
        .withColumn(position, (F.col("_rn") + F.col("_before")).cast("long"))
        .drop("_b", "_rn", "_before")
    )


def self_pairs(
    df: DataFrame, keys: Sequence[str], id_col: str, payload: Sequence[str] = (), rows_per_tile: int = ROWS_PER_TILE
) -> DataFrame:
    """Rows that share ``keys``, joined to each other with ``a_<id> < b_<id>``.

    A key above ``rows_per_tile`` rows is cut into hash tiles and each pair of
    tiles becomes its own join key, so no task joins more than one tile with
    another.
    """
    keys, names = list(keys), [id_col, *payload]
    hot = hot_groups(df, keys, rows_per_tile)
    ordered = F.col(f"a_{id_col}") < F.col(f"b_{id_col}")

    def side(frame, prefix, *keep):
        return frame.select(*keys, *keep, *[F.col(c).alias(f"{prefix}_{c}") for c in names])

    if hot is None:
        return side(df, "a").join(side(df, "b"), keys).filter(ordered)
    tiled = (
        df.select(*keys, *names)
        .join(hot.select(*keys, F.ceil(F.col("_n") / F.lit(rows_per_tile)).cast("int").alias("_tiles")), keys, "left")
        .withColumn("_tiles", F.coalesce("_tiles", F.lit(1)))
        .withColumn("_tile", F.pmod(F.xxhash64(id_col), F.col("_tiles")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
        .withColumn("_t1", F.least("_tile", "_other"))
        .withColumn("_t2", F.greatest("_tile", "_other"))
    )
    met = side(tiled, "a", "_t1", "_t2", "_tile").join(side(tiled.withColumnRenamed("_tile", "_tile_b"), "b", "_t1", "_t2", "_tile_b"), [*keys, "_t1", "_t2"])
    # two rows of one tile meet under every tile pair it belongs to: keep them on the diagonal only
    once = (F.col("_tile") != F.col("_tile_b")) | (F.col("_t1") == F.col("_t2"))
    return met.filter(ordered & once).drop("_t1", "_t2", "_tile", "_tile_b")
