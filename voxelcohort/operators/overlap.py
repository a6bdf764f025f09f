"""Overlap of sparse masks.

Masks are packed into 64-bit words, one per 4x4x4 block, so an intersection is
a join on the block and a bit count: up to 64 voxels per joined row.

Within a patient only pairs that share a foreground voxel are listed. Every
other pair has Dice 0 (or none when both masks are empty); the summaries count
those pairs exactly without listing them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelcohort.operators.quantiles import quantiles
from voxelcohort.operators.skew import ROWS_PER_TILE, self_pairs
from voxelcohort.session import cut_lineage

BLOCK = ["bi", "bj", "bk"]


def pack(masks: DataFrame) -> DataFrame:
    """``(volume_id, bi, bj, bk, bits)``: the foreground of each 4x4x4 block as one word."""
    bit = F.col("i").bitwiseAND(3) + F.col("j").bitwiseAND(3) * 4 + F.col("k").bitwiseAND(3) * 16
    at = [F.shiftright(F.col(a), 2).alias(b) for a, b in zip("ijk", BLOCK)]
    word = F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int"))
    return masks.groupBy("volume_id", *at).agg(F.bit_or(word).alias("bits"))


def mask_sizes(masks: DataFrame) -> DataFrame:
    return masks.groupBy("volume_id").agg(F.count(F.lit(1)).alias("n"))


def _sizes(words: DataFrame) -> DataFrame:
    return words.groupBy("volume_id").agg(F.sum(F.bit_count("bits").cast("long")).alias("n"))


def _common(a: str = "a_bits", b: str = "b_bits") -> Column:
    return F.bit_count(F.col(a).bitwiseAND(F.col(b))).cast("long")


def intersections(pairs: DataFrame, masks: DataFrame) -> DataFrame:
    """``(a_id, b_id, n_a, n_b, n_ab)`` of given pairs."""
    words = pack(masks)
    left = pairs.select("a_id", "b_id").join(words.withColumnsRenamed({"volume_id": "a_id", "bits": "a_bits"}), "a_id")
    met = left.join(words.withColumnsRenamed({"volume_id": "b_id", "bits": "b_bits"}), ["b_id", *BLOCK])
    inter = met.groupBy("a_id", "b_id").agg(F.sum(_common()).alias("n_ab"))
    sizes = _sizes(words)
    out = pairs.join(inter, ["a_id", "b_id"], "left")
    for side in "ab":
        out = out.join(sizes.withColumnsRenamed({"volume_id": f"{side}_id", "n": f"n_{side}"}), f"{side}_id", "left")
    return out.fillna(0, ["n_a", "n_b", "n_ab"])


def dice(pairs: DataFrame, masks: DataFrame, empty: float | None = None) -> DataFrame:
    """Dice of given pairs; two empty masks score ``empty`` (null for review, 1.0 for placement)."""
    total = F.col("n_a") + F.col("n_b")
    score = F.when(total > 0, 2.0 * F.col("n_ab") / total).otherwise(F.lit(empty).cast("double"))
    return intersections(pairs, masks).withColumn("dice", score)


def overlapping_pairs(members: DataFrame, masks: DataFrame, group: str, payload: Sequence[str] = (), rows_per_tile: int = ROWS_PER_TILE) -> DataFrame:
    """All pairs of a group whose masks share a voxel: ``a_id, b_id, n_a, n_b, n_ab, dice``.

    ``members`` has ``(volume_id, group, payload...)``. Volumes meet on the
    block they both fill; a block filled by very many volumes of one group is
    tiled.
    """
    # packed once: the search for hot blocks, both sides of the join and the sizes read it
    words = cut_lineage(pack(masks).join(members.select("volume_id", group), "volume_id"))
    met = self_pairs(words, [group, *BLOCK], "volume_id", ["bits"], rows_per_tile)
    inter = met.groupBy(group, F.col("a_volume_id").alias("a_id"), F.col("b_volume_id").alias("b_id")).agg(F.sum(_common()).alias("n_ab"))
    inter = inter.filter(F.col("n_ab") > 0)
    facts = members.select("volume_id", *payload).join(_sizes(words), "volume_id")
    for side in "ab":
        inter = inter.join(facts.withColumnsRenamed({"volume_id": f"{side}_id", "n": f"n_{side}", **{p: f"{side}_{p}" for p in payload}}), f"{side}_id")
    return inter.withColumn("dice", 2.0 * F.col("n_ab") / (F.col("n_a") + F.col("n_b")))


def pairwise_dice(series: DataFrame, masks: DataFrame, **how) -> DataFrame:
    """Dice of the unordered pairs within each patient that overlap."""
    return overlapping_pairs(series, masks, "patient_id", ["study_type"], **how)


def cross_type_dice(series: DataFrame, masks: DataFrame, a: str, b: str) -> DataFrame:
    """Dice of all pairs of types ``a`` and ``b`` within each timepoint, those that miss each other too.

    Types match by substring, ignoring case; ``a_id`` is the row of type ``a``. A
    timepoint holds a few series of each type. Two empty masks have no Dice.
    """
    kind = F.lower("study_type")
    left = series.filter(kind.contains(a.lower())).select("tracker", F.col("volume_id").alias("a_id"))
    right = series.filter(kind.contains(b.lower())).select("tracker", F.col("volume_id").alias("b_id"))
    pairs = left.join(right, "tracker").filter("a_id != b_id")
    return dice(pairs, masks).select("tracker", "a_id", "b_id", "n_ab", "dice")


def pair_counts(series: DataFrame, masks: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """Comparisons per patient, n(n-1)/2.

    With ``masks`` and the overlapping ``pairs`` also how many of them score
    above 0, exactly 0, and not at all (both masks empty).
    """
    members = series.select("patient_id", "volume_id")
    if masks is None:
        n = members.groupBy("patient_id").agg(F.count(F.lit(1)).alias("n_series"))
        return n.withColumn("n_pairs", (F.col("n_series") * (F.col("n_series") - 1) / 2).cast("long"))
    full = members.join(mask_sizes(masks), "volume_id", "left")
    n = full.groupBy("patient_id").agg(F.count(F.lit(1)).alias("n_series"), F.count_if(F.col("n").isNull()).alias("_e"))
    hits = pairs.groupBy("patient_id").agg(F.count(F.lit(1)).alias("n_overlapping"))
    out = n.join(hits, "patient_id", "left").fillna(0, ["n_overlapping"])
    both = lambda c: (F.col(c) * (F.col(c) - 1) / 2).cast("long")
    return out.withColumns({"n_pairs": both("n_series"), "n_unscored": both("_e")}).withColumn(
        "n_zero", F.col("n_pairs") - F.col("n_unscored") - F.col("n_overlapping")).drop("_e")


def comparison_stats(counts: DataFrame) -> DataFrame:
    return counts.agg(F.avg("n_pairs").alias("mean_pairs"), F.min("n_pairs").alias("min_pairs"), F.max("n_pairs").alias("max_pairs"))


def dice_per_study(series: DataFrame, masks: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per study over all its comparisons: n, mean, sample deviation, min, max, median.

    ``pairs`` are the overlapping ones; the others enter as zeros by their
    number. Studies without a scored comparison are left out.
    """
    ends = pairs.select(F.explode(F.array("a_id", "b_id")).alias("volume_id"), "dice")
    seen = ends.groupBy("volume_id").agg(
        F.count(F.lit(1)).alias("_k"), F.sum("dice").alias("_s"), F.sum(F.col("dice") * F.col("dice")).alias("_s2"), F.min("dice").alias("_lo"), F.max("dice").alias("max_dice"))
    full = series.select("volume_id", "patient_id", "study_type").join(mask_sizes(masks), "volume_id", "left").withColumn("_empty", F.col("n").isNull())
    groups = full.groupBy("patient_id").agg(F.count(F.lit(1)).alias("_n"), F.count_if("_empty").alias("_e"))
    told = full.join(groups, "patient_id").join(seen, "volume_id", "left")
    told = told.withColumn("n_comparisons", F.col("_n") - 1 - F.when(F.col("_empty"), F.col("_e") - 1).otherwise(0))
    told = told.filter(F.col("n_comparisons") > 0).fillna(0, ["_k"]).fillna(0.0, ["_s", "_s2", "max_dice"])
    told = told.withColumn("_zeros", F.col("n_comparisons") - F.col("_k"))
    n = F.col("n_comparisons")
    spread = F.when(n > 1, F.sqrt(F.greatest(F.col("_s2") - F.col("_s") * F.col("_s") / n, F.lit(0.0)) / (n - 1)))
    scores = ends.select("volume_id", "dice", F.lit(1).cast("long").alias("w")).unionByName(
        told.filter(F.col("_zeros") > 0).select("volume_id", F.lit(0.0).alias("dice"), F.col("_zeros").alias("w")))
    median = quantiles(scores, ["volume_id"], "dice", [0.5], weight="w").select("volume_id", F.get("q", 0).alias("median_dice"))
    return told.join(median, "volume_id").select(
        "volume_id", "patient_id", "study_type", "n_comparisons", (F.col("_s") / n).alias("mean_dice"), spread.alias("std_dice"),
        F.when(F.col("_zeros") > 0, 0.0).otherwise(F.col("_lo")).alias("min_dice"), "max_dice", "median_dice",
    )


def scored_dice(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """All scored comparisons as ``(dice, w)``: the overlapping pairs, and zeros by their number from :func:`pair_counts`."""
    zeros = counts.filter("n_zero > 0").select(F.lit(0.0).alias("dice"), F.col("n_zero").alias("w"))
    return pairs.select("dice", F.lit(1).cast("long").alias("w")).unionByName(zeros)


def describe(df: DataFrame, col: str, weight: str | None = None) -> DataFrame:
    """Count, mean, sample deviation, min, quartiles and max of one column; a row counts ``weight`` times."""
    x, w = F.col(col).cast("double"), F.lit(1).cast("long") if weight is None else F.col(weight)
    rows = df.filter(x.isNotNull() & (w > 0))
    n, s = F.sum(w), F.sum(w * x)
    spread = F.when(n > 1, F.sqrt(F.greatest(F.sum(w * x * x) - s * s / n, F.lit(0.0)) / (n - 1)))
    base = rows.agg(F.coalesce(n, F.lit(0)).alias("count"), (s / n).alias("mean"), spread.alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    out = base.withColumn("_q", quantiles(rows, [], col, [0.25, 0.5, 0.75], weight=weight).select("q").scalar())
    return out.withColumns({f"p{p}": F.get("_q", n) for n, p in enumerate((25, 50, 75))}).drop("_q")


def dice_by_type(per_study: DataFrame) -> DataFrame:
    return per_study.groupBy("study_type").agg(
        F.round(F.avg("mean_dice"), 4).alias("mean_dice"), F.round(F.stddev_samp("mean_dice"), 4).alias("std_dice"),
        F.count("mean_dice").alias("n_studies"), F.round(F.avg("n_comparisons"), 4).alias("mean_comparisons"))


def top_bottom(per_study: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` best and worst studies, ranked within each end."""
    best = per_study.orderBy(F.desc("mean_dice"), "volume_id").limit(n).withColumn("end", F.lit("top"))
    worst = per_study.orderBy(F.asc("mean_dice"), "volume_id").limit(n).withColumn("end", F.lit("bottom"))
    return best.unionByName(worst)


def rvd(pairs: DataFrame, masks: DataFrame) -> DataFrame:
    """Relative volume difference of prediction ``a`` to target ``b``; null for an empty target."""
    return intersections(pairs, masks).withColumn("rvd", F.when(F.col("n_b") > 0, F.abs(F.col("n_a") - F.col("n_b")) / F.col("n_b")))


def precision_recall(pairs: DataFrame, masks: DataFrame) -> DataFrame:
    """Precision and recall of prediction ``a`` against target ``b``; null without a denominator."""
    return intersections(pairs, masks).withColumns({
        "precision": F.when(F.col("n_a") > 0, F.col("n_ab") / F.col("n_a")), "recall": F.when(F.col("n_b") > 0, F.col("n_ab") / F.col("n_b"))})


def first_pairs(scans: DataFrame) -> DataFrame:
    """First and second scan of each patient by day: ``(patient_id, a_id, b_id)``."""
    from pyspark.sql import Window

    w = Window.partitionBy("patient_id").orderBy("day", "volume_id")
    two = scans.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= 2)
    at = lambda n: F.max(F.when(F.col("_rn") == n, F.col("volume_id")))
    return two.groupBy("patient_id").agg(at(1).alias("a_id"), at(2).alias("b_id")).filter(F.col("b_id").isNotNull())


def persistence_baseline(scans: DataFrame, masks: DataFrame) -> DataFrame:
    """Dice of "nothing changes": first against second scan, mean and population deviation."""
    scored = dice(first_pairs(scans), masks)
    return scored.agg(F.count("dice").alias("n"), F.avg("dice").alias("mean_dice"), F.stddev_pop("dice").alias("std_dice"))


def binarise(voxels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Foreground of a score volume: sigmoid at or above the threshold."""
    return voxels.filter(1 / (1 + F.exp(-F.col("value"))) >= threshold).select("volume_id", "i", "j", "k")
