"""Time-ordered scan sequences, kept as one row per scan.

A sequence is never collected into one value: position and length columns carry
its order, so the longest patient costs no more memory than the shortest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelcohort.operators.skew import global_position, in_order
from voxelcohort.session import cut_lineage

SCAN_ID = r"^(\d+)_(\d+)_(\d+)$"


def parse_scan_id(df: DataFrame, col: str = "scan_id", fallback: str = "days_since_first") -> DataFrame:
    """Patient, index and day from ``patient_index_day``; other ids take the fallback day or 0."""
    part = lambda n: F.nullif(F.regexp_extract(col, SCAN_ID, n), F.lit(""))
    other = F.col(fallback).cast("double") if fallback in df.columns else F.lit(None).cast("double")
    return df.withColumns({
        "scan_patient": part(1), "scan_index": part(2).cast("long"), "day": F.coalesce(part(3).cast("double"), other, F.lit(0.0)),
    })


def relative_days(df: DataFrame, group: Sequence[str] = ("patient_id",), day: str = "day") -> DataFrame:
    first = df.groupBy(*group).agg(F.min(day).alias("_first"))
    return df.join(first, list(group)).withColumn("rel_day", F.col(day) - F.col("_first")).drop("_first")


def assemble(df: DataFrame, group: Sequence[str] = ("split", "patient_id"), **how) -> DataFrame:
    """Scans in order: 0-based ``pos``, ``seq_len`` and days since the patient's first scan."""
    ordered = in_order(relative_days(df, group), group, "day", ["scan_id"], position="pos", size="seq_len", **how)
    return ordered.withColumn("pos", F.col("pos") - 1)


def flatten_sequences(df: DataFrame, arrays: Sequence[str], keep: Sequence[str] = ("patient_id",)) -> DataFrame:
    """Nested sequences (one array per field) to single scans with their ``pos``."""
    return df.select(*keep, F.posexplode(F.arrays_zip(*arrays)).alias("pos", "_s")).select(*keep, "pos", *[f"_s.{a}" for a in arrays])


def sequence_lengths(df: DataFrame, group: Sequence[str] = ("patient_id",)) -> DataFrame:
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("seq_len"))


def longest_sequence(lengths: DataFrame, patient: str = "patient_id") -> DataFrame:
    """The longest sequence, the smallest id of equal ones."""
    return lengths.orderBy(F.desc("seq_len"), patient).limit(1)


def time_deltas(df: DataFrame, group: Sequence[str] = ("patient_id",), **how) -> DataFrame:
    """Days since the previous scan (null for the first), and ln(1 + delta / 360) with delta clamped at 0."""
    out = in_order(df, group, "day", ["scan_id"], position="pos", lag={"day": "_prev"}, **how)
    delta = F.col("day") - F.col("_prev")
    return out.withColumns({"pos": F.col("pos") - 1, "delta": delta, "log_delta": F.log1p(F.greatest(delta, F.lit(0.0)) / 360)}).drop("_prev")


def _padding(lengths: DataFrame, batch: str, *carry: str) -> DataFrame:
    """Rows for the missing positions of each sequence up to its batch's longest."""
    longest = lengths.groupBy(batch).agg(F.max("seq_len").alias("_max"))
    short = lengths.join(longest, batch).filter(F.col("seq_len") < F.col("_max"))
    return short.select(batch, "patient_id", "seq_len", *carry, F.explode(F.sequence(F.col("seq_len"), F.col("_max") - 1)).alias("pos"))


def fill_last_delta(deltas: DataFrame, batch: str) -> DataFrame:
    """``(batch, patient_id, pos, delta)`` for positions 1.. of the padded grid.

    Padded positions repeat the sequence's last delta; a single scan has none,
    its padded deltas are 0.
    """
    ends = deltas.groupBy(batch, "patient_id").agg(
        F.count(F.lit(1)).alias("seq_len"), F.coalesce(F.max_by("delta", "pos"), F.lit(0.0)).alias("delta"))
    padded = _padding(ends, batch, "delta").select(batch, "patient_id", "pos", "delta")
    real = deltas.filter(F.col("pos") > 0).select(batch, "patient_id", "pos", "delta")
    return real.unionByName(padded).withColumn("delta", F.greatest("delta", F.lit(0.0)))


def history_pairs(df: DataFrame, group: Sequence[str] = ("patient_id",), **how) -> DataFrame:
    """For every step t: the history is positions 0..t, the target is position t + 1.

    One row per step, ``history_len`` long; ``valid`` where the target exists.
    The history itself is a range of positions, so nothing grows quadratically.
    """
    out = in_order(df, group, "day", ["scan_id"], position="history_len", lead={"scan_id": "target_scan", "day": "target_day"}, **how)
    return out.withColumns({"step": F.col("history_len") - 1, "valid": F.col("target_scan").isNotNull()})


def aggregate_sequence(df: DataFrame, how: str, group: str = "patient_id", step: str = "step", vec: str = "vec") -> DataFrame:
    """``(group, dim, value)``: last, mean or max over valid steps, or ``cat`` = mean followed by last."""
    if how not in ("last", "mean", "max", "cat"):
        raise ValueError(f"unknown aggregation {how!r}; must be last, mean, max or cat")
    flat = df.select(group, step, F.size(vec).alias("_n"), F.posexplode(vec).alias("dim", "v")).withColumn("v", F.col("v").cast("double"))
    per = flat.groupBy(group, "dim").agg(F.avg("v").alias("mean"), F.max("v").alias("max"), F.max_by("v", step).alias("last"), F.max("_n").alias("_n"))
    if how != "cat":
        return per.select(group, "dim", F.col(how).alias("value"))
    both = F.array(F.struct(F.col("dim").alias("dim"), F.col("mean").alias("value")), F.struct((F.col("dim") + F.col("_n")).alias("dim"), F.col("last").alias("value")))
    return per.select(group, F.inline(both))


def length_batches(lengths: DataFrame, size: int, seed: int, patient: str = "patient_id", **how) -> DataFrame:
    """Adds ``batch``: sequences of one length, shuffled by a seeded hash, cut into batches of ``size``."""
    hashed = lengths.withColumn("_h", F.xxhash64(patient, F.lit(seed)))
    placed = in_order(hashed, ["seq_len"], "_h", [patient], position="_pos", **how)
    return placed.withColumn("batch", F.concat_ws("_", "seq_len", F.floor((F.col("_pos") - 1) / size))).drop("_h", "_pos")


def epoch_order(batches: DataFrame, seed: int, epoch: int) -> DataFrame:
    """Each distinct batch with its 1-based place in the epoch's seeded order."""
    hashed = batches.select("batch").distinct().withColumn("_h", F.xxhash64("batch", F.lit(seed + epoch)))
    return global_position(hashed, ["_h", "batch"], "place").select("batch", "place")


def n_batches(lengths: DataFrame, size: int) -> DataFrame:
    per = lengths.groupBy("seq_len").agg(F.ceil(F.count(F.lit(1)) / size).alias("n"))
    return per.agg(F.sum("n").alias("n_batches"))


def pad_batch(assembled: DataFrame, batch: str) -> DataFrame:
    """``(batch, patient_id, pos, date, seq_len)`` up to the batch's longest sequence; padded dates are -1."""
    real = assembled.select(batch, "patient_id", "pos", F.col("rel_day").alias("date"), "seq_len")
    lengths = assembled.filter(F.col("pos") == 0).select(batch, "patient_id", "seq_len")
    padded = _padding(lengths, batch).withColumn("date", F.lit(-1.0))
    return real.unionByName(padded.select(batch, "patient_id", "pos", "date", "seq_len"))


def growth(masks: DataFrame, scans: DataFrame) -> DataFrame:
    """Foreground voxels per scan and the change since the patient's previous scan."""
    counts = masks.groupBy("volume_id").agg(F.count(F.lit(1)).alias("n_voxels"))
    # one row per scan from many voxels: stored, because the ordering reads it twice
    sized = cut_lineage(scans.select("patient_id", "volume_id", "day").join(counts, "volume_id", "left").fillna(0, ["n_voxels"]))
    out = in_order(sized, ["patient_id"], "day", ["volume_id"], lag={"n_voxels": "_prev"})
    return out.withColumn("change", F.col("n_voxels") - F.col("_prev")).drop("_prev")
