"""Parameter grids, folds and metric histories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import prod

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelcohort.operators.skew import global_position

# fixed values: metrics where a smaller value is better
LOWER_IS_BETTER = ("rvd", "hausdorff")


def param_grid(values: DataFrame) -> DataFrame:
    """Every combination of parameter values, numbered from 1 with the last parameter fastest.

    ``values`` has ``(param, pos, value)``, positions from 0; parameters nest in
    name order. Items are numbers, each parameter reads its digit of the number.
    """
    sizes = {r["param"]: r["n"] for r in values.groupBy("param").agg(F.count(F.lit(1)).alias("n")).orderBy("param").collect()}
    grid = values.sparkSession.range(prod(sizes.values())).withColumnRenamed("id", "_item")
    after = prod(sizes.values())
    for name, n in sizes.items():
        after //= n
        digit = F.floor(F.col("_item") / after) % n
        listed = values.filter(F.col("param") == name).select(F.col("pos").cast("long").alias("_pos"), F.col("value").alias(name))
        grid = grid.withColumn("_pos", digit).join(listed, "_pos").drop("_pos")
    return grid.withColumn("item", F.col("_item") + 1).drop("_item")


def kfold(df: DataFrame, id_col: str, k: int, seed: int) -> DataFrame:
    """Adds ``fold`` 0..k-1 by a seeded shuffle; the first n mod k folds are one larger."""
    placed = global_position(df.withColumn("_h", F.xxhash64(id_col, F.lit(seed))), ["_h", id_col], "_pos")
    n = df.agg(F.count(F.lit(1))).scalar()
    base, extra = F.floor(n / k), n % k
    cut = extra * (base + 1)
    at = F.col("_pos") - 1
    fold = F.when(at < cut, F.floor(at / (base + 1))).otherwise(extra + F.floor((at - cut) / base))
    return placed.withColumn("fold", fold.cast("int")).drop("_h", "_pos")


def fold_views(folds: DataFrame, k: int) -> DataFrame:
    """Every row once per run of the cross-validation, as ``train`` or ``val``."""
    run = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    return folds.withColumn("run_fold", run).withColumn("part", F.when(F.col("fold") == F.col("run_fold"), "val").otherwise("train"))


def cv_summary(log: DataFrame, group: Sequence[str] = ("run_id", "metric")) -> DataFrame:
    """Mean and population deviation over folds, also as text with four decimals."""
    per = log.groupBy(*group).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    # this pattern rounds the exact binary value, half to even
    text = lambda c: F.expr(f"format_number({c}, '0.0000')")
    return per.withColumn("summary", F.concat(text("mean"), F.lit(" +/- "), text("std")))


def grid_results(grid: DataFrame, cv: DataFrame, metrics: Sequence[str], item: str = "item") -> DataFrame:
    """One row per grid item with a column per metric."""
    wide = cv.groupBy(item).agg(*[F.max(F.when(F.col("metric") == m, F.col("summary"))).alias(m) for m in metrics])
    return grid.join(wide, item, "left")


def to_losses(log: DataFrame) -> DataFrame:
    """Every metric as a loss: metrics where more is better become 1 - value."""
    return log.withColumn("value", F.when(F.col("metric").isin(*LOWER_IS_BETTER), F.col("value")).otherwise(1 - F.col("value")))


def composite_score(
    log: DataFrame, weights: Mapping[str, float], tracked: Sequence[str], window: int = 10, group: Sequence[str] = ("run_id", "fold")
) -> DataFrame:
    """Weighted score per epoch; tracked metrics enter as the sigmoid of their z-score in a trailing window.

    A metric's first value has z = 100, a window without spread gives null, and
    so does an epoch that lacks a weighted metric. A history has one row per epoch.
    """
    w = Window.partitionBy(*group, "metric").orderBy("epoch")
    recent = w.rowsBetween(1 - window, 0)
    spread = F.stddev_pop("value").over(recent)
    z = F.when(F.row_number().over(w) == 1, F.lit(100.0)).when(spread > 0, (F.col("value") - F.avg("value").over(recent)) / spread)
    scored = log.filter(F.col("metric").isin(*weights)).withColumn("_z", z)
    value = F.when(F.col("metric").isin(*tracked), 1 / (1 + F.exp(-F.col("_z")))).otherwise(F.col("value"))
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]), F.col("metric"))
    per = scored.withColumn("_p", weight * value).groupBy(*group, "epoch").agg(F.sum("_p").alias("_s"), F.count("_p").alias("_k"))
    return per.select(*group, "epoch", F.when(F.col("_k") == len(weights), F.col("_s")).alias("score"))


def early_stop(log: DataFrame, patience: int, delta: float = 0.0, alpha: float = 0.9, run: str = "run_id") -> DataFrame:
    """``(run, stop_epoch, best)``: where training would stop on the smoothed loss, null if it never does.

    The loss is smoothed as s = alpha * x + (1 - alpha) * s from s = 0; an epoch
    that fails to beat the best by ``delta`` counts as idle, and more than
    ``patience`` idle epochs stop the run. The fold is sequential, so runs are
    sorted and streamed through with a constant-size state.
    """
    run_type = log.schema[run].dataType.simpleString()

    def scan(batches):
        import pyarrow as pa

        def emit(rows):
            columns = [pa.array([r[n] for r in rows], t) for n, t in enumerate((key_type, pa.int64(), pa.float64()))]
            return pa.RecordBatch.from_arrays(columns, [run, "stop_epoch", "best"])

        now, state, key_type = None, None, None
        for batch in batches:
            key_type, out = batch.schema.field(run).type, []
            for key, epoch, x in zip(*(batch.column(c).to_pylist() for c in (run, "epoch", "value"))):
                if state is None or key != now:
                    if state is not None:
                        out.append((now, state["stop"], state["best"]))
                    now, state = key, {"s": 0.0, "best": float("inf"), "idle": 0, "stop": None}
                if state["stop"] is not None:
                    continue
                state["s"] = alpha * x + (1 - alpha) * state["s"]
                if state["s"] < state["best"] - delta:
                    state["best"], state["idle"] = state["s"], 0
                else:
                    state["idle"] += 1
                    if state["idle"] > patience:
                        state["stop"] = epoch
            yield emit(out)
        if state is not None:
            yield emit([(now, state["stop"], state["best"])])

    typed = log.select(run, F.col("epoch").cast("long").alias("epoch"), F.col("value").cast("double").alias("value"))
    ordered = typed.repartition(run).sortWithinPartitions(run, "epoch")
    return ordered.mapInArrow(scan, f"{run} {run_type}, stop_epoch long, best double")


def best_epoch(scores: DataFrame, group: Sequence[str] = ("run_id",)) -> DataFrame:
    """First epoch with the smallest score below 1.0."""
    per = scores.filter(F.col("score") < 1.0).groupBy(*group).agg(F.min(F.struct("score", "epoch")).alias("_b"))
    return per.select(*group, F.col("_b.epoch").alias("best_epoch"), F.col("_b.score").alias("best_score"))


def epoch_loss(log: DataFrame, group: Sequence[str] = ("run_id", "epoch")) -> DataFrame:
    return log.groupBy(*group).agg(F.avg("value").alias("mean_loss"))
