"""Continuous intake of series manifests."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from voxelcohort.functions import paths as P
from voxelcohort.operators import incremental as I
from voxelcohort.operators import linkage as L
from voxelcohort.session import cut_lineage, drop_stored


def clean(series: DataFrame) -> DataFrame:
    """Clean paths and split the tracker; works on batch and streaming frames alike."""
    return L.split_tracker(series.withColumn("image_path", P.clean_path("image_path")))


TRACKED = "series_id string, tracker string, image_path string, version string, arrived_ms long, cause string"
KEPT = "series array<string>, version array<string>, tracker array<string>, image_path array<string>, planned_ms array<long>, check_ms array<long>"
#: Rows of state: the series of a bucket share one, because each group called for costs milliseconds.
BUCKETS = 1 << 13


def _follow(delay_ms: int, recheck_ms: int | None):
    """State of a bucket of series: the version planned last, when, and when to check; says why an arrival, or a timer, has to be planned."""

    def fn(key, frames, state):
        kept = {series: row for series, *row in zip(*state.get)} if state.exists else {}
        now = state.getCurrentWatermarkMs()
        out, arrivals = [], {}
        if not state.hasTimedOut:
            for frame in frames:
                for series, *row in zip(*(frame[c].tolist() for c in ("series_id", "arrived_ms", "version", "tracker", "image_path"))):
                    arrivals.setdefault(series, []).append(row)
        if recheck_ms is not None:
            for series, (version, tracker, path, _, check) in kept.items():
                if check < now and series not in arrivals:
                    out.append((series, tracker, path, version, now, "check"))
                    kept[series] = [version, tracker, path, now, max(now + recheck_ms, now + 1)]
        for series, rows in arrivals.items():
            own = kept.get(series)
            rows.sort(key=lambda row: [(True, 0) if x is None or x != x else (False, x) for x in row])  # missing values last
            for arrived, version, tracker, path in rows:
                if own is None:
                    cause = "new"
                elif version != own[0]:
                    cause = "changed"
                elif arrived - own[3] > delay_ms:
                    cause = "repeat"
                else:
                    continue
                own = [version, tracker, path, int(arrived), 0]
                out.append((series, tracker, path, version, int(arrived), cause))
            if recheck_ms is not None:
                own[4] = max(own[3] + recheck_ms, now + 1)
            kept[series] = own
        state.update((list(kept), *map(list, zip(*kept.values()))))
        if recheck_ms is not None:
            state.setTimeoutTimestamp(min(row[4] for row in kept.values()))
        if out:
            yield pd.DataFrame(out, columns=["series_id", "tracker", "image_path", "version", "arrived_ms", "cause"])

    return fn


def track_series(arrivals: DataFrame, delay: str = "1 day", recheck: str | None = None) -> DataFrame:
    """Arrivals that have to be planned, with ``cause``: ``new``, ``changed``, ``repeat`` or ``check``.

    ``arrivals`` streams ``(series_id, tracker, image_path, version, arrived)``. A
    series is planned when it is first seen, when its version is another than
    the one planned last, and when it comes again more than ``delay`` after that;
    other repeats are dropped, and so are rows later than ``delay`` behind the latest arrival. With ``recheck`` a timer
    plans it once more that long after it was planned, and again as long as the stream goes on, so that lost
    outputs are found. A small entry of state is kept for each series, in ``BUCKETS`` rows.
    """
    spark = arrivals.sparkSession
    ms = lambda text: int(spark.sql(f"select unix_millis(timestamp '1970-01-01 00:00:00Z' + interval {text})").first()[0])
    bucket = F.pmod(F.xxhash64("series_id"), F.lit(BUCKETS))
    rows = arrivals.withWatermark("arrived", delay).withColumns({"arrived_ms": F.unix_millis("arrived"), "version": F.coalesce("version", F.lit("")), "_bucket": bucket})
    told = rows.groupBy("_bucket").applyInPandasWithState(_follow(ms(delay), recheck and ms(recheck)), TRACKED, KEPT, "append", "EventTimeTimeout")
    return told.withColumn("arrived", F.timestamp_millis("arrived_ms")).drop("arrived_ms")


def stream_tracked(arrivals: DataFrame, outputs: DataFrame, inputs: DataFrame, sink: str, checkpoint: str, delay: str = "1 day", recheck: str | None = None) -> StreamingQuery:
    """Plan what :func:`track_series` gives and append it with its ``cause`` to the to-do table at ``sink``.

    A check of a series whose outputs are there is no work and not written.
    Each micro-batch is written to its own folder, so a batch run again after a failure replaces itself.
    """

    def plan(batch: DataFrame, batch_id: int) -> None:
        with _stored(batch) as rows:
            told = _planned(rows, outputs, inputs).filter(F.lit(not rows.isEmpty()))  # nothing is joined to an empty batch
            told = told.filter((F.col("cause") != "check") | F.coalesce(F.col("reason") != "already_processed", F.lit(True)))
            told.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    stream = track_series(arrivals.withColumn("image_path", P.clean_path("image_path")), delay, recheck)
    with _few_parts(arrivals.sparkSession):
        return stream.writeStream.foreachBatch(plan).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@contextmanager
def _few_parts(spark: SparkSession) -> Iterator[None]:
    """A stream started inside keeps its state in two parts a core at most; a checkpoint that exists keeps its number.

    Each part writes files in every micro-batch, also in one without rows, and
    micro-batches are planned without merging small partitions.
    """
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, min(int(before), 2 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def _stored(batch: DataFrame) -> Iterator[DataFrame]:
    """The rows of a micro-batch, written once and read by several joins, removed at the end.

    Stateful tasks must run once a batch: of a cached batch, executors that do not hold a
    part yet start its task again while another still writes that part's state.
    """
    rows = cut_lineage(batch)
    try:
        yield rows
    finally:
        drop_stored(rows)


def _planned(batch: DataFrame, outputs: DataFrame, inputs: DataFrame) -> DataFrame:
    """The batch planned against the outputs and inputs as they are."""
    # the inventories are reduced to what the batch can ask for before anything else reads them
    asked = batch.select(F.explode(P.expected_names(P.strip_ext(P.base_name("image_path")))).alias("name")).distinct()
    done = outputs.join(asked, "name", "left_semi")
    there = inputs.join(batch.select(F.col("image_path").alias("path")).distinct(), "path", "left_semi")
    return I.plan_todo(batch, done, there, row_id="series_id")


def stream_intake(
    arrivals: DataFrame, outputs: DataFrame, inputs: DataFrame, sink: str, checkpoint: str, delay: str = "1 day"
) -> StreamingQuery:
    """Plan every arriving series once and append it to the to-do table at ``sink``.

    ``arrivals`` streams ``(series_id, tracker, image_path, arrived)``. Repeats of a
    series within ``delay`` are dropped; a later repeat is planned again, and is
    then finished work if its outputs are there. Each micro-batch is planned against the
    outputs and inputs as they are then and written to its own folder, so a
    batch run again after a failure replaces itself.
    """
    fresh = clean(arrivals).withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["series_id"])

    def plan(batch: DataFrame, batch_id: int) -> None:
        with _stored(batch) as rows:
            _planned(rows, outputs, inputs).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return fresh.writeStream.foreachBatch(plan).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
