"""Session defaults, shared scratch space and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, app: str = "voxelcohort", **conf) -> SparkSession:
    """A single-machine session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Without the setting a checkpoint folder given to the context is used. Only a
    local master may fall back to a temporary folder: on a cluster that is an
    error, because a machine-local folder dies with its machine.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return _local_dirs.setdefault(context.applicationId, tempfile.mkdtemp(prefix="voxelcohort-"))


_scopes: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; the innermost open scope owns it."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Owns the tables that operators store inside it and removes them at its end.

    Frames are lazy: write the result inside the scope, to a path taken before
    it. Without a scope the tables stay until the folder is cleaned.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _remove(spark, path)


def cut_lineage(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """Write the frame to a table in the shared folder and continue from there.

    Used between the rounds of iterative operators and where one intermediate
    feeds several branches. The table survives lost executors, is pruned by
    column, and its size on disk lets the planner choose joins. ``instead_of`` is
    an earlier result of this function that nothing reads any more; its table is
    removed once the new one is there, so a loop holds one round and not all.
    """
    path = scratch_path(df.sparkSession, "stage")
    df.write.parquet(path)
    if instead_of is not None:
        drop_stored(instead_of)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def drop_stored(df: DataFrame) -> None:
    """Remove the table of a result of :func:`cut_lineage` that nothing reads any more."""
    if (at := getattr(df, "_stored_at", None)) is not None:
        _remove(df.sparkSession, at)
