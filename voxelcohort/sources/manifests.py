"""Readers and writers of manifests, splits, graphs, inventories and results."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelcohort import schemas
from voxelcohort.schemas import SPLIT_NAMES


def read_manifest(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | str) -> DataFrame:
    """CSV with a header and an explicit schema; a header that does not match it is an error."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(paths if isinstance(paths, str) else list(paths))


def read_batches(spark: SparkSession, batches: Mapping[int, str], schemas_by_batch: Mapping[int, T.StructType | str] | T.StructType | str) -> DataFrame:
    """Several batch manifests as one frame with ``batch_id``; absent columns are null."""
    def one(batch_id):
        schema = schemas_by_batch[batch_id] if isinstance(schemas_by_batch, Mapping) else schemas_by_batch
        return read_manifest(spark, batches[batch_id], schema).withColumn("batch_id", F.lit(batch_id))

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [one(b) for b in batches])


def read_splits(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Split specification JSON as ``(split, patient_id, scan_id, days_since_first)``.

    A file is one document, or one a line with ``lines``, which many tasks can
    read. Each document must have all of train, val and test.
    """
    spec = spark.read.schema(schemas.SPLITS).json(path, multiLine=not lines)
    named = [
        F.struct(
            F.lit(n).alias("split"),
            F.coalesce(F.col(n), F.raise_error(F.lit(f"split {n!r} is missing")).cast(schemas.SPLIT_TYPE)).alias("patients"),
        )
        for n in SPLIT_NAMES
    ]
    patients = spec.select(F.inline(F.array(*named))).select("split", F.inline("patients"))
    return patients.select("split", "patient_id", F.inline("scans"))


def read_graph(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables of a nested graph JSON, a document a file or, with ``lines``, a line."""
    graph = spark.read.schema(schemas.GRAPH).json(path, multiLine=not lines)
    return graph.select(F.inline("nodes")), graph.select(F.inline("links"))


def list_files(spark: SparkSession, path: str | list[str], pattern: str | None = None) -> DataFrame:
    """Inventory ``(path, length, mtime)`` of a folder or of several prefixes; file contents are not read.

    Spark lists more than ``spark.sql.sources.parallelPartitionDiscovery.threshold``
    prefixes, or subfolders of one, as a job and not on the driver. A prefix that does not exist is an error.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", "length", F.col("modificationTime").alias("mtime"))


def write_snapshot(df: DataFrame, base: str, stamp: str, fmt: str = "parquet") -> str:
    """Write one stamped version of a table and return its path."""
    path = f"{base.rstrip('/')}/{stamp}"
    writer = df.write.mode("overwrite").format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)
    return path


def _is_nested(t: T.DataType) -> bool:
    return isinstance(t, T.ArrayType | T.MapType | T.StructType)


def write_case_summary(df: DataFrame, path: str) -> None:
    """One flat CSV row per case; nested columns become JSON text."""
    flat = [F.to_json(f.name).alias(f.name) if _is_nested(f.dataType) else F.col(f.name) for f in df.schema]
    df.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_partitioned(df: DataFrame, path: str, by: Sequence[str] = ("study_type", "tracker"), rows_per_file: int = 1_000_000) -> None:
    """Table laid out by modality and timepoint; rows meet by partition first, so tasks write few files.

    A partition value that holds very many rows is rebalanced over several files.
    """
    df.hint("rebalance", *by).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy(*by).parquet(path)


def latest_snapshot(files: DataFrame, pattern: str, preferred: str) -> DataFrame:
    """Newest stamped file; names matching ``preferred`` come first."""
    name = F.element_at(F.split("path", "/"), -1)
    hits = files.withColumn("name", name).filter(F.col("name").rlike(pattern))
    return hits.orderBy(F.col("name").rlike(preferred).desc(), F.desc("name")).limit(1)


def materialise_once(spark: SparkSession, path: str, fn: Callable[[], DataFrame]) -> DataFrame:
    """Read the table at ``path``, computing and writing it first when it is not complete.

    A write that was cut short leaves no success marker and is done again.
    """
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    if not jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        fn().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
