"""Registered queries: sources, sinks and the streaming intake, as round trips of the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelcohort.checks import require_columns
from voxelcohort.operators import voxels as V
from voxelcohort.session import scratch_path
from voxelcohort.sources import manifests as S
from voxelcohort.sources import volumes as SV
from voxelcohort.streaming.intake import stream_intake, stream_tracked
from voxelcohort.workload import tables as T
from voxelcohort.workload.hierarchy import _PLAN, intake
from voxelcohort.workload.tables import CTE, with_sql

Q: dict[str, tuple] = {}
_COLS = ["series_id", "patient_id", "scan_order", "study_type", "seg_path", "file_size_mb"]
_DDL = "series_id STRING, patient_id STRING, scan_order BIGINT, study_type STRING, seg_path STRING, file_size_mb DOUBLE"
_SQL = f"SELECT {', '.join(_COLS)} FROM series"


def q(name, sql=None):
    def add(fn):
        Q[name] = (fn, sql)
        return fn

    return add


def _csv(df, spark, name):
    path = scratch_path(spark, name)
    df.write.option("header", True).csv(path)
    return path


@q("S01_read_manifest", with_sql(_SQL, "series"))
def _(spark, d):
    return S.read_manifest(spark, _csv(T.series(spark, d).select(*_COLS), spark, "manifest"), _DDL)


@q("S02_read_batches", with_sql("SELECT series_id, patient_id, CASE WHEN study_type <> 'DWI' THEN seg_path END AS seg_path, CASE WHEN study_type = 'DWI' THEN 2 ELSE 1 END AS batch_id FROM series", "series"))
def _(spark, d):
    s = T.series(spark, d)
    full = _csv(s.filter("study_type <> 'DWI'").select("series_id", "patient_id", "seg_path"), spark, "batch1")
    bare = _csv(s.filter("study_type = 'DWI'").select("series_id", "patient_id"), spark, "batch2")
    ddl = {1: "series_id STRING, patient_id STRING, seg_path STRING", 2: "series_id STRING, patient_id STRING"}
    return S.read_batches(spark, {1: full, 2: bare}, ddl)


@q("S03_read_splits", with_sql("SELECT CASE WHEN split = 'val' THEN 'val' WHEN CAST(patient_id AS BIGINT) % 7 = 0 THEN 'test' ELSE 'train' END AS split, patient_id, scan_id, day AS days_since_first FROM scans", "scans"))
def _(spark, d):
    s = T.scans(spark, d)
    part = F.when(F.col("split") == "val", "val").when(F.col("patient_id").cast("long") % 7 == 0, "test").otherwise("train")
    # one document a scan, so nothing is gathered; Spark chooses the number of files
    person = F.struct("patient_id", F.array(F.struct("scan_id", F.col("day").alias("days_since_first"))).alias("scans"))
    none = F.array().cast("array<struct<patient_id:string,scans:array<struct<scan_id:string,days_since_first:double>>>>")
    spec = s.select(*[F.when(part == n, F.array(person)).otherwise(none).alias(n) for n in S.SPLIT_NAMES])
    path = scratch_path(spark, "splits")
    spec.write.json(path)
    return S.read_splits(spark, path, lines=True)


@q("S04_read_graph", with_sql("""
  SELECT 'node' AS kind, id AS a, label AS b, file_type AS c FROM nodes UNION ALL SELECT 'link', source, target, relation FROM edges""", "nodes", "edges"))
def _(spark, d):
    node_type = "array<struct<id:string,label:string,community:int,file_type:string,source_file:string>>"
    link_type = "array<struct<source:string,target:string,relation:string,confidence:string>>"
    n = T.nodes(spark, d).select(F.array(F.struct("id", "label", "community", "file_type", "source_file")).alias("nodes"), F.array().cast(link_type).alias("links"))
    e = T.edges(spark, d).select(F.array().cast(node_type).alias("nodes"), F.array(F.struct("source", "target", "relation", "confidence")).alias("links"))
    path = scratch_path(spark, "graph")
    n.unionByName(e).write.json(path)
    nodes, links = S.read_graph(spark, path, lines=True)
    return nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("label").alias("b"), F.col("file_type").alias("c")).unionByName(
        links.select(F.lit("link").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"), F.col("relation").alias("c")))


@q("S05_require_columns", with_sql("SELECT series_id, study_type FROM series", "series"))
def _(spark, d):
    return require_columns(T.series(spark, d), ["series_id", "study_type"]).select("series_id", "study_type")


@q("S06_list_files", with_sql("""
  SELECT 'study_type=' || study_type || '/part=' || (event_id // 500) AS place, CAST(sum(length(series_id) + 1) AS BIGINT) AS length, true AS recent
  FROM series GROUP BY study_type, event_id // 500""", "series"))
def _(spark, d):
    # all series, 500 event numbers a part, so that the inventory grows with the table
    path = scratch_path(spark, "inventory")
    rows = T.series(spark, d).select("study_type", F.expr("event_id div 500").alias("part"), F.col("series_id").alias("value"))
    # a folder for each task: the driver moves folders and not files when the write ends, and one task lists what one task wrote
    dealt = rows.repartition(max(64, 4 * spark.sparkContext.defaultParallelism), "study_type", "part").withColumn("slice", F.spark_partition_id())
    dealt.write.partitionBy("slice", "study_type", "part").text(path)
    files = S.list_files(spark, path, "*.txt")
    place = F.url_decode(F.regexp_extract("path", "(study_type=[^/]*/part=[^/]*)/[^/]*$", 1))
    place = F.when(~F.col("path").contains("/study_type=__HIVE_DEFAULT_PARTITION__/"), place)  # files of series without a type
    return files.select(place.alias("place"), F.col("length").cast("long").alias("length"), (F.col("mtime") > F.current_timestamp() - F.expr("INTERVAL 1 HOUR")).alias("recent"))


def _nifti_files(spark, d):
    """Every volume chunk as the bytes of its own NIfTI-1 file, first axis fastest as the format demands."""
    import struct

    import numpy as np
    import pandas as pd

    def encode(batches):
        for pdf in batches:
            out = []
            for vec_id, vec in zip(pdf["vec_id"], pdf["embedding"]):
                head = bytearray(352)
                struct.pack_into("<i", head, 0, 348)
                struct.pack_into("<8h", head, 40, 3, 4, 4, 4, 1, 1, 1, 1)
                struct.pack_into("<2h", head, 70, 16, 32)
                struct.pack_into("<8f", head, 76, 1, 0.5, 0.5, 3.0, 0, 0, 0, 0)
                struct.pack_into("<3f", head, 108, 352, 1, 0)
                head[123] = 2
                head[344:348] = b"n+1\0"
                body = np.asarray(vec, dtype="<f4").reshape(4, 4, 4).tobytes(order="F")
                out.append((f"vault/{vec_id}.nii", bytes(head) + body))
            yield pd.DataFrame(out, columns=["path", "content"])

    return T.table(spark, d, "embeddings").select("vec_id", "embedding").mapInPandas(encode, "path string, content binary")


@q("S07_decode_volumes", """
  SELECT 'vault/' || vec_id || '.nii' AS volume_id, pos // 16 AS i, pos // 4 % 4 AS j, pos % 4 AS k, round(CAST(v AS DOUBLE), 6) + 0.0 AS value, 3.0::DOUBLE AS dz, 'mm' AS unit
  FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)""")
def _(spark, d):
    chunks = SV.decode_volumes(_nifti_files(spark, d), edge=3).withColumnRenamed("path", "volume_id")
    vox = V.explode_voxels(chunks).withColumn("value", F.round("value", 6))
    head = chunks.filter("bi = 0 AND bj = 0 AND bk = 0").select("volume_id", F.get("spacing", 2).alias("dz"), "unit")
    return vox.join(head, "volume_id")


@q("S08_write_snapshot", with_sql(_SQL, "series"))
def _(spark, d):
    base = scratch_path(spark, "snapshots")
    s = T.series(spark, d).select(*_COLS)
    S.write_snapshot(s, base, "2024-01-01", "csv")
    return spark.read.parquet(S.write_snapshot(s, base, "2024-01-02"))


@q("S09_write_case_summary", with_sql("SELECT series_id, '[\"' || study_type || '\",\"' || tracker || '\"]' AS labels FROM series", "series"))
def _(spark, d):
    path = scratch_path(spark, "summary")
    S.write_case_summary(T.series(spark, d).select("series_id", F.array("study_type", "tracker").alias("labels")), path)
    return spark.read.schema("series_id STRING, labels STRING").option("header", True).option("escape", '"').csv(path)


@q("S10_write_json", with_sql("SELECT series_id, study_type, scan_order FROM series", "series"))
def _(spark, d):
    path = scratch_path(spark, "report")
    S.write_json(T.series(spark, d).select("series_id", F.struct("study_type", "scan_order").alias("facts")), path)
    return spark.read.schema("series_id STRING, facts STRUCT<study_type: STRING, scan_order: BIGINT>").json(path).select("series_id", "facts.*")


@q("S11_write_partitioned", with_sql("SELECT study_type, scan_order, series_id FROM series", "series"))
def _(spark, d):
    path = scratch_path(spark, "layout")
    S.write_partitioned(T.series(spark, d).select("study_type", "scan_order", "series_id"), path, ["study_type", "scan_order"])
    return spark.read.schema("series_id STRING, study_type STRING, scan_order BIGINT").parquet(path)


@q("S12_latest_snapshot", """
  SELECT 'runs/' || name AS path FROM (SELECT 'meta_' || strftime(CAST(ts AS DATE), '%Y-%m-%d') || CASE WHEN event_type = 'view' THEN '_full' ELSE '' END || '.csv' AS name FROM events)
  ORDER BY name LIKE '%_full.csv' DESC, name DESC LIMIT 1""")
def _(spark, d):
    e = T.table(spark, d, "events")
    name = F.concat(F.lit("runs/meta_"), F.date_format("ts", "yyyy-MM-dd"), F.when(F.col("event_type") == "view", "_full").otherwise(""), F.lit(".csv"))
    return S.latest_snapshot(e.select(name.alias("path")).distinct(), r"^meta_.*\.csv$", r"_full\.csv$").select("path")


@q("S13_materialise_once", with_sql("SELECT study_type, count(*) AS n FROM series GROUP BY 1", "series"))
def _(spark, d):
    path = scratch_path(spark, "once")
    counts = lambda: T.series(spark, d).groupBy("study_type").agg(F.count(F.lit(1)).alias("n"))
    S.materialise_once(spark, path, counts)
    return S.materialise_once(spark, path, counts)


CTE["todo_plan"] = (("intake", "outputs"), _PLAN)


@q("I13_stream_intake", with_sql("""
  SELECT p.series_id, p.reason, p.matched, i.scan_order, i.days FROM todo_plan p JOIN (SELECT series_id, CAST(scan_order AS INTEGER) AS scan_order, CAST(days AS INTEGER) AS days FROM series) i USING (series_id)""", "todo_plan", "series"))
def _(spark, d):
    rows, outputs, present = intake(spark, d)
    s = T.series(spark, d).select("series_id", "tracker")
    arrivals = rows.join(s, "series_id").select(
        "series_id", "tracker", F.concat(F.lit("/ "), "image_path").alias("image_path"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("arrived"))
    landing, sink = scratch_path(spark, "landing"), scratch_path(spark, "todo")
    # every series arrives twice
    arrivals.write.parquet(landing)
    arrivals.write.mode("append").parquet(landing)
    stream = spark.readStream.schema(arrivals.schema).option("maxFilesPerTrigger", 4).parquet(landing)
    query = stream_intake(stream, outputs, present, sink, scratch_path(spark, "progress"))
    query.awaitTermination()
    return spark.read.parquet(sink).select("series_id", "reason", "matched", "scan_order", "days")


@q("I13_tracked_intake", with_sql("""
  SELECT p.series_id, c.cause, c.version, c.arrived, p.reason FROM todo_plan p JOIN series s USING (series_id) JOIN (VALUES
    ('new', 'v1', TIMESTAMP '2024-01-01 00:00:00', 1), ('repeat', 'v1', TIMESTAMP '2024-01-04 00:00:00', 5), ('changed', 'v2', TIMESTAMP '2024-01-04 12:00:00', 7)
  ) c(cause, version, arrived, every) ON s.event_id % c.every = 0""", "todo_plan", "series"))
def _(spark, d):
    rows, outputs, present = intake(spark, d)
    base = rows.join(T.series(spark, d).select("series_id", "tracker", "event_id"), "series_id")

    def arrival(every, when, version):
        return base.filter(F.col("event_id") % every == 0).select("series_id", "tracker", "image_path", F.lit(version).alias("version"), F.lit(when).cast("timestamp").alias("arrived"))

    landing, sink, progress = (scratch_path(spark, x) for x in ("landing", "todo", "progress"))
    first = arrival(1, "2024-01-01 00:00:00", "v1")
    # all series twice; some again within the day; some after it; rows that come too late; another version
    for part in (first.unionByName(first), arrival(3, "2024-01-01 06:00:00", "v1"), arrival(5, "2024-01-04 00:00:00", "v1"), arrival(2, "2024-01-01 12:00:00", "v9"), arrival(7, "2024-01-04 12:00:00", "v2")):
        part.write.mode("append").parquet(landing)
        stream = spark.readStream.schema(first.schema).parquet(landing)
        stream_tracked(stream, outputs, present, sink, progress, "1 day").awaitTermination()
    return spark.read.parquet(sink).select("series_id", "cause", "version", "arrived", "reason")
