"""Readers, writers and the streaming intake."""

import gzip
import json
import os
import struct
from datetime import datetime
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelcohort.functions import paths as P
from voxelcohort.operators import incremental as I
from voxelcohort.operators.voxels import explode_voxels
from voxelcohort.session import cut_lineage, scratch_path, scratch_scope, shared_dir
from voxelcohort.sources import manifests as S
from voxelcohort.sources import volumes as SV
from voxelcohort.streaming.intake import clean, stream_intake, stream_tracked
from voxelcohort.workload.storage import Q as STORAGE


def nifti(arr, kind, code, end="<", slope=1.0, inter=0.0, spacing=(0.5, 0.6, 3.0), unit=2):
    head = bytearray(352)
    struct.pack_into(end + "i", head, 0, 348)
    struct.pack_into(end + "8h", head, 40, arr.ndim, *arr.shape, *[1] * (7 - arr.ndim))
    struct.pack_into(end + "2h", head, 70, code, np.dtype(kind).itemsize * 8)
    struct.pack_into(end + "8f", head, 76, 1, *spacing[: arr.ndim], *[0] * (7 - arr.ndim))
    struct.pack_into(end + "3f", head, 108, 352, slope, inter)
    head[123], head[344:348] = unit, b"n+1\0"
    return bytes(head) + arr.astype(np.dtype(end + kind)).tobytes(order="F")


@pytest.fixture
def volume_files(tmp_path):
    rng = np.random.default_rng(1)
    arrays = {"a.nii": rng.normal(size=(5, 4, 7)), "b.nii.gz": rng.integers(-9, 9, (3, 6, 5)).astype("f8"), "c.npy": rng.normal(size=(6, 3, 2)), "d.nii": rng.normal(size=(4, 3))}
    (tmp_path / "a.nii").write_bytes(nifti(arrays["a.nii"], "f4", 16))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.nii.gz").write_bytes(gzip.compress(nifti(arrays["b.nii.gz"], "i2", 4, ">", 2.0, 1.0, unit=3)))
    np.save(tmp_path / "c.npy", arrays["c.npy"])
    (tmp_path / "d.nii").write_bytes(nifti(arrays["d.nii"], "f8", 64))
    (tmp_path / "notes.txt").write_text("no volume")
    arrays["b.nii.gz"] = arrays["b.nii.gz"] * 2 + 1
    return tmp_path, arrays


def test_read_volumes(spark, volume_files):
    root, arrays = volume_files
    head, chunks = SV.read_volumes(spark, str(root), edge=3)
    heads = {r["volume_id"].split("/")[-1]: r for r in head.collect()}
    assert set(heads) == set(arrays)
    assert heads["b.nii.gz"]["unit"] == "um" and heads["a.nii"]["spacing"] == pytest.approx([0.5, 0.6, 3.0]) and heads["d.nii"]["spacing"][2] == 1.0
    got = {n: np.full(a.shape if a.ndim == 3 else (*a.shape, 1), np.nan) for n, a in arrays.items()}
    for r in explode_voxels(chunks).collect():
        got[r["volume_id"].split("/")[-1]][r["i"], r["j"], r["k"]] = r["value"]
    for n, a in arrays.items():
        np.testing.assert_allclose(got[n], a.reshape(got[n].shape), rtol=1e-6)
        assert heads[n]["shape"] == list(got[n].shape)


def test_frames_scaling_and_offsets(spark, tmp_path):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(3, 4, 5, 2)).astype("f4")
    (tmp_path / "four.nii").write_bytes(nifti(a, "f4", 16, spacing=(1.0, 2.0, 3.0, 9.0)))
    np.save(tmp_path / "four.npy", a)
    np.save(tmp_path / "fortran.npy", np.asfortranarray(a))
    np.save(tmp_path / "line.npy", a[0, 0, 0])
    flat = a[..., 0]
    (tmp_path / "zero.nii").write_bytes(nifti(flat, "f4", 16, slope=0.0, inter=7.0))
    (tmp_path / "nan.nii").write_bytes(nifti(flat, "f4", 16, slope=float("nan"), inter=7.0))
    (tmp_path / "inter.nii").write_bytes(nifti(flat, "f4", 16, slope=1.0, inter=float("nan")))
    low = bytearray(nifti(flat, "f4", 16))
    struct.pack_into("<f", low, 108, 0.0)
    (tmp_path / "low.nii").write_bytes(bytes(low))
    head, chunks = SV.read_volumes(spark, str(tmp_path), edge=2)
    names = {r["volume_id"].split("/")[-1]: r for r in head.collect()}
    assert set(names) == {f"{n}#{t}" for n in ("four.nii", "four.npy", "fortran.npy") for t in (0, 1)} | {"line.npy", "zero.nii", "nan.nii", "inter.nii", "low.nii"}
    assert names["four.nii#1"]["shape"] == [3, 4, 5] and names["four.nii#1"]["spacing"] == [1.0, 2.0, 3.0]
    got = {}
    for r in explode_voxels(chunks).collect():
        got.setdefault(r["volume_id"].split("/")[-1], {})[r["i"], r["j"], r["k"]] = r["value"]
    for n, cells in got.items():
        want = a[0, 0, 0].reshape(2, 1, 1) if n == "line.npy" else a[..., int(n[-1])] if "#" in n else flat
        assert len(cells) == want.size and all(abs(want[at] - v) < 1e-6 for at, v in cells.items()), n
    assert set(got) == set(names)


def test_a_short_file_is_an_error(spark, tmp_path):
    (tmp_path / "short.nii").write_bytes(nifti(np.zeros((3, 3, 3)), "f4", 16)[:-8])
    with pytest.raises(Exception, match="ends before"):
        SV.read_volumes(spark, str(tmp_path))[1].collect()


def test_inventory(spark, volume_files):
    files = S.list_files(spark, str(volume_files[0]))
    assert files.count() == 5 and files.filter("path LIKE '%notes.txt'").first()["length"] == 9
    assert "content" not in files._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def test_inventory_query_moves_folders_of_tasks(spark, tmp_path):
    """One row a study type and part; what one task writes has folders of its own, so none of its files is moved alone."""
    kinds = {"view": "T1_post", "purchase": "t2_thin", "signup": "T2_FLAIR", "error": "DWI", "click": "t1 pre", None: None}
    rows = [(n * 97, datetime(2024, 1, 1 + n % 9), n % 11, [*kinds][n % 6], 20.0, "{}") for n in range(600)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    want = {}
    for event_id, _, _, kind, *_ in rows:
        want[kinds[kind], event_id // 500] = want.get((kinds[kind], event_id // 500), 0) + len(f"S{event_id}") + 1
    named = sorted((f"study_type={k}/part={p}" if k else "", n, True) for (k, p), n in want.items())
    made = lambda: set(Path(shared_dir(spark)).glob("inventory-*"))
    key, here = "spark.sql.adaptive.coalescePartitions.enabled", made()
    given = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        got = STORAGE["S06_list_files"][0](spark, str(tmp_path)).collect()
    finally:
        spark.conf.set(key, given)
    assert sorted((r["place"] or "", r["length"], r["recent"]) for r in got) == named
    (kept,) = made() - here
    tops = [x for x in kept.iterdir() if x.is_dir()]
    writers = [{f.name.split("-")[1] for f in top.rglob("part-*.txt")} for top in tops]
    assert len(tops) > 32 and all(len(w) == 1 for w in writers)  # above 32 folders Spark lists them as a job


def test_manifest_header_must_match(spark, tmp_path):
    (tmp_path / "m.csv").write_text("a,b\n1,x\n")
    assert tuple(S.read_manifest(spark, str(tmp_path / "m.csv"), "a INT, b STRING").first()) == (1, "x")
    with pytest.raises(Exception, match="(?i)header"):
        S.read_manifest(spark, str(tmp_path / "m.csv"), "a INT, c STRING").collect()


def test_splits(spark, tmp_path):
    spec = {"train": [{"patient_id": "1", "scans": [{"scan_id": "1_0_0", "days_since_first": 0}, {"scan_id": "1_1_9", "days_since_first": 9}]}], "val": [], "test": []}
    (tmp_path / "s.json").write_text(json.dumps(spec, indent=1))
    assert {tuple(r) for r in S.read_splits(spark, str(tmp_path / "s.json")).collect()} == {("train", "1", "1_0_0", 0.0), ("train", "1", "1_1_9", 9.0)}
    del spec["val"]
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(Exception, match="split 'val' is missing"):
        S.read_splits(spark, str(tmp_path / "t.json")).collect()


def test_graph(spark, tmp_path):
    doc = {"nodes": [{"id": "a", "community": 3}, {"id": "b", "label": "B"}], "links": [{"source": "a", "target": "b", "relation": "r"}]}
    (tmp_path / "g.json").write_text(json.dumps(doc, indent=1))
    nodes, links = S.read_graph(spark, str(tmp_path / "g.json"))
    assert {(r["id"], r["community"], r["label"]) for r in nodes.collect()} == {("a", 3, None), ("b", None, "B")}
    assert [(r["source"], r["target"]) for r in links.collect()] == [("a", "b")]


def test_materialise_once_runs_once_and_repairs_a_cut_write(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(3)

    path = str(tmp_path / "t")
    assert S.materialise_once(spark, path, make).count() == S.materialise_once(spark, path, make).count() == 3
    assert len(calls) == 1
    (tmp_path / "t" / "_SUCCESS").unlink()
    S.materialise_once(spark, path, make)
    assert len(calls) == 2


def test_latest_snapshot(spark):
    files = spark.createDataFrame([(f"x/{n}",) for n in ("meta_2024-01-02.csv", "meta_2024-03-01.csv", "meta_2023-01-01_full.csv", "other.csv")], "path string")
    assert S.latest_snapshot(files, r"^meta_.*\.csv$", "_full").first()["name"] == "meta_2023-01-01_full.csv"
    assert S.latest_snapshot(files, r"^meta_.*\.csv$", "_none").first()["name"] == "meta_2024-03-01.csv"


class FakeSession:
    """The three things ``shared_dir`` asks a session for."""

    def __init__(self, setting, context_dir, master):
        self.conf = {"spark.checkpoint.dir": setting} if setting else {}
        self.sparkContext = self
        self.master, self.applicationId, self._dir = master, f"app-{master}", context_dir

    def getCheckpointDir(self):
        return self._dir


def test_shared_dir_follows_the_session_setting():
    assert scratch_path(FakeSession("hdfs://c/", "/other", "yarn"), "x").startswith("hdfs://c/x-")
    assert shared_dir(FakeSession(None, "s3a://b/ck", "yarn")) == "s3a://b/ck"
    local = FakeSession(None, None, "local[2]")
    assert shared_dir(local) == shared_dir(local)
    with pytest.raises(RuntimeError, match="shared by all executors"):
        shared_dir(FakeSession(None, None, "yarn"))


def test_stream_equals_batch_and_drops_repeats(spark, tmp_path):
    rows = [(f"s{n}", f"{n}_0_{n}", f"in\\ s{n}.nii.gz" if n % 3 else f"in/s{n}.txt", "2024-01-01 00:00:00") for n in range(20)]
    df = spark.createDataFrame(rows, "series_id string, tracker string, image_path string, at string").withColumn("arrived", F.to_timestamp("at")).drop("at")
    outputs = spark.createDataFrame([("s1_bet.nii.gz",), ("s2_mask.nii.gz",)], "name string")
    inputs = spark.createDataFrame([(f"in/s{n}.nii.gz",) for n in range(0, 20, 2)], "path string")
    landing, sink, progress = (str(tmp_path / p) for p in ("landing", "todo", "progress"))
    df.filter("series_id < 's15'").write.parquet(landing)
    stream = spark.readStream.schema(df.schema).parquet(landing)
    stream_intake(stream, outputs, inputs, sink, progress).awaitTermination()
    df.write.mode("append").parquet(landing)
    stream_intake(stream, outputs, inputs, sink, progress).awaitTermination()
    cols = ["series_id", "patient_id", "days", "image_path", "reason", "matched"]
    got = [tuple(r) for r in spark.read.parquet(sink).select(*cols).collect()]
    want = {tuple(r) for r in I.plan_todo(clean(df), outputs, inputs, row_id="series_id").select(*cols).collect()}
    assert len(got) == 20 and set(got) == want


def test_tracked_series_are_planned_again(spark, tmp_path):
    """Versions, repeats, late rows, and a timer that finds a lost output."""
    landing, sink, progress = (str(tmp_path / n) for n in ("landing", "sink", "progress"))
    schema = "series_id string, tracker string, image_path string, version string, arrived timestamp"
    outputs = spark.createDataFrame([("a_vs.nii.gz",)], "name string").limit(0)
    names = [r["name"] for r in spark.createDataFrame([("in/b.nii.gz",)], "p string").select(F.explode(P.expected_names(P.strip_ext(P.base_name("p")))).alias("name")).collect()]
    inputs = spark.createDataFrame([("in/a.nii.gz",), ("in/b.nii.gz",)], "path string")

    def run(rows, done):
        df = spark.createDataFrame([(s, "1_0_0", f"in/{s}.nii.gz", v, datetime.fromisoformat(t)) for s, v, t in rows], schema)
        df.write.mode("append").parquet(landing)
        stream_tracked(spark.readStream.schema(schema).parquet(landing), done, inputs, sink, progress, "1 day", "2 days").awaitTermination()
        return sorted((r["series_id"], r["cause"], r["version"], r["reason"]) for r in spark.read.parquet(sink).collect())

    finished = spark.createDataFrame([(names[0],)], "name string")
    first = run([("a", "v1", "2024-01-01 00:00:00"), ("a", "v1", "2024-01-01 05:00:00"), ("b", None, "2024-01-01 00:00:00")], finished)
    assert first == [("a", "new", "v1", None), ("b", "new", "", "already_processed")]
    second = run([("a", "v2", "2024-01-01 08:00:00"), ("c", "v1", "2024-01-06 00:00:00")], finished)
    # the watermark is now 5 January: both timers are due, and only a has no outputs
    assert [x for x in second if x not in first] == [("a", "changed", "v2", None), ("a", "check", "v2", None), ("c", "new", "v1", "missing_file")]
    third = run([("a", "v9", "2024-01-02 00:00:00"), ("c", "v1", "2024-01-09 00:00:00")], outputs)
    fresh = third.copy()
    for x in second:
        fresh.remove(x)
    # the late row is dropped, the repeat is recognised, and the output of b is gone
    assert ("a", "changed", "v9", None) not in fresh and ("c", "repeat", "v1", "missing_file") in fresh and ("b", "check", "", None) in fresh


def test_tracked_series_of_one_bucket(spark, tmp_path, monkeypatch):
    from voxelcohort.streaming import intake

    monkeypatch.setattr(intake, "BUCKETS", 1)
    test_tracked_series_are_planned_again(spark, tmp_path)


def test_tracked_state_has_few_rows_and_parts(spark, tmp_path, monkeypatch):
    """Series share rows of state, and its parts follow the cores whatever a shuffle has."""
    from voxelcohort.streaming import intake

    monkeypatch.setattr(intake, "BUCKETS", 4)
    landing, sink, progress = (str(tmp_path / n) for n in ("landing", "sink", "progress"))
    names = spark.createDataFrame([("x",)], "name string").limit(0)
    at = F.lit("2024-01-01 00:00:00").cast("timestamp").alias("arrived")
    df = spark.range(50).select(F.concat(F.lit("s"), "id").alias("series_id"), F.lit("1_0_0").alias("tracker"), F.concat(F.lit("in/"), "id").alias("image_path"), F.lit("v1").alias("version"), at)
    df.write.parquet(landing)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        query = stream_tracked(spark.readStream.schema(df.schema).parquet(landing), names, names.withColumnRenamed("name", "path"), sink, progress)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    state = query.lastProgress["stateOperators"][0]
    assert state["numRowsTotal"] <= 4 and state["numShufflePartitions"] <= 2 * spark.sparkContext.defaultParallelism
    assert spark.read.parquet(sink).select("series_id").distinct().count() == 50


def test_a_batch_with_state_is_computed_once(spark, tmp_path, monkeypatch):
    """Rows of a micro-batch reach the plan as a stored table, which is gone afterwards."""
    from voxelcohort.streaming import intake

    landing, sink, progress = (str(tmp_path / n) for n in ("landing", "sink", "progress"))
    schema = "series_id string, tracker string, image_path string, version string, arrived timestamp"
    names = spark.createDataFrame([("x",)], "name string").limit(0)
    rows = [("a", None, "in/a.nii.gz", "v1"), ("a", "1_0_0", "in/a.nii.gz", "v1"), (None, "1_0_0", "in/b.nii.gz", None)]
    spark.createDataFrame([(*r, datetime.fromisoformat("2024-01-01 00:00:00")) for r in rows], schema).write.parquet(landing)
    seen, planned = [], intake._planned
    monkeypatch.setattr(intake, "_planned", lambda batch, *more: (seen.append(batch.inputFiles()), planned(batch, *more))[1])
    stream_tracked(spark.readStream.schema(schema).parquet(landing), names, names.withColumnRenamed("name", "path"), sink, progress).awaitTermination()
    assert seen and all(files and "/stage-" in files[0] for files in seen)
    assert not [f for files in seen for f in files if os.path.exists(f.removeprefix("file:").replace("//", "/"))]
    # missing trackers come after the others
    assert sorted((r["series_id"] or "", r["tracker"], r["cause"]) for r in spark.read.parquet(sink).collect()) == [("", "1_0_0", "new"), ("a", "1_0_0", "new")]


def test_a_scope_removes_its_tables_and_a_loop_its_rounds(spark):
    import os

    path = scratch_path(spark, "result")
    with scratch_scope(spark):
        first = cut_lineage(spark.range(3))
        second = cut_lineage(first.withColumn("x", F.lit(1)), instead_of=first)
        assert not os.path.exists(first._stored_at) and os.path.exists(second._stored_at)
        second.write.parquet(path)
    assert not os.path.exists(second._stored_at) and spark.read.parquet(path).count() == 3
