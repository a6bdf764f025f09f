import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelcohort.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k):
    """The k best of every query, ties to the smaller id."""
    good = [(i, np.asarray(v, np.float64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in good:
        if i % 20 == 0:
            out[i] = sorted(((-(v * w).sum(), j) for j, w in good if j != i and len(w) == len(v)))[:k]
    return out


def ask(spark, rows, k=20, **how):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    return sorted(map(tuple, ann.nearest(df, F.col("vec_id") % 20 == 0, k=k, **how).collect()))


@pytest.mark.parametrize("norms", [False, True])
def test_recall_and_exact_scores(spark, norms):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 16))
    x = (centres[rng.integers(0, 8, 900)] + 0.7 * rng.normal(size=(900, 16))).astype(np.float32)
    if not norms:
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    want = brute(rows, 20)
    got = ask(spark, rows)
    by = {}
    for q, rank, v, score in got:
        by.setdefault(q, []).append((rank, v, score))
        assert score == pytest.approx(float((x[q].astype(float) * x[v].astype(float)).sum()), abs=1e-12)
    assert set(by) == set(want)
    hits = [len({v for _, v, _ in by[q]} & {v for _, v in want[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.9
    for q, found in by.items():
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert found == sorted(found, key=lambda t: (-t[2], t[1]))


def test_recall_on_the_supplied_table(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows, 20)
    got = {}
    for r in ann.op4_nearest(spark, sf).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert np.mean([len(got[q] & {v for _, v in want[q]}) / 20 for q in want]) >= 0.9


def test_ties_copies_and_hot_buckets(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_VECTORS", 16)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 2)
    rows = [(i, [1.0, 0.0]) for i in range(100)] + [(200, [0.0, 1.0]), (201, [0.5, 0.5])]
    got = ask(spark, rows, k=3)
    assert [t[2] for t in got if t[0] == 0] == [1, 2, 3] and [t[2] for t in got if t[0] == 40] == [0, 1, 2]
    assert [(t[2], t[3]) for t in got if t[0] == 200] == [(201, 0.5), (0, 0.0), (1, 0.0)]


def test_few_rows_bad_vectors_and_lengths(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [-1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (20, [1.0, 2.0, 3.0]), (40, [3.0, 0.0]), (40, [0.0, 1.0])]
    got = ask(spark, rows)
    assert [(t[0], t[2], t[3]) for t in got if t[0] == 0] == [(0, 40, 3.0), (0, 1, -1.0)]
    assert [t for t in got if t[0] == 20] == []
    assert {t[2] for t in got if t[0] == 40} == {0, 1}
    assert ask(spark, []) == [] and ask(spark, [(2, None)]) == []


def test_probes_start_at_home_and_are_ordered():
    position = np.array([[0.1, 0.95, -3.5]])
    first = ann.probes(position, 4)[0]
    assert first[0] == ann._pack_slots(np.array([0, 0, -4])) and first[1] == ann._pack_slots(np.array([0, 1, -4])) and first[2] == ann._pack_slots(np.array([-1, 0, -4]))
    assert len(set(ann.probes(position, 125)[0])) == 125


def test_scales_of_doubles(spark):
    rows = [(0, [1.0, 0.0]), (1, [1e200, 1e200]), (2, [1.0, 0.001]), (3, [1e-200, 0.0]), (20, [1e200, 0.0]), (40, [3e-200, 1e-200])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cell", F.lit(1)).withColumn("asks", F.lit("a")).withColumn("dim", F.lit(3))
    got = {}
    for q, rank, v, score in sorted(map(tuple, ann.nearest(df, F.col("vec_id") % 20 == 0, k=5).collect())):
        got.setdefault(q, []).append(v)
    assert got == {0: [1, 20, 2, 40, 3], 20: [1, 0, 2, 40, 3], 40: [1, 20, 2, 0, 3]}


def test_merging_inside_a_task(spark, monkeypatch):
    q, v, s = np.array([1, 1, 1, 0, 1]), np.array([5, 4, 5, 9, 7]), np.array([0.5, 0.5, 0.4, 1.0, 0.1])
    assert [a.tolist() for a in ann._top(q, v, s, 2)] == [[0, 1, 1], [9, 4, 5], [1.0, 0.5, 0.5]]
    rng = np.random.default_rng(6)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.normal(size=(300, 6)))]
    want = ask(spark, rows, k=4)
    monkeypatch.setattr(ann, "HELD_ROWS", 8)
    assert ask(spark, rows, k=4) == want
