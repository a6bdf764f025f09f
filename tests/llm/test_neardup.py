from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelcohort.llm import neardup

from brute import union_find

SCHEMA = "vec_id long, embedding array<float>"


def brute(x, least=0.95):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    links = [(a, b) for a, b in combinations(range(len(x)), 2) if u[a] @ u[b] >= least]
    part = union_find(range(len(x)), links)
    count = np.zeros(len(x), int)
    for a, b in links:
        count[[a, b]] += 1
    return [(i, int(count[i]), part[i], part[i] == i) for i in range(len(x))]


def found(spark, rows, **how):
    return sorted(map(tuple, neardup.near_vectors(spark.createDataFrame(rows, SCHEMA), **how).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(neardup, "TILE", 7)
    monkeypatch.setattr(neardup, "BLOCK", 100)
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(120, 24))
    near = base[rng.integers(0, 12, 200)] + 0.12 * rng.normal(size=(200, 24))
    x = np.concatenate([base, near, base[:20], base[:5]]).astype(np.float32)
    x = x[rng.permutation(len(x))]
    assert found(spark, [(i, v.tolist()) for i, v in enumerate(x)]) == sorted(brute(x), key=str)


def test_one_hot_vector(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", 4)
    rows = [(i, [1.0, 2.0]) for i in range(3, 60)] + [(1, [1.0, 2.01]), (2, [-2.0, 1.0])]
    got = {r[0]: r[1:] for r in found(spark, rows)}
    assert got[3] == (57, 1, False) and got[1] == (57, 1, True) and got[2] == (0, 2, True)


def test_bad_vectors_lengths_and_repeated_ids(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [1.0, 1.0]), (8, [1.0, 1.0, 1.0]), (9, [2.0, 2.0]), (9, [2.0, 2.0])]
    want = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 8)] + [(None, 0, None, False), (7, 2, 7, True), (9, 2, 7, False), (9, 2, 7, False)]
    assert found(spark, rows) == sorted(want, key=str)
    assert found(spark, []) == []
    clash = spark.createDataFrame([(1, [1.0, 0.0])], SCHEMA).withColumn("copies", F.lit(3)).withColumn("dim", F.lit("d")).withColumn("id", F.lit(9))
    assert [tuple(r) for r in neardup.near_vectors(clash).collect()] == [(1, 0, 1, True)]


def test_one_id_with_several_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (2, [1.0, 0.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 1.0, 0.0])]
    got = found(spark, rows)
    assert sorted((r[0], r[1]) for r in got) == [(1, 1), (2, 0), (2, 0), (2, 1), (3, 0)] and {r[2] for r in got if r[0] in (1, 2)} == {1}


def test_scales_and_limits_of_doubles(spark):
    df = spark.createDataFrame([(1, [1e-200, 2e-200]), (2, [1.0, 0.001]), (3, [1e200, 2e200]), (4, [3.0, 6.0]), (5, [1e300, 0.0])], "vec_id long, embedding array<double>")
    got = {r[0]: (r[1], r[2]) for r in neardup.near_vectors(df).collect()}
    assert got == {1: (2, 1), 3: (2, 1), 4: (2, 1), 2: (1, 2), 5: (1, 2)}


def counts(x, least=0.95):
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float64)
    out = np.zeros(len(u), int)
    for lo in range(0, len(u), 1000):
        out[lo : lo + 1000] = (u[lo : lo + 1000] @ u.T >= least).sum(1)
    return out - 1


def test_recall_on_the_supplied_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    want = counts(np.array([r["embedding"] for r in rows], np.float64))
    got = {r["vec_id"]: r["n_links"] for r in neardup.op7_near_vectors(spark, sf).collect()}
    have = np.array([got[r["vec_id"]] for r in rows])
    assert have.sum() >= 0.98 * want.sum() and (have <= want).all()


def cone_and_twins(rng, n_cone, n_twins, n_rest, cosine=0.9):
    """Rows at a cosine of each other, pairs at 0.955 among them, and rows around them in all directions."""
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    axis = unit(rng.normal(size=64))
    cone = unit(np.sqrt(cosine) * axis + np.sqrt(1 - cosine) * unit(rng.normal(size=(n_cone, 64))))
    twins = unit(cone[:n_twins] + np.tan(np.arccos(0.955)) * unit(rng.normal(size=(n_twins, 64))))
    x = np.concatenate([cone, twins, unit(rng.normal(size=(n_rest, 64)))])
    return x[rng.permutation(len(x))].astype(np.float32)


@pytest.mark.parametrize("size, crowded_reach", [(1400, neardup.CROWDED_REACH), (4000, 512)])
def test_dense_cone(spark, monkeypatch, size, crowded_reach):
    """A third of the rows at cosine 0.9 of each other, near pairs at 0.955 among them; also with cells far above the reach."""
    monkeypatch.setattr(neardup, "BLOCK", 1024)
    x = cone_and_twins(np.random.default_rng(5), size, size // 10, 2 * size)
    want = counts(x)
    assert want.sum() >= size // 5
    got = {r[0]: r[1] for r in found(spark, [(i, v.tolist()) for i, v in enumerate(x)], crowded_reach=crowded_reach)}
    have = np.array([got[i] for i in range(len(x))])
    assert (have <= want).all() and have.sum() >= 0.9 * want.sum()


def test_passes_grow_with_the_logarithm():
    turns = [neardup.plan_passes(n, 64, 0.95, 0.002)[1] for n in (10, 10**4, 10**6, 10**8)]
    assert turns[0] == 1 and turns == sorted(turns) and turns[-1] < 100


def test_windows_reach_over_blocks(spark, monkeypatch):
    """With a reach of several blocks every pair is compared in one pass."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(90, 3)).astype(np.float32)
    assert found(spark, [(i, v.tolist()) for i, v in enumerate(x)], reach=90) == sorted(brute(x), key=str)
