"""Intensity operators against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelcohort.operators import voxels as V
from voxelcohort.operators import windows as W

EDGE = 3


def chunked(spark, arrays, edge=EDGE):
    """Chunk rows of id -> array, cut into blocks of ``edge``."""
    rows = []
    for v, arr in arrays.items():
        for i in range(0, arr.shape[0], edge):
            for j in range(0, arr.shape[1], edge):
                for k in range(0, arr.shape[2], edge):
                    part = arr[i : i + edge, j : j + edge, k : k + edge]
                    rows.append((v, list(arr.shape), [0.5, 0.5, 3.0], "mm", i // edge, j // edge, k // edge, [i, j, k], list(part.shape), [float(x) for x in part.ravel()]))
    return spark.createDataFrame(rows, "volume_id long, shape array<int>, spacing array<double>, unit string, bi int, bj int, bk int, origin array<int>, dims array<int>, data array<float>")


def dense(df, shape, volume=0):
    out = np.full(shape, np.nan)
    for r in df.filter(F.col("volume_id") == volume).collect():
        out[r["i"], r["j"], r["k"]] = r["value"]
    return out


@pytest.fixture(scope="module")
def arrays():
    rng = np.random.default_rng(0)
    return {0: rng.normal(size=(5, 4, 7)).astype("f4"), 1: rng.integers(0, 9, size=(3, 3, 4)).astype("f4"), 2: np.full((4, 4, 4), 2.5, "f4")}


def test_explode_round_trip(spark, arrays):
    vox = V.explode_voxels(chunked(spark, arrays))
    for v, arr in arrays.items():
        np.testing.assert_array_equal(dense(vox, arr.shape, v), arr)


def numpy_entropy(x, bins, integer=False):
    x = x[~np.isnan(x)]
    if not x.size or np.isclose(x.max(), x.min()):
        return 0.0
    if integer and x.max() - x.min() + 1 <= bins:
        c, _ = np.histogram(x, bins=int(x.max() - x.min() + 1), range=(x.min() - 0.5, x.max() + 0.5))
    else:
        c, _ = np.histogram(x, bins=bins, range=(x.min(), x.max()))
    p = c[c > 0] / c.sum()
    return float(-(p * np.log2(p)).sum())


@pytest.mark.parametrize("integer", [False, True])
def test_entropy(spark, arrays, integer):
    holes = {**arrays, 3: np.where(arrays[0] > 1, np.nan, arrays[0]), 4: np.full((2, 2, 2), np.nan, "f4")}
    if integer:
        holes = {1: arrays[1], 2: arrays[2]}
    got = {r["volume_id"]: r["entropy"] for r in V.entropy(chunked(spark, holes), 16, integer).collect()}
    assert got.keys() == holes.keys()
    for v, arr in holes.items():
        assert got[v] == pytest.approx(numpy_entropy(arr.astype("f8"), 16, integer), abs=1e-9)


@pytest.mark.parametrize("knots", [2, 7, None])
def test_percentiles_of_many_chunks(spark, knots):
    """Ties, infinities, missing values, chunks of one value, and a volume without any."""
    rng = np.random.default_rng(knots or 1)
    arrays = {0: rng.normal(size=(9, 8, 7)), 1: rng.integers(0, 4, (6, 6, 6)).astype(float), 2: np.full((3, 3, 3), np.nan), 3: np.array([[[5.0]]]), 4: rng.normal(size=(4, 4, 4))}
    arrays[0][rng.random(arrays[0].shape) < 0.2] = np.nan
    arrays[4][0, 0, :2] = np.inf, -np.inf
    ps = [0, 1, 33.3, 50, 99, 100]
    got = {r["volume_id"]: r["q"] for r in V.percentiles(chunked(spark, arrays), ps, knots).collect()}
    assert set(got) == {0, 1, 3, 4}
    for v, q in got.items():
        x = np.sort(arrays[v][~np.isnan(arrays[v])])
        for p, have in zip(ps, q):
            at = (len(x) - 1) * p / 100
            low, high = x[int(np.floor(at))], x[int(np.ceil(at))]
            assert have == pytest.approx(low if low == high else low + (high - low) * (at - np.floor(at)), nan_ok=True)


def test_percentiles_hold_few_rows_at_once(spark, arrays, monkeypatch):
    """A chunk gives one row a percentile: they leave in batches of bounded size, and come in tables of whole groups."""
    ps = [100 * n / 255 for n in range(256)]
    c = chunked(spark, arrays).coalesce(1)
    want = {r["volume_id"]: r["q"] for r in V.percentiles(c, ps).collect()}
    monkeypatch.setattr(V, "SELECTED_ROWS", 1)
    assert {r["volume_id"]: r["q"] for r in V.percentiles(c, ps).collect()} == want
    keys = [0] * 5 + [1] * 2 + [2] * 9 + [3]
    batches = [V.pa.RecordBatch.from_pydict({"k": keys[a : a + 3], "n": list(range(a, min(a + 3, len(keys))))}) for a in range(0, len(keys), 3)]
    tables = [t.to_pydict() for t in V.whole_groups(batches, ["k"])]
    assert sum((t["n"] for t in tables), []) == list(range(len(keys)))
    assert all(not set(a["k"]) & set(b["k"]) for n, a in enumerate(tables) for b in tables[:n]) and len(tables) < 5


def test_percentiles_never_explode_values(spark, arrays):
    for df in (V.percentiles(chunked(spark, arrays), [1, 99]), V.standardise(chunked(spark, arrays))):
        assert "explode" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_standardise(spark, arrays):
    out = V.explode_voxels(V.standardise(chunked(spark, arrays), 5, 90, 10, 20))
    a = arrays[0].astype("f8")
    lo, hi = np.percentile(a, [5, 90])
    np.testing.assert_allclose(dense(out, a.shape), (np.clip(a, lo, hi) - lo) / (hi - lo) * 10 + 10)
    np.testing.assert_array_equal(dense(out, (4, 4, 4), 2), arrays[2])


def test_histogram_match(spark, arrays):
    src, ref = {0: arrays[0]}, {9: (arrays[0] * 3 + 1).astype("f4")}
    pairs = spark.createDataFrame([(0, 9)], "volume_id long, reference_id long")
    inside = arrays[0] > 0
    pts = np.argwhere(inside)
    mask = spark.createDataFrame([(v, *map(int, p)) for v in (0, 9) for p in pts], "volume_id long, i int, j int, k int")
    levels = np.linspace(0, 100, 16)
    for m, sel in ((None, np.ones_like(inside)), (mask, inside), (mask.filter("volume_id > 99"), np.ones_like(inside))):
        got = dense(V.explode_voxels(V.histogram_match(chunked(spark, src), chunked(spark, ref), pairs, m, points=16, edge=(EDGE,) * 3)), inside.shape)
        want = np.interp(src[0].astype("f8"), np.percentile(src[0].astype("f8")[sel], levels), np.percentile(ref[9].astype("f8")[sel], levels))
        np.testing.assert_allclose(got, want, rtol=1e-9)


@pytest.mark.parametrize("spacing, want", [
    ([0.5, 0.5, 0.5], [0.5, 0.5, 0.5]), ([0.0, 0.5, 0.7], [0.6, 0.5, 0.7]), ([float("nan"), float("inf"), -1.0], [1.0, 1.0, 1.0]),
    ([None, 1.0, 101.0], [1.0, 1.0, 1.0]), ([0.4, 0.4], [0.4, 0.4])])
def test_repair_spacing(spark, spacing, want):
    df = spark.createDataFrame([(0, [2, 2, 2], spacing)], "volume_id long, shape array<int>, spacing array<double>")
    got = V.repair_spacing(df).first()["spacing"]
    assert got == pytest.approx(want)
    assert V.valid_header(df).first()["valid"] == (spacing in ([0.5, 0.5, 0.5], [0.4, 0.4]))


def test_units(spark):
    df = spark.createDataFrame([("mm",), (" UM ",), ("inch",), (None,), ("",)], "u string")
    assert [r[0] for r in df.select(V.cubic_unit("u")).collect()] == ["mm³", "um³", "inch³", None, None]


def test_sanitise(spark):
    c = chunked(spark, {0: np.array([[[np.nan, np.inf, -np.inf, 1.5]]], "f4")}, 4)
    assert V.sanitise(c).first()["data"] == [0.0, V.FLOAT32_MAX, -V.FLOAT32_MAX, 1.5]


def test_apply_mask_across_chunks(spark, arrays):
    keep = arrays[0] > 0.3
    mask = spark.createDataFrame([(0, *map(int, p)) for p in np.argwhere(keep)], "volume_id long, i int, j int, k int")
    got = dense(V.explode_voxels(V.apply_mask(chunked(spark, {0: arrays[0]}), mask, (EDGE,) * 3)), keep.shape)
    np.testing.assert_array_equal(got, np.where(keep, arrays[0], 0))


def test_normalise_nonzero(spark, arrays):
    holes = {0: np.where(arrays[0] > 0, arrays[0], 0), 1: np.zeros((2, 2, 2), "f4"), 2: arrays[2]}
    out = V.explode_voxels(V.normalise_nonzero(chunked(spark, holes)))
    x = holes[0].astype("f8")
    want = np.where(x != 0, (x - x[x != 0].mean()) / x[x != 0].std(), 0)
    np.testing.assert_allclose(dense(out, x.shape), want, atol=1e-9)
    assert not dense(out, (2, 2, 2), 1).any() and not dense(out, (4, 4, 4), 2).any()


def test_mutual_information_is_symmetric_and_bounded(spark, arrays):
    c = chunked(spark, {0: arrays[0], 5: (arrays[0] ** 2).astype("f4")})
    pairs = spark.createDataFrame([(0, 5), (5, 0), (0, 0)], "a_id long, b_id long")
    got = {(r["a_id"], r["b_id"]): r["mi"] for r in V.mutual_information(c, c, pairs, 8).collect()}
    assert got[0, 5] == pytest.approx(got[5, 0]) and 0 < got[0, 5] < got[0, 0]


def test_mutual_information_leaves_missing_voxels_out(spark, arrays):
    x, y = arrays[0].copy(), (arrays[0] ** 2).astype("f4")
    x[0, 0, :3], y[1, 1, 1] = np.nan, np.nan
    pairs = spark.createDataFrame([(0, 5)], "a_id long, b_id long")
    got = V.mutual_information(chunked(spark, {0: x}), chunked(spark, {5: y}), pairs, 4).first()["mi"]
    spot = lambda a: np.minimum(((a - np.nanmin(a)) / (np.nanmax(a) - np.nanmin(a)) * 4), 3).astype(float) // 1
    ok = ~np.isnan(x) & ~np.isnan(y)
    joint = np.histogram2d(spot(x)[ok], spot(y)[ok], bins=[range(5), range(5)])[0] / ok.sum()
    want = sum(p * np.log(p / (joint[i].sum() * joint[:, j].sum())) for (i, j), p in np.ndenumerate(joint) if p)
    assert got == pytest.approx(want)
    with pytest.raises(Exception, match="different grids"):
        V.mutual_information(chunked(spark, {0: x}), chunked(spark, {5: y}, 4), pairs, 4).collect()


def test_mutual_information_leaves_missing_chunks_out(spark, arrays):
    x, y = arrays[0], (arrays[0] ** 2).astype("f4")
    pairs = spark.createDataFrame([(0, 5), (5, 0)], "a_id long, b_id long")
    less = chunked(spark, {5: y}).filter("bk < 2")
    gone = np.where(np.arange(y.shape[2]) < 2 * EDGE, y, np.nan).astype("f4")
    both = [chunked(spark, {0: x}).unionByName(c) for c in (less, chunked(spark, {5: gone}))]
    got, want = ({(r["a_id"], r["b_id"]): r["mi"] for r in V.mutual_information(c, c, pairs, 4).collect()} for c in both)
    assert got == pytest.approx(want) and len(got) == 2
    # blocks of one size on volumes of different shapes do not belong to one grid
    with pytest.raises(Exception, match="different grids"):
        V.mutual_information(chunked(spark, {0: x}), chunked(spark, {5: y[:EDGE]}), spark.createDataFrame([(0, 5)], "a_id long, b_id long"), 4).collect()


def test_coverage(masks_of, volumes_of):
    got = {r["volume_id"]: (r["coverage_pct"], r["use_all"]) for r in V.coverage_guard(masks_of({0: [(0, 0, 0)]}), volumes_of({0: (2, 2, 2), 1: (2, 2, 2)}), 12.5).collect()}
    assert got == {0: (12.5, False), 1: (0.0, True)}
    with pytest.raises(Exception, match="without voxels"):
        V.coverage_guard(masks_of({0: [(0, 0, 0)]}), volumes_of({3: (0, 2, 2)})).collect()


def test_reorient_round_trip(spark, arrays):
    turned = W.reorient(chunked(spark, {0: arrays[0]}), "RAS", "SPL")
    np.testing.assert_array_equal(dense(V.explode_voxels(turned), (7, 4, 5)), arrays[0].transpose(2, 1, 0)[:, ::-1, ::-1])
    back = W.reorient(turned.withColumn("shape", F.array(*[F.lit(n) for n in (7, 4, 5)])), "SPL", "RAS")
    np.testing.assert_array_equal(dense(V.explode_voxels(back), arrays[0].shape), arrays[0])


def test_stride_and_range_on_chunks(spark, arrays):
    c = chunked(spark, arrays)
    got = {v: {(r["i"], r["j"], r["k"]): r["value"] for r in W.stride_sample(c, 30).filter(F.col("volume_id") == v).collect()} for v in arrays}
    for v, arr in arrays.items():
        step = -(-arr.size // 30)
        assert got[v] == {tuple(map(int, p)): float(arr[tuple(p)]) for n, p in enumerate(np.argwhere(arr == arr)) if n % step == 0}
    cut = V.explode_voxels(V.crop_range(c, "k", 2, 6))
    np.testing.assert_array_equal(dense(cut, (5, 4, 4)), arrays[0][:, :, 2:6])


def test_otsu_splits_two_modes(spark):
    rng = np.random.default_rng(2)
    arr = np.concatenate([rng.normal(0, 0.1, (4, 4, 4)), rng.normal(5, 0.1, (2, 4, 4))]).astype("f4")
    assert arr[:4].max() <= V.otsu_threshold(chunked(spark, {0: arr}), 64).first()["threshold"] <= arr[4:].min()
    assert V.otsu_mask(chunked(spark, {0: arr}), 64).count() == 32


def test_composite_touches_only_alpha_voxels(spark, arrays):
    base = {0: arrays[0]}
    alpha = spark.createDataFrame([(0, 0, 0, 0, 1.0), (0, 4, 3, 6, 0.25), (0, 2, 2, 2, 0.5)], "volume_id long, i int, j int, k int, alpha double")
    over = spark.createDataFrame([(0, 0, 0, 0, 1.0), (0, 4, 3, 6, 0.5), (0, 1, 1, 1, 0.9)], "volume_id long, i int, j int, k int, value double")
    low = spark.createDataFrame([(0, -1.0, 3.0)], "volume_id long, p1 double, p99 double")
    got = dense(V.explode_voxels(V.composite(chunked(spark, base), over, alpha, low, (EDGE,) * 3)), arrays[0].shape)
    want = arrays[0].astype("f8")
    want[0, 0, 0] = 3.0
    want[4, 3, 6] = 0.75 * want[4, 3, 6] + 0.25 * 1.0
    want[2, 2, 2] = 0.5 * want[2, 2, 2] + 0.5 * -1.0
    np.testing.assert_allclose(got, want)
