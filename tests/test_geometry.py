"""Mask geometry, resampling and placement against numpy brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelcohort.operators import geometry as G
from voxelcohort.operators import resample as RS
from voxelcohort.operators import windows as W

CORNER = [(0, 0, 0), (1, 1, 1), (2, 2, 2)]
HOPS = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]


def points(df, volume=0):
    return {(r["i"], r["j"], r["k"]) for r in df.filter(F.col("volume_id") == volume).collect()}


def flood(pts):
    left, out = set(pts), []
    while left:
        todo, seen = [min(left)], set()
        while todo:
            p = todo.pop()
            if p in left:
                left.remove(p)
                seen.add(p)
                todo += [tuple(a + b for a, b in zip(p, h)) for h in HOPS]
        out.append(frozenset(seen))
    return set(out)


def chunk_rows(spark, arrays, edge=3):
    """Chunk rows of id -> array, cut into blocks of ``edge``."""
    rows = []
    for v, arr in arrays.items():
        for at in itertools.product(*[range(0, n, edge) for n in arr.shape]):
            part = arr[tuple(slice(a, a + edge) for a in at)]
            rows.append((v, list(arr.shape), list(at), list(part.shape), [float(x) for x in part.ravel()]))
    return spark.createDataFrame(rows, "volume_id long, shape array<int>, origin array<int>, dims array<int>, data array<double>")


def snake(n):
    """A winding path: the worst case for label spreading."""
    out = []
    for i in range(0, n, 2):
        out += [(i, 0, k) for k in range(n)]
        out.append((i + 1, 0, n - 1 if (i // 2) % 2 == 0 else 0))
    return out


def test_components(masks_of):
    rng = np.random.default_rng(4)
    noise = [tuple(map(int, p)) for p in np.argwhere(rng.random((8, 8, 8)) < 0.32)]
    stairs = [((n + 1) // 2, n // 2, 0) for n in range(150)]  # 150 runs in a row, each the next one's smallest neighbour
    zigzag = [(n, 40 * (n % 2) + j, 3) for n in range(40) for j in range(1)] + [(n, j, 3) for n in range(1, 40, 2) for j in range(1, 40)]
    cases = {0: CORNER, 1: noise, 2: snake(12), 3: [(0, 0, 0), (0, 0, 1), (4, 4, 4), (4, 4, 5)], 4: stairs, 5: sorted(set(zigzag))}
    rows = G.components(masks_of(cases)).collect()
    for v, pts in cases.items():
        groups = {}
        for r in rows:
            if r["volume_id"] == v:
                groups.setdefault(r["component"], set()).add((r["i"], r["j"], r["k"]))
        assert {frozenset(g) for g in groups.values()} == flood(pts)
        assert all(c == ",".join(map(str, min(g))) for c, g in groups.items())


def test_components_at_any_coordinate(masks_of):
    far = 1 << 21
    pts = [(0, 0, 0), (0, 0, far), (0, 1, 0), (far, 0, 0), (far, 0, 1), (-3, -2, -1), (-3, -2, 0), (-2, -2, 0), (1 << 30, 5, 5)]
    rows = G.components(masks_of({0: pts})).collect()
    assert sorted((r["i"], r["j"], r["k"]) for r in rows) == sorted(pts)
    assert {r["component"] for r in rows} == {"0,0,0", f"0,0,{far}", f"{far},0,0", "-3,-2,-1", f"{1 << 30},5,5"}


@pytest.mark.parametrize("edge", [1, 3, 64])
def test_components_over_many_blocks(spark, masks_of, edge):
    rng = np.random.default_rng(edge)
    pts = {tuple(p) for p in np.argwhere(rng.random((11, 9, 10)) < 0.35) - [4, 0, 20]}
    winding = set(snake(9))
    df = G.components(masks_of({0: sorted(pts), 1: sorted(winding)}).unionByName(masks_of({0: sorted(pts)[:20]})), edge)
    for volume, own in ((0, pts), (1, winding)):
        found = {}
        for r in df.filter(F.col("volume_id") == volume).collect():
            found.setdefault(r["component"], []).append((r["i"], r["j"], r["k"]))
        assert {frozenset(v) for v in found.values()} == flood(own)
        assert all(name == ",".join(map(str, min(v))) for name, v in found.items())


def test_only_faces_travel_between_blocks(spark):
    """Three chunks of 64^3 in a row, full of foreground, are one component after one round."""
    i, j, k = np.meshgrid(np.arange(3 * 64), np.arange(8), np.arange(8), indexing="ij")
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame({"volume_id": 0, "i": i.ravel(), "j": j.ravel(), "k": k.ravel()}).astype({"i": "int32", "j": "int32", "k": "int32"}))
    got = G.components(df)
    assert got.count() == i.size and [r[0] for r in got.select("component").distinct().collect()] == ["0,0,0"]


def test_largest_component_takes_the_first_of_equals(masks_of):
    got = G.largest_component(masks_of({0: [(4, 4, 4), (4, 4, 5), (0, 0, 0), (0, 0, 1), (9, 9, 9)]}))
    assert points(got) == {(0, 0, 0), (0, 0, 1)}


def test_empty_masks_stay_empty(masks_of):
    assert G.components(masks_of({0: [(0, 0, 0)]}).limit(0)).count() == 0


def test_principal_axes_of_a_rod(masks_of, volumes_of):
    rod = [(n, n, 0) for n in range(9)]
    tilted = [(n, 0, n) for n in range(9)]
    axes = {r["volume_id"]: r for r in G.principal_axes(G.inertia(masks_of({0: rod, 1: tilted}), volumes_of({0: (9, 9, 9), 1: (9, 9, 9)}))).collect()}
    np.testing.assert_allclose(axes[0]["axis_vox"], np.array([1, 1, 0]) / 2**0.5, atol=1e-9)
    np.testing.assert_allclose(axes[1]["axis_mm"], np.array([0.5, 0, 3]) / np.hypot(0.5, 3), atol=1e-9)


def test_principal_axes_equal_an_eigen_solver(spark):
    rng = np.random.default_rng(13)
    flats = [np.diag(d) for d in ([1.0, 2.0, 3.0], [3.0, 1.0, 2.0], [1.0, 1.0, 1.0], [1.0, 1.0, 4.0], [0.0, 0.0, 0.0], [2.0, 5.0, 2.0])]
    tensors = flats + [(lambda m: m @ m.T)(rng.normal(size=(3, 3))) for _ in range(40)]
    df = spark.createDataFrame([(n, [float(x) for x in t.ravel()], [float(x) for x in t.ravel()]) for n, t in enumerate(tensors)], "volume_id int, tensor_vox array<double>, tensor_mm array<double>")
    for r in G.principal_axes(df).collect():
        t, v = tensors[r["volume_id"]], np.array(r["axis_vox"])
        low = np.linalg.eigvalsh(t)[0]
        assert np.linalg.norm(v) == pytest.approx(1) and v[np.abs(v).argmax()] > 0 and r["axis_mm"] == r["axis_vox"]
        np.testing.assert_allclose(t @ v, low * v, atol=1e-7 * max(1, np.abs(t).max()))


def test_inertia_matches_numpy(masks_of, volumes_of):
    rng = np.random.default_rng(5)
    pts = np.argwhere(rng.random((6, 5, 4)) < 0.4)
    row = G.inertia(masks_of({0: [tuple(p) for p in pts]}), volumes_of({0: (6, 5, 4)})).first()
    for name, scale in (("tensor_vox", np.ones(3)), ("tensor_mm", np.array([0.5, 0.5, 3.0]))):
        cov = np.cov((pts * scale).T, bias=True)
        np.testing.assert_allclose(np.reshape(row[name], (3, 3)), np.trace(cov) * np.eye(3) - cov, atol=1e-9)


def test_axis_helpers(spark):
    v = lambda *xs: F.array(*[F.lit(float(x)) for x in xs])
    row = spark.range(1).select(G.angle_deg(v(1, 0, 0), v(-1, 0, 0)), G.angle_deg(v(1, 0, 0), v(1, 1, 0)), G.axis_to_mm(v(0, 0, 0), v(1, 1, 1)), G.axis_to_mm(v(1, 0, 1), v(3, 1, 4))).first()
    assert row[0] == pytest.approx(0) and row[1] == pytest.approx(45) and row[2] is None and row[3] == pytest.approx([0.6, 0, 0.8])


def test_slices_without_foreground_take_the_middle(masks_of, volumes_of):
    got = G.max_area_slices(masks_of({0: [(1, 1, 1), (1, 2, 1), (3, 2, 1)]}), volumes_of({0: (5, 5, 5), 1: (5, 6, 9)}))
    assert {(r["volume_id"], r["axis"], r["slice"], r["area"]) for r in got.collect()} == {
        (0, "i", 1, 2), (0, "j", 2, 2), (0, "k", 1, 3), (1, "i", 2, 0), (1, "j", 3, 0), (1, "k", 4, 0)}


def test_dilate_and_inner_distance(masks_of, volumes_of):
    rng = np.random.default_rng(6)
    shape, spacing = (7, 6, 5), (0.5, 0.7, 1.0)
    keep = rng.random(shape) < 0.75
    pts, holes = np.argwhere(keep), np.argwhere(~keep)
    masks, head = masks_of({0: [tuple(p) for p in pts]}), volumes_of({0: shape}, spacing)
    seed = masks_of({0: [(3, 3, 2), (0, 0, 0)]})
    grown = {p for p in itertools.product(*map(range, shape)) if min(sum((a - b) ** 2 for a, b in zip(p, q)) for q in [(3, 3, 2), (0, 0, 0)]) <= 4}
    assert points(G.dilate(seed, head, 0.8)) == grown
    cap = 1.3
    got = {(r["i"], r["j"], r["k"]): r["dist_mm"] for r in G.inner_distance(masks, head, cap).collect()}
    for p in pts:
        want = min(cap, np.sqrt((((holes - p) * spacing) ** 2).sum(1)).min())
        assert got[tuple(p)] == pytest.approx(want)
    hard = G.feather_alpha(G.inner_distance(masks, head, cap), 0.0)
    assert {r["alpha"] for r in hard.collect()} == {1.0}


def test_windows_and_blend(spark, volumes_of):
    head = volumes_of({0: (5, 4, 9)})
    starts = {a: sorted({r[f"w{a}"] for r in G.patch_windows(head, (3, 4, 4), 0.5).collect()}) for a in "ijk"}
    assert starts == {"i": [0, 1, 2], "j": [0], "k": [0, 2, 4, 5]}
    for a, n, r in zip("ijk", (5, 4, 9), (3, 4, 4)):
        assert W.window_starts(n, r, 0.5) == starts[a]


def test_whole_windows_are_predicted_and_blended(spark):
    rng = np.random.default_rng(12)
    arr, small = rng.normal(size=(5, 4, 9)), rng.normal(size=(2, 3, 4))
    c, roi = chunk_rows(spark, {0: arr, 1: small}), (3, 4, 4)
    windows = W.assign_patches(c, roi, 0.5)
    for r in windows.collect():
        full = arr if r["volume_id"] == 0 else small
        want = full[r["wi"] : r["wi"] + 3, r["wj"] : r["wj"] + 4, r["wk"] : r["wk"] + 4]
        np.testing.assert_array_equal(np.reshape(r["data"], r["dims"]), want)
    centred = W.predict_patches(windows, lambda x: x - x.mean((1, 2, 3), keepdims=True))
    for weights, importance in ((np.ones, None), (W.gaussian_importance, W.gaussian_importance)):
        top, low = np.zeros(arr.shape), np.zeros(arr.shape)
        for i, k in itertools.product((0, 1, 2), (0, 2, 4, 5)):
            at = (slice(i, i + 3), slice(0, 4), slice(k, k + 4))
            top[at] += weights(roi) * (arr[at] - arr[at].mean())
            low[at] += weights(roi)
        got = np.full(arr.shape, np.nan)
        for r in W.blend_patches(centred, 2, importance).filter("volume_id = 0").collect():
            got[tuple(slice(o, o + d) for o, d in zip(r["origin"], r["dims"]))] = np.reshape(r["data"], r["dims"])
        np.testing.assert_allclose(got, top / low)
    with pytest.raises(Exception, match="the predictor returned"):
        W.predict_patches(windows, lambda x: x[:, :1]).collect()


def test_importance_is_highest_in_the_middle():
    w = W.gaussian_importance((3, 4, 9))
    assert w.argmax() == np.ravel_multi_index((1, 1, 4), w.shape) and w.min() >= 1e-3 * w.max() and np.allclose(w, w[::-1, ::-1, ::-1])


@pytest.mark.parametrize("target", [(5, 4, 3), (9, 8, 3), (2, 3, 1), (5, 1, 7)])
def test_trilinear(spark, volumes_of, target):
    rng = np.random.default_rng(8)
    arr = rng.normal(size=(5, 4, 3))
    vox = spark.createDataFrame([(0, *map(int, p), float(arr[tuple(p)])) for p in np.argwhere(arr == arr)], "volume_id long, i int, j int, k int, value double")
    want = arr
    for axis, size in enumerate(target):
        n = arr.shape[axis]
        at = np.maximum((np.arange(size) + 0.5) * n / size - 0.5, 0)
        i0 = np.minimum(np.floor(at).astype(int), n - 1)
        i1, w = np.minimum(i0 + 1, n - 1), at - i0
        shape = [1, 1, 1]
        shape[axis] = size
        w = w.reshape(shape)
        want = np.take(want, i0, axis) * (1 - w) + np.take(want, i1, axis) * w
    got = np.full(target, np.nan)
    for r in RS.resample_trilinear(vox, volumes_of({0: arr.shape}), target).collect():
        got[r["i"], r["j"], r["k"]] = r["value"]
    np.testing.assert_allclose(got, want, atol=1e-9)


def test_place_nearest(spark, masks_of):
    rng = np.random.default_rng(9)
    keep = rng.random((6, 5, 7)) < 0.3
    angle = 0.4
    m = np.array([[np.cos(angle), -np.sin(angle), 0], [np.sin(angle), np.cos(angle), 0], [0, 0, 0.7]])
    offset, shape = np.array([1.3, -0.9, 0.45]), (8, 9, 10)
    placed = spark.createDataFrame([(0, [float(x) for x in m.ravel()], [float(x) for x in offset], list(shape))], "volume_id long, m array<double>, offset array<double>, target_shape array<int>")
    want = set()
    for t in itertools.product(*map(range, shape)):
        s = np.floor(m @ t + offset + 0.5).astype(int)
        if (s >= 0).all() and (s < keep.shape).all() and keep[tuple(s)]:
            want.add(t)
    assert points(RS.place_nearest(masks_of({0: [tuple(p) for p in np.argwhere(keep)]}), placed)) == want


def test_padding_is_symmetric(spark, volumes_of):
    moved, head = G.pad_to(chunk_rows(spark, {0: np.ones((3, 5, 4))}, 9), volumes_of({0: (3, 5, 4)}), (6, 5, 9))
    assert moved.first()["origin"] == [1, 0, 2] and head.first()["shape"] == [6, 5, 9]


def test_crops_without_a_mask_take_the_middle(spark, volumes_of, masks_of):
    c, none = chunk_rows(spark, {0: np.arange(9.0).reshape(9, 1, 1)}), masks_of({5: [(0, 0, 0)]})
    values = lambda df: sorted(x for r in df.collect() for x in r["data"])
    assert values(G.crop_center(c, volumes_of({0: (9, 1, 1)}), none, (4, 1, 1))) == [2, 3, 4, 5]
    assert values(G.crop_center_k(c, volumes_of({0: (9, 1, 1)}), none, (4, 1, 1), 4)) == [0, 1, 2, 3]


def test_dense_plans_keep_arrays(spark, volumes_of, masks_of):
    c, head, mask = chunk_rows(spark, {0: np.ones((3, 5, 4))}), volumes_of({0: (3, 5, 4)}), masks_of({0: [(1, 1, 1)]})
    for df in (G.crop_foreground(c, mask), G.crop_center(c, head, mask, (2, 2, 2)), G.pad_to(c, head, (6, 6, 6))[0], W.reorient(c, "RAS", "LPS"), W.stride_sample(c, 10),
               W.blend_patches(W.predict_patches(W.assign_patches(c, (2, 2, 2), 0.5), lambda x: x))):
        assert "posexplode(data" not in df._jdf.queryExecution().optimizedPlan().toString()
