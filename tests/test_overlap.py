"""Overlap and surface metrics on masks with empty, equal, disjoint and far cases."""

import itertools
import statistics

import numpy as np
import pytest

from voxelcohort.operators import overlap as M
from voxelcohort.operators import distance as D
from voxelcohort.operators import surface as S

BOX = [(i, j, k) for i in range(3) for j in range(3) for k in range(3)]
MASKS = {1: BOX, 2: BOX, 3: [(i + 1, j, k) for i, j, k in BOX], 4: [(i + 40, j, k) for i, j, k in BOX], 7: [(2, 2, 2)]}
EMPTY = (5, 6)


@pytest.fixture
def series(spark):
    rows = [(v, "p", "T1" if v % 2 else "t2 thin", "p_0") for v in (1, 2, 3, 4, 5, 6)] + [(7, "q", "T1", "q_0")]
    return spark.createDataFrame(rows, "volume_id long, patient_id string, study_type string, tracker string")


def dice_of(a, b):
    a, b = set(MASKS.get(a, [])), set(MASKS.get(b, []))
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else None


def test_dice(spark, masks_of):
    pairs = list(itertools.product((1, 3, 4, 5, 6), repeat=2))
    df = spark.createDataFrame(pairs, "a_id long, b_id long")
    got = {(r["a_id"], r["b_id"]): r["dice"] for r in M.dice(df, masks_of(MASKS)).collect()}
    assert got == {p: dice_of(*p) for p in pairs}
    assert M.dice(df, masks_of(MASKS), empty=1.0).filter("a_id = 5 AND b_id = 6").first()["dice"] == 1.0


@pytest.mark.parametrize("tile", [1, 100])
def test_pairwise_lists_overlaps_and_counts_the_rest(series, masks_of, tile):
    masks = masks_of(MASKS)
    pairs = M.pairwise_dice(series, masks, rows_per_tile=tile)
    assert {(r["a_id"], r["b_id"]): r["dice"] for r in pairs.collect()} == {(1, 2): 1.0, (1, 3): dice_of(1, 3), (2, 3): dice_of(2, 3)}
    counts = {r["patient_id"]: (r["n_pairs"], r["n_overlapping"], r["n_zero"], r["n_unscored"]) for r in M.pair_counts(series, masks, pairs).collect()}
    assert counts == {"p": (15, 3, 11, 1), "q": (0, 0, 0, 0)}


def test_per_study_summary_equals_listing_every_pair(series, masks_of):
    masks = masks_of(MASKS)
    got = {r["volume_id"]: r for r in M.dice_per_study(series, masks, M.pairwise_dice(series, masks)).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6}
    for v in got:
        scores = [s for s in (dice_of(v, w) for w in range(1, 7) if w != v) if s is not None]
        r = got[v]
        assert r["n_comparisons"] == len(scores)
        assert r["mean_dice"] == pytest.approx(statistics.mean(scores)) and r["std_dice"] == pytest.approx(statistics.stdev(scores))
        assert (r["min_dice"], r["max_dice"]) == (min(scores), max(scores)) and r["median_dice"] == pytest.approx(statistics.median(scores))


def test_cross_type(series, masks_of):
    got = {(r["a_id"], r["b_id"]): r["dice"] for r in M.cross_type_dice(series, masks_of(MASKS), "T1", "T2").collect()}
    assert got == {(a, b): dice_of(a, b) for a in (1, 3, 5) for b in (2, 4, 6)}


def test_describe_counts_the_zeros(series, masks_of):
    masks = masks_of(MASKS)
    pairs = M.pairwise_dice(series, masks)
    row = M.describe(M.scored_dice(pairs, M.pair_counts(series, masks, pairs)), "dice", "w").first()
    scores = [s for a, b in itertools.combinations(range(1, 7), 2) if (s := dice_of(a, b)) is not None]
    assert row["count"] == len(scores) and row["mean"] == pytest.approx(statistics.mean(scores)) and row["std"] == pytest.approx(statistics.stdev(scores))
    assert (row["min"], row["p50"], row["max"]) == (0.0, statistics.median(scores), 1.0)


def test_volume_metrics(spark, masks_of):
    pairs = spark.createDataFrame([(3, 1), (7, 1), (1, 5), (5, 1)], "a_id long, b_id long")
    rvd = {(r["a_id"], r["b_id"]): r["rvd"] for r in M.rvd(pairs, masks_of(MASKS)).collect()}
    assert rvd == {(3, 1): 0.0, (7, 1): pytest.approx(26 / 27), (1, 5): None, (5, 1): 1.0}
    pr = {(r["a_id"], r["b_id"]): (r["precision"], r["recall"]) for r in M.precision_recall(pairs, masks_of(MASKS)).collect()}
    assert pr == {(3, 1): (18 / 27, 18 / 27), (7, 1): (1.0, 1 / 27), (1, 5): (0.0, None), (5, 1): (None, 0.0)}


def test_surfaces_far_apart_and_empty(spark, masks_of):
    pairs = spark.createDataFrame([(1, 2), (1, 4), (3, 7), (1, 5)], "a_id long, b_id long")
    shell = {v: np.array([p for p in pts if len(pts) < 27 or p != (sorted(pts)[13])]) for v, pts in MASKS.items()}

    def directed(a, b):
        return np.sqrt(((shell[a][:, None] - shell[b][None]) ** 2).sum(-1)).min(1)

    hd = {(r["a_id"], r["b_id"]): r["hd95"] for r in S.hausdorff95(pairs, masks_of(MASKS)).collect()}
    sd = {(r["a_id"], r["b_id"]): r["surface_dice"] for r in S.surface_dice(pairs, masks_of(MASKS), 1.0).collect()}
    for a, b in ((1, 2), (1, 4), (3, 7)):
        there, back = directed(a, b), directed(b, a)
        assert hd[a, b] == pytest.approx(max(np.quantile(there, 0.95), np.quantile(back, 0.95)))
        assert sd[a, b] == pytest.approx(((there <= 1).sum() + (back <= 1).sum()) / (len(there) + len(back)))
    assert hd[1, 5] is None and sd[1, 5] == 0.0


def test_describe_of_one_value(spark):
    row = M.describe(spark.createDataFrame([(2.0,), (None,)], "v double"), "v").first()
    assert row.asDict() == {"count": 1, "mean": 2.0, "std": None, "min": 2.0, "max": 2.0, "p25": 2.0, "p50": 2.0, "p75": 2.0}


def test_distances_of_clouds(spark, masks_of):
    rng = np.random.default_rng(11)
    clouds = {1: rng.integers(0, 12, (40, 3)), 2: rng.integers(0, 12, (30, 3)) + [60, 25, 3], 3: rng.integers(-50, 100, (50, 3))}
    clouds = {v: np.unique(c, axis=0) for v, c in clouds.items()}
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "a_id long, b_id long")
    masks = masks_of({v: [tuple(p) for p in c] for v, c in clouds.items()})
    got = {}
    for r in S.surface_distances(pairs, masks).collect():
        got.setdefault((r["a_id"], r["b_id"], r["side"]), []).append(r["d"])
    for a, b in ((1, 2), (2, 3)):
        d = np.sqrt(((clouds[a][:, None] - clouds[b][None]) ** 2).sum(-1))
        np.testing.assert_allclose(sorted(got[a, b, "a"]), sorted(d.min(1)))
        np.testing.assert_allclose(sorted(got[a, b, "b"]), sorted(d.min(0)))


@pytest.mark.parametrize("shape", [(1, 1), (5, 3), (40, 60), (7, 200)])
def test_envelope_equals_all_pairs(shape):
    rng = np.random.default_rng(sum(shape))
    f = np.where(rng.random(shape) < 0.3, rng.integers(0, 900, shape), np.inf)
    x = np.arange(shape[1])
    for step in (1.0, 0.37):
        want = (f[:, None, :] + (step * (x[:, None] - x[None, :])) ** 2).min(2)
        np.testing.assert_allclose(D.envelope(f, step), want)


def test_jobs_do_not_depend_on_the_extent(spark, masks_of):
    pairs = spark.createDataFrame([(1, 2)], "a_id long, b_id long")
    plans = []
    for far in (5, 500):
        masks = masks_of({1: [(0, 0, 0)], 2: [(far, far, 3)]})
        plans.append(S.surface_distances(pairs, masks)._jdf.queryExecution().optimizedPlan().toString())
        assert [r["d"] for r in S.surface_distances(pairs, masks).collect()] == [pytest.approx((2 * far * far + 9) ** 0.5)] * 2
    assert len(plans[0].splitlines()) == len(plans[1].splitlines()) and "explode" not in plans[1]
