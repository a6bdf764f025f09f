"""Registered queries: mask overlap and surface distances."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelcohort.operators import geometry as G
from voxelcohort.operators import overlap as M
from voxelcohort.operators import surface as S
from voxelcohort.operators import voxels as V
from voxelcohort.session import cut_lineage
from voxelcohort.workload import tables as T
from voxelcohort.workload.tables import CTE, with_sql

Q: dict[str, tuple] = {}


def q(name, sql=None):
    def add(fn):
        Q[name] = (fn, sql)
        return fn

    return add


def _r(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


CTE["sizes"] = (("masks",), "SELECT volume_id, count(*) AS n FROM masks GROUP BY 1")
CTE["all_pairs"] = (("volumes", "masks", "sizes"), """
  SELECT a.patient_id, a.volume_id AS a_id, b.volume_id AS b_id, a.tracker AS a_tracker, b.tracker AS b_tracker, a.study_type AS a_type, b.study_type AS b_type,
    coalesce(x.n_ab, 0) AS n_ab, 2.0 * coalesce(x.n_ab, 0) / (sa.n + sb.n) AS dice
  FROM volumes a JOIN volumes b ON a.patient_id = b.patient_id AND a.volume_id < b.volume_id JOIN sizes sa ON sa.volume_id = a.volume_id JOIN sizes sb ON sb.volume_id = b.volume_id
  LEFT JOIN (SELECT ma.volume_id AS va, mb.volume_id AS vb, count(*) AS n_ab FROM masks ma JOIN masks mb ON ma.volume_id // 5 = mb.volume_id // 5 AND ma.i = mb.i AND ma.j = mb.j AND ma.k = mb.k GROUP BY ALL) x
    ON x.va = a.volume_id AND x.vb = b.volume_id""")
CTE["follow_n"] = (("follow", "masks", "sizes"), """
  SELECT a_id, b_id, sa.n AS n_a, sb.n AS n_b, (SELECT count(*) FROM masks ma JOIN masks mb USING (i, j, k) WHERE ma.volume_id = a_id AND mb.volume_id = b_id) AS n_ab
  FROM follow JOIN sizes sa ON sa.volume_id = a_id JOIN sizes sb ON sb.volume_id = b_id""")
CTE["study"] = (("all_pairs", "volumes"), """
  SELECT volume_id, any_value(patient_id) AS patient_id, any_value(study_type) AS study_type, count(*) AS n_comparisons, avg(dice) AS mean_dice, stddev_samp(dice) AS std_dice,
    min(dice) AS min_dice, max(dice) AS max_dice, median(dice) AS median_dice
  FROM (SELECT a_id AS volume_id, dice FROM all_pairs UNION ALL SELECT b_id, dice FROM all_pairs) JOIN volumes USING (volume_id) GROUP BY volume_id""")


def _study(spark, d):
    """Pairs feed several branches of the summary, so they are computed once."""
    series, masks = T.volumes(spark, d), T.masks(spark, d)
    return M.dice_per_study(series, masks, cut_lineage(M.pairwise_dice(series, masks)))


@q("M01_dice", with_sql("SELECT a_id, b_id, n_ab, round(2.0 * n_ab / (n_a + n_b), 6) + 0.0 AS dice FROM follow_n", "follow_n"))
def _(spark, d):
    return _r(M.dice(T.follow(spark, d), T.masks(spark, d)), "dice").select("a_id", "b_id", "n_ab", "dice")


@q("M02_cross_type_dice", with_sql("""
  SELECT a_tracker AS tracker, CASE WHEN a_type = 'T1_post' THEN a_id ELSE b_id END AS a_id, CASE WHEN a_type = 'T1_post' THEN b_id ELSE a_id END AS b_id, n_ab, round(dice, 6) + 0.0 AS dice
  FROM all_pairs WHERE a_tracker = b_tracker AND a_type <> b_type""", "all_pairs"))
def _(spark, d):
    return _r(M.cross_type_dice(T.volumes(spark, d), T.masks(spark, d), "t1", "T2"), "dice")


@q("M03_pairwise_dice", with_sql("SELECT patient_id, a_id, b_id, a_type, b_type, n_ab, round(dice, 6) + 0.0 AS dice FROM all_pairs WHERE n_ab > 0", "all_pairs"))
def _(spark, d):
    out = _r(M.pairwise_dice(T.volumes(spark, d), T.masks(spark, d)), "dice")
    return out.select("patient_id", "a_id", "b_id", F.col("a_study_type").alias("a_type"), F.col("b_study_type").alias("b_type"), "n_ab", "dice")


@q("M03_pairwise_dice_tiled", Q["M03_pairwise_dice"][1])  # every block above the limit, so its volumes meet in tiles
def _(spark, d):
    out = _r(M.pairwise_dice(T.volumes(spark, d), T.masks(spark, d), rows_per_tile=2), "dice")
    return out.select("patient_id", "a_id", "b_id", F.col("a_study_type").alias("a_type"), F.col("b_study_type").alias("b_type"), "n_ab", "dice")


@q("M04_pair_counts", with_sql("""
  SELECT patient_id, count(*) AS n_pairs, count(*) FILTER (n_ab > 0) AS n_overlapping, count(*) FILTER (n_ab = 0) AS n_zero FROM all_pairs GROUP BY 1""", "all_pairs"))
def _(spark, d):
    series, masks = T.volumes(spark, d), T.masks(spark, d)
    return M.pair_counts(series, masks, M.pairwise_dice(series, masks)).select("patient_id", "n_pairs", "n_overlapping", "n_zero")


@q("M04_comparison_stats", with_sql("""
  SELECT round(avg(n), 6) + 0.0 AS mean_pairs, min(n) AS min_pairs, max(n) AS max_pairs FROM (SELECT patient_id, count(*) AS n FROM all_pairs GROUP BY 1)""", "all_pairs"))
def _(spark, d):
    return _r(M.comparison_stats(M.pair_counts(T.volumes(spark, d))), "mean_pairs")


_STATS = ["mean_dice", "std_dice", "min_dice", "max_dice", "median_dice"]


@q("M05_dice_per_study", with_sql(f"SELECT volume_id, patient_id, study_type, n_comparisons, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in _STATS)} FROM study ORDER BY mean_dice DESC", "study"))
def _(spark, d):
    return _r(_study(spark, d), *_STATS).orderBy(F.desc("mean_dice"))


@q("M06_describe", with_sql("""
  SELECT count(dice) AS count, round(avg(dice), 6) + 0.0 AS mean, round(stddev_samp(dice), 6) + 0.0 AS std, round(min(dice), 6) + 0.0 AS min, round(max(dice), 6) + 0.0 AS max,
    round(quantile_cont(dice, 0.25), 6) + 0.0 AS p25, round(quantile_cont(dice, 0.5), 6) + 0.0 AS p50, round(quantile_cont(dice, 0.75), 6) + 0.0 AS p75 FROM all_pairs""", "all_pairs"))
def _(spark, d):
    series, masks = T.volumes(spark, d), T.masks(spark, d)
    pairs = cut_lineage(M.pairwise_dice(series, masks).select("patient_id", "dice"))
    scored = cut_lineage(M.scored_dice(pairs, M.pair_counts(series, masks, pairs)))
    return _r(M.describe(scored, "dice", "w"), "mean", "std", "min", "max", "p25", "p50", "p75")


@q("M07_dice_by_type", with_sql("""
  SELECT study_type, round(avg(mean_dice), 4) + 0.0 AS mean_dice, round(stddev_samp(mean_dice), 4) + 0.0 AS std_dice, count(mean_dice) AS n_studies, round(avg(n_comparisons), 4) + 0.0 AS mean_comparisons FROM study GROUP BY 1""", "study"))
def _(spark, d):
    return M.dice_by_type(_study(spark, d))


@q("M08_top_bottom", with_sql("""
  SELECT 'top' AS "end", volume_id, round(mean_dice, 6) + 0.0 AS mean_dice FROM (SELECT * FROM study ORDER BY mean_dice DESC, volume_id LIMIT 10)
  UNION ALL SELECT 'bottom', volume_id, round(mean_dice, 6) + 0.0 FROM (SELECT * FROM study ORDER BY mean_dice, volume_id LIMIT 10)""", "study"))
def _(spark, d):
    return _r(M.top_bottom(cut_lineage(_study(spark, d))), "mean_dice").select("end", "volume_id", "mean_dice")


@q("M09_rvd", with_sql("SELECT a_id, b_id, round(abs(n_a - n_b) / n_b, 6) + 0.0 AS rvd FROM follow_n", "follow_n"))
def _(spark, d):
    return _r(M.rvd(T.follow(spark, d), T.masks(spark, d)), "rvd").select("a_id", "b_id", "rvd")


@q("M10_precision_recall", with_sql('SELECT a_id, b_id, round(n_ab / n_a, 6) + 0.0 AS "precision", round(n_ab / n_b, 6) + 0.0 AS recall FROM follow_n', "follow_n"))
def _(spark, d):
    return _r(M.precision_recall(T.follow(spark, d), T.masks(spark, d)), "precision", "recall").select("a_id", "b_id", "precision", "recall")


CTE["big"] = (("voxels",), "SELECT volume_id, i, j, k FROM voxels WHERE value > -0.05")
_HOPS = "(VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) h(di, dj, dk)"
CTE["shell"] = (("big",), f"""
  SELECT DISTINCT b.volume_id, b.i, b.j, b.k FROM big b, {_HOPS}
  WHERE NOT EXISTS (SELECT 1 FROM big x WHERE x.volume_id = b.volume_id AND x.i = b.i + di AND x.j = b.j + dj AND x.k = b.k + dk)""")
CTE["dists"] = (("shell", "follow"), """
  SELECT a_id, b_id, 'a' AS side, min(sqrt((a.i - b.i) ^ 2 + (a.j - b.j) ^ 2 + (a.k - b.k) ^ 2)) AS d FROM follow JOIN shell a ON a.volume_id = a_id JOIN shell b ON b.volume_id = b_id GROUP BY a_id, b_id, a.i, a.j, a.k
  UNION ALL SELECT a_id, b_id, 'b', min(sqrt((a.i - b.i) ^ 2 + (a.j - b.j) ^ 2 + (a.k - b.k) ^ 2)) FROM follow JOIN shell a ON a.volume_id = a_id JOIN shell b ON b.volume_id = b_id GROUP BY a_id, b_id, b.i, b.j, b.k""")


def _big(spark, d):
    return V.to_mask(V.explode_voxels(T.chunks(spark, d)), -0.05)


@q("M11_surface", with_sql("SELECT * FROM shell", "shell"))
def _(spark, d):
    return G.surface(_big(spark, d))


@q("M12_hausdorff95", with_sql("""
  SELECT a_id, b_id, round(max(h), 6) + 0.0 AS hd95 FROM (SELECT a_id, b_id, side, quantile_cont(d, 0.95) AS h FROM dists GROUP BY ALL) GROUP BY ALL""", "dists"))
def _(spark, d):
    return _r(S.hausdorff95(T.follow(spark, d), _big(spark, d)), "hd95")


@q("M13_surface_dice", with_sql("SELECT a_id, b_id, round(avg(CASE WHEN d <= 1.0 THEN 1 ELSE 0 END), 6) + 0.0 AS surface_dice FROM dists GROUP BY ALL", "dists"))
def _(spark, d):
    return _r(S.surface_dice(T.follow(spark, d), _big(spark, d), 1.0), "surface_dice")


@q("M14_persistence_baseline", with_sql("""
  SELECT count(dice) AS n, round(avg(dice), 6) + 0.0 AS mean_dice, round(stddev_pop(dice), 6) + 0.0 AS std_dice FROM all_pairs JOIN volumes v ON v.volume_id = a_id JOIN volumes w ON w.volume_id = b_id WHERE v.day = 0 AND w.day = 1""", "all_pairs", "volumes"))
def _(spark, d):
    return _r(M.persistence_baseline(T.volumes(spark, d), T.masks(spark, d)), "mean_dice", "std_dice")


@q("M15_binarise", with_sql("SELECT volume_id, i, j, k FROM voxels WHERE 1 / (1 + exp(-value)) >= 0.52", "voxels"))
def _(spark, d):
    return M.binarise(V.explode_voxels(T.chunks(spark, d)), 0.52)
