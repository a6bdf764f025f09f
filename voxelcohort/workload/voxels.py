"""Registered queries: intensity and geometry of volumes."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelcohort.operators import geometry as G
from voxelcohort.operators import resample as RS
from voxelcohort.operators import voxels as V
from voxelcohort.operators import windows as W
from voxelcohort.workload import tables as T
from voxelcohort.workload.tables import with_sql

Q: dict[str, tuple] = {}
KEY = ["volume_id", "i", "j", "k"]
EDGE = (4, 4, 4)


def q(name, sql=None):
    def add(fn):
        Q[name] = (fn, sql)
        return fn

    return add


def _r(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def _flat(chunks):
    return _r(V.explode_voxels(chunks), "value")


def _ints(df):
    return df.select("volume_id", *[F.col(a).cast("long").alias(a) for a in "ijk"], *[c for c in df.columns if c not in KEY])


_VOX = "volume_id, i, j, k"


@q("V01_explode_voxels", with_sql(f"SELECT {_VOX}, value, value > 0.1 AS foreground FROM voxels", "voxels"))
def _(spark, d):
    vox = V.explode_voxels(T.chunks(spark, d))
    marks = V.to_mask(vox, 0.1).withColumn("foreground", F.lit(True))
    return vox.join(marks, KEY, "left").fillna(False, ["foreground"])


_BIN = "CASE WHEN hi > lo THEN least(floor((value - lo) / (hi - lo) * {n}), {m}) ELSE 0 END"
_RNG = "(SELECT *, min(value) OVER (PARTITION BY volume_id) AS lo, max(value) OVER (PARTITION BY volume_id) AS hi FROM voxels)"


@q("V02_entropy", with_sql(f"""
  SELECT volume_id, round(-sum(c / n * log2(c / n)), 6) + 0.0 AS entropy FROM (
    SELECT volume_id, CAST(count(*) AS DOUBLE) AS c, CAST(sum(count(*)) OVER (PARTITION BY volume_id) AS DOUBLE) AS n
    FROM (SELECT volume_id, {_BIN.format(n=256, m=255)} AS bin FROM {_RNG}) GROUP BY volume_id, bin) GROUP BY volume_id""", "voxels"))
def _(spark, d):
    return _r(V.entropy(T.chunks(spark, d)), "entropy")


@q("V03_stride_sample", with_sql(f"SELECT {_VOX}, value FROM voxels WHERE ((i * 4 + j) * 16 + k) % 6 = 0", "voxels"))
def _(spark, d):
    return W.stride_sample(T.chunks(spark, d), max_n=50)


_PCT = ", ".join(f"round(quantile_cont(value, {p / 100}), 6) + 0.0 AS p{p}" for p in (1, 25, 50, 99))


@q("V04_percentiles", with_sql(f"SELECT volume_id, {_PCT} FROM voxels GROUP BY volume_id", "voxels"))
def _(spark, d):
    ps = [1, 25, 50, 99]
    return V.percentiles(T.chunks(spark, d), ps).select("volume_id", *[F.round(F.get("q", n), 6).alias(f"p{p}") for n, p in enumerate(ps)])


@q("V04_percentiles_split", Q["V04_percentiles"][1])  # few order statistics a chunk, so that bounds are wide
def _(spark, d):
    ps = [1, 25, 50, 99]
    return V.percentiles(T.chunks(spark, d), ps, knots=5).select("volume_id", *[F.round(F.get("q", n), 6).alias(f"p{p}") for n, p in enumerate(ps)])


@q("V05_standardise", with_sql(f"""
  SELECT {_VOX}, round((greatest(least(value, b), a) - a) / (b - a), 6) + 0.0 AS value FROM voxels
  JOIN (SELECT volume_id, quantile_cont(value, 0.01) AS a, quantile_cont(value, 0.99) AS b FROM voxels GROUP BY 1) USING (volume_id)""", "voxels"))
def _(spark, d):
    return _flat(V.standardise(T.chunks(spark, d)))


_KNOTS = "[" + ", ".join(f"{n}.0 / 255" for n in range(256)) + "]"


@q("V06_histogram_match", with_sql(f"""
  , q AS (SELECT volume_id, quantile_cont(value, {_KNOTS}) AS ks FROM voxels GROUP BY 1),
  knots AS (SELECT volume_id, unnest(range(256)) AS n, unnest(ks) AS x, unnest(list_concat(ks[2:], [NULL])) AS x1 FROM q),
  hit AS (SELECT v.*, s.n, s.x, s.x1 FROM voxels v ASOF JOIN knots s ON v.volume_id = s.volume_id AND v.value >= s.x)
  SELECT h.volume_id, i, j, k, round(CASE WHEN h.x1 IS NULL OR h.x1 = h.x THEN r.x ELSE r.x + (h.value - h.x) / (h.x1 - h.x) * (r.x1 - r.x) END, 5) + 0.0 AS value
  FROM hit h JOIN knots r ON r.volume_id = h.volume_id // 5 * 5 AND r.n = h.n""".lstrip(), "voxels"))
def _(spark, d):
    c = T.chunks(spark, d)
    pairs = T.volumes(spark, d).select("volume_id", (F.col("patient_id") * 5).alias("reference_id"))
    return _r(V.explode_voxels(V.histogram_match(c, c, pairs)), "value", digits=5)


@q("V07_sanitise", with_sql(f"""
  SELECT {_VOX}, CASE WHEN value < -0.3 THEN 0 WHEN value < -0.2 THEN -3.4028235e38 WHEN value > 0.3 THEN 3.4028235e38 ELSE round(value, 6) + 0.0 END AS value FROM voxels""", "voxels"))
def _(spark, d):
    def spoil(v):
        x = lambda s: F.lit(s).cast("double")
        return F.when(v < -0.3, x("NaN")).when(v < -0.2, x("-Infinity")).when(v > 0.3, x("Infinity")).otherwise(v)

    out = V.explode_voxels(V.sanitise(V.map_values(T.chunks(spark, d), spoil)))
    big = F.abs("value") > 1e38
    return out.withColumn("value", F.when(big, F.signum("value") * 3.4028235e38).otherwise(F.round("value", 6)))


_GOOD = "list_filter(spacing, lambda x: x IS NOT NULL AND NOT isnan(x) AND x >= 1e-6 AND x <= 100)"


@q("V08_repair_spacing", with_sql(f"""
  SELECT volume_id, round(s[1], 6) + 0.0 AS d0, round(s[2], 6) + 0.0 AS d1, round(s[3], 6) + 0.0 AS d2 FROM (
    SELECT volume_id, list_transform(spacing, lambda x: CASE WHEN x IS NOT NULL AND NOT isnan(x) AND x >= 1e-6 AND x <= 100 THEN x ELSE coalesce(list_median({_GOOD}), 1.0) END) AS s FROM headers)""", "headers"))
def _(spark, d):
    return V.repair_spacing(T.headers(spark, d)).select("volume_id", *[F.round(F.get("spacing", n), 6).alias(f"d{n}") for n in range(3)])


@q("V09_valid_header", with_sql("SELECT volume_id, len(list_filter(spacing, lambda x: x IS NULL OR isnan(x) OR isinf(x) OR x <= 0)) = 0 AS valid FROM headers", "headers"))
def _(spark, d):
    return V.valid_header(T.headers(spark, d)).select("volume_id", "valid")


@q("V10_voxel_volume", with_sql("""
  SELECT volume_id, CASE WHEN len(list_filter(spacing, lambda x: x IS NULL OR isnan(x))) = 0 THEN round(list_product(spacing), 6) + 0.0 END AS voxel_volume, CASE trim(unit) WHEN 'mm' THEN 'mm³' WHEN 'CM' THEN 'cm³' WHEN 'furlong' THEN 'furlong³' END AS volume_unit
  FROM headers""", "headers"))
def _(spark, d):
    return V.voxel_volume(T.headers(spark, d)).select("volume_id", F.round("voxel_volume", 6).alias("voxel_volume"), V.cubic_unit("unit").alias("volume_unit"))


@q("V11_segmentation_volume", with_sql("""
  SELECT volume_id, count(m.i) AS n_voxels, round(CAST(count(m.i) AS DOUBLE) * 0.75, 6) + 0.0 AS segmentation_volume FROM volumes LEFT JOIN masks m USING (volume_id) GROUP BY 1""", "volumes", "masks"))
def _(spark, d):
    return _r(V.segmentation_volume(T.masks(spark, d), T.volumes(spark, d)), "segmentation_volume")


@q("V12_file_size_mb", with_sql("SELECT path, round(length / 1048576, 6) + 0.0 AS file_size_mb FROM files", "files"))
def _(spark, d):
    return _r(V.file_size_mb(T.files(spark, d)), "file_size_mb").select("path", "file_size_mb")


_MI = """
  (SELECT a_id, b_id, sum(c / n * ln(c * n / (cx * cy))) AS mi FROM (
    SELECT *, CAST(sum(c) OVER (PARTITION BY a_id, b_id) AS DOUBLE) AS n, CAST(sum(c) OVER (PARTITION BY a_id, b_id, x) AS DOUBLE) AS cx, CAST(sum(c) OVER (PARTITION BY a_id, b_id, y) AS DOUBLE) AS cy FROM (
      SELECT a_id, b_id, x, y, CAST(count(*) AS DOUBLE) AS c FROM (
        SELECT a_id, b_id, {a} AS x, {b} AS y FROM follow JOIN {rng} va ON va.volume_id = a_id JOIN {rng} vb ON vb.volume_id = b_id AND va.i = vb.i AND va.j = vb.j AND va.k = vb.k)
      GROUP BY ALL)) GROUP BY a_id, b_id)"""


def _mi_sql(n):
    bin_ = lambda t: f"CASE WHEN {t}.hi > {t}.lo THEN least(floor(({t}.value - {t}.lo) / ({t}.hi - {t}.lo) * {n}), {n - 1}) ELSE 0 END"
    return _MI.format(a=bin_("va"), b=bin_("vb"), rng=_RNG)


@q("V13_mutual_information", with_sql(f"SELECT a_id, b_id, round(mi, 6) + 0.0 AS mi FROM {_mi_sql(8)}", "follow", "voxels"))
def _(spark, d):
    c = T.chunks(spark, d)
    return _r(V.mutual_information(c, c, T.follow(spark, d), 8), "mi")


@q("V14_mi_gain", with_sql(f"""
  SELECT a_id, b_id, round(x.mi, 6) + 0.0 AS mi_before, round(y.mi, 6) + 0.0 AS mi_after, round(y.mi - x.mi, 6) + 0.0 AS gain FROM {_mi_sql(8)} x JOIN {_mi_sql(16)} y USING (a_id, b_id)""", "follow", "voxels"))
def _(spark, d):
    c, pairs = T.chunks(spark, d), T.follow(spark, d)
    gain = V.mi_gain(V.mutual_information(c, c, pairs, 8), V.mutual_information(c, c, pairs, 16))
    return _r(gain, "mi_before", "mi_after", "gain")


@q("V15_coverage_guard", with_sql("""
  SELECT volume_id, round(count(m.i) * 100.0 / 256, 6) + 0.0 AS coverage_pct, count(m.i) * 100.0 / 256 < 20 AS use_all FROM volumes LEFT JOIN masks m USING (volume_id) GROUP BY 1""", "volumes", "masks"))
def _(spark, d):
    return _r(V.coverage_guard(T.masks(spark, d), T.volumes(spark, d), 20.0), "coverage_pct")


@q("V16_apply_mask", with_sql(f"SELECT {_VOX}, CASE WHEN value > 0.1 THEN round(value, 6) + 0.0 ELSE 0.0 END AS value FROM voxels", "voxels"))
def _(spark, d):
    return _flat(V.apply_mask(T.chunks(spark, d), T.masks(spark, d), EDGE))


@q("V17_dilate", with_sql("""
  SELECT DISTINCT volume_id, i + di AS i, j + dj AS j, k + dk AS k FROM masks, range(-2, 3) a(di), range(-2, 3) b(dj), range(-2, 3) c(dk)
  WHERE di * di + dj * dj + dk * dk <= 4 AND i + di BETWEEN 0 AND 3 AND j + dj BETWEEN 0 AND 3 AND k + dk BETWEEN 0 AND 15""", "masks"))
def _(spark, d):
    return _ints(G.dilate(T.masks(spark, d), T.volumes(spark, d), 1.0))


@q("V18_otsu_mask", with_sql(f"""
  , h AS (SELECT volume_id, lo, hi, bin, count(*) AS n, count(*) * any_value(lo + (bin + 0.5) * (hi - lo) / 32) AS m FROM (SELECT *, {_BIN.format(n=32, m=31)} AS bin FROM {_RNG}) GROUP BY volume_id, lo, hi, bin),
  c AS (SELECT *, CAST(sum(n) OVER w AS DOUBLE) AS n0, sum(m) OVER w AS s0, CAST(sum(n) OVER (PARTITION BY volume_id) AS DOUBLE) AS nn, sum(m) OVER (PARTITION BY volume_id) AS ss FROM h WINDOW w AS (PARTITION BY volume_id ORDER BY bin)),
  b AS (SELECT *, CASE WHEN nn > n0 THEN round(n0 * (nn - n0) * (s0 / n0 - (ss - s0) / (nn - n0)) ^ 2, 9) ELSE -1 END AS between_, lo + (bin + 1) * (hi - lo) / 32 AS edge FROM c),
  t AS (SELECT volume_id, edge FROM (SELECT *, row_number() OVER (PARTITION BY volume_id ORDER BY between_ DESC, bin) AS rn FROM b) WHERE rn = 1)
  SELECT volume_id, i::INT AS i, j::INT AS j, k::INT AS k FROM voxels JOIN t USING (volume_id) WHERE value >= edge""".lstrip(), "voxels"))
def _(spark, d):
    return V.otsu_mask(T.chunks(spark, d), 32)


@q("V19_normalise_nonzero", with_sql(f"""
  , m AS (SELECT {_VOX}, CASE WHEN abs(value) < 0.05 THEN 0 ELSE value END AS value FROM voxels)
  SELECT {_VOX}, CASE WHEN value = 0 THEN 0 ELSE round((value - mu) / sd, 6) + 0.0 END AS value FROM m
  JOIN (SELECT volume_id, avg(value) AS mu, stddev_pop(value) AS sd FROM m WHERE value <> 0 GROUP BY 1) USING (volume_id)""".lstrip(), "voxels"))
def _(spark, d):
    holes = V.map_values(T.chunks(spark, d), lambda v: F.when(F.abs(v) < 0.05, 0.0).otherwise(v))
    return _flat(V.normalise_nonzero(holes))


@q("V20_crop_range", with_sql("SELECT volume_id, i, j, k - 3 AS k, round(value, 6) + 0.0 AS value FROM voxels WHERE k >= 3 AND k < 11", "voxels"))
def _(spark, d):
    return _ints(_r(V.explode_voxels(V.crop_range(T.chunks(spark, d), "k", 3, 11)), "value"))


@q("V21_reorient", with_sql("SELECT volume_id, k AS i, 3 - i AS j, j AS k, round(value, 6) + 0.0 AS value FROM voxels", "voxels"))
def _(spark, d):
    return _ints(_r(V.explode_voxels(W.reorient(T.chunks(spark, d), "RAS", "SLA")), "value"))


@q("V22_intensity_profile", with_sql(f"""
  SELECT volume_id, CAST(bin AS INT) AS bin, count(*) AS n, round(any_value(mp), 6) + 0.0 AS mean_positive, round(any_value(hi), 6) + 0.0 AS max_value FROM (
    SELECT *, avg(CASE WHEN value > 0 THEN value END) OVER (PARTITION BY volume_id) AS mp, {_BIN.format(n=50, m=49)} AS bin FROM {_RNG}) GROUP BY volume_id, bin""", "voxels"))
def _(spark, d):
    stats, hist = V.intensity_profile(T.chunks(spark, d))
    return _r(hist.join(stats, "volume_id"), "mean_positive", "max_value")


# --- G: geometry ------------------------------------------------------------------------------------------

_LABELS = """RECURSIVE_ r AS (SELECT volume_id, i, j, k, (i * 4 + j) * 16 + k AS root FROM masks
    UNION SELECT m.volume_id, m.i, m.j, m.k, r.root FROM r JOIN masks m ON m.volume_id = r.volume_id AND abs(m.i - r.i) + abs(m.j - r.j) + abs(m.k - r.k) = 1),
  lab AS (SELECT volume_id, i, j, k, min(root) AS root FROM r GROUP BY ALL),
  sz AS (SELECT volume_id, root, count(*) AS n FROM lab GROUP BY ALL)"""


def _recursive(body):
    return with_sql("", "masks").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + ", " + _LABELS.replace("RECURSIVE_ ", "") + body


@q("G01_components", _recursive(" SELECT lab.volume_id, i, j, k, root // 64 || ',' || root // 16 % 4 || ',' || root % 16 AS component FROM lab"))
def _(spark, d):
    return _ints(G.components(T.masks(spark, d)))


@q("G01_largest_component", _recursive("""
  SELECT volume_id, i, j, k FROM lab WHERE (volume_id, root) IN (SELECT (volume_id, root) FROM (SELECT *, row_number() OVER (PARTITION BY volume_id ORDER BY n DESC, root) AS rn FROM sz) WHERE rn = 1)"""))
def _(spark, d):
    return _ints(G.largest_component(T.masks(spark, d)))


@q("G02_centroid", with_sql("""
  SELECT volume_id, round(avg(i), 6) + 0.0 AS ci, round(avg(j), 6) + 0.0 AS cj, round(avg(k), 6) + 0.0 AS ck, round(avg(i) * 0.5, 6) + 0.0 AS mm_i, round(avg(j) * 0.5, 6) + 0.0 AS mm_j, round(avg(k) * 3, 6) + 0.0 AS mm_k
  FROM masks GROUP BY 1""", "masks"))
def _(spark, d):
    return _r(G.centroid(T.masks(spark, d), T.volumes(spark, d)), "ci", "cj", "ck", "mm_i", "mm_j", "mm_k")


def _tensor_sql(name, scale):
    cov = lambda a, b: f"{f'var_pop({a})' if a == b else f'covar_pop({a}, {b})'} * {scale[a] * scale[b]}"
    cell = lambda a, b: " + ".join(cov(c, c) for c in "ijk" if c != a) if a == b else f"-({cov(min(a, b), max(a, b))})"
    return ", ".join(f"round({cell(a, b)}, 6) + 0.0 AS {name}_{a}{b}" for a in "ijk" for b in "ijk")


@q("G03_inertia", with_sql(f"SELECT volume_id, {_tensor_sql('vox', dict.fromkeys('ijk', 1.0))}, {_tensor_sql('mm', {'i': 0.5, 'j': 0.5, 'k': 3.0})} FROM masks GROUP BY 1", "masks"))
def _(spark, d):
    t = G.inertia(T.masks(spark, d), T.volumes(spark, d))
    return t.select("volume_id", *[F.round(F.get(f"tensor_{n}", 3 * r + c), 6).alias(f"{n}_{'ijk'[r]}{'ijk'[c]}") for n in ("vox", "mm") for r in range(3) for c in range(3)])


def _axis_sql(name, cov):
    """Long axis by the closed form, on the covariance ``(a, b, c, d, e, f)`` = ii, jj, kk, ij, ik, jk: its largest eigenvalue's vector."""
    return f"""{name} AS (SELECT volume_id, {cov} FROM masks GROUP BY 1),
  {name}1 AS (SELECT *, (a + b + c) / 3 AS m FROM {name}),
  {name}2 AS (SELECT *, sqrt(((a - m)^2 + (b - m)^2 + (c - m)^2 + 2 * (d*d + e*e + f*f)) / 6) AS p FROM {name}1),
  {name}3 AS (SELECT *, ((a-m)*((b-m)*(c-m) - f*f) - d*(d*(c-m) - f*e) + e*(d*f - (b-m)*e)) / (2 * p^3) AS h FROM {name}2),
  {name}4 AS (SELECT *, m + 2 * p * cos(acos(least(greatest(h, -1), 1)) / 3) AS l FROM {name}3),
  {name}5 AS (SELECT volume_id, unnest([[d*f - e*(b-l), e*d - (a-l)*f, (a-l)*(b-l) - d*d], [d*(c-l) - e*f, e*e - (a-l)*(c-l), (a-l)*f - d*e], [(b-l)*(c-l) - f*f, f*e - d*(c-l), d*f - (b-l)*e]]) AS v FROM {name}4),
  {name}6 AS (SELECT volume_id, arg_max(v, v[1]^2 + v[2]^2 + v[3]^2) AS v FROM {name}5 GROUP BY 1),
  {name}7 AS (SELECT volume_id, list_transform(v, lambda x: x / sqrt(v[1]^2 + v[2]^2 + v[3]^2) * CASE WHEN greatest(v[1], v[2], v[3]) >= -least(v[1], v[2], v[3]) THEN 1 ELSE -1 END) AS v FROM {name}6)"""


_COV = "var_pop(i) * {x} AS a, var_pop(j) * {x} AS b, var_pop(k) * {z} AS c, covar_pop(i, j) * {x} AS d, covar_pop(i, k) * {y} AS e, covar_pop(j, k) * {y} AS f"


@q("G04_principal_axes", with_sql(f"""
  , {_axis_sql('vx', _COV.format(x=1, y=1, z=1))}, {_axis_sql('mm', _COV.format(x=0.25, y=1.5, z=9))}
  SELECT volume_id, {', '.join(f'round({t}.v[{n + 1}], 6) + 0.0 AS {s}_{a}' for t, s in (('vx7', 'vox'), ('mm7', 'mm')) for n, a in enumerate('ijk'))} FROM vx7 JOIN mm7 USING (volume_id)""".lstrip(), "masks"))
def _(spark, d):
    axes = G.principal_axes(G.inertia(T.masks(spark, d), T.volumes(spark, d)))
    return axes.select("volume_id", *[F.round(F.get(f"axis_{s}", n), 6).alias(f"{s}_{a}") for s in ("vox", "mm") for n, a in enumerate("ijk")])


_DOT = "(ca.ci * cb.ci + ca.cj * cb.cj + ca.ck * cb.ck)"
_CEN = "(SELECT volume_id, avg(i) AS ci, avg(j) AS cj, avg(k) AS ck FROM masks GROUP BY 1)"


@q("G05_angle_deg", with_sql(f"""
  SELECT a_id, b_id, round(degrees(acos(least(abs{_DOT} / (sqrt(ca.ci^2 + ca.cj^2 + ca.ck^2) * sqrt(cb.ci^2 + cb.cj^2 + cb.ck^2)), 1))), 5) + 0.0 AS angle
  FROM follow JOIN {_CEN} ca ON ca.volume_id = a_id JOIN {_CEN} cb ON cb.volume_id = b_id""", "follow", "masks"))
def _(spark, d):
    c = G.centroid(T.masks(spark, d), T.volumes(spark, d)).select("volume_id", F.array("ci", "cj", "ck").alias("v"))
    out = T.follow(spark, d).join(c.withColumnsRenamed({"volume_id": "a_id", "v": "va"}), "a_id").join(c.withColumnsRenamed({"volume_id": "b_id", "v": "vb"}), "b_id")
    return out.select("a_id", "b_id", F.round(G.angle_deg("va", "vb"), 5).alias("angle"))


@q("G06_axis_to_mm", with_sql(f"""
  SELECT volume_id, round(ci * 0.5 / n, 6) + 0.0 AS x, round(cj * 0.5 / n, 6) + 0.0 AS y, round(ck * 3 / n, 6) + 0.0 AS z FROM (SELECT *, sqrt(ci^2 * 0.25 + cj^2 * 0.25 + ck^2 * 9) AS n FROM {_CEN})""", "masks"))
def _(spark, d):
    c = G.centroid(T.masks(spark, d), T.volumes(spark, d)).join(T.volumes(spark, d).select("volume_id", "spacing"), "volume_id")
    u = c.withColumn("u", G.axis_to_mm(F.array("ci", "cj", "ck"), F.col("spacing")))
    return u.select("volume_id", *[F.round(F.get("u", n), 6).alias(a) for n, a in enumerate("xyz")])


@q("G07_bounding_box", with_sql("SELECT volume_id, min(i) AS min_i, max(i) AS max_i, min(j) AS min_j, max(j) AS max_j, min(k) AS min_k, max(k) AS max_k FROM masks GROUP BY 1", "masks"))
def _(spark, d):
    return G.bounding_box(T.masks(spark, d))


@q("G08_max_area_slices", with_sql("""
  SELECT volume_id, axis, CAST(slice AS INT) AS slice, area FROM (SELECT *, row_number() OVER (PARTITION BY volume_id, axis ORDER BY area DESC, slice) AS rn FROM (
    SELECT volume_id, 'i' AS axis, i AS slice, count(*) AS area FROM masks GROUP BY ALL UNION ALL SELECT volume_id, 'j', j, count(*) FROM masks GROUP BY ALL
    UNION ALL SELECT volume_id, 'k', k, count(*) FROM masks GROUP BY ALL)) WHERE rn = 1""", "masks"))
def _(spark, d):
    return G.max_area_slices(T.masks(spark, d), T.volumes(spark, d))


_BOX = "SELECT volume_id, min(i) - 1 AS li, max(i) + 2 AS hi, min(j) - 1 AS lj, max(j) + 2 AS hj, min(k) - 1 AS lk, max(k) + 2 AS hk FROM small GROUP BY 1"


@q("G09_crop_foreground", with_sql(f"""
  , small AS (SELECT {_VOX} FROM voxels WHERE value > 0.25), box AS ({_BOX}),
  st AS (SELECT volume_id, {', '.join(f"CAST(ceil((h{a} - l{a}) / 4.0) * 4 AS BIGINT) AS n{a}, l{a} - CAST(ceil((h{a} - l{a}) / 4.0) * 4 - (h{a} - l{a}) AS BIGINT) // 2 AS s{a}" for a in 'ijk')} FROM box)
  SELECT volume_id, i - si AS i, j - sj AS j, k - sk AS k, round(value, 6) + 0.0 AS value FROM voxels JOIN st USING (volume_id)
  WHERE i >= si AND i < si + ni AND j >= sj AND j < sj + nj AND k >= sk AND k < sk + nk""".lstrip(), "voxels"))
def _(spark, d):
    c = T.chunks(spark, d)
    return _ints(_r(V.explode_voxels(G.crop_foreground(c, V.to_mask(V.explode_voxels(c), 0.25), margin=1, multiple=4)), "value"))


@q("G10_crop_center", with_sql(f"""
  SELECT volume_id, i - si AS i, j - sj AS j, k - sk AS k, round(value, 6) + 0.0 AS value FROM voxels JOIN (
    SELECT volume_id, CAST(floor(greatest(1, least(ci, 3))) AS BIGINT) - 1 AS si, CAST(floor(greatest(1, least(cj, 3))) AS BIGINT) - 1 AS sj, CAST(floor(greatest(4, least(ck, 12))) AS BIGINT) - 4 AS sk FROM {_CEN}) USING (volume_id)
  WHERE i >= si AND i < si + 2 AND j >= sj AND j < sj + 2 AND k >= sk AND k < sk + 8""", "voxels", "masks"))
def _(spark, d):
    return _ints(_r(V.explode_voxels(G.crop_center(T.chunks(spark, d), T.volumes(spark, d), T.masks(spark, d), (2, 2, 8))), "value"))


def _ck(c, half, dim, m):
    return f"least(greatest(floor((round_even({c}, 0) - {half}) / {m}) * {m} + {half}, {half}), {dim} - {half} - 1) - {half}"


@q("G11_crop_center_k", with_sql(f"""
  SELECT volume_id, i - si AS i, j - sj AS j, k - sk AS k, round(value, 6) + 0.0 AS value FROM voxels JOIN (
    SELECT volume_id, CAST({_ck('ci', 1, 4, 2)} AS BIGINT) AS si, CAST({_ck('cj', 1, 4, 2)} AS BIGINT) AS sj, CAST({_ck('ck', 4, 16, 2)} AS BIGINT) AS sk FROM {_CEN}) USING (volume_id)
  WHERE i >= si AND i < si + 2 AND j >= sj AND j < sj + 2 AND k >= sk AND k < sk + 8""", "voxels", "masks"))
def _(spark, d):
    return _ints(_r(V.explode_voxels(G.crop_center_k(T.chunks(spark, d), T.volumes(spark, d), T.masks(spark, d), (2, 2, 8), 2)), "value"))


@q("G12_pad_to", with_sql("SELECT volume_id, i + 2 AS i, j + 1 AS j, k, round(value, 6) + 0.0 AS value, 9 AS ni, 6 AS nj, 16 AS nk FROM voxels", "voxels"))
def _(spark, d):
    moved, head = G.pad_to(T.chunks(spark, d), T.volumes(spark, d), (9, 6, 8))
    out = _ints(_r(V.explode_voxels(moved), "value")).join(head.select("volume_id", "shape"), "volume_id")
    return out.select(*KEY, "value", *[F.get("shape", n).alias(f"n{a}") for n, a in enumerate("ijk")])


def _lin(a, out, dim):
    at = f"greatest((t{a} + 0.5) * {dim}.0 / {out} - 0.5, 0)"
    return f"""SELECT t{a}, least(floor({at}), {dim - 1}) + c AS s{a}, CASE c WHEN 0 THEN 1 - ({at} - least(floor({at}), {dim - 1})) ELSE {at} - least(floor({at}), {dim - 1}) END AS w{a}
      FROM range({out}) x(t{a}), range(2) y(c)"""


@q("G13_resample_trilinear", with_sql(f"""
  SELECT volume_id, ti AS i, tj AS j, tk AS k, round(sum(value * wi * wj * wk), 6) + 0.0 AS value FROM voxels
  JOIN ({_lin('i', 7, 4)}) a ON i = least(si, 3) JOIN ({_lin('j', 3, 4)}) b ON j = least(sj, 3) JOIN ({_lin('k', 10, 16)}) c ON k = least(sk, 15) GROUP BY ALL""", "voxels"))
def _(spark, d):
    return _ints(_r(RS.resample_trilinear(V.explode_voxels(T.chunks(spark, d)), T.volumes(spark, d), (7, 3, 10)), "value"))


def _placement(spark, d):
    shift = F.col("volume_id") % 3
    m = F.array(*[F.lit(x) for x in (0.8, 0.3, 0.0, -0.3, 0.8, 0.0, 0.0, 0.1, 1.4)])
    offset = F.array(F.lit(-0.75), shift * 0.5 - 1.1, F.lit(0.35))
    return T.volumes(spark, d).select("volume_id", m.alias("m"), offset.alias("offset"), F.array(F.lit(6), F.lit(8), F.lit(12)).alias("target_shape"))


@q("G14_place_nearest", with_sql("""
  SELECT volume_id, ti AS i, tj AS j, tk AS k FROM (
    SELECT volume_id, ti, tj, tk, floor(0.8 * ti + 0.3 * tj + 0.0 * tk + -0.75 + 0.5) AS si, floor(-0.3 * ti + 0.8 * tj + 0.0 * tk + (volume_id % 3 * 0.5 - 1.1) + 0.5) AS sj,
      floor(0.0 * ti + 0.1 * tj + 1.4 * tk + 0.35 + 0.5) AS sk
    FROM volumes, range(6) a(ti), range(8) b(tj), range(12) c(tk)) t
  JOIN masks m USING (volume_id) WHERE m.i = si AND m.j = sj AND m.k = sk""", "volumes", "masks"))
def _(spark, d):
    return _ints(RS.place_nearest(T.masks(spark, d), _placement(spark, d)))


_DIST = """(SELECT m.volume_id, m.i, m.j, m.k, least(coalesce(min(sqrt(((m.i - b.i) * 0.5) ^ 2 + ((m.j - b.j) * 0.5) ^ 2 + ((m.k - b.k) * 3.0) ^ 2)), {cap}), {cap}) AS dist_mm
  FROM masks m LEFT JOIN (SELECT volume_id, i, j, k FROM voxels WHERE value <= 0.1) b USING (volume_id) GROUP BY ALL)"""


@q("G15_inner_distance", with_sql(f"SELECT {_VOX}, round(dist_mm, 6) + 0.0 AS dist_mm FROM {_DIST.format(cap='1.25')}", "masks", "voxels"))
def _(spark, d):
    return _ints(_r(G.inner_distance(T.masks(spark, d), T.volumes(spark, d), 1.25), "dist_mm"))


@q("G16_feather_alpha", with_sql(f"SELECT {_VOX}, round((dist_mm / 1.25) ^ 2 * (3 - 2 * dist_mm / 1.25), 6) + 0.0 AS alpha FROM {_DIST.format(cap='1.25')}", "masks", "voxels"))
def _(spark, d):
    dist = G.inner_distance(T.masks(spark, d), T.volumes(spark, d), 1.25)
    return _ints(_r(G.feather_alpha(dist, 1.25), "alpha").drop("dist_mm"))


@q("G17_composite", with_sql(f"""
  SELECT v.volume_id, v.i, v.j, v.k, round(CASE WHEN al IS NULL THEN value ELSE (1 - al) * value + al * (abs(value) * (b - a) + a) END, 6) + 0.0 AS value
  FROM voxels v JOIN (SELECT volume_id, quantile_cont(value, 0.01) AS a, quantile_cont(value, 0.99) AS b FROM voxels GROUP BY 1) USING (volume_id)
  LEFT JOIN (SELECT *, (dist_mm / 1.25) ^ 2 * (3 - 2 * dist_mm / 1.25) AS al FROM {_DIST.format(cap='1.25')}) d USING (volume_id, i, j, k)""", "masks", "voxels"))
def _(spark, d):
    c = T.chunks(spark, d)
    vox = V.explode_voxels(c)
    alpha = G.feather_alpha(G.inner_distance(T.masks(spark, d), T.volumes(spark, d), 1.25), 1.25)
    low = V.percentiles(c, [1, 99]).select("volume_id", F.get("q", 0).alias("p1"), F.get("q", 1).alias("p99"))
    return _flat(V.composite(c, vox.withColumn("value", F.abs("value")), alpha, low, EDGE))


_WIN = "(SELECT * FROM (VALUES (0), (1)) a(wi), (VALUES (0), (1)) b(wj), (VALUES (0), (4), (8), (9)) c(wk))"


@q("G18_patch_windows", with_sql(f"SELECT volume_id, wi, wj, wk FROM volumes, {_WIN}", "volumes"))
def _(spark, d):
    return G.patch_windows(T.volumes(spark, d), (3, 3, 7), 0.4)


_ASSIGN = f"(SELECT v.*, wi, wj, wk FROM voxels v, {_WIN} w WHERE i >= wi AND i < wi + 3 AND j >= wj AND j < wj + 3 AND k >= wk AND k < wk + 7)"


def _windows(spark, d):
    return W.assign_patches(T.chunks(spark, d), (3, 3, 7), 0.4)


@q("G19_assign_patches", with_sql(f"SELECT {_VOX}, wi, wj, wk FROM {_ASSIGN}", "voxels"))
def _(spark, d):
    return _ints(W.window_voxels(_windows(spark, d)).drop("value"))


@q("G19_cut_windows", with_sql(f"SELECT volume_id, wi, wj, wk, count(*) AS n, round(sum(value * ((i - wi) * 21 + (j - wj) * 7 + k - wk + 1)), 5) + 0.0 AS moment FROM {_ASSIGN} GROUP BY ALL", "voxels"))
def _(spark, d):
    place = F.aggregate(F.zip_with("data", F.sequence(F.lit(1), F.size("data")), lambda v, n: v * n), F.lit(0.0), lambda a, x: a + x)
    return _windows(spark, d).select("volume_id", "wi", "wj", "wk", F.size("data").cast("long").alias("n"), F.round(place, 5).alias("moment"))


@q("G20_blend_patches", with_sql(f"""
  SELECT {_VOX}, round(sum((1 + wk) * (value + wk * 0.01)) / greatest(sum(1 + wk), 1e-5), 6) + 0.0 AS value FROM {_ASSIGN} GROUP BY ALL""", "voxels"))
def _(spark, d):
    preds = _windows(spark, d).withColumn("data", F.transform("data", lambda v: v + F.col("wk") * 0.01)).withColumn("w", 1.0 + F.col("wk"))
    return _ints(_r(V.explode_voxels(W.blend_patches(preds, 4, weight="w")), "value"))


_GAUSS = " * ".join(f"exp(-0.5 * (({a} - w{a} - {(n - 1) / 2}) / {0.125 * n}) ^ 2)" for a, n in zip("ijk", (3, 3, 7)))


@q("U01_predict_whole_patches", with_sql(f"""
  SELECT {_VOX}, round(sum(g * (value - m)) / greatest(sum(g), 1e-5), 6) + 0.0 AS value FROM (
    SELECT *, greatest({_GAUSS}, 0.001) AS g, avg(value) OVER (PARTITION BY volume_id, wi, wj, wk) AS m FROM {_ASSIGN}) GROUP BY ALL""", "voxels"))
def _(spark, d):
    centred = W.predict_patches(_windows(spark, d), lambda x: x - x.mean((1, 2, 3), keepdims=True))
    return _ints(_r(V.explode_voxels(W.blend_patches(centred, 4, W.gaussian_importance)), "value"))


@q("U01_predict_patches", with_sql(f"SELECT {_VOX}, round(value * 2, 6) + 0.0 AS value FROM voxels", "voxels"))
def _(spark, d):
    doubled = W.predict_patches(_windows(spark, d), lambda x: x * 2.0)
    return _ints(_r(V.explode_voxels(W.blend_patches(doubled, 4)), "value"))


@q("U01_padded_patches", with_sql(f"""
  SELECT {_VOX}, round(value - (sum(value) OVER (PARTITION BY volume_id) + 2 * 4 * 16 * 0.5) / (6 * 4 * 16), 6) + 0.0 AS value FROM voxels""", "voxels"))
def _(spark, d):
    roi = (6, 4, 16)
    centred = W.predict_patches(W.assign_patches(T.chunks(spark, d), roi, 0.25), lambda x: x - x.mean((1, 2, 3), keepdims=True), roi=roi, padding="constant", value=0.5)
    return _ints(_r(V.explode_voxels(W.blend_patches(centred, 4)), "value"))


_STEPS = "(SELECT volume_id, patient_id, CAST(day * 30 + volume_id % 7 AS DOUBLE) AS days, row_number() OVER (PARTITION BY patient_id ORDER BY day) AS n, count(*) OVER (PARTITION BY patient_id) AS steps FROM volumes)"


def _sequences(spark, d):
    scans = T.volumes(spark, d).select("volume_id", F.col("patient_id").alias("sequence_id"), F.col("day").alias("step"), (F.col("day") * 30 + F.col("volume_id") % 7).alias("days"))
    return W.assign_sequences(T.chunks(spark, d), scans, (3, 3, 7), 0.4)


def _extrapolated(x, days):
    """The last step, carried on for 30 days at the pace of the last two."""
    return x[-1] + (x[-1] - x[-2]) * 30 / (days[-1] - days[-2]) if len(x) > 1 else x[-1]


@q("U01_predict_sequences", with_sql(f"""
  SELECT l.patient_id AS volume_id, a.i, a.j, a.k, round(a.value + coalesce((a.value - b.value) * 30 / (l.days - p.days), 0), 6) + 0.0 AS value
  FROM {_STEPS} l JOIN voxels a ON a.volume_id = l.volume_id AND l.n = l.steps
  LEFT JOIN {_STEPS} p ON p.patient_id = l.patient_id AND p.n = l.n - 1 LEFT JOIN voxels b ON b.volume_id = p.volume_id AND b.i = a.i AND b.j = a.j AND b.k = a.k""", "voxels", "volumes"))
def _(spark, d):
    return _ints(_r(V.explode_voxels(W.blend_patches(W.predict_sequences(_sequences(spark, d), _extrapolated), 4, W.gaussian_importance)), "value"))


@q("G19_assign_sequences", with_sql(f"""
  SELECT l.patient_id, wi, wj, wk, max(l.steps) AS length, round(sum(v.value * l.n), 5) + 0.0 AS moment, sum(DISTINCT l.days) AS days
  FROM {_ASSIGN} v JOIN {_STEPS} l USING (volume_id) GROUP BY ALL""", "voxels", "volumes"))
def _(spark, d):
    w = _sequences(spark, d).withColumn("_n", F.size("data") / F.col("length"))
    total = F.aggregate(F.transform("data", lambda v, p: v * (F.floor(p / F.col("_n")) + 1)), F.lit(0.0), lambda a, x: a + x)
    days = F.aggregate("days", F.lit(0.0), lambda a, x: a + x)
    return w.select(F.col("sequence_id").alias("patient_id"), "wi", "wj", "wk", F.col("length").cast("long").alias("length"), F.round(total, 5).alias("moment"), days.alias("days"))


@q("V20_crop_large", """
  SELECT vec_id AS volume_id, CAST(64 * 64 * 8 AS BIGINT) AS n, round(sum(4096 * CAST(embedding[k] AS DOUBLE)), 3) + 0.0 AS total
  FROM embeddings, range(4, 12) r(k) GROUP BY vec_id""")
def _(spark, d):
    large = T.large_chunks(spark, d)
    cut = V.crop_range(large, "k", 3, 11).select("volume_id", F.size("data").cast("long").alias("n"), F.aggregate("data", F.lit(0.0), lambda a, x: a + x).alias("total"))
    return _r(cut, "total", digits=3)
