"""Registered queries: anchors, incremental planning and review flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelcohort.operators import anchors as A
from voxelcohort.operators import incremental as I
from voxelcohort.operators import qc as R
from voxelcohort.session import cut_lineage
from voxelcohort.workload import tables as T
from voxelcohort.workload.tables import CTE, with_sql

Q: dict[str, tuple] = {}


def q(name, sql=None):
    def add(fn):
        Q[name] = (fn, sql)
        return fn

    return add


# --- A: anchors -----------------------------------------------------------------------------------

def _rank(by, order):
    return f"row_number() OVER (PARTITION BY {by} ORDER BY {order})"


_PREF = "study_type LIKE '%T2%' DESC, coreg_image IS NOT NULL DESC, metric DESC NULLS LAST, row_id"
CTE["anchored"] = (("review",), f"""
  SELECT r.*, p.row_id AS patient_anchor, t.row_id AS timepoint_anchor,
    CASE WHEN r.row_id = p.row_id THEN 'patient_anchor' WHEN r.row_id = t.row_id THEN 'timepoint_anchor' END AS anchor
  FROM review r
  JOIN (SELECT patient_id, row_id FROM (SELECT *, {_rank('patient_id', _PREF)} AS rn FROM review) WHERE rn = 1) p USING (patient_id)
  JOIN (SELECT patient_id, timepoint, row_id FROM (SELECT *, {_rank('patient_id, timepoint', _PREF)} AS rn FROM review) WHERE rn = 1) t USING (patient_id, timepoint)""")
CTE["flags"] = (("anchored",), """
  SELECT a.*, coalesce(a.patient_id IN (SELECT patient_id FROM anchored WHERE flagged AND anchor = 'patient_anchor')
    OR (a.patient_id, a.timepoint) IN (SELECT (patient_id, timepoint) FROM anchored WHERE flagged AND anchor = 'timepoint_anchor')
    OR (flagged AND anchor IS NULL), false) AS manual FROM anchored a""")

HOW = {"modality": "T2", "prefer_coreg": True}


def anchored(spark, d):
    return A.anchor_roles(A.with_anchors(T.review(spark, d), **HOW))


def flagged(spark, d):
    return R.propagate_flags(anchored(spark, d))


@q("A01_select_anchor", with_sql(f"SELECT patient_id, row_id, metric FROM (SELECT *, {_rank('patient_id', _PREF)} AS rn FROM review) WHERE rn = 1", "review"))
def _(spark, d):
    return A.select_anchor(T.review(spark, d), ["patient_id"], **HOW).select("patient_id", "row_id", "metric")


_CAND = f"(SELECT *, {_rank('patient_id', 'metric DESC NULLS LAST, row_id')} AS attempt FROM review)"


@q("A02_anchor_candidates", with_sql(f"""
  SELECT patient_id, row_id, CAST(attempt AS INT) AS attempt, CAST(min(CASE WHEN coreg_seg IS NOT NULL THEN attempt END) OVER (PARTITION BY patient_id) AS INT) AS succeeded_at
  FROM {_CAND} WHERE attempt <= 5""", "review"))
def _(spark, d):
    r = T.review(spark, d)
    outcomes = r.select("row_id", F.col("coreg_seg").isNotNull().alias("ok"))
    return A.first_success(A.anchor_candidates(r, ["patient_id"]), outcomes, ["patient_id"]).select("patient_id", "row_id", "attempt", "succeeded_at")


@q("A03_failed_attempts", with_sql(f"""
  SELECT patient_id, row_id, CAST(attempt AS INT) AS attempt FROM (
    SELECT *, min(CASE WHEN coreg_seg IS NOT NULL THEN attempt END) OVER (PARTITION BY patient_id) AS won FROM {_CAND} WHERE attempt <= 5)
  WHERE won IS NULL OR attempt < won""", "review"))
def _(spark, d):
    r = T.review(spark, d)
    outcomes = r.select("row_id", F.col("coreg_seg").isNotNull().alias("ok"))
    return A.failed_attempts(A.anchor_candidates(r, ["patient_id"]), outcomes, ["patient_id"]).select("patient_id", "row_id", "attempt")


@q("A04_timepoint_anchors", with_sql("""
  SELECT patient_id, timepoint, row_id, row_id = patient_anchor AS same_as_patient FROM anchored WHERE row_id = timepoint_anchor""", "anchored"))
def _(spark, d):
    r = T.review(spark, d)
    return A.timepoint_anchors(r, A.select_anchor(r, ["patient_id"], **HOW), **HOW).select("patient_id", "timepoint", "row_id", "same_as_patient")


@q("A05_anchor_roles", with_sql("SELECT row_id, anchor FROM anchored", "anchored"))
def _(spark, d):
    return anchored(spark, d).select("row_id", "anchor")


@q("A06_transform_chain", with_sql("""
  SELECT row_id, 'template' || ' ' || patient_anchor || CASE WHEN timepoint_anchor <> patient_anchor THEN ' ' || timepoint_anchor ELSE '' END
    || CASE WHEN row_id <> patient_anchor AND row_id <> timepoint_anchor THEN ' ' || row_id ELSE '' END AS chain FROM anchored""", "anchored"))
def _(spark, d):
    return A.transform_chain(anchored(spark, d)).select("row_id", F.array_join("chain", " ").alias("chain"))


def _edge_matrix():
    """An affine per study: scaling and shift taken from its metric, identity elsewhere."""
    scale, zero, one = 1 + F.col("metric") / 200000, F.lit(0.0), F.lit(1.0)
    shift = [F.col("metric") / 10000 + r for r in range(3)]
    return F.array(scale, zero, zero, shift[0], zero, scale, zero, shift[1], zero, zero, scale, shift[2], zero, zero, zero, one)


@q("A07_compose_chain", with_sql("""
  SELECT row_id, round(coalesce(pa.s, 1) * coalesce(ta.s, 1) * coalesce(me.s, 1), 6) + 0.0 AS scale,
    round(pa.t + pa.s * (coalesce(ta.t, 0) + coalesce(ta.s, 1) * coalesce(me.t, 0)), 6) + 0.0 AS shift
  FROM anchored a
  JOIN (SELECT row_id AS k, 1 + metric / 200000 AS s, metric / 10000 AS t FROM review) pa ON pa.k = a.patient_anchor
  LEFT JOIN (SELECT row_id AS k, 1 + metric / 200000 AS s, metric / 10000 AS t FROM review) ta ON ta.k = a.timepoint_anchor AND a.timepoint_anchor <> a.patient_anchor
  LEFT JOIN (SELECT row_id AS k, 1 + metric / 200000 AS s, metric / 10000 AS t FROM review) me ON me.k = a.row_id AND a.row_id <> a.patient_anchor AND a.row_id <> a.timepoint_anchor""", "anchored"))
def _(spark, d):
    r = T.review(spark, d)
    rows = cut_lineage(A.with_anchors(r, **HOW).select("row_id", "patient_anchor", "timepoint_anchor", "metric"))
    # registrations are a stored result that every hop looks up; their matrices are made after the metric has been joined
    told = A.chain_edges(rows).join(rows.select(F.col("row_id").alias("moving"), "metric"), "moving")
    edges = cut_lineage(told.select("fixed", "moving", _edge_matrix().alias("m")))
    return A.compose_chain(rows, edges).select("row_id", F.round(F.get("m", 0), 6).alias("scale"), F.round(F.get("m", 3), 6).alias("shift"))


@q("A08_resume_template", with_sql(f"""
  SELECT r.row_id, t.row_id AS template FROM review r
  LEFT JOIN (SELECT patient_id, row_id FROM (SELECT *, {_rank('patient_id', "study_type LIKE '%T2%' DESC, metric DESC NULLS LAST, row_id")} AS rn FROM review WHERE coreg_seg IS NOT NULL) WHERE rn = 1) t USING (patient_id)
  WHERE r.coreg_seg IS NULL""", "review"))
def _(spark, d):
    return A.resume_template(T.review(spark, d), modality="T2").select("row_id", "template")


# --- I: incremental ---------------------------------------------------------------------------------

_OLD = "version IS DISTINCT FROM 'A'"
_GROUP = "(PARTITION BY patient_id, timepoint)"
_MODE_SQL = {
    "skip_all": (f"bool_and(coreg_image IS NOT NULL) OVER {_GROUP}", "true"),
    "process_new": (f"bool_and(coreg_image IS NOT NULL) OVER {_GROUP}", "coreg_image IS NULL"),
    "smart": (f"bool_and(coreg_image IS NOT NULL AND NOT {_OLD}) OVER {_GROUP}", f"(coreg_image IS NULL OR {_OLD})"),
    "force_reprocess": ("false", "true"),
}


@q("I01_plan_incremental", with_sql(" UNION ALL ".join(
    f"SELECT '{m}' AS mode, row_id, skipped, NOT skipped AND todo AS process FROM (SELECT row_id, {s} AS skipped, {t} AS todo FROM review)" for m, (s, t) in _MODE_SQL.items()), "review"))
def _(spark, d):
    r = T.review(spark, d)
    plans = [I.plan_incremental(r, m, "A", ["patient_id", "timepoint"]).select(F.lit(m).alias("mode"), "row_id", "skipped", "process") for m in I.MODES]
    out = plans[0]
    for p in plans[1:]:
        out = out.unionByName(p)
    return out


@q("I02_outdated", with_sql(f"SELECT row_id FROM review WHERE coreg_image IS NOT NULL AND {_OLD}", "review"))
def _(spark, d):
    return I.outdated(T.review(spark, d), "A").select("row_id")


CTE["intake"] = (("series",), """
  SELECT series_id, patient_id, CASE WHEN study_type = 'DWI' THEN series_id || '.dcm' ELSE 'in/' || series_id || '.nii.gz' END AS image_path, file_size_mb FROM series""")
CTE["outputs"] = (("series",), """
  SELECT series_id || '_bet.nii.gz' AS name FROM series WHERE coreg_image IS NOT NULL
  UNION ALL SELECT series_id || '_mask.nii.gz' FROM series WHERE coreg_seg IS NOT NULL""")
_PLAN = """
  SELECT series_id, CASE WHEN image_path LIKE '%.dcm' THEN 'unsupported_extension' WHEN m IS NOT NULL THEN 'already_processed'
    WHEN file_size_mb < 15 THEN 'missing_file' END AS reason, CASE WHEN image_path NOT LIKE '%.dcm' THEN m END AS matched
  FROM (SELECT i.*, o.m FROM intake i LEFT JOIN (
    SELECT regexp_replace(name, '_(bet|mask)\\.nii\\.gz$', '') AS series_id, string_agg(name, ';' ORDER BY name) AS m FROM outputs GROUP BY 1) o USING (series_id))"""


def intake(spark, d):
    s = T.series(spark, d)
    name = F.when(F.col("study_type") == "DWI", F.concat("series_id", F.lit(".dcm"))).otherwise(F.concat(F.lit("in/"), "series_id", F.lit(".nii.gz")))
    rows = s.select("series_id", "patient_id", name.alias("image_path"), "file_size_mb")
    outputs = s.filter("coreg_image IS NOT NULL").select(F.concat("series_id", F.lit("_bet.nii.gz")).alias("name")).unionByName(
        s.filter("coreg_seg IS NOT NULL").select(F.concat("series_id", F.lit("_mask.nii.gz")).alias("name")))
    present = rows.filter("file_size_mb >= 15").select(F.col("image_path").alias("path"))
    return rows, outputs, present


@q("I03_plan_todo", with_sql(_PLAN, "intake", "outputs"))
def _(spark, d):
    return I.plan_todo(*intake(spark, d), row_id="series_id").select("series_id", "reason", "matched")


@q("I04_skip_reasons", with_sql(f"SELECT reason, count(*) AS n FROM ({_PLAN}) WHERE reason IS NOT NULL GROUP BY reason", "intake", "outputs"))
def _(spark, d):
    return I.skip_reasons(I.plan_todo(*intake(spark, d), row_id="series_id"))


@q("I05_pending", with_sql("""
  SELECT series_id FROM intake WHERE series_id NOT IN (SELECT series_id FROM series WHERE study_type <> 'DWI' AND coreg_image IS NOT NULL)
    AND series_id NOT IN (SELECT series_id FROM series WHERE file_size_mb < 5)""", "intake", "series"))
def _(spark, d):
    rows, outputs, _p = intake(spark, d)
    return I.pending(rows, outputs, rows.filter("file_size_mb < 5"), "series_id").select("series_id")


CTE["updates"] = (("series",), """
  SELECT series_id, event_id AS seq, 'coreg_image' AS col, 'new/' || series_id AS value FROM series WHERE study_type = 'T1_post'
  UNION ALL SELECT series_id, event_id + 1, 'coreg_image', CASE WHEN seg_path IS NOT NULL THEN 'newer/' || series_id END FROM series WHERE study_type = 'T1_post' AND file_size_mb < 60
  UNION ALL SELECT series_id, event_id, 'preprocessing_version', 'v9' FROM series WHERE study_type = 'DWI'
  UNION ALL SELECT 'X' || series_id, event_id, 'preprocessing_version', 'v9' FROM series""")


def _updates(s):
    def part(cond, shift, col, value, rid=F.col("series_id")):
        return s.filter(cond).select(rid.alias("series_id"), (F.col("event_id") + shift).alias("seq"), F.lit(col).alias("column"), value.alias("value"))

    return (
        part("study_type = 'T1_post'", 0, "coreg_image", F.concat(F.lit("new/"), "series_id"))
        .unionByName(part("study_type = 'T1_post' AND file_size_mb < 60", 1, "coreg_image", F.when(F.col("seg_path").isNotNull(), F.concat(F.lit("newer/"), "series_id"))))
        .unionByName(part("study_type = 'DWI'", 0, "preprocessing_version", F.lit("v9")))
        .unionByName(part("true", 0, "preprocessing_version", F.lit("v9"), F.concat(F.lit("X"), "series_id")))
    )


@q("I06_apply_updates", with_sql("""
  SELECT s.series_id, CASE WHEN c.series_id IS NOT NULL THEN c.value ELSE s.coreg_image END AS coreg_image,
    CASE WHEN v.series_id IS NOT NULL THEN v.value ELSE s.preprocessing_version END AS preprocessing_version
  FROM series s
  LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY seq DESC) AS rn FROM updates WHERE col = 'coreg_image') WHERE rn = 1) c USING (series_id)
  LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY seq DESC) AS rn FROM updates WHERE col = 'preprocessing_version') WHERE rn = 1) v USING (series_id)""", "series", "updates"))
def _(spark, d):
    s = T.series(spark, d)
    cols = ["coreg_image", "preprocessing_version"]
    return I.apply_updates(s, _updates(s), cols, "series_id").select("series_id", *cols)


@q("I07_overlay_checkpoint", with_sql("""
  SELECT series_id, CASE WHEN file_size_mb >= 50 THEN (CASE WHEN study_type <> 'DWI' THEN 'saved' END) ELSE preprocessing_version END AS preprocessing_version FROM series""", "series"))
def _(spark, d):
    s = T.series(spark, d)
    saved = s.filter("file_size_mb >= 50").select("series_id", F.when(F.col("study_type") != "DWI", "saved").alias("preprocessing_version"))
    return I.overlay_checkpoint(s, saved, ["preprocessing_version"], "series_id").select("series_id", "preprocessing_version")


@q("I08_remaining_groups", with_sql("SELECT series_id FROM series WHERE patient_id NOT IN (SELECT patient_id FROM series WHERE file_size_mb >= 300)", "series"))
def _(spark, d):
    s = T.series(spark, d)
    return I.remaining_groups(s, s.filter("file_size_mb >= 300")).select("series_id")


CTE["errors"] = (("review",), """
  SELECT 'row' AS grain, patient_id, row_id AS key, 'bad discount' AS message FROM review WHERE flagged
  UNION ALL SELECT 'timepoint', patient_id, CAST(timepoint AS VARCHAR), 'late' FROM review WHERE metric > 100000
  UNION ALL SELECT 'patient', patient_id, CAST(patient_id AS VARCHAR), 'lost ' || study_type FROM review WHERE metric < 1000""")
_ATTR = """
  SELECT r.*, coalesce(e.m, t.m, p.m) AS error_details FROM review r
  LEFT JOIN (SELECT key, max(message) AS m FROM errors WHERE grain = 'row' GROUP BY key) e ON e.key = r.row_id
  LEFT JOIN (SELECT patient_id, key, max(message) AS m FROM errors WHERE grain = 'timepoint' GROUP BY ALL) t ON t.key = CAST(r.timepoint AS VARCHAR) AND t.patient_id = r.patient_id
  LEFT JOIN (SELECT key, max(message) AS m FROM errors WHERE grain = 'patient' GROUP BY key) p ON p.key = CAST(r.patient_id AS VARCHAR)"""


def _attributed(spark, d, rows=None):
    r = T.review(spark, d)

    def part(cond, grain, key, message):
        return r.filter(cond).select(F.lit(grain).alias("grain"), "patient_id", F.col(key).cast("string").alias("key"), message.alias("message"))

    errors = (
        part("flagged", "row", "row_id", F.lit("bad discount"))
        .unionByName(part("metric > 100000", "timepoint", "timepoint", F.lit("late")))
        .unionByName(part("metric < 1000", "patient", "patient_id", F.concat(F.lit("lost "), "study_type")))
    )
    return I.attribute_errors(r if rows is None else rows, errors)


@q("I09_attribute_errors", with_sql(f"SELECT row_id, error_details FROM ({_ATTR})", "review", "errors"))
def _(spark, d):
    return _attributed(spark, d).select("row_id", "error_details")


@q("I10_run_summary", with_sql(f"""
  SELECT count(*) AS n_rows, count(*) FILTER (anchor = 'patient_anchor') AS n_patient_anchors, count(*) FILTER (anchor = 'timepoint_anchor') AS n_timepoint_anchors,
    count(coreg_image) AS n_coreg_images, count(coreg_seg) AS n_coreg_segs, (SELECT count(error_details) FROM ({_ATTR})) AS n_errors FROM anchored""", "anchored", "review", "errors"))
def _(spark, d):
    return I.run_summary(_attributed(spark, d, anchored(spark, d)))


@q("I11_outcome_counts", with_sql(f"""
  SELECT CASE WHEN coreg_image IS NOT NULL THEN 'skipped' WHEN error_details IS NOT NULL THEN 'error' ELSE 'success' END AS outcome, count(*) AS n
  FROM ({_ATTR}) GROUP BY 1""", "review", "errors"))
def _(spark, d):
    return I.outcome_counts(_attributed(spark, d).withColumn("skipped", F.col("coreg_image").isNotNull()))


@q("I12_error_report", with_sql(f"""
  SELECT row_id, error_details, n_errors, n_total FROM (SELECT *, count(error_details) OVER () AS n_errors, count(*) OVER () AS n_total FROM ({_ATTR})) WHERE error_details IS NOT NULL""", "review", "errors"))
def _(spark, d):
    return I.error_report(_attributed(spark, d)).select("row_id", "error_details", "n_errors", "n_total")


# --- Q: review flags ---------------------------------------------------------------------------------

@q("Q01_propagate_flags", with_sql("SELECT row_id, manual FROM flags", "flags"))
def _(spark, d):
    return flagged(spark, d).select("row_id", "manual")


@q("Q02_route", with_sql("""
  SELECT row_id, CASE WHEN manual THEN 'manual_correction' ELSE 'acceptable' END AS category,
    CASE WHEN manual THEN 'manual_correction/' ELSE 'acceptable/' END || substr(coreg_image, 5) AS dest FROM flags""", "flags"))
def _(spark, d):
    return R.route(flagged(spark, d)).select("row_id", "category", "dest")


@q("Q03_flag_sources", with_sql("""
  SELECT count(*) AS n_flagged, count(*) FILTER (anchor = 'patient_anchor') AS n_patient_anchor, count(*) FILTER (anchor = 'timepoint_anchor') AS n_timepoint_anchor,
    count(*) FILTER (anchor IS NULL) AS n_individual FROM anchored WHERE flagged""", "anchored"))
def _(spark, d):
    return R.flag_sources(anchored(spark, d))


@q("Q04_category_share", with_sql("""
  SELECT CASE WHEN manual THEN 'manual_correction' ELSE 'acceptable' END AS category, count(*) AS n_rows,
    round(100.0 * count(*) / sum(count(*)) OVER (), 6) + 0.0 AS percent FROM flags GROUP BY 1""", "flags"))
def _(spark, d):
    return R.category_share(flagged(spark, d)).withColumn("percent", F.round("percent", 6))


@q("Q05_category_by_type", with_sql("""
  SELECT study_type, count(*) FILTER (NOT manual) AS acceptable, count(*) FILTER (manual) AS manual_correction, count(*) AS total FROM flags GROUP BY ROLLUP (study_type)""", "flags"))
def _(spark, d):
    return R.category_by_type(flagged(spark, d))


@q("Q06_manual_per_patient", with_sql("""
  SELECT count(*) AS n_patients, min(n) AS min_rows, max(n) AS max_rows, round(avg(n), 6) + 0.0 AS mean_rows FROM (SELECT patient_id, count(*) AS n FROM flags WHERE manual GROUP BY 1)""", "flags"))
def _(spark, d):
    return R.manual_per_patient(flagged(spark, d)).withColumn("mean_rows", F.round("mean_rows", 6))


@q("Q07_missing_by_kind", with_sql("""
  SELECT kind, count(*) AS n FROM (SELECT 'image' AS kind, coreg_image AS path FROM review UNION ALL SELECT 'seg', coreg_seg FROM review)
  WHERE path IS NOT NULL AND path NOT IN (SELECT coreg_image FROM review WHERE coreg_image IS NOT NULL AND metric > 50000
    UNION ALL SELECT coreg_seg FROM review WHERE coreg_seg IS NOT NULL AND metric > 80000) GROUP BY kind""", "review"))
def _(spark, d):
    r = T.review(spark, d).withColumn("overlay", F.lit(None).cast("string"))
    there = r.filter("metric > 50000").select(F.col("coreg_image").alias("path")).unionByName(r.filter("metric > 80000").select(F.col("coreg_seg").alias("path")))
    return R.missing_by_kind(r, there.filter("path IS NOT NULL"))
