"""Registered queries: linkage and cohort operators on the series manifest."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelcohort.functions import paths as P
from voxelcohort.functions.similarity import seq_ratio
from voxelcohort.operators import cohort as C
from voxelcohort.operators import linkage as L
from voxelcohort.workload import tables as T
from voxelcohort.workload.tables import with_sql

TYPES = ["DWI", "T1_post", "T2_FLAIR", "t1 pre", "t2_thin"]
_COLS = ["series_id", "study_type", "study_labels"]

Q: dict[str, tuple] = {}


def q(name, sql=None):
    def add(fn):
        Q[name] = (fn, sql)
        return fn

    return add


# --- L: linkage ---------------------------------------------------------------------------------

_CLEAN = r"array_to_string(list_transform(list_filter(string_split(replace(path, '\', '/'), '/'), lambda x: x <> ''), lambda x: {f}), '/')"


@q("L01_clean_path", with_sql("SELECT page_id, " + _CLEAN.format(f=r"regexp_replace(x, '^\s+', '')") + " AS cleaned, "
   + _CLEAN.format(f="trim(x)") + " AS trimmed FROM paths", "paths"))
def _(spark, d):
    return T.paths(spark, d).select("page_id", P.clean_path("path").alias("cleaned"), P.clean_path("path", True).alias("trimmed"))


@q("L02_clean_path_strict", with_sql(r"""
  SELECT page_id, nullif(CASE WHEN regexp_matches(p, '^//([^/]|$)') THEN '//' WHEN starts_with(p, '/') THEN '/' ELSE '' END ||
    array_to_string(list_filter(list_transform(list_filter(string_split(p, '/'), lambda x: x <> '' AND x <> '.'),
      lambda x: regexp_replace(trim(x), '\.+$', '')), lambda x: x <> ''), '/'), '') AS cleaned
  FROM (SELECT page_id, regexp_replace(path, '[ .\t]+$', '') AS p FROM paths)""", "paths"))
def _(spark, d):
    return T.paths(spark, d).select("page_id", P.clean_path_strict("path").alias("cleaned"))


@q("L03_abs_path", with_sql(r"""SELECT page_id, '/data/VS_batch' || (page_id % 3) || '/' || regexp_replace(path, '^/+', '') AS abs_path FROM paths""", "paths"))
def _(spark, d):
    return T.paths(spark, d).select("page_id", P.abs_path("/data", F.col("page_id") % 3, "path").alias("abs_path"))


@q("L04_split_by_existence", with_sql("""
  SELECT series_id, image_path IN (SELECT path FROM files) AS found FROM series""", "series", "files"))
def _(spark, d):
    ok, bad = L.split_by_existence(T.series(spark, d), T.files(spark, d), "image_path")
    return ok.select("series_id", F.lit(True).alias("found")).unionByName(bad.select("series_id", F.lit(False).alias("found")))


def _mask_asks(spark, d):
    """Mask paths as a careless manifest would spell them: blanks, capitals and a lost letter."""
    s = T.series(spark, d).filter("seg_path IS NOT NULL")
    name = P.base_name("seg_path")
    spelled = F.when(F.col("scan_order") % 3 == 0, F.replace(name, F.lit("seg_"), F.lit("Seg "))).when(
        F.col("scan_order") % 3 == 1, F.replace(name, F.lit("uva"), F.lit(""))).otherwise(name)
    return s.select("series_id", F.concat(P.parent_dir("seg_path"), F.lit("/"), spelled).alias("path"), F.when(F.col("scan_order") % 6 == 0, name).otherwise("other.nii").alias("mask_name"), "seg_path")


_ASK_SQL = """
  SELECT a.series_id, CASE WHEN f.path IS NOT NULL THEN a.seg_path END AS resolved
  FROM (SELECT series_id, seg_path FROM series WHERE seg_path IS NOT NULL) a LEFT JOIN files f ON f.path = a.seg_path"""


@q("L05_repair_in_parent", with_sql(_ASK_SQL, "series", "files"))
def _(spark, d):
    return L.repair_in_parent(_mask_asks(spark, d), T.files(spark, d), "series_id").select("series_id", "resolved")


@q("L06_repair_path")
def _(spark, d):
    asks = _mask_asks(spark, d).withColumn("path", F.replace("path", F.lit("raw_studies"), F.lit("Raw_Studies")))
    roots = asks.withColumn("path", F.concat(F.lit("vault/"), "path"))
    inv = T.files(spark, d).withColumn("path", F.concat(F.lit("vault/"), "path"))
    return L.repair_path(roots, inv, "series_id").select("series_id", F.expr("substring(resolved, 7)").alias("resolved"))


@q("L06_repair_case", with_sql("""
  SELECT series_id, CASE WHEN seg_path IN (SELECT path FROM files) THEN seg_path END AS resolved FROM series WHERE seg_path IS NOT NULL""", "series", "files"))
def _(spark, d):
    # existing paths in another case have one candidate a component; the others start in a folder unlike any
    s = T.series(spark, d).filter("seg_path IS NOT NULL").select("series_id", F.col("seg_path").alias("path"))
    inv = T.files(spark, d).select("path").distinct()
    there = s.join(inv, "path", "left_semi").withColumn("path", F.concat(F.lit("vault/"), F.upper("path")))
    gone = s.join(inv, "path", "left_anti").withColumn("path", F.concat(F.lit("0000/"), "path"))
    vault = T.files(spark, d).withColumn("path", F.concat(F.lit("vault/"), "path"))
    return L.repair_path(there.unionByName(gone), vault, "series_id").select("series_id", F.expr("substring(resolved, 7)").alias("resolved"))


@q("L07_seq_ratio")
def _(spark, d):
    s = T.series(spark, d).filter("seg_path IS NOT NULL")
    return s.select("series_id", F.round(seq_ratio(P.base_name("seg_path"), P.base_name("image_path")), 6).alias("ratio"))


@q("L08_recover", with_sql(_ASK_SQL, "series", "files"))
def _(spark, d):
    ok, bad = L.recover(_mask_asks(spark, d), T.files(spark, d), "series_id")
    return ok.select("series_id", F.col("path").alias("resolved")).unionByName(bad.select("series_id", F.lit(None).cast("string").alias("resolved")))


@q("L09_clean_timeline", with_sql("SELECT accession, tracker FROM timeline WHERE tracker <> '.'", "timeline"))
def _(spark, d):
    return L.clean_timeline(T.timeline(spark, d))


@q("L10_split_tracker", with_sql("""
  SELECT accession, split_part(tracker, '_', 1) AS patient_id, try_cast(nullif(split_part(tracker, '_', 2), '') AS BIGINT) AS scan_order,
    try_cast(nullif(split_part(tracker, '_', 3), '') AS BIGINT) AS days FROM timeline""", "timeline"))
def _(spark, d):
    return L.split_tracker(T.timeline(spark, d)).drop("tracker")


@q("L11_split_patient_timepoint", with_sql("""
  SELECT accession, split_part(tracker, '_', 1) AS patient_id, CASE WHEN contains(tracker, '_') THEN substr(tracker, strpos(tracker, '_') + 1) END AS timepoint FROM timeline""", "timeline"))
def _(spark, d):
    return L.split_patient_timepoint(T.timeline(spark, d)).drop("tracker")


@q("L12_link_timeline", with_sql("SELECT s.series_id, t.tracker FROM series s JOIN timeline t USING (accession)", "series", "timeline"))
def _(spark, d):
    return L.link_timeline(T.timeline(spark, d), T.series(spark, d).drop("tracker")).select("series_id", "tracker")


@q("L13_unmatched", with_sql("SELECT series_id FROM series WHERE accession NOT IN (SELECT accession FROM timeline WHERE tracker <> '.')", "series", "timeline"))
def _(spark, d):
    s = T.series(spark, d)
    linked = L.link_timeline(L.clean_timeline(T.timeline(spark, d)), s.drop("tracker"))
    return L.unmatched(s, linked).select("series_id")


@q("L14_order_scans", with_sql("SELECT patient_id, scan_order, series_id FROM series ORDER BY patient_id, scan_order", "series"))
def _(spark, d):
    return L.order_scans(T.series(spark, d).select("patient_id", "scan_order", "series_id"))


@q("L15_canonicalise", with_sql("SELECT patient_id, study_type, image_path FROM series", "series"))
def _(spark, d):
    raw = T.series(spark, d).withColumnsRenamed({"patient_id": "Patient_ID ", "study_type": "Study Type"})
    return L.canonicalise(raw, {"Patient_ID": "patient_id", "Study Type": "study_type"}, ["patient_id", "study_type", "image_path", "absent"])


@q("L16_first_present", with_sql("SELECT series_id, coalesce(coreg_seg, seg_path) AS seg FROM series", "series"))
def _(spark, d):
    s = T.series(spark, d)
    return s.select("series_id", L.first_present(s, ["segmentation path", "coreg_seg", "seg_path"]).alias("seg"))


@q("L17_drop_phi", with_sql("SELECT series_id, study_type FROM series", "series"))
def _(spark, d):
    return L.drop_phi(T.series(spark, d).select("series_id", "study_type", "patient_id", "accession"), ["patient_id", "accession", "Patient Name"])


@q("L18_safe_id", "SELECT page_id, coalesce(nullif(regexp_replace(trim(url), '[^A-Za-z0-9._-]+', '_', 'g'), ''), 'case') AS id FROM pages")
def _(spark, d):
    return T.table(spark, d, "pages").select("page_id", P.safe_id("url").alias("id"))


@q("L19_stable_seed", "SELECT page_id, CAST('0x' || substr(sha256(url), 1, 8) AS BIGINT) AS seed FROM pages")
def _(spark, d):
    return T.table(spark, d, "pages").select("page_id", P.stable_seed("url").alias("seed"))


@q("L20_geometry_key", with_sql("SELECT series_id, md5(concat_ws('_', patient_id, study_type, CAST(scan_order AS VARCHAR))) AS key FROM series", "series"))
def _(spark, d):
    return T.series(spark, d).select("series_id", P.geometry_key("patient_id", "study_type", "scan_order").alias("key"))


@q("L21_strip_ext", with_sql(r"SELECT series_id, regexp_replace(image_path, '\.nii(\.gz)?$', '') AS base FROM series", "series"))
def _(spark, d):
    return T.series(spark, d).select("series_id", P.strip_ext("image_path").alias("base"))


@q("L22_expected_outputs", with_sql("""
  SELECT series_id, base || s AS output FROM (SELECT series_id, replace(image_path, '.nii.gz', '') AS base FROM series),
    (VALUES ('_bet.nii.gz'), ('_bet_mask.nii.gz'), ('_mask.nii.gz')) t(s)""", "series"))
def _(spark, d):
    s = T.series(spark, d).select("series_id", P.strip_ext("image_path").alias("base"))
    return L.expected_outputs(s, "base").select("series_id", "output")


@q("L23_result_path", with_sql("""
  SELECT series_id, CASE WHEN coreg_image IS NOT NULL THEN 'done/' || patient_id || '/' || event_id || '/image_coregistered.nii.gz' END AS result FROM series""", "series"))
def _(spark, d):
    s = T.series(spark, d)
    made = s.filter("coreg_image IS NOT NULL").select(P.registered_path("image_path", "done").alias("path"))
    return L.result_path(s.withColumn("image_path", F.replace("image_path", F.lit("raw_s"), F.lit("Raw_S"))), made, "done").select("series_id", "result")


@q("L24_organised_path", with_sql("""
  SELECT series_id, 'out/' || study_type || '/' || tracker || '/' || tracker || '_' || study_type || '_image.nii.gz' AS dest FROM series""", "series"))
def _(spark, d):
    return T.series(spark, d).select("series_id", P.organised_path("out", "study_type", "tracker", "image_path").alias("dest"))


@q("L25_discover_files", with_sql("""
  SELECT s.series_id, max(CASE WHEN f.path LIKE '%/image.nii.gz' THEN f.path END) AS image,
    max(CASE WHEN f.path LIKE '%uvauser%' THEN f.path END) AS segmentation, count(CASE WHEN f.path LIKE '%uvauser%' THEN 1 END) > 1 AS multiple
  FROM series s LEFT JOIN files f ON regexp_replace(s.image_path, '/[^/]*$', '') = regexp_replace(f.path, '/[^/]*$', '')
  GROUP BY s.series_id""", "series", "files"))
def _(spark, d):
    s = T.series(spark, d).withColumn("dir", P.parent_dir("image_path"))
    return L.discover_files(s, T.files(spark, d)).select("series_id", "image", "segmentation", "multiple")


def _scan_dirs(spark, d):
    s = T.scans(spark, d).select("scan_id", F.concat(F.lit("data/"), "patient_id", F.lit("/"), "scan_id").alias("dir"), "turn")
    f = lambda cond, name: s.filter(cond).select(F.concat("dir", F.lit("/"), name).alias("path"))
    files = (
        f("turn <> 3", F.concat("scan_id", F.lit("_T1p_pre_tpl.nii.gz")))
        .unionByName(f("turn < 3", F.concat("scan_id", F.lit("_T1_pre.nii.gz"))))
        .unionByName(f("turn < 5", F.lit("old_mask.nii.gz")))
        .unionByName(f("turn < 2", F.concat("scan_id", F.lit("_seg_tpl.nii.gz"))))
    )
    return s, files


@q("L26_resolve_scan_files", with_sql("""
  SELECT scan_id, CASE WHEN turn < 3 THEN p || '_T1_pre.nii.gz' WHEN turn <> 3 THEN p || '_T1p_pre_tpl.nii.gz' END AS image,
    CASE WHEN turn < 2 THEN p || '_seg_tpl.nii.gz' WHEN turn < 5 THEN d || 'old_mask.nii.gz' END AS label
  FROM (SELECT *, 'data/' || patient_id || '/' || scan_id || '/' AS d, 'data/' || patient_id || '/' || scan_id || '/' || scan_id AS p FROM scans)""", "scans"))
def _(spark, d):
    return L.resolve_scan_files(*_scan_dirs(spark, d)).select("scan_id", "image", "label")


@q("L27_resolve_relative", with_sql("""
  SELECT series_id, CASE WHEN image_path IN (SELECT path FROM files) THEN '/data/' || image_path END AS resolved FROM series""", "series", "files"))
def _(spark, d):
    s = T.series(spark, d).withColumn("path", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("./"), "image_path")).otherwise(F.concat(F.lit("/data/"), "image_path")))
    inv = T.files(spark, d).withColumn("path", F.concat(F.lit("/data/"), "path"))
    return L.resolve_relative(s, inv, "/data").select("series_id", "resolved")


# --- C: cohort ------------------------------------------------------------------------------------

@q("C01_keep_types", with_sql("SELECT series_id, study_type, study_labels FROM series WHERE study_type IN ('T1_post', 't2_thin')", "series"))
def _(spark, d):
    return C.keep_types(T.series(spark, d), ["T1_post", "t2_thin"]).select(*_COLS)


@q("C02_require_labels", with_sql("SELECT series_id, study_type, study_labels FROM series WHERE study_labels ILIKE '%view%' AND study_labels ILIKE '%QC1%'", "series"))
def _(spark, d):
    return C.require_labels(T.series(spark, d), ["view", "QC1"]).select(*_COLS)


@q("C03_exclude_labels", with_sql("SELECT series_id, study_type, label FROM (SELECT *, CASE WHEN study_type <> 'DWI' THEN study_labels END AS label FROM series) WHERE coalesce(label NOT ILIKE '%qc2%', true)", "series"))
def _(spark, d):
    s = T.series(spark, d).withColumn("label", F.when(F.col("study_type") != "DWI", F.col("study_labels")))
    return C.exclude_labels(s, ["QC2"], "label").select("series_id", "study_type", "label")


@q("C04_exclude_values", with_sql("SELECT series_id, preprocessing_version FROM series WHERE preprocessing_version IS NULL OR preprocessing_version NOT IN ('v1')", "series"))
def _(spark, d):
    return C.exclude_values(T.series(spark, d), ["v1"], "preprocessing_version").select("series_id", "preprocessing_version")


@q("C05_exclude_regex", with_sql("SELECT series_id, seg_path FROM series WHERE seg_path IS NOT NULL AND NOT regexp_matches(seg_path, '(?i)UVAUSER[12]')", "series"))
def _(spark, d):
    return C.exclude_regex(T.series(spark, d), "UVAUSER[12]", "seg_path").select("series_id", "seg_path")


@q("C06_split_kind", with_sql("""
  SELECT kind, CAST(count(*) AS BIGINT) AS n, min(path) AS first_path FROM (
    SELECT 'image' AS kind, image_path AS path FROM series UNION ALL SELECT 'mask', path FROM mask_rows) GROUP BY kind""", "series", "mask_rows"))
def _(spark, d):
    manifest = T.series(spark, d).select(F.lit("MRI").alias("file_type"), F.col("image_path").alias("path")).unionByName(
        T.mask_rows(spark, d).select(F.lit("mask").alias("file_type"), "path"))
    images, masks = C.split_kind(manifest)
    both = images.withColumn("kind", F.lit("image")).unionByName(masks.withColumn("kind", F.lit("mask")))
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path"))


@q("C07_flag_multiple", with_sql("SELECT path, count(*) OVER (PARTITION BY accession) AS n_masks, count(*) OVER (PARTITION BY accession) > 1 AS multiple_masks FROM mask_rows", "mask_rows"))
def _(spark, d):
    return C.flag_multiple(T.mask_rows(spark, d), ["accession"]).select("path", "n_masks", "multiple_masks")


_PRIO = """CASE WHEN lower(trim(coalesce(mask_user, ''))) = 'admin' AND contains(lower(study_labels), 'qc1') THEN 0
  WHEN regexp_matches(lower(coalesce(mask_user, '')), '(uva)?user\\d+') THEN 100 + CAST(regexp_extract(lower(mask_user), '(?:uva)?user(\\d+)', 1) AS INT) ELSE 9999 END"""


@q("C08_mask_priority", with_sql(f"SELECT path, {_PRIO} AS priority FROM mask_rows", "mask_rows"))
def _(spark, d):
    return T.mask_rows(spark, d).select("path", C.mask_priority().alias("priority"))


_BEST = f"SELECT accession, path, mask_user FROM (SELECT *, row_number() OVER (PARTITION BY accession ORDER BY {_PRIO}, path) AS rn FROM mask_rows) WHERE rn = 1"


@q("C09_pick_best_mask", with_sql(_BEST, "mask_rows"))
def _(spark, d):
    return C.pick_best_mask(T.mask_rows(spark, d), ["accession"]).select("accession", "path", "mask_user")


@q("C10_list_masks", with_sql("SELECT accession, row_number() OVER (PARTITION BY accession ORDER BY path) AS position, path FROM mask_rows WHERE path IS NOT NULL", "mask_rows"))
def _(spark, d):
    return C.list_masks(T.mask_rows(spark, d), ["accession"])


@q("C11_attach_masks", with_sql(f"SELECT s.series_id, b.path AS mask_path FROM series s LEFT JOIN ({_BEST}) b USING (accession)", "series", "mask_rows"))
def _(spark, d):
    best = C.pick_best_mask(T.mask_rows(spark, d), ["accession"]).select("accession", F.col("path").alias("mask_path"))
    return C.attach_masks(T.series(spark, d), best, ["accession"]).select("series_id", "mask_path")


@q("C12_modality", with_sql("SELECT series_id, CASE WHEN lower(study_type) LIKE 't1%' THEN 't1' ELSE 't2' END AS modality FROM series", "series"))
def _(spark, d):
    return T.series(spark, d).select("series_id", P.modality("study_type").alias("modality"))


_KIND = "CASE WHEN regexp_matches(lower({c}), '^t[12]') THEN substr(lower({c}), 1, 2) ELSE lower({c}) END"


@q("C13_pair_metric", with_sql(f"""
  SELECT a.series_id, CASE WHEN {_KIND.format(c='a.study_type')} = {_KIND.format(c='f.study_type')} THEN 'GC' ELSE 'mattes' END AS metric
  FROM series a JOIN (SELECT patient_id, arg_min(study_type, event_id) AS study_type FROM series GROUP BY patient_id) f USING (patient_id)""", "series"))
def _(spark, d):
    s = T.series(spark, d)
    fixed = s.groupBy("patient_id").agg(F.min_by("study_type", "event_id").alias("fixed_type"))
    return s.join(fixed, "patient_id").select("series_id", P.pair_metric("fixed_type", "study_type").alias("metric"))


@q("C14_limit_patients", with_sql("SELECT series_id FROM series WHERE patient_id IN (SELECT DISTINCT patient_id FROM series ORDER BY 1 LIMIT 5)", "series"))
def _(spark, d):
    return C.limit_patients(T.series(spark, d), 5).select("series_id")


@q("C15_limit_rows", with_sql("SELECT series_id FROM series ORDER BY series_id LIMIT 100", "series"))
def _(spark, d):
    return C.limit_rows(T.series(spark, d), 100, "series_id").select("series_id")


@q("C16_value_counts", with_sql("SELECT study_type, count(*) AS n FROM series GROUP BY 1 ORDER BY 2 DESC, 1", "series"))
def _(spark, d):
    return C.value_counts(T.series(spark, d), "study_type")


@q("C17_n_distinct", with_sql("SELECT count(DISTINCT patient_id) AS n_patient_id, count(DISTINCT tracker) AS n_tracker FROM series", "series"))
def _(spark, d):
    return C.n_distinct(T.series(spark, d), ["patient_id", "tracker"])


def _has(prefix, cond=""):
    return ", ".join(f"bool_or(study_type = '{t}'{cond}) AS \"{prefix}_{t}\"" for t in TYPES)


@q("C18_presence_matrix", with_sql(f"SELECT tracker, {_has('has')} FROM series GROUP BY tracker", "series"))
def _(spark, d):
    return C.presence_matrix(T.series(spark, d), TYPES)


_SEG = f"SELECT tracker, {_has('has')}, {_has('seg', ' AND seg_path IS NOT NULL')} FROM series GROUP BY tracker"


@q("C19_presence_with_seg", with_sql(_SEG, "series"))
def _(spark, d):
    return C.presence_matrix(T.series(spark, d), TYPES, with_seg=True)


@q("C20_with_both", with_sql(f'SELECT tracker FROM ({_SEG}) WHERE "seg_T1_post" AND "seg_t2_thin"', "series"))
def _(spark, d):
    return C.with_both(C.presence_matrix(T.series(spark, d), TYPES, with_seg=True), "seg_T1_post", "seg_t2_thin").select("tracker")
