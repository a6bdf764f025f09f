"""Registered queries: sequences, batches, experiments."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelcohort.operators import experiments as E
from voxelcohort.operators import sequences as S
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


_W = "OVER (PARTITION BY patient_id ORDER BY day, scan_id)"


@q("T01_parse_scan_id", with_sql("""
  SELECT series_id, CASE WHEN seg_path IS NULL THEN NULL ELSE patient_id END AS scan_patient, CASE WHEN seg_path IS NOT NULL THEN scan_order END AS scan_index,
    CASE WHEN seg_path IS NOT NULL THEN CAST(days AS DOUBLE) WHEN study_type = 'DWI' THEN 0.0 ELSE file_size_mb END AS day FROM series""", "series"))
def _(spark, d):
    s = T.series(spark, d).withColumns({
        "scan_id": F.when(F.col("seg_path").isNotNull(), F.col("tracker")).otherwise(F.col("image_path")),
        "days_since_first": F.when(F.col("study_type") != "DWI", F.col("file_size_mb"))})
    return S.parse_scan_id(s).select("series_id", "scan_patient", "scan_index", "day")


@q("T02_relative_days", with_sql("SELECT scan_id, day - min(day) OVER (PARTITION BY patient_id) AS rel_day FROM scans", "scans"))
def _(spark, d):
    return S.relative_days(T.scans(spark, d)).select("scan_id", "rel_day")


@q("T03_assemble", with_sql("""
  SELECT split, patient_id, scan_id, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY split, patient_id) AS seq_len, day - min(day) OVER (PARTITION BY split, patient_id) AS rel_day
  FROM scans WINDOW w AS (PARTITION BY split, patient_id ORDER BY day, scan_id)""", "scans"))
def _(spark, d):
    return S.assemble(T.scans(spark, d)).select("split", "patient_id", "scan_id", "pos", "seq_len", "rel_day")


@q("T04_flatten_sequences", """
  SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos, round(CAST(unnest(embedding) AS DOUBLE), 6) + 0.0 AS image, round(CAST(unnest(embedding) AS DOUBLE) * 2, 6) + 0.0 AS date FROM embeddings""")
def _(spark, d):
    nested = T.table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("image"), F.transform("embedding", lambda x: x.cast("double") * 2).alias("date"))
    flat = S.flatten_sequences(nested, ["image", "date"], ["vec_id"])
    return _r(flat.withColumn("image", F.col("image").cast("double")), "image", "date")


@q("T05_sequence_lengths", with_sql("SELECT patient_id, count(*) AS seq_len FROM scans GROUP BY 1", "scans"))
def _(spark, d):
    return S.sequence_lengths(T.scans(spark, d))


@q("T05_longest_sequence", with_sql("SELECT patient_id, count(*) AS seq_len FROM scans GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1", "scans"))
def _(spark, d):
    return S.longest_sequence(S.sequence_lengths(T.scans(spark, d)))


CTE["deltas"] = (("scans",), f"SELECT *, row_number() {_W} - 1 AS pos, day - lag(day) {_W} AS delta FROM scans")


@q("T06_time_deltas", with_sql("SELECT scan_id, pos, delta, round(ln(1 + greatest(delta, 0) / 360), 6) + 0.0 AS log_delta FROM deltas", "deltas"))
def _(spark, d):
    return _r(S.time_deltas(T.scans(spark, d)), "log_delta").select("scan_id", "pos", "delta", "log_delta")


@q("T07_fill_last_delta", with_sql("""
  , l AS (SELECT CAST(patient_id AS BIGINT) // 16 AS batch, patient_id, count(*) AS n, coalesce(arg_max(delta, pos), 0) AS last FROM deltas GROUP BY ALL)
  SELECT batch, patient_id, p AS pos, greatest(coalesce(d.delta, l.last), 0) AS delta
  FROM (SELECT *, unnest(range(1, max(n) OVER (PARTITION BY batch))) AS p FROM l) l LEFT JOIN deltas d USING (patient_id) WHERE d.pos = p OR (d.pos = 0 AND p >= n)""".lstrip(), "deltas").replace("coalesce(d.delta, l.last)", "CASE WHEN d.pos = p THEN d.delta ELSE l.last END"))
def _(spark, d):
    deltas = S.time_deltas(T.scans(spark, d)).withColumn("batch", F.expr("CAST(patient_id AS BIGINT) div 16"))
    return S.fill_last_delta(deltas, "batch")


@q("T08_history_pairs", with_sql(f"""
  SELECT patient_id, row_number() {_W} - 1 AS step, row_number() {_W} AS history_len, lead(scan_id) {_W} AS target_scan, lead(day) {_W} AS target_day, lead(scan_id) {_W} IS NOT NULL AS valid FROM scans""", "scans"))
def _(spark, d):
    return S.history_pairs(T.scans(spark, d)).select("patient_id", "step", "history_len", "target_scan", "target_day", "valid")


@q("T08_history_pairs_split", Q["T08_history_pairs"][1])  # every patient above the limit, so its sequence is cut
def _(spark, d):
    return S.history_pairs(T.scans(spark, d), rows_per_split=2).select("patient_id", "step", "history_len", "target_scan", "target_day", "valid")


CTE["dims"] = ((), """
  SELECT vec_id // 20 AS patient_id, generate_subscripts(embedding, 1) - 1 AS dim, vec_id AS step, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings""")


@q("T09_aggregate_sequence", with_sql("""
  SELECT 'mean' AS how, patient_id, dim, round(avg(v), 6) + 0.0 AS value FROM dims GROUP BY ALL UNION ALL SELECT 'max', patient_id, dim, round(max(v), 6) + 0.0 FROM dims GROUP BY ALL
  UNION ALL SELECT 'last', patient_id, dim, round(arg_max(v, step), 6) + 0.0 FROM dims GROUP BY ALL UNION ALL SELECT 'cat', patient_id, dim, round(avg(v), 6) + 0.0 FROM dims GROUP BY ALL
  UNION ALL SELECT 'cat', patient_id, dim + 64, round(arg_max(v, step), 6) + 0.0 FROM dims GROUP BY ALL""", "dims"))
def _(spark, d):
    vecs = T.table(spark, d, "embeddings").select(F.expr("vec_id div 20").alias("patient_id"), F.col("vec_id").alias("step"), F.col("embedding").alias("vec"))
    part = lambda how: S.aggregate_sequence(vecs, how).select(F.lit(how).alias("how"), "patient_id", "dim", F.round("value", 6).alias("value"))
    return part("mean").unionByName(part("max")).unionByName(part("last")).unionByName(part("cat"))


def _batches(spark, d):
    return S.length_batches(S.sequence_lengths(T.scans(spark, d)), 8, 42)


@q("T10_length_batches", with_sql("""
  SELECT seq_len || '_' || b AS batch, seq_len, least(8, n - b * 8) AS batch_size FROM (SELECT seq_len, n, unnest(range(0, CAST(ceil(n / 8) AS BIGINT))) AS b FROM (
    SELECT seq_len, count(*) AS n FROM (SELECT count(*) AS seq_len FROM scans GROUP BY patient_id) GROUP BY 1))""", "scans"))
def _(spark, d):
    return _batches(spark, d).groupBy("batch", "seq_len").agg(F.count(F.lit(1)).alias("batch_size"))


@q("T11_epoch_order")
def _(spark, d):
    return S.epoch_order(_batches(spark, d), 42, 3)


@q("T11_epoch_places", with_sql("""
  , b AS (SELECT CAST(sum(ceil(n / 8)) AS BIGINT) AS n FROM (SELECT seq_len, count(*) AS n FROM (SELECT count(*) AS seq_len FROM scans GROUP BY patient_id) GROUP BY 1))
  SELECT epoch, n AS n_batches, n AS n_places, 1::BIGINT AS first, n AS last, n = 1 AS same_as_before FROM b, range(2) e(epoch)""".lstrip(), "scans"))
def _(spark, d):
    batches = cut_lineage(_batches(spark, d).select("batch").distinct())
    orders = [S.epoch_order(batches, 42, e) for e in (0, 1)]
    before = orders[0].withColumnRenamed("place", "before")
    out = None
    for e, o in enumerate(orders):
        other = orders[1].withColumnRenamed("place", "before") if e == 0 else before
        row = o.join(other, "batch").agg(
            F.lit(e).cast("long").alias("epoch"), F.count_distinct("batch").alias("n_batches"), F.count_distinct("place").alias("n_places"), F.min("place").alias("first"), F.max("place").alias("last"),
            F.bool_and(F.col("place") == F.col("before")).alias("same_as_before"))
        out = row if out is None else out.unionByName(row)
    return out


@q("T12_n_batches", with_sql("""
  SELECT CAST(sum(ceil(n / 8)) AS BIGINT) AS n_batches FROM (SELECT seq_len, count(*) AS n FROM (SELECT count(*) AS seq_len FROM scans GROUP BY patient_id) GROUP BY 1)""", "scans"))
def _(spark, d):
    return S.n_batches(S.sequence_lengths(T.scans(spark, d)), 8)


@q("T13_pad_batch", with_sql("""
  , a AS (SELECT CAST(patient_id AS BIGINT) // 16 AS batch, patient_id, pos, day - min(day) OVER (PARTITION BY patient_id) AS date, count(*) OVER (PARTITION BY patient_id) AS seq_len FROM deltas)
  SELECT batch, patient_id, pos, date, seq_len FROM a
  UNION ALL SELECT batch, patient_id, unnest(range(seq_len, m)), -1.0, seq_len FROM (SELECT batch, patient_id, seq_len, max(seq_len) OVER (PARTITION BY batch) AS m FROM a WHERE pos = 0)""".lstrip(), "deltas"))
def _(spark, d):
    rows = cut_lineage(S.assemble(T.scans(spark, d), ["patient_id"]).withColumn("batch", F.expr("CAST(patient_id AS BIGINT) div 16")))
    return S.pad_batch(rows, "batch")


@q("T14_growth", with_sql("""
  SELECT patient_id, volume_id, n_voxels, n_voxels - lag(n_voxels) OVER (PARTITION BY patient_id ORDER BY day, volume_id) AS change FROM (
    SELECT patient_id, volume_id, day, count(m.i) AS n_voxels FROM volumes LEFT JOIN masks m USING (volume_id) GROUP BY ALL)""", "volumes", "masks"))
def _(spark, d):
    return S.growth(T.masks(spark, d), T.volumes(spark, d)).select("patient_id", "volume_id", "n_voxels", "change")


# --- E: experiments ------------------------------------------------------------------------------------------

def _param_values(spark, d):
    """Parameter lists read from the data: brands, part types, sizes."""
    p = T.table(spark, d, "part")
    cols = {"brand": "p_brand", "kind": "p_type", "size": F.col("p_size").cast("string")}
    long = p.select(F.inline(F.array(*[F.struct(F.lit(n).alias("param"), (F.col(c) if isinstance(c, str) else c).alias("value")) for n, c in cols.items()]))).distinct()
    from pyspark.sql import Window

    return long.withColumn("pos", F.row_number().over(Window.partitionBy("param").orderBy("value")) - 1)


@q("E01_param_grid", """
  SELECT brand, kind, size, row_number() OVER (ORDER BY brand, kind, size) AS item FROM (SELECT DISTINCT p_brand AS brand FROM part), (SELECT DISTINCT p_type AS kind FROM part), (SELECT DISTINCT CAST(p_size AS VARCHAR) AS size FROM part)""")
def _(spark, d):
    return E.param_grid(_param_values(spark, d))


@q("E02_kfold", """
  SELECT fold, CAST(count(*) OVER () AS BIGINT) AS n_folds, n // 7 + CASE WHEN fold < n % 7 THEN 1 ELSE 0 END AS fold_size FROM (SELECT count(*) AS n FROM customer), (SELECT CAST(unnest(range(7)) AS INTEGER) AS fold)""")
def _(spark, d):
    folds = E.kfold(T.table(spark, d, "customer").select("c_custkey"), "c_custkey", 7, 42)
    return folds.groupBy("fold").agg(F.count(F.lit(1)).alias("fold_size")).withColumn("n_folds", F.lit(7).cast("long"))


CTE["folds"] = ((), "SELECT c_custkey, CAST(c_nationkey % 5 AS INTEGER) AS fold FROM customer")


@q("E03_fold_views", with_sql("SELECT c_custkey, CAST(f AS INTEGER) AS run_fold, CASE WHEN fold = f THEN 'val' ELSE 'train' END AS part FROM folds, range(5) r(f)", "folds"))
def _(spark, d):
    folds = T.table(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") % 5).alias("fold"))
    return E.fold_views(folds, 5).select("c_custkey", "run_fold", "part")


CTE["fold_best"] = (("metric_log",), "SELECT run_id, fold, metric, arg_max(value, epoch) AS value FROM metric_log GROUP BY ALL")
CTE["cv"] = (("fold_best",), "SELECT run_id, metric, avg(value) AS mean, stddev_pop(value) AS std, printf('%.4f +/- %.4f', avg(value), stddev_pop(value)) AS summary FROM fold_best GROUP BY ALL")


def _cv(spark, d):
    best = T.metric_log(spark, d).groupBy("run_id", "fold", "metric").agg(F.max_by("value", "epoch").alias("value"))
    return E.cv_summary(best)


@q("E04_cv_summary", with_sql("SELECT run_id, metric, round(mean, 6) + 0.0 AS mean, round(std, 6) + 0.0 AS std, summary FROM cv", "cv"))
def _(spark, d):
    return _r(_cv(spark, d), "mean", "std")


_NAMES = ["dice", "hausdorff", "loss", "rvd", "surface_dice"]


@q("E05_grid_results", with_sql("SELECT p_partkey AS item, p_brand AS brand, " + ", ".join(f"max(CASE WHEN metric = '{m}' THEN summary END) AS {m}" for m in _NAMES)
   + " FROM part LEFT JOIN cv ON run_id = p_partkey GROUP BY ALL", "cv"))
def _(spark, d):
    grid = T.table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("brand"))
    return E.grid_results(grid, _cv(spark, d).withColumnRenamed("run_id", "item"), _NAMES)


CTE["losses"] = (("metric_log",), "SELECT * REPLACE (CASE WHEN metric IN ('rvd', 'hausdorff') THEN value ELSE 1 - value END AS value) FROM metric_log")


@q("E06_to_losses", with_sql("SELECT run_id, fold, epoch, metric, round(value, 6) + 0.0 AS value FROM losses", "losses"))
def _(spark, d):
    return _r(E.to_losses(T.metric_log(spark, d)), "value")


CTE["scores"] = (("losses",), """
  SELECT run_id, fold, epoch, CASE WHEN count(p) = 2 THEN sum(p) END AS score FROM (
    SELECT run_id, fold, epoch, metric, CASE WHEN metric = 'dice' THEN 0.6 * value ELSE 0.4 / (1 + exp(-CASE WHEN rn = 1 THEN 100 WHEN sd > 0 THEN (value - mu) / sd END)) END AS p FROM (
      SELECT *, row_number() OVER (PARTITION BY run_id, fold, metric ORDER BY epoch) AS rn, avg(value) OVER w AS mu, stddev_pop(value) OVER w AS sd
      FROM losses WHERE metric IN ('dice', 'hausdorff') WINDOW w AS (PARTITION BY run_id, fold, metric ORDER BY epoch ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)))
  GROUP BY ALL""")


def _scores(spark, d):
    return E.composite_score(E.to_losses(T.metric_log(spark, d)), {"dice": 0.6, "hausdorff": 0.4}, ["hausdorff"])


@q("E07_composite_score", with_sql("SELECT run_id, fold, epoch, round(score, 6) + 0.0 AS score FROM scores", "scores"))
def _(spark, d):
    return _r(_scores(spark, d), "score")


@q("E08_early_stop", with_sql("""
  , x AS (SELECT run_id, epoch, avg(value) AS v, row_number() OVER (PARTITION BY run_id ORDER BY epoch) AS n FROM metric_log WHERE metric = 'loss' GROUP BY run_id, epoch),
  f AS (SELECT run_id, n, epoch, 0.6 * v AS s, 0.6 * v AS best, 0 AS idle FROM x WHERE n = 1
    UNION ALL SELECT x.run_id, x.n, x.epoch, 0.6 * x.v + 0.4 * f.s, CASE WHEN 0.6 * x.v + 0.4 * f.s < f.best - 0.01 THEN 0.6 * x.v + 0.4 * f.s ELSE f.best END,
      CASE WHEN 0.6 * x.v + 0.4 * f.s < f.best - 0.01 THEN 0 ELSE f.idle + 1 END FROM f JOIN x ON x.run_id = f.run_id AND x.n = f.n + 1 WHERE f.idle <= 3)
  SELECT run_id, min(CASE WHEN idle > 3 THEN epoch END) AS stop_epoch, round(min(best), 6) + 0.0 AS best FROM f GROUP BY run_id""".lstrip(), "metric_log").replace("WITH ", "WITH RECURSIVE ", 1))
def _(spark, d):
    loss = T.metric_log(spark, d).filter("metric = 'loss'")
    per = E.epoch_loss(loss).withColumnRenamed("mean_loss", "value")
    return _r(E.early_stop(per, 3, 0.01, 0.6), "best")


@q("E09_best_epoch", with_sql("""
  SELECT run_id, fold, epoch AS best_epoch, round(score, 6) + 0.0 AS best_score FROM (SELECT *, row_number() OVER (PARTITION BY run_id, fold ORDER BY score, epoch) AS rn FROM scores WHERE score < 1.0) WHERE rn = 1""", "scores"))
def _(spark, d):
    return _r(E.best_epoch(_scores(spark, d), ["run_id", "fold"]), "best_score")


@q("E10_epoch_loss", with_sql("SELECT run_id, epoch, round(avg(value), 6) + 0.0 AS mean_loss FROM metric_log WHERE metric = 'loss' GROUP BY ALL", "metric_log"))
def _(spark, d):
    return _r(E.epoch_loss(T.metric_log(spark, d).filter("metric = 'loss'")), "mean_loss")
