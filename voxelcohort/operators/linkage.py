"""Cleaning, path repair and record linkage on the series manifest."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelcohort.checks import require_columns
from voxelcohort.functions import paths as P
from voxelcohort.functions.similarity import seq_ratio
from voxelcohort.session import cut_lineage


def split_by_existence(df: DataFrame, files: DataFrame, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """Rows whose path is in the inventory, and the others."""
    known = files.select(F.col("path").alias(path)).distinct()
    return df.join(known, path, "left_semi"), df.join(known, path, "left_anti")


def with_existence(df: DataFrame, files: DataFrame, path: str = "path", flag: str = "exists") -> DataFrame:
    known = files.select(F.col("path").alias(path), F.lit(True).alias(flag)).distinct()
    return df.join(known, path, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def _inventory(files: DataFrame) -> DataFrame:
    return files.select("path", P.parent_dir("path").alias("dir"), P.base_name("path").alias("name")).distinct()


def _letters(name: Column) -> Column:
    """The characters of a name as distinct tokens: the character and which of its kind it is."""
    chars = F.sort_array(F.split(name, ""))
    return F.transform(chars, lambda c, n: F.concat(c, (n + 1 - F.array_position(chars, c)).cast("string")))


def _fuzzy_best(asks: DataFrame, entries: DataFrame, cutoff: float) -> DataFrame:
    """For each distinct ``(dir, want)`` the most similar entry of that directory at or above ``cutoff``.

    ``asks`` has one row per distinct question, so rows with the same broken
    name are compared once, and only directories that are asked about are looked at. Matching characters cannot be more than the names
    have in common, which bounds the ratio; the bound is taken on arrays in the JVM. The entry of the greatest bound is
    scored first, and after that only entries whose bound reaches its score: Python sees
    a few names a question and not all of a directory. Equal scores go to the greatest name.
    """
    asked = cut_lineage(asks.withColumn("_w", _letters(F.col("want"))))
    looked = entries.select("dir", "name").join(asked.select("dir").distinct(), "dir", "left_semi")
    named = cut_lineage(looked.withColumn("_e", _letters(F.col("name"))))
    la, lb = F.length("want"), F.length("name")
    near = asked.join(named, "dir").filter(2.0 * F.least(la, lb) >= (la + lb) * F.lit(cutoff))
    near = near.withColumn("_bound", 2.0 * F.size(F.array_intersect("_w", "_e")) / (la + lb)).filter(F.col("_bound") >= cutoff)
    near = near.select("dir", "want", "name", "_bound")
    first = near.groupBy("dir", "want").agg(F.max_by("name", F.struct("_bound", "name")).alias("_name"))
    first = cut_lineage(first.withColumn("_least", seq_ratio("_name", "want")))
    rest = near.join(first, ["dir", "want"]).filter((F.col("_bound") >= F.col("_least")) & (F.col("name") != F.col("_name")))
    scored = rest.select("dir", "want", "name", seq_ratio("name", "want").alias("_score")).unionByName(first.select("dir", "want", F.col("_name").alias("name"), F.col("_least").alias("_score")))
    return scored.filter(F.col("_score") >= cutoff).groupBy("dir", "want").agg(F.max_by("name", F.struct("_score", "name")).alias("pick"))


def repair_in_parent(df: DataFrame, files: DataFrame, row_id: str, path: str = "path", mask_name: str = "mask_name", cutoff: float = 0.4) -> DataFrame:
    """Resolve each path inside its own directory; adds ``resolved`` (null when nothing fits).

    Order of preference: the path itself, the exact ``mask_name``, the most
    similar volume name at or above ``cutoff``, the only volume in the directory.
    """
    inv = cut_lineage(_inventory(files))
    nifti = inv.filter(F.col("name").rlike(P.NIFTI_EXT) & (F.col("name") != "image.nii.gz")).select("dir", "name")
    rows = cut_lineage(
        df.select(row_id, F.col(path).alias("_path"), F.col(mask_name).alias("_wanted"), P.parent_dir(path).alias("dir"), P.base_name(path).alias("want"))
        .filter(P.blank_to_null("_path").isNotNull())
        .join(inv.select(F.col("path").alias("_path"), F.lit(True).alias("_exact")), "_path", "left")
        .join(nifti.withColumnsRenamed({"name": "_wanted"}).withColumn("_named", F.lit(True)), ["dir", "_wanted"], "left")
    )
    lone = nifti.groupBy("dir").agg(F.count(F.lit(1)).alias("_n"), F.min("name").alias("_only")).filter(F.col("_n") == 1)
    asks = rows.filter(F.col("_exact").isNull() & F.col("_named").isNull()).select("dir", "want").distinct()
    fuzzy = _fuzzy_best(asks, nifti, cutoff)
    picked = rows.join(fuzzy, ["dir", "want"], "left").join(lone.select("dir", "_only"), "dir", "left")
    name = F.when(F.col("_named"), F.col("_wanted")).otherwise(F.coalesce("pick", "_only"))
    resolved = F.when(F.col("_exact"), F.col("_path")).otherwise(F.concat("dir", F.lit("/"), name))
    return df.join(picked.select(row_id, resolved.alias("resolved")), row_id, "left")


def _steps(paths: DataFrame) -> DataFrame:
    """Every step of each ``path`` from the root: its number, the path up to there, the folder and the name in it."""
    step = paths.select("path", F.explode(F.sequence(F.lit(1), F.size(F.split("path", "/")))).alias("_step"))
    step = step.select("_step", F.expr("substring_index(path, '/', _step)").alias("_upto"))
    up = F.expr("CASE WHEN _step = 1 THEN '' ELSE substring_index(_upto, '/', _step - 1) END")
    name = F.expr("CASE WHEN _step = 1 THEN _upto ELSE substring_index(_upto, '/', -1) END")
    return step.select("_step", "_upto", up.alias("dir"), name.alias("name"))


def repair_path(df: DataFrame, files: DataFrame, row_id: str, path: str = "path", cutoff: float = 0.6) -> DataFrame:
    """Walk each path from the root and mend one component at a time; adds ``resolved``.

    A component is taken as it is, else by ignoring case, else the most similar
    entry of the resolved parent. One component without a match ends the walk.
    The loop runs once per path depth, never per row: each folder that paths share is
    mended once, and looks only at entries of its own depth.
    """
    tree = cut_lineage(_steps(files.select("path")).select(F.greatest(F.col("_step") - 1, F.lit(1)).alias("_deep"), "dir", "name").distinct())
    asks = df.select(F.col(path).alias("path")).filter(P.blank_to_null("path").isNotNull()).distinct()
    asked = cut_lineage(_steps(asks).select("_step", F.col("_upto").alias("_asked"), F.col("dir").alias("_above"), F.col("name").alias("want")).distinct())
    depth = asked.agg(F.max("_step")).first()[0] or 0
    first = asked.filter(F.col("_step") == 1).select("_asked", F.col("want").alias("dir"))
    walk = cut_lineage(first.join(tree.filter(F.col("dir") == "").select(F.col("name").alias("dir")), "dir", "left_semi").select("_asked", "dir"))
    done = walk
    for level in range(2, depth + 1):
        want = asked.filter(F.col("_step") == level).join(walk.withColumnRenamed("_asked", "_above"), "_above").select("_asked", "dir", "want", F.lower("want").alias("_low"))
        here = tree.filter(F.col("_deep") == level - 1)
        exact = here.select("dir", F.col("name").alias("want"), F.col("name").alias("_same"))
        folded = here.groupBy("dir", F.lower("name").alias("_low")).agg(F.max("name").alias("_folded"))
        known = want.join(exact, ["dir", "want"], "left").join(folded, ["dir", "_low"], "left")
        known = cut_lineage(known.select("_asked", "dir", "want", F.coalesce("_same", "_folded").alias("_pick")))
        lost = known.filter(F.col("_pick").isNull()).drop("_pick")
        found = known.filter(F.col("_pick").isNotNull()).drop("want")
        if not lost.isEmpty():
            best = _fuzzy_best(lost.select("dir", "want").distinct(), here, cutoff)
            found = found.unionByName(lost.join(best, ["dir", "want"]).select("_asked", "dir", F.col("pick").alias("_pick")))
        walk = cut_lineage(found.select("_asked", F.concat_ws("/", "dir", "_pick").alias("dir")))
        done = done.unionByName(walk)
    # folders on the way to a path are no questions of their own: a blank one stays without an answer
    done = done.filter(P.blank_to_null("_asked").isNotNull())
    return df.join(done.select(F.col("_asked").alias(path), F.col("dir").alias("resolved")), path, "left")


def recover(df: DataFrame, files: DataFrame, row_id: str, path: str = "path", mask_name: str = "mask_name") -> tuple[DataFrame, DataFrame]:
    """Valid rows plus those repaired inside their directory, and the residue."""
    valid, missing = split_by_existence(df, files, path)
    fixed = repair_in_parent(missing, files, row_id, path, mask_name)
    good = fixed.filter(F.col("resolved").isNotNull()).withColumn(path, F.col("resolved")).drop("resolved")
    return valid.unionByName(good), fixed.filter(F.col("resolved").isNull()).drop("resolved")


def clean_timeline(df: DataFrame, col: str = "tracker") -> DataFrame:
    return df.withColumn(col, F.nullif(F.col(col), F.lit("."))).dropna(subset=[col])


def split_tracker(df: DataFrame, col: str = "tracker") -> DataFrame:
    """``patient_order_days`` into its three fields; absent fields, and what is no whole number, are null."""
    part = F.split(col, "_")
    return df.withColumns({
        "patient_id": F.get(part, 0), "scan_order": F.get(part, 1).try_cast("long"), "days": F.get(part, 2).try_cast("long"),
    })


def split_patient_timepoint(df: DataFrame, col: str = "tracker") -> DataFrame:
    """Cut at the first underscore only."""
    part = F.split(col, "_", 2)
    return df.withColumns({"patient_id": F.get(part, 0), "timepoint": F.get(part, 1)})


def link_timeline(timeline: DataFrame, series: DataFrame, key: str = "accession") -> DataFrame:
    return series.join(timeline, key, "inner")


def unmatched(series: DataFrame, linked: DataFrame, key: str = "accession") -> DataFrame:
    return series.join(linked.select(key).distinct(), key, "left_anti")


def order_scans(df: DataFrame) -> DataFrame:
    return df.orderBy("patient_id", "scan_order")


def canonicalise(df: DataFrame, mapping: Mapping[str, str], keep: Sequence[str]) -> DataFrame:
    """Trim column names, rename to canonical ones and keep those of ``keep`` that exist."""
    df = df.withColumnsRenamed({c: c.strip() for c in df.columns if c != c.strip()})
    df = df.withColumnsRenamed({old: new for old, new in mapping.items() if old in df.columns})
    return df.select(*[c for c in keep if c in df.columns])


def first_present(df: DataFrame, names: Sequence[str]) -> Column:
    """The first of several alternative columns the frame has."""
    found = [n for n in names if n in df.columns]
    if not found:
        raise ValueError(f"none of {list(names)} present")
    return F.coalesce(*[F.col(f"`{n}`") for n in found])


def drop_phi(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*cols)


def expected_outputs(df: DataFrame, base: str, suffixes: Sequence[str] = P.RESULT_SUFFIXES) -> DataFrame:
    return df.withColumn("output", F.explode(P.expected_names(base, suffixes)))


def result_path(df: DataFrame, files: DataFrame, folder: str, path: str = "image_path") -> DataFrame:
    """Adds ``result``: the registered copy's path, null unless the file exists."""
    named = df.withColumn("_result", P.registered_path(path, folder))
    known = files.select(F.col("path").alias("_result"), F.col("path").alias("result")).distinct()
    return named.join(known, "_result", "left").drop("_result")


def _is_segmentation():
    return F.lower("name").contains("uvauser")


def discover_files(series: DataFrame, files: DataFrame, dir_col: str = "dir") -> DataFrame:
    """Image and segmentation of each series directory.

    The image's name contains ``image``, a segmentation's contains ``uvauser``;
    of several segmentations one named ``copy`` is preferred and the series is flagged.
    """
    inv = _inventory(files).withColumnsRenamed({"dir": dir_col}).filter(F.col("name").endswith(".nii.gz"))
    is_seg = _is_segmentation()
    seg_rank = F.struct(F.when(F.lower("name").contains("copy"), 0).otherwise(1), F.col("name"))
    per_dir = inv.groupBy(dir_col).agg(
        F.min(F.when(F.lower("name").contains("image"), F.col("path"))).alias("image"),
        F.min_by(F.when(is_seg, F.col("path")), F.when(is_seg, seg_rank)).alias("segmentation"),
        F.count_if(is_seg).alias("n_segmentations"),
    )
    return series.join(per_dir, dir_col, "left").withColumn("multiple", F.coalesce(F.col("n_segmentations") > 1, F.lit(False)))


def list_segmentations(series: DataFrame, files: DataFrame, dir_col: str = "dir") -> DataFrame:
    """Every segmentation file of each series directory, one row per file."""
    inv = _inventory(files).withColumnsRenamed({"dir": dir_col}).filter(F.col("name").endswith(".nii.gz") & _is_segmentation())
    return series.join(inv.select(dir_col, F.col("path").alias("segmentation")), dir_col)


# fixed values: file names in order of preference; ``*`` matches any text
IMAGE_NAMES = (
    "{scan}_T1_pre.nii.gz", "{scan}_t1p_pre.nii.gz", "{scan}_pre_tpl.nii.gz",
    "{scan}_T1p_pre*.nii.gz", "{scan}_T1*.nii.gz", "{scan}_*.nii.gz",
)
LABEL_NAMES = (
    "{scan}_T1_seg.nii.gz", "{scan}_T1p_seg_tpl.nii.gz", "{scan}_t1p_seg_tpl.nii.gz", "{scan}_seg_tpl.nii.gz",
    "{scan}_T1p_seg*.nii.gz", "{scan}_seg*.nii.gz", "*seg*.nii.gz", "*mask*.nii.gz", "*label*.nii.gz",
)


def _name_tier(scan_id: str, patterns: Sequence[str]) -> Column:
    """Index of the first pattern the column ``name`` matches, else null."""
    tier = F.lit(None).cast("int")
    for n in reversed(range(len(patterns))):
        rx = patterns[n].replace(".", r"\.").replace("*", ".*")
        before, scan, after = rx.partition("{scan}")
        rx_col = F.concat(F.lit("^" + before + "\\Q"), F.col(scan_id), F.lit("\\E" + after + "$")) if scan else F.lit(f"^{before}$")
        tier = F.when(F.rlike(F.col("name"), rx_col), F.lit(n)).otherwise(tier)
    return tier


def resolve_scan_files(
    scans: DataFrame, files: DataFrame, scan_id: str = "scan_id", dir_col: str = "dir", require_labels: bool = False,
    image_names: Sequence[str] = IMAGE_NAMES, label_names: Sequence[str] = LABEL_NAMES,
) -> DataFrame:
    """Image and label of each scan by ordered name patterns; the first sorted name wins.

    With ``require_labels`` a scan without a label fails the job, otherwise its
    label is null.
    """
    inv = _inventory(files).withColumnsRenamed({"dir": dir_col})
    ranked = scans.select(scan_id, dir_col).join(inv, dir_col).withColumns(
        {"_it": _name_tier(scan_id, image_names), "_lt": _name_tier(scan_id, label_names)}
    )

    def first(tier):
        some = F.col(tier).isNotNull()
        return F.min_by(F.when(some, F.col("path")), F.when(some, F.struct(tier, "name")))

    best = ranked.groupBy(scan_id).agg(first("_it").alias("image"), first("_lt").alias("label"))
    out = scans.join(best, scan_id, "left")
    if require_labels:
        missing = F.raise_error(F.concat(F.lit("no label for scan "), F.col(scan_id)))
        out = out.withColumn("label", F.when(F.col("label").isNull(), missing.cast("string")).otherwise(F.col("label")))
    return out


def resolve_relative(df: DataFrame, files: DataFrame, root: str, path: str = "path") -> DataFrame:
    """A path as it is when absolute, else below ``root``; adds ``resolved``, null when no such file exists."""
    p = P.blank_to_null(path)
    below = F.concat(F.lit(root.rstrip("/") + "/"), F.regexp_replace(p, r"^(\./)+", ""))
    named = df.withColumn("_asked", F.when(p.startswith("/"), p).otherwise(below))
    known = files.select(F.col("path").alias("_asked"), F.col("path").alias("resolved")).distinct()
    return named.join(known, "_asked", "left").drop("_asked")
