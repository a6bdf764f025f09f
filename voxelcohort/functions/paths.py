"""Column functions on paths, names and identifiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the file name endings a volume can have, and those of the results of one image
NIFTI_EXT = r"\.nii(\.gz)?$"
RESULT_SUFFIXES = ("_bet", "_bet_mask", "_mask")


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _trim(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def clean_path(path: Column | str, trim_both: bool = False) -> Column:
    """Forward slashes, no empty segments, no leading blanks per segment (or none at either end)."""
    strip = _trim if trim_both else (lambda x: F.regexp_replace(x, r"^\s+", ""))
    segments = F.filter(F.split(F.replace(_c(path), F.lit("\\"), F.lit("/")), "/"), lambda x: x != "")
    return F.array_join(F.transform(segments, strip), "/")


def clean_path_strict(path: Column | str) -> Column:
    """Trim the end of the path and every segment, drop trailing dots, null when nothing is left."""
    p = F.regexp_replace(_c(path), r"[ .\t]+$", "")
    root = F.when(p.rlike(r"^//([^/]|$)"), "//").when(p.startswith("/"), "/").otherwise("")
    segments = F.filter(F.split(p, "/"), lambda x: (x != "") & (x != "."))
    segments = F.filter(F.transform(segments, lambda x: F.regexp_replace(_trim(x), r"\.+$", "")), lambda x: x != "")
    cleaned = F.concat(root, F.array_join(segments, "/"))
    return F.when(cleaned != "", cleaned)


def abs_path(root: str, batch_id: Column | str, rel: Column | str) -> Column:
    """``root/VS_batch<id>/rel``; null for a blank relative path."""
    r = _c(rel)
    joined = F.concat(F.lit(root.rstrip("/") + "/VS_batch"), _c(batch_id), F.lit("/"), F.regexp_replace(r, "^/+", ""))
    return F.when(_trim(r) != "", joined)


def parent_dir(path: Column | str) -> Column:
    return F.regexp_replace(_c(path), "/[^/]*$", "")


def base_name(path: Column | str) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def strip_ext(path: Column | str) -> Column:
    return F.regexp_replace(_c(path), NIFTI_EXT, "")


def safe_id(col: Column | str, default: str = "case") -> Column:
    cleaned = F.regexp_replace(_trim(_c(col)), r"[^A-Za-z0-9._-]+", "_")
    return F.when(cleaned == "", default).otherwise(cleaned)


def safe_name(col: Column | str, default: str = "node") -> Column:
    """A name usable as a note's file name."""
    cleaned = F.regexp_replace(_trim(_c(col)), r'[\\/*?:"<>|#^\[\]]+', "_")
    cleaned = F.regexp_replace(F.regexp_replace(cleaned, r"\s+", "_"), r"^[ ._]+|[ ._]+$", "")
    return F.when(cleaned == "", default).otherwise(cleaned)


def community_folder(col: Column | str) -> Column:
    return F.when(_c(col).isNull(), "community_unassigned").otherwise(F.format_string("community_%03d", _c(col)))


def first_nonempty(*cols: Column | str) -> Column:
    return F.coalesce(*[F.nullif(_trim(_c(c)), F.lit("")) for c in cols])


def stable_seed(col: Column | str) -> Column:
    """32-bit seed from the first eight hex digits of the id's SHA-256."""
    return F.conv(F.substring(F.sha2(_c(col), 256), 1, 8), 16, 10).cast("long")


def geometry_key(*cols: Column | str) -> Column:
    """Fingerprint of header text, usable as a cache key."""
    return F.md5(F.concat_ws("_", *[_c(c).cast("string") for c in cols]))


def organised_path(base: str, tag: Column | str, tracker: Column | str, path: Column | str) -> Column:
    tag, tracker = _c(tag), _c(tracker)
    name = F.concat(tracker, F.lit("_"), tag, F.lit("_"), base_name(path))
    return F.concat_ws("/", F.lit(base), tag, tracker, name)


def registered_path(path: Column | str, folder: str, marker: str = "raw_studies") -> Column:
    """The path with the first ``marker`` (any case) replaced and the result suffix added."""
    p = _c(path)
    at = F.locate(marker, F.lower(p))
    swapped = F.concat(F.substring(p, F.lit(1), at - 1), F.lit(folder), F.substring(p, at + len(marker), F.length(p)))
    return F.when(at > 0, F.replace(swapped, F.lit(".nii.gz"), F.lit("_coregistered.nii.gz")))


def blank_to_null(col: Column | str) -> Column:
    """Blanks and the text ``nan`` are missing values."""
    t = _trim(_c(col))
    return F.when((t != "") & (F.lower(t) != "nan"), _c(col))


def modality(study_type: Column | str) -> Column:
    t = F.lower(_trim(_c(study_type)))
    return F.when(t.startswith("t1"), "t1").otherwise("t2")


def pair_metric(a: Column | str, b: Column | str) -> Column:
    """``GC`` for two studies of one modality, ``mattes`` otherwise or when a type is unknown."""

    def kind(c):
        t = F.lower(_trim(_c(c)))
        return F.when(t.startswith("t1") | t.startswith("t2"), F.substring(t, 1, 2)).otherwise(t)

    same = (kind(a) == kind(b)) & (kind(a) != "")
    return F.when(F.coalesce(same, F.lit(False)), "GC").otherwise("mattes")


def expected_names(base: Column | str, suffixes: Sequence[str] = RESULT_SUFFIXES) -> Column:
    """The result file names a processed image leaves, as an array."""
    return F.array(*[F.concat(_c(base), F.lit(f"{s}.nii.gz")) for s in suffixes])
