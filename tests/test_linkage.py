"""Hand-computed cases of cleaning, repair and linkage."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from voxelcohort.checks import require_columns
from voxelcohort.functions import paths as P
from voxelcohort.functions.similarity import seq_ratio
from voxelcohort.operators import cohort as C
from voxelcohort.operators import linkage as L


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("path, want", [("a\\ b/ c", "a/b/c"), ("/x//y ", "x/y "), ("a/ /b", "a//b"), (None, None)])
def test_clean_path(spark, path, want):
    assert one(spark, P.clean_path("p"), p=path) == want


@pytest.mark.parametrize("path, want", [
    ("/root//x. /y..", "/root/x/y"), (" a /b.\t", "a/b"), ("...", None), ("  ", None), ("a/./b/..", "a/b"), (None, None), ("/", "/")])
def test_clean_path_strict(spark, path, want):
    assert one(spark, P.clean_path_strict("p"), p=path) == want


@pytest.mark.parametrize("tracker, want", [("120_0_0", ("120", 0, 0)), ("120_10_400", ("120", 10, 400)), ("x_1", ("x", 1, None)), ("7_0_-30", ("7", 0, -30)), ("7_12345678901_12345678901", ("7", 12345678901, 12345678901)), ("7_a_1.5", ("7", None, None)), (None, (None, None, None))])
def test_split_tracker(spark, tracker, want):
    df = spark.createDataFrame([(tracker,)], "tracker string")
    assert tuple(L.split_tracker(df).select("patient_id", "scan_order", "days").first()) == want


def test_scans_sort_as_numbers(spark):
    df = spark.createDataFrame([("120", n) for n in (10, 2, 0)], "patient_id string, scan_order int")
    assert [r["scan_order"] for r in L.order_scans(df).collect()] == [0, 2, 10]


@pytest.mark.parametrize("user, labels, want", [
    ("admin", "VS qc1", 0), ("admin", "VS", 9999), ("user1", "", 101), ("uvauser2", "qc1", 102), (" USER10", None, 110), ("AI", "qc1", 9999), (None, None, 9999)])
def test_mask_priority(spark, user, labels, want):
    assert one(spark, C.mask_priority(), mask_user=user, study_labels=labels) == want


def test_pair_metric(spark):
    case = lambda a, b: one(spark, P.pair_metric("a", "b"), a=a, b=b)
    assert [case("T1_post", "t1 pre"), case("T1", "T2"), case("DWI", "dwi "), case(None, "T1"), case("", "")] == ["GC", "mattes", "GC", "mattes", "mattes"]


def test_registered_path(spark):
    assert one(spark, P.registered_path("p", "done"), p="/d/Raw_Studies/a/raw_studies.nii.gz") == "/d/done/a/raw_studies_coregistered.nii.gz"
    assert one(spark, P.registered_path("p", "done"), p="/d/other/a.nii.gz") is None


def test_seq_ratio_is_the_standard_ratio(spark):
    words = ["image.nii.gz", "LVS _uvauser2.nii.gz", "L_VS__uvauser2_.nii.gz", "", "é"]
    df = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string").repartition(3)
    for r in df.select("a", "b", seq_ratio("a", "b").alias("x")).collect():
        assert r["x"] == difflib.SequenceMatcher(None, r["a"], r["b"]).ratio()


def test_repair_in_parent_tiers(spark):
    files = spark.createDataFrame([(p,) for p in (
        "d/1/exact.nii.gz", "d/2/wanted.nii", "d/2/aask.nii.gz", "d/3/L_VS__uvauser2_.nii.gz", "d/3/zzz.nii", "d/3/image.nii.gz",
        "d/4/completely-else.nii", "d/5/qqqq.nii", "d/5/wwww.nii", "d/6/notes.txt")], "path string")
    asks = [("a", "d/1/exact.nii.gz", None), ("b", "d/2/ask.nii.gz", "wanted.nii"), ("c", "d/3/LVS _uvauser2.nii.gz", "x"), ("d", "d/4/0123.img", None),
            ("e", "d/5/0123.img", None), ("f", "d/6/notes.nii", None), ("g", "  ", None), ("h", "d/9/x.nii", None)]
    df = spark.createDataFrame(asks, "id string, path string, mask_name string")
    got = {r["id"]: r["resolved"] for r in L.repair_in_parent(df, files, "id").collect()}
    assert got == {"a": "d/1/exact.nii.gz", "b": "d/2/wanted.nii", "c": "d/3/L_VS__uvauser2_.nii.gz", "d": "d/4/completely-else.nii",
                   "e": None, "f": None, "g": None, "h": None}


def test_best_match_scores_few_names(spark, monkeypatch):
    """A flat folder of 400 names and 60 broken ones: the picks of the plain search, with few ratios taken."""
    rng = random.Random(3)
    names = sorted({"".join(rng.choice("abcdefghij_0123") for _ in range(rng.randrange(3, 14))) + rng.choice([".nii", ".nii.gz"]) for _ in range(400)})
    asks = []
    for _ in range(60):
        w = list(rng.choice(names))
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(len(w))] = rng.choice(["", "x", "a", "_"])
        asks.append("".join(w))
    asked, entries = (spark.createDataFrame([("d", x) for x in sorted(set(v))], f"dir string, {c} string") for v, c in ((asks, "want"), (names, "name")))
    for cutoff in (0.4, 0.6, 0.9):
        got = {r["want"]: r["pick"] for r in L._fuzzy_best(asked, entries, cutoff).collect()}
        want = {a: max(((difflib.SequenceMatcher(None, n, a).ratio(), n) for n in names)) for a in asks}
        assert got == {a: n for a, (score, n) in want.items() if score >= cutoff}
    letters = spark.createDataFrame([("abca",), ("",), ("éé",)], "s string").select(L._letters(F.col("s")).alias("l")).collect()
    assert [r["l"] for r in letters] == [["a0", "a1", "b0", "c0"], ["0"], ["é0", "é1"]]


def brute_repair(path, files, cutoff=0.6):
    tree = {}
    for f in files:
        parts = f.split("/")
        for n in range(len(parts)):
            tree.setdefault("/".join(parts[:n]), set()).add(parts[n])
    parts = path.split("/")
    if parts[0] not in tree[""]:
        return None
    at = parts[0]
    for part in parts[1:]:
        names = tree.get(at, set())
        folded = [n for n in names if n.lower() == part.lower()]
        close = sorted(((difflib.SequenceMatcher(None, n, part).ratio(), n) for n in names), reverse=True)
        if part in names:
            at += "/" + part
        elif folded:
            at += "/" + max(folded)
        elif close and close[0][0] >= cutoff:
            at += "/" + close[0][1]
        else:
            return None
    return at


def test_repair_path_against_brute_force(spark):
    files = ["vault/Alpha/scan_01/image.nii.gz", "vault/Alpha/scan_02/image.nii.gz", "vault/beta/x.nii", "vault/Beta2/deep/er/y.nii", "vault/gamma/q"]
    asks = ["vault/alpha/scan_1/image.nii", "vault/Alpha/scan_02/image.nii.gz", "vault/bet/x.nii", "Vault/beta/x.nii", "vault/Beta2/deep/er/zzzzzz", "vault",
            "vault/BETA/X.NII", "vault/gama/q", "vault/gamma/q/too/deep", "vault/Alpha/scan_03/img.nii.gz"]
    df = spark.createDataFrame(list(enumerate(asks)), "id int, path string")
    got = {r["path"]: r["resolved"] for r in L.repair_path(df, spark.createDataFrame([(f,) for f in files], "path string"), "id").collect()}
    assert got == {a: brute_repair(a, files) for a in asks}


def test_repair_path_looks_only_where_it_is_asked(spark, monkeypatch):
    """Of a hundred folders one is asked about: the letters of its four names are taken, and shared folders are mended once."""
    files = [f"vault/p{n:02d}/{x}" for n in range(100) for x in ("alpha.nii", "beta.nii", "gamma.nii", "delta.nii")]
    asks = ["vault/p07/alpa.nii", "vault/p07/beta.nii", "vault/p07/gama.nii", "Vault/p07/x", "vault/P09/delta.nii"]
    stored, cut = [], L.cut_lineage

    def count(df, *more):
        out = cut(df, *more)
        stored.append((set(df.columns), out.count()))
        return out

    monkeypatch.setattr(L, "cut_lineage", count)
    df = spark.createDataFrame(list(enumerate(asks)), "id int, path string")
    got = {r["path"]: r["resolved"] for r in L.repair_path(df, spark.createDataFrame([(f,) for f in files], "path string"), "id").collect()}
    assert got == {a: brute_repair(a, files) for a in asks}
    assert [n for cols, n in stored if "_e" in cols] == [4]
    assert [n for cols, n in stored if "_pick" in cols] == [2, 4]


def test_repair_path_of_blank_and_absolute_paths(spark):
    files = ["/data/Sub/a.nii", "/data/sub/b.nii", "data/Sub/c.nii", " /x.nii", "nan/y.nii"]
    asks = ["/Data/sub/a.nii", "/data/Sub/a.nii", "data/sub/c.nii", "/data", "", " ", "nan", "nan/y.nii", " /X.nii", "data//c.nii", "/data/SUB/B.nii", None]
    df = spark.createDataFrame(list(enumerate(asks)), "id int, path string")
    got = {r["id"]: r["resolved"] for r in L.repair_path(df, spark.createDataFrame([(f,) for f in files], "path string"), "id").collect()}
    assert got == {n: None if a is None or a.strip() in ("", "nan") else brute_repair(a, files) for n, a in enumerate(asks)}


def test_resolve_scan_files(spark):
    files = spark.createDataFrame([(f"s/{p}",) for p in (
        "1/a_T1_pre.nii.gz", "1/a_pre_tpl.nii.gz", "1/a_T1_seg.nii.gz", "2/b_T1p_pre_z.nii.gz", "2/b_T1p_pre_a.nii.gz", "2/old_label.nii.gz", "2/my_mask.nii.gz", "3/c+x_T1.nii.gz")], "path string")
    scans = spark.createDataFrame([("a", "s/1"), ("b", "s/2"), ("c+x", "s/3")], "scan_id string, dir string")
    got = {r["scan_id"]: (r["image"], r["label"]) for r in L.resolve_scan_files(scans, files).collect()}
    assert got == {"a": ("s/1/a_T1_pre.nii.gz", "s/1/a_T1_seg.nii.gz"), "b": ("s/2/b_T1p_pre_a.nii.gz", "s/2/my_mask.nii.gz"), "c+x": ("s/3/c+x_T1.nii.gz", None)}
    with pytest.raises(Exception, match="no label for scan"):
        L.resolve_scan_files(scans, files, require_labels=True).collect()


def test_discover_files_prefers_a_copy(spark):
    files = spark.createDataFrame([(f"d/{p}",) for p in ("Image_uvauser1.nii.gz", "z_image.nii.gz", "uvauser2 copy.nii.gz", "other.nii")], "path string")
    series = spark.createDataFrame([("s", "d"), ("t", "e")], "id string, dir string")
    got = {r["id"]: (r["image"], r["segmentation"], r["multiple"]) for r in L.discover_files(series, files).collect()}
    assert got == {"s": ("d/Image_uvauser1.nii.gz", "d/uvauser2 copy.nii.gz", True), "t": (None, None, False)}
    assert L.list_segmentations(series, files).count() == 2


def test_schema_helpers(spark):
    df = spark.createDataFrame([("x", "1")], "`Registration Classification ` string, a string")
    got = L.canonicalise(df, {"Registration Classification": "flag"}, ["flag", "zz", "a"])
    assert got.columns == ["flag", "a"]
    with pytest.raises(ValueError, match="missing columns"):
        require_columns(df, ["a", "b"])
    with pytest.raises(ValueError, match="none of"):
        L.first_present(df, ["q"])


def test_names(spark):
    assert one(spark, P.safe_id("p"), p="  ") == "case" and one(spark, P.safe_id("p"), p=" a b/c ") == "a_b_c"
    assert one(spark, P.safe_name("p"), p="..a:b  c. ") == "a_b_c" and one(spark, P.safe_name("p"), p="._") == "node"
    assert one(spark, P.first_nonempty("a", "b"), a=" ", b=" x ") == "x"
    assert one(spark, P.blank_to_null("p"), p="nan") is None
    assert one(spark, F.array_join(P.expected_names("p"), ","), p="s") == "s_bet.nii.gz,s_bet_mask.nii.gz,s_mask.nii.gz"
