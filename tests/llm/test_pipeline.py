from itertools import combinations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from voxelcohort.session import cut_lineage

from brute import DOCS, shingle_set, union_find, words_of
from test_bpe import KNOWN
from test_shared_text import brute as brute_repeats


@pytest.fixture(scope="module")
def tables(spark, sf):
    """What every stage leaves on the smallest documents."""
    out = [spark.read.parquet(f"{sf}/documents.parquet")]
    for _, stage in cp.STAGES:
        out.append(cut_lineage(stage(spark, out[-1], sf)))
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns(tables):
    for df in tables[1:-1]:
        assert [(n, t) for n, t in df.dtypes if n in cp.COLUMNS] == tables[0].select(*cp.COLUMNS).dtypes


def test_language_keeps_clean_documents(tables):
    raw, kept = rows(tables[0]), rows(tables[1])
    assert len(kept) >= 0.97 * len(raw)
    assert all(kept[i]["text"] == raw[i]["text"] for i in kept)


def test_low_confidence_keeps_documents_with_letters(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "eins two trois", "en", "a", 14), (2, "a b", None, "a", 3), (3, "12", "en", "a", 2)], DOCS)
    judged = F.when(F.col("text").rlike(r"\p{L}"), F.lit("en")).otherwise(F.lit("und"))
    monkeypatch.setattr(cp.langid, "train", lambda df: object())
    monkeypatch.setattr(cp.langid, "predict", lambda df, net: df.withColumn("lang_pred", judged).withColumn("score", F.lit(0.35)))
    assert {i: r["lang"] for i, r in rows(cp.language(spark, docs, "")).items()} == {1: "en", 2: "en"}


def test_near_duplicates_equal_all_pairs(tables):
    before = rows(tables[1])
    sets = {i: shingle_set(r["text"], 5) for i, r in before.items()}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    assert set(rows(tables[2])) == {i for i, c in union_find(sets, links).items() if i == c}


def test_repeated_passages_equal_brute_force(tables):
    before, after = rows(tables[2]), rows(tables[3])
    ids = sorted(before)
    for i, (n, removed, kept) in zip(ids, brute_repeats([before[i]["text"] for i in ids], 35)):
        if removed and removed == n:
            assert i not in after
        else:
            assert after[i]["text"] == (kept if removed else before[i]["text"])


def test_mixture_copies(spark, tables):
    from voxelcohort.llm.mixing import mix_sources

    plan = {r["doc_id"]: r for r in mix_sources(tables[3]).collect()}
    copies = {r["doc_id"]: r["count"] for r in tables[4].groupBy("doc_id").count().collect()}
    for i, r in plan.items():
        assert copies.get(i, 0) == (int(r["taken"] / r["size"] + 0.5) if r["size"] else 0)
    words = sum(len(words_of(r["text"])) for r in tables[4].collect())
    assert abs(words - 1.5 * sum(r["size"] for r in plan.values())) < 0.05 * words


def test_ids(tables):
    before = rows(tables[4])
    for r in tables[5].collect():
        assert list(r["ids"]) == KNOWN.encode_ordinary(before[r["doc_id"]]["text"]) and r["round_trip"]


def test_edge_rows(spark):
    given = [(1, None, "en", "a", 0), (2, "", "en", None, None), (3, "one two three", None, "a", 13), (3, "one two three", None, "a", 13), (None, "four five", "en", None, 9), (None, None, None, None, None), (4, "12 34", "en", "b", 5)]
    docs = spark.createDataFrame(given, DOCS).withColumn("component_id", F.lit("clash")).withColumn("ids", F.lit(1))
    for _, stage in cp.STAGES:
        docs = cut_lineage(stage(spark, docs, ""))
    assert {r["doc_id"] for r in docs.collect()} <= {3, None} and all(r["round_trip"] for r in docs.collect())
    empty = spark.createDataFrame([], DOCS)
    for _, stage in cp.STAGES:
        empty = cut_lineage(stage(spark, empty, ""))
    assert empty.count() == 0


def test_a_text_above_a_slice_goes_through_all_stages(spark, sf):
    long = " ".join(f"word{i} of the long text" for i in range(30_000))
    docs = spark.createDataFrame([(1, long, "en", "a", len(long)), (2, long, "en", "a", len(long)), (3, "a short text in english", "en", "b", 23), (4, "ein kurzer text", "de", "b", 15)], DOCS)
    for name, stage in cp.STAGES:
        docs = cut_lineage(stage(spark, docs, sf))
        if name == "jaccard_join":
            assert {r["doc_id"] for r in docs.collect()} == {1, 3, 4}
    assert all(r["round_trip"] for r in docs.collect()) and 1 in {r["doc_id"] for r in docs.collect()}
