from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelcohort.llm import jaccard

from brute import shingle_set, union_find


def brute(rows, k, num, den):
    sets = {i: shingle_set(t, k) for i, t in rows}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    part = union_find(sets, links)
    return {i: (len(sets[i]), part[i]) for i in sets}


def found(df, **how):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_groups(df, **how).collect()}


@pytest.mark.parametrize(("k", "num", "den", "seed", "longest"), [(3, 90, 100, 1, 60), (5, 8, 10, 2, 60), (1, 7, 10, 3, 12), (3, 90, 100, 4, 300)])
def test_groups_equal_all_pairs(docs_of, corpus, monkeypatch, k, num, den, seed, longest):
    monkeypatch.setattr(jaccard, "TILE_TEXTS", 5)  # several tiles in every larger family
    rows = list(enumerate(corpus(250, seed, longest=longest)))
    assert found(docs_of(rows), words=k, num=num, den=den) == brute(rows, k, num, den)


def test_every_linked_pair_shares_a_key():
    rng = np.random.default_rng(8)
    for num, den in ((90, 100), (8, 10), (5, 10)):
        for size in (2, 3, 9, 10, 11, 40, 77, 400, 2000):
            base = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
            lost = int(rng.integers(0, max(1, len(base) * (den - num) // den) + 1))
            other = np.sort(base[lost:])
            sets = [base, other]
            values, first = np.concatenate(sets), np.array([0, len(base), len(base) + len(other)])
            if den * len(other) < num * len(base) or len(base) == len(other):
                continue
            keys, at = jaccard.band_keys(values, first, num, den)
            assert set(keys[at[0] : at[1]]) & set(keys[at[1] : at[2]]), (num, den, size, lost)


def test_hamming_never_exceeds_the_symmetric_difference():
    rng = np.random.default_rng(2)
    a = np.unique(rng.integers(0, 2**63, 500, dtype=np.uint64))
    b = np.unique(np.concatenate([a[50:], rng.integers(0, 2**63, 70, dtype=np.uint64)]))
    s = jaccard.check_sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
    assert np.bitwise_count(s[0] ^ s[1]).sum() <= len(set(a.tolist()) ^ set(b.tolist()))


def test_folded_sketches_never_exceed_the_symmetric_difference():
    rng = np.random.default_rng(4)
    for size in (1, 150, 175, 1400):
        a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        b = np.unique(np.concatenate([a[size // 10 :], rng.integers(0, 2**63, size // 5, dtype=np.uint64)]))
        s = jaccard.folded(jaccard.sized_sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])).to_pylist())
        assert np.bitwise_count(s[0] ^ s[1]).sum() <= len(set(a.tolist()) ^ set(b.tolist()))


def test_texts_that_only_quote_each_other_are_not_verified_in_tiles(docs_of, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE_TEXTS", 8)
    texts, inner = [], jaccard.map_groups

    def counted(df, keys, fn, schema):
        if keys == ["family", "i", "j"]:
            texts.append(df.count())
        return inner(df, keys, fn, schema)

    monkeypatch.setattr(jaccard, "map_groups", counted)
    # each text shares 40 of its 50 words with the next; the last two are near copies of the first
    rows = [(k, " ".join(f"w{x}" for x in range(10 * k, 10 * k + 50))) for k in range(60)]
    rows += [(100, rows[0][1] + " a"), (101, rows[0][1] + " b")]
    assert found(docs_of(rows), words=5, num=8, den=10) == brute(rows, 5, 8, 10)
    assert texts[0] <= len(rows)


def test_nulls_empty_short_and_repeated_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one TWO"), (6, "one two three"), (6, "one two three"), (7, "é É"), (8, "é é"), (None, "one two"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1)).withColumn("keys", F.lit("x")).withColumn("component", F.lit(2))
    got = sorted(map(tuple, jaccard.jaccard_groups(df, words=3, num=90, den=100).collect()), key=str)
    expected = [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (6, 1, 6), (7, 1, 7), (8, 1, 8), (None, 0, None), (None, 1, None)]
    assert got == sorted(expected, key=str)


def test_empty_table(docs_of):
    assert jaccard.jaccard_groups(docs_of([])).count() == 0


def test_texts_without_an_id_still_connect(docs_of):
    """The text of the rows without an id is linked with both others, which are not linked with each other."""
    words = [f"w{i}" for i in range(60)]
    near = lambda a, b: " ".join(words[: 60 - a] + [f"x{i}" for i in range(b)])
    texts = [near(3, 0), near(0, 0), near(0, 3)]
    sets = [shingle_set(t, 5) for t in texts]
    share = lambda a, b: len(a & b) / len(a | b)
    assert share(sets[0], sets[1]) >= 0.94 and share(sets[1], sets[2]) >= 0.94 and share(sets[0], sets[2]) < 0.92
    rows = [(1, texts[0]), (None, texts[1]), (None, texts[1]), (2, texts[2])]
    got = sorted(map(tuple, jaccard.jaccard_groups(docs_of(rows), words=5, num=94, den=100).select("doc_id", "component_id").collect()), key=str)
    assert got == [(1, 1), (2, 1), (None, None), (None, None)]


def test_a_text_above_a_slice(docs_of):
    long = " ".join(f"w{i}" for i in range(120_000))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_groups(docs_of([(1, long), (2, long + " more"), (3, "w1 w2 w3 w4 w5")])).collect()}
    assert got == {1: (119_996, 1), 2: (119_997, 1), 3: (1, 3)}
