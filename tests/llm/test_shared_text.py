import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from voxelcohort.llm import shared_text
from voxelcohort.llm.shared_text import mark_repeats

from brute import words_of


def brute(texts, w):
    docs = [words_of(t) for t in texts]
    seen = Counter(tuple(d[i : i + w]) for d in docs for i in range(len(d) - w + 1))
    out = []
    for d in docs:
        gone = set()
        for i in range(len(d) - w + 1):
            if seen[tuple(d[i : i + w])] > 1:
                gone.update(range(i, i + w))
        out.append((len(d), len(gone), b" ".join(x for i, x in enumerate(d) if i not in gone).decode()))
    return out


@pytest.mark.parametrize(("window", "seed"), [(1, 1), (2, 2), (5, 3), (8, 4), (35, 5)])
def test_equals_brute_force(docs_of, monkeypatch, window, seed):
    monkeypatch.setattr(shared_text, "BUCKET_BYTES", 2000)
    rng = random.Random(seed)
    vocab = ["a", "A", "b,", "é", "dd", "eee"] if window < 35 else [f"w{i}" for i in range(50)]
    passages = [[rng.choice(vocab) for _ in range(window + rng.randrange(-1, 9))] for _ in range(6)]
    texts = []
    for _ in range(90):
        words = []
        for _ in range(rng.randrange(0, 4)):
            words += rng.choice(passages) if rng.random() < 0.4 else [rng.choice(vocab) for _ in range(rng.randrange(window + 3))]
        texts.append(rng.choice([" ", "\n", " \t"]).join(words))
    texts += [texts[0], (" ".join(passages[0]) + " ") * 7, "", None]
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept"], sum(s["words"] for s in r["spans"])) for r in mark_repeats(docs_of(list(enumerate(texts))), window=window).collect())
    assert got == [(i, n, k, t, k) for i, (n, k, t) in enumerate(brute(texts, window))]


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    rows = [(1, "a b c"), (1, "a b c"), (None, "x y"), (2, None), (None, "q r s t")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(5)).withColumn("part", F.lit("p")).withColumn("packed", F.lit(None).cast("map<string,int>"))
    out = mark_repeats(df, window=3)
    assert out.columns == ["doc_id", "text", "part", "packed", "n_words", "n_removed", "spans", "kept"]
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in out.collect()), key=str) == sorted([(1, 3, 3, ""), (1, 3, 3, ""), (None, 2, 0, "x y"), (2, 0, 0, ""), (None, 4, 0, "q r s t")], key=str)
    assert mark_repeats(df.limit(0), window=3).count() == 0


def test_a_text_above_a_slice(docs_of):
    """A passage at the far end of a text of a megabyte, and that text twice."""
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(10**9)}"
    passage, long, twice = " ".join(word() for _ in range(60)), " ".join(word() for _ in range(90_000)), " ".join(word() for _ in range(60_000))
    texts = [f"{long} {passage}", f"start {passage} end", twice, twice]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in mark_repeats(docs_of(list(enumerate(texts))).select("doc_id", "text")).collect()}
    assert got == {0: (90_060, 60, long), 1: (62, 60, "start end"), 2: (60_000, 60_000, ""), 3: (60_000, 60_000, "")}
