import numpy as np
from pyspark.sql import functions as F

from voxelcohort.llm import langid


def test_gradients_equal_finite_differences():
    net = langid.GatedNetwork(["a", "b", "c"], hidden=3, seed=2)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 256, (4, 6)).astype(np.uint8), np.array([0, 1, 2, 1])
    _, g = net.gradients(x, y)
    for name in net.p:
        used = [tuple(i) for i in np.argwhere(np.abs(g[name]) > 1e-6)[:: max(1, g[name].size // 40)][:6]]
        for i in used:
            keep, step = net.p[name][i], 1e-4
            net.p[name][i] = keep + step
            up, _ = net.gradients(x, y)
            net.p[name][i] = keep - step
            down, _ = net.gradients(x, y)
            net.p[name][i] = keep
            assert abs((up - down) / (2 * step) - g[name][i]) < 2e-3 * max(1, abs(g[name][i])) + 1e-4


def test_slices_give_the_same_labels_as_single_texts():
    import pyarrow as pa

    from voxelcohort.llm.text import slices

    net = langid.GatedNetwork(["a", "b"], seed=4)
    texts = ["x", "", "abc " * 70, "é" * 200]
    together = next(slices(pa.array(texts)))
    sums, votes = net.label_slice(together)
    for k, t in enumerate(texts):
        one, v = net.label_slice(next(slices(pa.array([t]))))
        np.testing.assert_allclose(sums[k], one[0], atol=1e-3)
        assert votes[k].sum() == len(t.encode()) == v.sum()


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = langid.op2_language_id(spark, sf).join(docs.select("doc_id", "lang", "text"), "doc_id")
    rows = [r for r in out.collect() if r["held_out"]]
    assert len(rows) > 30 and np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_undetermined_nulls_and_clashes(spark):
    rows = [(1, None, "en"), (2, "12 :-) \n", "en"), (3, "the thing that", "en"), (3, "the thing that", "en"), (None, "der die das", "de"), (4, "x", None), (5, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("s")).withColumn("label", F.lit(1)).withColumn("h", F.lit(1))
    net = langid.train(df, per_lang=5)
    out = {r["doc_id"]: r for r in langid.predict(df, net).collect()}
    assert set(net.labels) == {"en", "de"}
    assert [out[i]["lang_pred"] for i in (1, 2, 5)] == ["und"] * 3 and out[1]["score"] == 0
    assert out[3]["lang_pred"] in net.labels and sum(out[3]["lang_bytes"].values()) == len("the thing that")
    assert langid.train(df.filter("lang is null")) is None
    assert {r["lang_pred"] for r in langid.predict(df, None).collect()} == {"und"}
    assert langid.predict(df.limit(0), net).count() == 0


def test_a_hot_text_leaves_room_in_the_sample(spark):
    rows = [("the same text", "en")] * 900 + [(f"text {i}", "en") for i in range(50)] + [(f"texte {i}", "fr") for i in range(30)]
    sample = langid.labelled_sample(spark.createDataFrame(rows, "text string, lang string"), "text", "lang", 40, 100)
    pieces = {k: [p for lang, _, p in sample if lang == k] for k in ("en", "fr")}
    assert len(pieces["en"]) == len(set(pieces["en"])) == 40 and len(set(pieces["fr"])) == len(pieces["fr"]) == 30


def test_a_text_above_a_slice_and_ties(spark):
    rows = [(1, "english words and more of them " * 40_000, "en"), (2, "english words", "en"), (2, "english words", "en"), (3, "mots anglais " * 20, "fr"), (4, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.predict(df, langid.train(df)).collect()
    assert len(got) == 5 and len({(r["lang_pred"], r["score"]) for r in got if r["doc_id"] == 2}) == 1
    (long,) = (r for r in got if r["doc_id"] == 1)
    assert sum(long["lang_bytes"].values()) == len(rows[0][1])
