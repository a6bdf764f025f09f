import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxelcohort.llm import toxicity


def slow_segments(score):
    """By definition: the best segment, the longest of equals from the left having no empty edge, and so on in what lies beside it."""

    def within(lo, hi):
        best = None
        for a in range(lo, hi):
            total = 0.0
            for b in range(a, hi):
                total += score[b]
                if best is None or total > best[0] + 1e-9:
                    best = (total, a, b + 1)
        if best is None or best[0] <= 1e-9:
            return []
        return within(lo, best[1]) + [best[1:]] + within(best[2], hi)

    return within(0, len(score))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-6, 6), max_size=18).map(lambda v: [x + (i % 7) * 0.013 + 0.001 * i * i + 0.00037 for i, x in enumerate(v)]))
def test_segments_equal_their_definition(score):
    got = toxicity.maximal_segments(np.array(score, float))
    assert [(a, b) for a, b, _ in got] == slow_segments(score)
    for a, b, s in got:
        assert s == pytest.approx(sum(score[a:b]))


def test_log_odds_need_evidence_and_take_zero_counts():
    counts = np.full((4, toxicity.CELLS), 5.0)
    counts[:, 0] = (0, 300, 0, 400)
    counts[:, 1] = (300, 0, 300, 0)
    counts[:, 2] = (0, 1, 0, 50)
    lexicon = toxicity.log_odds(counts, counts.sum(1))
    assert lexicon[0] > 3 and lexicon[1] < -3 and lexicon[2] == 0 and not lexicon[3:].any()
    none = np.zeros((4, toxicity.CELLS))
    assert not toxicity.log_odds(none, none.sum(1)).any()


def tokens_of(text):
    """Per word, the keys that it is looked up by: itself and its first 4, 5 and 6 characters."""
    words = re.findall(r"[A-Za-z\u0080-\U0010ffff]+", text or "")
    lower = ["".join(c.lower() if c.isascii() else c for c in w) for w in words]
    return [[(k, w[:k] if k else w) for k in toxicity.STEMS if len(w) >= k] for w in lower]


def plain_evidence(key, counts, totals):
    """Shrunk log-odds of one key from its four counts."""
    clean, toxic, clean_n, toxic_n = counts.get(key, (0, 0, 0, 0))
    if clean + toxic == 0:
        return 0.0
    prior = toxicity.PRIOR * (clean_n + toxic_n + 0.5) / (totals[2] + totals[3] + 0.5 * toxicity.CELLS)
    odds = [math.log((n + prior) / (total + toxicity.PRIOR - n - prior)) for n, total in ((toxic_n, totals[3]), (clean_n, totals[2]))]
    delta, expected = odds[0] - odds[1], (clean + toxic) * totals[1] / (totals[0] + totals[1])
    ratio = (toxic * math.log(toxic / expected) if toxic else 0) + (clean * math.log(clean / (clean + toxic - expected)) if clean else 0)
    if ratio <= 0 or (delta > 0) != (toxic * totals[0] > clean * totals[1]):
        return 0.0
    delta *= max(0.0, 1 - toxicity.SURE**2 / (2 * ratio))
    return delta if abs(delta) >= toxicity.LEAST else 0.0


def plain_features(tokens, counts, totals):
    score = []
    for keys in tokens:
        each = [plain_evidence(k, counts, totals) for k in keys] + [0.0] * (len(toxicity.STEMS) - len(keys))
        score.append((max(each) if max(each) > 0 else max(min(each), -1)) - toxicity.GAP_COST)
    parts = [sum(score[a:b]) for a, b in slow_segments(score)]
    return len(score), max(parts, default=0.0), sum(parts), sum(x > 0 for x in score), sum(x > toxicity.STRONG for x in score)


def plain_scores(rows, labels, held):
    """The whole query with dicts: counts, leave-one-out features for the fit, scores."""
    counts, texts = {}, {}
    for id, text in rows:
        if id in labels and not held(id):
            texts[id] = own = Counter(k for keys in tokens_of(text) for k in keys)
            for k, n in own.items():
                c = counts.setdefault(k, [0, 0, 0, 0])
                c[labels[id]] += 1
                c[labels[id] + 2] += n
    totals = [sum(c[i] for c in counts.values()) for i in range(4)]
    fit = []
    for id, text in rows:
        if id in texts:
            less = {k: [v - (i == labels[id]) - n * (i == labels[id] + 2) for i, v in enumerate(counts[k])] for k, n in texts[id].items()}
            fit.append((*plain_features(tokens_of(text), less, totals), labels[id]))
    c = toxicity.calibrate(*(np.array(v, float) for v in zip(*fit)))
    out = {}
    for id, text in rows:
        n, best, total, hits, strong = plain_features(tokens_of(text), counts, totals)
        z = (best - c.place - c.slope * math.log(n + 1)) / c.scale
        x = [1, min(max(z, -5), 20), math.log1p(best), math.log1p(total), total / (n + 20), min(best, 12), math.log1p(hits), math.log1p(strong), math.log(n + 1)]
        out[id] = 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, c.weights))))
    return out


def test_query_equals_a_plain_version(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows, labels = [], {}
    for i in range(240):
        words = [f"{rng.choice(['ka', 'le', 'möri', 'sontu'])}{rng.choice(['', 'ta', 'nissa', 'é'])}" for _ in range(rng.integers(0, 25))]
        if i % 4 == 0:
            words[3:3] = [str(rng.choice(["Éxecrab", "éxecrable", "vileness", "vilest"])) for _ in range(3)]
        rows.append((i, " ".join(words) + f" unique{chr(97 + i % 26)}{chr(97 + i // 26)}"))
        if i % 7:
            labels[i] = int(i % 4 == 0)
    rows += [(500, None), (501, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([*labels.items(), (9999, 1), (7, None)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    want = plain_scores(rows, labels, held)
    got = {r["doc_id"]: r for r in toxicity.op8_toxicity(spark, str(tmp_path)).collect()}
    assert set(got) == set(want)
    for i, p in want.items():
        assert got[i]["score"] == pytest.approx(p, abs=1e-4) and got[i]["held_out"] == held(i)
        assert got[i]["predicted"] == int(got[i]["score"] >= 0.7)


def test_supplied_labels(spark):
    """Held-out documents of the largest supplied tables, through the registered query."""
    sf = "/root/testdata/sf0.1"
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").filter("toxic is not null").collect()}
    rows = [r for r in toxicity.op8_toxicity(spark, sf).collect() if r["held_out"] and r["doc_id"] in toxic]
    hit = [r["predicted"] for r in rows if toxic[r["doc_id"]] == 1]
    false = [r["predicted"] for r in rows if toxic[r["doc_id"]] == 0]
    assert np.mean(hit) >= 0.9 and np.mean(false) <= 0.005


def texts(spark, n=400):
    rng = np.random.default_rng(9)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{rng.integers(60)}" for _ in range(rng.integers(5, 120))]
        bad = i % 5 == 0
        if bad:
            for _ in range(4):
                words.insert(int(rng.integers(len(words))), rng.choice(["Scum", "scum,", "scummy"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_held_out_documents(spark):
    df, labels, truth = texts(spark)
    scored = toxicity.score_toxicity(df, labels, usable=F.col("doc_id") % 3 != 1).collect()
    hidden = [r for r in scored if r["doc_id"] % 3 == 1]
    right = [(r["score"] >= 0.7) == bool(truth[r["doc_id"]]) for r in hidden]
    assert np.mean(right) > 0.97


def test_scores_do_not_see_held_out_labels(spark):
    df, labels, _ = texts(spark, 120)
    other = labels.withColumn("toxic", F.when(F.col("doc_id") % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    usable = F.col("doc_id") % 3 != 1
    a, b = ({r["doc_id"]: r["score"] for r in toxicity.score_toxicity(df, x, usable=usable).collect()} for x in (labels, other))
    assert a == b


def test_nulls_empties_and_clashes(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "scum scum"), (3, "123 !!"), (3, "123 !!")], "doc_id long, text string").withColumn("score", F.lit("s")).withColumn("best", F.lit(1)).withColumn("_label", F.lit(1))
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    out = toxicity.score_toxicity(df, labels).collect()
    assert len(out) == 5 and all(0 <= r["score"] <= 1 for r in out)
    assert len({round(r["score"], 9) for r in out if r["doc_id"] in (1, 2, 3)}) == 1
    assert toxicity.score_toxicity(df, labels.limit(0)).count() == 5
    assert toxicity.score_toxicity(df.limit(0), labels).count() == 0


def test_passages_are_byte_ranges(spark):
    df, labels, _ = texts(spark)
    extra = spark.createDataFrame([(9000, "w1 " * 30 + "scum scum scum scum scum scum" + " w2" * 30)], "doc_id long, text string")
    row = toxicity.score_toxicity(df.unionAll(extra), labels).filter("doc_id = 9000").first()
    assert len(row["passages"]) == 1
    span = row["passages"][0]
    assert ("w1 " * 30 + "scum scum scum scum scum scum" + " w2" * 30)[span["start"] : span["end"]] == "scum scum scum scum scum scum"


def test_a_text_above_a_slice(spark):
    df, labels, _ = texts(spark)
    long = spark.createDataFrame([(9000, "w1 w2 " * 200_000 + "scum scum scum scum " + "w3 " * 200_000), (9001, "w1 w2 " * 300_000)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(df.unionAll(long), labels).filter("doc_id >= 9000").collect()}
    assert got[9000]["n_words"] == 600_004 and [(p["start"], p["end"]) for p in got[9000]["passages"]] == [(1_200_000, 1_200_019)]
    assert got[9001]["passages"] == []
