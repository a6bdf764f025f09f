import random

import duckdb
import pytest
from pyspark.sql import functions as F

from voxelcohort.llm import mixing

from brute import words_of


def expected_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, out, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        for s in full:
            out[s] = 2 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets_and_taken(docs_of, seed):
    rng = random.Random(seed)
    names = [None, "", "a", "B", "é", "zz", "\U0001f600"][: 3 + 2 * seed]
    rows = [(i, " ".join("w" for _ in range(rng.randrange(0, 200))), "en", rng.choice(names + names[:1] * 5)) for i in range(400)]
    got = mixing.mix_sources(docs_of(rows)).collect()
    assert len(got) == len(rows)
    sizes, taken = {}, {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert r["taken"] <= 2 * r["size"]
    want = expected_targets(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.5
    again = mixing.mix_sources(docs_of(rows[::-1])).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_oracle_on_nulls_and_repeated_rows(spark, tmp_path):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (None, "q", None), (2, None, "x"), (3, " ", None), (4, "l m n o p q r", "y"), (None, "q", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("place", F.lit(1)).withColumn("cell", F.lit("c")).withColumn("n", F.lit(2))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(mixing.OP3_SQL).fetchall(), key=str)
    assert sorted((tuple(r) for r in mixing.op3_mixing(spark, str(tmp_path)).collect()), key=str) == want
    assert sum(r[4] for r in want) > 0


def test_a_small_source_beside_a_huge_one(spark, docs_of, tmp_path):
    """3,000,000 words make blocks of 5 words for the large source; the query gives the others their targets to the word."""
    huge, small = " ".join(["w"] * 15_000), " ".join(["w"] * 10)
    rows = [(i, huge, "en", "a") for i in range(200)] + [(1000 + i, small, "en", "b") for i in range(100)] + [(2000, "one two three", "en", "c"), (2001, "", "en", "c")]
    docs_of(rows).write.parquet(str(tmp_path / "documents.parquet"))
    source = {r[0]: r[3] for r in rows}
    sizes, taken = {}, {}
    for r in mixing.op3_mixing(spark, str(tmp_path)).collect():
        s = source[r["doc_id"]]
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert sizes == {"a": 3_000_000, "b": 1000, "c": 3}
    want = expected_targets(sizes)
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes) and taken["b"] == 2000 and taken["c"] == 6


@pytest.mark.parametrize("slots, fewest", [(1, 1), (7, 3), (50, 1000)])
def test_what_is_taken_does_not_depend_on_the_blocks(docs_of, slots, fewest):
    rng = random.Random(slots)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(0, 90))), "en", rng.choice("aaaaabbc")) for i in range(300)]
    want = sorted(map(str, mixing.mix_sources(docs_of(rows)).collect()))
    assert sorted(map(str, mixing.mix_sources(docs_of(rows), slots=slots, fewest=fewest).collect())) == want


def test_no_words_and_no_rows(docs_of):
    got = mixing.mix_sources(docs_of([(1, "", "en", "a"), (2, None, "en", "b")])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in got] == [(0, 0.0, 0)] * 2
    assert mixing.mix_sources(docs_of([])).count() == 0


def plan_of(spark, sources, slots, fewest):
    """A plan for sources of (size, target)."""
    rows = [(str(k), k, size, float(target)) for k, (size, target) in enumerate(sources, 1)]
    return mixing.block_plan(spark.createDataFrame(rows, "source string, place int, source_size long, target double"), slots, fewest)


def test_any_run_of_slots_is_balanced(spark):
    rows = sorted(mixing.schedule(spark, plan_of(spark, [(10**6, 600), (10**6, 300), (10**6, 100)], 1000, 1000)).collect())
    assert len(rows) == 1000 and [sum(r["words"] for r in rows if r["place"] == p) for p in (1, 2, 3)] == [600, 300, 100]
    for lo in range(0, 900, 50):
        places = [r["place"] for r in rows[lo : lo + 50]]
        assert [abs(places.count(p) - 50 * w) <= 3 for p, w in ((1, 0.6), (2, 0.3), (3, 0.1))] == [True] * 3
    assert [r["block"] for r in rows if r["place"] == 2] == list(range(300))


@pytest.mark.parametrize("seed", range(4))
def test_every_source_has_all_its_uses(spark, seed):
    rng = random.Random(seed)
    sources = [(size := rng.choice([1, 2, 3, 10, 1000, 123_457]), rng.uniform(0, 2 * size)) for _ in range(rng.randrange(1, 40))]
    rows = mixing.schedule(spark, plan_of(spark, sources, 5000, rng.choice([1, 7, 256]))).collect()
    got = {}
    for r in rows:
        got[r["place"]] = got.get(r["place"], 0) + r["words"]
        assert r["words"] > 0
    assert got == {k: int(t + 0.5) for k, (_, t) in enumerate(sources, 1) if t >= 0.5}


def test_word_count(spark):
    texts = ["", None, " ", "a", " a\tb\x0b\x0cc\r\n", "a b c", "x" * 50]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(mixing.word_count(F.col("t"))).collect()]
    assert got == [len(words_of(t)) for t in texts]
