import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from voxelcohort.llm import exact


def brute(rows):
    groups = {}
    for id, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(id)
    out = []
    for norm, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), keep is None or i == keep, hashlib.sha256(norm.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


ROWS = [(5, "a  b"), (3, "a\t\nb"), (9, "a b "), (1, None), (2, ""), (None, "a b"), (None, "x"), (None, "x"), (7, "a b"), (7, "a b"), (8, " "), (10, "A b"), (11, " "), (12, "y " * 300_000), (13, "y\n" * 300_000)]


@pytest.mark.parametrize("bits, capacity", [(64, 1 << 26), (64, 40), (3, 40), (0, 1)])
def test_equals_brute_force(spark, bits, capacity):
    """Weak keys make every text collide; small buckets make the directory double."""
    rng = random.Random(bits)
    rows = ROWS + [(100 + i, " ".join(rng.choice("abc") for _ in range(rng.randrange(1, 5)))) for i in range(300)] + [(1000 + i, "hot text") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("norm", F.lit("n")).withColumn("bucket", F.lit(2))
    got = exact.exact_groups(df, bucket_bytes=capacity, key_bits=bits).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_query_and_oracle(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(exact.OP13_SQL).fetchall(), key=str)
    assert sorted((tuple(r) for r in exact.op13_exact(spark, str(tmp_path)).collect()), key=str) == want == brute(ROWS)


def test_empty_table(spark):
    assert exact.exact_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_directory_splits_overfull_buckets_only(spark):
    keys = [(k << 60, 10) for k in range(-8, 8)] + [(5 + (i << 30), 10) for i in range(32)]
    df = spark.createDataFrame(keys, "key long, bytes long")
    leaves = exact.grow_directory(df, 100).collect()
    assert sum(r["n_keys"] for r in leaves) == len(set(keys)) and all(r["bytes"] <= 100 for r in leaves)
    assert len({r["depth"] for r in leaves}) > 1
    placed = exact.bucket_of(df, exact.grow_directory(df, 100)).collect()
    starts = sorted(r["bucket"] for r in leaves)
    assert len(placed) == len(keys)
    for r in placed:
        assert r["bucket"] == max(s for s in starts if s <= r["key"])


def test_one_key_is_never_split(spark):
    leaves = exact.grow_directory(spark.createDataFrame([(7, 10**9), (-7, 1)], "key long, bytes long"), 100).collect()
    assert sorted((r["n_keys"], r["bytes"]) for r in leaves) == [(1, 1), (1, 10**9)]


def test_plan_has_no_python(spark):
    df = exact.exact_groups(spark.createDataFrame(ROWS, "doc_id long, text string"))
    assert "Python" not in df._jdf.queryExecution().toString() and "InArrow" not in df._jdf.queryExecution().toString()
