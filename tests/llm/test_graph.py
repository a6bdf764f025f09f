import random

from pyspark.sql import functions as F

from voxelcohort.llm.graph import components, perhaps_in

from brute import union_find


def check(spark, links):
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for a, b in links if a is not None and b is not None and a != b for x in (a, b)}
    assert got == union_find(nodes, [(a, b) for a, b in links if a in nodes and b in nodes])


def test_chain_star_and_random(spark):
    rng = random.Random(4)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, x) for x in range(1000, 1060)]
    mixed = [(rng.randrange(2000, 2080), rng.randrange(2000, 2080)) for _ in range(60)]
    check(spark, chain + star + mixed + [(5, 5), (None, 3), (3, None), (-4, 2), (-4, 2)])


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_perhaps_in_misses_no_wanted_key(spark):
    wanted = spark.range(0, 3000, 3).unionByName(spark.createDataFrame([(None,)], "id long"))
    df = spark.range(3000).unionByName(spark.createDataFrame([(None,)], "id long")).withColumn("text", F.lit("x"))
    got = perhaps_in(df, "id", wanted).collect()
    true = {r["id"] for r in got if r["_perhaps"]}
    assert len(got) == 3001 and set(range(0, 3000, 3)) <= true and None not in true and len(true) < 1300
    assert not perhaps_in(df, "id", wanted.limit(0)).filter("_perhaps").count()
