"""Connected components by alternating stars, one stored table a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelcohort.session import cut_lineage


def apart(df: DataFrame, key: str) -> DataFrame:
    """The frame with a long key that Spark does not know to be grouped already.

    A join with a grouped frame keeps its grouping, and then Spark cannot split
    the other side's hot keys. With the key computed anew both sides get an exchange
    of their own, and skewed partitions are split.
    """
    return df.withColumn(key, F.bitwise_not(F.bitwise_not(F.col(key))))


def perhaps_in(df: DataFrame, key: str, wanted: DataFrame, name: str = "_perhaps") -> DataFrame:
    """Adds boolean ``name``, true where ``key`` is one of the wanted keys and on few other rows; null keys give false.

    A join that needs only some rows then exchanges little more than those. The
    wanted keys set one bit each, 16 bits for each key up to 8 MB in all, so with
    very many keys more rows than needed are true but none is missed.
    """
    bits = 1 << min(26, max(15, (16 * wanted.count()).bit_length()))
    place = F.pmod(F.xxhash64(key), F.lit(bits)) + 1
    marks = wanted.filter(F.col(key).isNotNull()).select(F.bitmap_bucket_number(place).alias("_bucket"), F.bitmap_bit_position(place).alias("_bit"))
    maps = marks.repartition("_bucket").groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    asked = df.withColumns({"_bucket": F.bitmap_bucket_number(place), "_bit": F.bitmap_bit_position(place)})
    byte = F.conv(F.hex(F.substring("_bits", (F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1, F.lit(False)) & F.col(key).isNotNull()
    return asked.join(F.broadcast(maps), "_bucket", "left").select(*df.columns, hit.alias(name))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of its neighbourhood."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(apart(least, "u"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them; edges point from larger to smaller."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    kept = edges.join(apart(least, "u"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return kept.unionAll(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from each node: edges ``(a, b)`` long in, ``(node, component)`` out.

    Alternating large-star and small-star rounds (Kiveris et al. 2014) run until
    nothing changes, about the square of the logarithm of the longest path. A
    hub's edges are reduced by a partial minimum before they are exchanged, and
    the join back on a hub is one that Spark can split. Nodes without an edge to
    another node, and null nodes, are not in the result. Each round is a table in
    the shared folder, so a lost executor repeats a task and not the loop.
    """
    now = cut_lineage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("a is not null and b is not null and u != v").distinct())
    tally = None
    while True:
        now = cut_lineage(_small_star(_large_star(now)), instead_of=now)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(state) == tally:
            break
        tally = tuple(state)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
