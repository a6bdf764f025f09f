"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks; DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelcohort.session import cut_lineage

#: About so many slots for the blocks of all large sources, and for those of each small one.
SLOTS, FEWEST = 1 << 20, 256
#: 2^32 divided by the golden ratio: slot t has the point t * GOLDEN mod 2^32.
GOLDEN = 2654435769
SPAN = 1 << 32
WEIGHTS = (3, 1, 2)
CHUNK = 4096
GRID = 4096


def word_count(text: Column) -> Column:
    """Number of runs of ``[^\\x20\\x09-\\x0D]``; 0 for null."""
    return F.coalesce(F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """Targets of sources: ``(source, source_size)`` in, with ``place``, ``weight`` and ``target`` out.

    Sources in code point order, null last, have the weights in turn. Together
    the targets are ``share`` of all sizes; none is above ``most`` times its
    source, what is over goes to the others by weight. The level at which the
    others are filled is the largest of the levels reached by giving the k
    sources with the least room their full room, over all k. One row a source is
    ordered in one task.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.orderBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = sizes.withColumn("place", F.row_number().over(order))
    rows = rows.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") - 1) % len(weights) + 1).cast("long")).withColumn("room", F.col("source_size") * most)
    before = Window.orderBy(F.col("room") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) * share - F.coalesce(F.sum("room").over(before), F.lit(0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    rows = rows.withColumn("level", level)
    return rows.withColumn("target", F.least(F.col("room").cast("double"), F.max("level").over(every) * F.col("weight"))).drop("room", "level")


def block_plan(targets: DataFrame, slots: int = SLOTS, fewest: int = FEWEST) -> DataFrame:
    """Blocks of each source: adds ``words`` (its target in whole words), ``block`` (words of a block), ``blocks`` and ``uses``.

    A block is a slot's share of all words, but a small source has shorter
    blocks, so that it has ``fewest`` uses too, and none is shorter than a word. ``uses`` is the number of slots that
    give ``words``: whole passes over the blocks, then blocks from the first on, the last of them in part.
    """
    sized = targets.withColumn("words", F.round("target").cast("long")).filter("words > 0")
    total = sized.agg(F.sum("words")).first()[0] or 0
    longest = max(1, math.ceil(total / slots))
    plan = sized.withColumn("block", F.least(F.lit(longest), F.ceil(F.col("words") / fewest)).cast("long"))
    plan = plan.withColumn("blocks", F.ceil(F.col("source_size") / F.col("block")).cast("long"))
    return plan.withColumn("uses", F.expr("words div source_size * blocks + cast(ceil(words % source_size / block) as long)"))


def schedule(spark: SparkSession, plan: DataFrame) -> DataFrame:
    """Low-discrepancy order of blocks: ``(slot, place, epoch, block, words)``.

    The golden-ratio point of a slot falls between two cumulative numbers of uses and so
    names a source; the r-th slot of a source takes its block r modulo the number
    of its blocks, and ``words`` of it. Any run of slots holds each source in its share but for a few
    slots. Among n points no gap is above 1.9 / n, so twice as many points as
    uses give every source its uses; the points beyond are left out.
    """
    order = Window.orderBy("place")
    total = plan.agg(F.sum("uses")).first()[0] or 0
    upto = F.sum("uses").over(order.rowsBetween(Window.unboundedPreceding, 0))
    bounds = plan.withColumn("hi", upto)
    edge = lambda n: F.floor(n.cast("decimal(20,0)") * F.lit(SPAN).cast("decimal(11,0)") / F.lit(max(1, total)).cast("decimal(20,0)")).cast("long")
    bounds = bounds.withColumn("lo", edge(F.col("hi") - F.col("uses"))).withColumn("hi", edge(F.col("hi")))
    step = SPAN // GRID
    bounds = bounds.select("place", "lo", "hi", "blocks", "uses", "words", "source_size", F.col("block").alias("length"), F.explode(F.sequence(F.expr(f"lo div {step}"), F.expr(f"(hi - 1) div {step}"))).alias("cell"))
    points = spark.range(2 * total + 2).select(F.col("id").alias("slot"), F.pmod(F.col("id") * F.lit(GOLDEN), F.lit(SPAN)).alias("u")).withColumn("cell", F.expr(f"u div {step}"))
    named = points.join(bounds, "cell").filter("u >= lo and u < hi").select("slot", "place", "blocks", "uses", "words", "source_size", "length", F.expr(f"slot div {CHUNK}").alias("chunk"))
    counts = named.groupBy("place", "chunk").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select("place", "chunk", (F.sum("n").over(Window.partitionBy("place").orderBy("chunk")) - F.col("n")).alias("first"))
    ranked = named.withColumn("k", F.row_number().over(Window.partitionBy("place", "chunk").orderBy("slot")) - 1).join(starts, ["place", "chunk"])
    ranked = ranked.withColumn("r", F.col("first") + F.col("k")).filter(F.col("r") < F.col("uses")).withColumn("block", F.col("r") % F.col("blocks"))
    # the last block of a pass ends with the source, and the last use with the target
    left = F.col("source_size") - F.col("block") * F.col("length")
    rest = F.expr("words % source_size") - F.col("block") * F.col("length")
    last = (F.col("r") == F.col("uses") - 1) & (F.expr("words % source_size") > 0)
    return ranked.select("slot", "place", F.expr("r div blocks").alias("epoch"), "block", F.least("length", F.when(last, rest).otherwise(left)).alias("words"))


def mix_sources(df: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2, slots: int = SLOTS, fewest: int = FEWEST) -> DataFrame:
    """What a mix takes of every document: ``id, source, size, source_size, target, taken``, one row for each input row.

    ``size`` counts words (null and empty texts: 0), ``taken`` the words that the
    mix takes, repeats counted, at most ``most`` times the size. A source is laid
    out in the order of a hash of id and text and cut into blocks of equal length. ``schedule`` deals
    golden-ratio slots to the sources and says how often, and with how many words, each block is used; a document
    has what is taken of its part of the blocks. Large or small, every source has its target, rounded to
    whole words. Null sources are a source of their own, null ids and texts count as empty; equal rows
    lie side by side, being interchangeable. An empty table gives none; with no
    words at all nothing is taken. Extra columns are not read. Reruns agree.

    Running sums are taken in 4096 hash cells a source first and inside a cell
    after that, so a source with a third of all rows is not ordered in one task.
    """
    spark = df.sparkSession
    key = F.md5(F.concat(F.coalesce(F.col(id).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).cast("binary"))
    rows = df.select(F.col(id).alias("id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), key.alias("h"))
    rows = cut_lineage(rows.withColumn("cell", F.substring("h", 1, 3)))
    sizes = rows.groupBy("source", "cell").agg(F.sum("size").alias("n"))
    targets = cut_lineage(source_targets(sizes.groupBy("source").agg(F.sum("n").alias("source_size")), weights, share, most))
    at = targets.select(F.col("source").alias("_source"), "place", "source_size", "target")
    cells = sizes.select("source", "cell", (F.sum("n").over(Window.partitionBy("source").orderBy("cell")) - F.col("n")).alias("base"))
    cells = cells.join(at, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumnsRenamed({"source": "_source", "cell": "_cell"})
    inside = Window.partitionBy("source", "cell").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("upto", F.sum("size").over(inside))
    placed = placed.join(cells, F.col("source").eqNullSafe(F.col("_source")) & (F.col("cell") == F.col("_cell"))).withColumn("lo", F.col("base") + F.col("upto") - F.col("size")).withColumn("hi", F.col("base") + F.col("upto"))
    kept = ["id", "source", "size", "source_size", "target", "place", "lo"]

    plan = cut_lineage(block_plan(targets, slots, fewest))
    uses = schedule(spark, plan).groupBy("place", "block", "words").agg(F.count(F.lit(1)).alias("uses"))
    length = plan.select("place", F.col("block").alias("length"))
    parts = placed.filter("size > 0").join(length, "place").withColumn("block", F.explode(F.sequence(F.expr("lo div length"), F.expr("(hi - 1) div length"))))
    parts = parts.withColumns({"_from": F.greatest(F.col("lo"), F.col("block") * F.col("length")), "_begin": F.col("block") * F.col("length")})
    # a use takes the first `words` words of its block
    used = F.greatest(F.least(F.col("hi"), F.col("_begin") + F.col("words")) - F.col("_from"), F.lit(0)) * F.col("uses")
    met = parts.select(*kept, "hi", "block", "_from", "_begin").join(uses, ["place", "block"], "left")
    taken = met.groupBy(*kept).agg(F.sum(F.coalesce(used, F.lit(0))).cast("long").alias("taken"))
    empty = placed.filter("size = 0").select(*kept, F.lit(0).cast("long").alias("taken"))
    return taken.unionAll(empty).select(F.col("id").alias(id), F.col("source").alias(source), "size", "source_size", "target", "taken")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all sources, weights 3, 1, 2 in turn, half as many words again."""
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
with docs as (select row_number() over () as row, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
              md5(coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))) as h from documents),
sizes as (select source, sum(size)::bigint as source_size from docs group by source),
ranked as (select *, row_number() over (order by source nulls last) as place from sizes),
weighed as (select *, [3, 1, 2][((place - 1) % 3 + 1)::int]::bigint as weight, source_size * 2 as room from ranked),
levels as (select *, ((sum(source_size) over ())::double * 1.5::double
             - coalesce(sum(room) over (order by room::double / weight::double, place rows between unbounded preceding and 1 preceding), 0)::double)
             / ((sum(weight) over ())::double - coalesce(sum(weight) over (order by room::double / weight::double, place rows between unbounded preceding and 1 preceding), 0)::double) as level from weighed),
targets as (select *, least(room::double, (max(level) over ()) * weight::double) as target from levels),
placed as (select d.*, t.source_size, t.target, round(t.target)::bigint as words, (sum(size) over (partition by t.place order by h, size, row rows between unbounded preceding and current row))::bigint as hi
           from docs d join targets t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
       case when size > 0 then size * (words // source_size) + greatest(least(hi, words % source_size) - (hi - size), 0) else 0 end::bigint as taken from placed
"""
