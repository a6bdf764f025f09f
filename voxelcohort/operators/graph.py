"""Annotation graph as node and edge tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelcohort.functions import paths as P
from voxelcohort.operators.skew import in_order
from voxelcohort.session import cut_lineage, scratch_path


def valid_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose both ends are known."""
    ids = nodes.select("id")
    for end in ("source", "target"):
        edges = edges.join(ids.withColumnRenamed("id", end), end, "left_semi")
    return edges


def adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, direction, relation, other, other_label, confidence)`` without duplicates."""
    known = valid_edges(nodes, edges)
    ends = F.array(
        F.struct(F.col("source").alias("id"), F.lit("outgoing").alias("direction"), F.col("target").alias("other")),
        F.struct(F.col("target").alias("id"), F.lit("incoming").alias("direction"), F.col("source").alias("other")),
    )
    both = known.select("relation", "confidence", F.inline(ends)).distinct()
    return both.join(nodes.select(F.col("id").alias("other"), F.col("label").alias("other_label")), "other")


# fixed values of a rule's ``test`` column
TESTS = ("equals", "prefix", "suffix", "contains", "type", "label")


def classify(nodes: DataFrame, rules: Sequence[tuple]) -> DataFrame:
    """Adds ``group`` and ``secondary`` by the first matching rule: null and an empty array without one.

    A rule is ``(priority, test, text, group)`` or has its further groups as a
    fifth entry. The tests look at ``source_file``, ``type`` at ``file_type`` and
    ``label`` for a part of the label, whatever its case. Rules are a short
    configuration list and become one conditional expression.
    """
    source = F.coalesce("source_file", F.lit(""))
    tests = {
        "equals": lambda t: source == t, "prefix": lambda t: source.startswith(t), "suffix": lambda t: source.endswith(t),
        "contains": lambda t: source.contains(t), "type": lambda t: F.col("file_type") == t, "label": lambda t: F.lower("label").contains(t.lower()),
    }
    found = F
    for _, test, text, name, *more in sorted(rules, key=lambda r: r[0]):
        others = F.array(*[F.lit(m) for m in (more[0] if more else ())]).cast("array<string>")
        found = found.when(tests[test](text), F.struct(F.lit(name).alias("group"), others.alias("secondary")))
    told = nodes.withColumn("_rule", found.otherwise(F.lit(None).cast("struct<group:string,secondary:array<string>>")))
    return told.withColumns({"group": F.col("_rule.group"), "secondary": F.coalesce("_rule.secondary", F.array().cast("array<string>"))}).drop("_rule")


def _votes(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``(id, group, n)``: how many edges lead from a node to each group."""
    return (
        edges.join(labels.select(F.col("id").alias("other"), "group"), "other")
        .groupBy("id", "group").agg(F.count(F.lit(1)).alias("n"))
    )


def _both_ways(edges: DataFrame) -> DataFrame:
    ends = F.array(
        F.struct(F.col("source").alias("id"), F.col("target").alias("other")), F.struct(F.col("target").alias("id"), F.col("source").alias("other")))
    return edges.select(F.inline(ends))


def propagate_labels(nodes: DataFrame, edges: DataFrame, default: str, checked: bool = False) -> DataFrame:
    """Fill null ``group`` from the majority of the neighbours, round by round, until nothing changes.

    Rounds are synchronous and ties go to the smallest name. A node gets its label one
    round after its first neighbour, so only the labels of the last round vote, and
    only those of the last two rounds have to be left out. Each round is one part of a table in
    the shared folder, read as a whole at the end; a round without a new label is the last.
    Nodes never reached get ``default``. ``checked`` edges are those of :func:`valid_edges`.
    """
    spark = nodes.sparkSession
    known = cut_lineage(nodes.select("id", "group"))
    links = _both_ways(edges if checked else valid_edges(nodes, edges))
    open_ids = known.filter(F.col("group").isNull()).select("id")
    links = cut_lineage(links.join(open_ids, "id", "left_semi"))
    told = scratch_path(spark, "labels")
    schema = known.schema

    def add(labels: DataFrame, number: int) -> DataFrame:
        path = f"{told}/round={number}"
        labels.write.parquet(path)
        return spark.read.schema(schema).parquet(path)

    fresh, before, number = add(known.filter(F.col("group").isNotNull()), 0), None, 0
    while not fresh.isEmpty():
        # an open node had no labelled neighbour before, so only new labels vote
        best = _votes(links, fresh).groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "group")).alias("_b"))
        best = best.join(fresh.select("id"), "id", "left_anti")
        if before is not None:
            best = best.join(before.select("id"), "id", "left_anti")
        number += 1
        fresh, before = add(best.select("id", F.col("_b.group").alias("group")), number), fresh
    labels = spark.read.schema(schema).parquet(told).select("id", "group")
    return nodes.drop("group").join(labels, "id", "left").withColumn("group", F.coalesce("group", F.lit(default)))


def secondary_groups(nodes: DataFrame, edges: DataFrame, n: int = 2, checked: bool = False) -> DataFrame:
    """Further groups of each node, ``(id, rank, group, n)``: those its rule gave, then hints from its neighbours.

    Nodes without a source file get the ``n`` most common neighbour groups other
    than their own as hints, unless a rule gave them already; a hint's ``n`` counts
    its edges, a given group's is null. ``checked`` edges are those of :func:`valid_edges`.
    """
    known = "secondary" in nodes.columns
    given = nodes.select("id", F.posexplode("secondary").alias("_at", "group")) if known else nodes.limit(0).select("id", F.lit(0).alias("_at"), F.lit("").alias("group"))
    bare = nodes.filter(F.coalesce("source_file", F.lit("")) == "").select("id", F.col("group").alias("_own"), (F.size("secondary") if known else F.lit(0)).alias("_given"))
    votes = _votes(_both_ways(edges if checked else valid_edges(nodes, edges)), nodes)
    w = Window.partitionBy("id").orderBy(F.desc("n"), "group")
    ranked = votes.join(bare, "id").filter(F.col("group") != F.col("_own")).withColumn("_at", F.row_number().over(w)).filter(F.col("_at") <= n)
    fresh = ranked.join(given.select("id", "group"), ["id", "group"], "left_anti")
    hints = fresh.withColumn("rank", F.col("_given") + F.row_number().over(Window.partitionBy("id").orderBy("_at")))
    return given.select("id", (F.col("_at") + 1).alias("rank"), "group", F.lit(None).cast("long").alias("n")).unionByName(hints.select("id", "rank", "group", "n"))


def group_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("group").agg(F.count(F.lit(1)).alias("n"))


def unique_names(nodes: DataFrame, order: str, name: str = "id") -> DataFrame:
    """``(folder, note)`` per node: safe names, with ``__2``, ``__3``... for repeats in ``order``."""
    named = nodes.withColumns({"folder": P.community_folder("community"), "_base": P.safe_name(name)})
    placed = in_order(named, ["folder", "_base"], order, [name], position="_n")
    return placed.withColumn("note", F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat_ws("__", "_base", "_n"))).drop("_base", "_n")
