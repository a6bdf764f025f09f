"""Nearest neighbours by multiprobe p-stable hashing, reranked exactly."""

from __future__ import annotations

import itertools
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelcohort.session import cut_lineage

from .batches import by_group
from .vectors import as_doubles, by_dim, matrix, packed, travels_as, unpacked

TABLES, PROJECTIONS, WIDTH, PROBES = 6, 5, 1.6, 64
#: Slots to each side that a probe may lie away.
AWAY = 2
#: Vectors and queries that meet in one block.
BLOCK_VECTORS, BLOCK_QUERIES = 4096, 2048
#: Answers that a task holds to merge them.
HELD_ROWS = 1 << 21


@lru_cache(maxsize=16)
def _projections(dim: int, table: int, projections: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([20240311, dim, table])
    return rng.normal(size=(dim + 1, projections)), rng.uniform(0, width, projections)


@lru_cache(maxsize=4)
def _perturbations(projections: int) -> np.ndarray:
    return np.array(list(itertools.product(range(-AWAY, AWAY + 1), repeat=projections)))


def _pack_slots(slots: np.ndarray) -> np.ndarray:
    out = np.zeros(slots.shape[:-1], np.int64)
    for k in range(slots.shape[-1]):
        out = out * 4099 + (slots[..., k] + 2048)
    return out


def place(x: np.ndarray, dim: int, table: int, projections: int, width: float) -> np.ndarray:
    """Positions of rows in units of slots: (a . x + b) / width for Gaussian a, which is 2-stable."""
    a, b = _projections(dim, table, projections, width)
    return (x @ a + b) / width


def probes(position: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` buckets likeliest to hold near vectors, best first.

    The score of a perturbed bucket is the squared distance from the query's
    position to it, summed over projections; the smaller, the likelier.
    """
    base = np.floor(position)
    inside = position - base
    steps = np.arange(-AWAY, AWAY + 1)
    gap = np.where(steps < 0, inside[..., None] - steps - 1, np.where(steps > 0, steps - inside[..., None], 0.0)) ** 2
    moves = _perturbations(position.shape[1])
    score = sum(gap[:, k, moves[:, k] + AWAY] for k in range(position.shape[1]))
    count = min(count, len(moves))
    best = np.argpartition(score, count - 1, axis=1)[:, :count]
    best = np.take_along_axis(best, np.argsort(np.take_along_axis(score, best, 1), axis=1, kind="stable"), 1)
    return _pack_slots((base[:, None, :] + moves[best]).astype(np.int64))


def nearest_in_block(q_id: np.ndarray, q: np.ndarray, v_id: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query the k rows of largest inner product, ties to the smaller id; the query's own id is left out."""
    order = np.argsort(v_id, kind="stable")
    v_id, v = v_id[order], v[order]
    out_q, out_v, out_s = [], [], []
    slack = 1e-9 * float(np.abs(v).sum(1).max(initial=0)) * (1 + float(np.abs(q).max(initial=0)))
    for lo in range(0, len(q), 256):
        s = q[lo : lo + 256] @ v.T
        s[q_id[lo : lo + 256, None] == v_id[None, :]] = -np.inf
        least = np.partition(s, len(v) - k, axis=1)[:, len(v) - k] - slack if len(v) > k else np.full(len(s), -np.finfo(float).max)
        for i in range(len(s)):
            may = np.flatnonzero((s[i] >= least[i]) & (v_id != q_id[lo + i]))
            exact = (v[may] * q[lo + i]).sum(1)
            best = np.argsort(-exact, kind="stable")[:k]
            out_q.append(np.full(len(best), q_id[lo + i]))
            out_v.append(v_id[may[best]])
            out_s.append(exact[best])
    if not out_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)


def _top(q: np.ndarray, v: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, each vector once; ties to the smaller id."""
    order = np.lexsort((-s, v, q))
    q, v, s = q[order], v[order], s[order]
    once = np.ones(len(q), bool)
    once[1:] = (q[1:] != q[:-1]) | (v[1:] != v[:-1])
    q, v, s = q[once], v[once], s[once]
    order = np.lexsort((v, -s, q))
    q, v, s = q[order], v[order], s[order]
    first = np.searchsorted(q, q, "left")
    best = np.arange(len(q)) - first < k
    return q[best], v[best], s[best]


def _blocks(keys: list[str], k: int, kind: str):
    """Answers of the blocks of a partition; what its blocks find for one query is merged before it is handed on."""

    def run(batches):
        held: list[tuple] = []
        rows = 0
        for table in by_group(batches, keys):
            asks = table["asks"].to_numpy(zero_copy_only=False)
            if not asks.any() or asks.all():
                continue
            ids, x = table["id"].to_numpy(), unpacked(table["vec"], kind)
            held.append(nearest_in_block(ids[asks], x[asks], ids[~asks], x[~asks], k))
            rows += len(held[-1][0])
            if rows > HELD_ROWS:
                held = [_top(*map(np.concatenate, zip(*held)), k)]
                rows = len(held[0][0])
                if rows > HELD_ROWS // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], names=["query_id", "vec_id", "score"])
                    held, rows = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in _top(*map(np.concatenate, zip(*held)), k)], names=["query_id", "vec_id", "score"])

    return run


FOUND = "query_id long, vec_id long, score double"


def _meet(vectors: DataFrame, queries: DataFrame, keys: list[str], k: int, kind: str) -> DataFrame:
    """Let the queries and vectors of each key meet in blocks of bounded size; each block gives k rows a query at most."""
    sizes = vectors.groupBy(*keys).agg(F.count(F.lit(1)).alias("_v"))
    asked = queries.groupBy(*keys).agg(F.count(F.lit(1)).alias("_q"))
    cuts = cut_lineage(sizes.join(asked, keys).select(*keys, F.ceil(F.col("_v") / BLOCK_VECTORS).alias("vs"), F.ceil(F.col("_q") / BLOCK_QUERIES).alias("qs")))
    span = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    v = vectors.join(cuts, keys).select(*keys, "id", "vec", F.lit(False).alias("asks"), F.pmod(F.xxhash64("id"), F.col("vs")).alias("i"), span("qs").alias("j"))
    q = queries.join(cuts, keys).select(*keys, "id", "vec", F.lit(True).alias("asks"), span("vs").alias("i"), F.pmod(F.xxhash64("id"), F.col("qs")).alias("j"))
    keys = [*keys, "i", "j"]
    return v.unionByName(q).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_blocks(keys, k, kind), FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    """Merge what the blocks found: k rows a query, ranked."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(df: DataFrame, is_query: Column, id: str = "vec_id", vector: str = "embedding", k: int = 20, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH, probe: int = PROBES) -> DataFrame:
    """The k nearest rows by inner product for every row that ``is_query`` admits: ``(query_id, rank, vec_id, score)``.

    Candidates are all other rows of the same vector length; ties go to the
    smaller id. Vectors that are null, empty, zero or hold null or non-finite
    components take no part, nor do null ids. Rows that repeat an id count once,
    with their best score, and never answer a query of that id. An empty table
    gives none; extra columns are not read. ``score`` is the sum of products in
    double precision.

    Method. Vectors are scaled by the longest norm and completed by one component
    to length one, queries to length one, so that nearest by distance is nearest
    by inner product. Each of ``tables`` hash tables deals vectors into buckets
    of ``projections`` Gaussian projections; a query visits ``probe`` buckets of
    each in the estimated order of success. Buckets are cut into blocks of
    bounded size, so a bucket with a third of all rows is many tasks. A query
    that finds fewer than k although there are more is compared with all rows, in
    blocks.
    """
    asks, kind = F.coalesce(is_query, F.lit(False)), {"float": "f4", "double": "f8"}[travels_as(df, vector)]
    flagged = df.select(F.col(id).alias("id"), F.col(vector).alias("vector"), asks.alias("asks"))
    rows = cut_lineage(as_doubles(flagged, "id", "vector", "asks"))
    # norms in units of the largest component, so that no square overflows
    largest = rows.agg(F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x))))).first()[0]
    longest = largest and rows.agg(F.max(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + (x / largest) * (x / largest))))).first()[0]
    if longest is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def deal(batches, asking: bool):
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for dim, at in by_dim(batch).items():
                x = matrix(batch.column("vec").take(pa.array(at)), dim)
                if asking:
                    own = x / np.abs(x).max(axis=1, keepdims=True)
                    full = np.concatenate([own / np.sqrt((own * own).sum(1))[:, None], np.zeros((len(x), 1))], 1)
                else:
                    own = x / largest / longest
                    full = np.concatenate([own, np.sqrt(np.maximum(1 - (own * own).sum(1), 0))[:, None]], 1)
                vec = packed(x.astype(kind))
                for t in range(tables):
                    where = place(full, dim, t, projections, width)
                    if asking:
                        cell = probes(where, probe)
                        n, m = cell.shape
                        each = np.repeat(np.arange(n), m)
                        cell = cell.ravel()
                    else:
                        cell, each = _pack_slots(np.floor(where).astype(np.int64)), np.arange(len(x))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(each), dim, np.int32)), pa.array(np.full(len(each), t, np.int32)), pa.array(cell), pa.array(ids[at][each]), vec.take(pa.array(each))], names=["dim", "tab", "cell", "id", "vec"])

    schema = "dim int, tab int, cell long, id long, vec binary"
    index = rows.select("id", "dim", "vec").mapInArrow(lambda b: deal(b, False), schema)
    queries = rows.filter("asks").select("id", "dim", "vec")
    asked = queries.mapInArrow(lambda b: deal(b, True), schema)
    found = cut_lineage(_best(_meet(index, asked, ["dim", "tab", "cell"], k, kind), k))

    there = rows.groupBy("dim").agg(F.count_distinct("id").alias("_n"))
    have = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("_have"))
    short = queries.join(there, "dim").join(have, F.col("id") == F.col("query_id"), "left").filter(F.coalesce("_have", F.lit(0)) < F.least(F.lit(k), F.col("_n") - 1))
    short = cut_lineage(short.select("id", "dim", "vec"))
    if short.isEmpty():
        return found

    def pack(batches):
        for batch in batches:
            for dim, at in by_dim(batch).items():
                yield pa.RecordBatch.from_arrays([batch.column("dim").take(pa.array(at)), batch.column("id").take(pa.array(at)), packed(matrix(batch.column("vec").take(pa.array(at)), dim).astype(kind))], names=["dim", "id", "vec"])

    plain = lambda d: d.select("dim", "id", "vec").mapInArrow(pack, "dim int, id long, vec binary")
    rest = _best(_meet(plain(rows), plain(short), ["dim"], k, kind), k)
    return found.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(rest)


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, k=20)
