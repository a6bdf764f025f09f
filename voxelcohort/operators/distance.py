"""Exact distances to voxel sets by lower envelopes of parabolas, one axis after the other.

The square of a distance is a sum over axes. Inside a plane the envelopes run
along the third and the second axis on an array; planes are then cut into
strips, and a strip meets the same strip of all other planes, where the first
axis is done. Points are neither copied nor searched for, and the number of
jobs does not depend on the extent.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

AXES = ("i", "j", "k")
#: Rows of a plane that make a strip, and lines up to which an axis is done by trying all pairs of places.
STRIP, SHORT = 16, 24


def groups(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Whole groups of a partition that is sorted by ``keys`` of any type without nulls; holds one group and one batch."""
    rest: list[pa.Table] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch])
        cuts = group_starts(table, keys)[1:]
        if rest and any(rest[-1][k][-1].as_py() != table[k][0].as_py() for k in keys):
            yield pa.concat_tables(rest)
            rest = []
        for lo, hi in zip([0, *cuts], [*cuts, len(table)]):
            rest.append(table.slice(lo, hi - lo))
            if hi < len(table):
                yield pa.concat_tables(rest)
                rest = []
    if rest:
        yield pa.concat_tables(rest)


def group_starts(table: pa.Table, keys: Sequence[str]) -> list[int]:
    """The first rows of the groups of a table that is sorted by ``keys``."""
    new = np.zeros(len(table), bool)
    new[:1] = True
    for k in keys:
        col = pa.concat_arrays(table[k].chunks)
        new[1:] |= pc.not_equal(col.slice(1), col.slice(0, len(col) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new).tolist()


def whole_groups(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Like :func:`groups`, but all groups that end in a batch come in one table; holds one group and one batch."""
    rest: list[pa.Table] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch])
        starts = group_starts(table, keys)
        if all(not rest or rest[-1][k][-1].as_py() == table[k][0].as_py() for k in keys):
            starts = starts[1:]
        if starts:
            done = [*rest, table.slice(0, starts[-1])]
            rest = []
            if sum(map(len, done)):
                yield pa.concat_tables(done)
            table = table.slice(starts[-1])
        rest.append(table)
    if rest:
        yield pa.concat_tables(rest)


def envelope(f: np.ndarray, step: float = 1.0) -> np.ndarray:
    """``min_y f[:, y] + (step (x - y))^2`` for every x of the rows of ``f``; infinity marks places without a source.

    The parabolas of a row that are lowest anywhere are kept in a stack (Felzenszwalb and
    Huttenlocher 2012); all rows go through their places together.
    """
    m, n = f.shape
    place = np.arange(n)
    if n <= SHORT:
        return (f[:, None, :] + (step * (place[:, None] - place[None, :])) ** 2).min(2)
    w = step * step
    top = np.full(m, -1)  # of each row's stack
    at = np.zeros((m, n), np.int64)  # places of the parabolas
    edge = np.full((m, n + 1), np.inf)  # from where each is the lowest
    own = np.arange(m)
    for q in range(n):
        todo = own[np.isfinite(f[:, q])]
        while len(todo):
            t = top[todo]
            v = at[todo, np.maximum(t, 0)]
            meet = ((f[todo, q] + w * q * q) - (f[todo, v] + w * v * v)) / np.where(q > v, 2 * w * (q - v), 1)
            meet = np.where(t < 0, -np.inf, meet)
            below = (t > 0) & (meet <= edge[todo, np.maximum(t, 0)])
            put = todo[~below]
            top[put] += 1
            at[put, top[put]] = q
            edge[put, top[put]] = meet[~below]
            edge[put, top[put] + 1] = np.inf
            todo = todo[below]
            top[todo] -= 1
    out, now = np.full((m, n), np.inf), np.zeros(m, np.int64)
    some = own[top >= 0]
    for x in range(n):
        while True:
            on = some[(edge[some, now[some] + 1] < x) & (now[some] < top[some])]
            if not len(on):
                break
            now[on] += 1
        v = at[some, now[some]]
        out[some, x] = f[some, v] + w * (x - v) ** 2
    return out


def plane(j: np.ndarray, k: np.ndarray, box: Sequence[int], steps: Sequence[float]) -> np.ndarray:
    """Squared distances inside a plane to the points ``(j, k)``, over the box ``j0, j1, k0, k1`` (ends included)."""
    j0, j1, k0, k1 = box
    f = np.full((j1 - j0 + 1, k1 - k0 + 1), np.inf)
    f[j - j0, k - k0] = 0.0
    hit = np.unique(j - j0)
    f[hit] = envelope(f[hit], steps[2])
    return envelope(np.ascontiguousarray(f.T), steps[1]).T


def _schema(df: DataFrame, by: Sequence[str], more: str) -> T.StructType:
    return T.StructType([*(T.StructField(c, df.schema[c].dataType) for c in by), *T._parse_datatype_string(more).fields])


def _strips(features: DataFrame, boxes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Plane distances of every slab that has a feature, cut into strips: ``(by, tile, i, j0, k0, nk, data)``."""
    schema = _schema(features, by, "tile long, i long, j0 long, k0 long, nk long, s0 double, data array<double>")
    met = features.select(*by, *[F.col(a).cast("long").alias(a) for a in AXES]).join(boxes, list(by))

    def run(batches):
        for table in groups(batches, [*by, "i"]):
            head = table.slice(0, 1).to_pylist()[0]
            box, steps = [head[c] for c in ("j0", "j1", "k0", "k1")], head["steps"]
            d = plane(table["j"].to_numpy(), table["k"].to_numpy(), box, steps)
            cut = [d[lo : lo + STRIP] for lo in range(0, len(d), STRIP)]
            n = len(cut)
            columns = [pa.array([head[c]] * n, table.schema.field(c).type) for c in by]
            columns += [pa.array(range(n), pa.int64()), *(pa.array([x] * n, pa.int64()) for x in (head["i"], box[0], box[2], d.shape[1])), pa.array([steps[0]] * n)]
            offsets = np.concatenate([[0], np.cumsum([c.size for c in cut])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(d.ravel()))], names=schema.names)

    return met.repartition(*by, "i").sortWithinPartitions(*by, "i").mapInArrow(run, schema)


def _boxes(frame: DataFrame, by: Sequence[str]) -> DataFrame:
    return frame.groupBy(*by).agg(*[f(a).cast("long").alias(f"{a}{n}") for a in "jk" for n, f in ((0, F.min), (1, F.max))])


def _steps(boxes: DataFrame, steps: DataFrame | None, by: Sequence[str]) -> DataFrame:
    if steps is None:
        return boxes.withColumn("steps", F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0)))
    return boxes.join(steps.select(*by, F.col("steps").cast("array<double>").alias("steps")), list(by))


def _stack(table: pa.Table) -> tuple[dict, np.ndarray, np.ndarray]:
    """Strips of one tile: what they share, their slabs and their arrays."""
    head = table.slice(0, 1).select([c for c in table.schema.names if c != "data"]).to_pylist()[0]
    i = table["i"].to_numpy()
    return head, i, table["data"].combine_chunks().flatten().to_numpy().reshape(len(i), -1, head["nk"])


def nearest_squared(asks: DataFrame, features: DataFrame, by: Sequence[str], steps: DataFrame | None = None) -> DataFrame:
    """``(by, i, j, k, d2)``: squared distance of each asking voxel to the nearest feature voxel of its group.

    Both frames have the columns ``by`` and integer ``i, j, k``; ``steps`` gives ``(by,
    steps)``, the voxel's size along each axis, 1 without it. Groups without a feature have no rows. A task
    holds one plane of a group's box, or one strip of all its planes.
    """
    by = list(by)
    asks = asks.select(*by, *[F.col(a).cast("long").alias(a) for a in AXES])
    both = features.select(*by, "j", "k").unionByName(asks.select(*by, "j", "k"))
    boxes = _steps(_boxes(both, by), steps, by)
    strips = _strips(features.join(asks.select(*by).distinct(), by, "left_semi"), boxes, by)
    tile = F.expr(f"(j - j0) div {STRIP}")
    placed = asks.join(boxes.select(*by, "j0"), by).select(*by, tile.alias("tile"), *AXES)
    schema = _schema(asks, by, "i long, j long, k long, d2 double")

    def run(asked: pa.Table, told: pa.Table) -> pa.Table:
        if not len(asked) or not len(told):
            return pa.Table.from_batches([], schema=_arrow(schema))
        head, slabs, stack = _stack(told)
        i, j, k = (asked[a].to_numpy() for a in AXES)
        best = np.full(len(i), np.inf)
        here = stack.reshape(len(slabs), -1)
        at = (j - head["j0"] - head["tile"] * STRIP) * head["nk"] + (k - head["k0"])
        for n, slab in enumerate(slabs.tolist()):
            np.minimum(best, here[n, at] + (head["s0"] * (i - slab)) ** 2, out=best)
        return pa.table([*(asked[c] for c in (*by, *AXES)), pa.array(best)], schema=_arrow(schema))

    return placed.groupBy(*by, "tile").cogroup(strips.groupBy(*by, "tile")).applyInArrow(run, schema)


def within(features: DataFrame, boxes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Voxels ``(by, i, j, k)`` of each group's box at a squared distance up to ``limit`` from a feature.

    ``boxes`` has ``(by, i0, i1, j0, j1, k0, k1, limit)``, ends included, and holds all features.
    """
    by = list(by)
    strips = _strips(features, _steps(boxes.select(*by, "j0", "j1", "k0", "k1"), None, by), by)
    schema = _schema(features, by, "i long, j long, k long")

    def run(batches):
        for table in groups(batches, [*by, "tile"]):
            head, slabs, stack = _stack(table)
            f = np.full((head["i1"] - head["i0"] + 1, *stack.shape[1:]), np.inf)
            f[slabs - head["i0"]] = stack
            d = envelope(np.ascontiguousarray(f.reshape(len(f), -1).T)).T.reshape(f.shape)
            i, j, k = np.nonzero(d <= head["limit"])
            own = [pa.repeat(pa.scalar(head[c], table.schema.field(c).type), len(i)) for c in by]
            yield pa.RecordBatch.from_arrays([*own, pa.array(i + head["i0"]), pa.array(j + head["j0"] + head["tile"] * STRIP), pa.array(k + head["k0"])], names=schema.names)

    met = strips.join(boxes.select(*by, "i0", "i1", F.col("limit").cast("double").alias("limit")), by)
    return met.repartition(*by, "tile").sortWithinPartitions(*by, "tile").mapInArrow(run, schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
