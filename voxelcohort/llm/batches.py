"""Arrow batches of Spark partitions, group by group."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def _changes(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Rows at which a new group starts, the first row included."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in keys:
        col = table[k].combine_chunks().to_numpy(zero_copy_only=False)
        new[1:] |= col[1:] != col[:-1]
    return np.flatnonzero(new)


def by_group(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Whole groups of a partition that is sorted by non-null integer ``keys``; holds one group and one batch."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch])
        cuts = _changes(table, keys)
        if rest and any(rest[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys):
            yield pa.Table.from_batches(rest)
            rest = []
        if len(cuts) > 1:
            yield pa.Table.from_batches([*rest, batch.slice(0, int(cuts[1]))])
            for lo, hi in zip(cuts[1:-1], cuts[2:]):
                yield table.slice(int(lo), int(hi - lo))
            rest = [batch.slice(int(cuts[-1]))]
        else:
            rest.append(batch)
    if rest:
        yield pa.Table.from_batches(rest)


def map_groups(df: DataFrame, keys: Sequence[str], fn: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply ``fn`` to every group of ``keys``; many small groups share one stream of batches.

    Groups must be bounded: callers split hot keys by a salt that is part of ``keys``.
    """
    keys = list(keys)

    def run(batches):
        for table in by_group(batches, keys):
            out = fn(table)
            if out is not None and out.num_rows:
                yield out

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
