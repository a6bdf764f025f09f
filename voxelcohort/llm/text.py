"""Whole texts as flat numpy arrays: words, runs and rolling windows with 64-bit hashes.

An Arrow string column is one byte buffer with offsets. Words are found and
hashed on that buffer at once, without a Python object per word. A slice holds
whole texts only; a text longer than the slice bound is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

SLICE_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1

#: Class 1: bytes outside [\x20\x09-\x0D]; these make words.
WORD_BYTES = np.ones(256, np.uint8)
WORD_BYTES[[32, 9, 10, 11, 12, 13]] = 0

BYTE_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The same values with A-Z taken as a-z.
LOWER_VALUES = BYTE_VALUES.copy()
LOWER_VALUES[65:91] = BYTE_VALUES[97:123]


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches of whole texts have 1,000 rows, where the session keeps Spark's own 10,000.

    A batch is held several times over by the executor and its Python worker, and
    texts are long rows.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "1000")


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over all 64."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        p = np.full(size, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(1 << 16, 1 << int(n - 1).bit_length()) if n > 0 else 1 << 16)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of ``values[start:end]`` for every span, from one running sum modulo 2^64."""
    up, down = powers(len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


class Slice:
    """Texts ``lo`` to ``hi`` of a column as bytes, with the text offsets in them."""

    def __init__(self, lo: int, hi: int, data: np.ndarray, offsets: np.ndarray):
        self.lo, self.hi, self.data, self.offsets = lo, hi, data, offsets

    def __len__(self) -> int:
        return self.hi - self.lo

    def text(self, k: int) -> bytes:
        return self.data[self.offsets[k] : self.offsets[k + 1]].tobytes()

    def runs(self, classes: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of runs of one nonzero class, and the first run of each text (one more at the end)."""
        kind = classes[self.data]
        change = np.ones(len(kind) + 1, bool)
        change[1:-1] = kind[1:] != kind[:-1]
        change[self.offsets] = True
        edges = np.flatnonzero(change)
        starts, ends = edges[:-1], edges[1:]
        keep = kind[starts] > 0
        starts, ends = starts[keep], ends[keep]
        return starts, ends, np.searchsorted(starts, self.offsets)

    def words_and_first(self, values: np.ndarray = BYTE_VALUES) -> tuple[np.ndarray, np.ndarray]:
        """Like ``words``; the first words stay at hand as ``first``."""
        hashes, self.first = self.words(values)
        return hashes, self.first

    def words(self, values: np.ndarray = BYTE_VALUES, classes: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words in order, and the first word of each text (one more at the end)."""
        starts, ends, first = self.runs(classes)
        return span_hashes(values[self.data], starts, ends), first


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a string column into slices of about ``limit`` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield Slice(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def windows(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` neighbouring words of one text, and the word at which each starts."""
    size = np.diff(first)
    n = np.maximum(size - k + 1, 0)
    starts = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    return span_hashes(hashes, starts, starts + k), starts


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text, sorted within it, and the first of each text (one more at the end).

    A text of fewer than ``k`` words, but one at least, has its whole sequence as the only shingle.
    """
    texts = len(first) - 1
    size = np.diff(first)
    full, starts = windows(hashes, first, k)
    short = np.flatnonzero((size > 0) & (size < k))
    owner = np.concatenate([np.searchsorted(first, starts, "right") - 1, short])
    values = np.concatenate([full, span_hashes(hashes, first[short], first[short + 1])])
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])
    return values[new], np.searchsorted(owner[new], np.arange(texts + 1))
