"""Quality of whole texts: random-indexing word vectors, pooled, and a two-layer network."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelcohort.session import cut_lineage

from .langid import crc_remainder
from .text import BYTE_VALUES, Slice, mix, slices, small_batches, span_hashes
from .vectors import packed, unpacked

#: Words are told apart by 18 bits of their hash: the table has a fixed size, and 100,000 words share a cell in a third of cases.
WORD_BITS = 18
WORDS = 1 << WORD_BITS
DIMENSIONS = 32
#: Nonzero places of an index vector, and neighbours on each side that make a context.
PLACES, REACH = 4, 2
#: A word whose context sum has this length gets half the weight of a frequent one.
SHRINK = 64.0
FIT_ROWS = 20_000
WORK_BYTES = 1 << 19

#: Lower-case letters and bytes above ASCII, capitals, digits; every other visible byte is a class of its own.
CLASSES = np.arange(256).astype(np.uint8)
CLASSES[[32, 9, 10, 11, 12, 13]] = 0
CLASSES[97:123] = CLASSES[128:] = 1
CLASSES[65:91] = 2
CLASSES[48:58] = 3


def tokens(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Hash number of every run of one class of bytes, and the first run of each text."""
    starts, ends, first = s.runs(CLASSES)
    return (mix(span_hashes(BYTE_VALUES[s.data], starts, ends)) >> np.uint64(64 - WORD_BITS)).astype(np.int64), first


@lru_cache(maxsize=1)
def index_vectors() -> np.ndarray:
    """A sparse random vector of 1 and -1 for every word: PLACES nonzero places, one in each part of the dimensions."""
    bits = mix(np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out, width = np.zeros((WORDS, DIMENSIONS), np.int8), DIMENSIONS // PLACES
    for p in range(PLACES):
        part = (bits >> np.uint64(16 * p)) & np.uint64(0xFFFF)
        out[np.arange(WORDS), p * width + (part % np.uint64(width)).astype(np.int64)] = np.where(part & np.uint64(0x8000), 1, -1)
    return out


def _contexts(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words of a slice, and for each the sum of the index vectors of its neighbours."""
    t, first = tokens(s)
    index, owner = index_vectors(), np.repeat(np.arange(len(s)), np.diff(first))
    near = np.zeros((len(t), DIMENSIONS), np.int32)
    for step in range(1, REACH + 1):
        same = (owner[step:] == owner[:-step])[:, None]
        near[:-step] += index[t[step:]] * same
        near[step:] += index[t[:-step]] * same
    order = np.argsort(t, kind="stable")
    words, start = np.unique(t[order], return_index=True)
    return words, np.add.reduceat(near[order], start, axis=0) if len(words) else near


def context_sums(df: DataFrame, text: str = "text") -> np.ndarray:
    """Sum of the index vectors of the neighbours of every word, over all texts: an array (words, dimensions).

    A task hands on one row for each word that it holds, and the rows of a word are
    added up in one of ``spark.sql.shuffle.partitions`` tasks.
    """

    def run(batches):
        total = np.zeros((WORDS, DIMENSIONS), np.int32)
        for batch in batches:
            for s in slices(batch.column(0), WORK_BYTES):
                words, sums = _contexts(s)
                total[words] += sums
        yield from rows(total, "<i4")

    def rows(total, kind):
        at = np.flatnonzero(total.any(1))
        for lo in range(0, len(at), 4096):
            some = at[lo : lo + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), packed(total[some].astype(kind))], names=["cell", "v"])

    def add(batches):
        total = np.zeros((WORDS, DIMENSIONS))
        for batch in batches:
            np.add.at(total, batch.column(0).to_numpy(), unpacked(batch.column(1), "<i4"))
        yield from rows(total, "<f4")

    small_batches(df.sparkSession)
    parts = df.select(text).mapInArrow(run, "cell int, v binary")
    got = parts.repartition("cell").mapInArrow(add, "cell int, v binary").toArrow()
    out = np.zeros((WORDS, DIMENSIONS))
    if len(got):
        out[got["cell"].to_numpy()] = unpacked(got["v"], "<f4")
    return out


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Context sums scaled to a length below one, the shorter the rarer the word, and centred; words without context are zero."""
    size = np.linalg.norm(sums, axis=1, keepdims=True)
    unit = sums / (size + SHRINK)
    seen = size[:, 0] > 0
    if seen.any():
        unit[seen] -= unit[seen].mean(0)
    return unit.astype(np.float32)


def pool(s: Slice, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors of each text, its log length, share of distinct words, and length of the mean."""
    t, first = tokens(s)
    n = np.diff(first)
    out = np.zeros((len(s), 2 * DIMENSIONS + 3), np.float32)
    some = np.flatnonzero(n > 0)
    if len(some):
        own = vectors[t]
        mean = np.add.reduceat(own, first[some], axis=0, dtype=np.float64) / n[some, None]
        square = np.add.reduceat(own * own, first[some], axis=0, dtype=np.float64) / n[some, None]
        out[some, :DIMENSIONS] = mean
        out[some, DIMENSIONS : 2 * DIMENSIONS] = np.sqrt(np.maximum(square - mean * mean, 0))
        owner = np.repeat(np.arange(len(s)), n)
        distinct = np.bincount(np.unique(owner * WORDS + t) // WORDS, minlength=len(s))
        out[some, -3] = np.log(n[some])
        out[some, -2] = distinct[some] / n[some]
        out[some, -1] = np.linalg.norm(mean, axis=1)
    return out


def pooled_vectors(df: DataFrame, vectors: np.ndarray, text: str = "text", out: str = "vector") -> DataFrame:
    """Replace ``text`` by ``out`` array<float>, the pooled vector of the whole text; other columns are kept."""
    shared = df.sparkSession.sparkContext.broadcast(vectors)
    names = [c for c in df.columns if c not in (text, out)]
    schema = T.StructType([*(f for f in df.schema.fields if f.name in names), T.StructField(out, T.ArrayType(T.FloatType(), False))])

    def run(batches):
        for batch in batches:
            for s in slices(batch.column(batch.schema.get_field_index(text)), WORK_BYTES):
                x = pool(s, shared.value)
                column = pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.slice(s.lo, len(s)).select(names).columns, column], names=[*names, out])

    return df.mapInArrow(run, schema)


class TwoLayers:
    """tanh layer and sigmoid output on standardised inputs, with a temperature fitted on rows kept apart."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 16, rounds: int = 40, batch: int = 128, rate: float = 0.01, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.mean, self.sd = x.mean(0), x.std(0) + 1e-6
        x = (x - self.mean) / self.sd
        order = rng.permutation(len(x))
        apart, fit = order[: len(x) // 5], order[len(x) // 5 :]
        p = self.p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        m, s = [np.zeros_like(v) for v in p], [np.zeros_like(v) for v in p]
        step = 0
        for k in range(rounds):
            rng.shuffle(fit)
            for lo in range(0, len(fit), batch):
                at = fit[lo : lo + batch]
                h = np.tanh(x[at] @ p[0] + p[1])
                d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[at]) / len(at)
                dh = np.outer(d, p[2]) * (1 - h * h)
                step += 1
                for i, g in enumerate((x[at].T @ dh + 1e-4 * p[0], dh.sum(0), h.T @ d + 1e-4 * p[2], d.sum(keepdims=True))):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    s[i] = 0.99 * s[i] + 0.01 * g * g
                    p[i] -= rate * (1 - k / rounds) * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.99**step)) + 1e-8)
        self.temperature = 1.0
        if len(apart):
            z = self._logit(x[apart])
            loss = lambda t: np.logaddexp(0, np.where(y[apart] > 0, -z, z) / t).mean()
            self.temperature = float(min(np.exp(np.linspace(-1, 2, 61)), key=loss))

    def _logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._logit((x - self.mean) / self.sd) / self.temperature, -30, 30)))


def score_quality(df: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", usable: Column | None = None, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Score every row of ``df``: ``text`` goes, ``score`` double 0 to 1 comes; every other column is kept.

    Word vectors are gathered from all texts, labelled or not; words have WORD_BITS of
    their hash for a name. The network is
    fitted on about ``fit_rows`` rows of ``labels`` (``id``, ``label`` 0 or 1)
    that ``usable``, a column of ``df``, admits, chosen by the hash of the vector, equal ones once; other labels
    count as none. Null and empty texts have the zero vector and get its score.
    With labels of fewer than two kinds every score is the share of label 1, 0.5
    without any. Repeated ids are scored row by row; an empty table gives none. Texts of any length are
    read whole and never exchanged: labels meet pooled vectors, which are stored in the shared folder.
    """
    vectors = word_vectors(context_sums(df, text))
    pooled = cut_lineage(pooled_vectors(df, vectors, text, "_vector"))
    known = labels.select(F.col(id).alias("_id"), F.col(label).cast("int").alias("_label")).filter("_label in (0, 1)")
    rows = (pooled if usable is None else pooled.filter(usable)).select(F.col(id).alias("_id"), F.xxhash64("_vector").alias("_hash"), "_vector").join(known, "_id")
    # a share of the hashes, so that every partition hands on its part of about fit_rows rows
    n, ones = rows.agg(F.count(F.lit(1)), F.sum("_label")).first()
    fit = rows.filter(F.abs(F.col("_hash").cast("double")) <= min(1.0, fit_rows / max(1, n)) * 2.0**63)
    fit = fit.groupBy("_hash", "_label").agg(F.first("_vector").alias("_vector")).toArrow()
    fit = fit.sort_by([("_hash", "ascending"), ("_label", "ascending")])
    y = fit["_label"].to_numpy().astype(np.float64)
    x = fit["_vector"].combine_chunks().flatten().to_numpy().reshape(len(y), -1) if len(y) else np.zeros((0, 1))
    net = TwoLayers(x.astype(np.float64), y) if len(set(y.tolist())) == 2 else None
    flat = ones / n if n else 0.5
    shared = df.sparkSession.sparkContext.broadcast(net)
    names = [c for c in pooled.columns if c not in ("_vector", "score")]
    schema = T.StructType([*(f for f in pooled.schema.fields if f.name in names), T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            v = batch.column(batch.schema.get_field_index("_vector"))
            n = batch.num_rows
            p = shared.value.probability(v.flatten().to_numpy().reshape(n, -1).astype(np.float64)) if shared.value is not None and n else np.full(n, flat)
            yield pa.RecordBatch.from_arrays([*batch.select(names).columns, pa.array(p)], names=[*names, "score"])

    return pooled.mapInArrow(run, schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from labels that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", (crc_remainder(F.col("doc_id"), 3) == 1).alias("held_out"))
    scored = score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), usable=~F.col("held_out"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
