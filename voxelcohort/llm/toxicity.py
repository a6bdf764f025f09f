"""Toxic passages by maximum-scoring segments of token log-odds, calibrated by extreme values."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .langid import crc_remainder
from .text import LOWER_VALUES, Slice, mix, slices, small_batches, span_hashes

#: Tokens are counted in this many hash cells, so that the lexicon has a fixed size.
CELLS = 1 << 18
#: A word is looked up whole and by its first characters, so that inflected forms share evidence.
STEMS = (0, 4, 5, 6)
PRIOR = 2_000.0
SURE = 2.5
GAP_COST = 0.06
#: Weaker evidence for a word counts as none; from STRONG on it is counted apart.
LEAST, STRONG = 1.2, 2.5
SIGNIFICANT = 0.01
FIT_ROWS = 20_000

LETTERS = np.zeros(256, np.uint8)
LETTERS[65:91] = LETTERS[97:123] = 1
LETTERS[128:] = 1


def token_cells(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash cells of every word, one row for each of STEMS (CELLS for shorter words); starts and ends of the words; the first word of each text."""
    starts, ends, first = s.runs(LETTERS)
    values = LOWER_VALUES[s.data]
    lead = (s.data & 0xC0) != 0x80
    at = np.append(np.flatnonzero(lead), len(s.data))  # bytes at which characters start
    rank = np.concatenate([[0], np.cumsum(lead)])
    cells = np.empty((len(STEMS), len(starts)), np.int64)
    for k, stem in enumerate(STEMS):
        stop = np.minimum(ends, at[np.minimum(rank[starts] + stem, len(at) - 1)]) if stem else ends
        h = mix(span_hashes(values, starts, stop) + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (2**64 - 1)))
        cells[k] = np.where(rank[ends] - rank[starts] >= stem, (h >> np.uint64(64 - 18)).astype(np.int64), CELLS)
    return cells, starts, ends, first


def cell_counts(df: DataFrame, text: str = "text", label: str = "toxic") -> tuple[np.ndarray, int]:
    """Over all rows, the texts of label 0 and 1 that hold each cell, then its occurrences in them: an array (4, cells); and the number of rows.

    A task adds up its own texts and hands on nonzero cells only; Spark adds
    those. The result has a fixed size, whatever the input.
    """

    def run(batches):
        total, rows = np.zeros(4 * CELLS, np.int64), 0
        for batch in batches:
            flag = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            rows += len(flag)
            for s in slices(batch.column(0)):
                cells, _, _, first = token_cells(s)
                owner = np.repeat(np.arange(len(s)), np.diff(first))
                for row in cells:
                    some = row < CELLS
                    own, n = np.unique(owner[some] * CELLS + row[some], return_counts=True)
                    to = flag[s.lo + own // CELLS] * CELLS + own % CELLS
                    total += np.bincount(to, minlength=4 * CELLS)
                    total += np.bincount(to + 2 * CELLS, n, minlength=4 * CELLS).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(total[at], rows))], names=["cell", "n"])

    small_batches(df.sparkSession)
    rows = df.select(text, F.col(label).cast("int").alias("label")).filter("label in (0, 1)")
    got = rows.mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(4 * CELLS + 1)
    out[got["cell"].to_numpy()] = got["n"].to_numpy()  # -1 is the last place
    return out[:-1].reshape(4, CELLS), int(out[-1])


def log_odds(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Log-odds ratio of cells under an informative Dirichlet prior, shrunk by its significance.

    ``counts`` holds texts and occurrences of both labels for each cell, ``totals`` their
    sums over all cells. The ratio is that of occurrences; the prior has the weight PRIOR and the shape
    of all counts (Monroe et al. 2008). As occurrences in one text depend on each other, significance is that of texts: with g the signed
    root of the likelihood ratio of equal rates, what
    is below SURE becomes 0 and the rest is multiplied by 1 - (SURE / g)^2; unlike
    a standard error, g is sound where one of the counts is 0.
    """
    clean, toxic, clean_n, toxic_n = counts
    if not (totals > 0).all():
        return np.zeros(counts.shape[1])
    both = clean_n + toxic_n
    a = PRIOR * (both + 0.5) / (totals[2] + totals[3] + 0.5 * CELLS)
    y, n = toxic_n + a, totals[3] + PRIOR
    z, m = clean_n + a, totals[2] + PRIOR
    delta = np.log(y / (n - y)) - np.log(z / (m - z))
    expected = (clean + toxic) * totals[1] / (totals[0] + totals[1])
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(toxic > 0, toxic * np.log(toxic / expected), 0) + np.where(clean > 0, clean * np.log(clean / (clean + toxic - expected)), 0)
        shrink = np.where(ratio > 0, 1 - SURE**2 / (2 * ratio), 0)
    agree = (delta > 0) == (toxic * totals[0] > clean * totals[1])
    delta = delta * np.maximum(shrink, 0) * agree
    return np.where(np.abs(delta) >= LEAST, delta, 0)


def maximal_segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring subsequences ``(start, end, score)`` in linear time (Ruzzo and Tompa 1999)."""
    total = np.concatenate([[0.0], np.cumsum(score, dtype=np.float64)])
    found: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum at the end, index of the list's next candidate to the left
    for i in np.flatnonzero(score > 0).tolist():
        start, left, right = i, float(total[i]), float(total[i + 1])
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0 or found[j][3] >= right:
                break
            start, left = found[j][0], found[j][2]
            del found[j:]
            j = len(found) - 1
        found.append((start, i + 1, left, right, j))
    return [(a, b, right - left) for a, b, left, right, _ in found]


def word_scores(each: np.ndarray) -> np.ndarray:
    """Score of each word from the evidence of its cells: the strongest less the cost of a word in a gap."""
    high, low = each.max(0), each.min(0)
    return np.where(high > 0, high, np.maximum(low, -1)) - GAP_COST


FEATURES = "n_words long, best double, total double, hits long, strong long"
SEGMENTS = FEATURES + ", segments array<struct<start:int,end:int,score:double>>"


def text_features(score: np.ndarray) -> tuple[tuple, list]:
    """Number of words, best and total segment score, positive and strong words of one text; and its segments."""
    found = maximal_segments(score)
    return (len(score), max((x for _, _, x in found), default=0.0), float(sum(x for _, _, x in found)), int((score > 0).sum()), int((score > STRONG).sum())), found


def segment_features(df: DataFrame, lexicon: np.ndarray, text: str = "text") -> DataFrame:
    """Add the maximal segments of every whole text: byte range and score, and what ``text_features`` says.

    Null and empty texts have no words and no segments. Columns with those names
    are replaced, all others kept; nothing is exchanged.
    """
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(np.append(lexicon, 0).astype(np.float32))
    own = T._parse_datatype_string(SEGMENTS)
    names = [c for c in df.columns if c not in own.fieldNames()]
    schema = T.StructType([*(f for f in df.schema.fields if f.name in names), *own.fields])
    segment = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        table = shared.value
        for batch in batches:
            for s in slices(batch.column(batch.schema.get_field_index(text))):
                cells, starts, ends, first = token_cells(s)
                score = word_scores(table[cells])
                rows, segments = [], []
                for k in range(len(s)):
                    lo, hi = first[k], first[k + 1]
                    numbers, found = text_features(score[lo:hi])
                    rows.append(numbers)
                    segments.append([{"start": int(starts[lo + a] - s.offsets[k]), "end": int(ends[lo + b - 1] - s.offsets[k]), "score": x} for a, b, x in found])
                columns = [pa.array(v, t) for v, t in zip(zip(*rows), (pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*batch.slice(s.lo, len(s)).select(names).columns, *columns, pa.array(segments, segment)], names=[*names, *own.fieldNames()])

    return df.mapInArrow(run, schema)


def fit_features(df: DataFrame, counts: np.ndarray) -> DataFrame:
    """Features of texts ``(id, same, text)`` for the fit: ``(id, same, label, n_words, ...)``, one row for each label a text may have.

    The evidence of a text is taken without its own counts under that label, as
    that of a held-out text would be; else rare words look surer in the fit than they are.
    """
    shared = df.sparkSession.sparkContext.broadcast(counts)
    schema = T.StructType([*df.drop("text").schema.fields, *T._parse_datatype_string("label int, " + FEATURES).fields])

    def run(batches):
        counts = np.concatenate([shared.value, np.zeros((4, 1))], axis=1)
        totals = counts.sum(1)
        for batch in batches:
            for s in slices(batch.column(batch.schema.get_field_index("text"))):
                cells, _, _, first = token_cells(s)
                rows = []
                for k in range(len(s)):
                    u, place, n = np.unique(cells[:, first[k] : first[k + 1]], return_inverse=True, return_counts=True)
                    for label in (0, 1):
                        own = counts[:, u].copy()
                        own[label] -= 1
                        own[label + 2] -= n
                        each = np.where(u < CELLS, log_odds(np.maximum(own, 0), totals), 0)[place].reshape(len(STEMS), -1)
                        rows.append((label, *text_features(word_scores(each))[0]))
                twice = pa.array(np.repeat(np.arange(s.lo, s.hi), 2))
                kinds = (pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(twice) for c in ("id", "same")), *(pa.array(v, t) for v, t in zip(zip(*rows), kinds))], names=schema.fieldNames())

    return df.select("id", "same", "text").mapInArrow(run, schema)


@dataclass
class Calibration:
    """Extreme-value law of the best segment of clean texts, and the weights that turn it into a probability."""

    place: float = 0.0
    slope: float = 0.0
    scale: float = 1.0
    weights: tuple = (-2.0, *[0.0] * 8)

    def inputs(self, n, best, total, hits, strong, m, least, most):
        """What the weights apply to, as arrays (``m`` numpy) or columns (``m`` pyspark functions); first the best score in units of the Gumbel law of clean texts of that length."""
        z = (best - self.place - self.slope * m.log(n + 1)) / self.scale
        return [most(least(z, 20.0), -5.0), m.log1p(best), m.log1p(total), total / (n + 20), least(best, 12.0), m.log1p(hits), m.log1p(strong), m.log(n + 1)]


def logistic_fit(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Weights of a logistic regression by Newton steps; the first column of ``x`` is 1."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) / len(y) + penalty * w
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x / len(y) + penalty * np.eye(x.shape[1])
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-7:
            break
    return w


def calibrate(n_words: np.ndarray, best: np.ndarray, total: np.ndarray, hits: np.ndarray, strong: np.ndarray, y: np.ndarray) -> Calibration:
    """Fit the Gumbel law to texts of label 0 by moments, its place linear in the log length, then the logistic weights."""
    out = Calibration()
    clean = y == 0
    if clean.sum() < 2 or (~clean).sum() < 1:
        return out
    log_n = np.log(n_words + 1)
    a = np.stack([np.ones(clean.sum()), log_n[clean]], 1)
    place, slope = np.linalg.lstsq(a, best[clean], rcond=None)[0]
    rest = best[clean] - place - slope * log_n[clean]
    out.scale = max(float(rest.std()) * np.sqrt(6) / np.pi, 1e-3)
    out.slope, out.place = float(slope), float(place) - 0.5772156649 * out.scale
    x = np.stack(out.inputs(n_words, best, total, hits, strong, np, np.minimum, np.maximum), 1)
    mean, sd = x.mean(0), x.std(0) + 1e-9
    w = logistic_fit(np.concatenate([np.ones((len(y), 1)), (x - mean) / sd], 1), y)
    out.weights = (float(w[0] - (w[1:] * mean / sd).sum()), *(float(v) for v in w[1:] / sd))
    return out


def probability(c: Calibration) -> Column:
    """Calibrated probability from the feature columns."""
    values = (F.col(x).cast("double") for x in ("n_words", "best", "total", "hits", "strong"))
    inputs = c.inputs(*values, F, lambda a, b: F.least(a, F.lit(b)), lambda a, b: F.greatest(a, F.lit(b)))
    return 1 / (1 + F.exp(-sum((x * w for x, w in zip(inputs, c.weights[1:])), F.lit(c.weights[0]))))


def significant(c: Calibration) -> Column:
    """Segments whose score the best segment of a clean text of that length exceeds with probability below 1 %."""
    limit = F.lit(c.place) + F.log(F.col("n_words") + 1) * c.slope - c.scale * float(np.log(-np.log(1 - SIGNIFICANT)))
    return F.filter("segments", lambda s: s["score"] > limit)


def score_toxicity(df: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", usable: Column | None = None, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Score every row of ``df``: adds ``score`` double 0 to 1 and ``passages``, the significant toxic byte ranges; ``text`` goes.

    Labels are learnt from rows of ``labels`` (``id``, ``label`` 0 or 1) that
    ``usable``, a column of ``df``, admits; other labels count as none. Word
    counts come from all of them; the calibration from about
    ``fit_rows`` of them with different texts, chosen by the hash of the text. Null, empty and unknown texts get the
    score of a text without evidence; without labels of both kinds all scores are
    equal. Texts of any length are read whole, one above half a megabyte by itself. Repeated ids are scored row by row; an empty table gives none. Columns ``score``, ``passages``
    and those of the features are replaced.

    One join of text and labels feeds the counts; it is a sort-merge join at every
    size, as labels grow with the input. The texts of the fit stay where they are: labels meet their features.
    """
    rows = df if usable is None else df.filter(usable)
    known = labels.select(F.col(id).alias("_id"), F.col(label).cast("int").alias("_label")).filter("_label in (0, 1)")
    train = rows.select(F.col(id).alias("_id"), F.col(text).alias("_text")).join(known.hint("merge"), "_id")
    counts, n = cell_counts(train, "_text", "_label")
    # a share of the hashes, so that every partition hands on its part of about fit_rows rows
    part = F.xxhash64(text)
    chosen = rows.filter(F.abs(part.cast("double")) <= min(1.0, fit_rows / max(1, n)) * 2.0**63).select(F.col(id).alias("id"), part.alias("same"), F.col(text).alias("text"))
    fit = fit_features(chosen, counts).join(known, (F.col("id") == F.col("_id")) & (F.col("label") == F.col("_label")))
    numbers = ["n_words", "best", "total", "hits", "strong"]
    fit = fit.select("same", "label", *numbers).distinct().select(*[F.col(c).cast("double") for c in (*numbers, "label")]).toArrow()
    c = calibrate(*(v[np.lexsort([fit[k].to_numpy() for k in range(6)])] for v in (fit[k].to_numpy() for k in range(6))))
    lexicon = log_odds(counts, counts.sum(1))
    scored = segment_features(df, lexicon, text).drop(text)
    return scored.withColumn("score", probability(c)).withColumn("passages", significant(c))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from labels that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", (crc_remainder(F.col("doc_id"), 3) == 1).alias("held_out"))
    scored = score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), usable=~F.col("held_out"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
