"""Language of whole texts by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import Slice, slices, small_batches

#: Bytes a window; the state starts at zero in each, in training and in use.
WINDOW = 128
#: Bytes of text that are in work at a time.
WORK_BYTES = 1 << 19
UNDETERMINED = "und"


class GatedNetwork:
    """One gated recurrent layer in each direction and a softmax at every position.

    For byte x and state h: gates z, r = hard sigmoid(E_zr[x] + U_zr h), candidate
    c = tanh(E_c[x] + r * (U_c h)), new state z * h + (1 - z) * c.
    """

    def __init__(self, labels: list[str], hidden: int = 8, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.labels, self.hidden = labels, hidden
        k = len(labels)
        self.p = {}
        for d in "fb":
            self.p["E" + d] = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
            self.p["E" + d][:, :hidden] += 1.0
            self.p["U" + d] = (rng.normal(0, 1, (hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32)
            self.p["V" + d] = (rng.normal(0, 1, (hidden, k)) / np.sqrt(hidden)).astype(np.float32)
        self.p["b"] = np.zeros(k, np.float32)

    def _direction(self, d: str, x: np.ndarray) -> tuple[np.ndarray, list]:
        """States of all positions of equally long windows ``x`` (window, position), and what their gradient needs."""
        H = self.hidden
        E, U = self.p["E" + d], self.p["U" + d]
        n, length = x.shape
        h = np.zeros((n, H), np.float32)
        states, kept = np.zeros((length, n, H), np.float32), []
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            a = h @ U
            gate = E[x[:, t]]
            pre = 0.25 * (gate[:, : 2 * H] + a[:, : 2 * H]) + 0.5
            zr = np.clip(pre, 0, 1)
            z, r = zr[:, :H], zr[:, H:]
            c = np.tanh(gate[:, 2 * H :] + r * a[:, 2 * H :])
            new = c + z * (h - c)
            kept.append((t, h, a[:, 2 * H :], z, r, c, (pre > 0) & (pre < 1)))
            states[t] = h = new
        return states, kept

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean cross entropy over positions and its gradient by backpropagation through time."""
        H, (n, length) = self.hidden, x.shape
        states, kept = {}, {}
        for d in "fb":
            states[d], kept[d] = self._direction(d, x)
        logit = states["f"] @ self.p["Vf"] + states["b"] @ self.p["Vb"] + self.p["b"]
        logit -= logit.max(-1, keepdims=True)
        prob = np.exp(logit)
        prob /= prob.sum(-1, keepdims=True)
        loss = -np.log(np.maximum(prob[:, np.arange(n), y], 1e-9)).mean()
        delta = prob
        delta[:, np.arange(n), y] -= 1
        delta /= n * length
        g = {"b": delta.sum((0, 1))}
        for d in "fb":
            U, V = self.p["U" + d], self.p["V" + d]
            g["V" + d] = np.einsum("tnh,tnk->hk", states[d], delta)
            out = delta @ V.T
            gE, gU = np.zeros_like(self.p["E" + d]), np.zeros_like(U)
            back = np.zeros((n, H), np.float32)
            for t, h, ac, z, r, c, soft in reversed(kept[d]):
                dh = out[t] + back
                dc = dh * (1 - z) * (1 - c * c)
                dgate = np.concatenate([dh * (h - c), dc * ac], 1) * soft * 0.25
                da = np.concatenate([dgate, dc * r], 1)
                gU += h.T @ da
                np.add.at(gE, x[:, t], np.concatenate([dgate, dc], 1))
                back = dh * z + da @ U.T
            g["E" + d], g["U" + d] = gE, gU
        return float(loss), g

    def fit(self, texts: list[bytes], y: np.ndarray, steps: int = 240, batch: int = 160, length: int = 64, rate: float = 0.02, seed: int = 5) -> list[float]:
        """Adam over random windows of the texts."""
        rng = np.random.default_rng(seed)
        usable = np.array([i for i, t in enumerate(texts) if t])
        if not len(usable):
            return []
        by_label = [usable[y[usable] == k] for k in range(len(self.labels))]
        by_label = [(k, own) for k, own in enumerate(by_label) if len(own)]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        losses = []
        for step in range(1, steps + 1):
            x, target = np.zeros((batch, length), np.uint8), np.zeros(batch, np.int64)
            for i in range(batch):
                k, own = by_label[i % len(by_label)]
                t = texts[rng.choice(own)]
                at = int(rng.integers(0, max(1, len(t) - length + 1)))
                piece = np.frombuffer(t[at : at + length], np.uint8)
                x[i], target[i] = np.resize(piece, length), k
            loss, g = self.gradients(x, target)
            losses.append(loss)
            lr = rate * min(1.0, 2 * (1 - (step - 1) / steps))
            for k, v in self.p.items():
                grad = np.clip(g[k], -1, 1)
                m[k] = 0.9 * m[k] + 0.1 * grad
                s[k] = 0.99 * s[k] + 0.01 * grad * grad
                v -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return losses

    def label_slice(self, s: Slice) -> tuple[np.ndarray, np.ndarray]:
        """Sum of position probabilities of each text (text, label), and how many positions each label has in it."""
        H, K = self.hidden, len(self.labels)
        size = np.diff(s.offsets)
        n_win = -(-size // WINDOW)
        owner = np.repeat(np.arange(len(s)), n_win)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(n_win) - n_win, n_win)
        start = s.offsets[:-1][owner] + within * WINDOW
        length = np.minimum(size[owner] - within * WINDOW, WINDOW)
        order = np.argsort(-length, kind="stable")
        owner, start, length = owner[order], start[order], length[order]
        n = len(owner)
        sums, counts = np.zeros((len(s), K)), np.zeros((len(s), K), np.int64)
        if not n:
            return sums, counts
        active = np.searchsorted(-length, -np.arange(1, int(length[0]) + 1), "right")  # windows longer than t
        forward: list[np.ndarray] = []
        pooled, votes = np.zeros((K, n), np.float32), np.zeros((K, n), np.int32)
        # one row a unit and one column a window, so every step works along contiguous memory
        for d in "fb":
            E, U = self.p["E" + d].T.copy(), self.p["U" + d].T.copy()
            E[: 2 * H] = 0.25 * E[: 2 * H] + 0.5
            U[: 2 * H] *= 0.25
            V, b = self.p["V" + d].T.copy(), self.p["b"][:, None]
            h = np.zeros((H, n), np.float32)
            for t in range(len(active)) if d == "f" else range(len(active) - 1, -1, -1):
                k = active[t]
                own = h[:, :k]
                gate = E.take(s.data[start[:k] + t], axis=1)
                a = U @ own
                zr = gate[: 2 * H]
                zr += a[: 2 * H]
                np.maximum(zr, 0, out=zr)
                np.minimum(zr, 1, out=zr)
                c = a[2 * H :]
                c *= zr[H:]
                c += gate[2 * H :]
                np.tanh(c, out=c)
                own -= c
                own *= zr[:H]
                own += c
                if d == "f":
                    forward.append(V @ own)
                else:
                    logit = V @ own
                    logit += forward[t]
                    logit += b
                    top = logit.max(0)
                    votes[:, :k] += logit >= top
                    logit -= top
                    np.exp(logit, out=logit)
                    logit /= logit.sum(0)
                    pooled[:, :k] += logit
        pooled, votes = pooled.T, votes.T
        np.add.at(sums, owner, pooled)
        np.add.at(counts, owner, votes)
        return sums, counts


def crc_remainder(id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def labelled_sample(df: DataFrame, text: str, label: str, per_label: int, chars: int) -> list:
    """At most ``per_label`` different texts of each label as ``(label, rank, piece)``, chosen by hash; a bounded sample for the fit.

    One pass counts the labels' texts, one takes those whose hash is below the share,
    copies once, and the least hashes of each label stay.
    A piece is ``chars`` characters from a place the hash gives.
    """
    h = F.xxhash64("text")
    rows = df.filter(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).cast("string").alias("label"), F.col(text).alias("text"))
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.approx_count_distinct(h).alias("n")).collect()}
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 1.5 * per_label / max(1, n)))])
    place = F.lit(1) + F.pmod(h, F.greatest(F.length("text") - F.lit(chars), F.lit(1)).cast("long")).cast("int")
    below = F.pmod(F.shiftright(h, 7), F.lit(1_000_000))
    picked = rows.withColumn("h", below).filter(F.col("h") < F.try_element_at(share, F.col("label")) * 1_000_000)
    picked = picked.groupBy("label", "h", F.xxhash64("text").alias("text")).agg(F.min(F.substring("text", place, F.lit(chars))).alias("piece"))
    least = Window.partitionBy("label").orderBy("h", "text")
    ranked = picked.withColumn("_r", F.row_number().over(least)).filter(F.col("_r") <= per_label)
    return sorted((r["label"], r["_r"], r["piece"]) for r in ranked.select("label", "_r", "piece").collect())


def train(df: DataFrame, text: str = "text", lang: str = "lang", per_lang: int = 400, chars: int = 600) -> GatedNetwork | None:
    """Fit the network on at most ``per_lang`` texts of each language; None when no row has a language."""
    sample = labelled_sample(df, text, lang, per_lang, chars)
    labels = sorted({k for k, *_ in sample})
    if not labels:
        return None
    net = GatedNetwork(labels)
    net.fit([p.encode() for *_, p in sample], np.array([labels.index(k) for k, *_ in sample]))
    return net


def predict(df: DataFrame, net: GatedNetwork | None, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` string, ``score`` double and ``lang_bytes`` map<string,long>.

    Every byte position of the whole text gets label probabilities from both
    directions; ``score`` is the largest mean probability and ``lang_pred`` its
    label (the first in order on a tie); ``lang_bytes`` counts the positions
    whose likeliest label is each. Texts are cut into windows of 128 bytes that
    are labelled side by side, so a long text costs as much as many short ones.
    Null texts, texts without a letter, and all texts without a network get
    ``und``, score 0 and no counts. Other columns are kept; those three names are
    replaced. Nothing is exchanged; memory is bounded by half a megabyte of text.
    """
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(net)
    names = [c for c in df.columns if c not in ("lang_pred", "score", "lang_bytes")]
    marked = df.select(*names, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("_has_letter"))
    schema = T.StructType([*(f for f in df.schema.fields if f.name in names), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("lang_bytes", T.MapType(T.StringType(), T.LongType()))])

    def run(batches):
        own = shared.value
        for batch in batches:
            for s in slices(batch.column(batch.schema.get_field_index(text)), WORK_BYTES):
                part = batch.slice(s.lo, len(s))
                letter = part.column(part.num_columns - 1).to_numpy(zero_copy_only=False)
                lang, score, counts = [], [], []
                if own is None:
                    lang, score, counts = [UNDETERMINED] * len(s), [0.0] * len(s), [[]] * len(s)
                else:
                    sums, votes = own.label_slice(s)
                    total = np.maximum(np.diff(s.offsets), 1)
                    best = sums.argmax(1)
                    value = np.clip(sums[np.arange(len(s)), best] / total, 0, 1)
                    for k in range(len(s)):
                        lang.append(own.labels[best[k]] if letter[k] else UNDETERMINED)
                        score.append(float(value[k]) if letter[k] else 0.0)
                        counts.append([(own.labels[j], int(votes[k, j])) for j in np.flatnonzero(votes[k])] if letter[k] else [])
                columns = [part.column(i) for i in range(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(counts, pa.map_(pa.string(), pa.int64()))], names=[*names, "lang_pred", "score", "lang_bytes"])

    return marked.mapInArrow(run, schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from the rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", crc_remainder(F.col("doc_id"), 4) == 2)
    net = train(docs.filter(~F.col("held_out")))
    return predict(docs.select("doc_id", "held_out", "text"), net).select("doc_id", "held_out", "lang_pred", "score")
