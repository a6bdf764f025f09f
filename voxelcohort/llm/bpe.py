"""Byte-level BPE on padded numpy matrices, encoding and decoding."""

from __future__ import annotations

import base64
import heapq
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import slices, small_batches

NONE = np.int32(2**31 - 1)
#: Pieces above this many bytes are merged one by one with a heap, in n log n.
MATRIX_BYTES = 1024
MATRIX_CELLS = 1 << 20


def read_ranks(path: str) -> bytes:
    """A rank file as it is (a megabyte or so); the driver reads it and broadcasts it."""
    with open(path, "rb") as f:
        return f.read()


class Vocabulary:
    """Ranks of tokens, with a hash table of the pairs that merge.

    Two neighbours merge when their joined bytes are a token, whatever parts the
    token was made from; its rank is the priority.
    """

    def __init__(self, ranks: bytes):
        self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        top = max(self.rank.values()) + 1
        self.byte_rank = np.array([self.rank[bytes([i])] for i in range(256)], np.int32)
        pairs = {}
        for token, r in self.rank.items():
            for cut in range(1, len(token)):
                a, b = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = r
        self._hash(np.fromiter(pairs.keys(), np.uint64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs)))
        self.pairs = pairs
        self.length = np.zeros(top, np.int64)
        for token, r in self.rank.items():
            self.length[r] = len(token)
        self.start = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        self.flat = np.zeros(self.length.sum(), np.uint8)
        for token, r in self.rank.items():
            self.flat[self.start[r] : self.start[r] + len(token)] = np.frombuffer(token, np.uint8)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _hash(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Open addressing; every round places the keys whose slot is free and moves the others one on."""
        self.bits = max(8, int(len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.values = np.full(1 << self.bits, NONE)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] == np.uint64(2**64 - 1)]
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that two neighbours make, NONE if they make none."""
        keys = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        slot = self._slot(keys)
        out, found = self.values[slot], self.keys[slot]
        left = np.flatnonzero((found != keys) & (found != np.uint64(2**64 - 1)))
        out[(found != keys)] = NONE
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[left]]
            hit = found == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (found != np.uint64(2**64 - 1))]
        return out

    def _merge_matrix(self, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge in every row, round by round, the leftmost pair of least rank; finished rows leave the matrix."""
        rows, width = ids.shape
        done = ids.copy()
        at = np.arange(rows)
        n = size.copy()
        rank = np.full((rows, width), NONE)
        if width > 1:
            valid = np.arange(1, width)[None, :] < n[:, None]
            pair = np.full((rows, width - 1), NONE)
            pair[valid] = self.pair_rank(ids[:, :-1][valid], ids[:, 1:][valid])
            rank[:, :-1] = pair
        column = np.arange(width)
        final = size.copy()
        while len(at):
            best = rank.argmin(1)
            row = np.arange(len(at))
            least = rank[row, best]
            over = least == NONE
            if over.any():
                done[at[over], : ids.shape[1]], final[at[over]] = ids[over], n[over]
                go = ~over
                at, ids, rank, n, best, least = at[go], ids[go], rank[go], n[go], best[go], least[go]
                if not len(at):
                    break
                most = int(n.max())
                if most < ids.shape[1]:
                    ids, rank, column = ids[:, :most].copy(), rank[:, :most].copy(), np.arange(most)
                row = np.arange(len(at))
            behind = column[None, :] > best[:, None]
            ids[row, best] = least
            moved_ids, moved_rank = ids.copy(), rank.copy()
            moved_ids[:, :-1] = np.where(behind[:, :-1], ids[:, 1:], ids[:, :-1])
            shifted = np.full_like(rank, NONE)
            shifted[:, :-1] = rank[:, 1:]
            moved_rank = np.where(column[None, :] >= best[:, None], shifted, rank)
            ids, rank = moved_ids, moved_rank
            n = n - 1
            for offset in (0, -1):
                left = best + offset
                ok = (left >= 0) & (left + 1 < n)
                r = row[ok]
                fresh = np.full(len(row), NONE)
                fresh[ok] = self.pair_rank(ids[r, left[ok]], ids[r, left[ok] + 1])
                inside = left >= 0
                rank[row[inside], left[inside]] = fresh[inside]
        return done, final

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same order of merges on a linked list with a heap of pairs."""
        ids = [int(self.byte_rank[b]) for b in piece]
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.pairs.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = r, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] < n and (q := self.pairs.get(ids[left] << 32 | ids[after[left]])) is not None:
                    heapq.heappush(heap, (q, left, ids[left], ids[after[left]]))
        return [x for x, keep in zip(ids, alive) if keep]

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in one array, and where each piece starts in it (one more at the end)."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        parts: list = [None] * len(pieces)
        whole = np.fromiter((self.rank.get(p, -1) for p in pieces), np.int32, len(pieces))
        count = np.ones(len(pieces), np.int64)
        rest = np.flatnonzero((whole < 0) & (size <= MATRIX_BYTES))
        rest = rest[np.argsort(size[rest], kind="stable")]
        groups = []
        lo = 0
        while lo < len(rest):
            width = 1 << max(2, int(size[rest[lo]] - 1).bit_length())
            hi = min(int(np.searchsorted(size[rest], width, "right")), lo + max(1, MATRIX_CELLS // width))
            take = rest[lo:hi]
            width = int(size[take].max())
            data = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in take), np.uint8).reshape(len(take), width)
            done, n = self._merge_matrix(self.byte_rank[data], size[take])
            count[take] = n
            groups.append((take, done, n))
            lo = hi
        for i in np.flatnonzero((whole < 0) & (size > MATRIX_BYTES)):
            parts[i] = self._merge_long(pieces[i])
            count[i] = len(parts[i])
        start = np.concatenate([[0], np.cumsum(count)])
        out = np.zeros(start[-1], np.int32)
        single = np.flatnonzero(whole >= 0)
        out[start[single]] = whole[single]
        for take, done, n in groups:
            column = np.arange(done.shape[1])
            valid = column[None, :] < n[:, None]
            out[(start[take][:, None] + column[None, :])[valid]] = done[valid]
        for i, ids in enumerate(parts):
            if ids is not None:
                out[start[i] : start[i + 1]] = ids
        return out, start

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids, one after the other."""
        return self.flat[ranges(self.start[ids], self.length[ids])]


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, ``size`` of them, in one array."""
    total = int(size.sum())
    return np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(total) if total else np.zeros(0, np.int64)


_vocabularies: dict[bytes, Vocabulary] = {}


def _vocabulary(shared) -> Vocabulary:
    """One vocabulary a worker process; workers are used again."""
    ranks = shared.value
    if ranks not in _vocabularies:
        _vocabularies.clear()
        _vocabularies[ranks] = Vocabulary(ranks)
    return _vocabularies[ranks]


def encode_texts(texts: list[str], pattern, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in one array, and where each text starts in it; every distinct piece is merged once."""
    code: dict[str, int] = {}
    numbered = [[code.setdefault(p, len(code)) for p in pattern.findall(t)] for t in texts]
    ids, start = vocabulary.encode_pieces([p.encode() for p in code])
    use = np.fromiter((x for own in numbered for x in own), np.int64)
    size = np.diff(start)[use]
    pieces = np.concatenate([[0], np.cumsum(np.fromiter(map(len, numbered), np.int64, len(numbered)))])
    return ids[ranges(start[use], size)], np.concatenate([[0], np.cumsum(size)])[pieces]


def _with_column(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in df.schema.fields if f.name != name), T.StructField(name, kind)])


def _append(batch: pa.RecordBatch, name: str, column: pa.Array, drop: str | None) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n not in (name, drop)]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), column], names=[*names, name])


def encode(df: DataFrame, ranks: bytes, pattern: str, text: str = "text", out: str = "ids", keep_text: bool = True, round_trip: str | None = None) -> DataFrame:
    """Add ``out`` array<int>, the BPE ids of the whole ``text``.

    Null and empty texts have no ids. Every other column is kept; a column that
    is already named ``out`` is replaced. Texts are split by ``pattern``; each
    match is merged on its own, special tokens are ordinary text. With
    ``round_trip`` a boolean column of that name says whether decoding the ids
    gives the text's bytes back, checked by the worker that has both. The input is
    not exchanged. Repeated rows and ties need no rule: a row's ids depend on its
    own text only. Work is done in slices of about half a megabyte of whole texts,
    so memory does not grow with the partition.
    """
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    schema = _with_column(df, out, T.ArrayType(T.IntegerType(), False))
    drop = None if keep_text else text
    if not keep_text:
        schema = T.StructType([f for f in schema.fields if f.name != text])
    if round_trip:
        schema = T.StructType([*(f for f in schema.fields if f.name != round_trip), T.StructField(round_trip, T.BooleanType())])

    def run(batches):
        vocabulary, split = _vocabulary(shared), regex.compile(pattern)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for s in slices(column):
                own = pc.fill_null(column.slice(s.lo, len(s)), "").to_pylist()
                ids, start = encode_texts(own, split, vocabulary)
                done = _append(batch.slice(s.lo, len(s)), out, pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.array(ids, pa.int32())), drop)
                if round_trip:
                    same = [vocabulary.decode(ids[a:b]).tobytes() == s.text(k) for k, (a, b) in enumerate(zip(start[:-1], start[1:]))]
                    done = _append(done, round_trip, pa.array(same, pa.bool_()), None)
                yield done

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ranks: bytes, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out`` binary, the bytes of the ids in order; null ids count as none.

    An id outside the vocabulary raises. Every other column is kept; one that is
    already named ``out`` is replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        vocabulary = _vocabulary(shared)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                column = part.column(part.schema.get_field_index(ids))
                size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = pc.list_flatten(column).to_numpy(zero_copy_only=False)
                if len(flat) and (flat.min() < 0 or flat.max() >= len(vocabulary.length) or not vocabulary.length[flat].all()):
                    raise ValueError("an id is not in the vocabulary")
                data = vocabulary.decode(flat)
                ends = np.concatenate([[0], np.cumsum(vocabulary.length[flat])])[np.concatenate([[0], np.cumsum(size)])]
                yield _append(part, out, pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.binary()), None)

    return df.mapInArrow(run, _with_column(df, out, T.BinaryType()))


def tokenizer_path(spark: SparkSession, name: str = "byte_bpe_50k.tiktoken") -> str:
    """Rank file on the driver: below ``llm.tokenizers`` if the session sets it, else of the installed package."""
    import public_tokenizers

    folder = spark.conf.get("llm.tokenizers", None)
    return os.path.join(folder, name) if folder else public_tokenizers.path(name)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and round trip of every document, as digests."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ranks = read_ranks(tokenizer_path(spark))
    coded = decode(encode(docs, ranks, public_tokenizers.PATTERN, keep_text=False), ranks)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
