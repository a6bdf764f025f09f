"""Substring dedup by fixed-block anchors: words in exact repeats of a window or more are removed."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import map_groups
from .text import slices, small_batches, windows

#: Bytes of text that one task holds as arrays at a time.
BUCKET_BYTES = 1 << 21
#: Fingerprints of one hash part that one group holds, at 100 bytes each while they are sorted.
PART_ROWS = 1 << 20
BUCKET = "_repeat_bucket"


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]


def _unpack(data: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.reshape(-1).view("<u8").astype(np.uint64)


def part_keys(hashes: np.ndarray, parts: int, bits: int) -> np.ndarray:
    """Part from the low bits, fingerprint from the high bits, in one number that sorts by part."""
    part = (hashes & np.uint64((1 << 26) - 1)) % np.uint64(parts)
    return part << np.uint64(bits) | hashes >> np.uint64(64 - bits)


def _fold(keys: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys with any flag, and how often each was there."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate([cut, [len(keys)]]))
    return keys[cut], np.maximum.reduceat(flags[order], cut) if len(cut) else flags[:0], count


def cells(bucket: int, keys: np.ndarray, flags: np.ndarray, bits: int) -> pa.RecordBatch:
    """One row for each hash part: the part, the bucket that sends it and its packed fingerprints.

    Two low bits of a fingerprint say whether it is that of a reference block and
    whether the bucket holds it more than once.
    """
    keys, flags, count = _fold(keys, flags)
    part = (keys >> np.uint64(bits)).astype(np.int64)
    width = (bits + 2 + 7) // 8
    value = (keys & np.uint64((1 << bits) - 1)) << np.uint64(2) | flags.astype(np.uint64) << np.uint64(1) | (count > 1).astype(np.uint64)
    packed = _pack(value, width)
    cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    ends = np.concatenate([cut[1:], [len(part)]])
    return pa.RecordBatch.from_arrays(
        [pa.array(part[cut]), pa.array(np.full(len(cut), bucket)), pa.array([packed[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary())], names=["part", BUCKET, "packed"]
    )


def repeated(bits: int, reference: bool):
    """For one hash part: tell each bucket which of its fingerprints start more than once in the corpus.

    With ``reference``, only those that some reference block has.
    """
    width = (bits + 2 + 7) // 8

    def fn(table: pa.Table) -> pa.RecordBatch:
        part = table["part"][0].as_py()
        data = [_unpack(x, width) for x in table["packed"].to_pylist()]
        bucket = np.repeat(table[BUCKET].to_numpy(), [len(x) for x in data])
        value = np.concatenate(data)
        order = np.argsort(value >> np.uint64(2), kind="stable")
        value, bucket = value[order], bucket[order]
        mark = value >> np.uint64(2)
        cut = np.flatnonzero(np.concatenate([[True], mark[1:] != mark[:-1]]))
        count = np.diff(np.concatenate([cut, [len(mark)]]))
        hit = (count > 1) | (np.maximum.reduceat(value & np.uint64(1), cut) > 0)
        if reference:
            hit &= np.maximum.reduceat(value & np.uint64(2), cut) > 0
        keep = np.repeat(hit, count)
        keys, bucket = np.uint64(part) << np.uint64(bits) | mark[keep], bucket[keep]
        order = np.argsort(bucket, kind="stable")
        keys, bucket = keys[order], bucket[order]
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
        ends = np.concatenate([cut[1:], [len(bucket)]])
        return pa.RecordBatch.from_arrays([pa.array(bucket[cut]), pa.array([keys[a:b].astype("<u8").tobytes() for a, b in zip(cut, ends)], pa.binary())], names=[BUCKET, "packed"])

    return fn


def is_in(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def known_keys(table: pa.Table) -> np.ndarray:
    parts = [np.frombuffer(x, "<u8") for x in table["packed"].to_pylist()]
    return np.sort(np.concatenate(parts)).astype(np.uint64) if parts else np.zeros(0, np.uint64)


def mark_repeats(df: DataFrame, text: str = "text", window: int = 35) -> DataFrame:
    """Find every word that lies in a window of ``window`` words which also starts elsewhere in the corpus.

    Adds ``n_words`` long, ``n_removed`` long, ``spans`` array<struct<first,words>>
    (the maximal exact repeats, as ranges of words) and ``kept`` string (the
    other words joined by one space). Every other column is kept; columns with
    those names are replaced. Words are the runs of ``[^\\x20\\x09-\\x0D]``, unchanged.
    "Elsewhere" counts other places of the same text too, so repeated rows remove
    each other. Null and empty texts have no words; an empty table gives none.

    Method. A window of w words holds a whole block of (w + 1) div 2 words at a
    multiple of that length, so two equal windows share a reference block of one
    that is a rolling window of the other. Documents are dealt once into buckets
    of about two megabytes of text. Each bucket sends the fingerprints of its
    reference blocks and of all its rolling windows, packed and each once, to
    the hash part of the fingerprint; a block that also starts elsewhere is told
    back to its buckets. Hits are then extended: only the windows around a hit are
    counted over the corpus in the same way, and neighbouring repeated windows
    make one maximal repeat. A passage in a third of all texts costs one
    fingerprint a bucket. Windows are compared by 64-bit hashes, of which at least
    55 bits travel.
    """
    spark = df.sparkSession
    small_batches(spark)
    block = (window + 1) // 2
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size, n_rows = df.agg(F.sum(F.octet_length(text)), F.count(F.lit(1))).first()
    buckets = max(1, math.ceil(max((size or 0) / BUCKET_BYTES, n_rows / 20_000)))
    parts = max(1, 2 * partitions, math.ceil((size or 0) / 6 / PART_ROWS))
    names = [c for c in df.columns if c not in ("n_words", "n_removed", "spans", "kept")]
    base = df.select(*names, F.pmod(F.xxhash64(*[c for c in df.columns if dict(df.dtypes)[c].split("<")[0] != "map"]), F.lit(buckets)).alias(BUCKET)).repartition(partitions, BUCKET)
    cell = f"part long, {BUCKET} long, packed binary"
    reply = f"{BUCKET} long, packed binary"
    anchor_bits, window_bits = 38, 46

    def anchors(table: pa.Table) -> pa.Table:
        keys, flags = [], []
        for s in slices(table[text]):
            own, starts = windows(*s.words_and_first(), block)
            first = s.first
            owner = np.searchsorted(first, starts, "right") - 1
            keys.append(part_keys(own, parts, anchor_bits))
            flags.append(((starts - first[owner]) % block == 0).astype(np.uint8))
        return pa.Table.from_batches([cells(table[BUCKET][0].as_py(), np.concatenate(keys), np.concatenate(flags), anchor_bits)])

    def extended(table: pa.Table, told: pa.Table) -> pa.Table:
        known, keys = known_keys(told), [np.zeros(0, np.uint64)]
        if table.num_rows:
            for s in slices(table[text]) if len(known) else ():
                hashes, first = s.words_and_first()
                own, starts = windows(hashes, first, block)
                hits = np.zeros(len(hashes) + 1, np.int64)
                hits[starts[is_in(part_keys(own, parts, anchor_bits), known)] + 1] = 1
                hits = np.cumsum(hits)
                own, starts = windows(hashes, first, window)
                near = hits[starts + window - block + 1] > hits[starts]
                keys.append(part_keys(own[near], parts, window_bits))
        found = np.concatenate(keys)
        bucket = table[BUCKET][0].as_py() if table.num_rows else 0
        return pa.Table.from_batches([cells(bucket, found, np.zeros(len(found), np.uint8), window_bits)])

    def cut(table: pa.Table, told: pa.Table) -> pa.Table:
        known = known_keys(told)
        n_words, n_removed, kept, spans = [], [], [], []
        for s in slices(table[text]) if table.num_rows else ():
            hashes, first = s.words_and_first()
            gone = np.zeros(len(hashes) + 1, np.int64)
            if len(known):
                own, starts = windows(hashes, first, window)
                starts = starts[is_in(part_keys(own, parts, window_bits), known)]
                gone[starts] += 1
                gone[starts + window] -= 1
            gone = np.cumsum(gone)[:-1] > 0
            total = np.concatenate([[0], np.cumsum(gone)])
            for k in range(len(s)):
                lo, hi = first[k], first[k + 1]
                words = s.text(k).split()
                lost = int(total[hi] - total[lo])
                if lost:
                    own = gone[lo:hi]
                    words = [w for w, out in zip(words, own.tolist()) if not out]
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], own, [0]]).astype(np.int8)))
                    spans.append([{"first": int(a), "words": int(b - a)} for a, b in zip(edge[::2], edge[1::2])])
                else:
                    spans.append([])
                n_words.append(int(hi - lo))
                n_removed.append(lost)
                kept.append(b" ".join(words).decode())
        out = [table[c] for c in names] if table.num_rows else [pa.array([], f.type) for f in table.schema if f.name in names]
        return pa.table([*out, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32())]))), pa.array(kept, pa.string())], names=[*names, "n_words", "n_removed", "spans", "kept"])

    sent = base.groupBy(BUCKET).applyInArrow(anchors, cell)
    hits = map_groups(sent, ["part"], repeated(anchor_bits, True), reply)
    sent = base.groupBy(BUCKET).cogroup(hits.groupBy(BUCKET)).applyInArrow(extended, cell)
    again = map_groups(sent, ["part"], repeated(window_bits, False), reply)
    span = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("words", T.IntegerType())]))
    schema = T.StructType([*(f for f in df.schema.fields if f.name in names), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", span), T.StructField("kept", T.StringType())])
    return base.groupBy(BUCKET).cogroup(again.groupBy(BUCKET)).applyInArrow(cut, schema)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What 35-word repeats leave of every document, as a digest."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return mark_repeats(docs, window=35).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP6_SQL = r"""
with words as (select doc_id, row_number() over () as r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
starts as (select r, unnest(range(1, len(w) - 33)) as i from words where len(w) >= 35),
win as (select s.r, s.i, array_to_string(list_slice(w, i, i + 34), ' ') as t from starts s join words using (r)),
again as (select r, i from win where t in (select t from win group by t having count(*) > 1)),
gone as (select distinct r, unnest(range(i, i + 35)) as p from again),
flat as (select r, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from words),
kept as (select f.r, count(g.p) as n_removed, coalesce(string_agg(word, ' ' order by f.p) filter (where g.p is null), '') as t
         from flat f left join gone g on f.r = g.r and f.p = g.p group by f.r)
select doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from words left join kept using (r)
"""
