"""N-gram Jaccard join on parity sketches: pigeonhole candidates in size bands, exact verification."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelcohort.session import cut_lineage

from .batches import map_groups
from .graph import apart, components, perhaps_in
from .shared_text import BUCKET, PART_ROWS, cells, is_in, known_keys, part_keys, repeated
from .text import LOWER_VALUES, mix, shingles, slices, small_batches

GROWTH = 2.0
CHECK_BITS = 1024
TILE_TEXTS = 1024
TILE_BYTES = 1 << 22
#: Nodes of one key whose sketches one task compares, and bounds of a sketch that travels.
TILE_NODES = 4096
LEAST_BITS, MOST_BITS = 256, 1 << 16
#: Sets whose keys one task holds at a time, and bits of a key that travel beside its part.
BUCKET_SETS = 4096
KEY_BITS = 46
#: Copies that a task may forget after.
REMEMBERED = 200_000


def _band_edges(top: int) -> np.ndarray:
    """Sizes at which a band ends: a band holds sizes below its edge and not below the edge before."""
    edges = [1]
    while edges[-1] <= top:
        edges.append(max(edges[-1] + 1, math.ceil(edges[-1] * GROWTH)))
    return np.array(edges)


def _most_different(size: np.ndarray, num: int, den: int) -> np.ndarray:
    """Largest symmetric difference that a set of ``size`` can have to any set it links with."""
    return size * (den - num) // num


def _set_hashes(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One 64-bit hash a set, from the sum of its mixed shingles and its size."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(values + np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    return mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def band_keys(values: np.ndarray, first: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the sketch blocks by which each set is looked up, and the first key of each set.

    A set lies in the size band of every partner it can have that is as large or
    larger. In a band every shingle toggles one bit of one block of the sketch,
    so blocks of two sets differ in at most as many places as the sets do. A set
    sends the fullest D + 1 blocks, D being the largest symmetric difference that
    a link allows; the order (count, block) is the same for blocks that agree, so
    two linked sets share one at least.
    """
    size = np.diff(first).astype(np.int64)
    top = int(size.max(initial=0))
    edges = _band_edges(int(top * den / num) + 1)
    most = _most_different(size, num, den)
    home = np.searchsorted(edges, size, "right")
    owner, band = [], []
    step = 0
    live = np.flatnonzero(most > 0)
    while len(live):
        owner.append(live)
        band.append(home[live] + step)
        step += 1
        below = edges[home[live] + step - 1]  # the smallest size of that band
        live = live[den * size[live] >= num * below]
    if not owner:
        return np.zeros(0, np.uint64), np.zeros(len(first), np.int64)
    owner, band = np.concatenate(owner), np.concatenate(band)
    blocks = np.ceil(1.15 * _most_different(edges[band], num, den)).astype(np.int64) + 2
    base = np.concatenate([[0], np.cumsum(blocks)])
    n = size[owner]
    emission = np.repeat(np.arange(len(owner)), n)
    token = np.repeat(first[:-1][owner] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    v = values[token]
    cell = base[emission] + ((v >> np.uint64(33)) % blocks[emission].astype(np.uint64)).astype(np.int64)
    order = np.argsort(cell, kind="stable")
    cell, v = cell[order], v[order]
    cut = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    parity, exact = np.zeros(base[-1], np.uint64), np.zeros(base[-1], np.uint64)
    parity[cell[cut]] = np.bitwise_xor.reduceat(np.uint64(1) << (v & np.uint64(63)), cut)
    exact[cell[cut]] = np.bitwise_xor.reduceat(mix(v), cut)
    count = np.bincount(cell, minlength=base[-1])
    whose = np.repeat(np.arange(len(owner)), blocks)
    block = np.arange(base[-1]) - base[whose]
    order = np.lexsort((block, -count, whose))
    rank = np.arange(base[-1]) - base[whose]
    order = order[rank < most[owner][whose] + 1]
    whose = whose[order]
    keys = mix(parity[order] ^ mix(exact[order] + band[whose].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + block[order].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
    by = np.argsort(owner[whose], kind="stable")
    return keys[by], np.searchsorted(owner[whose][by], np.arange(len(first)))


def check_sketches(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Parity of shingles in 1024 bits a set; the Hamming distance never exceeds the symmetric difference."""
    n = len(first) - 1
    owner = np.repeat(np.arange(n), np.diff(first))
    bit = ((values >> np.uint64(40)) & np.uint64(CHECK_BITS - 1)).astype(np.int64)
    odd = (np.bincount(owner * CHECK_BITS + bit, minlength=n * CHECK_BITS) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n, CHECK_BITS), axis=1).view(np.uint64)


def sized_sketches(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """Parity of shingles as bytes, in at least 1.5 bits a shingle within bounds; the upper half may be folded on the lower."""
    size = np.diff(first).astype(np.int64)
    bits = np.int64(1) << np.ceil(np.log2(np.clip(1.5 * size, LEAST_BITS, MOST_BITS))).astype(np.int64)
    base = np.concatenate([[0], np.cumsum(bits)])
    owner = np.repeat(np.arange(len(size)), size)
    cell = base[owner] + ((values >> np.uint64(40)).astype(np.int64) & (bits[owner] - 1))
    packed = np.packbits((np.bincount(cell, minlength=base[-1]) & 1).astype(np.uint8))
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((base // 8).astype(np.int32)), pa.py_buffer(packed)])


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit words, the longer ones folded to the shortest."""
    length = np.array([len(x) for x in sketches])
    out = np.empty((len(sketches), int(length.min()) // 8), np.uint64)
    for n in np.unique(length):
        at = np.flatnonzero(length == n)
        rows = np.frombuffer(b"".join([sketches[k] for k in at]), np.uint64).reshape(len(at), -1)
        while rows.shape[1] > out.shape[1]:
            half = rows.shape[1] // 2
            rows = rows[:, :half] ^ rows[:, half:]
        out[at] = rows
    return out


def near_links(size: np.ndarray, sketch: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Like ``spanning_links``, of the pairs that sizes and sketches do not rule out."""
    return _search(size, sketch, num, den, lambda x, may: may)


def spanning_links(values: np.ndarray, first: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links that connect what the pairs of these sets connect: a breadth-first search that asks each set for unreached ones only."""
    size = np.diff(first).astype(np.int64)

    def linked(x: int, may: np.ndarray) -> np.ndarray:
        own = values[first[x] : first[x + 1]]
        n_may = size[may]
        ends = np.cumsum(n_may)
        at = np.repeat(first[:-1][may] - (ends - n_may), n_may) + np.arange(ends[-1])
        other = values[at]
        same = own[np.minimum(np.searchsorted(own, other), len(own) - 1)] == other
        shared = np.add.reduceat(same.astype(np.int64), ends - n_may)
        return may[den * shared >= num * (size[x] + n_may - shared)]

    return _search(size, check_sketches(values, first), num, den, linked)


def _search(size: np.ndarray, sketch: np.ndarray, num: int, den: int, check: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    left = np.arange(len(size))
    found = []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            a, b = np.minimum(size[x], size[left]), np.maximum(size[x], size[left])
            may = left[(den * a >= num * b) & (a > 0)]
            if not len(may):
                continue
            apart = np.bitwise_count(sketch[may] ^ sketch[x]).sum(1, dtype=np.int64)
            may = may[apart * (den + num) <= (size[x] + size[may]) * (den - num)]
            if not len(may):
                continue
            linked = check(x, may)
            if len(linked):
                found += [(x, int(y)) for y in linked]
                queue += linked.tolist()
                left = left[~np.isin(left, linked, assume_unique=True)]
    return found


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype("<u8").view(np.int64)


def _shared_keys(sets: DataFrame, n_sets: int) -> DataFrame:
    """Keys that more than one set has, as rows ``(key, node)``; nearly all keys belong to one set and stay where they are.

    Sets ``(node, keys)`` are dealt into buckets by node, which also brings
    copies together. A bucket sends each of its keys once, as a packed
    fingerprint, to the key's hash part, which tells it the keys that others
    hold as well.
    """
    spark = sets.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, 2 * partitions, math.ceil(n_sets * 100 / PART_ROWS))
    base = sets.select("node", "keys", F.pmod(F.xxhash64("node"), F.lit(max(1, math.ceil(n_sets / BUCKET_SETS)))).alias(BUCKET)).repartition(partitions, BUCKET)

    def distinct(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the bucket's different nodes, and whose they are."""
        node, at = np.unique(table["node"].to_numpy(), return_index=True)
        keys = table["keys"].combine_chunks().take(pa.array(at))
        size = keys.value_lengths().to_numpy()
        return keys.flatten().to_numpy().view(np.uint64), np.repeat(node, size)

    def send(table: pa.Table) -> pa.Table:
        keys, _ = distinct(table)
        return pa.Table.from_batches([cells(table[BUCKET][0].as_py(), part_keys(keys, parts, KEY_BITS), np.zeros(len(keys), np.uint8), KEY_BITS)])

    def pick(table: pa.Table, told: pa.Table) -> pa.Table:
        keys, node = distinct(table) if table.num_rows else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        hit = is_in(part_keys(keys, parts, KEY_BITS), known_keys(told))
        return pa.table({"key": keys[hit].view(np.int64), "node": node[hit]})

    sent = base.groupBy(BUCKET).applyInArrow(send, f"part long, {BUCKET} long, packed binary")
    told = map_groups(sent, ["part"], repeated(KEY_BITS, False), f"{BUCKET} long, packed binary")
    return base.groupBy(BUCKET).cogroup(told.groupBy(BUCKET)).applyInArrow(pick, "key long, node long")


def _gather_keys(keys: DataFrame) -> DataFrame:
    """Star edges of every block key that more than one set has: ``(a, b)``, b the smallest set of the key."""
    shared = keys.groupBy("key").agg(F.min("node").alias("b"), F.max("node").alias("_last")).filter("b != _last").drop("_last")
    return keys.join(apart(shared, "key"), "key").filter("node != b").select(F.col("node").alias("a"), "b").distinct()


def _near_edges(keys: DataFrame, nodes: DataFrame, signed: DataFrame, num: int, den: int) -> DataFrame:
    """Edges ``(a, b)`` that connect what pairs with a common key connect, without the pairs that their sketches rule out.

    Of the keys that hold the same ``nodes`` one is looked at. A key's nodes
    are cut into tiles of bounded nodes and bytes, and every pair of tiles is
    one task group.
    """
    rows = cut_lineage(keys.join(nodes, "node").select("key", "node", "n"))
    held = (
        rows.groupBy("key")
        .agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("n"), F.bit_xor(F.xxhash64("node")).alias("_x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("_y"))
        .filter("size > 1")
        .groupBy("size", "_x", "_y")
        .agg(F.min("key").alias("key"), F.max("n").alias("n"))
        .select("key", F.greatest(F.ceil(F.col("size") / TILE_NODES), F.ceil(F.col("n") * 3 / 8 / TILE_BYTES)).alias("tiles"))
    )
    dealt = _tile_pairs(rows.join(apart(held, "key"), "key"), "key", "n")
    sketches = perhaps_in(signed.select("node", "sketch"), "node", nodes.select("node")).filter("_perhaps").groupBy("node").agg(F.first("sketch").alias("sketch"))
    compared = dealt.join(apart(sketches, "node"), "node").select("key", "i", "j", "node", "n", "sketch")

    def near(table: pa.Table) -> pa.RecordBatch:
        node = table["node"].to_numpy()
        found = np.array(near_links(table["n"].to_numpy(), folded(table["sketch"].to_pylist()), num, den), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(node[found[:, 0]]), pa.array(node[found[:, 1]])], names=["a", "b"])

    return map_groups(compared, ["key", "i", "j"], near, "a long, b long")


def _tile_pairs(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """Each row once for every pair ``(i, j)`` of its key's ``tiles`` that has its own; keeps ``node``, the key and ``columns``."""
    own = F.pmod(F.xxhash64("node"), F.col("tiles"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    return df.select("node", key, *columns, own.alias("_own"), every.alias("_with")).select("node", key, *columns, F.least("_own", "_with").alias("i"), F.greatest("_own", "_with").alias("j"))


def jaccard_groups(df: DataFrame, id: str = "doc_id", text: str = "text", words: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """Group documents linked by the Jaccard similarity num/den or more of their distinct word shingles.

    Returns one row for each input row: ``id``, ``n_shingles`` long and
    ``component_id``, the smallest id reachable by links. A-Z count as a-z. A text
    of fewer than ``words`` words has its whole sequence as one shingle; a null
    or empty one has none and links with nothing. Null ids keep a null component
    and lend no id to others, though their text still connects. Rows that repeat
    an id are judged by their own text. Extra columns are not read; an empty table
    gives none.

    Method. Equal sets are one node at once (hash of the set). Every node has the
    keys of its sketch blocks (``band_keys``); keys that others have too are
    found by packed fingerprints (``_shared_keys``), and nodes that share one are
    gathered into families through the smallest node of the key, so a key costs
    as many edges as it has nodes and not pairs. Keys of passages that many texts
    quote chain unlike sets, the more the larger the table; a family above one
    tile is therefore gathered anew from the pairs of its keys that sketches do
    not rule out (``_near_edges``). Families are cut into tiles of
    bounded texts and bytes; every pair of tiles is one task group, in which
    Hamming distances of parity sketches are compared first and what they leave
    is verified on the shingles. A tile returns a spanning set of its links, and
    the components of those are the groups. Sets are told apart by 64-bit hashes.
    """

    def signatures(batches):
        for batch in batches:
            for s in slices(batch.column(1)):
                values, first = shingles(*s.words(LOWER_VALUES), words)
                columns = [batch.column(0).slice(s.lo, len(s)), pa.array(np.diff(first).astype(np.int64)), pa.array(_signed(_set_hashes(values, first))), sized_sketches(values, first)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_shingles", "node", "sketch"])

    def named(batches):
        for batch in batches:
            for s in slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(_signed(_set_hashes(*shingles(*s.words(LOWER_VALUES), words)))), batch.column(1).slice(s.lo, len(s))], names=["node", "text"])

    def sketches(batches):
        """Keys of each set, once for all copies that this task meets in a while."""
        seen: set[int] = set()
        for batch in batches:
            for s in slices(batch.column(0)):
                values, first = shingles(*s.words(LOWER_VALUES), words)
                node = _signed(_set_hashes(values, first)).tolist()
                fresh = np.zeros(len(node), bool)
                for k, x in enumerate(node):
                    if x not in seen:
                        seen.add(x)
                        fresh[k] = True
                keep = np.repeat(fresh, np.diff(first))
                values, first = values[keep], np.concatenate([[0], np.cumsum(np.diff(first)[fresh])])
                keys, at = band_keys(values, first, num, den)
                some = np.flatnonzero(np.diff(at))
                ends = np.concatenate([[0], np.cumsum(np.diff(at)[some])])
                yield pa.RecordBatch.from_arrays([pa.array(np.array(node, np.int64)[fresh][some]), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(_signed(keys)))], names=["node", "keys"])
            if len(seen) > REMEMBERED:
                seen.clear()

    small_batches(df.sparkSession)
    kind = dict(df.dtypes)[id]
    docs = df.select(F.col(id).alias("id"), F.col(text).alias("text"))
    signed = cut_lineage(docs.mapInArrow(signatures, f"id {kind}, n_shingles long, node long, sketch binary"))
    sets = docs.select("text").mapInArrow(sketches, "node long, keys array<long>")
    keys = cut_lineage(_shared_keys(sets, signed.count()))
    family = components(cut_lineage(_gather_keys(keys)))

    reps = signed.filter("n_shingles > 0").groupBy("node").agg(F.min("id").alias("least"), F.max("n_shingles").alias("n"))
    tiles = F.greatest(F.ceil(F.count(F.lit(1)) / TILE_TEXTS), F.ceil(F.sum("n") * 8 / TILE_BYTES)).alias("tiles")
    members = cut_lineage(family.join(reps, "node").select("node", F.col("component").alias("family"), "least", "n"))
    crowded = cut_lineage(members.groupBy("family").agg(tiles).filter("tiles > 1").select("family"))
    if not crowded.isEmpty():
        crowd = cut_lineage(members.join(apart(crowded, "family"), "family").select("node", "least", "n"))
        near = components(_near_edges(keys, crowd.select("node", "n"), signed, num, den)).withColumnRenamed("component", "family")
        members = cut_lineage(members.join(apart(crowded, "family"), "family", "left_anti").unionByName(near.join(crowd, "node")))
    dealt = _tile_pairs(members.join(apart(members.groupBy("family").agg(tiles), "family"), "family"), "family", "least")
    wanted = perhaps_in(docs, "id", members.select(F.col("least").alias("id"))).filter("_perhaps").drop("_perhaps")
    tiled = wanted.join(dealt, wanted["id"] == dealt["least"]).select("family", "i", "j", "node", "text")
    if not signed.filter("id is null and n_shingles > 0").isEmpty():
        # sets that only rows without an id have bring a text by their hash
        nameless = docs.filter("id is null").mapInArrow(named, "node long, text string").groupBy("node").agg(F.min("text").alias("text"))
        tiled = tiled.unionByName(dealt.filter("least is null").join(apart(nameless, "node"), "node").select("family", "i", "j", "node", "text"))

    def verify(table: pa.Table) -> pa.RecordBatch:
        node = table["node"].to_numpy()
        values, first = [], [np.zeros(1, np.int64)]
        for s in slices(table["text"]):
            v, f = shingles(*s.words(LOWER_VALUES), words)
            first.append(f[1:] + first[-1][-1])
            values.append(v)
        values, first = np.concatenate(values), np.concatenate(first)
        own = _signed(_set_hashes(values, first)) == node  # an id may have several texts
        if not own.all():
            keep = np.repeat(own, np.diff(first))
            values, first, node = values[keep], np.concatenate([[0], np.cumsum(np.diff(first)[own])]), node[own]
        found = spanning_links(values, first, num, den)
        return pa.RecordBatch.from_arrays([pa.array([node[a] for a, _ in found], pa.int64()), pa.array([node[b] for _, b in found], pa.int64())], names=["a", "b"])

    links = map_groups(tiled, ["family", "i", "j"], verify, "a long, b long")
    linked = components(links)
    joined = reps.join(linked, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    smallest = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    label = joined.filter("node != component").select("node", "component").join(smallest, "component").select("node", "component_id")
    alone = joined.filter("node = component").select("node", "component").join(smallest, "component").select("node", "component_id")
    return (
        signed.select("id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("node")).alias("node"))
        .join(label.unionAll(alone), "node", "left")
        .select(F.col("id").alias(id), "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
    )


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents at Jaccard 0.9 of 3-word shingles."""
    return jaccard_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, num=90, den=100)


OP1_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sets as (select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
         else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as s from words),
grams as (select doc_id, len(s) as n, unnest(s) as g from sets),
pairs as (select a.doc_id as x, b.doc_id as y, any_value(a.n) as m, any_value(b.n) as n, count(*) as c
          from grams a join grams b on a.g = b.g and a.doc_id < b.doc_id and 100 * a.n >= 90 * b.n and 100 * b.n >= 90 * a.n group by 1, 2),
links as (select x, y from pairs where 100 * c >= 90 * (m + n - c)),
both_ways as (select x, y from links union all select y, x from links),
reach as (select doc_id as x, doc_id as y from documents union select r.x, b.y from reach r join both_ways b on r.y = b.x)
select sets.doc_id, len(s)::bigint as n_shingles, (select min(y) from reach where reach.x = sets.doc_id) as component_id from sets
"""
