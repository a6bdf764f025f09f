"""Exact dedup by an extendible-hash index of texts on shared files; DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelcohort.session import cut_lineage

from .graph import apart

#: A bucket above so many bytes of distinct texts is overfull.
BUCKET_BYTES = 1 << 26
KEY_BITS = 64


def one_blank(text: Column) -> Column:
    """Each run of ``[\\x20\\x09-\\x0D]`` as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _prefix(key: Column, depth: int) -> Column:
    """The first ``depth`` bits of a key."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def grow_directory(keys: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Buckets of an extendible hash: ``(key long, bytes long)`` in, ``(depth, prefix, bucket, n_keys, bytes)`` out.

    ``key`` is distinct. The directory starts with a slot for each ``bucket_bytes``
    of all texts and doubles while a bucket is overfull: only that bucket is
    dealt again, by one bit more. A bucket with a single key cannot be split and keeps
    its chain. ``bucket`` is the first key of the bucket's range, so ranges of
    buckets are ranges of keys. Prefixes without keys have no bucket. An empty
    table gives none.
    """
    total = keys.agg(F.sum("bytes")).first()[0] or 0
    depth = max(0, math.ceil(math.log2(max(1, total / bucket_bytes))))
    counts = [F.count(F.lit(1)).alias("n_keys"), F.sum("bytes").alias("bytes")]

    def level(frame: DataFrame, depth: int) -> DataFrame:
        cells = frame.groupBy(_prefix(F.col("key"), depth).alias("prefix")).agg(*counts)
        return cut_lineage(cells.withColumn("depth", F.lit(depth)).withColumn("full", (F.col("bytes") > bucket_bytes) & (F.col("n_keys") > 1)))

    now, settled = level(keys, depth), []
    while True:
        settled.append(now.filter("not full"))
        full = now.filter("full").select(F.col("prefix").alias("_prefix"))
        if depth == 64 or full.isEmpty():
            break
        keys = keys.join(full, _prefix(F.col("key"), depth) == F.col("_prefix"), "left_semi")
        depth += 1
        now = level(keys, depth)
    leaves = settled[0]
    for more in settled[1:]:
        leaves = leaves.unionByName(more)
    first = F.when(F.col("depth") > 0, F.expr("shiftleft(prefix, 64 - depth)")).otherwise(F.lit(-(1 << 63)))
    return cut_lineage(leaves.select("depth", "prefix", first.alias("bucket"), "n_keys", "bytes"))


def bucket_of(keys: DataFrame, directory: DataFrame) -> DataFrame:
    """Add the ``bucket`` of every key; each is looked up once for every depth that the directory has."""
    depths = sorted(r[0] for r in directory.select("depth").distinct().collect())  # 65 at most
    slots = F.array(*[F.struct(F.lit(d).alias("depth"), _prefix(F.col("key"), d).alias("prefix")) for d in depths or [0]])
    asked = keys.withColumn("_slot", F.explode(slots)).withColumn("depth", F.col("_slot.depth")).withColumn("prefix", F.col("_slot.prefix"))
    return asked.join(directory.select("depth", "prefix", "bucket"), ["depth", "prefix"]).drop("_slot", "depth", "prefix")


def build_index(keyed: DataFrame, directory: DataFrame) -> DataFrame:
    """The index as a stored table: ``(bucket, key, link, chain, text_sha256, keep_id, group_size)``.

    ``keyed`` has ``(id, key, norm)``. Texts meet by key and by their bytes, which
    Spark combines in every task before they travel, so thousands of copies are one
    row a task. Owner tasks then take ranges of buckets: different texts that share a
    key are its chain of ``chain`` links, numbered by ``link``.
    """
    entries = keyed.groupBy("key", "norm").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    entries = entries.select("key", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")
    owned = bucket_of(entries, directory).repartitionByRange("bucket", "key")
    key = Window.partitionBy("bucket", "key")
    linked = owned.withColumn("link", F.row_number().over(key.orderBy(F.col("keep_id").asc_nulls_last(), "text_sha256")))
    return cut_lineage(linked.withColumn("chain", F.count(F.lit(1)).over(key)))


def exact_groups(df: DataFrame, id: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES, key_bits: int = KEY_BITS) -> DataFrame:
    """Groups of texts that are equal when every run of ``[\\x20\\x09-\\x0D]`` is one space.

    Returns ``(id, keep_id, group_size, kept, text_sha256)``, one row for each input
    row: ``keep_id`` is the smallest id of the group, ``kept`` whether it is the row's
    own. Null texts count as empty; a null id keeps nothing, but in a group without
    any id (``keep_id`` null) all rows are kept. Repeated rows are members like
    others, and each with the smallest id is kept. Other columns are not read. An empty
    table gives none.

    Method. Texts have ``key_bits``-bit keys. A directory over key prefixes doubles until no
    bucket holds more than ``bucket_bytes`` of texts, as ``grow_directory``
    says. Texts are compared by their bytes under their key, and owner tasks of key ranges chain those
    that collide; the index is a table in the shared folder. Rows, stored with
    their key and digest, then read the group from the index by key, in a join whose hot
    keys Spark splits; where a key has a chain, by the bytes of the text again.
    """
    norm = one_blank(F.col(text))
    key = F.xxhash64("norm").bitwiseAND(F.lit(-(1 << (64 - key_bits)) if key_bits else 0))
    keyed = df.select(F.col(id).alias("id"), norm.alias("norm")).withColumn("key", key)
    rows = cut_lineage(keyed.select("id", "key", F.octet_length("norm").cast("long").alias("bytes"), F.sha2("norm", 256).alias("text_sha256")))
    directory = grow_directory(cut_lineage(rows.groupBy("key").agg(F.max("bytes").alias("bytes"))), bucket_bytes)
    index = build_index(keyed, directory)
    single = index.filter("chain = 1").select("key", "keep_id", "group_size")
    found = rows.join(apart(single, "key"), "key").select("id", "keep_id", "group_size", "text_sha256")
    chains = index.filter("chain > 1").select(F.col("key").alias("_key")).distinct()
    if not chains.isEmpty():
        texts = keyed.join(chains, F.col("key") == F.col("_key"), "left_semi")
        heads = texts.groupBy(F.col("key").alias("_key"), F.col("norm").alias("_norm")).agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        again = texts.join(cut_lineage(heads), (F.col("key") == F.col("_key")) & (F.col("norm") == F.col("_norm")))
        found = found.unionByName(again.select("id", "keep_id", "group_size", F.sha2("norm", 256).alias("text_sha256")))
    kept = F.coalesce(F.col("id") == F.col("keep_id"), F.col("keep_id").isNull())
    return found.select(F.col("id").alias(id), "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def op13_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies of all documents."""
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
with docs as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents),
groups as (select norm, min(doc_id) as keep_id, count(*)::bigint as group_size from docs group by norm)
select d.doc_id, g.keep_id, g.group_size, coalesce(d.doc_id = g.keep_id, g.keep_id is null) as kept, sha256(d.norm) as text_sha256
from docs d join groups g on d.norm = g.norm
"""
