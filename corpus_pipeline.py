"""From raw documents to token ids: five stages, each on all that the one before kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next one's ``docs``. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelcohort.llm import bpe, jaccard, langid, mixing, shared_text
from voxelcohort.llm.graph import perhaps_in
from voxelcohort.session import cut_lineage, scratch_path, scratch_scope

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a letter go; a missing language is filled in by the likeliest.

    The network learns from the documents that name their language. Where none
    does, there is nothing to judge by. Its confidence removes nothing: it falls
    with the number of languages and where a text mixes some.
    """
    net = langid.train(docs)
    if net is None:
        return docs.filter(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    judged = langid.predict(docs.select(*COLUMNS), net)
    kept = judged.filter(F.col("lang_pred") != langid.UNDETERMINED)
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Jaccard join on five-word shingles at 0.8: of each group the document with the smallest id stays.

    A row that repeats id and text goes too. Rows without an id stay. Only rows
    whose id may be one of those that go or repeat are exchanged.
    """
    groups = jaccard.jaccard_groups(docs, words=5, num=8, den=10)
    extra = cut_lineage(groups.filter("component_id != doc_id").select("doc_id").distinct())
    hashed = F.xxhash64("text").alias("_h")
    again = docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id", hashed).count().filter("count > 1").select("doc_id")
    told = perhaps_in(docs.select(*COLUMNS), "doc_id", cut_lineage(extra.unionByName(again)))
    kept = told.filter("_perhaps").join(extra, "doc_id", "left_anti").select("*", hashed).dropDuplicates(["doc_id", "_h"])
    return kept.select(*COLUMNS).unionByName(told.filter("not _perhaps").select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup: words in 35-word passages that start elsewhere too are cut; a document left without words goes.

    Documents that lose nothing keep their text as it is.
    """
    marked = shared_text.mark_repeats(docs.select(*COLUMNS), window=35).filter("n_removed = 0 or n_removed < n_words")
    cut = marked.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text")))
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(dict(docs.dtypes)["n_chars"])).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mix sources: a document stands in the result as often as the mix takes it, to the nearest whole number."""
    plan = mixing.mix_sources(docs).groupBy("doc_id", "source", "size").agg(F.max("taken").alias("taken"))
    plan = plan.withColumn("copies", F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")).filter("copies > 0").withColumnsRenamed({"doc_id": "_id", "source": "_source", "size": "_size"})
    sized = docs.select(*COLUMNS, mixing.word_count(F.col("text")).alias("size"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size"))
    return sized.join(plan, same).withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE: the ids of every document, and whether decoding them gives the text back."""
    import public_tokenizers

    ranks = bpe.read_ranks(bpe.tokenizer_path(spark))
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), ranks, public_tokenizers.PATTERN, keep_text=False, round_trip="round_trip")
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("language_id", language),
    ("jaccard_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("mixing", mixture),
    ("bpe", token_ids),
]

#: A trained network and a tokenizer cannot be written in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        with scratch_scope(spark):  # what a stage stores on its way goes when its result is there
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
