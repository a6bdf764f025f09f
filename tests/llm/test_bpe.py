import base64
import random

import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxelcohort.llm import bpe

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
VOCABULARY = bpe.Vocabulary(RANKS)
KNOWN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())}, special_tokens={})
SPLIT = regex.compile(public_tokenizers.PATTERN)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("abcdthe 's\n")), max_size=60), max_size=6))
def test_ids_equal_the_library_and_decode_back(texts):
    ids, start = bpe.encode_texts(texts, SPLIT, VOCABULARY)
    for k, t in enumerate(texts):
        own = ids[start[k] : start[k + 1]]
        assert own.tolist() == KNOWN.encode_ordinary(t)
        assert VOCABULARY.decode(own).tobytes() == t.encode()


def test_long_pieces_take_the_heap_with_equal_ids():
    rng = random.Random(5)
    for n in (1020, 1030, 5000):
        text = "".join(rng.choice("abcdeth") for _ in range(n))
        ids, _ = bpe.encode_texts([text], SPLIT, VOCABULARY)
        assert ids.tolist() == KNOWN.encode_ordinary(text)


def test_frames_keep_columns_and_define_nulls(spark):
    rows = [(1, "Hello  world, it's <|endoftext|>", 3), (1, "Hello  world, it's <|endoftext|>", 3), (None, None, None), (2, "", 4), (3, "日本   é" * 400, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded int").withColumn("ids", F.lit("clash"))
    out = bpe.decode(bpe.encode(df, RANKS, public_tokenizers.PATTERN), RANKS).collect()
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in out) == sorted((str(a), b or "") for a, b, _ in rows)
    for r in out:
        assert list(r["ids"]) == KNOWN.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
    assert bpe.encode(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_unknown_ids_are_refused(spark):
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(spark.createDataFrame([([7_000_000],)], "ids array<int>"), RANKS).collect()
    assert bytes(bpe.decode(spark.createDataFrame([(None,)], "ids array<int>"), RANKS).first()["decoded"]) == b""
