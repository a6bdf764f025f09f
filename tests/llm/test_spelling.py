import random
import re
import zlib
from collections import Counter
from itertools import product

import duckdb
import pytest
from pyspark.sql import functions as F

from voxelcohort.llm import spelling


def edits(a, b):
    """Levenshtein distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute_variants(counts, times=5):
    near = {w: [v for v in counts if abs(len(v) - len(w)) < 2 and edits(w, v) == 1] for w in counts}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= times * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] is not None else None))
    return sorted(out)


def brute_counts(rows):
    total = Counter()
    for id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if id is None else id}:{run}".encode())
            total[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


def variants(rng, n, letters, longest):
    """Words, and words one or two edits from others."""
    out = []
    while len(out) < n:
        w = list(rng.choice(out)) if out and rng.random() < 0.7 else [rng.choice(letters) for _ in range(rng.randrange(1, longest))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randrange(2)] = rng.choice(["", *letters])
        out.append("".join(w))
    return {w: rng.choice([5, 6, 30, 200, 2000]) for w in out}


@pytest.mark.parametrize("partitions, bucket", [((1, 7), 512), ((1, 3), 13), ((2, 4), 1), ((3, 1), 4), ((2, 2), 512)])
def test_near_words_equal_brute_force(spark, partitions, bucket):
    """Few letters make buckets of hundreds of anagrams."""
    rng = random.Random(bucket)
    counts = variants(rng, 400, "abé", 9) | variants(rng, 200, "abcdefgh", 12)
    df = spark.createDataFrame([*counts.items(), (None, 3)], "word string, n long").withColumn("kind", F.lit(0)).withColumn("root", F.lit("r"))
    got = spelling.spelling_variants(df, partitions=partitions, bucket_words=bucket).collect()
    assert sorted(tuple(r) for r in got) == brute_variants(counts)


def test_signatures_meet_within_distance_two():
    for scheme in (spelling.PartEnum(1, 7), spelling.PartEnum(2, 4), spelling.PartEnum(3, 1), spelling.PartEnum(1, 3)):
        words = ["".join(w) for w in product("abc", repeat=4)][::3] + ["aabbcc", "aabbccd", "", "z"]
        for a in words:
            for b in words:
                away = sum(((Counter(a) - Counter(b)) + (Counter(b) - Counter(a))).values())
                common = [x == y for x, y in zip(scheme.signatures(a), scheme.signatures(b))]
                assert away > 2 or any(common)
                assert scheme.first_common(a, b) == (common.index(True) if any(common) else -1)


def test_one_edit_and_deletions():
    rng = random.Random(1)
    for _ in range(3000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(6))) for _ in range(2))
        assert spelling.one_edit(a, b) == (edits(a, b) == 1)
        assert not spelling.one_edit(a, b) or spelling.deletions(a) & spelling.deletions(b)


def test_long_words_share_an_end():
    rng = random.Random(2)
    for n in (62, 63, 64, 65, 66, 500):
        for _ in range(200):
            a = [rng.choice("ab") for _ in range(n)]
            b, at = a[:], rng.randrange(n)
            b[at : at + rng.randrange(2)] = rng.choice(["", "a", "c"])
            a, b = "".join(a), "".join(b)
            assert not spelling.one_edit(a, b) or spelling.deletions(a) & spelling.deletions(b)
    assert len(spelling.deletions("ab" * 500_000)) == 2


def random_docs(rng, n):
    words = list(variants(rng, 60, "abcdefghé×ÿ", 10))
    return [(i if i % 17 else None, " ".join(rng.choice(words).title() + rng.choice(["", "'s", "1", "Āx", "İ", "\U0001f600"]) for _ in range(rng.randrange(80)))) for i in range(n)]


def test_counts_and_query_equal_brute_force_and_oracle(spark, tmp_path):
    rng = random.Random(12)
    rows = [*random_docs(rng, 300), (1, None), (2, ""), (3, "Longword " * 100_000), (3, "Longword " * 100_000), (4, "lonGwordà " * 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("w")).withColumn("n", F.lit(1))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    counts = brute_counts(rows)
    assert any(zlib.crc32(f"{i}:{w}".encode()) % 199 == 0 for i in range(300) for w in counts)
    got = sorted(tuple(r) for r in spelling.op12_spelling(spark, str(tmp_path)).collect())
    assert got == brute_variants(counts)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.execute(spelling.OP12_SQL).fetchall()) == got


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_variants(spelling.word_counts(docs)).count() == 0
