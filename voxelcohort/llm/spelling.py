"""Spelling variants: near words found by PartEnum signatures of their letters, and the forms they lead to."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelcohort.session import cut_lineage

from .text import small_batches

LEAST_LETTERS, LEAST_COUNT, TIMES = 6, 5, 5
#: First- and second-level partitions of the letters: 21 signatures, each of five sevenths of them.
PARTITIONS = (1, 7)
DISTANCE = 2
#: Buckets above so many words are dealt by the words' deletions too.
BUCKET_WORDS = 512
#: Longer words are told apart by their ends: deletions would take the square of the length.
LONG = 64

#: Latin-1 bytes: letters A-Z as a-z, the other word letters as they are, all else as a blank.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def runs(text: str) -> list[bytes]:
    """Maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` in lower case (A-Z only), as Latin-1."""
    return text.encode("latin-1", "replace").translate(LETTERS).split()


def misspelt(id: str, word: bytes, every: int) -> bytes:
    """The word, or without one letter where ``every`` divides the crc32 of ``id:word`` in UTF-8."""
    h = zlib.crc32(f"{id}:{word.decode('latin-1')}".encode())
    return word if h % every else word[: h % len(word)] + word[h % len(word) + 1 :]


def word_counts(df: DataFrame, id: str = "doc_id", text: str = "text", least_letters: int = LEAST_LETTERS, every: int | None = None) -> DataFrame:
    """``(word, n)`` of all words of ``least_letters`` or more in all whole texts, spelt as in ``misspelt`` if ``every`` is given.

    Null texts have no words; a null id counts as empty. Every batch of texts is
    added up before its words are exchanged.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter = Counter()
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                value = value.as_py()
                if not value:
                    continue
                own = Counter(w for w in runs(value) if len(w) >= least_letters)
                if every is None:
                    total.update(own)
                    continue
                start = zlib.crc32(f"{key}:".encode())
                for word, n in own.items():
                    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
                    total[word if h % every else misspelt(key, word, every)] += n
            kept = [(w.decode("latin-1"), n) for w, n in total.items() if len(w) >= least_letters]
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*kept)], names=["word", "n"])

    small_batches(df.sparkSession)
    rows = df.select(F.coalesce(F.col(id).cast("string"), F.lit("")).alias("id"), text)
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class PartEnum:
    """Signatures of letter multisets: vectors of 0 and 1 with a place for the first, second, ... of each letter.

    Two words at one edit differ in two places at most: one for a letter more or
    less, two for a letter replaced. Places are dealt into ``first`` partitions of ``second`` parts each.
    Among the first-level partitions one differs in at most
    ``(distance + 1) / first - 1`` places (rounded up), so in no more of its parts, and
    the vectors agree on all the others: a signature is one choice of parts to leave
    out, with the vector on those that stay (Arasu, Ganti and Kaushik 2006).
    """

    def __init__(self, first: int, second: int, distance: int = DISTANCE):
        out = -(-(distance + 1) // first) - 1
        if second <= out:
            raise ValueError("too few second-level parts")
        self.parts = first * second
        self.kinds = [tuple(p * second + s for s in kept) for p in range(first) for kept in combinations(range(second), second - out)]

    def contents(self, word: str) -> list[str]:
        """The places of a word that are set, by part."""
        found: list[list[str]] = [[] for _ in range(self.parts)]
        for letter, n in sorted(Counter(word).items()):
            for k in range(n):
                found[_part(letter, k, self.parts)].append(f"{letter}{k}")
        return ["".join(f) for f in found]

    def signatures(self, word: str) -> list[int]:
        own = self.contents(word)
        return [hash_text(f"{kind}|" + "|".join(own[p] for p in kept)) for kind, kept in enumerate(self.kinds)]

    def first_common(self, a: str, b: str) -> int:
        """The first signature that two words share, or -1."""
        same = [x == y for x, y in zip(self.contents(a), self.contents(b))]
        return next((kind for kind, kept in enumerate(self.kinds) if all(same[p] for p in kept)), -1)


@lru_cache(maxsize=1 << 14)
def _part(letter: str, k: int, parts: int) -> int:
    return zlib.crc32(f"{letter}/{k}".encode()) % parts


def hash_text(text: str) -> int:
    """A signed 64-bit number of a text; words are compared afterwards, so collisions cost time only."""
    data = text.encode()
    return ((zlib.crc32(data) << 32) | zlib.crc32(data[::-1], 0x5A17)) - (1 << 63)


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced letter makes one word of the other."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, x in enumerate(a) if x != b[i]), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def deletions(word: str) -> set[str]:
    """The word itself and the word without each one of its letters; words at one edit share one of these.

    Words of LONG letters or more have their first and their last letters instead,
    which one edit cannot both touch; those of just LONG letters have both kinds.
    """
    ends = {"<" + word[: LONG // 2], word[len(word) - LONG // 2 :] + ">"} if len(word) >= LONG else set()
    return ends if len(word) > LONG else {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))} | ends


def _near_in(words: list[str]) -> Iterator[tuple[str, str]]:
    """Pairs of a bucket at one edit. Small buckets are compared pair by pair, others by their deletions."""
    if len(words) <= 12:
        yield from ((a, b) for a, b in combinations(words, 2) if abs(len(a) - len(b)) < 2 and one_edit(a, b))
        return
    by: dict[str, list[str]] = {}
    for w in words:
        for d in deletions(w):
            by.setdefault(d, []).append(w)
    for d, own in by.items():
        for a, b in combinations(own, 2):
            if one_edit(a, b) and d == min(deletions(a) & deletions(b)):
                yield a, b


def _pairs(scheme: PartEnum, keys: tuple[str, ...], dealt: bool):
    """Near pairs of a partition sorted by ``keys``; a pair is given by the first bucket that it shares only."""

    def found(key: tuple, rows: list[tuple[str, int]]) -> list[tuple[str, str, int]]:
        n = dict(rows)
        out = []
        for a, b in combinations(n, 2) if dealt else _near_in(list(n)):
            if dealt and not (one_edit(a, b) and key[2] == min(map(hash_text, deletions(a) & deletions(b)))):
                continue
            if scheme.first_common(a, b) == key[0]:
                out += [(a, b, n[b]), (b, a, n[a])]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            out = []
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (*keys, "word", "n")]
            for *key, word, n in zip(*columns):
                if key != now:
                    if len(held) > 1:
                        out += found(tuple(now), held)
                    now, held = key, []
                held.append((word, n))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*out)], names=["word", "other", "other_n"])
        if len(held) > 1 and (out := found(tuple(now), held)):
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*out)], names=["word", "other", "other_n"])

    return run


PAIR = "word string, other string, other_n long"


def near_words(words: DataFrame, partitions: tuple[int, int] = PARTITIONS, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """All pairs ``(word, other, other_n)`` of distinct words at one edit, in both directions, from ``(word, n)``.

    Words meet where they share a signature and are compared there. A
    bucket above ``bucket_words`` words, say of anagrams over few letters, is dealt by
    signature and deletion instead: words at one edit share a deletion, and the
    words that share one are some dozens for each letter of the word, however many there are.
    """
    scheme = PartEnum(*partitions)

    def sign(batches):
        for batch in batches:
            rows = [(kind, s, w, n) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for kind, s in enumerate(scheme.signatures(w))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*rows)], names=["kind", "signature", "word", "n"])

    def deal(batches):
        for batch in batches:
            rows = [(k, s, hash_text(d), w, n) for k, s, w, n in zip(*(c.to_pylist() for c in batch.columns)) for d in deletions(w)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*rows)], names=["kind", "signature", "deletion", "word", "n"])

    signed = words.select("word", "n").mapInArrow(sign, "kind long, signature long, word string, n long")
    sizes = signed.groupBy("kind", "signature").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    sizes = cut_lineage(sizes.withColumn("large", F.col("_n") > bucket_words).drop("_n"))
    keys = ["kind", "signature"]
    small = signed.join(sizes.filter("not large").select(*keys), keys, "left_semi")
    out = small.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_pairs(scheme, tuple(keys), False), PAIR)
    large = sizes.filter("large").select(*keys)
    if not large.isEmpty():
        keys = [*keys, "deletion"]
        dealt = signed.join(large, keys[:2], "left_semi").select("kind", "signature", "word", "n").mapInArrow(deal, "kind long, signature long, deletion long, word string, n long")
        out = out.unionByName(dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_pairs(scheme, tuple(keys), True), PAIR))
    return out


def _last(forms: DataFrame) -> DataFrame:
    """``(word, root)`` from ``(word, form)``: the end of each chain, by doubling; forms grow in number, so no chain is a circle."""
    now = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        above = now.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        joined = now.join(above, F.col("root") == F.col("_word"), "left")
        now = cut_lineage(joined.select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")), instead_of=now)
        if now.filter("moved").isEmpty():
            return now.drop("moved")


def spelling_variants(words: DataFrame, times: int = TIMES, partitions: tuple[int, int] = PARTITIONS, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """Variants of words: ``(word, n)`` in, ``(word, form, root, n, n_near, form_n)`` out.

    Two words are near at exactly one inserted, deleted or replaced letter.
    ``form`` is the near word of largest ``n`` (ties: smallest in code-point order) if its
    ``n`` is at least ``times`` the word's, else null; ``root`` follows forms to the last,
    the word itself without a form; ``n_near`` counts near words. Rows that
    repeat a word are added up; null words are left out; an empty table gives none;
    other columns are not read. Words of any length may come, an empty one too.
    """
    words = cut_lineage(words.filter(F.col("word").isNotNull()).groupBy("word").agg(F.sum("n").cast("long").alias("n")))
    pairs = near_words(words, partitions, bucket_words)
    best = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word"))).alias("_best"))
    joined = words.join(best.withColumnRenamed("word", "_word"), F.col("word") == F.col("_word"), "left")
    enough = -F.col("_best.n") >= F.col("n") * times
    formed = cut_lineage(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("_best.word")).alias("form"), F.when(enough, -F.col("_best.n")).alias("form_n")))
    roots = _last(formed.filter("form is not null")).withColumnRenamed("word", "_word")
    rooted = formed.join(roots, F.col("word") == F.col("_word"), "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of all words of six letters or more that occur five times or more, some misspelt on purpose."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spelling_variants(word_counts(docs, every=199).filter(F.col("n") >= LEAST_COUNT))


OP12_SQL = r"""
with recursive crc_table as (select list(v order by i) as t from (select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v from range(256) r(i))),
runs as (select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents),
distinct_runs as (select doc_id, run, count(*) as n, hex(encode(coalesce(doc_id::varchar, '') || ':' || run)) as digits from runs where length(run) >= 6 group by 1, 2),
hashed as (select run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(digits) // 2), lambda i: ('0x' || digits[2 * i + 1 : 2 * i + 2])::bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) as h from distinct_runs, crc_table),
spelt as (select case when h % 199 = 0 then run[1 : h % length(run)] || run[h % length(run) + 2 :] else run end as word, n from hashed),
words as (select word, sum(n)::bigint as n from spelt where length(word) >= 6 group by word having sum(n) >= 5),
cut as (select word, n, i, word[1 : i - 1] || word[i + 1 :] as rest from (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
pairs as (select a.word, b.word as other, b.n as other_n from cut a join cut b on a.rest = b.rest and a.i = b.i and a.word <> b.word and length(a.word) = length(b.word)
          union select a.word, b.word, b.n from words a join cut b on a.word = b.rest union select b.word, a.word, a.n from words a join cut b on a.word = b.rest),
ranked as (select *, row_number() over (partition by word order by other_n desc, other) as r, count(*) over (partition by word) as n_near from pairs),
formed as (select w.word, w.n, coalesce(p.n_near, 0)::bigint as n_near, case when p.other_n >= 5 * w.n then p.other end as form, case when p.other_n >= 5 * w.n then p.other_n end as form_n
           from words w left join ranked p on p.word = w.word and p.r = 1),
up as (select word, form as root, 1 as depth from formed where form is not null union all
       select u.word, f.form, u.depth + 1 from up u join formed f on f.word = u.root where f.form is not null),
ends as (select word, arg_max(root, depth) as root from up group by word)
select f.word, f.form, coalesce(e.root, f.word) as root, f.n, f.n_near, f.form_n from formed f left join ends e on e.word = f.word
"""
