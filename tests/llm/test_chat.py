import random

import duckdb
import pytest
from pyspark.sql import functions as F

from voxelcohort.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
ROWS = [
    (1, 0, "user", "How are you?\nThe Second line."),
    (1, 1, "bot", "On Monday the user wrote:\n> how   ARE you?\n\nFine, thanks."),
    (1, 2, "user", "> fine, thanks.\n> > How are you?\nGood."),
    (1, 3, "bot", ">>> deep\n>> The second line.\nUnsure"),
    (1, 4, "user", "no quote"),
    (1, 5, "bot", "> Good.\n> no quote\n> no quote"),
    (1, 6, "user", "> never said"),
    (2, 0, "user", "> How are you?"),
    (2, 0, "user", "twice"),
    (2, 1, "bot", "> twice"),
    (3, 0, "user", None),
    (3, 1, "bot", ""),
    (3, 2, "bot", "> > \r\n>\r\nonly blanks quoted"),
    (None, 1, "x", "> How are you?"),
    (4, None, "x", "How are you?"),
]


@pytest.fixture
def linked(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumn("thread", F.lit("old")).withColumn("passage", F.lit(1)).withColumn("level", F.lit(1))
    return chat.link_quotes(df)


def test_links_depth_and_own_text(linked):
    got = {(r["conv_id"], r["turn"]): r for r in linked.filter("conv_id = 1").collect()}
    assert [got[1, t]["reply_to"] for t in range(7)] == [None, 0, 1, 0, None, 4, None]
    assert [got[1, t]["thread"] for t in range(7)] == [0, 0, 0, 0, 4, 4, 6]
    assert [got[1, t]["depth"] for t in range(7)] == [0, 1, 2, 1, 0, 1, 0]
    assert [got[1, t]["own_text"] for t in (1, 2, 4, 6)] == ["Fine, thanks.", "Good.", "no quote", ""]
    assert got[1, 5]["quoted_lines"] == 3 and got[1, 5]["matched_lines"] == 3
    assert got[1, 6]["quoted_lines"] == 1 and got[1, 6]["matched_lines"] == 0


def test_all_rows_stay(linked):
    assert linked.count() == len(ROWS)
    rest = {(r["conv_id"], r["turn"], r["text"]): r for r in linked.collect()}
    assert rest[2, 1, "> twice"]["reply_to"] == 0
    assert rest[3, 0, None]["own_text"] is None and rest[3, 1, ""]["own_text"] == ""
    assert rest[None, 1, "> How are you?"]["reply_to"] is None


def query_and_oracle(spark, path, rows):
    """Rows of the registered query, which equal those of its SQL."""
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{path}/conversations.parquet/*.parquet'")
    got = chat.op10_quotes(spark, str(path)).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(con.execute(chat.OP10_SQL).fetchall(), key=str)
    return got


def test_oracle(spark, tmp_path):
    query_and_oracle(spark, tmp_path, ROWS)


def test_long_chain_and_empty_table(spark):
    rows = [(1, t, "u", f"> line {t - 1}\nline {t}") for t in range(40)]
    got = chat.link_quotes(spark.createDataFrame(rows, SCHEMA)).orderBy("turn").collect()
    assert [r["depth"] for r in got] == list(range(40)) and {r["thread"] for r in got} == {0}
    assert chat.link_quotes(spark.createDataFrame([], SCHEMA)).count() == 0


def runs_of(lines, quoted):
    """Runs of neighbouring non-blank lines that are quoted, or of those that are not."""
    out, now = [], []
    for line in [*lines, None]:
        if line is not None and line.startswith("> ") == quoted and line.removeprefix("> "):
            now.append(line.removeprefix("> "))
        elif now:
            out.append(tuple(now))
            now = []
    return out


def brute_parents(rows):
    """Per (conv, turn), from messages whose quoted lines all have one mark: the earlier turn that wrote most quoted characters as whole passages, then as lines, the later on a tie."""
    wrote, out = {}, {}
    for conv, turn, _, text in sorted(rows):
        lines = text.split("\n")
        quoted, blocks = [x[2:] for x in lines if x.startswith("> ")], set(runs_of(lines, True))
        scores = [(sum(len("".join(b)) for b in blocks & passages), sum(len(q) for q in quoted if q in said), t) for (c, t), (said, passages) in wrote.items() if c == conv]
        best = max((s for s in scores if s[1]), default=None)
        matched = sum(any(q in said for (c, _), (said, _) in wrote.items() if c == conv) for q in quoted)
        out[conv, turn] = (best and best[2], matched)
        wrote[conv, turn] = ({x for x in lines if not x.startswith("> ")}, set(runs_of(lines, False)))
    return out


def parents(spark, path, rows):
    return {(r["conv_id"], r["turn"]): (r["reply_to"], r["matched_lines"]) for r in query_and_oracle(spark, path, rows)}


def test_repeated_signature_and_resent_message(spark, tmp_path):
    sign = "-" * 60
    rows = [(1, 0, "u", f"a long question\n{sign}"), (1, 1, "b", "what?"), (1, 2, "u", f"yes.\n{sign}"), (1, 3, "b", f"> yes.\n> {sign}\nfine")]
    rows += [(2, 0, "u", "is anyone here?"), (2, 1, "u", "is anyone here?"), (2, 2, "b", "> is anyone here?\nme"), (2, 3, "u", "is anyone here?")]
    # both lines stand in turn 1 too, but only turn 0 wrote them as one passage
    rows += [(3, 0, "u", "first line\nsecond line\n\nmore"), (3, 1, "u", "second line\n\nfirst line"), (3, 2, "b", "> first line\n> second line\nyes")]
    got = parents(spark, tmp_path, rows)
    assert got == brute_parents(rows)
    assert got[1, 3] == (2, 2) and got[2, 2] == (1, 1) and got[3, 2] == (0, 2)


def test_frequent_lines_equal_brute_force(spark, tmp_path):
    rng = random.Random(4)
    lines = ["hello", "best wishes, anna", "sent from my phone", *(f"line {i}" for i in range(30))]
    rows = []
    for conv in range(6):
        for turn in range(25):
            own = rng.sample(lines[:3], rng.randrange(3)) + rng.sample(lines[3:], rng.randrange(3))
            rows.append((conv, turn, "u", "\n".join(["> " + rng.choice(lines) for _ in range(rng.randrange(4))] + own)))
    assert parents(spark, tmp_path, rows) == brute_parents(rows)


def test_repeated_rows_and_very_long_messages(spark, tmp_path):
    long = "\n".join(f"line {i} of a long message" for i in range(20_000))
    rows = [(1, 0, "u", long), (1, 1, "b", "> " + long.replace("\n", "\n> ") + "\nyes"), (1, 1, "b", "> " + long.replace("\n", "\n> ") + "\nyes"), (1, 2, "u", "> yes"), (1, 2, "u", None)]
    got = parents(spark, tmp_path, rows)
    assert got[1, 1] == (0, 40_000) and got[1, 2] == (1, 1)
