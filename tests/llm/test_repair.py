import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from voxelcohort.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"


def faults_of(rows):
    """Fault of each (role, text) in order."""
    out, seen = [], set()
    for role, text in rows:
        tail = text.rstrip(" \t\n\x0b\f\r")
        out.append("blank" if not tail else "duplicate" if (role, text) in seen else "truncated" if tail[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def all_repairs(rows):
    """Every result of up to three insertions: (cost, audit, repaired lines), straight from the definition."""
    faults = faults_of(rows)
    choices = []
    for (role, text), fault in zip(rows, faults):
        own = [(2, "D", None)]
        if fault in ("", "truncated"):
            more = 5 if fault else 0
            own += [(more, "K", (role, text)), (1 + more, "R", ("user", text)), (1 + more, "R", ("assistant", text))]
        choices.append(own)
    gaps = [c for n in range(3) for c in itertools.product(("user", "assistant"), repeat=n)]
    for picked in itertools.product(*choices):
        for holes in itertools.product(gaps, repeat=len(rows) + 1):
            if sum(map(len, holes)) > 3:
                continue
            lines, cost, audit = [], 0, ""
            for k, hole in enumerate(holes):
                lines += [(r, "") for r in hole]
                cost, audit = cost + 5 * len(hole), audit + "I" * len(hole)
                if k < len(rows):
                    cost, audit = cost + picked[k][0], audit + picked[k][1]
                    lines += [picked[k][2]] if picked[k][2] else []
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in lines)):
                yield cost, audit, lines


def digest(lines):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()


TEXTS = ["Hello.", "Cut off", " \n", "Why?", "", "Yes! \n"]


def random_rows(rng, n):
    return [(rng.choice(["system", "user", "assistant", "assistant", "user", "tool", ""]), rng.choice(TEXTS) if rng.random() < 0.5 else f"text {rng.random()}.") for _ in range(n)]


def test_cheapest_repair_equals_enumeration(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for conv in range(40):
        own = sorted(random_rows(rng, conv % 4))
        rows += [(conv, 5, r, t) for r, t in own]
        if own:
            cost, audit, lines = min(all_repairs(own), key=lambda x: x[:2])
            want[conv] = (cost, audit, digest(lines))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("fault", F.lit("x")).withColumn("part", F.lit(9))
    got = {r["conv_id"]: (r["cost"], r["audit"], r["repaired_sha256"]) for r in repair.summary(repair.repair_conversations(df)).collect()}
    assert got == want


def plain_cyk(kinds):
    """Cells of every span with every split."""
    n, cell = len(kinds), {}
    for i, k in enumerate(kinds):
        cell[i, i + 1] = repair.LEAVES[k]
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            options = [repair.join_spans(cell[i, m], cell[m, i + length]) for m in range(i + 1, i + length)]
            cell[i, i + length] = tuple(min((o[e] for o in options if o[e] is not None), default=None) for e in range(len(options[0])))
    return cell[0, n]


def test_one_split_gives_what_all_splits_give():
    rng = random.Random(5)
    for n in range(1, 15):
        kinds = "".join(rng.choice(sorted(repair.LEAVES)) for _ in range(n))
        assert repair.parse(kinds) == plain_cyk(kinds)


@pytest.mark.parametrize("part_rows", [1, 3, 40])
def test_long_conversations_in_parts(spark, part_rows):
    rng = random.Random(part_rows)
    rows = [(c, rng.choice([None, *range(60)]), r, t) for c in (1, None, 7) for r, t in random_rows(rng, 130 if c != 7 else 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = repair.summary(repair.repair_conversations(df)).collect()
    parts = repair.repair_conversations(df, part_rows=part_rows)
    assert {r["conv_id"]: r["parts"] for r in parts.collect()}[1] == -(-130 // part_rows)
    assert sorted(map(str, repair.summary(parts).collect())) == sorted(map(str, whole))


def test_messages_are_the_result(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "user", "Hi."), (1, 3, "assistant", ""), (1, 4, "tool", "Hello!")]
    (r,) = repair.repair_conversations(spark.createDataFrame(rows, SCHEMA)).collect()
    assert (r["audit"], r["cost"], r["blank"], r["duplicate"], r["truncated"], r["illegal"]) == ("KKDDR", 5, 1, 1, 0, 2)
    assert [(m["edit"], m["role"], m["text"]) for m in r["messages"]][-1] == ("R", "assistant", "Hello!")


ODD = [(1, None, None, None), (1, 2, "user", "a"), (1, 2, "user", "a"), (None, 1, "user", "Null."), (None, None, "x", "y" * 600_000 + "."), (2, 3, "", "z."), (2, 9, "", "q?"), (3, None, "user", "v.")]


@pytest.fixture
def odd_dir(spark, tmp_path):
    rng = random.Random(8)
    rows = ODD + [(100 + c, t if rng.random() < 0.9 else None, *random_rows(rng, 1)[0]) for c in range(150) for t in range(rng.randrange(1, 9))]
    # one conversation that the damage drops whole
    rows += [(c, 0, "user", "gone.") for c in range(1000, 1200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    spark.createDataFrame(rows, SCHEMA).withColumn("_d", F.lit(1)).withColumn("ck", F.lit("c")).write.parquet(str(tmp_path / "conversations.parquet"))
    return str(tmp_path), rows


def test_query_equals_oracle(spark, odd_dir):
    path, rows = odd_dir
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{path}/conversations.parquet/*.parquet'")
    want = sorted(map(str, con.execute(repair.OP11_SQL).fetchall()))
    got = [tuple(r) for r in repair.op11_repair(spark, path).collect()]
    assert sorted(map(str, got)) == want
    assert len(got) == len({r[0] for r in rows})
    empty = [r for r in got if r[0] is not None and r[0] >= 1000]
    assert empty and all(r[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in empty)


def test_damage(spark):
    rows = [(c, 1, "assistant", "A. B!") for c in range(100)]
    got = {}
    for r in repair.damaged(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    for c in range(100):
        d = zlib.crc32(f"{c}:1".encode()) % 20
        plain = ("assistant", "A. B!")
        assert got.get(c, []) == {0: [], 1: [("assistant", "")], 2: [("assistant", "A B")], 3: [plain, plain], 4: [("user", "A. B!")]}.get(d, [plain])


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    assert repair.op11_repair(spark, str(tmp_path)).count() == 0
