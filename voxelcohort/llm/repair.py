"""Conversation structure repair by weighted interval parsing with a repair grammar."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelcohort.operators.skew import hot_groups, in_order
from voxelcohort.session import cut_lineage

from .batches import map_groups

#: A conversation above so many rows is parsed in parts of that many.
PART_ROWS = 2048
#: So many neighbouring spans are joined in a round.
FAN_IN = 16

# The target (s?(ua)+)? as an automaton: nothing yet, after s, after u, after a; the first and the last may end it.
STATES = 4
STEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
ENDS = (0, 3)
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
ROLES = {"u": "user", "a": "assistant"}
BLANKS = " \t\n\x0b\f\r"

#: Kinds of rows: initial s, u, a or another; then whether the row is whole, truncated, or has to go.
KINDS = {i + f: chr(97 + n) for n, (i, f) in enumerate((i, f) for i in "sua-" for f in ("", "truncated", "gone"))}

Cell = tuple  # entry STATES * p + q: None, or the least (cost, audit) of edits that lead from state p to q


def join_spans(left: Cell, right: Cell) -> Cell:
    """The cell of two neighbouring spans: the production ``pq -> pr rq`` for every p, r and q.

    Edits of one span with equal cost are never prefixes of each other, so the
    least audit of a whole begins with the least of its part.
    """
    out: list = [None] * (STATES * STATES)
    for p in range(STATES):
        for r in range(STATES):
            x = left[STATES * p + r]
            if x is None:
                continue
            for q in range(STATES):
                y = right[STATES * r + q]
                if y is None:
                    continue
                k, cost = STATES * p + q, x[0] + y[0]
                now = out[k]
                if now is None or cost < now[0] or (cost == now[0] and x[1] + y[1] < now[1]):
                    out[k] = (cost, x[1] + y[1])
    return tuple(out)


_short = lru_cache(maxsize=1 << 16)(join_spans)


def _cell(entries: Iterable[tuple[int, int, int, str]]) -> Cell:
    out: list = [None] * (STATES * STATES)
    for p, q, cost, audit in entries:
        k = STATES * p + q
        out[k] = min(out[k] or (cost, audit), (cost, audit))
    return tuple(out)


NOTHING = _cell((p, p, 0, "") for p in range(STATES))


def _insertions() -> Cell:
    """Closure of inserted rows: the cheapest insertions from each state to each other."""
    one = _cell([*((p, p, 0, "") for p in range(STATES)), *((p, q, INSERT, "I") for c in ROLES for p, q in STEPS[c].items())])
    out = one
    while (more := join_spans(out, one)) != out:
        out = more
    return out


def _leaf(initial: str, fault: str) -> Cell:
    """The cell of one row, with insertions before and after it."""
    edits = [(p, p, DELETE, "D") for p in range(STATES)]
    if fault != "gone":
        more = TRUNCATED if fault == "truncated" else 0
        edits += [(p, q, more, "K") for p, q in STEPS.get(initial, {}).items()]
        edits += [(p, q, REROLE + more, "R") for c in ROLES for p, q in STEPS[c].items()]
    around = _insertions()
    return join_spans(join_spans(around, _cell(edits)), around)


LEAVES = {KINDS[i + f]: _leaf(i, f) for i in "sua-" for f in ("", "truncated", "gone")}


def join_all(cells: Sequence[Cell], short: int = 0) -> Cell:
    """One cell for a run of neighbouring spans, bottom-up: every round joins pairs, so spans double."""
    cells = list(cells) or [_insertions()]
    length = 1
    while len(cells) > 1:
        length *= 2
        join = _short if length <= short else join_spans
        cells = [join(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0]


def parse(kinds: str) -> Cell:
    """Cell of the whole span of rows of these kinds."""
    return join_all([LEAVES[k] for k in kinds], short=16)


def cheapest(cell: Cell, rows: int) -> tuple[int, str]:
    """Cost and audit of the cheapest repair of a whole conversation; nothing to do without rows."""
    return min(cell[q] for q in ENDS if cell[q] is not None) if rows else (0, "")


def _kind(role: str, fault: str) -> str:
    first = role[:1]
    return KINDS[(first if first in STEPS else "-") + ("gone" if fault in ("blank", "duplicate") else fault)]


def apply_edits(audit: str, state: int, rows: Sequence[tuple]) -> tuple[list[tuple], int]:
    """Messages ``(edit, fault, turn, role, text)`` of rows ``(fault, turn, role, text)``, deleted ones too, and what they cost."""
    out, cost, at = [], 0, 0
    for edit in audit:
        need = "a" if state == 2 else "u"
        if edit == "I":
            out.append((edit, "", None, ROLES[need], ""))
            cost, state = cost + INSERT, STEPS[need][state]
            continue
        fault, turn, role, text = rows[at]
        at += 1
        if edit == "D":
            cost += DELETE
        else:
            cost += (REROLE if edit == "R" else 0) + (TRUNCATED if fault == "truncated" else 0)
            role = ROLES[need] if edit == "R" else role
            state = STEPS[role[0]][state]
        out.append((edit, fault, turn, role, text))
    return out, cost


MESSAGE = pa.struct([("edit", pa.string()), ("fault", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
PARTS = "ck string, part long, parts long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, messages array<struct<edit:string,fault:string,turn:bigint,role:string,text:string>>"
_TYPES = [pa.string(), *[pa.int64()] * 7, pa.string(), pa.list_(MESSAGE)]
_NAMES = [c.split()[0] for c in PARTS.split(", ")]


def _part(ck: str, part: int, parts: int, audit: str, state: int, before: str | None, rows: list[tuple]) -> tuple:
    """One row of the result; ``before`` is the role of the row before the part, null at the beginning."""
    messages, cost = apply_edits(audit, state, rows)
    found = [r[0] for r in rows]
    initials = [x[2][:1] for x in rows] if before is None else [before[:1], *(x[2][:1] for x in rows)]
    illegal = sum(x + y not in ("su", "ua", "au") or not x for x, y in zip(initials, initials[1:]))
    return ck, part, parts, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, audit, messages


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = []
    for values, kind in zip(zip(*rows), _TYPES):
        if kind == _TYPES[-1]:
            values = [[dict(zip(MESSAGE.names, m)) for m in v] for v in values]
        columns.append(pa.array(values, kind))
    return pa.RecordBatch.from_arrays(columns, names=_NAMES)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations of a partition sorted by (ck, turn, role, text), each judged, parsed and repaired at once."""

    def repair(ck: str, rows: list[tuple]) -> tuple:
        seen, judged = set(), []
        for fault, turn, role, text in rows:
            if fault != "blank" and (role, text) in seen:
                fault = "duplicate"
            seen.add((role, text))
            judged.append((fault, turn, role, text))
        cell = parse("".join(_kind(r[2], r[0]) for r in judged))
        return _part(ck, 0, 1, cheapest(cell, len(rows))[1], 0, None, judged)

    key, held = None, []
    for batch in batches:
        done = []
        columns = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("ck", "fault", "turn", "role", "text"))
        for ck, *row in zip(*columns):
            if ck != key:
                if held:
                    done.append(repair(key, held))
                key, held = ck, []
            held.append(tuple(row))
        if done:
            yield _batch(done)
    if held:
        yield _batch([repair(key, held)])


def _span_table(rows: list[tuple[str, int, str, Cell]]) -> pa.RecordBatch:
    ck, part, kinds, cells = zip(*rows)
    costs = [[None if e is None else e[0] for e in c] for c in cells]
    audits = [[None if e is None else e[1] for e in c] for c in cells]
    columns = [pa.array(ck), pa.array(part, pa.int64()), pa.array(kinds), pa.array(costs, pa.list_(pa.int64())), pa.array(audits, pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(columns, names=["ck", "part", "kinds", "costs", "audits"])


SPAN = "ck string, part long, kinds string, costs array<bigint>, audits array<string>"


def _parse_part(table: pa.Table) -> pa.RecordBatch:
    rows = sorted(zip(*(table[c].to_pylist() for c in ("place", "role", "fault"))))
    kinds = "".join(_kind(role, fault) for _, role, fault in rows)
    return _span_table([(table["ck"][0].as_py(), table["part"][0].as_py(), kinds, parse(kinds))])


def _join_parts(table: pa.Table) -> pa.RecordBatch:
    rows = sorted(zip(*(table[c].to_pylist() for c in ("part", "kinds", "costs", "audits"))))
    cells = [tuple(None if c is None else (c, a) for c, a in zip(costs, audits)) for _, _, costs, audits in rows]
    return _span_table([(table["ck"][0].as_py(), table["up"][0].as_py(), "".join(r[1] for r in rows), join_all(cells))])


def _cut_audit(part_rows: int):
    """The cheapest audit of a long conversation, cut into parts with the state in which each begins."""

    def run(batches):
        for batch in batches:
            for ck, kinds, costs, audits in zip(*(batch.column(c).to_pylist() for c in ("ck", "kinds", "costs", "audits"))):
                audit = cheapest(tuple(None if c is None else (c, a) for c, a in zip(costs, audits)), len(kinds))[1]
                initials = {v: k[0] for k, v in KINDS.items()}
                out, start, state, before, at = [], 0, 0, 0, 0
                for i, edit in enumerate(audit):
                    if edit != "I" and at and at % part_rows == 0:  # a part ends before the row that begins the next
                        out.append((start, i, before))
                        start, before = i, state
                    if edit != "D":
                        own = initials[kinds[at]] if edit == "K" else "a" if state == 2 else "u"
                        state = STEPS[own][state]
                    at += edit != "I"
                out.append((start, len(audit), before))
                columns = [pa.array([ck] * len(out)), pa.array(range(len(out)), pa.int64()), pa.array([audit[a:b] for a, b, _ in out]), pa.array([s for *_, s in out], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["ck", "part", "audit", "state"])

    return run


def _finish_part(table: pa.Table) -> pa.RecordBatch:
    rows = sorted(zip(*(table[c].to_pylist() for c in ("place", "fault", "turn", "role", "text", "before"))), key=lambda r: r[0])
    (_, _, state, _, audit, _), *rest = rows  # place 0 holds what is known of the part
    messages = [(fault, turn, role, text) for _, fault, turn, role, text, _ in rest]
    return _batch([_part(table["ck"][0].as_py(), table["part"][0].as_py(), table["parts"][0].as_py(), audit, state, rest[0][-1], messages)])


def _long(rows: DataFrame, part_rows: int) -> DataFrame:
    """The same for conversations that span many tasks: parts are parsed apart and their cells joined by rounds."""
    placed = cut_lineage(in_order(rows, ["ck"], "turn", ["role", "text"], position="place", lag={"role": "before"}).withColumn("_digest", F.md5("text")))
    part = F.expr(f"(place - 1) div {part_rows}")
    first = placed.groupBy("ck", F.col("role").alias("_role"), F.col("_digest").alias("_same")).agg(F.min("place").alias("_first")).withColumnRenamed("ck", "_ck")
    again = (F.col("ck") == F.col("_ck")) & (F.col("role") == F.col("_role")) & (F.col("_digest") == F.col("_same"))
    fault = F.when((F.col("place") > F.col("_first")) & (F.col("fault") != "blank"), F.lit("duplicate")).otherwise(F.col("fault"))
    judged = cut_lineage(placed.select("ck", "place", "role", "fault", "_digest").join(first, again).select("ck", part.alias("part"), "place", "role", fault.alias("fault")))
    spans = cut_lineage(map_groups(judged, ["ck", "part"], _parse_part, SPAN))
    most = spans.agg(F.max("part")).first()[0]
    while most:
        most //= FAN_IN
        spans = cut_lineage(map_groups(spans.withColumn("up", F.expr(f"part div {FAN_IN}")), ["ck", "up"], _join_parts, SPAN))
    audits = cut_lineage(spans.mapInArrow(_cut_audit(part_rows), "ck string, part long, audit string, state long"))
    heads = audits.select("ck", "part", F.lit(0).cast("long").alias("place"), F.lit("").alias("fault"), F.col("state").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(None).cast("string").alias("before"))
    known = placed.drop("fault").join(judged.select("ck", "place", "fault"), ["ck", "place"])
    known = known.select("ck", part.alias("part"), "place", "fault", "turn", "role", "text", "before")
    parts = audits.groupBy("ck").agg(F.count(F.lit(1)).alias("parts"))
    return map_groups(known.unionByName(heads).join(parts, "ck"), ["ck", "part"], _finish_part, PARTS)


def _conversation_key(conv: Column) -> Column:
    return F.when(conv.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), conv.cast("string")))


def repair_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part_rows: int = PART_ROWS) -> DataFrame:
    """Cheapest edits that give every conversation the roles ``(system? (user assistant)+)?``.

    Rows are taken by turn, nulls first, then role and text. A row's first fault
    counts: ``blank`` (no byte outside ``[\\x20\\x09-\\x0D]``), ``duplicate`` (role and
    text seen earlier in the conversation), ``truncated`` (last such character is not
    one of ``.!?``). To keep a row costs 0, to give it the role user or assistant 1,
    to delete it 2, to insert an empty user or assistant row 5; a truncated row that stays
    adds 5; blank and duplicate rows have to go. Of the cheapest edits the one
    with the least ``audit`` (initials of Keep, Rerole, Delete, Insert in order) is taken.

    Returns a row for each conversation with rows: ``(conv, part, parts, blank, duplicate, truncated,
    illegal, cost, audit, messages)``; ``illegal`` counts neighbours whose role
    initials are not su, ua or au, ``messages`` holds edit, fault, turn (long), role and text
    of every edit in order, deleted rows too. A conversation above ``part_rows`` rows has
    ``parts`` rows, to be read by ``part``; numbers are to be added up and audits joined. Null roles and
    texts count as one space, a null conversation is one of its own. Repeated
    rows are duplicates. An empty table gives none; other columns are not read.

    Method. The target is an automaton, and the grammar has a nonterminal for each pair
    of its states: ``pq -> pr rq`` for neighbouring spans and ``pq -> edit`` for a row,
    closed under insertions. A span's cell holds the least (cost, audit) of each nonterminal.
    As every split of a span gives the same cell, one split is enough: spans double from single
    rows upwards. Conversations up to ``part_rows`` rows are parsed in the task
    they are sorted in; longer ones are cut into parts, whose cells are joined
    by rounds of 16, and the audit is cut back into parts, so no task holds all
    texts of a conversation. Duplicates in long conversations meet by the MD5 of the text.
    """
    tail = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(tail == "", F.lit("blank")).when(~F.substring(tail, -1, 1).isin(".", "!", "?"), F.lit("truncated")).otherwise(F.lit(""))
    rows = df.select(_conversation_key(F.col(conv)).alias("ck"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"))
    rows = rows.withColumn("fault", fault)
    hot = hot_groups(rows, ["ck"], part_rows)
    whole = rows if hot is None else rows.join(hot.select("ck"), "ck", "left_anti")
    out = whole.repartition("ck").sortWithinPartitions("ck", "turn", "role", "text").mapInArrow(_whole, PARTS)
    if hot is not None:
        out = out.unionByName(_long(rows.join(hot.select("ck"), "ck", "left_semi"), part_rows))
    back = F.when(F.col("ck") != "", F.col("ck").substr(F.lit(2), F.length("ck"))).cast(df.schema[conv].dataType)
    return out.select(back.alias(conv), *[c for c in _NAMES if c != "ck"])


def repaired_text(messages: Column) -> Column:
    """``role:text`` of what is left, joined by newlines; null if nothing is."""
    left = F.filter(messages, lambda m: m["edit"] != "D")
    return F.when(F.size(left) > 0, F.array_join(F.transform(left, lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the parts of each conversation in turn; one part is held at a time."""
    key, digest, begun = None, hashlib.sha256(), False
    for batch in batches:
        out = []
        for ck, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if ck != key:
                if key is not None:
                    out.append((key, digest.hexdigest()))
                key, digest, begun = ck, hashlib.sha256(), False
            if text is not None:
                digest.update((b"\n" if begun else b"") + text.encode())
                begun = True
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*out)], names=["ck", "repaired_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], names=["ck", "repaired_sha256"])


def summary(repaired: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row a conversation from ``repair_conversations``: sums, the whole audit and the SHA-256 of what is left.

    A digest runs over a whole text in order, so the parts of a long conversation pass through one task, one
    after another; all others are digested where they are.
    """
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    text, whole = repaired_text(F.col("messages")), F.col("parts") == 1
    once = repaired.select(conv, "part", "parts", *counts, "audit", F.when(whole, F.sha2(F.coalesce(text, F.lit("")), 256)).alias("repaired_sha256"), F.when(~whole, text).alias("_text"))
    once = cut_lineage(once)  # conversations are parsed once for both branches; only texts of parts are stored
    short = once.filter("parts = 1").select(conv, *counts, "audit", "repaired_sha256")
    long = once.filter("parts > 1").select(_conversation_key(F.col(conv)).alias("ck"), conv, "part", *counts, "audit", "_text")
    if long.isEmpty():
        return short
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "audit"))), lambda x: x["audit"]), "")
    sums = long.groupBy("ck").agg(F.first(conv).alias(conv), *[F.sum(c).alias(c) for c in counts], joined.alias("audit"))
    digests = long.select("ck", "part", "_text").repartition("ck").sortWithinPartitions("ck", "part").mapInArrow(_digests, "ck string, repaired_sha256 string")
    return short.unionByName(sums.join(digests, "ck").drop("ck"))


def turn_gaps(df: DataFrame, conv: str, turn: str, there: Column) -> DataFrame:
    """Every conversation of ``df`` with ``gaps``: missing numbers between its least and greatest turn, over rows where ``there``."""
    turns = df.select(conv, F.when(there, F.col(turn)).alias("_turn")).distinct()
    one = turns.groupBy(conv).agg(F.min("_turn").alias("_lo"), F.max("_turn").alias("_hi"), F.count("_turn").alias("_n"))
    return one.select(conv, F.coalesce(F.col("_hi") - F.col("_lo") + 1 - F.col("_n"), F.lit(0)).cast("long").alias("gaps"))


def damage_number(conv: str, turn: str) -> Column:
    """crc32 of ``conv:turn`` modulo 20; a null counts as one space."""
    named = F.concat(F.coalesce(F.col(conv).cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col(turn).cast("string"), F.lit(" ")))
    return F.crc32(named.cast("binary")) % 20


def damaged(df: DataFrame) -> DataFrame:
    """``conversations`` with faults by ``damage_number``: 0 drops a row, 1 empties it, 2 takes its ``.!?``, 3 repeats it, 4 makes it the user's."""
    text = F.coalesce("text", F.lit(" "))
    rows = df.withColumn("_d", damage_number("conv_id", "turn")).filter("_d != 0")
    rows = rows.withColumn("text", F.when(F.col("_d") == 1, F.lit("")).when(F.col("_d") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text))
    rows = rows.withColumn("role", F.when(F.col("_d") == 4, F.lit("user")).otherwise(F.coalesce("role", F.lit(" "))))
    return rows.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.when(F.col("_d") == 3, 2).otherwise(1)))).select("conv_id", "turn", "role", "text")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest repair of every damaged conversation; one without rows after the damage has nothing to repair."""
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    every = turn_gaps(df, "conv_id", "turn", damage_number("conv_id", "turn") != 0).withColumnRenamed("conv_id", "_conv")
    done = summary(repair_conversations(damaged(df)))
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(done, F.col("_conv").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("_conv").alias("conv_id"), "gaps", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )


OP11_SQL = r"""
with recursive crc_table as (select list(v order by i) as t from (select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v from range(256) r(i))),
named as (select *, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as name from conversations),
marked as (select *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(name, ''), lambda x: ascii(x)::bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 as d from named, crc_table),
changed as (select conv_id, turn, case when d = 4 then 'user' else coalesce(role, ' ') end as role,
            case when d = 1 then '' when d = 2 then regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') else coalesce(text, ' ') end as text, unnest(range(case when d = 3 then 2 else 1 end)) as copy from marked where d <> 0),
ordered as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as k, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as tail,
            row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as seen, lag(role) over (partition by conv_id order by turn nulls first, role, text, copy) as before from changed),
judged as (select *, case when tail = '' then 'blank' when seen > 1 then 'duplicate' when tail[-1] not in ('.', '!', '?') then 'truncated' else '' end as fault from ordered),
steps(c, p, q) as (values ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
inserted(p, q, cost, audit) as (values (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 5, 'I'), (0, 3, 10, 'II'), (1, 2, 5, 'I'), (1, 3, 10, 'II'), (2, 3, 5, 'I'), (3, 2, 5, 'I')),
edits as (select conv_id, k, s.p, s.p as q, 2 as cost, 'D' as audit from judged, (values (0), (1), (2), (3)) s(p)
          union all select conv_id, k, p, q, case when fault = 'truncated' then 5 else 0 end, 'K' from judged join steps on c = role[1] where fault in ('', 'truncated')
          union all select conv_id, k, p, q, case when fault = 'truncated' then 6 else 1 end, 'R' from judged, steps where c <> 's' and fault in ('', 'truncated')),
paths as (select distinct j.conv_id, 0::bigint as k, i.q as state, i.cost, i.audit from judged j, inserted i where i.p = 0
          union all
          select x.conv_id, x.k, x.state, (min({'cost': x.cost, 'audit': x.audit})).cost, (min({'cost': x.cost, 'audit': x.audit})).audit
          from (select a.conv_id, e.k, i.q as state, a.cost + e.cost + i.cost as cost, a.audit || e.audit || i.audit as audit
                from paths a join edits e on e.conv_id is not distinct from a.conv_id and e.k = a.k + 1 and e.p = a.state join inserted i on i.p = e.q) x
          group by x.conv_id, x.k, x.state),
counts as (select conv_id, count(*) as n, sum((fault = 'blank')::int) as blank, sum((fault = 'duplicate')::int) as duplicate, sum((fault = 'truncated')::int) as truncated,
           sum((before is not null and coalesce(before[1] || role[1] not in ('su', 'ua', 'au'), true))::int) as illegal, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps from judged group by conv_id),
best as (select c.conv_id, (min({'cost': p.cost, 'audit': p.audit})).cost as cost, (min({'cost': p.cost, 'audit': p.audit})).audit as audit
         from counts c join paths p on p.conv_id is not distinct from c.conv_id and p.k = c.n and p.state in (0, 3) group by c.conv_id),
letters as (select conv_id, audit[i] as edit, i, sum((audit[i] <> 'I')::int) over w as k, sum((audit[i] <> 'D')::int) over w as place
            from (select conv_id, audit, unnest(range(1, length(audit) + 1)) as i from best) window w as (partition by conv_id order by i)),
placed as (select l.*, j.role, j.text, max((l.edit = 'K' and l.place = 1 and j.role[1] = 's')::int) over (partition by l.conv_id) as has_s
           from letters l left join judged j on l.edit <> 'I' and j.conv_id is not distinct from l.conv_id and j.k = l.k),
texts as (select conv_id, string_agg((case when edit = 'K' then role when (place - has_s) % 2 = 1 then 'user' else 'assistant' end) || ':' || (case when edit = 'I' then '' else text end), chr(10) order by i) as whole
          from placed where edit <> 'D' group by conv_id)
select v.conv_id, coalesce(c.gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
       coalesce(illegal, 0)::bigint as illegal, coalesce(cost, 0)::bigint as cost, coalesce(audit, '') as audit, sha256(coalesce(whole, '')) as repaired_sha256
from (select distinct conv_id from conversations) v left join counts c on c.conv_id is not distinct from v.conv_id
left join best b on b.conv_id is not distinct from v.conv_id left join texts t on t.conv_id is not distinct from v.conv_id
"""
