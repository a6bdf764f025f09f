"""Quotation linking: replies find the messages they quote, and conversations are ordered without the quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelcohort.session import cut_lineage

#: Marks before a quoted line: any number of ">", blanks between them.
MARKS = r"^[ \t]*(>[ \t]*)+"
#: A line that only introduces a quotation.
INTRODUCTION = r"(?i)^.{0,200}(wrote|writes|schrieb|a écrit|escribió)[ \t]*:[ \t]*$"


def quote_level(line: Column) -> Column:
    """How deep a line is quoted: the number of its leading marks."""
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), "[^>]", ""))


def normalised(line: Column) -> Column:
    """A line without marks, in lower case, with single blanks."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, MARKS, "")), r"[\s ]+", " "))


def message_lines(df: DataFrame, conv: str, turn: str, text: str) -> DataFrame:
    """Lines of all messages: ``(conv, turn, message, place, level, line, hash, chars)``; ``hash`` is of the normalised line, null if blank."""
    cut = df.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.xxhash64(text).alias("message"), F.posexplode(F.split(F.col(text), "\r?\n")).alias("place", "line"))
    cut = cut.withColumn("level", quote_level(F.col("line"))).withColumn("_n", normalised(F.col("line")))
    return cut.withColumn("hash", F.when(F.col("_n") != "", F.xxhash64("_n"))).withColumn("chars", F.length("_n")).drop("_n")


def passages(lines: DataFrame) -> DataFrame:
    """Maximal runs of neighbouring lines of one level without a blank one: ``(conv, turn, block, chars)``, each once a turn.

    ``block`` hashes the lines of the run in order. Runs end with their message, so no more than a message is gathered.
    """
    run = Window.partitionBy("conv", "turn", "message", "level").orderBy("place")
    runs = lines.withColumn("_run", F.col("place") - F.dense_rank().over(run)).groupBy("conv", "turn", "message", "level", "_run")
    runs = runs.agg(F.array_sort(F.collect_set(F.struct("place", "hash", "chars"))).alias("_l"))
    chars = F.aggregate("_l", F.lit(0).cast("long"), lambda n, x: n + x["chars"])
    return runs.select("conv", "turn", F.xxhash64(F.transform("_l", lambda x: x["hash"])).alias("block"), chars.alias("chars")).distinct()


def own_text(text: Column) -> Column:
    """The lines of a message that are neither quoted nor introduce a quotation, joined again."""
    lines = F.split(text, "\r?\n")
    quoted = lambda x: x.rlike(MARKS)
    following = lambda i: F.coalesce(F.try_element_at(lines, i + 2), F.lit(""))
    kept = F.filter(lines, lambda x, i: ~quoted(x) & ~(x.rlike(INTRODUCTION) & quoted(following(i))))
    return F.when(text.isNotNull(), F.regexp_replace(F.array_join(kept, "\n"), r"^\s+|\s+$", ""))


def _roots(parents: DataFrame) -> DataFrame:
    """Root and depth of every linked message by doubling: each round a message's step becomes twice as long."""
    now = cut_lineage(parents.select("conv", "turn", F.col("parent").alias("up"), F.lit(1).cast("long").alias("steps")))
    while True:
        above = now.select(F.col("conv").alias("_c"), F.col("turn").alias("_t"), F.col("up").alias("_up"), F.col("steps").alias("_steps"))
        joined = now.join(above, (F.col("conv") == F.col("_c")) & (F.col("up") == F.col("_t")), "left")
        now = cut_lineage(joined.select("conv", "turn", F.coalesce("_up", "up").alias("up"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), F.col("_up").isNotNull().alias("moved")))
        if now.filter("moved").isEmpty():
            return now.select("conv", "turn", F.col("up").alias("thread"), F.col("steps").alias("depth"))
        now = now.drop("moved")


def link_quotes(df: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """Reply-ordered conversations without quotes.

    Adds to every message ``own_text`` (its text without quoted lines and the
    lines that introduce them), ``reply_to`` (the turn it answers, or null),
    ``thread`` (the turn at which its chain of replies begins), ``depth`` (0 for a
    beginning), ``quoted_lines`` and ``matched_lines``. Read by (``conv``, ``thread``,
    ``turn``), every reply stands after the message it answers. Other columns are
    kept; columns with those names are replaced.

    Method. A line's leading ">" marks are its quote level. Lines are
    normalised and hashed, and so are passages: neighbouring lines of one level up to a blank one. A
    quoted passage is joined to every earlier message of the same conversation that
    wrote just that passage outside any quotation, and so is every quoted line. A message answers the
    one from which most characters of its outermost quotations come as whole passages, then as
    lines, the later one on a tie. Lines two levels deep are
    what that message had quoted itself and say nothing more.

    Null texts stay null and have no lines; a null conversation or turn is kept
    and links with nothing; rows that repeat a turn share what any of them
    links to. An empty table gives none. Conversations without quotations are not searched. A line that w messages of a conversation
    write and q quote costs up to w * q rows, which are summed before they are
    exchanged; Spark splits the join of a hot line. No
    conversation is gathered into one task.
    """
    added = ("own_text", "reply_to", "thread", "depth", "quoted_lines", "matched_lines")
    base = df.drop(*added)
    lines = message_lines(base.filter(F.col(conv).isNotNull() & F.col(turn).isNotNull()), conv, turn, text).filter("hash is not null").drop("line")
    quoted = cut_lineage(lines.filter("level > 0"))
    written = lines.filter("level = 0").join(quoted.select("conv").distinct(), "conv", "left_semi")
    written = cut_lineage(written)
    outermost = quoted.groupBy("conv", "turn").agg(F.min("level").alias("_outer"), F.count(F.lit(1)).alias("quoted_lines"))
    outer = cut_lineage(quoted.join(outermost.drop("quoted_lines"), ["conv", "turn"]).filter("level = _outer").drop("_outer"))

    def votes(asked: DataFrame, said: DataFrame, key: str) -> DataFrame:
        """Characters of each message that come from each earlier one by ``key``."""
        every = said.select(F.col("conv").alias("_conv"), F.col(key).alias("_key"), F.col("turn").alias("parent")).distinct()
        pairs = asked.join(every, (F.col("conv") == F.col("_conv")) & (F.col(key) == F.col("_key")) & (F.col("parent") < F.col("turn")))
        return pairs.groupBy("conv", "turn", "parent").agg(F.sum("chars").cast("long").alias("chars"))

    asked = outer.groupBy("conv", "turn", "hash").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))
    first = written.groupBy("conv", "hash").agg(F.min("turn").alias("_first"))
    counted = asked.join(first, ["conv", "hash"]).filter("_first < turn").groupBy("conv", "turn").agg(F.sum("n").alias("matched_lines"))
    none = F.lit(0).cast("long")
    by_line = votes(asked, written, "hash").select("conv", "turn", "parent", none.alias("whole"), F.col("chars").alias("parts"))
    by_passage = votes(passages(outer), passages(written), "block").select("conv", "turn", "parent", F.col("chars").alias("whole"), none.alias("parts"))
    scores = by_line.unionByName(by_passage).groupBy("conv", "turn", "parent").agg(F.sum("whole").alias("whole"), F.sum("parts").alias("parts"))
    best = scores.groupBy("conv", "turn").agg(F.max(F.struct("whole", "parts", "parent")).alias("_b")).join(counted, ["conv", "turn"])
    best = cut_lineage(best.select("conv", "turn", F.col("_b.parent").alias("parent"), "matched_lines"))
    chains = _roots(best)
    facts = outermost.select("conv", "turn", "quoted_lines").join(best, ["conv", "turn"], "left").join(chains, ["conv", "turn"], "left")
    facts = facts.withColumnsRenamed({"conv": "_conv", "turn": "_turn"})
    out = base.join(facts, (F.col(conv) == F.col("_conv")) & (F.col(turn) == F.col("_turn")), "left")
    return out.select(
        *base.columns,
        own_text(F.col(text)).alias("own_text"),
        F.col("parent").alias("reply_to"),
        F.coalesce("thread", F.col(turn)).alias("thread"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        F.coalesce("quoted_lines", F.lit(0)).cast("long").alias("quoted_lines"),
        F.coalesce("matched_lines", F.lit(0)).cast("long").alias("matched_lines"),
    )


def op10_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages with what they answer, and their own text as a digest."""
    linked = link_quotes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return linked.select("conv_id", "turn", "role", "reply_to", "thread", "depth", "quoted_lines", "matched_lines", F.sha2("own_text", 256).alias("own_sha256"))


OP10_SQL = r"""
with recursive msgs as (select row_number() over () as r, * from conversations),
lines as (select r, conv_id, turn, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) as line, generate_subscripts(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), 1) as p from msgs),
marked as (select *, length(regexp_replace(regexp_extract(line, '^[ \t]*(>[ \t]*)+'), '[^>]', '', 'g')) as level,
           trim(regexp_replace(lower(regexp_replace(line, '^[ \t]*(>[ \t]*)+', '')), '[\s\x{00a0}]+', ' ', 'g')) as norm,
           regexp_matches(line, '(?i)^.{0,200}(wrote|writes|schrieb|a écrit|escribió)[ \t]*:[ \t]*$') as intro from lines),
filled as (select * from marked where norm <> '' and conv_id is not null and turn is not null),
said as (select distinct conv_id, turn, norm from filled where level = 0),
quoted as (select conv_id, turn, level, norm, count(*) as n, count(*) * length(norm) as chars from filled where level > 0 group by 1, 2, 3, 4),
outermost as (select conv_id, turn, min(level) as level, sum(n) as quoted_lines from quoted group by 1, 2),
runs as (select conv_id, turn, level, string_agg(norm, chr(10) order by p) as block, sum(length(norm)) as chars
         from (select *, p - row_number() over (partition by r, level order by p) as run from filled) group by r, conv_id, turn, level, run),
blocks as (select distinct * from runs),
by_line as (select q.conv_id, q.turn, s.turn as parent, sum(q.chars) as parts from quoted q join outermost o using (conv_id, turn, level)
            join said s on s.conv_id = q.conv_id and s.norm = q.norm and s.turn < q.turn group by 1, 2, 3),
by_block as (select q.conv_id, q.turn, s.turn as parent, sum(q.chars) as whole from blocks q join outermost o using (conv_id, turn, level)
             join blocks s on s.level = 0 and s.conv_id = q.conv_id and s.block = q.block and s.turn < q.turn group by 1, 2, 3),
counted as (select q.conv_id, q.turn, sum(q.n) as matched_lines from quoted q join outermost o using (conv_id, turn, level)
            where exists (select 1 from said s where s.conv_id = q.conv_id and s.norm = q.norm and s.turn < q.turn) group by 1, 2),
best as (select l.conv_id, l.turn, arg_max(l.parent, (coalesce(b.whole, 0), l.parts, l.parent)) as parent, any_value(c.matched_lines) as matched_lines
         from by_line l left join by_block b using (conv_id, turn, parent) join counted c on c.conv_id = l.conv_id and c.turn = l.turn group by 1, 2),
chain as (select conv_id, turn, parent as up, 1 as depth from best union all
          select c.conv_id, c.turn, b.parent, c.depth + 1 from chain c join best b on b.conv_id = c.conv_id and b.turn = c.up),
root as (select conv_id, turn, min(up) as thread, max(depth) as depth from chain group by 1, 2),
kept as (select m.r, trim(string_agg(m.line, chr(10) order by m.p), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as own from marked m
         left join marked x on x.r = m.r and x.p = m.p + 1
         where not regexp_matches(m.line, '^[ \t]*(>[ \t]*)+') and not (m.intro and coalesce(regexp_matches(x.line, '^[ \t]*(>[ \t]*)+'), false)) group by m.r)
select m.conv_id, m.turn, m.role, b.parent as reply_to, coalesce(t.thread, m.turn) as thread, coalesce(t.depth, 0)::bigint as depth, coalesce(o.quoted_lines, 0)::bigint as quoted_lines,
       coalesce(b.matched_lines, 0)::bigint as matched_lines, case when m.text is not null then sha256(coalesce(k.own, '')) end as own_sha256
from msgs m left join kept k using (r) left join outermost o on o.conv_id = m.conv_id and o.turn = m.turn
left join best b on b.conv_id = m.conv_id and b.turn = m.turn left join root t on t.conv_id = m.conv_id and t.turn = m.turn
"""
