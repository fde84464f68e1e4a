"""Quotation linking: who answers whom, and conversations without quotes.

Only DataFrame functions.  Lines that begin with ``>`` are quotes, nested as
deep as there are marks.  Consecutive lines of one level are a passage; its
normalised text and that of its lines are hashed and joined to the earliest
message of the conversation that says the same outside of a quote.  That table
has one row per conversation and hash, so a passage that very many messages say
or quote never pairs them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import written

# Marks at the start of a line, each with the blanks after it.
MARKS = r"^[ \t]*((?:>[ \t]*)+)"
BLANKS = r"[ \t\r\n]+"


def normalised(text: Column) -> Column:
    """Lower case with runs of blanks as one space and none at the ends."""
    return F.lower(F.trim(F.regexp_replace(text, BLANKS, " ")))


def _lines(text: Column) -> Column:
    return F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), "\n")


def level(line: Column) -> Column:
    """How deep a line is quoted; 0 for a line of the message itself."""
    marks = F.regexp_extract(line, MARKS, 1)
    return F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))


def own_text(text: Column) -> Column:
    """The lines outside of quotes, without blank lines around them."""
    own = F.filter(_lines(text), lambda line: level(line) == 0)
    return F.regexp_replace(F.array_join(own, "\n"), r"^[ \t\n]+|[ \t\n]+$", "")


def passages(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, level, said``: quoted passages and their lines, normalised.

    A passage of several lines gives a row for itself and one for each line.
    """
    quoting = messages.filter(F.col("text").rlike(r"(?m)^[ \t]*>")).select("conv_id", "turn", "text").distinct()
    lines = quoting.select(
        "conv_id", "turn", F.xxhash64("text").alias("message"), F.posexplode(_lines(F.col("text"))).alias("at", "line")
    ).select("*", level(F.col("line")).alias("level"))
    message = Window.partitionBy("conv_id", "turn", "message").orderBy("at")
    begins = F.coalesce(F.col("level") != F.lag("level").over(message), F.lit(True)).cast("int")
    runs = lines.withColumn("begins", begins).withColumn("run", F.sum("begins").over(message)).filter("level > 0")
    content = F.regexp_replace("line", MARKS, "")
    whole = runs.groupBy("conv_id", "turn", "message", "run", "level").agg(
        F.array_sort(F.collect_list(F.struct("at", content.alias("line")))).alias("lines")
    )
    text = F.transform("lines", lambda entry: entry["line"])
    parts = F.array_distinct(F.concat(F.array(F.array_join(text, "\n")), text))
    said = whole.select("conv_id", "turn", "level", F.explode(parts).alias("said"))
    return said.select("conv_id", "turn", "level", normalised(F.col("said")).alias("said")).filter("said <> ''").distinct()


def originals(messages: DataFrame) -> DataFrame:
    """``conv_id, hash, origin``: the first turn that says a text or line itself."""
    own = own_text(F.col("text"))
    parts = F.array_distinct(F.concat(F.array(own), F.split(own, "\n")))
    said = messages.select("conv_id", "turn", F.explode(F.transform(parts, normalised)).alias("said"))
    return (
        said.filter("said <> ''")
        .groupBy("conv_id", F.xxhash64("said").alias("hash"))
        .agg(F.min("turn").alias("origin"))
    )


def parents(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, parent_turn, n_linked``: the message each one answers.

    Of the earlier messages its first-level quotes come from, the one with most
    quoted characters; ties go to the later one.
    """
    quoted = written(passages(messages), "quotes").withColumn("hash", F.xxhash64("said"))
    linked = quoted.join(originals(messages), ["conv_id", "hash"]).filter("origin < turn")
    by_origin = linked.groupBy("conv_id", "turn", "origin").agg(
        F.sum(F.when(F.col("level") == 1, F.length("said")).otherwise(0)).alias("weight"),
        F.count(F.lit(1)).alias("n"),
    )
    return by_origin.groupBy("conv_id", "turn").agg(
        F.max_by(F.when(F.col("weight") > 0, F.col("origin")), F.struct("weight", "origin")).alias("parent_turn"),
        F.sum("n").alias("n_linked"),
    )


def roots(found: DataFrame) -> DataFrame:
    """``conv_id, turn, root_turn`` of messages with a parent, by pointer doubling."""
    at = written(
        found.filter("parent_turn is not null").select("conv_id", "turn", F.col("parent_turn").alias("root_turn")), "parents"
    )
    while True:
        above = at.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("above"))
        moved = written(at.join(above, ["conv_id", "root_turn"], "left"), "roots")
        at = moved.select("conv_id", "turn", F.coalesce("above", "root_turn").alias("root_turn"))
        if moved.filter("above is not null").isEmpty():
            return at


def conversations(messages: DataFrame) -> DataFrame:
    """Every message without quotes, with its place in reply order.

    Columns: ``conv_id, turn, role, text, parent_turn, root_turn, n_linked,
    formatted``.  Ordering a conversation by ``root_turn, turn`` puts threads one
    after the other and each message behind the one it answers.  ``n_linked``
    counts quoted passages and lines with a known origin.

    One row per row of ``messages``.  A null text is empty; a null ``conv_id`` or
    ``turn`` links with nothing and is its own root.  Rows that share a turn count
    as one message for links.  Whole texts are read, however long; an empty table gives
    no rows.  Extra columns are not read.
    """
    messages = messages.select("conv_id", "turn", "role", "text")
    found = written(parents(messages), "links")
    linked = messages.join(found, ["conv_id", "turn"], "left").join(roots(found), ["conv_id", "turn"], "left")
    own = own_text(F.col("text"))
    return linked.select(
        "conv_id", "turn", "role", own.alias("text"), "parent_turn",
        F.coalesce("root_turn", "turn").alias("root_turn"),
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), own, F.lit("\n")).alias("formatted"),
    )


# The same for DuckDB.
SQL = r"""
with recursive
messages as (select conv_id, turn, role, text,
    string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10)) as lines from conversations),
leveled as (select *, list_transform(lines, lambda x: {'line': x,
    'level': length(regexp_extract(x, '^[ \t]*((?:>[ \t]*)+)', 1))
      - length(replace(regexp_extract(x, '^[ \t]*((?:>[ \t]*)+)', 1), '>', ''))}) as parts from messages),
own as (select conv_id, turn, role, text, parts, regexp_replace(
    array_to_string(list_transform(list_filter(parts, lambda x: x.level = 0), lambda x: x.line), chr(10)),
    '^[ \t\n]+|[ \t\n]+$', '', 'g') as own_text from leveled),
said as (select conv_id, turn, unnest(list_distinct(list_concat([own_text], string_split(own_text, chr(10))))) as said from own),
origins as (select conv_id, lower(trim(regexp_replace(said, '[ \t\r\n]+', ' ', 'g'))) as said, min(turn) as origin
    from said where lower(trim(regexp_replace(said, '[ \t\r\n]+', ' ', 'g'))) <> '' group by 1, 2),
quoting as (select distinct conv_id, turn, text, parts from own
    where len(list_filter(parts, lambda x: x.level > 0)) > 0),
lines as (select conv_id, turn, text, unnest(range(1, len(parts) + 1)) as place, unnest(parts) as part from quoting),
flagged as (select *, case when lag(part.level) over w = part.level then 0 else 1 end as begins
    from lines window w as (partition by conv_id, turn, text order by place)),
runs as (select *, sum(begins) over (partition by conv_id, turn, text order by place) as run from flagged),
whole as (select conv_id, turn, text, run, part.level as level,
    list(regexp_replace(part.line, '^[ \t]*((?:>[ \t]*)+)', '') order by place) as content
    from runs where part.level > 0 group by all),
parts as (select conv_id, turn, level,
    unnest(list_distinct(list_concat([array_to_string(content, chr(10))], content))) as said from whole),
passages as (select distinct conv_id, turn, level,
    lower(trim(regexp_replace(said, '[ \t\r\n]+', ' ', 'g'))) as said from parts),
linked as (select p.conv_id, p.turn, p.level, p.said, o.origin from passages p join origins o
    on p.conv_id = o.conv_id and p.said = o.said where p.said <> '' and o.origin < p.turn),
by_origin as (select conv_id, turn, origin, sum(case when level = 1 then length(said) else 0 end) as weight,
    count(*) as n from linked group by all),
parents as (select conv_id, turn, first(case when weight > 0 then origin end order by weight desc, origin desc) as parent_turn,
    sum(n) as n_linked from by_origin group by all),
climb as (select conv_id, turn, parent_turn as up from parents where parent_turn is not null
    union all select c.conv_id, c.turn, p.parent_turn from climb c join parents p
    on c.conv_id = p.conv_id and c.up = p.turn where p.parent_turn is not null),
roots as (select conv_id, turn, min(up) as root_turn from climb group by all)
select o.conv_id, o.turn, o.role, o.own_text as text, p.parent_turn, coalesce(r.root_turn, o.turn) as root_turn,
    cast(coalesce(p.n_linked, 0) as bigint) as n_linked,
    concat('<|', coalesce(o.role, ''), '|>', chr(10), o.own_text, chr(10)) as formatted
from own o left join parents p on o.conv_id = p.conv_id and o.turn = p.turn
left join roots r on o.conv_id = r.conv_id and o.turn = r.turn
"""
