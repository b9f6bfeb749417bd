"""Chat formatting in Spark expressions only.

Turns are collected in two steps, bounded segments first, sorted as structs, runs of one role merged by array functions,
and concatenated. The template:

    <|role|>\\n text [<|+|> text ...] <|end|>\\n

for each run of adjacent turns of one role; ``<|+|>`` stands between the turns that were merged and ``<|~|>`` for a null
role. Inside texts and roles a backslash is put before every backslash and after the first character of every control
string: ``<|``, ``|>``, ``<s>``, ``</s>``, ``[INST]`` and ``[/INST]``; a role that reads like a mark (``end``, ``+``, ``~``)
gets one in front. So no text holds a control string, no role is a mark, and taking the backslashes away again gives the text. The loss mask covers the texts of the trained roles and nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

#: Roles that would read like a mark of the template.
MARKS = ("end", "+", "~")
#: Turns of a conversation that are collected and sorted in one first-step group.
SEGMENT = 512


def escape(c: Column) -> Column:
    c = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("|>"), F.lit("|\\>"))
    return F.regexp_replace(c, r"([<\[])(?=\||/?s>|/?INST\])", r"$1\\")


def escape_role(c: Column) -> Column:
    return F.when(c.isin(*MARKS), F.concat(F.lit("\\"), c)).otherwise(escape(c))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def format_chats(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: id, pieces (array of struct<text, loss>), formatted (the pieces, concatenated).

    Turns are sorted by turn, null turns first; turns that repeat a number by role and text, and repeated rows are all
    kept. Null text is empty, a null role is kept apart from an empty one. Rows with a null id form one conversation.
    Other columns are ignored; an empty table gives an empty result. A conversation becomes one row, so it must fit in
    a task: its turns are gathered in sorted segments first, and those are merged.
    """
    turn = F.col(turn_col).cast("long")
    one = df.select(F.col(id_col).alias("id"), turn.alias("turn"), F.struct(turn.alias("turn"), F.col(role_col).cast("string").alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).alias("t"))
    part = one.groupBy("id", F.floor(F.col("turn") / SEGMENT).alias("segment")).agg(F.array_sort(F.collect_list("t")).alias("turns"))
    whole = part.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("segment", "turns"))).alias("s"))
    turns = whole.select("id", F.flatten(F.col("s.turns")).alias("t"))
    # each turn beside its neighbours' roles; a role is wrapped in an array, so that null differs from none
    at = turns.select("id", "t", F.transform("t", lambda x: F.array(x["role"])).alias("r")).select(
        "id", F.arrays_zip("t", F.col("r").alias("role"), F.concat(F.array(F.lit(None).cast("array<string>")), F.col("r")).alias("before"), F.concat(F.slice("r", 2, F.size("r") + 1), F.array(F.lit(None).cast("array<string>"))).alias("after")).alias("z")
    )
    wrap = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))

    def piece(x: Column) -> Column:
        role = F.when(x["role"][0].isNull(), F.lit("<|~|>")).otherwise(F.concat(F.lit("<|"), escape_role(x["role"][0]), F.lit("|>")))
        head = F.when(x["role"].eqNullSafe(x["before"]), F.lit("<|+|>")).otherwise(F.concat(role, F.lit("\n")))
        tail = F.when(x["role"].eqNullSafe(x["after"]), F.lit("")).otherwise(F.lit("<|end|>\n"))
        return F.array(wrap(head, F.lit(False)), wrap(escape(x["t"]["text"]), F.coalesce(x["role"][0].isin(*trained), F.lit(False))), wrap(tail, F.lit(False)))

    # the arrays end with the last turn: the zipped array is one longer because of "before"
    pieces = at.select("id", F.flatten(F.transform(F.filter("z", lambda x: x["t"].isNotNull()), piece)).alias("pieces"))
    return pieces.select(F.col("id").alias(id_col), "pieces", F.array_join(F.col("pieces.text"), "").alias("formatted"))


def read_back(formatted: Column) -> Column:
    """The turns, as array<struct<role, text>>, that a formatted conversation holds, from its characters alone."""
    runs = F.filter(F.split(formatted, r"<\|end\|>\n"), lambda r: r != "")

    def turns(run: Column) -> Column:
        head = F.substring_index(run, "|>\n", 1)
        role = F.when(head == "<|~", F.lit(None).cast("string")).otherwise(unescape(F.substring(head, 3, 1 << 30)))
        body = F.substr(run, F.length(head) + 4)
        return F.transform(F.split(body, r"<\|\+\|>"), lambda text: F.struct(role.alias("role"), unescape(text).alias("text")))

    return F.flatten(F.transform(runs, turns))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.sql(f"select * from values (-7L, 0L, 'user', '{said}'), (-7L, 1L, 'assistant', '{said}') as t(conv_id, turn, role, text)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    done = format_chats(rows).select("conv_id", "formatted", F.filter("pieces", lambda p: p["loss"]).alias("loss"))
    done = done.select("conv_id", "formatted", F.array_join(F.transform("loss", lambda p: unescape(p["text"])), "").alias("loss"), read_back(F.col("formatted")).alias("turns"))
    line = lambda t: F.concat(F.coalesce(t["role"], F.lit("")), F.lit("\n"), t["text"], F.lit("\n"))
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", line), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP9_SQL = r"""
with r as (
  select conv_id, turn, role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
w as (
  select *, coalesce(lag(role) over w = role, false) as merged, coalesce(lead(role) over w = role, false) as more,
    regexp_replace(replace(replace(text, '\', '\\'), '|>', '|\>'), '(<)(\||/?s>)|(\[)(/?INST\])', '\1\3\\\2\4', 'g') as escaped
  from r window w as (partition by conv_id order by turn, role, text))
select conv_id, count(*) as n_turns, sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(length(escaped) + case when merged then 5 else length(role) + 5 end + case when more then 0 else 8 end) as bigint) as formatted_chars
from w group by conv_id
"""
