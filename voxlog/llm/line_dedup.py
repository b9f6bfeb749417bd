"""Line dedup by a log-template tree, in DataFrame operations only.

A line's way through the tree is fixed: its token count, then its leading tokens, with tokens that hold a digit or an
``@`` read as the wildcard ``<*>``. Within a leaf the variable fields are generalised: a token stays fixed at its place
where enough of the leaf's different lines have it there, else it becomes a wildcard. The lines that aren't generalised
are grouped by the token that most of the leaf's other lines hold and tried again among their own, so that other lines
of a leaf can't hide a template. Lines of one template recur when it stands in several documents; all but the first
document (smallest id) lose them.

A text is split once; its lines are written with their hashes, and only those of leaves with several different lines are
read again as text. A line is known by its leaf and its hash, two 64-bit hashes. Whole texts are shuffled once, to meet
the decisions.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, table, text_of

#: Leading tokens in the tree; least documents of a recurring template.
DEPTH, DOCUMENTS = 3, 2
#: A line of fewer tokens and characters is short. It may recur by chance: it goes where so many documents hold it, and so
#: large a share of the table's rows, which chance keeps to at every size.
TOKENS, CHARS, SHORT_DOCUMENTS, SHORT_SHARE = 3, 20, 5, 1 / 500
#: Least fixed tokens of a generalised template, least share of its tokens, and least share of a leaf's lines, and
#: lines, that fix a token.
FIXED_TOKENS, FIXED_SHARE, LINE_SHARE, LINES = 5, 0.7, 0.25, 2
#: Rows (three numbers each) that are broadcast at most; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Lines for each file of a written table at least, from two files a core on. On a local file system Hadoop starts a process for each.
FILE_LINES = 100_000
_NO_ID = -(2**63)


def masked(line: Column) -> Column:
    return F.when(line.rlike("[0-9@]"), F.regexp_replace(line, r"(?<![^ ])[^ 0-9@]*+[0-9@][^ ]*", "<*>")).otherwise(line)


def _lines(docs: DataFrame) -> DataFrame:
    """id, th, pos, n, short, leaf, h of every line that isn't blank, and the masked line where it may be generalised."""
    lines = docs.select("id", "th", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.trim("line") != "")
    lines = lines.select("id", "th", "pos", masked(F.col("line")).alias("line"))
    n = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "))) + 1
    lines = lines.withColumn("n", n).withColumn("short", (F.col("n") < TOKENS) & (F.length("line") < CHARS))
    return lines.select(
        "id", "th", "pos", "n", F.when(F.col("short"), F.col("line").rlike(r"\p{L}")).alias("short"), F.xxhash64("n", F.substring_index("line", " ", DEPTH)).alias("leaf"), F.xxhash64("line").alias("h"),
        F.when(F.col("n") >= FIXED_TOKENS, F.col("line")).alias("line"),
    )


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _generalised(lines: DataFrame, scratch: Scratch, files: int) -> DataFrame:
    """(leaf, h, template) for the lines whose variable fields are generalised; its tables have ``files`` files at most.

    A group of the lines that are left is less than LINE_SHARE of the one it is taken from, so the rounds grow with the
    logarithm of the largest leaf.
    """
    several = scratch.put(lines.where("line is not null").groupBy("leaf").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("leaf").coalesce(files))
    texts = lines.where("line is not null").join(_few(several), "leaf", "left_semi").groupBy("leaf", "h").agg(F.any_value("line").alias("line"))
    tokens = scratch.put(texts.select("leaf", "h", F.posexplode(F.split("line", " ")).alias("at", "token")).select("leaf", "h", "at", F.xxhash64("token").alias("token")).coalesce(files))
    done, group = [], tokens.withColumn("group", F.col("leaf"))
    while True:
        variants = group.where("at = 0").groupBy("group").agg(F.count("*").alias("variants"))
        seen = group.groupBy("group", "at", "token").agg(F.count("*").alias("lines")).where(F.col("lines") >= LINES).join(variants, "group")
        seen = seen.select("group", "at", "token", "lines", (F.col("lines") >= LINE_SHARE * F.col("variants")).alias("fixed"))
        held = group.join(seen, ["group", "at", "token"], "left")
        anchor = F.max(F.when(~F.col("fixed"), F.struct("lines", "at", "token")))
        templates = held.groupBy("leaf", "group", "h").agg(
            F.count("*").alias("n"), F.count_if("fixed").alias("fixed"), F.bit_xor(F.when(F.col("fixed"), F.xxhash64("at", "token"))).alias("template"), anchor.alias("anchor")
        )
        whole = (F.col("fixed") >= FIXED_TOKENS) & (F.col("fixed") >= FIXED_SHARE * F.col("n"))
        templates = scratch.put(templates.withColumn("whole", whole).coalesce(files))
        done.append(templates.where("whole").select("leaf", "h", "template"))
        rest = templates.where("not whole and anchor is not null")
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, done)
        group = scratch.put(tokens.join(rest.select("leaf", "h", F.xxhash64("group", "anchor.at", "anchor.token").alias("group")), ["leaf", "h"]).coalesce(files))


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", documents: int = DOCUMENTS, short_documents: int = SHORT_DOCUMENTS, short_share: float = SHORT_SHARE) -> DataFrame:
    """``df`` with the text cut to the lines that stay, and n_lines, n_dropped (long) added or replaced.

    Lines are what newlines separate; blank ones are never dropped. A line goes from ``documents`` documents on; a short
    one (fewer than TOKENS tokens and CHARS characters) with a letter from ``short_documents`` on that are at least
    ``short_share`` of the rows, and one without a letter stays. A line that recurs only within its document stays.
    Rows that repeat an id and a text are one document and are cut alike; a null id ranks before all others. A null text
    stays null; a text may become empty. Other columns pass through whatever their names, an empty table gives an empty result.
    """
    scratch = Scratch(df.sparkSession, "line-dedup")
    key = (F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(text_of(text_col)).alias("th"))
    lines = scratch.put(_lines(df.select(*key, text_of(text_col).alias("text"))))
    tree = Scratch(df.sparkSession, "line-dedup-tree")
    files = max(2 * df.sparkSession.sparkContext.defaultParallelism, math.ceil(lines.count() / FILE_LINES))
    merged = scratch.put(_generalised(lines, tree, files).coalesce(files))
    tree.clear()
    named = lines.drop("line").join(_few(merged), ["leaf", "h"], "left").select("id", "th", "pos", "leaf", F.coalesce("template", "h").alias("t"), "short")
    read, lines = lines, scratch.put(named.coalesce(files))
    scratch.drop(read, merged)
    once = lines.groupBy("leaf", "t", "id", "th").agg(F.max("short").alias("short"))
    recurring = once.groupBy("leaf", "t").agg(F.count("*").alias("docs"), F.min("id").alias("first"), F.min_by("th", "id").alias("first_th"), F.max("short").alias("short"))
    often = max(short_documents, short_share * df.count())
    recurring = recurring.where((F.col("short").isNull() & (F.col("docs") >= documents)) | (F.col("short") & (F.col("docs") >= often)))
    recurring = scratch.put(recurring.drop("docs", "short").coalesce(files))  # joined from a written table, so that a template that most documents hold can be split
    gone = lines.join(recurring, ["leaf", "t"]).where((F.col("id") != F.col("first")) | (F.col("th") != F.col("first_th")))
    gone = gone.groupBy("id", "th").agg(F.collect_set("pos").alias("gone"))
    names = [c for c in df.columns if c not in ("n_lines", "n_dropped")]
    whole = df.select(*key, F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")).join(gone, ["id", "th"], "left")
    old = F.col("row").getField(text_col)
    whole = whole.select("row", "gone", F.split(old, "\n").alias("lines"))
    whole = whole.select("row", "gone", "lines", F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone")).alias("kept"))
    text = F.when(F.col("gone").isNull(), old).otherwise(F.array_join(F.transform("kept", lambda i: F.col("lines")[i]), "\n"))
    return whole.select(
        *[text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in names],
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Rounds of the tree that the SQL spells out: a leaf of 0.25 ** -7 different lines needs no more.
ROUNDS = 8


def _round_sql(k: int) -> str:
    """Round k of a leaf's templates: m{k} has a row per line, e{k + 1} the tokens of the lines that are tried again."""
    return f"""
v{k} as materialized (select leaf, g, count(*) as variants from e{k} where i = 1 group by all),
s{k} as materialized (
  select leaf, g, i, token, count(*) as lines, count(*) >= 0.25 * variants as fixed from e{k} join v{k} using (leaf, g) group by leaf, g, i, token, variants having count(*) >= 2),
m{k} as materialized (
  select leaf, g, tokens, list(case when fixed then token else '<*>' end order by i) as template, count(*) filter (fixed) as fixed,
    max({{'lines': lines, 'i': i, 'token': token}}) filter (not fixed) as anchor
  from e{k} left join s{k} using (leaf, g, i, token) group by leaf, g, tokens),
e{k + 1} as materialized (
  select leaf, g || chr(31) || anchor.i || chr(31) || anchor.token as g, tokens, generate_subscripts(tokens, 1) as i, unnest(tokens) as token
  from m{k} where not (fixed >= 5 and fixed >= 0.7 * len(tokens)) and anchor is not null),"""


OP10_SQL = rf"""
with l as (
  select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as pos, unnest(string_split(text, chr(10))) as line from documents),
n as (
  select doc_id, pos, list_transform(string_split(line, ' '), lambda x: case when regexp_matches(x, '[0-9@]') then '<*>' else x end) as tokens
  from l where trim(line) <> ''),
k as materialized (
  select doc_id, pos, tokens, struct_pack(n := len(tokens), lead := list_slice(tokens, 1, 3)) as leaf,
    case when len(tokens) < 3 and length(array_to_string(tokens, ' ')) < 20 then regexp_matches(array_to_string(tokens, ' '), '\p{{L}}') end as short from n),
d as (select distinct leaf, tokens from k where len(tokens) >= 5),
e0 as materialized (select leaf, '' as g, tokens, generate_subscripts(tokens, 1) as i, unnest(tokens) as token from (
    select *, count(*) over (partition by leaf) as v from d) where v > 1),{"".join(map(_round_sql, range(ROUNDS)))}
g as (select leaf, tokens, template from ({" union all ".join(f"select * from m{k}" for k in range(ROUNDS))}) where fixed >= 5 and fixed >= 0.7 * len(tokens)),
t as materialized (
  select k.doc_id, k.pos, k.leaf, k.short, case when g.template is not null then {{'g': true, 't': g.template}} else {{'g': false, 't': k.tokens}} end as t
  from k left join g on k.leaf = g.leaf and k.tokens = g.tokens),
r as (
  select leaf, t, min(doc_id) as first from t group by leaf, t
  having case when bool_or(short) is null then count(distinct doc_id) >= 2
    else bool_or(short) and count(distinct doc_id) >= greatest(5, (select count(*) from documents) / 500) end),
x as (select t.doc_id, t.pos from t join r on t.leaf = r.leaf and t.t = r.t where t.doc_id <> r.first),
y as (
  select l.doc_id, count(*) as n_lines, count(x.pos) as n_dropped, coalesce(string_agg(l.line, chr(10) order by l.pos) filter (x.pos is null), '') as text
  from l left join x on l.doc_id = x.doc_id and l.pos = x.pos group by l.doc_id)
select doc_id, text, n_lines, n_dropped from y
"""
