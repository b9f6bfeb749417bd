"""Exact dedup with a heavy-hitter split, in DataFrame operations only.

A Misra-Gries summary (Spark's frequent-items aggregate, which merges partial summaries) names digests that may
be frequent. Their exact counts and winners are then verified, and only the proven frequent ones, at most
``2 / support`` rows, are broadcast; their rows are settled on the map side. All other digests have fewer than
``support`` of the rows each and go through an ordinary shuffle.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, table, text_of

SUPPORT = 1 / 256
_NO_ID = -(2**63)


def ascii_lower(col):
    return F.translate(col, string.ascii_uppercase, string.ascii_lowercase)


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per row of ``df``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. The row with the largest
    id stays; a null id ranks as the smallest long, and of rows that repeat the largest id exactly one stays. Other
    columns are ignored, whatever their names. An empty table gives an empty result.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    d = scratch.put(
        df.select(F.col(id_col).alias("id"), F.sha2(ascii_lower(text_of(text_col)).cast("binary"), 256).alias("sha")).select(
            "id", "sha", F.xxhash64("sha").alias("h"), F.coalesce(F.col("id").cast("long"), F.lit(_NO_ID)).alias("ord"), F.monotonically_increasing_id().alias("rid")
        )
    )
    best = (F.count("*").alias("n"), F.max_by("rid", "ord").alias("best"), F.max("id").alias("keep_id"))
    rows = d.count()
    maybe = d.stat.freqItems(["h"], support).first()[0] if rows else []
    heavy = d.where(F.col("h").isin(list(maybe))).groupBy("sha").agg(*best).where(F.col("n") >= max(2, rows * support))
    heavy = F.broadcast(scratch.put(heavy))
    rest = d.join(heavy.select("sha"), "sha", "left_anti")
    found = d.join(heavy, "sha").unionByName(rest.join(rest.groupBy("sha").agg(*best), "sha"))
    return found.select(
        F.col("id").alias(id_col),
        "keep_id",
        F.col("n").cast("long").alias("group_size"),
        (F.col("rid") == F.col("best")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP8_SQL = """
with d as (
  select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256
  from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
  doc_id = max(doc_id) over w as kept, text_sha256
from d window w as (partition by text_sha256)
"""
