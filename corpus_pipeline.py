"""A corpus pipeline: quality classifier, line dedup, near-dedup, best-fit packing.

Every stage takes (spark, docs, sf_dir), with docs the table ``documents`` or what the stage before kept, and all but the
last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlog.llm.kneser_ney import quality, trusted_labels, with_ids
from voxlog.llm.line_dedup import line_dedup
from voxlog.llm.near_copies import near_copies
from voxlog.llm.packing import best_fit_pack
from voxlog.llm.shared import Scratch, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects, row by row.

    Rows are numbered, so rows that share an id, or have none, are judged each by their own text; all rows of a trusted id
    are trusted. Empty and null texts are rejected, an empty table stays empty.
    """
    scratch = Scratch(spark, "quality-stage")
    rows = scratch.put(docs.withColumn("_row", F.monotonically_increasing_id()))
    trusted = with_ids(rows.select("_row", "doc_id"), "doc_id", scratch.put(trusted_labels(table(spark, sf_dir, "labels"))), "left_semi").select("_row")
    rejected = quality(rows, scratch.put(trusted), id_col="_row").where("not kept").select("_row")
    return with_ids(rows, "_row", scratch.put(rejected), "left_anti").select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts recurring lines out of the texts; every row stays, with what is left of its text.

    Rows that repeat an id and a text are cut alike; a null text stays null, and a text may become empty.
    """
    cut = line_dedup(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: the smallest id's, the first of them if it repeats. Null ids rank last.

    Near copies share four fifths of their five-word shingles; op6's four-word fingerprints are that query's own. Rows
    are numbered and decided one by one, so other rows of an id don't go with a copy.
    """
    scratch = Scratch(spark, "near")
    rows = scratch.put(docs.withColumn("_row", F.monotonically_increasing_id()))
    near = near_copies(rows, "_row").join(rows.select("_row", "doc_id"), "_row")
    first = near.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("first"))
    return with_ids(rows, "_row", scratch.put(first.select("first._row")), "left_semi").select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs every row, rows that repeat each; a null or empty text is the end id alone."""
    return best_fit_pack(docs)


STAGES = [("quality_classifier", quality_classifier), ("line_dedup", lines), ("simhash_near_dedup", near_duplicates), ("best_fit_packing", packing)]

#: Scoring, near-dedup and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.put(docs)
    return docs
