"""Scratch tables in the folder all executors share, and small helpers used by every operator here."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where none is set a local master gets one of our own; a cluster needs a shared one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="voxlog-scratch-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


class Scratch:
    """Written tables that cut lineage. They live in the shared folder, so they survive a lost executor.

    ``put`` writes and rereads a table; ``drop`` removes tables nothing lazy depends on any more. What a
    returned DataFrame still reads stays until the cluster empties its checkpoint folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{self.n}"
        self.n += 1
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._scratch_path = path
        return back

    def drop(self, *tables: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for t in tables:
            if path := getattr(t, "_scratch_path", None):
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(conf).delete(p, True)


    def clear(self) -> None:
        """Removes all tables, once nothing lazy depends on any."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def tidied(out: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``out``, after which a worker gives freed memory back to the system: it lives on beside the JVM for other tasks."""
    try:
        yield from out
    finally:
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # not this C library
            pass


def text_of(col: str) -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def literal_rows(spark: SparkSession, rows: list[tuple[int, ...]], schema: str) -> DataFrame:
    """A few rows of integers as a table in the plan itself; a list given to createDataFrame goes through Python workers."""
    names = ", ".join(c.split()[0] for c in schema.split(", "))
    casts = ", ".join(f"cast({c.split()[0]} as {c.split()[1]}) as {c.split()[0]}" for c in schema.split(", "))
    low = -(2**63)
    values = ", ".join("(" + ", ".join(f"{v}L" if v != low else f"(-{2**63 - 1}L - 1L)" for v in r) + ")" for r in rows)
    return spark.sql(f"select {casts} from values {values} as t({names})")


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node long, root long) for every node of ``edges`` (a long, b long); root is the smallest node reachable.

    Alternating large-star and small-star steps: each is an aggregation with map-side combine and a join that
    adaptive execution can split, so a hub with very many links doesn't meet in one task. Rounds grow with the
    logarithm of the longest path. An empty input gives an empty result; self links and nulls are ignored.
    """
    spark = edges.sparkSession
    e = scratch.put(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def mark(t: DataFrame) -> tuple:
        return tuple(t.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    was, now = None, mark(e)
    while now[0] and now != was:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        big = scratch.put(large)
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x"))
        new = scratch.put(small.select("x.u", "x.v").where("u <> v").distinct())
        scratch.drop(e, big)
        e, was, now = new, now, mark(new)
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots) if now[0] else spark.createDataFrame([], "node long, root long")
