"""Flat dumps of chunks: a magic, a count, then per chunk its position and records. Read, written, and spread over more regions."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Corrupt
from ..storage import Files

MAGIC = b"ZGDS"  # a fixed value of the format
SCHEMA = "chunk_x int, chunk_z int, component int, subchunk_y int, value binary"


def parse(data: bytes) -> Iterator[tuple[int, int, int, int, bytes]]:
    if len(data) < 8 or data[:4] != MAGIC:
        raise Corrupt("dataset magic")
    at = 8
    try:
        for _ in range(struct.unpack_from("<I", data, 4)[0]):
            x, z, n = struct.unpack_from("<iiH", data, at)
            at += 10
            for _ in range(n):
                tag, y, size = struct.unpack_from("<BbI", data, at)
                at += 6
                if at + size > len(data):
                    raise Corrupt("dataset record")
                yield x, z, tag, y, data[at : at + size]
                at += size
    except struct.error as e:
        raise Corrupt("dataset") from e
    if at != len(data):
        raise Corrupt("dataset tail")


def read(spark: SparkSession, path: str) -> DataFrame:
    import pyarrow as pa

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                held = list(parse(content.as_py()))
                for i in range(0, len(held), 4096):
                    x, z, tag, y, v = zip(*held[i : i + 4096], strict=True)
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in (x, z, tag, y)), pa.array(v, pa.binary())], [c.split()[0] for c in SCHEMA.split(", ")])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, SCHEMA)


def write(df: DataFrame, path: str) -> int:
    """Writes one file in chunk order, a chunk at a time."""
    chunks = df.groupBy("chunk_x", "chunk_z").agg(F.array_sort(F.collect_list(F.struct("component", "subchunk_y", "value"))).alias("records"))
    n, out = 0, bytearray()
    for row in chunks.orderBy("chunk_x", "chunk_z").toLocalIterator():
        out += struct.pack("<iiH", row["chunk_x"], row["chunk_z"], len(row["records"]))
        for r in row["records"]:
            out += struct.pack("<BbI", r["component"], r["subchunk_y"], len(r["value"])) + bytes(r["value"])
        n += 1
    folder, name = path.rsplit("/", 1)
    Files(df.sparkSession, folder).create(name, MAGIC + struct.pack("<I", n) + bytes(out))
    return n


def spread(df: DataFrame, regions: int, chunks_each: int = 8) -> DataFrame:
    """The first ``regions * chunks_each`` chunks in order, dealt out ``chunks_each`` to a region."""
    order = df.select("chunk_x", "chunk_z").distinct().orderBy("chunk_x", "chunk_z").limit(regions * chunks_each)
    from pyspark.sql.window import Window

    numbered = order.withColumn("n", F.row_number().over(Window.orderBy("chunk_x", "chunk_z")) - 1)  # a bounded number of chunks
    region = F.floor(F.col("n") / chunks_each)
    side = int(regions**0.5) or 1
    to = numbered.select("chunk_x", "chunk_z", (F.floor(region / side) * 32 + F.col("n") % chunks_each).cast("int").alias("new_x"), (region % side * 32).cast("int").alias("new_z"))
    return df.join(to, ["chunk_x", "chunk_z"]).select(F.col("new_x").alias("chunk_x"), F.col("new_z").alias("chunk_z"), "component", "subchunk_y", "value")
