"""Best-fit packing of token sequences: bounded-space online best-fit.

Texts are encoded where they are read; what is shuffled is a narrow row per piece. Each packing task keeps a fixed
number of open sequences. A bitset has bit f set where some open sequence has f free places, so the best fit for a
piece of n tokens is the lowest set bit at or above n. When one more sequence must open, the fullest closes.

Pieces arrive in an order that is written with them, so that a task run again places them alike. A small look-ahead, the
longest of so many pieces first, saves about one sequence in a hundred; without it the packing is strictly online.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, table, text_of, tidied
from .tokens import encoder

LENGTH, OPEN, END_ID = 1024, 4096, 2
#: Pieces looked ahead at; 0 places each as it comes.
LOOK_AHEAD = 1024
#: Tokens that a packing task should place: a task leaves a few sequences part-filled.
TASK_TOKENS = 200_000_000


class BestFit:
    """Places lengths of at most ``size`` into sequences, at most ``open_bins`` of them open at a time."""

    def __init__(self, size: int = LENGTH, open_bins: int = OPEN):
        self.size, self.open_bins = size, open_bins
        self.free: list[list[int]] = [[] for _ in range(size + 1)]  # open sequences by free space
        self.bits = self.opened = self.open = 0

    def place(self, n: int) -> tuple[int, int]:
        """(sequence, offset) for a piece of n tokens."""
        fits = self.bits >> n
        if fits:
            f = n + (fits & -fits).bit_length() - 1
            at = self._take(f)
        else:
            if self.open >= self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
            f, at = self.size, self.opened
            self.opened += 1
        if f > n:  # a full sequence closes at once
            self.free[f - n].append(at)
            self.bits |= 1 << (f - n)
            self.open += 1
        return at, self.size - f

    def _take(self, f: int) -> int:
        at = self.free[f].pop()
        self.open -= 1
        if not self.free[f]:
            self.bits ^= 1 << f
        return at


def _cut(batches: Iterator[pa.RecordBatch], size: int, end: bytes, path: str | None) -> Iterator[pa.RecordBatch]:
    made = encoder(path)
    ids_of = made.ids
    for b in batches:
        rows: list[list] = [[] for _ in range(5)]
        for i, text in enumerate(b.column(1)):
            ids = ids_of(text.as_py()) + end
            total, piece, start = len(ids) // 4, 0, 0
            stop = total % size or size
            while start < total:
                for to, v in zip(rows, (i, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])), strict=True):
                    to.append(v)
                piece, start, stop = piece + 1, stop, stop + size
        at, piece, start, length, crc = rows
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["id", "piece", "start", "length", "ids_crc32"]
        )
    made.forget()


def _windows(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of exactly ``rows`` rows (the last one fewer), however they come."""
    held, n = [], 0
    for b in batches:
        while n + b.num_rows >= rows:
            held.append(b.slice(0, rows - n))
            b, n = b.slice(rows - n), 0
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        if b.num_rows:
            held.append(b)
            n += b.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _pack(batches: Iterator[pa.RecordBatch], size: int, open_bins: int, look_ahead: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    base = TaskContext.get().partitionId() << 40
    bins = BestFit(size, open_bins)
    for b in _windows(batches, look_ahead) if look_ahead else batches:
        lengths = b.column("length").to_pylist()
        placed: list = [None] * len(lengths)
        for i in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True) if look_ahead else range(len(lengths)):
            placed[i] = bins.place(lengths[i])
        yield pa.RecordBatch.from_arrays(
            [*b.columns, pa.array([base + s for s, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())], [*b.schema.names, "sequence_id", "offset"]
        )


def best_fit_pack(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = LENGTH,
    open_bins: int = OPEN,
    end_id: int = END_ID,
    tokenizer: str | None = None,
    look_ahead: int = LOOK_AHEAD,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and an end id; a null or empty text is the end id alone. Only documents longer than ``size``
    are cut, into pieces of ``size``, the first of which may be shorter. Pieces of one sequence lie side by side from
    offset 0. Repeated rows are packed each; other columns are ignored; an empty table gives an empty result. The same
    rows come from every action on the result and from a task that is run again.
    """
    scratch = Scratch(df.sparkSession, "packing")
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long"
    end = end_id.to_bytes(4, "little")
    cut = scratch.put(df.select(F.col(id_col).alias("id"), text_of(text_col).alias("t")).mapInArrow(lambda bs: tidied(_cut(bs, size, end, tokenizer)), schema).withColumn("rid", F.monotonically_increasing_id()))
    tokens = cut.agg(F.sum("length")).first()[0] or 0
    dealt = cut.repartition(max(1, math.ceil(tokens / TASK_TOKENS)), "rid").sortWithinPartitions(F.xxhash64("rid"), "rid").drop("rid")
    packed = dealt.mapInArrow(lambda bs: tidied(_pack(bs, size, open_bins, look_ahead)), f"{schema}, sequence_id long, offset long")
    return packed.withColumnRenamed("id", id_col)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(table(spark, sf_dir, "documents"))
