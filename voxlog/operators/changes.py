"""Checks and rewrites of changes before they are written, and the order in which a log accepts batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.keys import FULL_KEY, KEY, REGION, key_valid, region_valid

# Limits of the data model.
MAX_RECORDS, MAX_BATCHES, MAX_BODY, MAX_VALUE, MAX_KEYS = 4096, 64, 64 << 20, 16 << 20, 65536
RECORD_BYTES, FRAME_BYTES = 16, 24


def validate_batches(changes: DataFrame) -> DataFrame:
    """One row per batch_id: the problem that refuses the batch, or null."""
    size = F.coalesce(F.octet_length("value"), F.lit(0))
    facts = changes.groupBy("batch_id").agg(
        F.count("*").alias("records"),
        F.count_distinct(*REGION).alias("regions"),
        F.sum(size + RECORD_BYTES).alias("body"),
        F.max(size).alias("largest"),
        F.bool_and(key_valid() & region_valid()).alias("valid"),
    )
    problem = (
        F.when(~F.col("valid"), "InvalidArgument")
        .when(F.col("regions") > 1, "RegionMismatch")
        .when((F.col("records") > MAX_RECORDS) | (F.col("body") > MAX_BODY) | (F.col("largest") > MAX_VALUE), "BatchTooLarge")
    )
    return facts.select("batch_id", "records", F.col("body").cast("long").alias("body"), problem.alias("problem"))


def validate_groups(batches: DataFrame) -> DataFrame:
    """batches: group_id, position, batch_id (0: to be assigned), the region columns, records. One row per group."""
    w = Window.partitionBy("group_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    seen = batches.withColumn("before", F.max("batch_id").over(w))
    facts = seen.groupBy("group_id").agg(
        F.count("*").alias("batches"),
        F.count_distinct(*REGION).alias("regions"),
        F.sum("records").cast("long").alias("records"),
        F.bool_or((F.col("batch_id") != 0) & (F.col("batch_id") <= F.coalesce("before", F.lit(0)))).alias("backwards"),
    )
    problem = (
        F.when(F.col("regions") > 1, "RegionMismatch").when((F.col("batches") > MAX_BATCHES) | (F.col("records") > MAX_RECORDS), "BatchTooLarge").when(F.col("backwards"), "BatchOrder")
    )
    return facts.select("group_id", "batches", "records", problem.alias("problem"))


def assign_ids(last: int, ids: list[int]) -> list[int]:
    """Ids of a region's new batches in order: 0 takes the next, a given one must exceed all before it."""
    from ..errors import BatchOrder

    out = []
    for i in ids:
        if i and i <= last:
            raise BatchOrder(f"{i} after {last}")
        last = i or last + 1
        out.append(last)
    return out


def is_unchanged() -> Column:
    """A change that leaves its key as it was; null is a delete and also no record. Repeats within a batch never count."""
    repeats = F.count("*").over(Window.partitionBy(*FULL_KEY, "batch_id"))
    before = F.lag("value").over(Window.partitionBy(*FULL_KEY).orderBy("batch_id", "ord"))
    return (repeats == 1) & F.col("value").eqNullSafe(before)


def unchanged(log: DataFrame) -> DataFrame:
    """The no-op changes of a log."""
    return log.withColumn("_same", is_unchanged()).where("_same").drop("_same")


def skip_unchanged(batch: DataFrame, live: DataFrame) -> DataFrame:
    """The changes of one batch that change something, held against the live records they touch."""
    now = live.join(batch.select(*FULL_KEY).distinct(), list(FULL_KEY), "left_semi").select(*FULL_KEY, F.col("value").alias("_now"))
    repeats = F.count("*").over(Window.partitionBy(*FULL_KEY))
    judged = batch.withColumn("_n", repeats).join(now, list(FULL_KEY), "left")
    return judged.where((F.col("_n") > 1) | ~F.col("value").eqNullSafe(F.col("_now"))).drop("_n", "_now")


def repeats_in_batch(log: DataFrame) -> DataFrame:
    return log.groupBy(*KEY, "batch_id").agg(F.count("*").alias("changes")).where("changes > 1")


def accepted(frames: DataFrame, by: tuple[str, ...], position: str = "position", base: int = 0) -> DataFrame:
    """Of the frames of each ``by`` those whose batch_id exceeds every accepted one before; that is exceeding every one before, accepted or not."""
    w = Window.partitionBy(*by).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    return frames.withColumn("_before", F.max("batch_id").over(w)).where(F.col("batch_id") > F.greatest(F.coalesce("_before", F.lit(base)), F.lit(base))).drop("_before")


def base_in_place(frames: DataFrame, base_batch_id: int | Column, by: tuple[str, ...], position: str = "position") -> DataFrame:
    """Adds ``in_place``: compacted base frames (kind 2) carry the base id and stand before every ordinary frame (kind 1)."""
    w = Window.partitionBy(*by).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    ordinary = F.coalesce(F.sum((F.col("kind") == 1).cast("int")).over(w), F.lit(0))
    base = base_batch_id if isinstance(base_batch_id, Column) else F.lit(base_batch_id)
    return frames.withColumn("in_place", (F.col("kind") == 1) | ((ordinary == 0) & (F.col("batch_id") == base)))


def valid_prefix(frames: DataFrame, by: tuple[str, ...], position: str = "position") -> DataFrame:
    """The frames before the first that is not valid."""
    w = Window.partitionBy(*by).orderBy(position).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return frames.withColumn("_ok", F.min(F.col("valid").cast("int")).over(w)).where("_ok = 1").drop("_ok")


def admitted(live: DataFrame, changes: DataFrame, max_keys: int = MAX_KEYS) -> DataFrame:
    """Per region with changes: keys before and after, and whether the net number stays within the limit."""
    from .snapshot import latest, sized

    last = latest(sized(changes)).select(*FULL_KEY, F.col("value").isNotNull().alias("puts"))
    now = live.join(last.select(*REGION).distinct(), list(REGION), "left_semi").select(*FULL_KEY, F.lit(True).alias("there"))
    both = now.join(last, list(FULL_KEY), "full_outer")
    out = both.groupBy(*REGION).agg(F.count("there").alias("keys_before"), F.count_if(F.coalesce("puts", "there")).alias("keys_after"))
    return out.withColumn("admitted", F.col("keys_after") <= max_keys)
