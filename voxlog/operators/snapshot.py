"""Reads of a record log: live snapshots, point, batched, chunk and range reads, overlays and differences.

Latest-per-key is a window with ``row_number() = 1``: Spark cuts it to one row per key and task before the shuffle, and
filters on key columns go below it, to partitions and row groups, because the region columns are among its keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import RangeTooLarge
from ..functions.keys import AUX_DIMENSION, CHUNK, FULL_KEY, KEY, REGION, local_key, matches

MAX_RANGE_REGIONS = 1024


def latest(log: DataFrame, keys: tuple[str, ...] = FULL_KEY, order: tuple[str, ...] = ("batch_id", "ord")) -> DataFrame:
    """The last change of every key, deletes included."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return log.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def live(log: DataFrame, keys: tuple[str, ...] = FULL_KEY, order: tuple[str, ...] = ("batch_id", "ord")) -> DataFrame:
    return latest(log, keys, order).where("value is not null")


def sized(log: DataFrame) -> DataFrame:
    """The log with each value's length in its place (null for a delete), so that reads which need no bytes shuffle none.

    A stored log has the lengths in a column of their own, and its values aren't even read.
    """
    size = F.when(~F.col("is_delete"), F.col("raw_len")) if "raw_len" in log.columns else F.octet_length("value")
    return log.withColumn("value", size.cast("long"))


def as_of(log: DataFrame, batch_id: int) -> DataFrame:
    """The live snapshot after a batch (an extension: the log keeps what it needs)."""
    return live(log.where(F.col("batch_id") <= batch_id))


def key_is(dimension: int, chunk_x: int, chunk_z: int, component: int, subchunk_y: int = 0) -> Column:
    return chunk_is(dimension, chunk_x, chunk_z) & (F.col("component") == component) & (F.col("subchunk_y") == subchunk_y)


def chunk_is(dimension: int, chunk_x: int, chunk_z: int) -> Column:
    return (F.col("dimension") == dimension) & (F.col("region_x") == chunk_x >> 5) & (F.col("region_z") == chunk_z >> 5) & (F.col("chunk_x") == chunk_x) & (F.col("chunk_z") == chunk_z)


def get(log: DataFrame, *key: int) -> DataFrame:
    """At most one row."""
    return live(log.where(key_is(*key)))


def value_size(log: DataFrame, *key: int) -> DataFrame:
    """The length alone; with a stored raw_len the value isn't read."""
    return get(sized(log), *key).select(*KEY, F.col("value").alias("raw_len"))


def get_many(log: DataFrame, requests: DataFrame) -> DataFrame:
    """requests: request_id, the key columns, capacity. One row each: status, required bytes, and the value if it fits.

    The requests side is small next to the log; its regions are joined in first, so the log is cut to them before the
    window. Order by request_id for the caller's order.
    """
    from ..plans.log import with_region

    asked = with_region(requests)
    here = log.join(asked.select(*REGION).distinct(), list(REGION), "left_semi")
    found = live(here).select(*FULL_KEY, "value")
    size = F.octet_length("value").cast("long")
    status = F.when(F.col("value").isNull(), "not_found").when(size > F.col("capacity"), "buffer_too_small").otherwise("ok")
    return asked.join(found, list(FULL_KEY), "left").select("request_id", status.alias("status"), size.alias("required"), F.when(size <= F.col("capacity"), F.col("value")).alias("value"))


def chunk_records(log: DataFrame, dimension: int, chunk_x: int, chunk_z: int) -> DataFrame:
    """The live records of a chunk in local-key order, with that order as ``place``."""
    found = live(log.where(chunk_is(dimension, chunk_x, chunk_z)))
    return found.select("component", "subchunk_y", "value", F.row_number().over(Window.partitionBy(*CHUNK).orderBy(local_key())).alias("place")).orderBy("place")


def chunk_packed(log: DataFrame) -> DataFrame:
    """One row per chunk: its live records in local-key order as an array, their count and total bytes."""
    one = F.struct(local_key().alias("local"), "component", "subchunk_y", "value")
    return live(log).groupBy(*CHUNK).agg(F.array_sort(F.collect_list(one)).alias("records"), F.count("*").alias("records_n"), F.sum(F.octet_length("value")).alias("required"))


def chunk_offsets(log: DataFrame) -> DataFrame:
    """Where each live record starts in its chunk's buffer."""
    before = Window.partitionBy(*CHUNK).orderBy("local").rowsBetween(Window.unboundedPreceding, -1)
    at = live(sized(log)).withColumn("local", local_key()).withColumn("raw_len", F.col("value"))
    return at.select(*KEY, "local", "raw_len", F.coalesce(F.sum("raw_len").over(before), F.lit(0)).alias("start"))


def chunk_summary(log: DataFrame) -> DataFrame:
    return live(sized(log)).groupBy(*CHUNK).agg(F.count("*").alias("records"), F.sum("value").alias("required"))


def list_keys(log: DataFrame, dimension: int, region_x: int, region_z: int, components: list[int] | None = None) -> DataFrame:
    """Keys of a region in key order; a missing region is empty."""
    here = (F.col("dimension") == dimension) & (F.col("region_x") == region_x) & (F.col("region_z") == region_z)
    return live(sized(log.where(here & matches(components)))).select(*KEY).orderBy(*CHUNK, local_key())


def keys_in_range(log: DataFrame, dimension: int | None, min_x: int, max_x: int, min_z: int, max_z: int, components: list[int] | None = None) -> DataFrame:
    """Live keys in inclusive chunk bounds, in key order. Inverted bounds are empty; too many regions are refused."""
    if min_x <= max_x and min_z <= max_z and ((max_x >> 5) - (min_x >> 5) + 1) * ((max_z >> 5) - (min_z >> 5) + 1) > MAX_RANGE_REGIONS:
        raise RangeTooLarge(f"x {min_x} to {max_x}, z {min_z} to {max_z}")
    keep = matches(components, min_x, max_x, min_z, max_z)
    if dimension is not None:
        keep = keep & (F.col("dimension") == dimension)
    return live(sized(log.where(keep))).select(*KEY).orderBy(*CHUNK, local_key())


def list_regions(log: DataFrame) -> DataFrame:
    """Every region that was ever written, one whose keys are all deleted too; never the auxiliary dimension."""
    return log.where(F.col("dimension") != AUX_DIMENSION).select(*REGION).distinct().orderBy(*REGION)


def last_batch_id(log: DataFrame) -> DataFrame:
    return log.groupBy(*REGION).agg(F.max("batch_id").alias("last_batch_id"))


def history(log: DataFrame, *key: int) -> DataFrame:
    """All changes of a key, oldest first, with that order as ``version`` (an extension)."""
    w = Window.partitionBy(*FULL_KEY).orderBy("batch_id", "ord")
    return log.where(key_is(*key)).select("batch_id", "ord", "value", F.row_number().over(w).alias("version")).orderBy("version")


def overlay(base: DataFrame, over: DataFrame) -> DataFrame:
    """Live records of a base log under an overlay log: an overlay's delete hides the base, a put replaces it."""
    both = live(base).withColumn("_layer", F.lit(0)).select(*FULL_KEY, "value", "_layer").unionByName(latest(over).withColumn("_layer", F.lit(1)).select(*FULL_KEY, "value", "_layer"))
    return live(both, order=("_layer",)).drop("_layer")


def overlay_state(base: DataFrame, over: DataFrame) -> DataFrame:
    """What the overlay says of each key of either: absent, deleted or value. A delete counts though the base lacks the key."""
    b, o = live(sized(base)).select(*FULL_KEY), latest(sized(over)).select(*FULL_KEY, "value", F.lit(True).alias("there"))
    state = F.when(F.col("there").isNull(), "absent").when(F.col("value").isNull(), "deleted").otherwise("value")
    return b.join(o, list(FULL_KEY), "full_outer").select(*KEY, state.alias("state"))


def diff(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = FULL_KEY) -> DataFrame:
    """Keys of two live snapshots whose values differ: added, removed or changed."""
    a, b = old.select(*keys, F.col("value").alias("old_value")), new.select(*keys, F.col("value").alias("new_value"))
    change = F.when(F.col("old_value").isNull(), "added").when(F.col("new_value").isNull(), "removed").otherwise("changed")
    return a.join(b, list(keys), "full_outer").where(~F.col("old_value").eqNullSafe(F.col("new_value"))).withColumn("change", change)


def first_difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """The first differing raw key in byte order, or no row."""
    return diff(old, new, ("key",)).orderBy("key").limit(1)


def merge_newest(*sources: DataFrame) -> DataFrame:
    """Merges sources (key, sequence, kind 0 delete or 1 put, value): the newest of each key wins, deletes go."""
    both = sources[0]
    for s in sources[1:]:
        both = both.unionByName(s)
    w = Window.partitionBy("key").orderBy(F.desc("sequence"))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1 and kind = 1").drop("_n")
