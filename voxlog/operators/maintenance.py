"""Staleness, compaction and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import FULL_KEY, REGION
from .changes import FRAME_BYTES, RECORD_BYTES
from .snapshot import live, sized


def region_stats(log: DataFrame) -> DataFrame:
    """Per region: live keys and bytes, and the bytes of all frames. Lengths are shuffled, never values."""
    log = sized(log)
    frames = log.groupBy(*REGION, "batch_id").agg(F.sum(RECORD_BYTES + F.coalesce("value", F.lit(0))).alias("body"))
    total = frames.groupBy(*REGION).agg(F.sum(F.col("body") + FRAME_BYTES).cast("long").alias("total_bytes"))
    now = live(log).groupBy(*REGION).agg(F.count("*").alias("live_keys"), F.sum(RECORD_BYTES + F.col("value")).cast("long").alias("live_bytes"))
    return total.join(now, list(REGION), "left").na.fill(0, ["live_keys", "live_bytes"])


def stale(stats: DataFrame, min_bytes: int = 16 << 20, live_percent: int = 50, max_segments: int = 64) -> DataFrame:
    """Regions worth compacting: large enough, with something dead, and mostly dead or in too many segments."""
    crowded = F.col("segments") * 4 >= max_segments * 3 if "segments" in stats.columns else F.lit(False)
    return stats.where((F.col("total_bytes") >= min_bytes) & (F.col("live_bytes") != F.col("total_bytes")) & ((F.col("live_bytes") * 100 < F.col("total_bytes") * live_percent) | crowded))


def compacted(log: DataFrame) -> DataFrame:
    """The log rewritten to its live records, which take their region's last batch id; contents stay as they were."""
    last = log.groupBy(*REGION).agg(F.max("batch_id").alias("base_batch_id"))
    return live(log).join(last, list(REGION)).select(*FULL_KEY, F.col("base_batch_id").alias("batch_id"), "value")


def write_stats(log: DataFrame) -> DataFrame:
    """Counters of what was written: frames, records, deletes and raw bytes."""
    return log.agg(
        F.count_distinct(*REGION, "batch_id").alias("writes"),
        F.count("*").alias("records_written"),
        F.count_if(F.col("value").isNull()).alias("deletes"),
        F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).cast("long").alias("raw_bytes"),
    )


def orphans(listed: DataFrame, named: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Files that are there and no manifest names (generation, id), in the folders ``by`` tells."""
    return listed.join(named, [*by, "generation", "id"], "left_anti")


def verification_totals(frames: DataFrame) -> DataFrame:
    """frames: the region columns, valid. Regions, good batches, and regions with problems."""
    by = frames.groupBy(*REGION).agg(F.count_if("valid").alias("batches"), F.bool_or(~F.col("valid")).alias("problem"))
    return by.agg(F.count("*").alias("regions"), F.coalesce(F.sum("batches"), F.lit(0)).cast("long").alias("batches"), F.count_if("problem").alias("problems"))


def latency_summary(samples: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Exact percentiles and the maximum by group."""
    p = lambda q, name: F.percentile(value, q).alias(name)
    return samples.groupBy(*by).agg(p(0.5, "p50"), p(0.95, "p95"), p(0.99, "p99"), p(0.999, "p999"), F.max(value).alias("max"))
