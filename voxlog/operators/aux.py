"""Auxiliary records: any raw byte key with any value. Keys with the exact layout of a chunk record belong to the record log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import METADATA, level_key, parse_level_key
from .snapshot import live

BUCKETS = 16


def bucket(key: Column | str = "key") -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def route(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """raw: key, value. (chunk records with their key columns, auxiliary records)."""
    parsed = raw.withColumn("_k", parse_level_key("key"))
    chunk = parsed.where("_k is not null").select("_k.*", "value")
    return chunk, parsed.where("_k is null").select("key", "value")


def aux_live(log: DataFrame) -> DataFrame:
    return live(log, ("key",))


def aux_get(log: DataFrame, key: bytes) -> DataFrame:
    return aux_live(log.where(F.col("key") == F.lit(key)))


def raw_records(records: DataFrame, aux: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all raw (key, value) of live records and live auxiliary ones, conflicts).

    An auxiliary copy of a chunk metadata record that equals the native one is dropped; a different one is a conflict.
    """
    native = records.select(level_key().alias("key"), "value", "component")
    meta = native.where(F.col("component") == METADATA).select("key", F.col("value").alias("native"))
    held = aux.join(meta, "key", "left")
    conflicts = held.where("native is not null and native <> value").select("key")
    return native.select("key", "value").unionByName(held.where("native is null").select("key", "value")), conflicts
