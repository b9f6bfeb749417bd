"""The record log: an append-only table of puts and deletes, and the adapter that reads one out of ``events``.

Columns: the five of a key, region_x, region_z, batch_id (strictly increasing in a region), ord (place in its batch) and
value; a null value is a delete, an empty one is a value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import region_of


def with_region(df: DataFrame) -> DataFrame:
    return df.withColumns({"region_x": region_of("chunk_x"), "region_z": region_of("chunk_z")})


def log_of_events(events: DataFrame) -> DataFrame:
    """A record log with deletes, repeats within batches, no-op puts and negative coordinates, made of ``events``."""
    e, user = F.col("event_id"), F.col("user_id")
    kind = F.pmod(e, F.lit(5))
    component = F.when(kind == 0, 43).when(kind == 1, 44).when(kind == 2, 47).when(kind == 3, 49).otherwise(50)
    value = F.concat("event_type", F.lit(":"), (F.floor("value").cast("long") % 3).cast("string"))
    return with_region(
        events.select(
            e,
            (user % 2).cast("int").alias("dimension"),
            (user - 75).cast("int").alias("chunk_x"),
            ((user * 7) % 90 - 45).cast("int").alias("chunk_z"),
            component.cast("int").alias("component"),
            F.when(kind == 2, e % 9 - 4).otherwise(0).cast("int").alias("subchunk_y"),
            (F.floor(e / 8.0).cast("long") + 1).alias("batch_id"),
            (e % 8).cast("int").alias("ord"),
            F.when(F.col("event_type") != "error", value).alias("value"),
        )
    )


#: The same log in SQL, for engines that read the same tables.
LOG_SQL = """
log as (
  select *, cast(floor(chunk_x / 32.0) as int) as region_x, cast(floor(chunk_z / 32.0) as int) as region_z from (
    select event_id, cast(user_id % 2 as int) as dimension,
      cast(user_id - 75 as int) as chunk_x, cast((user_id * 7) % 90 - 45 as int) as chunk_z,
      cast(case event_id % 5 when 0 then 43 when 1 then 44 when 2 then 47 when 3 then 49 else 50 end as int) as component,
      cast(case when event_id % 5 = 2 then event_id % 9 - 4 else 0 end as int) as subchunk_y,
      cast(floor(event_id / 8.0) as bigint) + 1 as batch_id, cast(event_id % 8 as int) as ord,
      case when event_type = 'error' then null
           else concat(event_type, ':', cast(cast(floor(value) as bigint) % 3 as varchar(10))) end as value
    from events))
"""
