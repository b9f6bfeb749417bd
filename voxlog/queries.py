"""The engine's queries over the driver's tables, each with the same query in SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.keys import FULL_KEY, KEY, REGION, key_valid, level_key, local_key, migrated_component, parse_level_key, parse_region_name, region_name, region_of, slot, unpack
from .operators import aux, changes, maintenance, snapshot
from .plans.log import LOG_SQL, log_of_events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_K = "dimension, chunk_x, chunk_z, component, subchunk_y"
_R = "dimension, region_x, region_z"
_LIVE = f"""
latest as (select * from (select *, row_number() over (partition by {_K} order by batch_id desc, ord desc) as n from log) where n = 1),
live as (select * from latest where value is not null)"""


def query(sql: str, live: bool = True):
    """Registers a query on the record log; ``sql`` follows the common table expressions."""

    def add(f: Callable[[DataFrame], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(log_of_events(spark.read.parquet(os.path.join(sf_dir, "events.parquet"))))
        head = f"with {LOG_SQL}" + (f",{_LIVE}" if live else "")
        SQL[f.__name__] = f"{head}, {sql.strip()[5:]}" if sql.strip().startswith("with ") else f"{head} {sql}"
        return f

    return add


@query(f"select {_K}, batch_id, ord, value from live")
def live_snapshot(log):
    return snapshot.live(log).select(*KEY, "batch_id", "ord", "value")


@query(f"select {_K}, value from live where dimension = 0 and chunk_x = -1 and chunk_z = 23 and component = 50 and subchunk_y = 0")
def point_get(log):
    return snapshot.get(log, 0, -1, 23, 50, 0).select(*KEY, "value")


@query(f"select {_K}, cast(length(value) as bigint) as raw_len from live where dimension = 0 and chunk_x = -1 and chunk_z = 23 and component = 50")
def value_size(log):
    return snapshot.value_size(log, 0, -1, 23, 50)


@query(f"""
with requests as (
  select event_id as request_id, dimension, cast(chunk_x + case when event_id % 10 = 0 then 1000 else 0 end as int) as chunk_x, chunk_z, component, subchunk_y,
    cast(event_id % 12 as bigint) as capacity
  from log)
select r.request_id, case when v.value is null then 'not_found' when length(v.value) > r.capacity then 'buffer_too_small' else 'ok' end as status,
  cast(coalesce(length(v.value), 0) as bigint) as required, case when length(v.value) <= r.capacity then v.value end as value
from requests r left join live v using ({_K})""")
def get_many(log):
    x = (F.col("chunk_x") + F.when(F.col("event_id") % 10 == 0, 1000).otherwise(0)).cast("int")
    requests = log.select(F.col("event_id").alias("request_id"), "dimension", x.alias("chunk_x"), "chunk_z", "component", "subchunk_y", (F.col("event_id") % 12).alias("capacity"))
    return snapshot.get_many(log, requests).na.fill(0, ["required"])


@query("""
select component, subchunk_y, value, cast(row_number() over (order by component * 256 + subchunk_y + 128) as int) as place
from live where dimension = 0 and chunk_x = -1 and chunk_z = 23""")
def chunk_read(log):
    return snapshot.chunk_records(log, 0, -1, 23)


@query(f"""
select {_K}, cast(component * 256 + subchunk_y + 128 as int) as local, cast(length(value) as bigint) as raw_len,
  cast(coalesce(sum(length(value)) over (partition by dimension, chunk_x, chunk_z order by component * 256 + subchunk_y + 128 rows between unbounded preceding and 1 preceding), 0) as bigint) as start
from live""")
def chunk_offsets(log):
    return snapshot.chunk_offsets(log)


@query("select dimension, chunk_x, chunk_z, count(*) as records, cast(sum(length(value)) as bigint) as required from live group by all")
def chunk_summary(log):
    return snapshot.chunk_summary(log)


@query("""
select dimension, chunk_x, chunk_z, string_agg(cast(component * 256 + subchunk_y + 128 as varchar) || '=' || value, ';' order by component * 256 + subchunk_y + 128) as packed,
  count(*) as records_n, cast(sum(length(value)) as bigint) as required
from live group by dimension, chunk_x, chunk_z""")
def chunk_packed(log):
    packed = F.array_join(F.transform("records", lambda r: F.concat(r["local"].cast("string"), F.lit("="), r["value"])), ";")
    return snapshot.chunk_packed(log).select("dimension", "chunk_x", "chunk_z", packed.alias("packed"), "records_n", F.col("required").cast("long").alias("required"))


@query(f"select distinct {_R} from log where dimension <> -2147483648", live=False)
def list_regions(log):
    return snapshot.list_regions(log)


@query("select * from (select distinct dimension, region_x, region_z from log order by 1, 2, 3 limit 5) cross join (select count(*) as total from (select distinct dimension, region_x, region_z from log))", live=False)
def list_regions_first(log):
    """The first five regions and how many there are: a caller with little room learns how much it needs."""
    found = snapshot.list_regions(log)
    return found.limit(5).crossJoin(found.agg(F.count("*").alias("total")))


@query(f"select {_K} from live where dimension = 0 and region_x = -1 and region_z = 0 and component = 47")
def list_keys_component(log):
    return snapshot.list_keys(log, 0, -1, 0, [47])


@query(f"select {_K} from live where component in (47, 49) and chunk_x between -40 and 31 and chunk_z between -33 and 5")
def keys_in_range(log):
    return snapshot.keys_in_range(log, None, -40, 31, -33, 5, [47, 49])


@query(f"select {_K}, cast(row_number() over (partition by dimension, region_x order by chunk_x, chunk_z, component * 256 + subchunk_y + 128) as int) as place from live")
def keys_sorted(log):
    """Key order, shown as a rank within each column of regions."""
    from pyspark.sql.window import Window

    return snapshot.live(log).select(*KEY, F.row_number().over(Window.partitionBy("dimension", "region_x").orderBy("chunk_x", "chunk_z", local_key())).alias("place"))


@query(f"select {_R}, max(batch_id) as last_batch_id from log group by all", live=False)
def last_batch_id(log):
    return snapshot.last_batch_id(log)


@query("""
with f as (select dimension, region_x, region_z, batch_id, 24 + sum(16 + coalesce(length(value), 0)) as bytes from log group by all),
t as (select dimension, region_x, region_z, cast(sum(bytes) as bigint) as total_bytes from f group by all),
l as (select dimension, region_x, region_z, count(*) as live_keys, cast(sum(16 + length(value)) as bigint) as live_bytes from live group by all)
select t.*, coalesce(live_keys, 0) as live_keys, coalesce(live_bytes, 0) as live_bytes from t left join l using (dimension, region_x, region_z)""")
def region_stats(log):
    return maintenance.region_stats(log)


@query("""
with f as (select dimension, region_x, region_z, batch_id, 24 + sum(16 + coalesce(length(value), 0)) as bytes from log group by all),
t as (select dimension, region_x, region_z, cast(sum(bytes) as bigint) as total_bytes from f group by all),
l as (select dimension, region_x, region_z, count(*) as live_keys, cast(sum(16 + length(value)) as bigint) as live_bytes from live group by all),
s as (select t.*, coalesce(live_keys, 0) as live_keys, coalesce(live_bytes, 0) as live_bytes from t left join l using (dimension, region_x, region_z))
select * from s where total_bytes >= 2000 and live_bytes <> total_bytes and live_bytes * 100 < total_bytes * 10""")
def stale_regions(log):
    return maintenance.stale(maintenance.region_stats(log), 2000, 10)


@query(f"""
with j as (select *, count(*) over (partition by {_K}, batch_id) as c, lag(value) over (partition by {_K} order by batch_id, ord) as before from log)
select event_id, {_K}, batch_id, ord from j where c = 1 and value is not distinct from before""", live=False)
def skip_unchanged(log):
    return changes.unchanged(log).select("event_id", *KEY, "batch_id", "ord")


@query(f"select {_K}, batch_id, count(*) as changes from log group by all having count(*) > 1", live=False)
def in_batch_repeats(log):
    return changes.repeats_in_batch(log)


_CUT = "(select cast(floor(max(batch_id) * 0.7) as bigint) from log)"


def _parts(log):
    """The log up to seven tenths of its batches, and after."""
    cut = log.agg(F.floor(F.max("batch_id") * 0.7).cast("long").alias("cut"))
    marked = log.join(F.broadcast(cut))  # one row
    return marked.where("batch_id <= cut").drop("cut"), marked.where("batch_id > cut").drop("cut")


@query(f"""
with b as (select * from (select *, row_number() over (partition by {_K} order by batch_id desc, ord desc) as m from log where batch_id <= {_CUT}) where m = 1 and value is not null),
o as (select *, true as there from (select *, row_number() over (partition by {_K} order by batch_id desc, ord desc) as m from log where batch_id > {_CUT}) where m = 1)
select {_K}, case when o.there then o.value else b.value end as value from b full join o using ({_K})
where case when o.there then o.value else b.value end is not null""", live=False)
def overlay_merge(log):
    return snapshot.overlay(*_parts(log)).select(*KEY, "value")


@query(f"""
with b as (select * from (select *, row_number() over (partition by {_K} order by batch_id desc, ord desc) as m from log where batch_id <= {_CUT}) where m = 1 and value is not null),
o as (select *, true as there from (select *, row_number() over (partition by {_K} order by batch_id desc, ord desc) as m from log where batch_id > {_CUT}) where m = 1)
select {_K}, case when o.there is null then 'absent' when o.value is null then 'deleted' else 'value' end as state from b full join o using ({_K})""", live=False)
def overlay_lookup_state(log):
    return snapshot.overlay_state(*_parts(log))


@query(f"""
with a as (select * from (select *, row_number() over (partition by {_K} order by batch_id desc, ord desc) as m from log where batch_id <= {_CUT}) where m = 1 and value is not null)
select {_K}, a.value as old_value, c.value as new_value, case when a.value is null then 'added' when c.value is null then 'removed' else 'changed' end as change
from a full join live c using ({_K}) where a.value is distinct from c.value""")
def diff_versions(log):
    return snapshot.diff(snapshot.live(_parts(log)[0]), snapshot.live(log)).select(*KEY, "old_value", "new_value", "change")


@query(f"select {_K}, batch_id, value from (select *, row_number() over (partition by {_K} order by batch_id desc, ord desc) as m from log where batch_id <= {_CUT}) where m = 1 and value is not null", live=False)
def as_of(log):
    return snapshot.live(_parts(log)[0]).select(*KEY, "batch_id", "value")


@query("select batch_id, ord, value, cast(row_number() over (order by batch_id, ord) as int) as version from log where dimension = 0 and chunk_x = -1 and chunk_z = 23 and component = 50", live=False)
def history(log):
    return snapshot.history(log, 0, -1, 23, 50)


@query(f"select {_K}, region_x, region_z, max(l.batch_id) over (partition by dimension, region_x, region_z) as batch_id, value from (select *, 1 as alive from live union all select *, 0 from log left join (select 1 as n) on true) l qualify alive = 1")
def compaction_rewrite(log):
    return maintenance.compacted(log)


@query(f"""
with f as (select {_R}, event_id as position, cast(event_id + (event_id * 3701) % 1009 as bigint) as batch_id from log)
select * from f qualify batch_id > greatest(coalesce(max(batch_id) over (partition by {_R} order by position rows between unbounded preceding and 1 preceding), 0), 0)""", live=False)
def batch_order_accept(log):
    """Of each region's frames those whose number exceeds all before."""
    return changes.accepted(log.select(*REGION, F.col("event_id").alias("position"), (F.col("event_id") + (F.col("event_id") * 3701) % 1009).alias("batch_id")), by=REGION)


@query(f"""
with f as (select {_R}, event_id as position, case when event_id % 50 = 0 then 2 else 1 end as kind, cast(event_id % 2 as bigint) as batch_id from log)
select *, kind = 1 or (coalesce(sum(case when kind = 1 then 1 else 0 end) over (partition by {_R} order by position rows between unbounded preceding and 1 preceding), 0) = 0 and batch_id = 0) as in_place from f""", live=False)
def base_frames(log):
    frames = log.select(*REGION, F.col("event_id").alias("position"), F.when(F.col("event_id") % 50 == 0, 2).otherwise(1).alias("kind"), (F.col("event_id") % 2).alias("batch_id"))
    return changes.base_in_place(frames, 0, by=REGION)


@query("select distinct dimension, region_x, region_z, lower(right(concat('0000000', hex(cast(dimension as bigint) & 4294967295)), 8)) || '-' || lower(right(concat('0000000', hex(cast(region_x as bigint) & 4294967295)), 8)) || '-' || lower(right(concat('0000000', hex(cast(region_z as bigint) & 4294967295)), 8)) || '.region' as name, region_x as parsed_x, region_z as parsed_z from log", live=False)
def region_names(log):
    named = log.select(*REGION).distinct().withColumn("name", region_name())
    return named.select(*REGION, "name", parse_region_name("name")["x"].alias("parsed_x"), parse_region_name("name")["z"].alias("parsed_z"))


@query(f"""
select distinct {_K}, region_x, region_z, cast((chunk_z & 31) * 32 + (chunk_x & 31) as int) as slot, cast(component * 256 + subchunk_y + 128 as int) as local, chunk_x as unpacked_x, chunk_z as unpacked_z from log""", live=False)
def key_packing(log):
    packed = log.select(*KEY, "region_x", "region_z").distinct().withColumns({"slot": slot(), "local": local_key()})
    back = unpack("region_x", "region_z", "slot", "local")
    return packed.withColumns({"unpacked_x": back["chunk_x"], "unpacked_z": back["chunk_z"]})


@query("""
select event_id, cast(component + event_id % 300 as int) as component, cast(event_id % 400 - 200 as int) as subchunk_y,
  component + event_id % 300 between 0 and 255 and case when component + event_id % 300 = 47 then event_id % 400 - 200 between -128 and 127 else event_id % 400 - 200 = 0 end as valid
from log""", live=False)
def key_validation(log):
    odd = log.select("event_id", (F.col("component") + F.col("event_id") % 300).cast("int").alias("component"), (F.col("event_id") % 400 - 200).cast("int").alias("subchunk_y"))
    return odd.withColumn("valid", key_valid())


def _le_sql(c: str) -> str:
    h = f"right(concat('0000000', hex(cast({c} as bigint) & 4294967295)), 8)"
    return f"upper(substr({h}, 7, 2) || substr({h}, 5, 2) || substr({h}, 3, 2) || substr({h}, 1, 2))"


@query(f"""
select distinct {_K}, {_le_sql('chunk_x')} || {_le_sql('chunk_z')} || case when dimension = 0 then '' else {_le_sql('dimension')} end || upper(hex(component))
  || case when component = 47 then upper(right(concat('0', hex(cast(subchunk_y as bigint) & 255)), 2)) else '' end as raw, true as same from log""", live=False)
def raw_key_routing(log):
    """Raw keys in hex, and that parsing gives the key back."""
    raw = log.select(*KEY).distinct().withColumn("k", level_key())
    return raw.select(*KEY, F.hex("k").alias("raw"), parse_level_key("k").eqNullSafe(F.struct(*KEY)).alias("same"))


@query("select event_id, cast([47, 43, 49, 50, 45, 44][event_id % 6 + 1] as int) as component from log", live=False)
def component_migration(log):
    return log.select("event_id", migrated_component(F.col("event_id") % 6).alias("component"))


@query("""
with a as (select 'player_' || cast(user_id % 40 as varchar) as key, event_id as seq, case when event_type = 'error' then null else event_type end as value from events)
select key, value from (select *, row_number() over (partition by key order by seq desc) as n from a) where n = 1 and value is not null""", live=False)
def _aux(log):
    return log


def aux_live(spark, sf_dir):
    e = spark.read.parquet(os.path.join(sf_dir, "events.parquet"))
    rows = e.select(F.concat(F.lit("player_"), (F.col("user_id") % 40).cast("string")).alias("key"), F.col("event_id").alias("batch_id"), F.lit(0).alias("ord"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("value"))
    return aux.aux_live(rows).select("key", "value")


QUERIES["aux_live"], SQL["aux_live"] = aux_live, SQL.pop("_aux")
del QUERIES["_aux"]


@query(f"select concat_ws('/', {_K}) as key, event_id as sequence, value from (select *, row_number() over (partition by {_K} order by event_id desc) as m from log) where m = 1 and value is not null", live=False)
def lsm_merge(log):
    """Three sorted sources with tombstones, merged: the newest of each key wins."""
    rows = log.select(F.concat_ws("/", *KEY).alias("key"), F.col("event_id").alias("sequence"), F.when(F.col("value").isNull(), 0).otherwise(1).alias("kind"), "value")
    return snapshot.merge_newest(*[rows.where(F.col("sequence") % 3 == i) for i in range(3)]).select("key", "sequence", "value")


@query(f"""
with a as (select * from (select *, row_number() over (partition by {_K} order by batch_id desc, ord desc) as m from log where batch_id <= {_CUT}) where m = 1 and value is not null),
x as (select concat_ws('/', {_K}) as key, value from a), y as (select concat_ws('/', {_K}) as key, value from live)
select key, x.value as old_value, y.value as new_value, case when x.value is null then 'added' when y.value is null then 'removed' else 'changed' end as change
from x full join y using (key) where x.value is distinct from y.value order by key limit 1""")
def first_difference(log):
    named = lambda df: df.select(F.concat_ws("/", *KEY).alias("key"), "value")
    return snapshot.first_difference(named(snapshot.live(_parts(log)[0])), named(snapshot.live(log)))


@query("""
select batch_id, count(*) as records, cast(sum(16 + coalesce(length(value), 0)) as bigint) as body,
  case when count(distinct (dimension, region_x, region_z)) > 1 then 'RegionMismatch' end as problem from log group by batch_id""", live=False)
def batch_validation(log):
    return changes.validate_batches(log)


@query("""
with b as (select cast(floor(batch_id / 20.0) as bigint) as group_id, batch_id as position, case when batch_id % 7 = 0 then 0 when batch_id % 11 = 0 then 1 else batch_id end as batch_id, count(*) as records from log group by log.batch_id),
c as (select *, max(batch_id) over (partition by group_id order by position rows between unbounded preceding and 1 preceding) as before from b)
select group_id, count(*) as batches, cast(sum(records) as bigint) as records,
  case when count(*) > 64 or sum(records) > 4096 then 'BatchTooLarge' when bool_or(batch_id <> 0 and batch_id <= coalesce(before, 0)) then 'BatchOrder' end as problem
from c group by group_id""", live=False)
def group_validation(log):
    b = F.col("batch_id")
    batches = log.groupBy("batch_id").agg(F.count("*").alias("records")).select(
        F.floor(b / 20.0).cast("long").alias("group_id"), b.alias("position"), F.when(b % 7 == 0, 0).when(b % 11 == 0, 1).otherwise(b).alias("batch_id"), "records", *[F.lit(0).alias(c) for c in REGION]
    )
    return changes.validate_groups(batches)


@query(f"""
with l as (select * from (select *, row_number() over (partition by {_K} order by batch_id desc, ord desc) as m from log where batch_id > {_CUT}) where m = 1),
b as (select * from (select *, row_number() over (partition by {_K} order by batch_id desc, ord desc) as m from log where batch_id <= {_CUT}) where m = 1 and value is not null),
j as (select {_R}, b.batch_id is not null as there, l.batch_id is not null as touched, l.value is not null as puts from b full join l using ({_K}, region_x, region_z))
select {_R}, count(*) filter (there) as keys_before, count(*) filter (case when touched then puts else there end) as keys_after, count(*) filter (case when touched then puts else there end) <= 50 as admitted
from j where ({_R}) in (select {_R} from l) group by {_R}""", live=False)
def key_admission(log):
    base, more = _parts(log)
    return changes.admitted(snapshot.live(base), more, 50)


@query("""
select count(distinct (dimension, region_x, region_z, batch_id)) as writes, count(*) as records_written, count(*) filter (value is null) as deletes,
  cast(coalesce(sum(length(value)), 0) as bigint) as raw_bytes from log""", live=False)
def write_stats(log):
    return maintenance.write_stats(log)


@query("""
with e as (select event_type, value from events where value is not null)
select event_type, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99,
  round(quantile_cont(value, 0.999), 6) as p999, max(value) as max from e group by event_type""", live=False)
def _latency(log):
    return log


def latency_summary(spark, sf_dir):
    return maintenance.latency_summary(spark.read.parquet(os.path.join(sf_dir, "events.parquet")).select("event_type", "value"), ["event_type"]).select("event_type", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99", "p999")], "max")


QUERIES["latency_summary"], SQL["latency_summary"] = latency_summary, SQL.pop("_latency")
del QUERIES["_latency"]


from . import stored_queries  # noqa: E402, F401  registers the queries over stored worlds


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["region_stats"](spark, sf_dir)
