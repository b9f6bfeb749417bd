"""Queries over stored worlds, binary formats, conversions and streams, each with the same query in SQL.

Every query builds its world or files out of ``events`` in the shared work folder and reads them back through the operator,
so what the SQL computes from ``events`` alone must have survived the way there and back. What several queries read is
built once for a session.
"""

from __future__ import annotations

import io
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import cli, tools
from .errors import STATUSES, WorldError
from .functions.checksums import crc32c, lz4_compress, lz4_decompress, mask, put_varint
from .functions.keys import KEY, METADATA, REGION, level_key, parse_region_name
from .operators import aux, changes, maintenance, snapshot
from .plans.log import LOG_SQL, log_of_events, with_region
from .queries import _CUT, _K, _LIVE, _R, QUERIES, SQL, _le_sql, _parts
from .sources import dataset, legacy, leveldb, native
from .storage import put_file, tasks, work_folder
from .streaming import ingest as streams
from .world import CHANGES_SCHEMA, Options, Overlay, World, as_batches, library_info, problem_text

_BUILT: dict[tuple, str] = {}


def query(sql: str, live: bool = True):
    """Registers f(spark, log); ``sql`` follows the common table expressions of the log."""

    def add(f: Callable[[SparkSession, DataFrame], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark, _log(spark, sf_dir))
        head = f"with {LOG_SQL}" + (f",{_LIVE}" if live else "")
        SQL[f.__name__] = f"{head}, {sql.strip()[5:]}" if sql.strip().startswith("with ") else f"{head} {sql}"
        return f

    return add


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_of_events(spark.read.parquet(os.path.join(sf_dir, "events.parquet")))


def _built(spark: SparkSession, log: DataFrame, kind: str, build: Callable[[str], object]) -> str:
    """The folder of what ``build`` makes of a log, made once."""
    key = (spark.sparkContext.applicationId, tuple(log.inputFiles()), kind)
    if key not in _BUILT:
        at = work_folder(spark, kind)
        build(at)
        _BUILT[key] = at
    return _BUILT[key]


def _changes(log: DataFrame) -> DataFrame:
    """The log as changes to write, with its batch ids."""
    return log.select(*KEY, F.col("batch_id").cast("int").alias("batch"), "ord", F.col("value").cast("binary").alias("value"), "batch_id")


def _write(spark: SparkSession, log: DataFrame, at: str, options: Options | None = None) -> World:
    world = World(spark, at, options)
    for part in _parts(log):
        world.write(_changes(part))
    return world


def _world(spark: SparkSession, log: DataFrame) -> World:
    """A world that was written in two commits, opened again."""
    return World(spark, _built(spark, log, "world", lambda at: _write(spark, log, at).close()), create=False)


def _text(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.col("value").cast("string"))


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


@query(f"select {_K}, batch_id, ord, value from live")
def world_snapshot(spark, log):
    return _text(_world(spark, log).live().select(*KEY, "batch_id", "ord", "value"))


@query(f"""
with requests as (
  select event_id as request_id, dimension, cast(chunk_x + case when event_id % 10 = 0 then 1000 else 0 end as int) as chunk_x, chunk_z, component, subchunk_y, cast(event_id % 12 as bigint) as capacity from log)
select r.request_id, case when v.value is null then 'not_found' when length(v.value) > r.capacity then 'buffer_too_small' else 'ok' end as status,
  cast(coalesce(length(v.value), 0) as bigint) as required, case when length(v.value) <= r.capacity then v.value end as value
from requests r left join live v using ({_K})""")
def world_get_many(spark, log):
    x = (F.col("chunk_x") + F.when(F.col("event_id") % 10 == 0, 1000).otherwise(0)).cast("int")
    requests = log.select(F.col("event_id").alias("request_id"), "dimension", x.alias("chunk_x"), "chunk_z", "component", "subchunk_y", (F.col("event_id") % 12).alias("capacity"))
    return _text(_world(spark, log).get_many(requests).na.fill(0, ["required"]))


@query("""
select component, subchunk_y, value, cast(row_number() over (order by component * 256 + subchunk_y + 128) as int) as place,
  (select count(*) from live where dimension = 0 and chunk_x = -1 and chunk_z = 23) as total,
  cast((select sum(length(value)) from live where dimension = 0 and chunk_x = -1 and chunk_z = 23) as bigint) as required
from live where dimension = 0 and chunk_x = -1 and chunk_z = 23""")
def world_chunk(spark, log):
    found, n, required = _world(spark, log).read_chunk(0, -1, 23, 1 << 20, 1 << 30)
    schema = "component int, subchunk_y int, value string, place int, total long, required long"
    return _rows(spark, [(c, y, v.decode(), i + 1, n, required) for i, (c, y, v) in enumerate(found)], schema)


@query(f"select {_K} from live where dimension = 0 and component in (47, 49) and chunk_x between -40 and 31 and chunk_z between -33 and 5")
def world_keys_in_range(spark, log):
    return _world(spark, log).keys_in_range(0, -40, 31, -33, 5, [47, 49])


@query(f"select {_R}, max(batch_id) as last_batch_id, (select count(*) from (select distinct {_R} from log)) as total from log group by {_R}", live=False)
def world_regions(spark, log):
    world = _world(spark, log)
    found, total = world.list_regions(1 << 30)
    last = {r[:3]: r[3] for r in world.last_batch_ids()}
    return _rows(spark, [(*r, last[r], total) for r in found], "dimension int, region_x int, region_z int, last_batch_id long, total long")


@query(f"""
with last as (select {_R}, max(batch_id) as last from log group by {_R})
select {_K}, region_x, region_z, last as batch_id, value, cast(0 as bigint) as orphans, cast(0 as bigint) as problems from live join last using ({_R})""")
def world_compact(spark, log):
    """Every region rewritten to its live records in one commit, then the replaced files deleted and all checked."""
    world = _write(spark, log, work_folder(spark, "compact"))
    world.compact_async(0, -1, 0)
    world.wait()
    world.compact_world()
    world.vacuum()
    orphans, problems = len(world.orphans()), world.verify()["problems"]
    return _text(World(spark, world.files.root, create=False).live().select(*KEY, "region_x", "region_z", "batch_id", "value")).withColumns({"orphans": F.lit(orphans).cast("long"), "problems": F.lit(problems).cast("long")})


@query(f"select {_K}, batch_id, value, false as elsewhere from live")
def buffered_read(spark, log):
    """What is buffered is read by its writer before it is committed, and by nobody else."""
    before, after = _parts(log)
    world = World(spark, work_folder(spark, "buffered"))
    world.write(_changes(before), sync=False)
    world.write(_changes(after), sync=False)
    return _text(world.live().select(*KEY, "batch_id", "value")).withColumn("elsewhere", F.lit(bool(World(spark, world.files.root).regions())))


@query(f"""
select count(distinct ({_R}, batch_id)) as writes, count(*) as records_written, count(*) filter (value is null) as deletes, cast(coalesce(sum(length(value)), 0) as bigint) as raw_bytes from log""", live=False)
def counters_after_compaction(spark, log):
    world = _write(spark, log, work_folder(spark, "counters"))
    world.compact_world()
    got = World(spark, world.files.root).counters()
    names = ("writes", "records_written", "deletes", "raw_bytes")
    return _rows(spark, [tuple(got[n] for n in names)], ", ".join(f"{n} long" for n in names))


@query(f"""
with b as (select {_R}, batch_id, dense_rank() over (partition by {_R} order by batch_id) as id from log where dimension = 0 and region_x = -1 and region_z = 0 qualify id <= 64),
g as (select l.*, b.id from log l join b using ({_R}, batch_id)),
n as (select * from g qualify row_number() over (partition by {_K} order by batch_id desc, ord desc) = 1)
select {_K}, id as batch_id, value from n where value is not null""", live=False)
def group_write(spark, log):
    """The first 64 batches of a region as one group; they are given the ids 1 and on."""
    here = log.where("dimension = 0 and region_x = -1 and region_z = 0")
    first = here.select("batch_id").distinct().orderBy("batch_id").limit(changes.MAX_BATCHES)
    group = _changes(here.join(first, "batch_id", "left_semi")).drop("batch_id")
    world = World(spark, work_folder(spark, "group"))
    world.write_group(group)
    return _text(world.live().select(*KEY, "batch_id", "value"))


@query(f"""
with a as (select * from (select *, row_number() over (partition by {_K} order by batch_id desc, ord desc) as m from log where batch_id <= {_CUT}) where m = 1 and value is not null),
w as (select live.*, a.value is not null and a.value = live.value as same, count(*) filter (a.value is null or a.value <> live.value) over (partition by {_R}) as changed from live left join a using ({_K}, region_x, region_z))
select count(*) filter (same) as skipped, count(*) filter (not same) as records_written, count(distinct case when changed > 0 then ({_R}) end) as writes from w""")
def resave(spark, log):
    """All live records saved again onto an earlier state: what is there already is skipped, and a batch of nothing else takes no id."""
    before, _ = _parts(log)
    world = World(spark, work_folder(spark, "resave"), Options(skip_unchanged=True))
    world.write(_changes(before))
    world.reset_counters()
    world.write(as_batches(snapshot.live(log).select(*KEY, F.col("value").cast("binary").alias("value"))))
    names = ("skipped", "records_written", "writes")
    return _rows(spark, [tuple(world.counters()[n] for n in names)], ", ".join(f"{n} long" for n in names))


@query("""
with a as (select 'player_record_' || cast(user_id % 40 as varchar) as key, event_id as seq, case when event_type = 'error' then null else event_type end as value from events),
m as (select * from a qualify row_number() over (partition by key, seq < (select count(*) from events) // 2 order by seq desc) = 1)
select key, value from m qualify row_number() over (partition by key order by seq desc) = 1 and value is not null""", live=False)
def _world_aux(spark, log):
    return log


def world_aux(spark, sf_dir):
    """Auxiliary records written in two steps, compacted, and read one by one."""
    e = spark.read.parquet(os.path.join(sf_dir, "events.parquet"))
    rows = e.select("event_id", F.concat(F.lit("player_record_"), (F.col("user_id") % 40).cast("string")).alias("key"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("value"))
    half = e.count() // 2
    world = World(spark, work_folder(spark, "aux"))
    for part in (rows.where(F.col("event_id") < half), rows.where(F.col("event_id") >= half)):
        last = snapshot.latest(part, ("key",), ("event_id",))
        world.aux_write(last.select("key", "value"))
    world.compact_world()
    one = world.aux_get(b"player_record_1")
    found = world.aux().select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))
    return found.withColumn("value", F.when(F.col("key") == "player_record_1", F.lit(None if one is None else one.decode())).otherwise(F.col("value")))


QUERIES["world_aux"], SQL["world_aux"] = world_aux, SQL.pop("_world_aux")
del QUERIES["_world_aux"]


def _raw_sql(component: str = "component") -> str:
    return (
        f"{_le_sql('chunk_x')} || {_le_sql('chunk_z')} || case when dimension = 0 then '' else {_le_sql('dimension')} end || upper(right(concat('0', hex({component})), 2))"
        " || case when component = 47 then upper(right(concat('0', hex(cast(subchunk_y as bigint) & 255)), 2)) else '' end"
    )


@query(f"""
with r as (select {_raw_sql('127')} as key, value, chunk_x from live where component = 50)
select key, value, chunk_x % 3 = 0 as conflict from r""")
def metadata_copies(spark, log):
    """Auxiliary copies of native metadata records: equal ones are dropped, different ones are conflicts."""
    records = snapshot.live(log).where("component = 50").withColumns({"component": F.lit(METADATA), "value": F.col("value").cast("binary")})
    raw = records.select(level_key().alias("key"), "value", "chunk_x")
    copies = raw.select("key", F.when(F.col("chunk_x") % 3 == 0, F.concat("value", F.lit("x").cast("binary"))).otherwise(F.col("value")).alias("value"))
    merged, conflicts = aux.raw_records(records, copies)
    found = merged.join(conflicts.withColumn("conflict", F.lit(True)), "key", "left")
    return found.select(F.hex("key").alias("key"), F.col("value").cast("string").alias("value"), F.coalesce("conflict", F.lit(False)).alias("conflict"))


# binary worlds

#: Batches whose frames are damaged: every thirteenth.
_DAMAGED = "batch_id % 13 = 0"


def _binary(spark: SparkSession, log: DataFrame, damaged: bool = False) -> str:
    return _built(spark, log, f"binary-{damaged}", lambda at: native.write(log, at, broken=F.expr(_DAMAGED) if damaged else None))


@query(f"select {_K}, batch_id, value from live")
def native_replay(spark, log):
    """A binary world, its segments cut short, read as opening it would."""
    at = _built(spark, log, "binary-small", lambda at: native.write(log, at, segment_bytes=2048))
    return _text(snapshot.live(native.replay(spark, at)).select(*KEY, "batch_id", "value"))


@query(f"select {_K}, batch_id, ord, value from log where batch_id % 13 <> 0", live=False)
def native_salvage(spark, log):
    """All frames of a damaged binary world that still verify."""
    found, _ = native.salvage(spark, _binary(spark, log, True))
    place = F.row_number().over(Window.partitionBy(*REGION, "batch_id").orderBy("ord"))
    places = log.select(*REGION, "batch_id", F.col("ord").alias("given"), place.alias("n"))
    return _text(found.withColumn("n", place).join(places, [*REGION, "batch_id", "n"]).select(*KEY, "batch_id", F.col("given").alias("ord"), "value"))


@query(f"select {_K}, value from (select * from log where batch_id % 13 <> 0 and dimension = 0 and region_x = -1 and region_z = 0) qualify row_number() over (partition by {_K} order by batch_id desc, ord desc) = 1 and value is not null", live=False)
def recover_region(spark, log):
    """One region of a damaged binary world, recovered into a new world."""
    at = f"{work_folder(spark, 'recovered')}/world"
    tools.recover(spark, _binary(spark, log, True), at, region=(0, -1, 0))
    return _text(World(spark, at, create=False).live().select(*KEY, "value"))


def _checked(spark: SparkSession, log: DataFrame) -> DataFrame:
    """A row for each frame that was written: whether it verifies when it is read."""
    found, _ = native.salvage(spark, _binary(spark, log, True))
    read = found.select(*REGION, "batch_id", F.lit(True).alias("there")).distinct()
    return log.select(*REGION, "batch_id").distinct().join(read, [*REGION, "batch_id"], "left").select(*REGION, F.col("batch_id").alias("position"), F.coalesce("there", F.lit(False)).alias("valid"))


@query(f"select distinct {_R}, batch_id as position from log l where batch_id < (select coalesce(min(batch_id), 1 << 60) from log x where x.batch_id % 13 = 0 and x.dimension = l.dimension and x.region_x = l.region_x and x.region_z = l.region_z)", live=False)
def valid_prefix(spark, log):
    """Per region, the frames before its first broken one, by their checksums."""
    return changes.valid_prefix(_checked(spark, log), by=REGION).select(*REGION, "position")


@query(f"""
with s as (select distinct {_R}, batch_id, batch_id % 13 <> 0 as valid from log), g as (select {_R}, count(*) filter (valid) as batches, bool_or(not valid) as problem from s group by {_R})
select count(*) as regions, cast(sum(batches) as bigint) as batches, count(*) filter (problem) as problems from g""", live=False)
def verification_totals(spark, log):
    return maintenance.verification_totals(_checked(spark, log))


@query(f"select {_R}, cast(1 as bigint) as generation, cast(9999 as bigint) as id from log where region_x % 2 = 0 group by {_R}", live=False)
def orphan_files(spark, log):
    """Segments that are there and that no manifest names."""

    def build(at: str) -> None:
        def strays(batches):
            for b in batches:
                for r in zip(*[c.to_pylist() for c in b.columns], strict=True):
                    put_file(f"{at}/{native._region_folder(r)}/{1:016x}-{9999:016x}.segment", b"stray")
                yield b

        native.write(log, at)
        log.where("region_x % 2 = 0").select(*REGION).distinct().repartition(tasks(spark)).mapInArrow(strays, "dimension int, region_x int, region_z int").count()

    at = _built(spark, log, "binary-orphans", build)
    files = native.listed(spark, at)
    number = lambda i: F.conv(F.substring("file", i, 16), 16, 10).cast("long")
    where = parse_region_name("folder")
    there = files.where("file like '%.segment'").select(where["dimension"].alias("dimension"), where["x"].alias("region_x"), where["z"].alias("region_z"), number(1).alias("generation"), number(18).alias("id"))
    named = native.segment_names(native.manifests(spark, at, files)).select(*REGION, "generation", F.col("segment").alias("id"))
    return maintenance.orphans(there, named, REGION)


@query(f"select {_K}, value, (select count(*) from log) as records, (select count(distinct ({_R}, batch_id)) from log) as batches from live")
def migrate_v1(spark, log):
    """A world of the first format, whose components go by other numbers, converted."""
    source = _built(spark, log, "old", lambda at: legacy.write(log, at))
    at = f"{work_folder(spark, 'migrated')}/world"
    report = tools.migrate(spark, source, at)
    found = World(spark, at, create=False).live().select(*KEY, "value")
    return _text(found).withColumns({"records": F.lit(report["records"]).cast("long"), "batches": F.lit(report["batches"]).cast("long")})


# LevelDB

def _raw(log: DataFrame) -> DataFrame:
    return snapshot.live(log).select(level_key().alias("key"), F.col("value").cast("binary").alias("value"))


def _leveldb(spark: SparkSession, log: DataFrame) -> str:
    """A game world: tables with the live records up to the cut, logs with the changes after it, and two other files."""

    def build(at: str) -> None:
        before, after = _parts(log)
        leveldb.write(_raw(before), f"{at}/db")
        rows = after.select(level_key().alias("key"), F.col("value").cast("binary").alias("value"), "batch_id", "ord")
        leveldb.write_logs(rows, f"{at}/db", ["batch_id", "ord"], 900, 100)
        put_file(f"{at}/level.dat", b"level")
        put_file(f"{at}/more/icon", b"")

    return _built(spark, log, "game", build)


@query(f"select {_raw_sql()} as key, value from live")
def leveldb_roundtrip(spark, log):
    found = leveldb.read(spark, f"{_leveldb(spark, log)}/db")
    return found.select(F.hex("key").alias("key"), F.col("value").cast("string").alias("value"))


@query("select count(*) as chunk_records, cast(0 as bigint) as aux_records, cast(sum(length(value)) as bigint) as bytes, cast(2 as bigint) as files from live")
def leveldb_import(spark, log):
    """A game world imported and held against its source both ways."""
    r = tools.import_leveldb(spark, _leveldb(spark, log), f"{work_folder(spark, 'imported')}/world")
    return _rows(spark, [(r.chunk_records, r.aux_records, r.bytes, r.files)], "chunk_records long, aux_records long, bytes long, files long")


@query(f"select {_raw_sql()} as key, value from live union all select upper(hex(encode('BiomeData'))), 'plains'")
def leveldb_export(spark, log):
    """A world exported as a game world and read back."""
    found = leveldb.read(spark, _built(spark, log, "export", lambda at: _exported(spark, log, at)) + "/game/db")
    return found.select(F.hex("key").alias("key"), F.col("value").cast("string").alias("value"))


def _exported(spark: SparkSession, log: DataFrame, at: str) -> None:
    world = _write(spark, log, f"{at}/world")
    world.aux_put(b"BiomeData", b"plains")
    tools.export_leveldb(world, f"{at}/game")


@query(f"""
with a as (select * from (select *, row_number() over (partition by {_K} order by batch_id desc, ord desc) as m from log where batch_id <= {_CUT}) where m = 1 and value is not null),
x as (select {_raw_sql()} as key, value from a), y as (select {_raw_sql()} as key, value from live),
d as (select min(key) as key from x full join y using (key) where x.value is distinct from y.value)
select (select count(*) from x where key < d.key) as matching, d.key as differs from d""")
def leveldb_compare(spark, log):
    """Two databases: the keys that match before the first one, in byte order, that differs."""
    older = _built(spark, log, "older", lambda at: leveldb.write(_raw(_parts(log)[0]), f"{at}/db"))
    n, key = tools.compare_leveldb(spark, older, _leveldb(spark, log))
    return _rows(spark, [(n, None if key is None else key.hex().upper())], "matching long, differs string")


@query("select chunk_x, chunk_z, component, subchunk_y, value from live where dimension = 0")
def dataset_dump(spark, log):
    """A flat dump of a dimension's chunks, written and read."""
    rows = snapshot.live(log).where("dimension = 0").select("chunk_x", "chunk_z", "component", "subchunk_y", F.col("value").cast("binary").alias("value"))
    at = _built(spark, log, "dump", lambda at: (put_file(f"{at}/readme", b""), dataset.write(rows, f"{at}/dump.bin")))
    return _text(dataset.read(spark, f"{at}/dump.bin"))


# checksums and texts


def _hashed(spark: SparkSession, log: DataFrame, f: Callable[[bytes], tuple], schema: str) -> DataFrame:
    """f of every value's bytes, over Arrow batches."""
    import pyarrow as pa

    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    columns = [c.split() for c in schema.split(", ")]

    def run(batches):
        for b in batches:
            if b.num_rows:
                made = zip(*[f(v.as_py()) for v in b.column(1)], strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, kinds[k]) for x, (_, k) in zip(made, columns, strict=True))], ["event_id", *(n for n, _ in columns)])

    return log.where("value is not null").select("event_id", F.col("value").cast("binary")).mapInArrow(run, f"event_id long, {schema}")


_CRC_STEP = "list_reduce([xor(c, b)] || range(8), lambda x, i: xor(x >> 1, cast(2197175160 as bigint) * (x & 1)))"


@query(f"""
with c as (
  select event_id, xor(list_reduce([cast(4294967295 as bigint)] || list_transform(string_split(value, ''), lambda s: cast(ascii(s) as bigint)), lambda c, b: {_CRC_STEP}), 4294967295) as crc from log where value is not null)
select event_id, crc, (((crc >> 15) | ((crc << 17) & 4294967295)) + 2726488792) & 4294967295 as masked from c""", live=False)
def value_checksums(spark, log):
    """CRC-32C of every value, and as LevelDB stores it."""
    return _hashed(spark, log, lambda v: (crc32c(v), mask(crc32c(v))), "crc long, masked long")


@query("select event_id, repeat(value, 50) as value, true as smaller from log where value is not null", live=False)
def lz4_roundtrip(spark, log):
    def there_and_back(v: bytes) -> tuple:
        small = lz4_compress(v * 50)
        return lz4_decompress(small, len(v) * 50).decode(), len(small) < len(v) * 50

    return _hashed(spark, log, there_and_back, "value string, smaller boolean")


@query("""
with v as (select event_id, event_id * 37 as n from log where value is not null)
select event_id, lower(case when n < 128 then printf('%02x', n) when n < 16384 then printf('%02x', n % 128 + 128) || printf('%02x', n // 128)
  when n < 2097152 then printf('%02x', n % 128 + 128) || printf('%02x', n // 128 % 128 + 128) || printf('%02x', n // 16384)
  else printf('%02x', n % 128 + 128) || printf('%02x', n // 128 % 128 + 128) || printf('%02x', n // 16384 % 128 + 128) || printf('%02x', n // 2097152) end) as raw from v""", live=False)
def varints(spark, log):
    numbers = log.withColumn("value", F.when(F.col("value").isNotNull(), (F.col("event_id") * 37).cast("string")))
    return _hashed(spark, numbers, lambda v: (put_varint(int(v)).hex(),), "raw string")


def _values_sql(rows: list[tuple], names: str) -> str:
    quoted = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"select * from (values {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) as t({names})"


def status_messages(spark, sf_dir):
    """Number and standing text of every status, and the kind of failure that carries it."""
    kinds = {c.status: c.__name__ for c in WorldError.__subclasses__()}
    return _rows(spark, [(n, t, kinds.get(n, "")) for n, t in STATUSES.items()], "status int, message string, kind string")


def library_options(spark, sf_dir):
    info = library_info()
    return _rows(spark, [(info["version"], info["world_version"], k, str(v)) for k, v in info["options"].items()], "version int, world_version int, option string, standard string")


_STATUS_ROWS = [
    (0, "ok", ""), (1, "failed", ""), (2, "invalid argument", "InvalidArgument"), (3, "not found", "NotFound"), (4, "buffer too small", "BufferTooSmall"), (5, "busy", "Busy"),
    (6, "corrupt data", "Corrupt"), (7, "needs recovery", "NeedsRecovery"), (8, "needs migration", "NeedsMigration"), (9, "unsupported version", "UnsupportedVersion"),
    (10, "unsupported compression", "UnsupportedCompression"), (11, "batch id out of order", "BatchOrder"), (12, "batch too large", "BatchTooLarge"), (13, "too many keys in a region", "IndexFull"),
    (14, "range covers too many regions", "RangeTooLarge"), (15, "records of more than one region", "RegionMismatch"), (16, "keys out of order or repeated", "KeyOrder"), (17, "contents differ", "Mismatch"),
    (18, "destination exists", "Exists"), (19, "closed", "Closed"), (20, "another writer committed first", "Conflict"),
]
QUERIES["status_messages"], SQL["status_messages"] = status_messages, _values_sql(_STATUS_ROWS, "status, message, kind")
_OPTION_ROWS = [
    (1, 2, "skip_unchanged", "False"), (1, 2, "max_keys", "65536"), (1, 2, "compact_min_bytes", "16777216"), (1, 2, "compact_live_percent", "50"), (1, 2, "auto_compact", "False"),
    (1, 2, "compression", "lz4"), (1, 2, "dense_compression", "zstd"), (1, 2, "queue", "16"),
]
QUERIES["library_options"], SQL["library_options"] = library_options, _values_sql(_OPTION_ROWS, "version, world_version, option, standard")


@query("select event_id, left(repeat(value, 40), 256) as problem from log where value is not null", live=False)
def problem_texts(spark, log):
    """A first problem in words is cut at 256 bytes."""
    return _hashed(spark, log, lambda v: (problem_text(ValueError(v.decode() * 40)),), "problem string")


@query(f"""
with s as (select distinct {_R}, batch_id from log)
select * from (values (1, 0, (select count(distinct ({_R})) || ' regions, ' || count(*) || ' committed batches, 0 with problems' from s)), (2, 2, ''), (3, 1, 'differs')) as t(step, code, says)""", live=False)
def cli_reports(spark, log):
    """Commands: a sound world is verified, a misused command fails, a world that isn't its source differs."""
    world = _built(spark, log, "world", lambda at: _write(spark, log, at).close())
    older = _built(spark, log, "older", lambda at: leveldb.write(_raw(_parts(log)[0]), f"{at}/db"))
    out = []
    for argv in (["verify", world], ["nonsense"], ["verify", world, older]):
        said = io.StringIO()
        out.append((len(out) + 1, cli.run(spark, argv, said), said.getvalue().strip().split(":")[0]))
    return _rows(spark, out, "step int, code int, says string")


@query(f"""
with b as (select * from (select *, row_number() over (partition by {_K} order by batch_id desc, ord desc) as m from log where batch_id <= {_CUT}) where m = 1 and value is not null),
o as (select *, true as there from (select *, row_number() over (partition by {_K} order by batch_id desc, ord desc) as m from log where batch_id > {_CUT}) where m = 1)
select {_K}, case when o.there then o.value else b.value end as value from b full join o using ({_K})
where case when o.there then o.value else b.value end is not null""", live=False)
def world_overlay(spark, log):
    """A stored world over another that stays as it is."""
    before, after = _parts(log)
    base = World(spark, work_folder(spark, "base"))
    base.write(_changes(before))
    over = Overlay(base, work_folder(spark, "over"))
    over.write(_changes(after))
    return _text(over.live().select(*KEY, "value"))


# streams


def _stream(spark: SparkSession, df: DataFrame, schema: str, name: str) -> DataFrame:
    at = work_folder(spark, name)
    df.write.parquet(at)
    return spark.readStream.schema(schema).parquet(at)


@query(f"select {_K}, value, true as once from live")
def stream_ingest(spark, log):
    """A stream of changes into a world; the micro-batch that is run again writes nothing twice."""
    rows = _changes(log).drop("batch_id")
    at = work_folder(spark, "stream")
    world, versions = World(spark, f"{at}/world"), []
    for n in range(2):
        streams.ingest(_stream(spark, rows, CHANGES_SCHEMA, "changes"), world, f"{at}/checkpoint-{n}").awaitTermination()
        versions.append(world.commits.state()[0])
    return _text(world.live().select(*KEY, "value")).withColumn("once", F.lit(versions[0] == versions[1]))


@query(f"select {_K}, value from live")
def stream_live_updates(spark, log):
    """The live view that a stateful stream keeps; what comes late is dropped."""
    rows = log.select(*[c.split()[0] for c in streams.CHANGES.split(", ")])
    at = work_folder(spark, "updates")

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("append").parquet(f"{at}/out")

    updates = streams.live_updates(_stream(spark, rows, streams.CHANGES, "changes"))
    updates.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return snapshot.live(with_region(spark.read.parquet(f"{at}/out"))).select(*KEY, "value")


@query("select epoch_us(time_bucket(interval '5 minutes', ts)) // 1000000 as start, event_type, count(*) as changes, round(sum(value), 6) as value from events group by all", live=False)
def _stream_windows(spark, log):
    return log


def stream_windows(spark, sf_dir):
    """Changes by kind and window of event time, with a watermark; all windows, open ones too."""
    at = work_folder(spark, "windows")
    events = _stream(spark, spark.read.parquet(os.path.join(sf_dir, "events.parquet")), spark.read.parquet(os.path.join(sf_dir, "events.parquet")).schema.simpleString()[7:-1].replace(":", " "), "events")

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out")

    streams.changes_per_window(events).writeStream.foreachBatch(keep).outputMode("complete").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{at}/out")
    return out.select(F.unix_seconds("w.start").alias("start"), "event_type", "changes", F.round("value", 6).alias("value"))


QUERIES["stream_windows"], SQL["stream_windows"] = stream_windows, SQL.pop("_stream_windows")
del QUERIES["_stream_windows"]
