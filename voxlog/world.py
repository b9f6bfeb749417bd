"""A world: a partitioned Parquet log of records, versioned by atomic commits, with an auxiliary table of raw keys.

Layout: ``log/commit=/*.parquet``, ``aux/commit=/bucket=/*.parquet``, ``_commits/`` and ``_aux_commits/``, ``_world.json``. A
file of the log holds many small regions, sorted, or a part of a large one, so files are as many as the bytes ask for; the
commits tell which regions lie in which. Worlds with a folder for each region (``log/commit=/dimension=/region_x=/region_z=/``)
are read as well. A read takes the file list of one version, so it is a snapshot, and lists only the files of the regions asked
for. Data are written in place by executors and count once the driver has published one small commit that names them.
"""

from __future__ import annotations

import json
import threading
import uuid
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .errors import BatchOrder, BatchTooLarge, Busy, Closed, Conflict, Corrupt, IndexFull, InvalidArgument, NeedsMigration, RegionMismatch, UnsupportedVersion, WorldError
from .functions.keys import AUX_DIMENSION, FULL_KEY, KEY, REGION
from .operators import aux as aux_ops
from .operators import changes, maintenance, snapshot
from .plans.log import with_region
from .storage import Commits, Files, drop, stored

LIBRARY_VERSION, WORLD_VERSION = 1, 2
_PROBLEMS = {c.__name__: c for c in (InvalidArgument, RegionMismatch, BatchTooLarge, BatchOrder)}
_RECORD = "chunk_x int, chunk_z int, component int, subchunk_y int, batch_id long, ord int, is_delete boolean, raw_len int, crc long, value binary"
LOG_SCHEMA = f"{_RECORD}, dimension int, region_x int, region_z int"
AUX_SCHEMA = "key binary, batch_id long, ord int, value binary, bucket int"
#: What a caller passes to write().
CHANGES_SCHEMA = "dimension int, chunk_x int, chunk_z int, component int, subchunk_y int, batch int, ord int, value binary"


@dataclass(frozen=True)
class Options:
    """Options of a world; ``validate`` refuses what makes no sense."""

    skip_unchanged: bool = False
    max_keys: int = changes.MAX_KEYS
    compact_min_bytes: int = 16 << 20
    compact_live_percent: int = 50
    auto_compact: bool = False
    compression: str = "lz4"
    dense_compression: str = "zstd"
    queue: int = 16

    def validate(self) -> Options:
        if not (1 <= self.max_keys <= changes.MAX_KEYS and 0 <= self.compact_live_percent <= 100 and self.compact_min_bytes >= 0 and self.queue >= 1):
            raise InvalidArgument(str(self))
        return self


#: Regions that a batched read names one by one, and up to which a filter on them is spelled out, so that it reaches row groups.
REGIONS_NAMED, REGIONS_SPELLED = 1_000, 16


def literal(rows: list[tuple[int, int, int, int]], spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows, "dimension int, region_x int, region_z int, last long")


def library_info() -> dict:
    return {"version": LIBRARY_VERSION, "world_version": WORLD_VERSION, "options": {f.name: f.default for f in fields(Options)}}


def _name(*region: int) -> str:
    return "-".join(f"{v & 0xFFFFFFFF:08x}" for v in region) + ".region"


def _region(name: str) -> tuple[int, ...]:
    return tuple(v - (1 << 32) if v >= 1 << 31 else v for v in (int(x, 16) for x in name.removesuffix(".region").split("-")))


class World:
    def __init__(self, spark: SparkSession, path: str, options: Options | None = None, create: bool = True):
        self.spark, self.options = spark, (options or Options()).validate()
        self.files = Files(spark, path)
        self._check_format(create)
        self.commits, self.aux_commits = Commits(self.files, "_commits"), Commits(self.files, "_aux_commits")
        self._buffer: list[dict] = []
        self._buffered_on, self._buffered_marks = 0, {}
        self._lock = threading.RLock()
        self._pool: ThreadPoolExecutor | None = None
        self._jobs: dict[tuple[int, int, int], Future] = {}
        self._skipped = 0  # by batches that were skipped whole
        self._counted: dict[str, int] = {}
        self.closed = False

    def _check_format(self, create: bool) -> None:
        if self.files.exists("_world.json"):
            try:
                version = json.loads(self.files.read("_world.json"))["version"]
            except (ValueError, KeyError) as e:
                raise Corrupt("_world.json") from e
            if version < WORLD_VERSION:
                raise NeedsMigration(f"version {version}")
            if version > WORLD_VERSION:
                raise UnsupportedVersion(f"version {version}")
            return
        if any(n.endswith(".region") for n in self.files.list("")):
            raise NeedsMigration("a world of binary segments; read it with voxlog.sources.native or migrate it")
        if not create:
            raise InvalidArgument(f"no world at {self.files.root}")
        try:
            self.files.create("_world.json", json.dumps({"version": WORLD_VERSION, "options": asdict(self.options)}).encode())
        except Conflict:
            pass

    def _open(self) -> None:
        if self.closed:
            raise Closed(self.files.root)

    # reads

    def _state(self) -> tuple[int, dict]:
        """The newest version and its state, with the buffered writes of this writer on top."""
        seen, state = self.commits.state()
        if self._buffer:
            state = dict(state)
            for changes_ in self._buffer:
                self.commits.fold(state, changes_, seen)
        return seen, state

    def _log_files(self, state: dict, regions: list[tuple[int, int, int]] | None) -> list[str]:
        """The files that hold the regions, and maybe others too."""
        names = state if regions is None else [_name(*r) for r in regions]
        return list(dict.fromkeys(f for n in names for f in state.get(n, {"files": []})["files"]))

    def log(self, regions: list[tuple[int, int, int]] | None = None) -> DataFrame:
        """The record log of the newest version, buffered writes included; given regions, theirs alone, of their files."""
        self._open()
        _, state = self._state()
        return self._of(self._read("log", self._log_files(state, regions), LOG_SCHEMA), regions)

    def _of(self, log: DataFrame, regions: list[tuple[int, int, int]] | None) -> DataFrame:
        """The rows of regions."""
        if regions is None:
            return log
        if len(regions) > REGIONS_SPELLED:
            return log.join(F.broadcast(literal([(*r, 0) for r in regions], self.spark).select(*REGION)), list(REGION), "left_semi")
        return log.where(" or ".join(" and ".join(f"{c} = {v}" for c, v in zip(REGION, r, strict=True)) for r in regions) or "false")

    def _read(self, table: str, files: list[str], schema: str) -> DataFrame:
        folders, plain = [f for f in files if f.count("/") > 1], [f for f in files if f.count("/") == 1]
        parts = []
        if folders:
            parts.append(self.spark.read.schema(schema).option("basePath", self.files.at(table)).parquet(*[self.files.at(f"{table}/{f}") for f in folders]).drop("commit"))
        if plain:
            parts.append(self.spark.read.schema(schema).parquet(*[self.files.at(f"{table}/{f}") for f in plain]))
        if not parts:
            return self.spark.range(0).select(*[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in schema.split(", ")])
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def _one(self, dimension: int, chunk_x: int, chunk_z: int) -> DataFrame:
        return self.log([(dimension, chunk_x >> 5, chunk_z >> 5)])

    def live(self, regions: list[tuple[int, int, int]] | None = None) -> DataFrame:
        return snapshot.live(self.log(regions)).select(*FULL_KEY, "batch_id", "ord", "value")

    def as_of(self, batch_id: int) -> DataFrame:
        """The live snapshot after a batch. Refused for batches that a compaction has merged."""
        if merged := [n for n, s in self._state()[1].items() if s["base"] > batch_id]:
            raise InvalidArgument(f"batch {batch_id} of region {merged[0]} was compacted")
        return snapshot.as_of(self.log(), batch_id)

    def get(self, dimension: int, chunk_x: int, chunk_z: int, component: int, subchunk_y: int = 0) -> bytes | None:
        row = snapshot.get(self._one(dimension, chunk_x, chunk_z), dimension, chunk_x, chunk_z, component, subchunk_y).select("value").first()
        return bytes(row[0]) if row else None

    def value_size(self, dimension: int, chunk_x: int, chunk_z: int, component: int, subchunk_y: int = 0) -> int | None:
        row = snapshot.value_size(self._one(dimension, chunk_x, chunk_z), dimension, chunk_x, chunk_z, component, subchunk_y).first()
        return row["raw_len"] if row else None

    def get_many(self, requests: DataFrame) -> DataFrame:
        """As snapshot.get_many; only the files of the regions asked for are read, while those are few enough to name."""
        asked = [tuple(r) for r in with_region(requests).select(*REGION).distinct().limit(REGIONS_NAMED + 1).collect()]
        return snapshot.get_many(self.log(asked if len(asked) <= REGIONS_NAMED else None), requests)

    def chunk(self, dimension: int, chunk_x: int, chunk_z: int) -> DataFrame:
        return snapshot.chunk_records(self._one(dimension, chunk_x, chunk_z), dimension, chunk_x, chunk_z)

    def keys(self, dimension: int, region_x: int, region_z: int, components: list[int] | None = None) -> DataFrame:
        return snapshot.list_keys(self.log([(dimension, region_x, region_z)]), dimension, region_x, region_z, components)

    def keys_in_range(self, dimension: int, min_x: int, max_x: int, min_z: int, max_z: int, components: list[int] | None = None) -> DataFrame:
        empty = min_x > max_x or min_z > max_z
        probe = snapshot.keys_in_range(self.log([]), dimension, min_x, max_x, min_z, max_z, components)
        if empty:
            return probe
        wanted = [r for r in self.regions() if r[0] == dimension and min_x >> 5 <= r[1] <= max_x >> 5 and min_z >> 5 <= r[2] <= max_z >> 5]
        return snapshot.keys_in_range(self.log(wanted), dimension, min_x, max_x, min_z, max_z, components)

    def regions(self) -> list[tuple[int, int, int]]:
        """Every region ever written, also one whose keys are all deleted; never the reserved dimension."""
        self._open()
        return sorted(r for r in map(_region, self._state()[1]) if r[0] != AUX_DIMENSION)

    def list_regions(self, capacity: int) -> tuple[list[tuple[int, int, int]], int]:
        """The first regions that fit, and how many there are."""
        found = self.regions()
        return found[:capacity], len(found)

    def list_keys(self, dimension: int, region_x: int, region_z: int, capacity: int, components: list[int] | None = None) -> tuple[list[tuple[int, ...]], int]:
        """The first keys of a region that fit, in key order, and how many there are."""
        keys = self.keys(dimension, region_x, region_z, components)
        return [tuple(r) for r in keys.limit(capacity).collect()], keys.count()

    def read_chunk(self, dimension: int, chunk_x: int, chunk_z: int, records: int, size: int) -> tuple[list[tuple[int, int, bytes]], int, int]:
        """(records in order, their number, their bytes); without the records where either doesn't fit."""
        here = self._one(dimension, chunk_x, chunk_z)
        row = snapshot.chunk_summary(here.where(snapshot.chunk_is(dimension, chunk_x, chunk_z))).first()
        n, required = (row["records"], row["required"]) if row else (0, 0)
        if n > records or required > size:
            return [], n, required
        found = snapshot.chunk_records(here, dimension, chunk_x, chunk_z).collect()
        return [(r["component"], r["subchunk_y"], bytes(r["value"])) for r in found], n, required

    def last_batch_id(self, dimension: int, region_x: int, region_z: int) -> int | None:
        found = self._state()[1].get(_name(dimension, region_x, region_z))
        return found["last"] if found else None

    def last_batch_ids(self) -> list[tuple[int, int, int, int]]:
        """Every region with its last batch id, of one version."""
        self._open()
        return sorted((*r, s["last"]) for n, s in self._state()[1].items() if (r := _region(n))[0] != AUX_DIMENSION)

    def prefetch(self, regions: list[tuple[int, int, int]]) -> DataFrame:
        """The live records of regions, kept by Spark; best effort. Unpersist it when done."""
        return self.live(regions).persist()

    def stats(self) -> DataFrame:
        """Per region: live keys and bytes, bytes of all frames, segments (files)."""
        _, state = self._state()
        counted = maintenance.region_stats(self._read("log", self._log_files(state, None), LOG_SCHEMA))
        rows = [(*_region(n), len(s["files"])) for n, s in state.items()]
        return counted.join(self.spark.createDataFrame(rows, "dimension int, region_x int, region_z int, segments int"), list(REGION)) if rows else counted.withColumn("segments", F.lit(0))

    def counters(self) -> dict:
        """What was written since the world began, or since reset_counters(): batches, records, deletes, bytes, and the no-op changes that were skipped.

        The totals are the commits' own, so compactions don't lessen them. Skipped changes of batches that were skipped
        whole left no commit and are counted by this writer alone.
        """
        states = self._state()[1].values()
        row = {k: sum(s["totals"].get(k, 0) for s in states) for k in self.commits.TOTALS}
        row = {"writes": row["writes"], "records_written": row["records"], **{k: row[k] for k in ("deletes", "raw_bytes", "stored_bytes")}, "skipped": row["skipped"] + self._skipped}
        return {k: v - self._counted.get(k, 0) for k, v in row.items()}

    def reset_counters(self) -> None:
        self._counted = {}
        self._counted = self.counters()

    # writes

    def write(self, batch: DataFrame, sync: bool = True, mark: tuple[str, int] | None = None) -> int | None:
        """Writes changes (CHANGES_SCHEMA; also batch_id, 0 or missing for the next). Every region's changes are atomic.

        A batch is the rows of one ``batch`` number in one region, ordered by ord. A buffered write is checked, has its ids
        and can be read through this writer at once; flush() or the next other write commits it, together with those
        before it. ``mark`` is a stream's name and number, committed with the changes.
        """
        self._open()
        return self._commit(batch, sync, mark)

    def write_group(self, batches: DataFrame) -> int:
        """Several batches of one region, all or nothing."""
        self._open()
        facts = with_region(batches).groupBy("batch").agg(F.count("*").alias("records"), F.min("dimension").alias("d"), F.min("region_x").alias("x"), F.min("region_z").alias("z"), F.count_distinct(*REGION).alias("n")).collect()
        if len({(f["d"], f["x"], f["z"]) for f in facts}) > 1 or any(f["n"] > 1 for f in facts):
            raise RegionMismatch("a group is of one region")
        if len(facts) > changes.MAX_BATCHES or sum(f["records"] for f in facts) > changes.MAX_RECORDS:
            raise BatchTooLarge(f"{len(facts)} batches")
        return self._commit(batches)

    def _commit(self, batch: DataFrame, sync: bool = True, mark: tuple[str, int] | None = None) -> int | None:
        with self._lock:
            if sync:
                self.flush()
            while True:
                try:
                    return self._try_commit(batch, sync, dict([mark] if mark else []))
                except Conflict:
                    continue

    def _try_commit(self, batch: DataFrame, sync: bool, marks: dict[str, int]) -> int | None:
        seen, state = self._state()
        rows = with_region(batch)
        rows = rows.withColumn("given", F.col("batch_id").cast("long") if "batch_id" in rows.columns else F.lit(0).cast("long")).drop("batch_id")
        rows = rows.withColumns({"value": F.col("value").cast("binary"), "batch": F.col("batch").cast("int"), "ord": F.col("ord").cast("int")}).persist()
        kept, ids = rows, None
        try:
            # one row for each region: what it is refused for, and its changes
            per = changes.validate_batches(rows.withColumn("batch_id", F.struct(*REGION, "batch"))).withColumnRenamed("records", "changes")
            facts = per.groupBy(*[F.col(f"batch_id.{c}").alias(c) for c in REGION]).agg(F.max("problem").alias("problem"), F.sum("changes").alias("changes"), F.count("*").alias("batches")).collect()
            if bad := next((f for f in facts if f["problem"]), None):
                raise _PROBLEMS[bad["problem"]](f"region {tuple(bad[:3])}")
            touched = [tuple(f[:3]) for f in facts]
            if not touched:
                return None
            known = [(*r, state.get(_name(*r), {}).get("last", 0)) for r in touched]
            last = literal(known, self.spark)
            now = snapshot.live(self._read("log", self._log_files(state, touched), LOG_SCHEMA)).select(*FULL_KEY, "value")
            if self.options.skip_unchanged:
                w = Window.partitionBy(*REGION)
                single = rows.withColumn("_b", F.min("batch").over(w) == F.max("batch").over(w))
                alone, groups = single.where("_b").drop("_b"), single.where("not _b").drop("_b")
                kept = changes.skip_unchanged(alone, now).unionByName(groups).persist()
            counted = (F.count("*").alias("changes"), F.count_if(F.col("value").isNull()).alias("deletes"), F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).cast("long").alias("raw_bytes"))
            ids = _assigned(kept.groupBy(*REGION, "batch").agg(F.max("given").alias("given"), *counted), last).persist()
            ends = ids.groupBy(*REGION).agg(F.max("batch_id").alias("last"), F.count("*").alias("batches"), *[F.sum(c).alias(c) for c in ("changes", "deletes", "raw_bytes")], F.max(F.when((F.col("given") != 0) & (F.col("given") <= F.col("before")), F.struct("given", "before"))).alias("bad")).collect()
            if bad := next((e["bad"] for e in ends if e["bad"]), None):
                raise BatchOrder(f"{bad['given']} after {bad['before']}")
            given = {tuple(f[:3]): f["changes"] for f in facts}
            touched = [tuple(e[:3]) for e in ends]
            self._skipped += sum(n for r, n in given.items() if r not in set(touched))
            if not touched:
                return None
            new = kept.join(ids.select(*REGION, "batch", "batch_id"), [*REGION, "batch"])
            if any(state.get(_name(*r), {}).get("keys", 0) + f["changes"] > self.options.max_keys for r, f in ((tuple(f[:3]), f) for f in facts)):
                if full := changes.admitted(now, new, self.options.max_keys).where("not admitted").first():
                    raise IndexFull(f"{full['keys_after']} keys in region {tuple(full[c] for c in REGION)}")
            new = new.select(*KEY, *REGION[1:], "batch_id", "ord", F.col("value").isNull().alias("is_delete"), F.coalesce(F.octet_length("value"), F.lit(0)).alias("raw_len"), F.crc32("value").alias("crc"), "value")
            sizes: dict[str, int] = {}
            added = self._put_log(new, self.options.compression, sizes)
            done = {}
            for e in ends:  # "keys" only bounds a region's keys from above: while it is low, they needn't be counted
                n = _name(*e[:3])
                totals = {"writes": e["batches"], "records": e["changes"], "deletes": e["deletes"], "raw_bytes": e["raw_bytes"], "stored_bytes": sizes.get(n, 0), "skipped": given[tuple(e[:3])] - e["changes"]}
                done[n] = {"add": added.get(n, []), "last": e["last"], "keys": e["changes"], "totals": totals}
            if not sync:
                self._buffered_on = self._buffered_on if self._buffer else seen
                self._buffer.append(done)
                self._buffered_marks |= marks
                return seen + len(self._buffer)
            version = self.commits.add(seen, done, marks=marks)
        finally:
            for df in (rows, kept, ids):
                if df is not None:
                    df.unpersist()
        if self.options.auto_compact:
            self._compact_stale(touched)
        return version

    def ingest(self, log: DataFrame) -> int:
        """Appends a whole log (the stored columns, with batch ids in order) to regions that have none yet."""
        self._open()
        seen, state = self.commits.state()
        added = self._put_log(log, self.options.compression)
        if held := set(added) & set(state):
            raise InvalidArgument(f"region {min(held)} has a log already")
        back = self._read("log", list(dict.fromkeys(f for fs in added.values() for f in fs)), LOG_SCHEMA).groupBy(*REGION)
        back = back.agg(F.max("batch_id").alias("last"), F.count("*").alias("records"), F.count_distinct("batch_id").alias("writes"), F.count_if("is_delete").alias("deletes"), F.sum("raw_len").alias("raw_bytes")).collect()
        totals = lambda r: {k: r[k] for k in ("writes", "records", "deletes", "raw_bytes")}
        return self.commits.add(seen, {n: {"add": added[n], "last": r["last"], "keys": r["records"], "totals": totals(r)} for r in back if (n := _name(r["dimension"], r["region_x"], r["region_z"]))})

    def _put_log(self, df: DataFrame, codec: str, sizes: dict[str, int] | None = None) -> dict[str, list[str]]:
        """Writes rows of the log and gives the files of each region, its share of their bytes into ``sizes``. Small regions share files, large ones are split."""
        commit = f"commit=c{uuid.uuid4().hex}"
        at = self.files.at(f"log/{commit}")
        columns = [c.split()[0] for c in LOG_SCHEMA.split(", ")]
        df.select(*columns).hint("rebalance", *REGION).sortWithinPartitions(*REGION, "chunk_x", "chunk_z").write.option("compression", codec).parquet(at)
        held = self.spark.read.schema(LOG_SCHEMA).parquet(at).groupBy(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("size"), *REGION).agg(F.count("*").alias("n"))
        out: dict[str, list[str]] = {}
        for file in held.groupBy("file", "size").agg(F.collect_list(F.struct(*REGION, "n")).alias("regions"), F.sum("n").alias("n")).collect():
            path = f"{commit}/{file['file']}"
            for *region, n in file["regions"]:
                name = _name(*region)
                out.setdefault(name, []).append(path)
                if sizes is not None:
                    sizes[name] = sizes.get(name, 0) + max(1, file["size"] * n // file["n"])
        return out

    def _put(self, table: str, df: DataFrame, by: tuple[str, ...], codec: str) -> dict[str, list[str]]:
        """Writes files below ``table`` and gives them by partition name. Large partitions are split, small ones are one file."""
        commit = f"commit=c{uuid.uuid4().hex}"
        df.hint("rebalance", *by).write.partitionBy(*by).option("compression", codec).parquet(self.files.at(f"{table}/{commit}"))
        out: dict[str, list[str]] = {}
        for path, _ in self.files.sizes(f"{table}/{commit}"):
            *parts, file = path.split("/")
            if file.endswith(".parquet"):
                out.setdefault(_name(*[int(p.split("=")[1]) for p in parts]), []).append(f"{commit}/{path}")
        return out

    def flush(self) -> int | None:
        """Commits the buffered writes, all of them or none. Where another writer has touched their regions it is a conflict, and they stay buffered."""
        with self._lock:
            if not self._buffer:
                return None
            whole: dict[str, dict] = {}
            for changes_ in self._buffer:
                for n, c in changes_.items():
                    old = whole.get(n, {"add": [], "last": 0, "keys": 0, "totals": {}})
                    whole[n] = {"add": old["add"] + c["add"], "last": c["last"], "keys": old["keys"] + c["keys"], "totals": {k: old["totals"].get(k, 0) + v for k, v in c["totals"].items()}}
            version = self.commits.add(self._buffered_on, whole, marks=self._buffered_marks)
            self._buffer, self._buffered_marks = [], {}
            return version

    def close(self) -> None:
        if not self.closed:
            self.flush()
            self.wait()
            if self._pool:
                self._pool.shutdown()
            self.closed = True

    def __enter__(self) -> World:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.close()

    # auxiliary records

    def aux_log(self) -> DataFrame:
        self._open()
        _, state = self.aux_commits.state()
        return self._read("aux", [f for s in state.values() for f in s["files"]], AUX_SCHEMA)

    def aux_write(self, rows: DataFrame, routed: bool = True) -> None:
        """rows: key, value (null deletes). Keys that are chunk records go to the record log, unless not ``routed``."""
        given = getattr(rows, "_work_path", None)
        rows = stored(rows if given else rows.select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value")), "aux-rows")
        try:
            self._aux_write(rows, routed)
        finally:
            if not given:
                drop(rows)

    def _aux_write(self, rows: DataFrame, routed: bool) -> None:
        chunk, other = aux_ops.route(rows) if routed else (None, rows)
        size = lambda c: F.coalesce(F.max(F.octet_length(c)), F.lit(0))
        key, value = other.agg(size("key"), size("value")).first()
        if max(key, value) > changes.MAX_VALUE:
            raise BatchTooLarge(f"an auxiliary record of {max(key, value)} bytes")
        if chunk is not None and not chunk.isEmpty():
            self.write(as_batches(chunk))
        if other.isEmpty():
            return
        while True:
            seen, state = self.aux_commits.state()
            last = max((s["last"] for s in state.values()), default=0) + 1
            new = other.select("key", F.lit(last).cast("long").alias("batch_id"), F.lit(0).alias("ord"), "value", aux_ops.bucket().alias("bucket"))
            added = self._put("aux", new, ("bucket",), self.options.compression)
            try:
                self.aux_commits.add(seen, {n: {"add": f, "last": last} for n, f in added.items()})
                return
            except Conflict:
                continue

    def _aux_rows(self, key: bytes, value: bytes | None) -> DataFrame:
        return self.spark.createDataFrame([(bytearray(key), None if value is None else bytearray(value))], "key binary, value binary")

    def aux_put(self, key: bytes, value: bytes) -> None:
        self.aux_write(self._aux_rows(key, value))

    def aux_delete(self, key: bytes) -> None:
        if self.aux_get(key) is not None:  # deleting what isn't there writes nothing
            self.aux_write(self._aux_rows(key, None))

    def aux_get(self, key: bytes) -> bytes | None:
        chunk, _ = aux_ops.route(self._aux_rows(key, b""))
        if row := chunk.first():
            return self.get(*[row[c] for c in KEY])
        row = aux_ops.aux_get(self.aux_log(), bytearray(key)).select("value").first()
        return bytes(row[0]) if row else None

    def aux(self) -> DataFrame:
        return aux_ops.aux_live(self.aux_log()).select("key", "value")

    # maintenance

    def compact(self, dimension: int, region_x: int, region_z: int) -> bool:
        """Rewrites a region to its live records; contents and last batch id stay. False if there is no such region."""
        return self._compact([(dimension, region_x, region_z)]) == 1

    def _compact(self, regions: list[tuple[int, int, int]]) -> int:
        """Compacts regions in one job and one commit; what is appended meanwhile stays. The number that were there.

        What other regions have in the same files is written again as it is.
        """
        self._open()
        self.flush()
        while True:
            seen, state = self.commits.state()
            found = {n: state[n] for r in regions if (n := _name(*r)) in state}
            if not found:
                return 0
            old = list(dict.fromkeys(f for s in found.values() for f in s["files"]))
            gone = set(old)
            beside = {n: shared for n, s in state.items() if n not in found and (shared := [f for f in s["files"] if f in gone])}
            last = literal([(*_region(n), s["last"]) for n, s in found.items()], self.spark)
            log = self._read("log", old, LOG_SCHEMA)
            live = snapshot.live(log.join(F.broadcast(last), list(REGION))).drop("batch_id")
            w = Window.partitionBy(*REGION).orderBy("chunk_z", "chunk_x", "component", "subchunk_y")  # a region's keys are limited
            new = live.select(*KEY, *REGION[1:], F.col("last").alias("batch_id"), F.row_number().over(w).alias("ord"), "is_delete", "raw_len", "crc", "value")
            if beside:
                new = new.unionByName(self._of(log, [_region(n) for n in beside]).select(*new.columns))
            added = self._put_log(new, self.options.dense_compression)
            changed = {n: {"add": added.get(n, []), "remove": s["files"], "base": s["last"]} for n, s in found.items()}
            changed |= {n: {"add": added.get(n, []), "remove": shared} for n, shared in beside.items()}
            try:
                self.commits.add(seen, changed, tail_safe=True)
                return len(found)
            except Conflict:
                continue

    def compact_world(self) -> tuple[int, int, int]:
        """Compacts all regions in one job, and the auxiliary records: (regions, bytes read, bytes written)."""
        self.flush()
        size = lambda: sum(n for _, n in self._referenced())
        before, regions = size(), sorted(map(_region, self.commits.state()[1]))
        self._compact(regions)
        self._compact_aux()
        return len(regions), before, size()

    def _compact_aux(self) -> None:
        """Rewrites the auxiliary records to the live ones; what is appended meanwhile stays."""
        while True:
            seen, state = self.aux_commits.state()
            found = {n: s for n, s in state.items() if s["files"]}
            if not found:
                return
            live = aux_ops.aux_live(self._read("aux", [f for s in found.values() for f in s["files"]], AUX_SCHEMA))
            added = self._put("aux", live, ("bucket",), self.options.dense_compression)
            try:
                self.aux_commits.add(seen, {n: {"add": added.get(n, []), "remove": s["files"], "base": s["last"]} for n, s in found.items()}, tail_safe=True)
                return
            except Conflict:
                continue

    def compact_async(self, dimension: int, region_x: int, region_z: int) -> None:
        """Queues a compaction; a full queue and a region that is queued already are refused as busy."""
        self._open()
        with self._lock:
            region = (dimension, region_x, region_z)
            waiting = [r for r, f in self._jobs.items() if not f.done()]
            if region in waiting or len(waiting) >= self.options.queue:
                raise Busy(f"{region}")
            self._pool = self._pool or ThreadPoolExecutor(2)
            self._jobs[region] = self._pool.submit(self.compact, *region)

    def wait(self) -> None:
        """Waits for queued compactions; the first failure is raised."""
        jobs, self._jobs = self._jobs, {}
        failed = [e for f in jobs.values() if (e := f.exception())]
        if failed:
            raise failed[0]

    def stale_regions(self) -> DataFrame:
        return maintenance.stale(self.stats(), self.options.compact_min_bytes, self.options.compact_live_percent)

    def _compact_stale(self, touched: list[tuple[int, int, int]]) -> None:
        for r in maintenance.stale(maintenance.region_stats(self.log(touched)), self.options.compact_min_bytes, self.options.compact_live_percent).collect():
            try:
                self.compact_async(r["dimension"], r["region_x"], r["region_z"])
            except Busy:
                pass

    def _referenced(self) -> list[tuple[str, int]]:
        sizes = {f"{t}/{p}": n for t in ("log", "aux") for p, n in self.files.sizes(t)}
        named = dict.fromkeys(f"{t}/{f}" for t, state in (("log", self._state()[1]), ("aux", self.aux_commits.state()[1])) for s in state.values() for f in s["files"])
        return [(f, sizes.get(f, -1)) for f in named]

    def orphans(self) -> list[str]:
        """Files that no commit names: left by compactions, and by writers that failed."""
        named = {f for f, _ in self._referenced()}
        return sorted(f"{t}/{p}" for t in ("log", "aux") for p, _ in self.files.sizes(t) if p.endswith(".parquet") and f"{t}/{p}" not in named)

    def vacuum(self) -> int:
        """Deletes orphans. Run it when no reader of an older version and no writer is at work."""
        gone = self.orphans()
        for f in gone:
            self.files.delete(f)
        return len(gone)

    def verify(self) -> dict:
        """Checks every file and every record's checksum: regions, batches, problems, and a text for the first problem."""
        missing = [f for f, n in self._referenced() if n < 0]
        if missing:
            return {"regions": len(self.regions()), "batches": 0, "problems": len(missing), "problem": f"missing file {missing[0]}"}
        log = self.log()
        good = F.when(F.col("is_delete"), F.col("value").isNull()).otherwise((F.crc32("value") == F.col("crc")) & (F.octet_length("value") == F.col("raw_len")))
        frames = log.groupBy(*REGION, "batch_id").agg(F.bool_and(F.coalesce(good, F.lit(False))).alias("valid"))
        row = maintenance.verification_totals(frames).first().asDict()
        orphans = len(self.orphans())
        problem = "" if not (row["problems"] or orphans) else f"{row['problems']} regions with damaged records, {orphans} files that nothing names"
        return row | {"problem": problem}


def as_batches(records: DataFrame) -> DataFrame:
    """Records (key columns, value; one per key) as batches of at most MAX_RECORDS in key order; a region has a bounded number of keys."""
    w = Window.partitionBy("dimension", F.shiftright("chunk_x", 5), F.shiftright("chunk_z", 5)).orderBy("chunk_x", "chunk_z", "component", "subchunk_y")
    placed = records.withColumn("_n", F.row_number().over(w) - 1)
    return placed.select(*KEY, F.floor(F.col("_n") / changes.MAX_RECORDS).cast("int").alias("batch"), (F.col("_n") % changes.MAX_RECORDS).cast("int").alias("ord"), "value")


def _assigned(batches: DataFrame, last: DataFrame) -> DataFrame:
    """Ids of new batches: a given id stands, the others follow the one before. Adds batch_id and the id before it."""
    w = Window.partitionBy(*REGION).orderBy("batch")
    run = batches.join(F.broadcast(last), list(REGION)).withColumn("run", F.sum((F.col("given") != 0).cast("int")).over(w))
    in_run = Window.partitionBy(*REGION, "run").orderBy("batch")
    start = F.when(F.col("run") > 0, F.max("given").over(in_run) - 1).otherwise(F.col("last"))
    out = run.withColumn("batch_id", (start + F.row_number().over(in_run)).cast("long"))
    return out.withColumn("before", F.coalesce(F.lag("batch_id").over(w), F.col("last")))


class Overlay:
    """A world over another: its puts replace and its deletes hide, while the base stays as it is."""

    def __init__(self, base: World, path: str, options: Options | None = None):
        self.base, self.path, self.options = base, path, options
        self.over = World(base.spark, path, options)

    def write(self, batch: DataFrame) -> int | None:
        return self.over.write(batch)

    def live(self) -> DataFrame:
        return snapshot.overlay(self.base.log(), self.over.log())

    def state(self, *key: int) -> str:
        """What the overlay itself says: absent, deleted or value."""
        row = snapshot.latest(self.over._one(*key[:3]).where(snapshot.key_is(*key))).select("is_delete").first()
        return "absent" if row is None else "deleted" if row[0] else "value"

    def get(self, *key: int) -> bytes | None:
        state = self.state(*key)
        return self.over.get(*key) if state == "value" else None if state == "deleted" else self.base.get(*key)

    def reset(self) -> None:
        """Drops the overlay."""
        self.over.close()
        for name in ("log", "aux", "_commits", "_aux_commits"):
            self.over.files.delete(name)
        self.over = World(self.base.spark, self.path, self.options)

    def close(self) -> None:
        self.over.close()


def problem_text(error: BaseException) -> str:
    """The first problem, in 256 bytes."""
    return str(error.detail if isinstance(error, WorldError) and error.detail else error).encode()[:256].decode(errors="ignore")
