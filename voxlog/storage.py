"""Files of a world through Hadoop's file systems, so that a world may lie in any store that Spark reads."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .errors import Conflict, InvalidArgument

#: Stores where two writers can both rename to one name: a commit there could be lost.
_NOT_ATOMIC = frozenset("s3 s3a s3n gs oss cos cosn obs swift http https".split())


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; where none is set a local master gets one of our own, a cluster an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise InvalidArgument("spark.checkpoint.dir names no folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="voxlog-work-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """A table written to a work folder and read from there: computed once, whatever executors are lost later."""
    if getattr(df, "_work_path", None):
        return df
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._work_path = path
    return back


def drop(df: DataFrame) -> None:
    """Deletes a stored table that nothing reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._work_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def store_of(uri: str):
    """(file system, path in it) for Python workers."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def tasks(spark: SparkSession, size: int = 0) -> int:
    """How many tasks to deal work for Python workers to: some for each core, and more where they would read over 32 MB each."""
    return max(4 * spark.sparkContext.defaultParallelism, -(-size // (32 << 20)))


def put_file(uri: str, data: bytes) -> None:
    """Writes a whole file from an executor; a task that is run again replaces it with the same."""
    store, path = store_of(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(tmp) as out:
        out.write(data)
    store.move(tmp, path)


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def at(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def reached(self) -> str | None:
        """The folder's URI if Python workers can read its store themselves; Spark's readers know more stores."""
        uri = self._fs.makeQualified(self._path(self.root)).toString()
        try:
            store, path = store_of(uri)
            store.get_file_info(path)
        except Exception:
            return None
        return uri

    def below(self) -> list[tuple[str, bool]]:
        """(name, whether it is a file) of what lies right below, in order; in one call where the store can be read without Spark."""
        if not (uri := self.reached()):
            path = self._path(self.root)
            return sorted((s.getPath().getName(), s.isFile()) for s in self._fs.listStatus(path)) if self._fs.exists(path) else []
        from pyarrow import fs

        store, path = store_of(uri)
        return sorted((f.base_name, f.is_file) for f in store.get_file_info(fs.FileSelector(path, allow_not_found=True)))

    def folders(self, ending: str) -> list[str]:
        return [n for n, is_file in self.below() if n.endswith(ending) and not is_file]

    def own(self) -> list[str]:
        return [n for n, is_file in self.below() if is_file and not n.endswith(".crc")]

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(self.at(name)))

    def list(self, name: str) -> list[str]:
        path = self._path(self.at(name))
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def walk(self, name: str) -> list[tuple[str, int]]:
        """(path below ``name``, bytes) of all files."""
        path = self._path(self.at(name))
        if not self._fs.exists(path):
            return []
        base = self._fs.makeQualified(path).toUri().getPath()
        out, it = [], self._fs.listFiles(path, True)
        while it.hasNext():
            s = it.next()
            out.append((s.getPath().toUri().getPath()[len(base) + 1 :], s.getLen()))
        return sorted(out)

    def sizes(self, name: str) -> list[tuple[str, int]]:
        """As walk, without hidden files, listed by Spark's executors: for folders of many files."""
        if not self.exists(name):
            return []
        base = self._fs.makeQualified(self._path(self.at(name))).toUri().getPath()
        rows = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.at(name)).select("path", "length").collect()
        paths = [(r["path"].split("://", 1)[-1] if "://" in r["path"] else r["path"].removeprefix("file:"), r["length"]) for r in rows]
        return sorted((p[p.index(base) + len(base) + 1 :], n) for p, n in paths)

    def read(self, name: str) -> bytes:
        path = self._path(self.at(name))
        stream = self._fs.open(path)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def create(self, name: str, data: bytes) -> None:
        """Writes a file that must not exist yet; of several writers exactly one succeeds."""
        scheme = self._fs.getScheme()
        if scheme == "file":  # the local file system's create isn't atomic; a hard link is
            target = self._path(self.at(name)).toUri().getPath()
            os.makedirs(os.path.dirname(target), exist_ok=True)
            tmp = f"{target}.{uuid.uuid4().hex}.tmp"
            with open(tmp, "xb") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(tmp, target)
            except FileExistsError:
                raise Conflict(name) from None
            finally:
                os.unlink(tmp)
            return
        if scheme in _NOT_ATOMIC:
            raise InvalidArgument(f"{scheme} has no rename that only one of two writers wins")
        target = self._path(self.at(name))
        tmp = self._path(f"{self.at(name)}.{uuid.uuid4().hex}.tmp")
        if self._fs.exists(target):
            raise Conflict(name)
        stream = self._fs.create(tmp, False)
        stream.write(bytearray(data))
        stream.close()
        try:  # whole or not there: a distributed file system refuses to rename over a file
            renamed = self._fs.rename(tmp, target)
        except Exception as e:
            if "AlreadyExists" not in str(e):
                raise
            renamed = False
        if not renamed:
            self._fs.delete(tmp, False)
            raise Conflict(name)

    def rename(self, old: str, new: str) -> None:
        target = self._path(self.at(new))
        self._fs.mkdirs(target.getParent())
        if not self._fs.rename(self._path(self.at(old)), target):
            raise OSError(f"can't rename {old} to {new}")

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(self.at(name)), True)


class Commits:
    """A table's commits, numbered files of which each is created once. Their fold is the state: the files and facts of every region.

    A commit is atomic for all regions it names. A writer that loses the race for a number rereads and tries the next,
    unless the winner touched a region of its own.
    """

    CHECKPOINT_EVERY = 32
    #: What is counted of a region's commits and only grows.
    TOTALS = ("writes", "records", "deletes", "raw_bytes", "stored_bytes", "skipped")

    def __init__(self, files: Files, name: str):
        self.files, self.name = files, name
        self._known: tuple[int, dict] = (0, {})
        #: The last number committed of each stream.
        self.marks: dict[str, int] = {}

    def _number(self, n: int) -> str:
        return f"{self.name}/{n:020d}.json"

    def state(self) -> tuple[int, dict]:
        """(version, {region: {files, last, base, generation, keys, totals, touched}})."""
        names = self.files.list(self.name)
        last = max((int(x[:20]) for x in names if x.endswith(".json") and x[:20].isdigit()), default=0)
        version, regions = self._known
        if version == 0:
            whole = max((int(x[:20]) for x in names if x.endswith(".state")), default=0)
            if whole:
                version, whole_state = whole, json.loads(self.files.read(f"{self.name}/{whole:020d}.state"))
                regions, self.marks = whole_state["regions"], whole_state["marks"]
        regions = dict(regions)
        for n in range(version + 1, last + 1):
            body = json.loads(self.files.read(self._number(n)))
            self.marks |= body.get("marks", {})
            self.fold(regions, body["regions"], n)
        self._known = last, regions
        return last, regions

    @classmethod
    def fold(cls, regions: dict[str, dict], changes: dict[str, dict], n: int) -> None:
        """Applies a commit's changes."""
        for region, change in changes.items():
            old = regions.get(region, {"files": [], "last": 0, "base": 0, "generation": 1, "keys": 0, "totals": {}})
            gone = set(change.get("remove", []))
            regions[region] = {
                "files": [f for f in old["files"] if f not in gone] + change.get("add", []),
                "last": max(old["last"], change.get("last", 0)),
                "base": change.get("base", old["base"]),
                "generation": old["generation"] + (1 if "base" in change else 0),
                "keys": old["keys"] + change.get("keys", 0),
                "totals": {k: old["totals"].get(k, 0) + change.get("totals", {}).get(k, 0) for k in cls.TOTALS},
                "touched": n,
            }

    def add(self, seen: int, regions: dict[str, dict], tail_safe: bool = False, marks: dict[str, int] | None = None) -> int:
        """Commits changes made on version ``seen``. ``tail_safe`` changes (compactions) don't mind newer appends.

        ``marks`` are numbers of streams: they are there if and only if the changes are.
        """
        body = json.dumps({"regions": regions, "marks": marks or {}}).encode()
        while True:
            last, now = self.state()
            if not tail_safe and any(now.get(r, {}).get("touched", 0) > seen for r in regions):
                raise Conflict("a region changed meanwhile")
            if tail_safe and any(not set(c.get("remove", [])) <= set(now.get(r, {}).get("files", [])) for r, c in regions.items()):
                raise Conflict("a region was compacted meanwhile")
            try:
                self.files.create(self._number(last + 1), body)
            except Conflict:
                continue
            if (last + 1) % self.CHECKPOINT_EVERY == 0:
                version, state = self.state()
                try:
                    self.files.create(f"{self.name}/{version:020d}.state", json.dumps({"regions": state, "marks": self.marks}).encode())
                except Conflict:
                    pass
            return last + 1
