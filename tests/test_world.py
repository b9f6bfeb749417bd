import random

import pytest

from voxlog import errors
from voxlog.functions.keys import KEY
from voxlog.operators import changes, snapshot
from voxlog.world import CHANGES_SCHEMA, Options, Overlay, World


def rows(spark, *changes, ids=False):
    schema = CHANGES_SCHEMA + (", batch_id long" if ids else "")
    return spark.createDataFrame([tuple(bytearray(v) if isinstance(v, bytes) else v for v in c) for c in changes], schema)


def put(x, value, batch=0, ord_=0, z=0, component=0x2C, y=0, *extra):
    return (0, x, z, component, y, batch, ord_, value, *extra)


def held(world):
    return {tuple(r[c] for c in KEY): bytes(r["value"]) for r in world.live().collect()}


def test_model(spark, tmp_path):
    rng, model = random.Random(11), {}
    world = World(spark, f"file://{tmp_path}/w", Options(skip_unchanged=True))
    for step in range(3):
        batch = []
        for i in range(80):
            c = rng.choice([43, 47, 49])
            k = (0, rng.randint(-40, 40), rng.randint(-3, 3), c, rng.randint(-4, 4) if c == 47 else 0)
            v = None if rng.random() < 0.2 else rng.randbytes(rng.choice([0, 5, 40]))
            batch.append((*k, 0, i, v))
            model.pop(k, None) if v is None else model.update({k: v})
        world.write(rows(spark, *batch))
        assert held(world) == model
    last = world.last_batch_id(0, 0, 0)
    assert world.compact(0, 0, 0) and not world.compact(0, 99, 99)
    again = World(spark, f"file://{tmp_path}/w", create=False)
    assert held(again) == model and again.last_batch_id(0, 0, 0) == last
    assert again.vacuum() > 0 and again.orphans() == [] and again.verify()["problems"] == 0
    k = next(iter(model))
    assert again.get(*k) == model[k] and again.value_size(*k) == len(model[k]) and again.get(0, 500, 0, 43) is None
    assert again.last_batch_id(5, 0, 0) is None


def test_batch_ids_and_limits(spark, tmp_path):
    world = World(spark, f"file://{tmp_path}/w", Options(max_keys=2))
    world.write(rows(spark, put(0, b"a", 0), put(1, b"b", 1), put(0, b"c", 1, 1)))
    assert world.last_batch_id(0, 0, 0) == 2 and world.get(0, 0, 0, 0x2C) == b"c"
    with pytest.raises(errors.BatchOrder):
        world.write(rows(spark, put(0, b"x", 0, 0, 0, 0x2C, 0, 2), ids=True))
    world.write(rows(spark, put(0, b"x", 0, 0, 0, 0x2C, 0, 7), put(0, b"y", 1, 0, 0, 0x2C, 0, 0), ids=True))
    assert world.last_batch_id(0, 0, 0) == 8 and world.get(0, 0, 0, 0x2C) == b"y"
    with pytest.raises(errors.IndexFull):
        world.write(rows(spark, put(2, b"z")))
    world.write(rows(spark, put(1, None), put(2, b"z", 0, 1)))  # the net number counts
    with pytest.raises(errors.InvalidArgument):
        world.write(rows(spark, put(0, b"", 0, 0, 0, 0x2C, 5)))
    with pytest.raises(errors.RegionMismatch):
        world.write_group(rows(spark, put(0, b"a", 0), put(40, b"b", 1)))
    assert changes.assign_ids(0, [0, 7, 0]) == [1, 7, 8]


def test_no_ops_deletes_and_buffering(spark, tmp_path):
    world = World(spark, f"file://{tmp_path}/w", Options(skip_unchanged=True))
    world.write(rows(spark, put(0, b"a"), put(1, b"", 0, 1)))
    assert world.write(rows(spark, put(0, b"a"), put(9, None, 0, 1))) is None and world.last_batch_id(0, 0, 0) == 1
    assert world.counters()["skipped"] == 2 and world.counters()["writes"] == 1
    world.reset_counters()
    assert set(world.counters().values()) == {0} and world.get(0, 1, 0, 0x2C) == b""
    world.write(rows(spark, put(0, b"a", 0, 0), put(0, b"a", 0, 1)))  # repeats in a batch are never judged
    assert world.last_batch_id(0, 0, 0) == 2
    world.write(rows(spark, put(0, None), put(1, None, 0, 1)))
    assert held(world) == {} and world.regions() == [(0, 0, 0)]
    other = World(spark, f"file://{tmp_path}/w")
    last = world.last_batch_id(0, 0, 0)
    world.write(rows(spark, put(5, b"later")), sync=False)
    world.write(rows(spark, put(6, b"too"), put(5, b"newer", 0, 1)), sync=False)
    assert world.get(0, 5, 0, 0x2C) == b"newer" and world.last_batch_id(0, 0, 0) == last + 2  # at once, by this writer
    with pytest.raises(errors.BatchOrder):
        world.write(rows(spark, put(5, b"x", 0, 0, 0, 0x2C, 0, last + 1), ids=True), sync=False)
    assert other.get(0, 5, 0, 0x2C) is None and world.orphans() == [] and other.last_batch_id(0, 0, 0) == last
    world.flush()
    assert other.get(0, 5, 0, 0x2C) == b"newer" and other.last_batch_id(0, 0, 0) == last + 2 and world.flush() is None
    world.compact_async(0, 0, 0)
    world.wait()
    world.close()
    with pytest.raises(errors.Closed):
        world.log()


def test_chunks_ranges_and_batched_reads(spark, tmp_path):
    world = World(spark, f"file://{tmp_path}/w")
    world.write(rows(spark, put(1, b"1234567", 0, 0, 0, 0x2F, 2), put(1, b"v", 0, 1), put(1, b"x" * 3000, 0, 2, 0, 0x2F, -4), put(1, b"1234", 0, 3, 0, 0x2B), put(-1, b"n", 0, 4, -33)))
    chunk = world.chunk(0, 1, 0).collect()
    assert [(r["component"], r["subchunk_y"]) for r in chunk] == [(0x2B, 0), (0x2C, 0), (0x2F, -4), (0x2F, 2)]
    assert [(r["chunk_x"], r["chunk_z"]) for r in world.keys_in_range(0, -1, 0, -40, 0).collect()] == [(-1, -33)]
    assert world.keys_in_range(0, 5, 4, 0, 0).count() == 0
    with pytest.raises(errors.RangeTooLarge):
        world.keys_in_range(0, -(2**31), 2**31 - 1, 0, 0)
    asked = spark.createDataFrame([(0, 0, 1, 0, 0x2B, 0, 10), (1, 0, 1, 0, 0x2B, 0, 3), (2, 0, -1, -33, 0x2C, 0, 10), (3, 0, 9, 9, 0x2C, 0, 10)], "request_id int, dimension int, chunk_x int, chunk_z int, component int, subchunk_y int, capacity int")
    got = {r["request_id"]: (r["status"], r["required"]) for r in world.get_many(asked).collect()}
    assert got == {0: ("ok", 4), 1: ("buffer_too_small", 4), 2: ("ok", 1), 3: ("not_found", None)}
    assert world.keys(0, 0, 0, [0x2C]).count() == 1 and world.keys(7, 0, 0).count() == 0


def test_overlay(spark, tmp_path):
    base = World(spark, f"file://{tmp_path}/b")
    base.write(rows(spark, put(0, b"b0"), put(1, b"b1", 0, 1), put(2, b"b2", 0, 2)))
    over = Overlay(base, f"file://{tmp_path}/o")
    over.write(rows(spark, put(0, b"o0"), put(1, None, 0, 1), put(3, b"o3" * 5000, 0, 2), put(4, None, 0, 3)))
    assert {r["chunk_x"]: bytes(r["value"]) for r in over.live().collect()} == {0: b"o0", 2: b"b2", 3: b"o3" * 5000}
    key = lambda x: (0, x, 0, 0x2C, 0)
    assert [over.state(*key(x)) for x in range(6)] == ["value", "deleted", "absent", "value", "deleted", "absent"]
    assert over.get(*key(0)) == b"o0" and over.get(*key(1)) is None and over.get(*key(2)) == b"b2"
    over.reset()
    assert over.get(*key(1)) == b"b1" and base.live().count() == 3


def test_auxiliary_records(spark, tmp_path):
    world = World(spark, f"file://{tmp_path}/w")
    keys = [(b"player_%09d" % i, b"" if i % 7 == 0 else b"v%d" % i) for i in range(60)]
    frame = lambda kv: spark.createDataFrame([(bytearray(k), None if v is None else bytearray(v)) for k, v in kv], "key binary, value binary")
    world.aux_write(frame(keys))
    world.aux_write(frame([(k, None) for k, _ in keys[:20]]))
    assert {bytes(r["key"]): bytes(r["value"]) for r in world.aux().collect()} == dict(keys[20:])
    chunk = b"\x01\0\0\0\x02\0\0\0\x2c"
    world.aux_put(chunk, b"routed")
    assert world.get(0, 1, 2, 0x2C) == b"routed" and world.aux_get(chunk) == b"routed" and world.aux().count() == 40
    assert world.aux_get(keys[21][0]) == b"" and world.aux_get(b"nothing") is None
    before = len(world.aux_commits.state()[1]["0000000a.region"]["files"]) if "0000000a.region" in world.aux_commits.state()[1] else 2
    world.compact_world()
    state = world.aux_commits.state()[1]
    assert {bytes(r["key"]): bytes(r["value"]) for r in world.aux().collect()} == dict(keys[20:]) and world.aux_log().count() == 40 and all(len(s["files"]) <= max(1, before) for s in state.values())
    for k, v in ((bytes(changes.MAX_VALUE + 1), b""), (b"k", bytes(changes.MAX_VALUE + 1))):
        with pytest.raises(errors.BatchTooLarge):
            world.aux_put(k, v)


def test_counters_outlive_compaction(spark, tmp_path):
    world = World(spark, f"file://{tmp_path}/w")
    for i in range(3):
        world.write(rows(spark, put(0, b"abc"), put(1, None, 0, 1), put(40, b"z", 0, 2)))
    world.reset_counters()
    world.write(rows(spark, put(0, b"abcd"), put(1, None, 0, 1)))
    world.compact_world()
    with pytest.raises(errors.InvalidArgument):  # what a compaction has merged can't be told apart
        world.as_of(2)
    assert world.as_of(4).count() == 2
    got = World(spark, f"file://{tmp_path}/w").counters()
    assert {k: got[k] for k in ("writes", "records_written", "deletes", "raw_bytes")} == {"writes": 7, "records_written": 11, "deletes": 4, "raw_bytes": 16} and got["stored_bytes"] > 0
    now = world.counters()
    assert {k: now[k] for k in ("writes", "records_written", "deletes", "raw_bytes", "skipped")} == {"writes": 1, "records_written": 2, "deletes": 1, "raw_bytes": 4, "skipped": 0}


def test_totals_of_reads_and_pruned_batched_reads(spark, tmp_path):
    world = World(spark, f"file://{tmp_path}/w")
    world.write(rows(spark, *[put(40 * i, b"x" * i, 0, i) for i in range(5)], put(0, b"yy", 0, 9, 0, 0x2B)))
    assert world.list_regions(2) == ([(0, 0, 0), (0, 1, 0)], 5) and world.list_keys(0, 0, 0, 1) == ([(0, 0, 0, 0x2B, 0)], 2)
    assert world.read_chunk(0, 0, 0, 2, 2) == ([(0x2B, 0, b"yy"), (0x2C, 0, b"")], 2, 2)
    assert world.read_chunk(0, 0, 0, 1, 99) == ([], 2, 2) and world.read_chunk(0, 0, 0, 9, 1) == ([], 2, 2) and world.read_chunk(0, 7, 7, 1, 1) == ([], 0, 0)
    asked = spark.createDataFrame([(0, 0, 40, 0, 0x2C, 0, 10)], "request_id int, dimension int, chunk_x int, chunk_z int, component int, subchunk_y int, capacity int")
    got = world.get_many(asked)
    assert [bytes(r["value"]) for r in got.collect()] == [b"x"] and len(got.inputFiles()) == 1


def test_conflicting_writers(spark, tmp_path):
    a, b = World(spark, f"file://{tmp_path}/w"), World(spark, f"file://{tmp_path}/w")
    a.write(rows(spark, put(0, b"1")))
    b.write(rows(spark, put(0, b"2")))
    a.write(rows(spark, put(0, b"3")))
    assert b.last_batch_id(0, 0, 0) == 3 and b.get(0, 0, 0, 0x2C) == b"3"
    seen, state = a.commits.state()
    b.write(rows(spark, put(0, b"4")))
    with pytest.raises(errors.Conflict):
        a.commits.add(seen, {next(iter(state)): {"add": [], "last": 4}})


def test_fold_of_no_op_rule(spark):
    """The set form of the no-op rule against a sequential fold."""
    from voxlog.plans.log import log_of_events

    log = log_of_events(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    all_rows = sorted(log.collect(), key=lambda r: (r["batch_id"], r["ord"]))
    now, want = {}, set()
    batches: dict = {}
    for r in all_rows:
        batches.setdefault(r["batch_id"], []).append(r)
    for _, batch in sorted(batches.items()):
        keys = [tuple(r[c] for c in KEY) for r in batch]
        for r, k in zip(batch, keys, strict=True):
            if keys.count(k) == 1 and now.get(k) == r["value"]:
                want.add(r["event_id"])
        for r, k in zip(batch, keys, strict=True):
            now[k] = r["value"]
    assert {r["event_id"] for r in changes.unchanged(log).collect()} == want
    assert {tuple(r[c] for c in KEY): r["value"] for r in snapshot.live(log).collect()} == {k: v for k, v in now.items() if v is not None}


def test_small_regions_share_files(spark, tmp_path):
    """Files follow the bytes, not the regions; a compacted region leaves what others have in its files as it was."""
    world = World(spark, f"file://{tmp_path}/w")
    for step in range(2):
        world.write(rows(spark, *[put(32 * i, b"%d" % (step * i), 0, 0) for i in range(60)], *[put(32 * i + 1, None if step else b"n", 0, 1) for i in range(60)]))
    assert len(list(tmp_path.glob("w/log/**/*.parquet"))) <= 8 and len(world.regions()) == 60
    assert all(s["totals"]["stored_bytes"] > 0 for s in world.commits.state()[1].values())
    want, ids = held(world), {r["chunk_x"]: r["batch_id"] for r in world.live().collect()}
    assert len(want) == 60 and world.compact(0, 3, 0) and held(world) == want
    assert {r["chunk_x"]: r["batch_id"] for r in world.live().collect()} == ids and world.last_batch_ids() == [(0, i, 0, 2) for i in range(60)]
    assert world.log([(0, 3, 0)]).count() == 1 and world.log([(0, 4, 0)]).count() == 4 and world.log([(0, i, 0) for i in range(20)]).count() == 77
    assert world.log().count() == 60 * 4 - 3 and [s["base"] for s in world.commits.state()[1].values()].count(2) == 1
    assert world.vacuum() > 0 and world.verify()["problems"] == 0 and world.verify()["batches"] == 119
    world.compact_async(0, 5, 0)
    world.compact_async(0, 6, 0)  # both in the same files
    world.wait()
    assert held(World(spark, f"file://{tmp_path}/w")) == want and world.log().count() == 60 * 4 - 9
    world.compact_world()
    assert held(world) == want and world.log().count() == 60 and world.counters()["records_written"] == 240


def test_worlds_with_a_folder_for_each_region(spark, tmp_path):
    """As they were written before: read, appended to and compacted."""
    world = World(spark, f"file://{tmp_path}/w")
    world.write(rows(spark, put(0, b"a"), put(40, b"b", 0, 1)))
    old = World(spark, f"file://{tmp_path}/old")
    world.log().write.partitionBy("dimension", "region_x", "region_z").parquet(str(tmp_path / "old/log/commit=c1"))
    files = {f.parent.parent.name.split("=")[1]: str(f.relative_to(tmp_path / "old/log")) for f in (tmp_path / "old/log").glob("**/*.parquet")}
    old.commits.add(0, {f"00000000-0000000{x}-00000000.region": {"add": [f], "last": 1, "keys": 1} for x, f in files.items()})
    assert held(old) == held(world) and len(held(old)) == 2
    old.write(rows(spark, put(0, b"c")))
    assert old.get(0, 0, 0, 0x2C) == b"c" and old.get(0, 40, 0, 0x2C) == b"b" and old.verify()["problems"] == 0
    old.compact_world()
    assert old.vacuum() == 3 and {k[1]: v for k, v in held(old).items()} == {0: b"c", 40: b"b"}
