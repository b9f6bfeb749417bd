from voxlog.functions.keys import KEY
from voxlog.operators.snapshot import live
from voxlog.plans.log import log_of_events
from voxlog.streaming.ingest import CHANGES, changes_per_window, ingest, live_updates
from voxlog.world import CHANGES_SCHEMA, World

DATA = "/root/testdata/sf0.001/events.parquet"


def test_stream_into_a_world(spark, tmp_path):
    log = log_of_events(spark.read.parquet(DATA)).where("region_x < 0")
    rows = log.selectExpr("dimension", "chunk_x", "chunk_z", "component", "subchunk_y", "cast(batch_id as int) as batch", "ord", "cast(value as binary) as value")
    rows.write.parquet(str(tmp_path / "in"))
    world = World(spark, f"file://{tmp_path}/w")
    ingest(spark.readStream.schema(CHANGES_SCHEMA).parquet(str(tmp_path / "in")), world, str(tmp_path / "cp")).awaitTermination()
    want = {tuple(r[c] for c in KEY): r["value"] for r in live(log).collect()}
    assert want
    assert {tuple(r[c] for c in KEY): bytes(r["value"]).decode() for r in world.live().collect()} == want
    version = world.commits.state()[0]
    ingest(spark.readStream.schema(CHANGES_SCHEMA).parquet(str(tmp_path / "in")), world, str(tmp_path / "cp2")).awaitTermination()  # the same micro-batch again
    assert world.commits.state()[0] == version
    again = World(spark, f"file://{tmp_path}/w")  # the number is the commit's own: whoever has the changes has it
    assert again.commits.state()[0] == version and again.commits.marks == {"ingest": 0}


def test_live_updates_and_windows(spark, tmp_path):
    log = log_of_events(spark.read.parquet(DATA)).where("dimension = 0 and region_x < 0")
    log.select(*[c.split()[0] for c in CHANGES.split(", ")]).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = live_updates(spark.readStream.schema(CHANGES).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("updates").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {tuple(r[c] for c in KEY): r["value"] for r in live(log).collect()}
    assert want
    assert {tuple(r[c] for c in KEY): r["value"] for r in spark.table("updates").where("value is not null").collect()} == want
    events = spark.readStream.schema(spark.read.parquet(DATA).schema).parquet("/root/testdata/sf0.001/events.parq*")
    q = changes_per_window(events).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("windows").agg({"changes": "sum"}).first()[0] == spark.read.parquet(DATA).count()


def test_newest_changes_of_a_region_at_once():
    """Against a fold, change by change; pieces of any size, late ones counted."""
    import random

    import numpy as np
    import pandas as pd

    from voxlog.streaming.ingest import newest

    rng, model, known = random.Random(4), {}, (np.zeros(0, np.int64),) * 3
    for _ in range(6):
        rows = [(0, rng.randint(-32, -1), rng.randint(0, 3), rng.choice([43, 47]), rng.choice([-4, 0, 7]), rng.randint(1, 30), n, rng.choice([None, "a"])) for n in range(120)]
        before = {k: v[:2] for k, v in model.items()}
        want, late = {}, {}
        for *key, batch, n, value in rows:
            key = tuple(key)
            if key in before and (batch, n) <= before[key]:
                late[key] = late.get(key, 0) + 1
            elif key not in want or (batch, n) > want[key][:2]:
                want[key] = (batch, n, value)
        model |= want
        df = pd.DataFrame(rows, columns=["dimension", "chunk_x", "chunk_z", "component", "subchunk_y", "batch_id", "ord", "value"])
        out, known = newest(iter([df[:50], df[50:53], df[53:]]), known)
        got = {tuple(r[:5]): (r[5], r[6], r[7], r[8]) for r in out.itertuples(index=False)}
        assert got == {k: (*v, late.get(k, 0)) for k, v in want.items()}
    assert len(known[0]) == len(model) and (np.diff(known[0]) > 0).all()
