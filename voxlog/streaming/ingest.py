"""Continuous ingestion (an extension): a stream of changes into a world, and a live view kept by state.

A micro-batch is one atomic commit that holds its number, so a micro-batch that is run again after a failure, whenever it
comes, writes nothing twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.keys import REGION
from ..operators.snapshot import latest
from ..plans.log import with_region
from ..world import World

CHANGES = "dimension int, chunk_x int, chunk_z int, component int, subchunk_y int, batch_id long, ord int, value string"


def ingest(stream: DataFrame, world: World, checkpoint: str, name: str = "ingest", **trigger) -> StreamingQuery:
    """Writes each micro-batch (the columns of a change: key, batch, ord, value) as one commit."""

    def put(batch: DataFrame, number: int) -> None:
        world.commits.state()
        if world.commits.marks.get(name, -1) < number and not batch.isEmpty():
            world.write(batch, mark=(name, number))

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


#: What a region's state holds, side by side and sorted by slot: the places of its keys, and the batch id and ord of the newest change of each.
STATE = "slots binary, batch_ids binary, ords binary"


def _slots(pdf: pd.DataFrame) -> np.ndarray:
    """Every key's place in its region."""
    column = lambda c: pdf[c].to_numpy(np.int64)
    return ((column("chunk_x") & 31) << 21) | ((column("chunk_z") & 31) << 16) | (column("component") << 8) | (column("subchunk_y") + 128)


def newest(pdfs: Iterator[pd.DataFrame], known: tuple[np.ndarray, ...]) -> tuple[pd.DataFrame, tuple[np.ndarray, ...]]:
    """The newest change of each key that is newer than what is known of it, with how many changes of that key came too late; what is known then.

    Changes come in pieces of any size; beside a piece one row for each key is held.
    """
    slots, batch_ids, ords = known
    best = late = None
    for pdf in pdfs:
        pdf = pdf.assign(slot=_slots(pdf))
        at = np.minimum(np.searchsorted(slots, pdf.slot), max(len(slots) - 1, 0))
        there = slots[at] == pdf.slot if len(slots) else np.zeros(len(pdf), bool)
        old_batch, old_ord = (np.where(there, x[at], -1) if len(slots) else np.full(len(pdf), -1) for x in (batch_ids, ords))
        is_late = there & ((pdf.batch_id < old_batch) | ((pdf.batch_id == old_batch) & (pdf.ord <= old_ord)))
        counted = is_late.astype("int64").groupby(pdf.slot).sum()
        late = counted if late is None else late.add(counted, fill_value=0)
        both = pdf[~is_late] if best is None else pd.concat([best, pdf[~is_late]])
        best = both.sort_values(["slot", "batch_id", "ord"], kind="stable").drop_duplicates("slot", keep="last")
    if best is None or best.empty:
        return pd.DataFrame(), known
    fresh = best.slot.to_numpy(np.int64)
    stay = ~np.isin(slots, fresh)
    all_slots = np.concatenate([slots[stay], fresh])
    order = np.argsort(all_slots)
    now = (all_slots[order], *(np.concatenate([x[stay], best[c].to_numpy(np.int64)])[order] for x, c in ((batch_ids, "batch_id"), (ords, "ord"))))
    return best.assign(late=late.reindex(fresh).to_numpy(np.int64)).drop(columns="slot"), now


def live_updates(stream: DataFrame) -> DataFrame:
    """A stream of changes (CHANGES) as updates of the live snapshot: the newest change of each key, once for each micro-batch.

    State of a region, whose keys are limited in number, is the (batch_id, ord) of the newest change of each of its keys;
    changes with an older one are late and are dropped, in sequence rather than in time. A null value tells that the key is
    deleted.
    """
    out = CHANGES + ", late long"
    names = [c.split()[0] for c in out.split(", ")]

    def update(key: tuple, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        known = tuple(np.frombuffer(bytes(x), np.int64) for x in state.get) if state.exists else (np.zeros(0, np.int64),) * 3
        rows, now = newest(pdfs, known)
        if len(rows):
            state.update(tuple(x.tobytes() for x in now))
            yield rows[names]

    return with_region(stream).groupBy(*REGION).applyInPandasWithState(update, out, STATE, "update", "NoTimeout")


def changes_per_window(stream: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Changes by kind and event-time window of the ``events`` stream, with a watermark."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("changes"), F.sum("value").alias("value"))


def upsert(view: DataFrame, batch: DataFrame) -> DataFrame:
    """A live view and a micro-batch of changes, merged."""
    return latest(with_region(view).unionByName(with_region(batch))).where("value is not null")
