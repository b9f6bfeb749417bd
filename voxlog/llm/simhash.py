"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints at most ``radius`` bits apart share a variant within half the radius of both. Every distinct
fingerprint emits all its variants, rows meet on the variant, and colliding fingerprints are linked. The shuffle is
keyed by a variant's leading bits: a fingerprint is sent once to each prefix that some variant of it has, and the
variants of that prefix are made where they meet, so 2,081 variants of a 64-bit fingerprint cost a few dozen shuffled
rows. Every collision is a true link (triangle inequality); it is verified all the same. The members of a colliding
group are linked to its smallest one only, which keeps what is reachable and never makes all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, connected_components, table, text_of, tidied

BITS, RADIUS, WORDS, SEED = 64, 4, 4, 42
#: Variants that one prefix should hold, and that are made at a time; the longest prefix.
PREFIX_VARIANTS, MADE_AT_ONCE, LONGEST = 4_000_000, 4_000_000, 32
#: Routed rows of a task: what it reads doesn't grow with the table, its number of prefixes does.
TASK_ROWS = 4_000_000
#: Shingles whose bits are counted at a time.
SHINGLES_AT_ONCE = 16_384


def majority(hashes: Iterable[np.ndarray], n: int) -> int:
    """The fingerprint of n shingles, whose hashes come in parts, as a signed number: the bits that over half of them set."""
    counts = np.zeros(BITS, np.int64)
    for h in hashes:
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The 64-bit fingerprint of UTF-8 bytes, as a signed number."""
    found = text.lower().split()  # bytes: lowers A-Z only, splits at \x20 and \x09-\x0D only
    if not found:
        return 0
    whole = b" ".join(found)
    lengths = np.fromiter(map(len, found), np.int64, len(found)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    k = min(words, len(found))
    starts, ends = starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest, n = xxhash.xxh64_intdigest, len(ends)
    cuts = range(0, n, SHINGLES_AT_ONCE)
    return majority((np.array([digest(whole[a:b], SEED) for a, b in zip(starts[i : i + SHINGLES_AT_ONCE], ends[i : i + SHINGLES_AT_ONCE])], np.uint64) for i in cuts), n)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), np.int64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["id", "fp"])


def _near(bits: int, at_most: int) -> list[int]:
    """Masks of ``bits`` bits with at most so many set."""
    return [sum(1 << i for i in c) for k in range(at_most + 1) for c in combinations(range(bits), k)]


def _links(fps: np.ndarray, prefix: int, length: int, half: int, at_once: int, out: list[np.ndarray]) -> None:
    """Appends (smallest, other) for the fingerprints that share a variant whose first ``length`` bits are ``prefix``."""
    low = BITS - length
    used = np.bitwise_count((fps >> np.uint64(low)) ^ np.uint64(prefix)) if 0 < length < BITS else np.zeros(len(fps), np.uint8)
    if len(fps := fps[used <= half]) < 2:
        return
    used = used[used <= half]
    ways = [sum(math.comb(low, j) for j in range(half - u + 1)) for u in range(half + 1)]
    if sum(int((used == u).sum()) * ways[u] for u in range(half + 1)) > at_once and low > 4:
        for bit in (0, 1):
            _links(fps, prefix * 2 + bit, length + 1, half, at_once, out)
        return
    rest = fps & np.uint64((1 << low) - 1)
    keys, owners = [], []
    for u in range(half + 1):
        own = np.flatnonzero(used == u).astype(np.uint32)
        masks = np.array(_near(low, half - u), np.uint64)
        keys.append((rest[own][:, None] ^ masks[None, :]).ravel())
        owners.append(np.repeat(own, len(masks)))
    keys, owners = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(keys)
    keys = keys[order]
    same = keys[1:] == keys[:-1]
    if not same.any():
        return
    group = np.concatenate(([0], np.cumsum(~same)))
    shared = np.concatenate((same, [False])) | np.concatenate(([False], same))
    group, member = group[shared], fps[owners[order[shared]]]
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    least = np.minimum.reduceat(member, first)
    least = np.repeat(least, np.diff(np.concatenate((first, [len(group)]))))
    pairs = np.stack((least, member), axis=1)[least != member]
    out.append(np.unique(pairs, axis=0))


def _meet(batches: Iterator[pa.RecordBatch], length: int, half: int, at_once: int) -> Iterator[pa.RecordBatch]:
    """Rows (at, fp) come sorted by their prefix ``at``; one prefix is held at a time."""
    here, held = None, []

    def met() -> Iterator[pa.RecordBatch]:
        out: list[np.ndarray] = []
        if here is not None:
            _links(np.concatenate(held), here, length, half, at_once, out)
        for pairs in out:
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].view(np.int64)), pa.array(pairs[:, 1].view(np.int64))], ["a", "b"])

    for b in batches:
        at, fps = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
        cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)] if len(at) else []
        for i, j in zip(cuts, cuts[1:]):
            if at[i] != here:
                yield from met()
                here, held = int(at[i]), []
            held.append(fps[i:j])
    yield from met()


def near_links(fps: DataFrame, radius: int = RADIUS, at_once: int = MADE_AT_ONCE) -> DataFrame:
    """(a long, b long): links among the distinct fingerprints of column ``fp``, enough for all that is reachable.

    ``at_once`` bounds the variants that a worker makes at a time, and with them its memory.
    """
    n, half = fps.count(), radius // 2
    variants = sum(math.comb(BITS, j) for j in range(half + 1))
    length = min(LONGEST, max(4, math.ceil(math.log2(max(2, n * variants / PREFIX_VARIANTS)))))
    masks = F.array(*[F.lit(m) for m in _near(length, half)])
    head = F.call_function("shiftrightunsigned", F.col("fp"), F.lit(BITS - length))
    routed = fps.select(F.explode(F.transform(masks, lambda m: head.bitwiseXOR(m).cast("long"))).alias("at"), "fp")
    routes = n * sum(math.comb(length, j) for j in range(half + 1))
    tasks = min(1 << length, max(fps.sparkSession.sparkContext.defaultParallelism * 4, math.ceil(routes / TASK_ROWS)))
    met = routed.repartition(tasks, "at").sortWithinPartitions("at").mapInArrow(lambda bs: tidied(_meet(bs, length, half, at_once)), "a long, b long")
    return met.distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per row of ``df``: id, fp long, component_id (the smallest id reachable over links, itself included).

    A text of fewer words than a shingle is one shingle; one without words, empty or null, has fingerprint zero and is
    linked like any other. A null id can't be a component's id unless the component has no other. Repeated rows link as
    copies do. Other columns are ignored; an empty table gives an empty result.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "simhash")
    schema = f"id {df.schema[id_col].dataType.simpleString()}, fp long"
    d = scratch.put(df.select(F.col(id_col).alias("id"), text_of(text_col).cast("binary").alias("t")).mapInArrow(_fingerprints, schema))
    fps = scratch.put(d.groupBy("fp").agg(F.min("id").alias("least")))
    roots = connected_components(near_links(fps.select("fp"), radius), scratch)
    labelled = fps.join(roots, fps.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    component = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    named = labelled.join(component, "root").select("fp", "component_id")
    return d.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
