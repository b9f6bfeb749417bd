"""Approximate nearest neighbours by inner product: a hierarchical k-means tree searched best bin first.

Vectors get one more component, ``sqrt(M^2 - |x|^2)`` with M the largest norm, so that the largest inner product is the
smallest distance. The tree is fitted on a bounded sample (``SAMPLE`` distinct vectors, so at most ``SAMPLE`` nodes:
its size is bounded) and indexes every vector. A query walks the tree with a priority queue of centroid distances; how
many leaves it visits is widened until the recall of calibration queries, held against all vectors, reaches ``RECALL``
by two standard errors.

Equal vectors are searched once: among them only the ``k + 1`` smallest ids can be anyone's k nearest, because ties go to
the smaller id. That is exact, and a vector that a third of all rows share costs one row.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Scratch, table

K, RECALL = 20, 0.9
#: Vectors the tree is fitted on; queries that calibrate it; vectors, and queries with what they found, held by a task at once.
SAMPLE, CALIBRATION, BLOCK, HELD = 32_768, 256, 16_384, 100_000
#: Bytes of vectors that a search task reads.
TASK_BYTES = 64 << 20
BRANCH, ROUNDS, SEED = 8, 8, 20


class Tree:
    """Centroids by node; a leaf has no children. Nodes are numbered in the order they were made."""

    def __init__(self, x: np.ndarray, leaf: int):
        self.centre, self.children, self.leaf = [x.mean(0)], [None], []
        rng, todo = np.random.default_rng(SEED), [(0, x)]
        while todo:
            node, own = todo.pop()
            parts = _kmeans(own, BRANCH, rng) if len(own) > max(leaf, 2 * BRANCH) else []
            if len(parts) < 2:
                continue
            self.children[node] = np.arange(len(self.centre), len(self.centre) + len(parts))
            for p in parts:
                todo.append((len(self.centre), p))
                self.centre.append(p.mean(0))
                self.children.append(None)
        self.centre = np.array(self.centre)
        self.leaves = [i for i, c in enumerate(self.children) if c is None]

    def assign(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.children[node] is None:
                at[rows] = node
                continue
            nearest = _distances(x[rows], self.centre[self.children[node]]).argmin(1)
            todo += [(int(c), rows[nearest == i]) for i, c in enumerate(self.children[node]) if (nearest == i).any()]
        return at

    def visit(self, q: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if self.children[node] is None:
                yield node
                continue
            for d, c in zip(_distances(q[None, :], self.centre[self.children[node]])[0].tolist(), self.children[node].tolist(), strict=True):
                heapq.heappush(queue, (d, c))


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :]


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> list[np.ndarray]:
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        at = _distances(x, c).argmin(1)
        c = np.array([x[at == i].mean(0) if (at == i).any() else c[i] for i in range(k)])
    at = _distances(x, c).argmin(1)
    return [x[at == i] for i in range(k) if (at == i).any()]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _best(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the ids and exact scores of its k largest inner products, ties to smaller ids; ids ascend."""
    out, scores = [], q @ x.T
    for row, s in enumerate(scores):
        if len(s) > k:
            least = s[np.argpartition(s, -k)[-k:]].min()
            near = np.flatnonzero(s >= least - 1e-9 * (1 + abs(least)))
        else:
            near = np.arange(len(s))
        exact = (x[near] * q[row]).sum(1)
        order = np.lexsort((ids[near], -exact))[:k]
        out.append((ids[near[order]], exact[order]))
    return out


def _rows(found: list[tuple[int, tuple[np.ndarray, np.ndarray]]]) -> pa.RecordBatch:
    q = np.repeat(np.array([i for i, _ in found], np.int64), [len(ids) for _, (ids, _) in found])
    return pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.concatenate([ids for _, (ids, _) in found])), pa.array(np.concatenate([s for _, (_, s) in found]))], ["qid", "vid", "score"])


def _join_blocks(batches: Iterator[pa.RecordBatch], dim: int, k: int) -> Iterator[pa.RecordBatch]:
    """Rows (leaf, block, kind, id, vector) come sorted: a block's vectors (kind 0), then the queries that visit it.

    What a query found in the task's blocks is merged before it is passed on.
    """
    here, ids, vectors, made = None, [], [], None
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def merge(q: int, near: np.ndarray, scores: np.ndarray) -> None:
        if q in found:
            near, scores = np.concatenate((found[q][0], near)), np.concatenate((found[q][1], scores))
            order = np.lexsort((near, -scores))[:k]
            near, scores = near[order], scores[order]
        found[q] = near, scores

    for b in batches:
        key = np.stack([b.column(i).to_numpy() for i in range(3)], 1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), b.num_rows] if b.num_rows else []
        for i, j in zip(cuts, cuts[1:]):
            part, (leaf, block, kind) = b.slice(i, j - i), key[i].tolist()
            if (leaf, block) != here:
                here, ids, vectors, made = (leaf, block), [], [], None
            own, x = part.column(3).to_numpy(), _matrix(part.column(4), dim)
            if kind == 0:
                ids.append(own)
                vectors.append(x)
            elif vectors:
                made = made or (np.concatenate(vectors), np.concatenate(ids))
                for a in range(0, len(own), 64):
                    for q, (near, scores) in zip(own[a : a + 64].tolist(), _best(x[a : a + 64], *made, k), strict=True):
                        merge(q, near, scores)
                if len(found) >= HELD:
                    yield _rows(list(found.items()))
                    found.clear()
    if found:
        yield _rows(list(found.items()))


def _top(df: DataFrame, by: str, k: int, id_col: str) -> DataFrame:
    """The first k rows of each ``by``, with their rank from 1; partial ranks are cut before the shuffle."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), id_col)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _visits(ranks: list[list[int]], leaves: int, recall: float) -> int:
    """The least number of leaves whose recall over the queries' neighbours, less two standard errors, is enough; all, if none is."""
    ranks = [r for r in ranks if r]
    for v in range(1, leaves if ranks else 1):
        reached = np.array([np.mean(np.array(r) < v) for r in ranks])
        if reached.mean() - 2 * reached.std() / math.sqrt(len(reached)) >= recall:
            return v
    return leaves


def nearest(
    df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, recall: float = RECALL
) -> DataFrame:
    """(query_id, rank int from 1, id, score double): the k nearest found of each query row, all candidates if fewer.

    Candidates are all rows but the query's own. Score is the inner product in double precision. Vectors that are null,
    zero, of another length than most, or that hold null or non-finite components take no part, nor do null ids; rows that
    repeat an id count once. Other columns are ignored; a table without vectors gives an empty result.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "ann")
    kind = df.schema[vector_col].dataType.elementType.simpleString()
    v = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), is_query.alias("asks"))
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    v = v.where("id is not null and vector is not null").where(~F.exists("vector", bad) & F.exists("vector", lambda c: c != 0))
    dims = v.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    empty = spark.sql(f"select 0L as query_id, 1 as rank, 0L as {id_col}, 0d as score where false")
    if not dims:
        return empty
    dim = dims["dim"]
    v = v.where(F.size("vector") == dim)
    few = Window.partitionBy("vector").orderBy("id")
    distinct = v.dropDuplicates(["id", "vector"]).withColumn("n", F.row_number().over(few)).where(F.col("n") <= k + 1)
    distinct = scratch.put(distinct.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("vid"), "ids", "vector"))
    asking = v.where("asks").select("id", "vector")
    queries = scratch.put(asking.groupBy("vector").agg(F.min("id").alias("qid")).select("qid", "vector"))

    norm = F.aggregate("vector", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    n, most = distinct.agg(F.count("*"), F.max(norm)).first()
    lift = lambda x: np.concatenate((x, np.sqrt(np.maximum(0, most - (x * x).sum(1)))[:, None]), 1)
    sample = np.array([r[0] for r in distinct.orderBy(F.xxhash64("vid"), "vid").limit(SAMPLE).select("vector").collect()], np.float64)
    tree = Tree(lift(sample), max(8, math.ceil(4 * len(sample) / math.sqrt(n))))  # about as many leaves as vectors in one
    shared = spark.sparkContext.broadcast((tree, most))

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, most = shared.value
        for b in batches:
            x = _matrix(b.column(1), dim)
            x = np.concatenate((x, np.sqrt(np.maximum(0, most - (x * x).sum(1)))[:, None]), 1)
            yield pa.RecordBatch.from_arrays([pa.array(tree.assign(x), pa.int32()), *b.columns], ["leaf", "vid", "vector"])

    index = scratch.put(distinct.select("vid", "vector").mapInArrow(assigned, f"leaf int, vid long, vector array<{kind}>"))
    sizes = {r["leaf"]: r["count"] for r in index.groupBy("leaf").count().collect()}

    # widen until the calibration queries' true neighbours are reached
    asked = queries.orderBy(F.xxhash64("qid"), "qid").limit(CALIBRATION)
    asked = distinct.join(F.broadcast(asked), "vector").select("qid", "vid", F.size("ids").alias("same"), "vector").collect()
    if not asked:
        return empty
    alone = {(r["qid"], r["vid"]) for r in asked if r["same"] == 1}  # a query isn't its own neighbour
    cq, cx = np.array([r["qid"] for r in asked], np.int64), np.array([r["vector"] for r in asked], np.float64)

    def all_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield _rows(list(zip(cq.tolist(), _best(cx, _matrix(b.column(1), dim), b.column(0).to_numpy(), k + 1), strict=True)))

    true = _top(index.select("vid", "vector").mapInArrow(all_rows, "qid long, vid long, score double"), "qid", k + 1, "vid")
    true = [r for r in true.join(index.select("vid", "leaf"), "vid").select("qid", "vid", "leaf").collect() if (r["qid"], r["vid"]) not in alone]
    places = {int(q): {leaf: i for i, leaf in enumerate(tree.visit(np.append(x, 0.0)))} for q, x in zip(cq, cx, strict=True)}
    visits = _visits([[places[q][r["leaf"]] for r in true if r["qid"] == q] for q in places], len(tree.leaves), recall)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, _ = shared.value
        for b in (whole.slice(a, 32) for whole in batches for a in range(0, whole.num_rows, 32)):
            row, leaf = [], []
            for i, q in enumerate(_matrix(b.column(1), dim)):
                seen = 0
                for j, at in enumerate(tree.visit(np.append(q, 0.0))):
                    if j >= visits and seen > k:
                        break
                    seen += sizes.get(at, 0)
                    row.append(i)
                    leaf.append(at)
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int32()), b.column(0).take(take), b.column(1).take(take)], ["leaf", "qid", "vector"])

    large = {leaf: math.ceil(c / BLOCK) for leaf, c in sizes.items() if c > BLOCK}  # at most n / BLOCK leaves of a bounded tree
    blocks = reduce(lambda e, x: F.when(F.col("leaf") == x[0], F.lit(x[1])).otherwise(e), large.items(), F.lit(1))
    held = index.select("leaf", F.pmod(F.xxhash64("vid"), blocks).cast("int").alias("block"), F.lit(0).alias("kind"), F.col("vid").alias("id"), "vector")
    visiting = queries.mapInArrow(routed, f"leaf int, qid long, vector array<{kind}>")
    visiting = visiting.select("leaf", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.lit(1).alias("kind"), F.col("qid").alias("id"), "vector")
    size = (n + queries.count() * visits) * dim * (8 if kind == "double" else 4)
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(size / TASK_BYTES))
    met = held.unionByName(visiting).repartition(tasks, "leaf", "block").sortWithinPartitions("leaf", "block", "kind")
    found = _top(met.mapInArrow(lambda bs: _join_blocks(bs, dim, k + 1), "qid long, vid long, score double"), "qid", k + 1, "vid").drop("rank")
    rows = found.join(distinct.select("vid", F.explode("ids").alias("id")), "vid").select("qid", "id", "score")
    best = _top(rows, "qid", k + 1, "id").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("best"))
    named = asking.join(queries.withColumnRenamed("vector", "same"), F.col("vector") == F.col("same")).select(F.col("id").alias("query_id"), "qid").distinct()
    others = named.join(best, "qid").select("query_id", F.slice(F.filter("best", lambda b: b["id"] != F.col("query_id")), 1, k).alias("best"))
    return others.select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("b.id").alias(id_col), "b.score")


def op2_kmeans_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
