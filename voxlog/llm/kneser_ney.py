"""Quality classifier: an interpolated modified Kneser-Ney model of character n-grams, trained on trusted text.

N-grams are strings, of any characters. Counting and scoring are joins sharded by n-gram:

1. trusted text gives its n-grams with their counts; counts, continuation counts and context sums of every order are
   grouped by n-gram;
2. all text is cut into blocks of bounded bytes, runs of rows of a file split; each gives its different n-grams, and the
   probabilities of all n-grams that occur anywhere are joined together order by order;
3. each block's n-grams are joined with their probabilities and meet the block's texts, compressed, which are scored there.

Only ids below a checked number are broadcast. Thresholds are quantiles of trusted documents' perplexity, by language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, table, text_of, tidied

#: Characters of an n-gram; the probability of a character of which nothing is known: one of all code points.
ORDER, UNIFORM = 4, 1 / 0x110000
#: Of trusted documents, by language, the share up to whose excess a document is kept, and the slack on it. The mean over
#: few characters varies more: a text of n characters is allowed 1 + SHORT / sqrt(n) times the excess of a long one.
QUANTILE, SLACK, SHORT = 0.99, 1.3, 10.0
#: Held-out documents that tell a language's median.
FEW = 30
#: One in so many trusted documents isn't trained on: unseen text is what the limits must hold for.
HELD_OUT = 4
#: Bytes of text handled at a time; bytes of text of a block; n-grams that a task gathers before it passes them on; ids
#: (a number each) that are broadcast at most.
BYTES_AT_ONCE, BLOCK_BYTES, GRAMS_HELD, BROADCAST_IDS = 1 << 20, 64 << 20, 1_000_000, 200_000


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, each after its padding; where n-grams end; the characters of each text."""
    pad = "\0" * (ORDER - 1)
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    s = np.frombuffer("".join([pad + t for t in texts]).encode("utf-32-le"), np.uint32)
    own = np.ones(len(s), bool)
    starts = np.cumsum(n + ORDER - 1) - (n + ORDER - 1)
    for i in range(ORDER - 1):
        own[starts + i] = False
    return s, np.flatnonzero(own), n


class Keys:
    """Numbers for n-grams over an alphabet: characters' places side by side where 63 bits hold them, else ranks order by order."""

    def __init__(self, alphabet: np.ndarray, bits: int = 63):
        self.alphabet, self.place = alphabet, np.zeros(0x110000, np.int32)
        self.place[alphabet] = np.arange(len(alphabet))
        self.size = max(2, len(alphabet))
        self.bits = (self.size - 1).bit_length()
        self.packed, self.ranks = self.bits * ORDER <= bits, []

    def of(self, s: np.ndarray, ends: np.ndarray, learn: bool = False) -> np.ndarray:
        """Keys of the n-grams that end at ``ends``; they must be among those that were learnt."""
        c = self.place[s].astype(np.int64)
        if self.packed:
            k = c.copy()
            for i in range(1, ORDER):
                k[i:] |= c[:-i] << (self.bits * i)
            return k[ends]
        k = c[ends - ORDER + 1]
        for i in range(ORDER - 2, -1, -1):
            k = k * self.size + c[ends - i]
            if learn:
                self.ranks.append(np.unique(k))
            k = np.searchsorted(self.ranks[ORDER - 2 - i], k)
        return k

    def different(self, s: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code points of the different n-grams, a row each, and their counts."""
        if self.packed:
            k, counts = np.unique(self.of(s, ends), return_counts=True)
            return self.alphabet[np.stack([k >> (self.bits * i) & ((1 << self.bits) - 1) for i in range(ORDER - 1, -1, -1)], 1)], counts
        _, first, counts = np.unique(self.of(s, ends, True), return_index=True, return_counts=True)
        return s[ends[first][:, None] - np.arange(ORDER - 1, -1, -1)[None, :]], counts


def _different(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The different n-grams of texts and their counts."""
    s, ends, _ = _codes(texts)
    if not len(ends):
        return pa.array([], pa.string()), np.empty(0, np.int64)
    codes, counts = Keys(np.flatnonzero(np.bincount(s)).astype(np.uint32)).different(s, ends)
    whole = codes.astype(np.uint32).tobytes().decode("utf-32-le")
    return pa.array([whole[i : i + ORDER] for i in range(0, len(whole), ORDER)], pa.string()), counts.astype(np.int64)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Columns split, text, ... -> (block, rows) of about BYTES_AT_ONCE bytes of text.

    A row's block follows from the bytes of its split's rows before it, so it is the same whenever the split is read.
    """
    so_far: dict[int, int] = {}
    for b in batches:
        split, sizes = b.column(0).to_numpy(), pc.binary_length(b.column(1)).to_numpy().astype(np.int64) + 1
        runs = [0, *(np.flatnonzero(split[1:] != split[:-1]) + 1).tolist(), b.num_rows] if b.num_rows else []
        for i, j in zip(runs, runs[1:]):
            before = so_far.get(int(split[i]), 0) + np.cumsum(sizes[i:j]) - sizes[i:j]
            so_far[int(split[i])] = int(before[-1] + sizes[j - 1])
            at = before // BYTES_AT_ONCE
            cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), j - i]
            for k, m in zip(cuts, cuts[1:]):
                block = (int(split[i]) + int(before[k]) // BLOCK_BYTES * 0x9E3779B97F4A7C15 + (1 << 63)) % (1 << 64) - (1 << 63)
                yield block, b.slice(i + k, m - k)


def _summed(held: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(held).group_by("gram").aggregate([("n", "sum")]).rename_columns(["gram", "n"]) if len(held) > 1 else held[0]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns split, text -> gram, its count so far."""
    held: list[pa.Table] = []
    for _, b in _parts(batches):
        grams, counts = _different(b.column(1).to_pylist())
        held.append(pa.table({"gram": grams, "n": counts}))
        if sum(t.num_rows for t in held) >= GRAMS_HELD:
            held = [_summed(held)]
            if held[0].num_rows >= GRAMS_HELD // 2:
                yield from held.pop().to_batches(1 << 16)
    if held:
        yield from _summed(held).to_batches(1 << 16)


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns split, text -> block, its different n-grams."""
    here, held = None, []

    def done() -> Iterator[pa.RecordBatch]:
        for part in _summed(held).select(["gram"]).to_batches(1 << 16) if held else ():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, here, np.int64)), part.column(0)], ["block", "gram"])
        held.clear()

    for block, b in _parts(batches):
        if block != here:
            yield from done()
            here = block
        grams, counts = _different(b.column(1).to_pylist())
        held.append(pa.table({"gram": grams, "n": counts}))
        if len(held) == 8:
            held[:] = [_summed(held)]
    yield from done()


def _parcels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns split, text, id, lang -> block, parcel: some rows of a block, compressed."""
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for block, b in _parts(batches):
        rows, sink = b.select(["text", "id", "lang"]), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=options) as w:
            w.write_batch(rows)
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "parcel"])


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows block, kind, gram, logp, parcel, sorted: a block's n-grams (kind 0), then its parcels (kind 1)."""
    here, grams, logs, made = None, [], [], None
    for b in batches:
        block, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero((block[1:] != block[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), b.num_rows] if b.num_rows else []
        for i, j in zip(cuts, cuts[1:]):
            if block[i] != here:
                here, grams, logs, made = block[i], [], [], None
            if kind[i] == 0:
                grams.append("".join(b.column(2).slice(i, j - i).to_pylist()))
                logs.append(b.column(3).slice(i, j - i).to_numpy(zero_copy_only=False))
                continue
            if made is None:
                s = np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32)
                keys = Keys(np.unique(s))
                k = keys.of(s, np.arange(ORDER - 1, len(s), ORDER), True)
                made, grams = (pa.array(k), np.concatenate(logs) if logs else np.empty(0)), []
            for parcel in b.column(4).slice(i, j - i):
                for rows in pa.ipc.open_stream(parcel.as_py()):
                    s, ends, n = _codes(rows.column(0).to_pylist())
                    log = made[1][pc.index_in(pa.array(keys.of(s, ends)), value_set=made[0]).to_numpy()] if len(ends) else np.empty(0)
                    sums = np.bincount(np.repeat(np.arange(len(n)), n), log, len(n))
                    with np.errstate(invalid="ignore", divide="ignore"):
                        ppl = np.exp(-sums / n)
                    yield pa.RecordBatch.from_arrays([rows.column(1), rows.column(2), pa.array(n), pa.array(ppl, mask=n == 0)], ["id", "lang", "chars", "perplexity"])


def _probabilities(grams: DataFrame, counts: DataFrame, scratch: Scratch) -> DataFrame:
    """(gram, p) for the different n-grams of ``grams``, from the n-gram counts (gram, n) of trusted text."""
    last = lambda c, size, n: F.substring(c, size - n + 1, n)
    by_order = {ORDER: counts}
    for n in range(ORDER - 1, 0, -1):  # continuation counts: different characters before it
        by_order[n] = scratch.put(by_order[n + 1].groupBy(last(F.col("gram"), n + 1, n).alias("gram")).agg(F.count("*").alias("n")))
    asked = {ORDER: grams}
    for n in range(ORDER - 1, 0, -1):
        asked[n] = scratch.put(asked[n + 1].select(last(F.col("gram"), n + 1, n).alias("gram")).distinct())
    p = None
    for n in range(1, ORDER + 1):
        c = by_order[n]
        of = {r["n"]: r["count"] for r in c.where("n <= 4").groupBy("n").count().collect()}
        n1, n2, n3, n4 = (of.get(i, 0) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        d = [min(max(x, 0.01), i) for i, x in ((1, 1 - 2 * y * n2 / n1 if n1 else 0.5), (2, 2 - 3 * y * n3 / n2 if n2 else 1.0), (3, 3 - 4 * y * n4 / n3 if n3 else 1.5))]
        off = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        context = c.groupBy(F.substring("gram", 1, n - 1).alias("context")).agg(F.sum("n").alias("total"), F.sum(off).alias("taken"))
        held = c.select("gram", (F.col("n") - off).alias("left"))
        joined = asked[n].withColumn("context", F.substring("gram", 1, n - 1)).join(held, "gram", "left").join(context, "context", "left")
        lower = F.lit(UNIFORM) if p is None else F.col("lower")
        if p is not None:
            joined = joined.withColumn("short", last(F.col("gram"), n, n - 1)).join(p.select(F.col("gram").alias("short"), F.col("p").alias("lower")), "short")
        mixed = (F.coalesce("left", F.lit(0.0)) + F.col("taken") * lower) / F.col("total")
        p = scratch.put(joined.select("gram", F.when(F.col("total").isNull(), lower).otherwise(mixed).alias("p")))
    return p


def with_ids(df: DataFrame, id_col: str, ids: DataFrame, how: str) -> DataFrame:
    """Joins a narrow written table by ``id_col``; broadcast while its rows are few, a shuffle beyond."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, id_col, how)


def perplexities(df: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", trains: Column | None = None) -> DataFrame:
    """One row per row of ``df``: id, lang, trusted, chars, perplexity (per character; null for an empty or null text).

    ``trusted_ids`` has one column of ids, named as ``id_col``; of these, where ``trains`` is given, the model is trained
    on those for which it holds. With no trusted text every character is equally likely.
    """
    scratch = Scratch(df.sparkSession, "kneser-ney")
    rows = df.select(text_of(text_col).alias("text"), F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"))
    if not rows.where(F.input_file_name() == "").isEmpty():  # not read from files: written, so that it is
        rows = scratch.put(rows)
    rows = rows.select(F.xxhash64(F.input_file_name(), F.input_file_block_start()).alias("split"), "text", "id", "lang")
    trained = F.lit(True) if trains is None else trains
    ids = trusted_ids.select(F.col(id_col).cast("long").alias(id_col)).where(F.col(id_col).isNotNull()).distinct()
    ids = scratch.put(ids.select(F.col(id_col).alias("id"), trained.alias("trained")))
    learnt = with_ids(rows.select("split", "text", "id"), "id", scratch.put(ids.where("trained").select("id")), "left_semi")
    counts = scratch.put(learnt.select("split", "text").mapInArrow(lambda bs: tidied(_counted(bs)), "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    grams = scratch.put(rows.select("split", "text").mapInArrow(lambda bs: tidied(_blocked(bs)), "block long, gram string"))
    p = _probabilities(scratch.put(grams.select("gram").distinct()), counts, scratch)
    known = grams.join(p, "gram").select("block", F.lit(0).alias("kind"), "gram", F.log("p").alias("logp"), F.lit(None).cast("binary").alias("parcel"))
    parcels = rows.mapInArrow(lambda bs: tidied(_parcels(bs)), "block long, parcel binary").select("block", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("gram"), F.lit(None).cast("double").alias("logp"), "parcel")
    places = scratch.put(grams.select("block").distinct().coalesce(1).withColumn("place", F.monotonically_increasing_id()))
    blocks, met = max(1, places.count()), known.unionByName(parcels)
    if blocks <= BROADCAST_IDS:  # a block a task; beyond, there are so many that hashing spreads them well
        met = met.join(F.broadcast(places), "block", "left").repartitionById(blocks, F.col("place").cast("int")).drop("place")
    else:
        met = met.repartition(blocks, "block")
    scores = scratch.put(met.sortWithinPartitions("block", "kind").mapInArrow(lambda bs: tidied(_scored(bs)), "id long, lang string, chars long, perplexity double"))
    scratch.drop(grams, p, counts)
    return with_ids(scores, "id", ids, "left").select(F.col("id").alias(id_col), "lang", F.col("trained").isNotNull().alias("trusted"), "chars", "perplexity")


def quality(df: DataFrame, trusted_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE, slack: float = SLACK) -> DataFrame:
    """One row per row of ``df``: id, lang, perplexity, threshold, kept.

    One in HELD_OUT trusted documents only serves to set the limits. A document's excess is the logarithm of its perplexity
    over its language's median, divided by what its length lets expect (see SHORT). A language's limit is the quantile
    of their excess, or that of all languages if it is larger (few documents say little about a quantile), times
    ``slack``. A language of fewer than FEW such documents is given the quantile of all perplexities for a median if that is
    larger, and so are unknown and null languages. Texts without characters are not kept. Without any trusted text
    nothing else is rejected. Repeated rows are judged each; other columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(df.sparkSession, "quality")
    ids = trusted_ids.select(F.col(id_col).cast("long").alias(id_col)).distinct()
    held_out = F.pmod(F.xxhash64(id_col), F.lit(HELD_OUT)) == 0
    scores = perplexities(df, ids, id_col, text_col, lang_col, ~held_out)
    seen = scratch.put(scores.where("trusted and perplexity is not null").where(held_out))
    overall = seen.agg(F.percentile_approx("perplexity", quantile, 10_000)).first()[0]
    middle = F.percentile_approx("perplexity", 0.5, 10_000)
    base = F.when(F.count("*") < FEW, F.greatest(middle, F.lit(overall))).otherwise(middle).cast("double")
    typical = scratch.put(seen.where("lang is not null").groupBy("lang").agg(middle.alias("median"), base.alias("base")))
    spread = 1 + SHORT / F.sqrt(F.greatest("chars", F.lit(1)))
    excess = scratch.put(with_ids(seen, "lang", typical, "inner").select("lang", (F.log(F.col("perplexity") / F.col("median")) / spread).alias("excess")))
    limits = scratch.put(excess.groupBy("lang").agg(F.percentile_approx("excess", quantile, 10_000).alias("high")).join(typical, "lang"))
    wide = excess.agg(F.percentile_approx("excess", quantile, 10_000)).first()[0]
    judged = with_ids(scores, "lang", limits, "left")
    limit = F.greatest("high", F.lit(wide).cast("double"))
    judged = judged.withColumn("threshold", F.coalesce("base", F.lit(overall).cast("double")) * F.exp(slack * F.coalesce(limit, F.lit(0.0)) * spread))
    kept = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.col("perplexity").isNotNull())
    return judged.select(id_col, "lang", "perplexity", "threshold", kept.alias("kept"))


def trusted_labels(labels: DataFrame) -> DataFrame:
    """Ids that are labelled good and never bad or toxic."""
    return labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 and coalesce(t, 0) = 0").select("doc_id")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), trusted_labels(table(spark, sf_dir, "labels")))
