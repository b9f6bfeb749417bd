"""SimHash near copies by word shingles: fingerprints propose pairs, the shingles decide.

A text's SimHash fingerprint is that of its different shingles. Ball hashing (``simhash.near_links``) finds all
fingerprints at most RADIUS bits apart; texts whose fingerprints reach each other that way are a group. At a similarity of
0.8 fingerprints differ by about 9 bits, more than ball hashing reaches, so links are sought by partial fingerprints
as well: bands of ROWS min-hashes each. Two texts of similarity s share one with probability
1 - (1 - s^ROWS)^BANDS, 0.99997 at 0.8.

Of the texts of a group, or of those that share a partial fingerprint, pivots are held against the others, as long as some
aren't linked already: what is reachable is found without making all pairs. A pair is linked where the Jaccard
similarity of the shingle sets is high enough. Texts of one shingle set are one node, so copies cost no pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, connected_components, text_of, tidied
from .simhash import RADIUS, majority, near_links

WORDS, SIMILARITY, SEED = 5, 0.8, 42
BANDS, ROWS = 20, 4
#: A band's pivots grow by this factor from round to round; shingles whose hashes are taken at a time, variants made at a time.
PIVOTS, SHINGLES_AT_ONCE, MADE_AT_ONCE = 4, 16_384, 500_000
#: Numbers of a set's profile: how many of its shingles fall to each. What two profiles have in common bounds what the sets have.
COUNTS = 256
_MIX = np.random.default_rng(SEED).integers(1, 2**63, (3, BANDS * ROWS), np.uint64) | np.uint64(1)


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The sorted different hashes of the word shingles of UTF-8 bytes; a shorter text is one shingle, none has none."""
    found = text.lower().split()  # bytes: lowers A-Z only, splits at \x20 and \x09-\x0D only
    if not found:
        return np.empty(0, np.uint64)
    whole = b" ".join(found)
    lengths = np.fromiter(map(len, found), np.int64, len(found)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    k = min(words, len(found))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(whole[a:b], SEED) for a, b in zip(starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64))


def partial_fingerprints(of: np.ndarray) -> np.ndarray:
    """A number for each band."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(of), SHINGLES_AT_ONCE):
        x = (of[i : i + SHINGLES_AT_ONCE, None] ^ _MIX[0]) * _MIX[1]
        least = np.minimum(least, (x ^ (x >> np.uint64(32))).min(0))
    mixed = (least * _MIX[2]).reshape(BANDS, ROWS)
    return (mixed ^ (mixed >> np.uint64(29))).sum(1, dtype=np.uint64) * _MIX[1, :BANDS]


def simhash(of: np.ndarray) -> int:
    """The SimHash fingerprint of a set of shingles, zero for none, as a signed number."""
    return majority((of[i : i + SHINGLES_AT_ONCE] for i in range(0, len(of), SHINGLES_AT_ONCE)), len(of))


def _digest(of: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(of.tobytes(), SEED)).view(np.int64))


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int, partial: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets, sizes, fps, bands = [], [], [], []
        for t in b.column(1):
            s = shingles(t.as_py(), words)
            sets.append(_digest(s))
            sizes.append(len(s))
            fps.append(simhash(s))
            bands.append(partial_fingerprints(s)[:partial].view(np.int64) if len(s) else np.empty(0, np.int64))
        numbers = [pa.array(x, pa.int64()) for x in (sets, sizes, fps)]
        yield pa.RecordBatch.from_arrays([b.column(0), *numbers, pa.array(bands, pa.list_(pa.int64()))], ["row", "of", "n", "fp", "bands"])


def _shingled(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingles(t.as_py(), words) for t in b.column(0)]
        counts = [np.bincount(s & np.uint64(COUNTS - 1), minlength=COUNTS) for s in sets]
        yield pa.RecordBatch.from_arrays([pa.array(list(map(_digest, sets)), pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int32()))], ["of", "hashes", "counts"])


def _links(pairs: DataFrame, hashes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar enough."""
    both = pairs.join(hashes.select(F.col("of").alias("a"), F.col("hashes").alias("x")), "a").join(hashes.select(F.col("of").alias("b"), F.col("hashes").alias("y")), "b")
    common = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("common"), (F.size("x") + F.size("y")).alias("sizes"))
    return common.where(F.col("common") >= similarity * (F.col("sizes") - F.col("common")) - 1e-9).select("a", "b")


def _reachable(met: DataFrame, hashes: DataFrame, similarity: float, scratch: Scratch) -> DataFrame | None:
    """(node, root) of the sets that are linked to others, from those that share a band (band, of, n, counts).

    In each round some members of a band, its pivots, are held against the others whose group isn't theirs yet; a pivot is
    settled then. Rounds go on while a band has unsettled members of different groups, each with PIVOTS times the
    pivots of the one before, so that there are few rounds. A pair is made only where the profiles leave it open whether
    the sets are similar enough, which is exact; so a band of m texts costs about m pairs, near copies or not.
    """
    roots = settled = None
    for r in itertools.count():
        here = met.join(settled, ["band", "of"], "left_anti") if settled is not None else met
        if roots is not None:
            here = here.join(roots.withColumnRenamed("node", "of"), "of", "left")
        here = here.select("band", "of", "n", "counts", F.coalesce("root", "of").alias("root") if roots is not None else F.col("of").alias("root"))
        divided = here.groupBy("band").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("band")
        here = scratch.put(here.join(divided, "band", "left_semi"))
        if here.isEmpty():
            return roots
        slot = F.pmod(F.xxhash64("of", F.lit(r)), F.lit(PIVOTS**r)).alias("slot")
        pivots = scratch.put(here.groupBy("band", slot).agg(F.min("of").alias("p"), F.min_by("n", "of").alias("pn"), F.min_by("root", "of").alias("pr")).drop("slot"))
        profiled = pivots.join(here.select("band", F.col("of").alias("p"), F.col("counts").alias("pc")), ["band", "p"])
        least = F.aggregate(F.zip_with("counts", "pc", lambda x, y: F.least(x, y)), F.lit(0), lambda a, x: a + x)
        alike = (F.least("n", "pn") >= similarity * F.greatest("n", "pn") - 1e-9) & (least >= similarity / (1 + similarity) * (F.col("n") + F.col("pn")) - 1e-6)
        pairs = here.join(profiled, "band").where((F.col("root") != F.col("pr")) & alike).select(F.least("of", "p").alias("a"), F.greatest("of", "p").alias("b")).distinct()
        links = scratch.put(_links(pairs, hashes, similarity))
        known = roots.select(F.col("node").alias("a"), F.col("root").alias("b")) if roots is not None else None
        read = [here, pivots, links]
        if not links.isEmpty():
            read += [roots] if roots is not None else []
            roots = scratch.put(connected_components(links if known is None else links.unionByName(known), scratch))
        now = pivots.select("band", F.col("p").alias("of"))
        read += [settled] if settled is not None else []
        settled = scratch.put(now if settled is None else settled.unionByName(now))
        scratch.drop(*read)


def near_copies(df: DataFrame, row_col: str, text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, radius: int = RADIUS, partial: int = BANDS) -> DataFrame:
    """One row per row of ``df``: row, component (the smallest row reachable over links of at least ``similarity``).

    Links are sought among the sets whose SimHash fingerprints reach each other by steps of ``radius`` bits, all of them,
    and among those that share one of ``partial`` partial fingerprints.
    ``row_col`` is a long that numbers the rows, without nulls and repeats, and must stay when ``df`` is read again. Texts
    without words, empty or null, are copies of each other. An empty table gives an empty result.
    """
    scratch = Scratch(df.sparkSession, "near-copies")
    texts = df.select(F.col(row_col).alias("row"), text_of(text_col).cast("binary").alias("t"))
    d = scratch.put(texts.mapInArrow(lambda bs: tidied(_fingerprints(bs, words, partial)), "row long, of long, n long, fp long, bands array<long>"))
    first = scratch.put(d.groupBy("of").agg(F.min("row").alias("row"), F.min("n").alias("n"), F.min("fp").alias("fp")))
    sets = first.where("n > 0")
    balls = connected_components(near_links(scratch.put(sets.select("fp").distinct()), radius, MADE_AT_ONCE), scratch)
    near = sets.join(balls, F.col("fp") == F.col("node"), "left").select(F.coalesce("root", "fp").alias("band"), "of", "n")
    bands = d.join(first.select("row"), "row", "left_semi").select(F.explode("bands").alias("band"), "of", "n").unionByName(near)
    shared = bands.groupBy("band").agg(F.min("of").alias("a"), F.max("of").alias("b")).where("a <> b").select("band")
    met = scratch.put(bands.join(shared, "band", "left_semi"))
    asked = first.join(met.select("of").distinct(), "of", "left_semi").select("row")
    hashes = scratch.put(texts.join(asked, "row", "left_semi").select("t").mapInArrow(lambda bs: tidied(_shingled(bs, words)), "of long, hashes array<long>, counts array<int>"))
    profiled = scratch.put(met.join(hashes.select("of", "counts"), "of"))
    scratch.drop(met)
    roots = _reachable(profiled, hashes, similarity, scratch)
    scratch.drop(profiled, hashes)
    if roots is None:
        labelled = first.select("of", "row", F.col("of").alias("root"))
    else:
        labelled = scratch.put(first.join(roots, F.col("of") == F.col("node"), "left").select("of", "row", F.coalesce("root", "of").alias("root")))
    component = labelled.groupBy("root").agg(F.min("row").alias("component"))
    named = labelled.join(component, "root").select("of", "component")
    return d.select("row", "of").join(named, "of").select(F.col("row").alias(row_col), "component")
