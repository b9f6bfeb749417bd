"""K-d tree sharding, in DataFrame operations only.

Rows are points in a space of numeric metadata. A node is split at the weighted median (for an uneven number of
leaves, the weighted quantile) along its widest dimension, until every leaf holds the target bytes. The cut is
exact: it is found by descending the bits of the sort key ``(dimension, id, row)``, a bounded histogram for each
pass, summed on the map side. Below DRIVER_NODES nodes a level, which bound what the driver and a broadcast hold, nodes are
small enough to be cut by windows over their own rows; both ways cut alike. Only the narrow metadata table is read again;
texts are read once and never shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Scratch, literal_rows, table, text_of

#: Rows of a histogram sent to the driver in one pass, over all nodes of a level.
HISTOGRAM_ROWS = 1 << 16
#: Nodes of a level that are cut by histograms at most.
DRIVER_NODES = 1024
#: Rows of a slot-numbering range.
BLOCK_ROWS = 1_000_000
_SIGN = -(2**63)


def _code(col):
    """The first six bytes of a string as an order-keeping number; null and empty are 0."""
    return F.coalesce(F.conv(F.hex(F.rpad(F.substring(F.coalesce(col.cast("string"), F.lit("")).cast("binary"), 1, 6), 6, F.unhex(F.lit("00")))), 16, 10).cast("long"), F.lit(0))


def kd_shard(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    numeric: tuple[str, ...] = ("n_chars",),
    categories: tuple[str, ...] = ("lang", "source"),
    shards: int | None = None,
    target_bytes: int | None = None,
) -> DataFrame:
    """One row per row of ``df``: id, size, text_crc32, shard, slot.

    ``size`` is the UTF-8 bytes of the text, none for null, plus 1. Shard sizes are near equal: a cut is off by
    half of the row that straddles it at most. Give the number of shards, or the bytes of one. Slots number a
    shard's rows from 0 without gaps, by id. Null metadata count as 0 or empty, ties are cut by id and then by row,
    so a value, a source or a group of copies that holds most rows is divided too. Missing metadata columns are
    skipped and other columns ignored; an empty table gives an empty result.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "kd-shard")
    numeric, categories = [c for c in numeric if c in df.columns], [c for c in categories if c in df.columns]
    text = text_of(text_col)
    size = F.octet_length(text).cast("long")
    dims = [F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in numeric] + [_code(F.col(c)) for c in categories] or [size]
    t = scratch.put(
        df.select(
            F.col(id_col).alias("id"),
            (size + 1).alias("w"),
            F.crc32(text.cast("binary")).alias("crc"),
            *[d.alias(f"d{i}") for i, d in enumerate(dims)],
            F.monotonically_increasing_id().alias("rid"),
            F.lit(0).alias("node"),
        )
    ).withColumn("ord", F.coalesce(F.col("id").cast("long"), F.lit(_SIGN)))
    total = t.agg(F.sum("w")).first()[0] or 0
    leaves = shards or max(1, math.ceil(total / (target_bytes or 1 << 30)))
    levels = math.ceil(math.log2(leaves)) if leaves > 1 else 0
    nodes = {0: (0, leaves)}  # node: its first leaf, its leaves
    rows, spread = t, {}
    above = min(levels, int(math.log2(DRIVER_NODES)) + 1)
    for level in range(above if total else 0):
        found = _spread(rows, len(dims))
        spread = spread or found[0]
        splits = {}
        for node, (first, k) in nodes.items():
            if k > 1 and node in found:
                width = [(hi - lo) / max(1, spread["hi"][i] - spread["lo"][i]) for i, (lo, hi) in enumerate(zip(found[node]["lo"], found[node]["hi"], strict=True))]
                splits[node] = {"dim": width.index(max(width)), "w": found[node]["w"] * (k // 2) / k}
        cuts = _cuts(spark, rows, splits, found, len(dims))
        at = F.broadcast(literal_rows(spark, [(n, splits[n]["dim"], *cuts[n]) for n in splits], "node int, dim int, c0 long, c1 long, c2 long"))
        rows = rows.join(at, "node", "left").withColumn("x", _pick("dim", len(dims)))
        low = (F.col("x") < F.col("c0")) | ((F.col("x") == F.col("c0")) & ((F.col("ord") < F.col("c1")) | ((F.col("ord") == F.col("c1")) & (F.col("rid") < F.col("c2")))))
        rows = rows.withColumn("node", F.when(F.col("dim").isNull() | low, F.col("node") * 2).otherwise(F.col("node") * 2 + 1).cast("int")).drop("dim", "c0", "c1", "c2", "x")
        below = {}
        for node, (first, k) in nodes.items():
            below |= {2 * node: (first, k // 2), 2 * node + 1: (first + k // 2, k - k // 2)} if node in splits else {2 * node: (first, k)}
        nodes = below
        rows = scratch.put(rows)
    if not total:
        return t.select(F.col("id").alias(id_col), F.col("w").alias("size"), F.col("crc").alias("text_crc32"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    leaf = F.broadcast(literal_rows(spark, [(n, first, k) for n, (first, k) in nodes.items()], "node int, shard int, leaves int"))
    rows = rows.join(leaf, "node")
    for _ in range(above, levels):
        rows = scratch.put(_halved(rows, spread, len(dims)))
    rows = scratch.put(rows.select("id", "ord", "rid", "w", "crc", "shard"))
    ranges = rows.repartitionByRange(max(1, math.ceil(rows.count() / BLOCK_ROWS)), "shard", "ord", "rid")
    rows = scratch.put(ranges.withColumn("block", F.spark_partition_id()))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "block").agg(F.count("*").alias("n")).select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    numbered = rows.withColumn("at", F.row_number().over(Window.partitionBy("shard", "block").orderBy("ord", "rid")) - 1)
    return numbered.join(starts, ["shard", "block"]).select(
        F.col("id").alias(id_col), F.col("w").alias("size"), F.col("crc").alias("text_crc32"), "shard", (F.col("start") + F.col("at")).cast("long").alias("slot")
    )


def _halved(rows: DataFrame, spread: dict, n: int) -> DataFrame:
    """One more level for rows (node, shard: the node's first leaf, leaves): every node's own rows are cut by a window."""
    own = Window.partitionBy("node")
    width = [(F.max(f"d{i}").over(own) - F.min(f"d{i}").over(own)) / max(1, spread["hi"][i] - spread["lo"][i]) for i in range(n)]
    rows = rows.withColumns({f"width{i}": c for i, c in enumerate(width)} | {"all": F.sum("w").over(own)})
    dim = F.lit(n - 1)
    for i in reversed(range(n - 1)):
        dim = F.when(F.col(f"width{i}") >= (F.greatest(*[f"width{j}" for j in range(i + 1, n)]) if n - i > 2 else F.col(f"width{n - 1}")), F.lit(i)).otherwise(dim)
    rows = rows.withColumn("dim", dim).withColumn("x", _pick("dim", n))
    upto = F.sum("w").over(own.orderBy("x", "ord", "rid").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    half = F.floor(F.col("leaves") / 2).cast("int")
    rows = rows.withColumn("low", (F.col("leaves") == 1) | (2 * upto - F.col("w") < 2 * (F.col("all") * half / F.col("leaves"))))
    rows = rows.withColumns(
        {
            "node": F.col("node") * 2 + F.when(F.col("low"), 0).otherwise(1),
            "shard": F.col("shard") + F.when(F.col("low"), 0).otherwise(half),
            "leaves": F.when(F.col("leaves") == 1, 1).when(F.col("low"), half).otherwise(F.col("leaves") - half),
        }
    )
    return rows.drop("all", "dim", "x", "low", *[f"width{i}" for i in range(n)])


def _pick(dim: str, n: int):
    x = F.col(f"d{n - 1}")
    for i in reversed(range(n - 1)):
        x = F.when(F.col(dim) == i, F.col(f"d{i}")).otherwise(x)
    return x


def _spread(rows: DataFrame, n: int) -> dict[int, dict]:
    """The weight and the range of each dimension, of the id and of the row number, of each node; a row per node."""
    keys = [*(f"d{i}" for i in range(n)), "ord", "rid"]
    out = rows.groupBy("node").agg(F.sum("w").alias("w"), *[f(k).alias(f"{f.__name__}_{k}") for k in keys for f in (F.min, F.max)]).collect()
    return {
        r["node"]: {"w": r["w"], "lo": [r[f"min_d{i}"] for i in range(n)], "hi": [r[f"max_d{i}"] for i in range(n)], "ord": (r["min_ord"], r["max_ord"]), "rid": (r["min_rid"], r["max_rid"])}
        for r in out
    }


def _cuts(spark: SparkSession, rows: DataFrame, splits: dict, found: dict, n: int) -> dict[int, tuple[int, int, int]]:
    """For each node the key (x, ord, rid) at which its upper part starts: the boundary nearest to the wanted weight.

    Each of the three parts of the key is resolved from its highest differing bit downwards. A pass sums the weights
    of the next bits' buckets among the rows that share what is resolved so far.
    """
    flip = lambda v: (v ^ _SIGN) & (2**64 - 1)  # noqa: E731  order-keeping, as unsigned
    signed = lambda u: ((u ^ (1 << 63)) + 2**63) % 2**64 - 2**63

    def enter(s: dict, part: int) -> None:
        lo, hi = ((found[s["node"]]["lo"][s["dim"]], found[s["node"]]["hi"][s["dim"]]), found[s["node"]]["ord"], found[s["node"]]["rid"])[part]
        bits = (flip(lo) ^ flip(hi)).bit_length()
        s |= {"part": part, "prefix": flip(lo) >> bits, "left": bits}

    states = []
    for node, s in splits.items():
        states.append(s := s | {"node": node, "below": 0, "fixed": [0, 0, 0]})
        enter(s, 0)
    bits = max(1, min(12, int(math.log2(HISTOGRAM_ROWS / max(1, len(states))))))
    while live := [s for s in states if s["part"] < 3]:
        for s in live:
            s["take"] = min(bits, s["left"])
        to_signed = lambda u: u - 2**64 if u >= 2**63 else u
        at = literal_rows(spark, 
            [(s["node"], s["dim"], s["part"], *s["fixed"][:2], to_signed(s["prefix"]) if s["left"] < 64 else 0, s["left"], s["left"] - s["take"], (1 << s["take"]) - 1) for s in live],
            "node int, dim int, part int, f0 long, f1 long, prefix long, above int, shift int, mask long",
        )
        x = F.when(F.col("part") == 0, _pick("dim", n)).when(F.col("part") == 1, F.col("ord")).otherwise(F.col("rid"))
        shifted = lambda c: F.when(F.col(c) >= 64, F.lit(0)).otherwise(F.call_function("shiftrightunsigned", F.col("u"), F.col(c)))
        hist = (
            rows.join(F.broadcast(at), "node")
            .withColumn("x", _pick("dim", n))
            .where((F.col("part") == 0) | ((F.col("x") == F.col("f0")) & ((F.col("part") == 1) | (F.col("ord") == F.col("f1")))))
            .withColumn("u", x.bitwiseXOR(F.lit(_SIGN)))
            .where((F.col("above") >= 64) | (shifted("above") == F.col("prefix")))
            .groupBy("node", shifted("shift").bitwiseAND(F.col("mask")).alias("bucket"))
            .agg(F.sum("w").alias("w"))
            .collect()
        )
        by: dict[int, dict[int, int]] = {}
        for r in hist:
            by.setdefault(r["node"], {})[r["bucket"]] = r["w"]
        for s in live:
            for bucket, w in sorted(by[s["node"]].items()):
                if s["below"] + w > s["w"] or bucket == max(by[s["node"]]):
                    break
                s["below"] += w
            s |= {"prefix": (s["prefix"] << s["take"]) | bucket, "left": s["left"] - s["take"]}
            if not s["left"]:
                s["fixed"][s["part"]] = signed(s["prefix"])
                if s["part"] < 2:
                    enter(s, s["part"] + 1)
                else:  # this row straddles the wanted weight: below the cut if that is nearer
                    s["part"] = 3
                    s["fixed"][2] += s["below"] + w - s["w"] < s["w"] - s["below"]
    return {s["node"]: tuple(s["fixed"]) for s in states}


def op1_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shard(table(spark, sf_dir, "documents"), shards=8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
