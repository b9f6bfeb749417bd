import struct

from pyspark.sql import functions as F

from voxlog.functions.checksums import crc32c, get_varint, lz4_bound, lz4_compress, lz4_decompress, mask, put_varint, unmask
from voxlog.functions.keys import KEY, level_key, parse_level_key, parse_region_name, region_name, region_of


def le(*v):
    return struct.pack(f"<{len(v)}i", *v)


CHUNK_KEYS = [
    (le(1, -2) + b"\x2c", (0, 1, -2, 0x2C, 0)),
    (le(1, -2) + b"\x2f\xfc", (0, 1, -2, 0x2F, -4)),
    (le(1, 2, 1) + b"\x2b", (1, 1, 2, 0x2B, 0)),
    (le(1, 2, 2) + b"\x2f\x07", (2, 1, 2, 0x2F, 7)),
    (le(1, -2) + b"\x7f", (0, 1, -2, 0x7F, 0)),
    (b"digp" + le(1, 2), (0, 1, 2, 0x80, 0)),
    (b"digp" + le(1, 2, 1), (1, 1, 2, 0x80, 0)),
]
OTHER_KEYS = [
    b"~local_player",
    b"BiomeData",
    b"",
    le(1, 2) + b"\x2c\x09",
    le(1, 2) + b"\x2f",
    le(1, 2, 0) + b"\x2c",
    le(1, 2, -(2**31)) + b"\x2c",
    le(1, 2) + b"\x99",
    le(1, 2) + b"\x7f\x00",
    b"digp" + le(1, 2, 0),
    b"actorprefix" + bytes(range(8)),
]


def test_raw_keys_both_ways(spark):
    raw = spark.createDataFrame([(bytearray(k),) for k, _ in CHUNK_KEYS] + [(bytearray(k),) for k in OTHER_KEYS], "k binary")
    got = {bytes(r["k"]): r["p"] and tuple(r["p"]) for r in raw.select("k", parse_level_key("k").alias("p")).collect()}
    assert got == dict(CHUNK_KEYS) | {k: None for k in OTHER_KEYS}
    keys = spark.createDataFrame([v for _, v in CHUNK_KEYS], ", ".join(f"{c} int" for c in KEY))
    assert {tuple(r[c] for c in KEY): bytes(r["k"]) for r in keys.withColumn("k", level_key()).collect()} == {v: k for k, v in CHUNK_KEYS}


def test_regions_floor_and_names(spark):
    rows = spark.createDataFrame([(-1, -33, -2**31), (0, 31, 2**31 - 1), (32, -32, 0)], "a int, b int, c int")
    got = rows.select(region_of("a"), region_of("b"), region_of("c")).collect()
    assert [tuple(r) for r in got] == [(-1, -2, -67108864), (0, 0, 67108863), (1, -1, 0)]
    named = rows.select("a", "b", "c", region_name("a", "b", "c").alias("n")).select("a", "b", "c", "n", parse_region_name("n").alias("p")).collect()
    assert all(tuple(r["p"]) == (r["a"], r["b"], r["c"]) for r in named)
    assert named[0]["n"] == "ffffffff-ffffffdf-80000000.region"
    assert spark.range(1).select(parse_region_name(F.lit("ffffffff-0-0.region"))).first()[0] is None


def test_checksums():
    assert crc32c(b"123456789") == 0xE3069283
    data = bytes(i * 7 % 251 for i in range(70_001))
    assert crc32c(data[5000:], crc32c(data[:5000])) == crc32c(data)
    plain = 0
    for i in range(0, len(data), 500):
        plain = crc32c(data[i : i + 500], plain)
    assert plain == crc32c(data)
    assert unmask(mask(0x12345678)) == 0x12345678
    for n in (0, 127, 128, 300, 2**32, 2**63):
        assert get_varint(put_varint(n), 0) == (n, len(put_varint(n)))
    small = lz4_compress(b"a" * 1000)
    assert len(small) < lz4_bound(1000) and lz4_decompress(small, 1000) == b"a" * 1000
