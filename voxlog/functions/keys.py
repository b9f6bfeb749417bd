"""Keys of records as column expressions: packing, validation, ordering, names, and the raw byte layout.

Coordinates are floor-divided by 32 with an arithmetic shift; a truncating division would send chunk -33 to region -1.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY = ("dimension", "chunk_x", "chunk_z", "component", "subchunk_y")
REGION = ("dimension", "region_x", "region_z")
CHUNK = ("dimension", "chunk_x", "chunk_z")
#: Keys with their region, which partitions the storage: group and filter by these, so that pruning reaches it.
FULL_KEY = (*REGION, "chunk_x", "chunk_z", "component", "subchunk_y")

# Fixed values of the data model.
AUX_DIMENSION = -2147483648
REGION_MIN, REGION_MAX = -67108864, 67108863
SUBCHUNK, METADATA, DIGEST = 0x2F, 0x7F, 0x80
COMPONENTS = {
    "data3d": 0x2B,
    "version": 0x2C,
    "data2d": 0x2D,
    "data2d_legacy": 0x2E,
    "subchunk": 0x2F,
    "legacy_terrain": 0x30,
    "block_entities": 0x31,
    "entities": 0x32,
    "pending_ticks": 0x33,
    "legacy_block_extra_data": 0x34,
    "biome_state": 0x35,
    "finalized_state": 0x36,
    "conversion_data": 0x37,
    "border_blocks": 0x38,
    "hardcoded_spawners": 0x39,
    "random_ticks": 0x3A,
    "checksums": 0x3B,
    "generation_seed": 0x3C,
    "pre_caves_blending": 0x3D,
    "blending_biome_height": 0x3E,
    "metadata_hash": 0x3F,
    "blending_data": 0x40,
    "actor_digest_version": 0x41,
    "legacy_version": 0x76,
    "metadata": 0x7F,
    "actor_digest": 0x80,
}
#: Component numbers of the first format, as tags.
FIRST_FORMAT_COMPONENTS = {0: 0x2F, 1: 0x2B, 2: 0x31, 3: 0x32, 4: 0x2D, 5: 0x2C}


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def region_of(chunk: Column | str) -> Column:
    return F.shiftright(_c(chunk), 5)


def slot(chunk_x: Column | str = "chunk_x", chunk_z: Column | str = "chunk_z") -> Column:
    return _c(chunk_z).bitwiseAND(31) * 32 + _c(chunk_x).bitwiseAND(31)


def local_key(component: Column | str = "component", subchunk_y: Column | str = "subchunk_y") -> Column:
    """Sorts as component, then signed y."""
    return _c(component) * 256 + (_c(subchunk_y) + 128)


def unpack(region_x: Column | str, region_z: Column | str, slot: Column | str, local: Column | str) -> dict[str, Column]:
    s, k = _c(slot), _c(local)
    return {
        "chunk_x": _c(region_x) * 32 + s.bitwiseAND(31),
        "chunk_z": _c(region_z) * 32 + F.shiftright(s, 5),
        "component": F.shiftright(k, 8),
        "subchunk_y": k.bitwiseAND(255) - 128,
    }


def key_valid() -> Column:
    """A component is a byte, and only subchunks have a y, a signed byte."""
    y = F.when(F.col("component") == SUBCHUNK, F.col("subchunk_y").between(-128, 127)).otherwise(F.col("subchunk_y") == 0)
    return F.col("component").between(0, 255) & y


def region_valid(x: Column | str = "region_x", z: Column | str = "region_z") -> Column:
    return _c(x).between(REGION_MIN, REGION_MAX) & _c(z).between(REGION_MIN, REGION_MAX)


def _hex32(c: Column) -> Column:
    return F.lower(F.right(F.concat(F.lit("0000000"), F.hex(c.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), F.lit(8)))


def region_name(dimension: Column | str = "dimension", x: Column | str = "region_x", z: Column | str = "region_z") -> Column:
    return F.concat(_hex32(_c(dimension)), F.lit("-"), _hex32(_c(x)), F.lit("-"), _hex32(_c(z)), F.lit(".region"))


def parse_region_name(name: Column | str) -> Column:
    """struct<dimension, x, z>, null where the name isn't exactly one that region_name makes."""
    n = _c(name)

    def part(at: int) -> Column:
        v = F.conv(F.substring(n, at, 8), 16, 10).cast("long")
        return F.when(v >= 2**31, v - 2**32).otherwise(v).cast("int")

    parsed = F.struct(part(1).alias("dimension"), part(10).alias("x"), part(19).alias("z"))
    return F.when(n.rlike(r"^[0-9a-f]{8}-[0-9a-f]{8}-[0-9a-f]{8}\.region$"), parsed)


def matches(components: list[int] | None = None, min_x: int | None = None, max_x: int | None = None, min_z: int | None = None, max_z: int | None = None) -> Column:
    """The component set and the inclusive chunk bounds, with the region bounds that let partitions be pruned."""
    keep = F.lit(True)
    if components is not None:
        keep = keep & F.col("component").isin(sorted(set(components)))
    for axis, low, high in (("x", min_x, max_x), ("z", min_z, max_z)):
        if low is not None:
            keep = keep & (F.col(f"chunk_{axis}") >= low) & (F.col(f"region_{axis}") >= low >> 5)
        if high is not None:
            keep = keep & (F.col(f"chunk_{axis}") <= high) & (F.col(f"region_{axis}") <= high >> 5)
    return keep


def _le(c: Column) -> Column:
    """Four little-endian bytes of an int."""
    h = F.right(F.concat(F.lit("0000000"), F.hex(c.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), F.lit(8))
    return F.unhex(F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)]))


def _int_at(raw: Column, at: int) -> Column:
    """The little-endian int at a byte offset from 0."""
    h = F.hex(F.substring(raw, at + 1, 4))
    v = F.conv(F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)]), 16, 10).cast("long")
    return F.when(v >= 2**31, v - 2**32).otherwise(v).cast("int")


def _byte_at(raw: Column, at: int) -> Column:
    return F.conv(F.hex(F.substring(raw, at + 1, 1)), 16, 10).cast("int")


def level_key() -> Column:
    """The raw key of a record in a LevelDB world; dimension 0 is left out."""
    dim = F.when(F.col("dimension") == 0, F.unhex(F.lit(""))).otherwise(_le(F.col("dimension")))
    byte = lambda c: F.unhex(F.right(F.concat(F.lit("0"), F.hex(c.cast("long").bitwiseAND(F.lit(255)))), F.lit(2)))
    tag = F.when(F.col("component") == DIGEST, F.unhex(F.lit(""))).when(F.col("component") == SUBCHUNK, F.concat(byte(F.col("component")), byte(F.col("subchunk_y")))).otherwise(byte(F.col("component")))
    head = F.when(F.col("component") == DIGEST, F.lit("digp").cast("binary")).otherwise(F.unhex(F.lit("")))
    return F.concat(head, _le(F.col("chunk_x")), _le(F.col("chunk_z")), dim, tag)


def parse_level_key(raw: Column | str) -> Column:
    """struct<dimension, chunk_x, chunk_z, component, subchunk_y>, null for keys that aren't chunk records.

    A dimension of 0 that is written out, the reserved dimension, a y on anything but a subchunk and a subchunk without
    one are not chunk records.
    """
    k = _c(raw)
    n = F.octet_length(k)

    def made(dim: Column, x_at: int, component: Column, y: Column) -> Column:
        return F.struct(dim.alias("dimension"), _int_at(k, x_at).alias("chunk_x"), _int_at(k, x_at + 4).alias("chunk_z"), component.alias("component"), y.alias("subchunk_y"))

    is_digest = n.isin(12, 16) & (F.substring(k, 1, 4) == F.lit("digp").cast("binary"))
    far = n.isin(13, 14)
    tag = F.when(far, _byte_at(k, 12)).otherwise(_byte_at(k, 8))
    has_y = n.isin(10, 14)
    tagged = (tag.between(0x2B, 0x41) | tag.isin(0x76, METADATA)) & (has_y == (tag == SUBCHUNK))
    y = F.when(far, _byte_at(k, 13)).otherwise(_byte_at(k, 9))
    y = F.when(has_y, F.when(y >= 128, y - 256).otherwise(y)).otherwise(0)
    dim = F.when(n == 16, _int_at(k, 12)).when(far, _int_at(k, 8)).otherwise(0)
    dim_ok = (dim != AUX_DIMENSION) & ~((far | (is_digest & (n == 16))) & (dim == 0))
    digest = F.when(dim_ok, made(dim, 4, F.lit(DIGEST), F.lit(0)))
    chunk = F.when(n.isin(9, 10, 13, 14) & tagged & dim_ok, made(dim, 0, tag, y))
    return F.when(is_digest, digest).otherwise(chunk)


def migrated_component(old: Column | str) -> Column:
    """The tag of a component number of the first format; others raise."""
    of = F.create_map(*[F.lit(x) for kv in FIRST_FORMAT_COMPONENTS.items() for x in kv])
    return F.coalesce(F.element_at(of, _c(old).cast("int")), F.raise_error(F.concat(F.lit("unknown component "), _c(old).cast("string"))).cast("int"))
