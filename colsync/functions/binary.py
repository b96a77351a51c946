"""Column expressions over bytes and integers: little-endian fields, bitmaps, length-encoded integers, bit costs.

All are built-in functions, so they stay inside generated code.  Offsets are
1-based, as in SQL's ``substring``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WRAP = 1 << 32


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _hex_number(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("decimal(20,0)")


def byte_at(data, at) -> Column:
    """The byte at a place as an integer; null beyond the end."""
    part = F.substring(_col(data), at if isinstance(at, Column) else F.lit(at), F.lit(1))
    return F.when(F.octet_length(part) > 0, F.conv(F.hex(part), 16, 10).cast("int"))


def little_endian(data, at, size: int) -> Column:
    """An unsigned little-endian integer of ``size`` bytes; a decimal for 8 bytes, else a long.

    The hex digits are taken in reverse byte order.  ``reverse`` on binary
    would go by code points and is no use here.
    """
    at = at if isinstance(at, Column) else F.lit(at)
    digits = F.hex(F.substring(_col(data), at, F.lit(size)))
    turned = F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in range(size - 1, -1, -1)])
    number = F.when(F.length(digits) == 2 * size, _hex_number(turned))
    return number if size > 7 else number.cast("long")


def big_endian(data, at, size: int) -> Column:
    """An unsigned big-endian integer of ``size`` bytes."""
    digits = F.hex(F.substring(_col(data), at if isinstance(at, Column) else F.lit(at), F.lit(size)))
    number = F.when(F.length(digits) == 2 * size, _hex_number(digits))
    return number if size > 7 else number.cast("long")


def to_little_endian(value, size: int) -> Column:
    """The low ``size`` bytes of an integer, least significant first."""
    digits = F.lpad(F.hex(_col(value).cast("long")), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(size)]))


def bitmap_bytes(n) -> Column:
    """Bytes of a bitmap of ``n`` bits."""
    return F.floor((_col(n) + 7) / 8)


def is_bit_set(bitmap, bit) -> Column:
    """Whether a bit of a bitmap is set, least significant bit of the first byte first."""
    bit = bit if isinstance(bit, Column) else F.lit(bit)
    byte = byte_at(bitmap, (F.floor(bit / 8) + 1).cast("int"))
    return F.call_function("bit_get", byte, (bit % 8).cast("int")) == 1


def pack_bits(flags: list[Column]) -> Column:
    """A bitmap of the flags."""
    parts = []
    for low in range(0, len(flags), 8):
        value = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(flags[low : low + 8])), F.lit(0))
        parts.append(to_little_endian(value, 1))
    return F.concat(*parts)


def length_encoded_size(value) -> Column:
    """Bytes of a length-encoded integer: 1, 3, 4 or 9; null takes 1."""
    v = _col(value)
    return F.when(v.isNull() | (v < 251), 1).when(v < 1 << 16, 3).when(v < 1 << 24, 4).otherwise(9)


def length_encoded_int(data, at) -> Column:
    """``value, size`` of the length-encoded integer at a place; value is null for the NULL mark (0xFB)."""
    at = at if isinstance(at, Column) else F.lit(at)
    first = byte_at(data, at)
    value = F.when(first < 0xFB, first.cast("decimal(20,0)")).when(first == 0xFC, little_endian(data, at + 1, 2)).when(first == 0xFD, little_endian(data, at + 1, 3)).when(first == 0xFE, little_endian(data, at + 1, 8))
    size = F.when(first <= 0xFB, 1).when(first == 0xFC, 3).when(first == 0xFD, 4).when(first == 0xFE, 9)
    return F.struct(value.cast("decimal(20,0)").alias("value"), size.alias("size"))


def length_encoded_string(data, at) -> Column:
    """The bytes of the length-encoded string at a place."""
    at = at if isinstance(at, Column) else F.lit(at)
    head = length_encoded_int(data, at)
    return F.substring(_col(data), (at + head["size"]).cast("int"), head["value"].cast("int"))


def to_length_encoded(value) -> Column:
    """An integer in length-encoded form."""
    v = _col(value)
    return (
        F.when(v.isNull(), F.unhex(F.lit("FB")))
        .when(v < 251, to_little_endian(v, 1))
        .when(v < 1 << 16, F.concat(F.unhex(F.lit("FC")), to_little_endian(v, 2)))
        .when(v < 1 << 24, F.concat(F.unhex(F.lit("FD")), to_little_endian(v, 3)))
        .otherwise(F.concat(F.unhex(F.lit("FE")), to_little_endian(v, 8)))
    )


def wrapped(difference: Column) -> Column:
    """A difference modulo 2**32."""
    return F.pmod(difference, F.lit(WRAP).cast("long"))


def varint_size(value) -> Column:
    """Bytes of a base-128 varint of a non-negative integer; zero takes one."""
    v = _col(value)
    out = F.when(v < 1 << 7, 1)
    for n in range(2, 9):
        out = out.when(v < F.lit(1 << (7 * n)).cast("long"), n)
    return out.otherwise(9)


#: Bounds of a delta of deltas, and the bits that one within them takes; any other takes 36.
DOD_COSTS = ((0, 0, 1), (-63, 64, 9), (-255, 256, 12), (-2047, 2048, 16))
DOD_OTHER = 36


def dod_bits(dod) -> Column:
    """Bits of one delta of deltas."""
    d = _col(dod)
    low, high, bits = DOD_COSTS[0]
    out = F.when((d >= low) & (d <= high), bits)
    for low, high, bits in DOD_COSTS[1:]:
        out = out.when((d >= low) & (d <= high), bits)
    return out.otherwise(DOD_OTHER)
