"""Variable-length integers and the encoded size of records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VERSION = 1


def varint_length(n: Column) -> Column:
    """Bytes of a non-negative integer with seven bits to the byte."""
    out = F.lit(9)
    for size in range(8, 0, -1):
        out = F.when(n < F.lit(1 << (7 * size)), size).otherwise(out)
    return out


def record_size(key: Column, value: Column, tombstone: Column) -> Column:
    """Encoded bytes of one record: the key's length shares its varint with the tombstone bit."""
    k, v = F.octet_length(key).cast("long"), F.octet_length(value).cast("long")
    body = varint_length(v) + v
    return (varint_length(F.shiftleft(k, 1)) + k + F.when(tombstone, F.lit(0)).otherwise(body)).cast("long")


def raw_size(key: Column, value: Column) -> Column:
    return (F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0))).cast("long")


def encode(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def decode(data: bytes | memoryview, at: int) -> tuple[int, int] | None:
    """(value, next place), or None if the bytes end or the value has more than 64 bits."""
    value = 0
    for k in range(10):
        if at + k >= len(data):
            return None
        byte = data[at + k]
        value |= (byte & 0x7F) << (7 * k)
        if byte < 0x80:
            return (value, at + k + 1) if value < 1 << 64 else None
    return None
