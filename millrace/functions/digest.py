"""Partition numbers that are the same everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_bytes(key: Column) -> Column:
    """Bytes of a key: bytes as they are, strings as UTF-8, numbers as decimal text."""
    return key.cast("string").cast("binary")


def md5_mod(key: Column, n: int) -> Column:
    """MD5 of the key's bytes, read as a little-endian integer, modulo ``n``.

    Folded four digest bytes at a time, from the most significant: the remainder stays below 2**31, so
    ``remainder * 2**32 + four bytes`` fits a bigint.
    """
    if not 0 < n < 2**31:
        raise ValueError("the number of partitions must be in 1 .. 2**31 - 1")
    hexed = F.md5(key_bytes(key))
    rest = F.lit(0).cast("bigint")
    for word in (3, 2, 1, 0):
        digits = F.concat(*[F.substring(hexed, 8 * word + 2 * i + 1, 2) for i in (3, 2, 1, 0)])
        rest = F.pmod(rest * F.lit(1 << 32) + F.conv(digits, 16, 10).cast("bigint"), F.lit(n).cast("bigint"))
    return rest


def mod(key: Column, n: int) -> Column:
    """Remainder with the sign of the divisor."""
    return F.pmod(key.cast("bigint"), F.lit(n).cast("bigint"))
