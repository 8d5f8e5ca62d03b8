"""Counter-based draws as column expressions: a draw is a function of a seed and a row's index and of nothing else.

All arithmetic is on 64 bits with wrap-around, held in BIGINT by bit pattern. Spark fixes what overflow does when an
expression is analysed, so expressions are to be put on their frame inside wrapping().
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# The published constants of the SplitMix64 generator and of the 64-bit FNV-1a hash.
GAMMA = 0x9E3779B97F4A7C15
MIX_1, MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
SHIFT_1, SHIFT_2, SHIFT_3 = 30, 27, 31
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3

LOW = 0xFFFFFFFF


@contextmanager
def wrapping(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def bits(value: int) -> Column:
    """An unsigned 64-bit number as BIGINT."""
    value &= (1 << 64) - 1
    return F.lit(value - (1 << 64) if value >> 63 else value).cast("bigint")


def mix64(z: Column) -> Column:
    z = z.bitwiseXOR(F.shiftrightunsigned(z, SHIFT_1)) * bits(MIX_1)
    z = z.bitwiseXOR(F.shiftrightunsigned(z, SHIFT_2)) * bits(MIX_2)
    return z.bitwiseXOR(F.shiftrightunsigned(z, SHIFT_3))


def draw_bits(seed: int, index: Column) -> Column:
    return mix64(bits(seed) + index.cast("bigint") * bits(GAMMA))


def draw(seed: int, index: Column) -> Column:
    """In [0, 1)."""
    return F.shiftrightunsigned(draw_bits(seed, index), 11).cast("double") * F.lit(2.0**-53)


def high_product(x: Column, bound: Column) -> Column:
    """The high 64 bits of the 128-bit product of two unsigned numbers, by 32-bit halves."""
    xl, xh = x.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(x, 32)
    bl, bh = bound.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(bound, 32)
    low = xl * bl
    mid = xh * bl + F.shiftrightunsigned(low, 32)
    other = xl * bh + mid.bitwiseAND(F.lit(LOW))
    return xh * bh + F.shiftrightunsigned(mid, 32) + F.shiftrightunsigned(other, 32)


def unsigned_less(a: Column, b: Column) -> Column:
    flip = F.lit(-(1 << 63)).cast("bigint")
    return a.bitwiseXOR(flip) < b.bitwiseXOR(flip)


def fnv1a(text: Column) -> Column:
    """The hash of a text's bytes, folded over their hexadecimal digits."""
    digits = F.hex(F.encode(text, "utf-8"))
    octets = F.transform(F.sequence(F.lit(1), F.octet_length(text)), lambda i: F.conv(F.substring(digits, 2 * i - 1, F.lit(2)), 16, 10).cast("bigint"))
    octets = F.when(F.octet_length(text) > 0, octets).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(octets, bits(FNV_BASIS), lambda h, o: h.bitwiseXOR(o) * bits(FNV_PRIME))
