"""Integer helpers: alignment, powers of two, bytes and bits, narrowing, length guards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def aligned(x: Column, to: int) -> Column:
    """The least multiple of `to` that is not less than x."""
    return (F.floor((x + (to - 1)) / to) * to).cast("long")


def pow2_ceil(x: Column) -> Column:
    """The least power of two that is not less than x >= 1: by the length of x - 1 in bits."""
    bits = F.when(x <= 1, 0).otherwise(F.length(F.bin(x - 1)))
    return F.call_function("shiftleft", F.lit(1).cast("long"), bits.cast("int"))


def least_bytes(x: Column) -> Column:
    """Bytes that hold an unsigned value; one for 0."""
    return F.ceil(F.length(F.bin(x)) / 8).cast("long")


def reversed_bits(x: Column, n: int = 8) -> Column:
    """The lowest 8 bits in reverse, the first n of those that result."""
    return F.conv(F.left(F.reverse(F.lpad(F.bin(x.bitwiseAND(255)), 8, "0")), F.lit(n)), 2, 10).cast("long")


def narrowed(x: Column, bits: int) -> Column:
    """x as an unsigned number of so many bits; an error if it does not fit."""
    return F.when((x >= 0) & (x < 1 << bits), x).otherwise(F.raise_error(F.concat(F.lit("does not fit: "), x.cast("string"))).cast("long"))


def try_narrowed(x: Column, bits: int) -> Column:
    """As narrowed(), with null for what does not fit."""
    return F.when((x >= 0) & (x < 1 << bits), x)


def guarded(array: Column, most: int = 100_000_000) -> Column:
    """The array, or an error if it is longer than a reader takes."""
    return F.when(F.size(array) <= most, array).otherwise(F.raise_error(F.lit(f"longer than {most}")).cast("array<float>"))
