"""Scalar functions as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_seconds(column: Column) -> Column:
    """Seconds since 1970 of a date string (yyyy-MM-dd), date or timestamp without zone, at midnight; NULL if it can't be read."""
    return (F.datediff(F.try_to_date(column.cast("string").substr(1, 10), "yyyy-MM-dd"), F.lit("1970-01-01").cast("date")).cast("bigint") * 86400).cast("bigint")


def enum_code(column: Column, values: Sequence[str]) -> Column:
    """1 for the first value, 2 for the second and so on, 0 for any other."""
    out = F.when(column == values[0], 1)
    for i, value in enumerate(values[1:], 2):
        out = out.when(column == value, i)
    return out.otherwise(0)


def to_number(column: Column, kind: str = "bigint", strict: bool = True) -> Column:
    """A number from a string; not strict: NULL if it isn't one."""
    return column.cast(kind) if strict else column.try_cast(kind)


def radix_bin(key: Column, bits: int, shift: int = 0) -> Column:
    """bits of the key above shift: mask first, then shift."""
    return F.shiftright(key.bitwiseAND(((1 << bits) - 1) << shift), shift).cast("bigint")


def msb_bin(key: Column, bits: int, key_bits: int) -> Column:
    """The high bits of a key of key_bits: shift first, then mask."""
    return F.shiftright(key, key_bits - bits).bitwiseAND((1 << bits) - 1).cast("bigint")


def next_power_of_two(column: Column) -> Column:
    return F.when(column <= 1, F.lit(1)).otherwise(F.pow(F.lit(2.0), F.ceil(F.log2(column)))).cast("bigint")


def bit_length_of(column: Column) -> Column:
    """floor(log2), for positive numbers."""
    return F.floor(F.log2(column)).cast("bigint")


def popcount(column: Column) -> Column:
    return F.bit_count(column).cast("bigint")


def test_bit(column: Column, bit: int) -> Column:
    return F.shiftright(column, bit).bitwiseAND(1).cast("bigint")


def set_bit(column: Column, bit: int) -> Column:
    return column.bitwiseOR(1 << bit).cast("bigint")


#: Fixed value: the low 32 bits of 2^64 over the golden ratio.
FIBONACCI = 2135587861


def hash_of(key: Column, kind: str = "identity") -> Column:
    """A hash of an integer key. identity: the key; fibonacci: 32 bits of a multiplicative hash of its low 32 bits; crc32: of its text; murmur: Spark's."""
    match kind:
        case "identity":
            return key.cast("bigint")
        case "fibonacci":
            return (key.cast("bigint").bitwiseAND(0xFFFFFFFF) * FIBONACCI).bitwiseAND(0xFFFFFFFF)
        case "crc32":
            return F.crc32(key.cast("string").cast("binary"))
        case "murmur":
            return F.hash(key).cast("bigint")
    raise ValueError(f"unknown hash {kind!r}; known: identity, fibonacci, crc32, murmur")
