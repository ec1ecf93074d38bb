"""Range scans over a column or a dictionary-encoded column.

A row matches where low <= value <= high, both ends included; an empty range gives an empty result, or zero.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.joins import broadcast_if_small, estimated_bytes
from quillon.session import pinned

#: A dictionary above this estimate is narrowed to the codes that the column has before it is joined.
SMALL_DICTIONARY = 1 << 20
OUTPUTS = ("count", "sum", "values", "positions", "index", "bitvector")


def matches(column: str | Column, low: int, high: int) -> Column:
    return (F.col(column) if isinstance(column, str) else column).between(low, high)


def range_scan(df: DataFrame, column: str, low: int, high: int, output: str = "count", pos: str = "pos", index: str | None = None) -> DataFrame:
    """One of OUTPUTS.

    positions and bitvector need pos, a dense row number from 0 held in the table (see with_positions); index returns another column of
    the matching rows. A bitvector has a row for each 64 positions, also those without a match, as two halves of 32 bits.
    """
    if output == "bitvector":
        k = (F.col(pos) % 64).cast("int")
        bit = lambda half, shift: F.when(matches(column, low, high) & half, F.call_function("shiftleft", F.lit(1).cast("bigint"), shift)).otherwise(F.lit(0).cast("bigint"))
        return df.groupBy(F.floor(F.col(pos) / 64).cast("bigint").alias("word")).agg(
            F.bit_or(bit(k < 32, k)).alias("lo"),
            F.bit_or(bit(k >= 32, k - 32)).alias("hi"),
        )
    found = df.where(matches(column, low, high))
    match output:
        case "count":
            return found.agg(F.count("*").alias("cnt"))
        case "sum":
            return found.agg(F.coalesce(F.sum(column), F.lit(0)).cast("bigint").alias("total"))
        case "values":
            return found.select(F.col(column).cast("bigint").alias("value"))
        case "positions":
            return found.select(F.col(pos).cast("bigint").alias("pos"))
        case "index":
            return found.select(F.col(index or pos).cast("bigint").alias("idx"))
    raise ValueError(f"unknown output {output!r}; known: {', '.join(OUTPUTS)}")


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it while the frame has such a column (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def code_range(dictionary: DataFrame, low: int, high: int) -> tuple[int, int] | None:
    """The least and the largest code with a value in the range; all codes between, if the dictionary is sorted. None without such a code."""
    least, most = dictionary.where(matches("value", low, high)).agg(F.min("code"), F.max("code")).first()
    return None if least is None else (least, most)


def dictionary_scan(df: DataFrame, code: str, dictionary: DataFrame, low: int, high: int) -> DataFrame:
    """Decoded values in the range: the predicate goes to the dictionary (code, value) and becomes a range of codes, which reaches the scan.

    The hits then decode, and in a dictionary that isn't sorted also choose, the rows in that range. The range takes a small job over the
    dictionary; before a large one is joined, a second one over the code column narrows it to codes that are there.
    """
    found = code_range(dictionary, low, high)
    rows = df.select(F.col(code).alias("code"))
    rows = rows.where(F.col("code").between(*found)) if found else rows.where(F.lit(False))
    hits = dictionary.where(matches("value", low, high)).select(F.col("code").alias("hit"), F.col("value").cast("bigint").alias("value"))
    if found and estimated_bytes(dictionary) > SMALL_DICTIONARY:
        least, most = rows.agg(F.min("code"), F.max("code")).first()
        hits = hits.where(F.col("hit").between(least, most) if least is not None else F.lit(False))
    return rows.join(broadcast_if_small(hits), F.col("code") == F.col("hit")).select("value")


def identity_dictionary(spark, size: int, scale: int = 1, shift: int = 0) -> DataFrame:
    """A sorted dictionary of the codes 0 to size - 1 with value = scale * code + shift."""
    return spark.range(size).select(F.col("id").alias("code"), (F.col("id") * scale + shift).alias("value"))


def with_positions(df: DataFrame, order: list[str], name: str = "pos") -> DataFrame:
    """Adds a dense position from 0 in the given order, without a window over all rows in one task.

    Range partitions are sorted and written once, with each row's number in its partition; a running sum over the partitions' counts gives
    each its first position. Rows alike in order come in any order.
    """
    id_, part, n, start = (free_name(df, x) for x in ("__id", "__part", "__n", "__start"))
    ranged = df.repartitionByRange(*(F.col(c) for c in order)).sortWithinPartitions(*order)
    rows = pinned(ranged.withColumn(id_, F.monotonically_increasing_id()).withColumn(part, F.shiftrightunsigned(id_, 33)))
    counts = rows.groupBy(part).agg(F.count("*").alias(n))
    before = F.coalesce(F.sum(n).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = rows.join(F.broadcast(counts.select(part, before.alias(start))), part)  # one row a partition
    return out.withColumn(name, F.col(start) + F.col(id_).bitwiseAND((1 << 33) - 1)).drop(part, start, id_)


def selectivity_to_high(percent: float, top: int = 255) -> int:
    """The upper bound that keeps about percent of the codes 0 to top, from 0."""
    return int(percent / 100 * top + 0.5)


def selectivity_sweep(df: DataFrame, column: str, percents: Iterable[int], top: int = 255) -> DataFrame:
    """Counts for each selectivity in one pass over the column."""
    percents = list(percents)
    counted = df.agg(*(F.count(F.when(matches(column, 0, selectivity_to_high(p, top)), 1)).alias(f"p{p}") for p in percents))
    stack = ", ".join(f"{p}, {selectivity_to_high(p, top)}, p{p}" for p in percents)
    return counted.selectExpr(f"stack({len(percents)}, {stack}) AS (selectivity, high, cnt)")


@dataclass(frozen=True)
class ScanConfig:
    mode: str
    threads: int
    entries: int
    selectivity: int


def spans(start: int, end: int, step: int, doubling: bool = False) -> Iterator[int]:
    """start to end, by adding step or by multiplying with 2^step."""
    while start <= end:
        yield start
        start = start << step if doubling else start + step


def configurations(modes: Iterable[str], threads: Iterable[int], entries: Iterable[int], selectivities: Iterable[int]) -> list[ScanConfig]:
    """All combinations of a sweep's settings."""
    return [ScanConfig(*c) for c in product(modes, threads, entries, selectivities)]
