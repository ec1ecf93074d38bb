"""Radix histograms, offsets and partitions over a key, sorting, and keyed micro-operators."""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.scalar import msb_bin, radix_bin


#: Radix bits of a join at most.
MOST_BITS = 14


def histogram(df: DataFrame, bin_column: Column) -> DataFrame:
    """(bin, cnt) of the bins that have rows."""
    return df.groupBy(bin_column.cast("bigint").alias("bin")).agg(F.count("*").alias("cnt"))


def prefix_sum(counts: DataFrame, padding: int = 0) -> DataFrame:
    """(bin, cnt, start): each bin's first position. The window has all bins in one task, as many as the radix bits allow, not rows."""
    before = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    rank = F.row_number().over(Window.orderBy("bin")) - 1
    start = F.coalesce(F.sum("cnt").over(before), F.lit(0)) + rank * padding
    return counts.select("bin", "cnt", start.cast("bigint").alias("start"))


def radix_partition(df: DataFrame, bin_column: Column, bins: int) -> DataFrame:
    """Rows with their bin, each bin in the Spark partition of its number."""
    return df.withColumn("bin", bin_column.cast("bigint")).repartitionById(bins, F.col("bin").cast("int"))


def two_pass_bins(df: DataFrame, key: str, bits_1: int, bits_2: int) -> DataFrame:
    """Rows with their bins of a first pass over the low bits and of a second over the next, each pair of bins in a Spark partition of its own.

    The second pass splits each partition of the first, so one shuffle to the pairs moves rows to where two would.
    """
    binned = df.withColumns({"bin1": radix_bin(F.col(key), bits_1), "bin2": radix_bin(F.col(key), bits_2, bits_1)})
    return binned.repartitionById(1 << (bits_1 + bits_2), (F.col("bin1") * (1 << bits_2) + F.col("bin2")).cast("int"))


def in_both(r: DataFrame, s: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """Both relations with their bin, without the rows of bins that are empty on the other side; at most 2^bits bins are broadcast."""
    bins = join_task_sizes(r, s, bits).select("bin")
    binned = lambda df: df.withColumn("bin", radix_bin(F.col("key"), bits)).join(F.broadcast(bins), "bin", "left_semi")
    return binned(r), binned(s)


def radix_join(r: DataFrame, s: DataFrame, tuples_in_cache: int = 1 << 18, threads: int | None = None, rows: int | None = None) -> DataFrame:
    """(key, r_payload, s_payload): both relations dealt by as many radix bits as r's rows take, empty pairs dropped, then joined bin by bin.

    rows: of r, counted if not given. The bits are bounded by MOST_BITS, beyond which partitions are a shuffle's and not a cache's.
    """
    threads = threads or r.sparkSession.sparkContext.defaultParallelism
    bits = min(MOST_BITS, num_radix_bits(r.count() if rows is None else rows, tuples_in_cache, threads))
    left, right = (df.repartition(1 << bits, "bin") for df in in_both(r, s, bits))
    joined = left.hint("shuffle_hash").alias("r").join(right.alias("s"), (F.col("r.bin") == F.col("s.bin")) & (F.col("r.key") == F.col("s.key")))
    return joined.select(F.col("r.key").alias("key"), F.col("r.payload").alias("r_payload"), F.col("s.payload").alias("s_payload"))


def join_task_sizes(r: DataFrame, s: DataFrame, bits: int) -> DataFrame:
    """(bin, r_rows, s_rows) of the bins in which both relations have rows: the others join nothing."""
    one = lambda df, name: histogram(df, radix_bin(F.col("key"), bits)).withColumnRenamed("cnt", name)
    return one(r, "r_rows").join(one(s, "s_rows"), "bin")


def num_radix_bits(rows: int, tuples_in_cache: int, threads: int) -> int:
    """Bits so that a build partition fits in a quarter of the cache and each thread has one."""
    return max(0, ceil(log2(max(ceil(rows / max(1, tuples_in_cache // 4)), threads, 1))))


def num_passes(bits: int, one_pass_bits: int = 13) -> int:
    return 1 if bits <= one_pass_bits else 2


def sort_by_key(df: DataFrame, *more: str, within_partitions: bool = False) -> DataFrame:
    return df.sortWithinPartitions("key", *more) if within_partitions else df.sort("key", *more)


def _folded(parts: DataFrame, *by: str) -> DataFrame:
    """(by, p, n, breaks, first, last) of stretches of positions, folded into one for each value of by; p is the first position."""
    before = F.lag("last").over((Window.partitionBy(*by) if by else Window).orderBy("p"))
    edge = F.when(F.col("first") < before, 1).otherwise(0)
    return parts.withColumn("breaks", F.col("breaks") + edge).groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.sum("breaks").alias("breaks"),
        F.min_by("first", "p").alias("first"),
        F.max_by("last", "p").alias("last"),
        F.min("p").alias("p"),
    )


def disorder(df: DataFrame, key: str, pos: str, block: int = 1 << 16, blocks: int = 1 << 12) -> DataFrame:
    """(cnt, breaks): rows, and neighbours by pos with a falling key.

    Blocks of positions are windows of their own, and so are groups of blocks; each stretch's last key meets the next one's first. So no
    task has all rows, and the window over all groups has one row for each block * blocks positions.
    """
    place = lambda n: F.floor(F.col("p") / n).cast("bigint")
    rows = df.select(F.col(pos).alias("p"), F.lit(1).alias("n"), F.lit(0).alias("breaks"), F.col(key).alias("first"), F.col(key).alias("last"))
    each = _folded(rows.withColumn("block", place(block)), "block")
    groups = _folded(each.withColumn("group", place(block * blocks)), "group")
    return _folded(groups).select(F.coalesce("n", F.lit(0)).cast("bigint").alias("cnt"), F.coalesce("breaks", F.lit(0)).cast("bigint").alias("breaks"))


def scatter(df: DataFrame, slot: Column) -> DataFrame:
    """The slots that a scatter write fills."""
    return df.select(slot.cast("bigint").alias("slot")).distinct()


def keyed_increment(df: DataFrame, slot: Column) -> DataFrame:
    return df.groupBy(slot.cast("bigint").alias("slot")).agg(F.count("*").alias("cnt"))


def lookup_sum(probe: DataFrame, slot: Column, table: DataFrame) -> DataFrame:
    """Sum of table (slot, value) over the probes' slots, counted by slot before the join."""
    counted = keyed_increment(probe, slot)
    return counted.join(table, "slot").agg(F.coalesce(F.sum(F.col("cnt") * F.col("value")), F.lit(0)).cast("bigint").alias("total"))


__all__ = ["histogram", "prefix_sum", "radix_partition", "two_pass_bins", "in_both", "radix_join", "join_task_sizes", "num_radix_bits", "num_passes", "sort_by_key", "disorder", "scatter", "keyed_increment", "lookup_sum", "radix_bin", "msb_bin"]
