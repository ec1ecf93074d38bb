"""Hashed features of words and held-out rows, shared by the learned operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import LOWER, Words, byte_class

#: Bytes of words made of letters: a-z and all that isn't ASCII.
LETTERS = byte_class([*range(0x61, 0x7B), *range(0x80, 256)])
#: Rows of a feature table; row 0 is no feature and stays zero.
TABLE_BITS = 17


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def labelled_sample(rows: DataFrame, label: str, size: int, key: str = "doc_id") -> DataFrame:
    """At most size rows (key, label) with a label that aren't held out, as many of each label as there are, or as its share of size allows.

    Of a label those with the smallest hashes of key; the same for any partitioning. With more labels than size, one row each of some.
    """
    ok = rows.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key))).select(F.col(key).alias("key"), F.col(label).alias("label"))
    share = max(1, size // max(1, ok.select("label").distinct().count()))
    order = F.md5(F.concat(F.lit("sample|"), F.col("key").cast("string")))
    ranked = ok.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(order, "key"))).where(F.col("rank") <= share)
    return ranked.orderBy("rank", "label").limit(size).select(F.col("key").alias(key), F.col("label").alias(label))


def row(keys: np.ndarray, family: int) -> np.ndarray:
    """Table rows, from 1 on, of 64-bit keys."""
    spread = (keys.astype(np.uint64) + np.uint64(family)) * np.uint64(0x9E3779B97F4A7C15)
    return (spread >> np.uint64(64 - TABLE_BITS)).astype(np.int64) % ((1 << TABLE_BITS) - 1) + 1


def gram_rows(data: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """For each byte the table rows of the two and of the three bytes around it; bytes beyond a word's ends count as a space."""
    shown = np.full(len(data) + 2, 32, np.uint32)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[words.start] += 1
    inside[words.end] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    shown[1:-1] = np.where(inside, LOWER[data], 32)
    b0, b1, b2 = shown[:-2], shown[1:-1], shown[2:]
    scale, shift, most = np.uint32(2654435761), np.uint32(32 - TABLE_BITS), np.uint32((1 << TABLE_BITS) - 1)
    three = np.maximum(1, (((b0 << np.uint32(16)) | (b1 << np.uint32(8)) | b2) * scale) >> shift)
    two = np.maximum(1, (((b1 << np.uint32(8)) | b2 | np.uint32(1 << 24)) * scale) >> shift)
    return np.where(inside, np.minimum(two, most), 0).astype(np.int32), np.where(inside, np.minimum(three, most), 0).astype(np.int32)


def affix_keys(data: np.ndarray, words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the first and of the last size bytes of each word (the whole word, if shorter)."""
    first, last = np.zeros(len(words.start), np.uint64), np.zeros(len(words.start), np.uint64)
    length = words.end - words.start
    for k in range(size):
        there = length > k
        a = LOWER[data[np.where(there, words.start + k, 0)]].astype(np.uint64)
        z = LOWER[data[np.where(there, words.end - 1 - k, 0)]].astype(np.uint64)
        first = first * np.uint64(257) + np.where(there, a + np.uint64(1), np.uint64(0))
        last = last * np.uint64(257) + np.where(there, z + np.uint64(1), np.uint64(0))
    return first, last


def word_sums(table: np.ndarray, rows: np.ndarray, words: Words) -> np.ndarray:
    """For each word the sum of the table's rows over its bytes."""
    if not len(words.start):
        return np.zeros((0, table.shape[1]), table.dtype)
    return np.add.reduceat(table[rows], words.start, axis=0)
