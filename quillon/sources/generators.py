"""Relations (key, payload) generated on the executors from ranges of row numbers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in a MB of 8-byte rows, and presets of (build rows, probe rows).
ROWS_PER_MB = 131_072
PRESETS = {"cache-fit": (10 * ROWS_PER_MB, 40 * ROWS_PER_MB), "cache-exceed": (100 * ROWS_PER_MB, 400 * ROWS_PER_MB), "L": (50_000_000, 200_000_000)}


def pk(spark: SparkSession, n: int, shuffle_seed: int | None = None) -> DataFrame:
    """Keys 1 to n, once each; payload = key."""
    out = spark.range(1, n + 1).select(F.col("id").alias("key"), F.col("id").alias("payload"))
    return out if shuffle_seed is None else out.orderBy(F.rand(shuffle_seed))


def pk_selectivity(spark: SparkSession, n: int, percent: int) -> DataFrame:
    """n different keys spread so that percent of the numbers from 1 to the largest are keys: key i is 1 + i * 100 / percent, cut."""
    key = (F.lit(1) + F.floor(F.col("id") * 100 / percent)).cast("bigint")
    return spark.range(n).select(key.alias("key"), F.col("id").alias("payload"))


def fk(spark: SparkSession, n: int, max_id: int) -> DataFrame:
    """n rows: every key from 1 to max_id as often as n allows, the remainder from 1 on."""
    return spark.range(n).select((F.col("id") % max_id + 1).alias("key"), F.col("id").alias("payload"))


def fk_selectivity(spark: SparkSession, n: int, build_rows: int, percent: int) -> DataFrame:
    """Keys of which about percent find one of 1 to build_rows; with 0 all keys are 0."""
    if percent <= 0:
        return spark.range(n).select(F.lit(0).cast("bigint").alias("key"), F.col("id").alias("payload"))
    return fk(spark, n, 100 * build_rows // percent)


def fk_from_pk(pk_relation: DataFrame, copies: int) -> DataFrame:
    """Every key of a relation, copies times."""
    return pk_relation.select("key", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(copies - 1).cast("bigint"))).alias("payload"))


def uniform(spark: SparkSession, n: int, max_id: int, seed: int = 0) -> DataFrame:
    return spark.range(n).select((F.floor(F.rand(seed) * max_id) + 1).cast("bigint").alias("key"), F.col("id").alias("payload"))


def zipf(spark: SparkSession, n: int, max_id: int, s: float, seed: int = 0) -> DataFrame:
    """n keys 1 to max_id with weight 1 / key^s, drawn by random numbers."""
    return zipf_of(spark.range(n).select(F.rand(seed).alias("u"), F.col("id").alias("payload")), max_id, s)


def zipf_of(drawn: DataFrame, max_id: int, s: float) -> DataFrame:
    """Keys of numbers (u from 0 to below 1, payload), by inversion of the distribution, which each task has once (8 bytes a key)."""

    @F.pandas_udf("bigint")
    def inverted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights = np.cumsum(1.0 / np.arange(1, max_id + 1) ** s)
        for u in batches:
            yield pd.Series(np.minimum(np.searchsorted(weights, u.to_numpy() * weights[-1], side="right"), max_id - 1) + 1)

    return drawn.select(inverted("u").alias("key"), "payload")


def ramp(spark: SparkSession, n: int, codes: int = 256) -> DataFrame:
    """(pos, code) with code = pos mod codes."""
    return spark.range(n).select(F.col("id").alias("pos"), (F.col("id") % codes).alias("code"))


def keyed_rows(spark: SparkSession, n: int, num_keys: int) -> DataFrame:
    return spark.range(n).select((F.col("id") % num_keys).alias("key"), F.col("id").alias("value"))


def slots(spark: SparkSession, n: int, bins: int, kind: str = "random", seed: int = 0) -> DataFrame:
    """Slot numbers below bins: random, linear (row number mod bins), or pointer (linear, as the offset of a slot of four bytes)."""
    if kind not in ("random", "linear", "pointer"):
        raise ValueError(f"unknown kind {kind!r}; known: random, linear, pointer")
    linear = F.col("id") % bins
    slot = {"random": F.floor(F.rand(seed) * bins).cast("bigint"), "linear": linear, "pointer": linear * 4}[kind]
    return spark.range(n).select(slot.alias("slot"))


@dataclass(frozen=True)
class RelationSpec:
    """What a join benchmark joins; where several apply, skew goes before selectivity, and that before the plain foreign key."""

    build_rows: int = 2_097_152
    probe_rows: int = 2_097_152
    skew: float = 0.0
    selectivity: int = 100
    seed: int = 22222


def make_relations(spark: SparkSession, spec: RelationSpec) -> tuple[DataFrame, DataFrame]:
    if spec.skew:
        s = zipf(spark, spec.probe_rows, spec.build_rows, spec.skew, spec.seed)
    elif spec.selectivity != 100:
        s = fk_selectivity(spark, spec.probe_rows, spec.build_rows, spec.selectivity)
    else:
        s = fk(spark, spec.probe_rows, spec.build_rows)
    return pk(spark, spec.build_rows), s
