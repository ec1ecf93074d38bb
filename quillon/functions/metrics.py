"""Summaries of benchmark measurements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summary(measurements: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Mean, least, largest and number of the measurements of each setting."""
    return measurements.groupBy(*keys).agg(F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), F.count("*").alias("n"))


def phase_maxima(timers: DataFrame, keys: Sequence[str], thread: str = "thread") -> DataFrame:
    """The largest value over threads of each phase's timer, for each setting; a phase takes as long as its slowest thread."""
    phases = [c for c in timers.columns if c not in (*keys, thread)]
    return timers.groupBy(*keys).agg(*(F.max(c).alias(c) for c in phases))


def overhead(measurements: DataFrame, keys: Sequence[str], variant: str, base: str, value: str = "value") -> DataFrame:
    """Each variant's mean over that of the base variant with the same keys."""
    means = measurements.groupBy(*keys, variant).agg(F.avg(value).alias("mean"))
    reference = means.where(F.col(variant) == base).select(*keys, F.col("mean").alias("base_mean"))
    return means.join(reference, list(keys)).withColumn("ratio", F.col("mean") / F.col("base_mean"))
