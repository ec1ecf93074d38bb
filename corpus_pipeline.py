"""A corpus from documents: language, near copies, benchmark passages, source weights, shards.

Each stage takes what the one before it kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import decontaminate, jaccard, language, mixing, sharding
from quillon.llm.common import documents, pinned

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; NULL and empty texts and those without letters go, long ones are read whole."""
    return language.keep_known(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group joined by 5-word shingle similarity of 0.8 or more; texts without words all stay."""
    return jaccard.deduplicate(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage like a benchmark item; NULL and empty texts stay."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated to the sources' target weights, globally shuffled; NULL is a source, rows without doc_id go by their text."""
    return mixing.mix(docs).select(*docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each copy with its shard; a NULL doc_id counts as the empty string. Texts are only carried."""
    return sharding.place(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", known_language),
    ("near_copies", one_of_each_group),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("sharding", sharded),
]
#: Language models and Jaccard components aren't for SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each one's result written to the shared folder before the next reads it."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = pinned(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
