"""The operators' queries over the tables of a scale-factor folder, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import chat, decontaminate, jaccard, language, licenses, mixing, neighbours, sharding, tokens, toxicity
from quillon.llm.common import documents
from quillon.registry import Registry

REGISTRY = Registry()
query = REGISTRY.add


@query("op1_mixing", mixing.SQL)
def op1_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(documents(spark, d))


@query("op3_licenses")
def op3_licenses(spark: SparkSession, d: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, d)).drop("spans")


@query("op8_chat", chat.SQL)
def op8_chat(spark: SparkSession, d: str) -> DataFrame:
    turns = chat.with_control(spark.read.parquet(f"{d}/conversations.parquet"))
    return chat.read_back(chat.format_chat(chat.records(turns), given="typed"))


@query("op9_sharding", sharding.SQL)
def op9_sharding(spark: SparkSession, d: str) -> DataFrame:
    return sharding.place(documents(spark, d))


@query("op10_tokens")
def op10_tokens(spark: SparkSession, d: str) -> DataFrame:
    return tokens.count_tokens(documents(spark, d))


@query("op2_language")
def op2_language(spark: SparkSession, d: str) -> DataFrame:
    return language.identify(documents(spark, d))


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    return toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{d}/labels.parquet")))


@query("op7_decontamination")
def op7_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.find_matches(documents(spark, d), spark.read.parquet(f"{d}/benchmark.parquet"))


@query("op5_neighbours")
def op5_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.search(spark.read.parquet(f"{d}/embeddings.parquet"))


@query("op4_jaccard", jaccard.SQL)
def op4_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return jaccard.join(documents(spark, d)).drop("class")
