"""The scan and histogram operators over streams: the same Column expressions on a streaming DataFrame.

The operators are stateless or keyed counts, so a stream needs no code of its own beyond its sink; count and histogram use complete mode,
values and positions append.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def to_memory(df: DataFrame, name: str, mode: str, checkpoint: str | None = None) -> StreamingQuery:
    """Runs a stream over what is there now into an in-memory table, for tests and small reports."""
    writer = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.start()
