"""Session settings used by tests, the bench and local runs.

A query never changes the session it is given: on a cluster the deployer's settings hold.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int = 8, memory: str = "8g", name: str = "quillon", **conf: str) -> SparkSession:
    """A local session with as many shuffle partitions as cores."""
    settings = DEFAULTS | {"spark.sql.shuffle.partitions": str(cpus), "spark.driver.memory": memory} | conf
    spark = SparkSession.builder.master(f"local[{cpus}]").appName(name).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one where it is unset and driver and executors are one process."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillon-"))
    return context._jsc.sc().getCheckpointDir().get()


def pinned(df: DataFrame) -> DataFrame:
    """The frame written to the shared folder, and read back: its lineage ends there. Spark removes it when it is no longer used."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
