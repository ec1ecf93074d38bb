"""Connected components of an edge table, by hooking labels' nodes and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import Scratch, pinned


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of the nodes of edges (a, b): label is the smallest node that can be reached.

    In each round a node takes the smallest label around it, and so does the node whose label it had, so that whole groups move at once; then
    each takes its label's label. Nothing left to take means that the ends of every edge agree. Minima are combined before each shuffle, and
    joins of hot nodes or labels can be split. Each step is written to the shared folder, and those before it go.
    """
    with Scratch(edges.sparkSession) as scratch:
        apart = edges.where("a <> b")
        both = scratch.put(apart.select("a", "b").unionByName(apart.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
        first = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        labels = scratch.put(first.select("node", F.least("node", "m").alias("label")))
        while True:
            near = both.join(labels, both["a"] == labels["node"]).groupBy(F.col("b").alias("at")).agg(F.min("label").alias("m"))
            taken = labels.join(near, labels["node"] == near["at"]).select("node", F.col("label").alias("old"), F.least("label", "m").alias("low"))
            moves = F.array(F.struct("node", "old", "low"), F.struct(F.col("old").alias("node"), F.lit(None).cast("bigint").alias("old"), "low"))
            moved = taken.select(F.inline(moves)).groupBy("node").agg(F.max("old").alias("old"), F.min("low").alias("label"))
            hooked = scratch.put(moved)
            if hooked.where("old <> label").isEmpty():
                return pinned(hooked.select("node", "label"))
            target = hooked.select(F.col("node").alias("t"), F.col("label").alias("jump"))
            labels = scratch.put(hooked.join(target, F.col("label") == F.col("t")).select("node", F.col("jump").alias("label")))
            scratch.drop(scratch.tables - 2, scratch.tables - 1)
