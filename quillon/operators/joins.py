"""Inner equi-joins on one key with a named physical strategy.

Relations have columns (key, payload). A join counts its matches or returns (key, r_payload, s_payload). R is the build side. All names
give the same bag join; a name picks a hint, and adaptive execution may still split skewed partitions. NULL keys match nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The names that callers know, each with Spark's join strategy. "unique" keeps one build row per key, that of the smallest payload.
JOIN_STRATEGIES = {
    "PHT": "broadcast",
    "PHT_no": "broadcast",
    "PHT_un": "broadcast",
    "PHT_o": "broadcast",
    "NPO_st": "broadcast",
    "NPO_no": "broadcast",
    "NPBC_st": "broadcast",
    "RHO": "shuffle_hash",
    "RHT": "shuffle_hash",
    "RSM": "merge",
    "PSM": "merge",
    "MWAY": "merge",
    "NL": "shuffle_replicate_nl",
    "INL": "lookup",
    "CHT": "unique",
    "CRKJ": "shuffle_hash",
    "CrkJoin": "shuffle_hash",
    "CRKJS": "shuffle_hash",
    "CRKJF": "shuffle_hash",
}
#: A side is broadcast only within both bounds, else the hint becomes shuffle_hash: Catalyst's estimate, and rows, as the estimate is that
#: of compressed files (2.5 bytes a row, where the driver's hash table has 36).
BROADCAST_BYTES, BROADCAST_ROWS = 16 << 20, 1 << 20
#: A block of block_nested_loop has keys that differ in this many low bits only.
NL_BITS = 9


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES, otherwise: str | None = "shuffle_hash", of: DataFrame | None = None) -> DataFrame:
    """A broadcast hint only where the estimate is within the limit, and then the rows, by a job that counts them, are within BROADCAST_ROWS.

    of: counted instead of df, where it has as many rows at least and is cheaper to count.
    """
    if estimated_bytes(df) <= limit and (df if of is None else of).count() <= BROADCAST_ROWS:
        return F.broadcast(df)
    return df.hint(otherwise) if otherwise else df


def relation(df: DataFrame, key: str, payload: str) -> DataFrame:
    return df.select(F.col(key).cast("bigint").alias("key"), F.col(payload).cast("bigint").alias("payload"))


def hinted(r: DataFrame, s: DataFrame, strategy: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with the strategy's hint; strategy is a name in JOIN_STRATEGIES or one of its values."""
    strategy = JOIN_STRATEGIES.get(strategy, strategy)
    match strategy:
        case "broadcast":
            return broadcast_if_small(r), s
        case "lookup":  # the index is on the probe side: a hash table, or above the bounds its sorted rows
            return r, broadcast_if_small(s, otherwise="merge")
        case "unique":
            return broadcast_if_small(r.groupBy("key").agg(F.min("payload").alias("payload")), of=r), s
        case "shuffle_hash" | "merge" | "shuffle_replicate_nl":
            return r.hint(strategy), s
    raise ValueError(f"unknown join strategy {strategy!r}; known: {', '.join(JOIN_STRATEGIES)}")


def equi_join(r: DataFrame, s: DataFrame, strategy: str = "RHO", materialize: bool = True) -> DataFrame:
    """Triples (key, r_payload, s_payload), or with materialize=False one row with their number as cnt."""
    build, probe = hinted(r, s, strategy)
    out = build.alias("r").join(probe.alias("s"), F.col("r.key") == F.col("s.key"))
    if not materialize:
        return out.agg(F.count("*").alias("cnt"))
    return out.select(F.col("r.key").alias("key"), F.col("r.payload").alias("r_payload"), F.col("s.payload").alias("s_payload"))


def block_nested_loop(r: DataFrame, s: DataFrame, materialize: bool = True, bits: int = NL_BITS) -> DataFrame:
    """What equi_join gives, by nested loops over whole relations: each pair within a block of 2^bits consecutive keys is compared.

    Only blocks are hashed. Catalyst takes no key from a difference, so equality is tested pair by pair.
    """
    blocks = lambda df: df.withColumn("block", F.shiftright("key", bits))
    same = (F.col("r.block") == F.col("s.block")) & (F.col("r.key") - F.col("s.key") == 0)
    out = blocks(r).hint("shuffle_hash").alias("r").join(blocks(s).alias("s"), same)
    if not materialize:
        return out.agg(F.count("*").alias("cnt"))
    return out.select(F.col("r.key").alias("key"), F.col("r.payload").alias("r_payload"), F.col("s.payload").alias("s_payload"))


def write_index(s: DataFrame, table: str, buckets: int = 16) -> DataFrame:
    """The probe side as a table bucketed and sorted by key: joins with it leave it in place, however large it is."""
    s.write.mode("overwrite").bucketBy(buckets, "key").sortBy("key").saveAsTable(table)
    return s.sparkSession.table(table)


def index_join(r: DataFrame, index: DataFrame, materialize: bool = True) -> DataFrame:
    """What equi_join gives, with r moved to the buckets of an index that write_index made."""
    return equi_join(r, index, "merge", materialize)


def rekey(joined: DataFrame, key: str, payload: str) -> DataFrame:
    """A relation from a join's result, for the next join."""
    return joined.select(F.col(key).alias("key"), F.col(payload).alias("payload"))


def checksum(joined: DataFrame) -> DataFrame:
    return joined.agg(F.count("*").alias("cnt"), F.sum(F.col("r_payload") + F.col("s_payload")).cast("bigint").alias("checksum"))


def union_fragments(*fragments: DataFrame) -> DataFrame:
    """Concatenates fragments of a result by column name; duplicates stay."""
    out = fragments[0]
    for fragment in fragments[1:]:
        out = out.unionByName(fragment)
    return out


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two results hold the same rows as often, in any order."""
    return a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
