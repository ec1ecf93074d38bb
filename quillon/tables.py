"""Parquet tables by scale-factor folder, and the columns that the fixtures lack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The twelve containers of query 19, three sizes of four, in the order of the specification.
CONTAINERS = (
    "SM CASE", "SM BOX", "SM PACK", "SM PKG",
    "MED BAG", "MED BOX", "MED PKG", "MED PACK",
    "LG CASE", "LG BOX", "LG PACK", "LG PKG",
)
#: Ship modes and instructions by remainder; the last is for every other remainder.
SHIP_MODES = ("REG AIR", "AIR", "RAIL", "SHIP", "TRUCK", "MAIL", "AIR REG")
SHIP_INSTRUCTIONS = ("DELIVER IN PERSON", "COLLECT COD", "NONE", "TAKE BACK RETURN")


#: Schemas of the relational tables: with them a read needs no job of its own to look at the files.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def _case(key: Column, values: tuple[str, ...]) -> Column:
    out = F.when(key == 0, values[0])
    for i, value in enumerate(values[1:-1], 1):
        out = out.when(key == i, value)
    return out.otherwise(values[-1])


def _case_sql(key: str, values: tuple[str, ...]) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values[:-1])) + f" ELSE '{values[-1]}' END"


def _plus_days(date: str, days: Column) -> Column:
    return F.col(date) + F.make_dt_interval(days.cast("int"))


def with_shipping(lineitem: DataFrame) -> DataFrame:
    """Adds ship mode, ship instruction, commit and receipt date, each a function of columns of the row."""
    return lineitem.withColumns(
        {
            "l_shipmode": _case((F.col("l_suppkey") + F.col("l_linenumber")) % 7, SHIP_MODES),
            "l_shipinstruct": _case(F.col("l_orderkey") % 4, SHIP_INSTRUCTIONS),
            "l_commitdate": _plus_days("l_shipdate", F.col("l_partkey") % 61 - 20),
            "l_receiptdate": _plus_days("l_shipdate", F.col("l_suppkey") % 30 + 1),
        }
    )


def with_container(part: DataFrame) -> DataFrame:
    return part.withColumn("p_container", _case(F.floor(F.col("p_partkey") / 3).cast("bigint") % 12, CONTAINERS))


#: The same two views for the SQL oracles.
LINEITEM_SQL = f"""(SELECT *, {_case_sql('(l_suppkey+l_linenumber)%7', SHIP_MODES)} AS l_shipmode,
  {_case_sql('l_orderkey%4', SHIP_INSTRUCTIONS)} AS l_shipinstruct,
  l_shipdate + to_days(CAST(l_partkey%61-20 AS INTEGER)) AS l_commitdate,
  l_shipdate + to_days(CAST(l_suppkey%30+1 AS INTEGER)) AS l_receiptdate FROM lineitem)"""
PART_SQL = f"(SELECT *, {_case_sql('CAST(FLOOR(p_partkey/3) AS BIGINT)%12', CONTAINERS)} AS p_container FROM part)"
