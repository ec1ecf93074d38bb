"""Pipe-delimited tables, the columnar store, key files and metric sinks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of the benchmark's text tables, in file order.
TBL = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate date, l_commitdate date, l_receiptdate date, l_shipinstruct string, l_shipmode string, l_comment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate date, o_orderpriority string, o_clerk string, o_shippriority int, o_comment string",
    "customer": "c_custkey bigint, c_name string, c_address string, c_nationkey int, c_phone string, c_acctbal double, c_mktsegment string, c_comment string",
    "part": "p_partkey bigint, p_name string, p_mfgr string, p_brand string, p_type string, p_size int, p_container string, p_retailprice double, p_comment string",
    "supplier": "s_suppkey bigint, s_name string, s_address string, s_nationkey int, s_phone string, s_acctbal double, s_comment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int, n_comment string",
    "region": "r_regionkey int, r_name string, r_comment string",
}


def read_tbl(spark: SparkSession, path: str, table: str, columns: Iterable[str] | None = None, keep_malformed: bool = False) -> DataFrame:
    """A text table: no header, no quotes, '|' between and after fields. Catalyst parses only the columns asked for.

    Malformed rows, as far as the columns read show it, go, or with keep_malformed stay with NULL where a field can't be read and the line in _corrupt_record.
    """
    schema = T._parse_datatype_string(TBL[table])
    read = T.StructType([*schema.fields, T.StructField("_end", T.StringType())])
    if keep_malformed:
        read = read.add("_corrupt_record", T.StringType())
    options = {"sep": "|", "header": "false", "quote": "", "mode": "PERMISSIVE" if keep_malformed else "DROPMALFORMED"}
    out = spark.read.options(**options).schema(read).csv(path)
    keep = list(columns or schema.fieldNames()) + ["_corrupt_record"] * keep_malformed
    return out.select(*keep)


def write_tbl(df: DataFrame, path: str) -> None:
    """One string a row with the separator after the last field too."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    df.select(F.concat(F.concat_ws("|", *fields), F.lit("|")).alias("value")).write.mode("overwrite").text(path)


def write_store(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_store(spark: SparkSession, path: str, columns: Iterable[str] | None = None) -> DataFrame:
    out = spark.read.parquet(path)
    return out.select(*columns) if columns else out


def convert(spark: SparkSession, source: str, target: str, tables: Iterable[str] = tuple(TBL)) -> None:
    """Text tables source/<table>.tbl to columnar tables target/<table>.parquet, a job each."""
    for table in tables:
        write_store(read_tbl(spark, f"{source}/{table}.tbl", table), f"{target}/{table}.parquet")


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    """A relation from a file with an integer a line; payload 0. Lines that aren't integers go."""
    return spark.read.text(path).select(F.trim("value").try_cast("bigint").alias("key"), F.lit(0).cast("bigint").alias("payload")).where("key IS NOT NULL")


def write_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def sample_rows(df: DataFrame, start: int, end: int, order: str = "key") -> DataFrame:
    """Rows number start to end - 1 by order, for a look."""
    return df.orderBy(order).offset(start).limit(end - start)


def write_join_text(joined: DataFrame, path: str) -> None:
    """A line for each match: key, build payload, probe payload."""
    joined.select("key", "r_payload", "s_payload").write.mode("overwrite").csv(path)
