"""Predicates of the composite queries, every literal a parameter, and filter-project.

Each returns a Column, so Catalyst pushes it into the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.tables import CONTAINERS


def day(text: str) -> Column:
    """A date literal: it compares with timestamps without zone whatever the session's zone."""
    return F.lit(date.fromisoformat(text))


def half_open(column: str, start: str, end: str) -> Column:
    return (F.col(column) >= day(start)) & (F.col(column) < day(end))


def filter_project(df: DataFrame, predicate: Column, **columns: Column | str) -> DataFrame:
    """Rows where predicate holds, projected to the named columns."""
    return df.where(predicate).select(*((F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()))


def q3_customer(segment: str = "BUILDING") -> Column:
    return F.col("c_mktsegment") == segment


def q3_orders(before: str = "1995-03-15") -> Column:
    return F.col("o_orderdate") < day(before)


def q3_lineitem(since: str = "1995-03-16") -> Column:
    return F.col("l_shipdate") >= day(since)


def q10_orders(start: str = "1995-10-01", end: str = "1996-01-01") -> Column:
    return half_open("o_orderdate", start, end)


def q10_lineitem(flag: str = "R") -> Column:
    return F.col("l_returnflag") == flag


def q12_lineitem(modes: Sequence[str] = ("MAIL", "SHIP"), start: str = "1996-01-01", end: str = "1997-01-01") -> Column:
    return (
        F.col("l_shipmode").isin(*modes)
        & (F.col("l_commitdate") < F.col("l_receiptdate"))
        & (F.col("l_shipdate") < F.col("l_commitdate"))
        & half_open("l_receiptdate", start, end)
    )


#: A branch of query 19: brand, containers, least quantity (the most is 10 above), largest size.
Branch = tuple[str, Sequence[str], int, int]
BRANCHES: tuple[Branch, ...] = (
    ("Brand#12", CONTAINERS[0:4], 1, 5),
    ("Brand#23", CONTAINERS[4:8], 10, 10),
    ("Brand#24", CONTAINERS[8:12], 20, 15),
)
AIR = ("AIR", "AIR REG")
IN_PERSON = "DELIVER IN PERSON"


def q19_lineitem(branches: Sequence[Branch] = BRANCHES, modes: Sequence[str] = AIR, instruct: str = IN_PERSON) -> Column:
    """What every branch implies for lineitem alone."""
    least, most = min(b[2] for b in branches), max(b[2] for b in branches) + 10
    return F.col("l_quantity").between(least, most) & F.col("l_shipmode").isin(*modes) & (F.col("l_shipinstruct") == instruct)


def q19_part(branches: Sequence[Branch] = BRANCHES) -> Column:
    """What every branch implies for part alone."""
    return (
        F.col("p_brand").isin(*(b[0] for b in branches))
        & F.col("p_container").isin(*(c for b in branches for c in b[1]))
        & F.col("p_size").between(1, max(b[3] for b in branches))
    )


def q19_residual(branches: Sequence[Branch] = BRANCHES) -> Column:
    """The disjunction over both tables, checked on joined rows."""
    out = F.lit(False)
    for brand, containers, quantity, size in branches:
        out = out | (
            (F.col("p_brand") == brand)
            & F.col("p_container").isin(*containers)
            & F.col("l_quantity").between(quantity, quantity + 10)
            & F.col("p_size").between(1, size)
        )
    return out
