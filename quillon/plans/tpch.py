"""The four join queries: each a DataFrame of joined rows, and a count.

Predicates are on the scans; Catalyst prunes columns and picks sides. The residual of query 19 also lies in its join, and Catalyst derives
the one-sided conditions from it; the explicit ones stay, as they stand as operators of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import filters


def count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("cnt"))


def q3(customer: DataFrame, orders: DataFrame, lineitem: DataFrame, **at: str) -> DataFrame:
    segment, before, since = at.get("segment", "BUILDING"), at.get("before", "1995-03-15"), at.get("since", "1995-03-16")
    c = customer.where(filters.q3_customer(segment)).select("c_custkey")
    o = orders.where(filters.q3_orders(before)).select("o_custkey", "o_orderkey")
    li = lineitem.where(filters.q3_lineitem(since)).select("l_orderkey")
    return c.join(o, c.c_custkey == o.o_custkey).join(li, o.o_orderkey == li.l_orderkey)


def q10(customer: DataFrame, orders: DataFrame, lineitem: DataFrame, nation: DataFrame, start: str = "1995-10-01", end: str = "1996-01-01", flag: str = "R") -> DataFrame:
    o = orders.where(filters.q10_orders(start, end)).select("o_custkey", "o_orderkey")
    li = lineitem.where(filters.q10_lineitem(flag)).select("l_orderkey")
    c, n = customer.select("c_custkey", "c_nationkey"), nation.select("n_nationkey")
    return c.join(o, c.c_custkey == o.o_custkey).join(n, c.c_nationkey == n.n_nationkey).join(li, o.o_orderkey == li.l_orderkey)


def q12(orders: DataFrame, lineitem: DataFrame, modes: tuple[str, ...] = ("MAIL", "SHIP"), start: str = "1996-01-01", end: str = "1997-01-01") -> DataFrame:
    li = lineitem.where(filters.q12_lineitem(modes, start, end)).select("l_orderkey")
    o = orders.select("o_orderkey")
    return o.join(li, o.o_orderkey == li.l_orderkey)


def q19(part: DataFrame, lineitem: DataFrame, branches: tuple[filters.Branch, ...] = filters.BRANCHES) -> DataFrame:
    p = part.where(filters.q19_part(branches)).select("p_partkey", "p_brand", "p_container", "p_size")
    li = lineitem.where(filters.q19_lineitem(branches)).select("l_partkey", "l_quantity")
    return p.join(li, (p.p_partkey == li.l_partkey) & filters.q19_residual(branches))


def q3_revenue(customer: DataFrame, orders: DataFrame, lineitem: DataFrame, n: int = 10, **at: str) -> DataFrame:
    """An extension: query 3 with revenue by order, the n largest."""
    segment, before, since = at.get("segment", "BUILDING"), at.get("before", "1995-03-15"), at.get("since", "1995-03-16")
    c = customer.where(filters.q3_customer(segment)).select("c_custkey")
    o = orders.where(filters.q3_orders(before)).select("o_custkey", "o_orderkey", "o_orderdate")
    li = lineitem.where(filters.q3_lineitem(since)).select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    joined = c.join(o, c.c_custkey == o.o_custkey).join(li, o.o_orderkey == li.l_orderkey)
    revenue = F.round(F.sum("v"), 2).alias("revenue")
    return joined.groupBy("o_orderkey", "o_orderdate").agg(revenue).orderBy(F.desc("revenue"), "o_orderkey").limit(n)
