import pytest
from oracle import compare

from quillon.registry import load_all

REGISTRY = load_all()
COUNTS = {"tpch_q3": 44, "tpch_q10": 81, "tpch_q12": 22, "tpch_q19": 0}


@pytest.mark.parametrize("name", sorted(REGISTRY.oracles))
def test_query_equals_its_oracle(spark, sf, name):
    assert compare(REGISTRY.queries[name](spark, sf), REGISTRY.oracles[name], sf) > 0


@pytest.mark.parametrize("name", sorted(COUNTS))
def test_known_counts(spark, sf, name):
    assert REGISTRY.queries[name](spark, sf).first().cnt == COUNTS[name]


def test_every_query_without_oracle_is_known():
    assert set(REGISTRY.queries) - set(REGISTRY.oracles) == {"gen_zipf"}


def test_zipf_prefers_small_keys(spark, sf):
    counts = {r.key: r["count"] for r in REGISTRY.queries["gen_zipf"](spark, sf).groupBy("key").count().collect()}
    assert sum(counts.values()) == 10_000 and min(counts) == 1 and max(counts) <= 1000
    assert counts[1] > counts.get(2, 0) > counts.get(10, 0)


def test_filters_and_columns_reach_the_scans(spark, sf):
    plan = REGISTRY.queries["tpch_q3"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_mktsegment,BUILDING)" in plan and "LessThan(o_orderdate" in plan and "GreaterThanOrEqual(l_shipdate" in plan
    assert "ReadSchema: struct<c_custkey:bigint,c_mktsegment:string>" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_shipdate:timestamp_ntz>" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_shipdate:timestamp_ntz>" in REGISTRY.queries["scan_prune"](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_counts_combine_before_the_exchange(spark, sf):
    plan = REGISTRY.queries["radix_histogram"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count(1)" in plan and plan.count("Exchange") == 1
