import pytest
from oracle import compare

from quillon.operators import joins
from quillon.registry import load_all

REGISTRY = load_all()


def test_whole_relations_are_joined(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    for name in ("join_nested_loop_whole", "join_count_all_strategies_whole"):
        assert compare(REGISTRY.queries[name](spark, sf), REGISTRY.oracles[name], sf) > 0
    counts = {r.strategy: r.cnt for r in REGISTRY.queries["join_count_all_strategies_whole"](spark, sf).collect()}
    assert counts == dict.fromkeys(joins.JOIN_STRATEGIES, lines)


def test_blocks_give_the_bag_join(spark):
    r = [(-513, 1), (-512, 2), (0, 3), (0, 4), (511, 5), (512, 6), (2**62, 7), (None, 8)]
    s = [(k, 10 * i) for i, (k, _) in enumerate(r)] + [(0, 99), (1, 98)]
    frame = lambda rows: spark.createDataFrame(rows, "key long, payload long")
    out = joins.block_nested_loop(frame(r), frame(s))
    assert sorted(map(tuple, out.collect())) == sorted((a, p, q) for a, p in r for b, q in s if a is not None and a == b)
    assert joins.block_nested_loop(frame(r), frame(s), materialize=False).first().cnt == out.count()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "[block" in plan and "[key" not in plan.split("ShuffledHashJoin")[1].split("\n")[0].split("Inner")[0]


@pytest.mark.parametrize("name", ["join_checksum", "join_count_all_strategies", "join_count_all_strategies_whole"])
def test_queries_broadcast_nothing_above_the_bound_of_rows(spark, sf, monkeypatch, name):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 1000)  # sf0.001 has 1,500 orders
    out = REGISTRY.queries[name](spark, sf)
    assert "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert compare(out, REGISTRY.oracles[name], sf) > 0
