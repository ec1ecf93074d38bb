import pytest
from pyspark.sql import functions as F

from quillon.operators import joins
from quillon.sources import generators

NAMES = sorted(joins.JOIN_STRATEGIES)


def rel(spark, rows):
    return spark.createDataFrame(rows, "key long, payload long")


def brute(r, s):
    return sorted((a, p, q) for a, p in r for b, q in s if a is not None and a == b)


@pytest.mark.parametrize("name", NAMES)
def test_all_names_give_the_bag_join(spark, name):
    r = [(k, 10 * k) for k in range(8)] + ([] if name == "CHT" else [(3, 1), (3, 2), (0, 5)])
    s = [(k % 11, i) for i, k in enumerate(range(40))] + [(3, 99), (None, 1)]
    got = joins.equi_join(rel(spark, r), rel(spark, s), name)
    assert sorted(map(tuple, got.collect())) == brute(r, s)
    assert joins.equi_join(rel(spark, r), rel(spark, s), name, materialize=False).first().cnt == len(brute(r, s))


@pytest.mark.parametrize("name", ["PHT", "RHO", "RSM", "NL", "CHT"])
def test_empty_sides(spark, name):
    one = rel(spark, [(1, 1)])
    none = rel(spark, [])
    assert joins.equi_join(none, one, name).count() == 0
    assert joins.equi_join(one, none, name, materialize=False).first().cnt == 0


def test_unique_build_keeps_one_row_a_key(spark):
    assert joins.equi_join(rel(spark, [(1, 1), (1, 2)]), rel(spark, [(1, 5), (1, 6)]), "CHT").count() == 2


def test_large_sides_are_not_broadcast(spark):
    big = spark.range(10).select("id")
    assert joins.broadcast_if_small(big, limit=1)._jdf.queryExecution().logical().toString().lower().count("shuffle_hash")


def test_strategies_choose_their_operator(spark):
    r, s = generators.pk(spark, 10), generators.fk(spark, 100, 10)
    plan = lambda n: joins.equi_join(r, s, n)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan("PHT") and "ShuffledHashJoin" in plan("RHO")
    assert "SortMergeJoin" in plan("MWAY") and "CartesianProduct" in plan("NL")


def test_unknown_name(spark):
    with pytest.raises(ValueError):
        joins.equi_join(rel(spark, []), rel(spark, []), "nope")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def compressed(spark, path, n):
    """A relation of few bytes a row in its file, which Catalyst's estimate takes for its size."""
    spark.range(n).select(F.col("id").alias("key"), F.lit(0).cast("long").alias("payload")).coalesce(1).write.parquet(str(path))
    return spark.read.parquet(str(path))


def test_rows_bound_a_broadcast_where_the_estimate_is_small(spark, tmp_path, monkeypatch):
    r, s = compressed(spark, tmp_path / "r", 3000), compressed(spark, tmp_path / "s", 3000)
    assert "BroadcastHashJoin" in plan_of(joins.equi_join(r, s, "PHT_o"))
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 2999)
    assert joins.estimated_bytes(r) < joins.BROADCAST_BYTES
    out = joins.equi_join(r, s, "PHT_o", materialize=False)
    assert "BroadcastExchange" not in plan_of(out) and out.first().cnt == 3000


def test_large_index_is_sorted_rows(spark, tmp_path, monkeypatch):
    r, s = compressed(spark, tmp_path / "r", 10), compressed(spark, tmp_path / "s", 3000)
    assert "BroadcastHashJoin" in plan_of(joins.equi_join(r, s, "INL"))
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 2999)
    out = joins.equi_join(r, s, "INL", materialize=False)
    assert "SortMergeJoin" in plan_of(out) and "BroadcastExchange" not in plan_of(out) and out.first().cnt == 10


def test_unique_build_is_bounded_by_the_rows_it_is_made_of(spark, tmp_path, monkeypatch):
    r, s = compressed(spark, tmp_path / "r", 3000), compressed(spark, tmp_path / "s", 3000)
    assert "BroadcastHashJoin" in plan_of(joins.equi_join(r, s, "CHT"))
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 2999)
    out = joins.checksum(joins.equi_join(r, s, "CHT"))
    assert "BroadcastExchange" not in plan_of(out) and tuple(out.first()) == (3000, 0)
