from pyspark.sql import functions as F

from quillon.functions import scalar
from quillon.operators import filters, partition
from quillon.sources import files, generators


def test_histogram_and_offsets(spark):
    rows = generators.keyed_rows(spark, 1000, 37)
    out = partition.prefix_sum(partition.histogram(rows, scalar.radix_bin(F.col("key"), 3, 1))).orderBy("bin").collect()
    assert sum(r.cnt for r in out) == 1000 and out[-1].start + out[-1].cnt == 1000
    padded = partition.prefix_sum(partition.histogram(rows, scalar.radix_bin(F.col("key"), 3, 1)), padding=4).orderBy("bin").collect()
    assert [p.start - r.start for p, r in zip(padded, out, strict=True)] == [4 * i for i in range(len(out))]


def test_bins_are_spark_partitions(spark):
    out = partition.radix_partition(generators.keyed_rows(spark, 500, 100), scalar.radix_bin(F.col("key"), 3), 8)
    assert out.where(F.spark_partition_id() != F.col("bin")).count() == 0 and out.count() == 500


def test_radix_bits():
    assert partition.num_radix_bits(1 << 20, 1 << 12, 4) == 10 and partition.num_radix_bits(0, 4, 1) == 0
    assert partition.num_passes(13) == 1 and partition.num_passes(14) == 2


def test_disorder_over_block_edges(spark):
    df = spark.createDataFrame([(p, v) for p, v in enumerate([1, 2, 2, 1, 5, 4, 4, 9])], "p long, v long")
    assert tuple(partition.disorder(df, "v", "p", block=2).first()) == (8, 2)
    assert tuple(partition.disorder(df, "v", "p", block=1, blocks=3).first()) == (8, 2)
    assert tuple(partition.disorder(df.limit(0), "v", "p").first()) == (0, 0)


def test_text_tables_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "ALGERIA", 0, "x"), (2, None, 1, "y")], "n_nationkey int, n_name string, n_regionkey int, n_comment string")
    files.write_tbl(rows, f"{tmp_path}/nation.tbl")
    back = files.read_tbl(spark, f"{tmp_path}/nation.tbl", "nation", ["n_nationkey", "n_name"]).orderBy("n_nationkey").collect()
    assert [tuple(r) for r in back] == [(1, "ALGERIA"), (2, None)]
    files.convert(spark, str(tmp_path), f"{tmp_path}/store", ["nation"])
    assert files.read_store(spark, f"{tmp_path}/store/nation.parquet", ["n_nationkey"]).columns == ["n_nationkey"]


def test_malformed_rows(spark, tmp_path):
    (tmp_path / "r.tbl").write_text("1|AFRICA|c|\nx|ASIA|c|\n")
    assert len(files.read_tbl(spark, str(tmp_path / "r.tbl"), "region").collect()) == 1
    kept = files.read_tbl(spark, str(tmp_path / "r.tbl"), "region", keep_malformed=True).cache()
    assert kept.count() == 2 and kept.where("_corrupt_record IS NOT NULL").first()._corrupt_record == "x|ASIA|c|"


def test_key_files_and_metrics(spark, tmp_path):
    (tmp_path / "keys").write_text("5\n7\nno\n")
    out = files.read_keys(spark, str(tmp_path / "keys"))
    assert sorted(map(tuple, out.collect())) == [(5, 0), (7, 0)]
    files.write_metrics(out, f"{tmp_path}/m")
    assert spark.read.csv(f"{tmp_path}/m", header=True).count() == 2
    assert [r.key for r in files.sample_rows(out, 1, 2).collect()] == [7]


def test_generators(spark):
    assert sorted(r.key for r in generators.fk(spark, 7, 3).collect()) == [1, 1, 1, 2, 2, 3, 3]
    assert generators.fk_selectivity(spark, 10, 5, 0).where("key = 0").count() == 10
    r, s = generators.make_relations(spark, generators.RelationSpec(100, 1000, selectivity=10))
    assert s.join(r, "key").count() == 100
    r, s = generators.make_relations(spark, generators.RelationSpec(100, 1000, skew=1.5))
    assert s.where("key < 1 OR key > 100").count() == 0
    assert generators.fk_from_pk(generators.pk(spark, 3), 4).count() == 12
    assert generators.slots(spark, 10, 4, "linear").distinct().count() == 4
    assert generators.uniform(spark, 50, 5).where("key BETWEEN 1 AND 5").count() == 50


def test_scalar_functions(spark):
    df = spark.createDataFrame([("1995-03-15",), ("bad",), (None,)], "d string")
    assert [r[0] for r in df.select(scalar.epoch_seconds(F.col("d"))).collect()] == [795225600, None, None]
    one = spark.range(1)
    assert one.select(scalar.to_number(F.lit("x"), strict=False)).first()[0] is None
    assert tuple(one.select(scalar.next_power_of_two(F.lit(5)), scalar.test_bit(F.lit(8), 3), scalar.set_bit(F.lit(1), 3)).first()) == (8, 1, 9)


def test_residual_with_other_literals(spark):
    row = spark.createDataFrame([("B", "C", 3, 7.0)], "p_brand string, p_container string, p_size int, l_quantity double")
    assert row.where(filters.q19_residual([("B", ("C",), 5, 3)])).count() == 1
    assert row.where(filters.q19_residual([("B", ("C",), 8, 3)])).count() == 0


def test_streamed_counts(spark, tmp_path):
    from quillon.streaming import scans

    generators.ramp(spark, 512).write.parquet(f"{tmp_path}/in")
    stream = scans.read_stream(spark, f"{tmp_path}/in", "pos long, code long")
    q = scans.to_memory(partition.histogram(stream, F.col("code") % 4), "bins", "complete")
    q.awaitTermination(60)
    assert {r.cnt for r in spark.table("bins").collect()} == {128}


def test_metrics_overhead(spark):
    from quillon.functions import metrics

    rows = spark.createDataFrame([("a", "x", 2.0), ("a", "x", 4.0), ("a", "y", 6.0), ("b", "x", 1.0)], "q string, mode string, value double")
    got = {(r.q, r.mode): r.ratio for r in metrics.overhead(rows, ["q"], "mode", "x").collect()}
    assert got == {("a", "x"): 1.0, ("a", "y"): 2.0, ("b", "x"): 1.0}
    assert {(r.q, r["mean"], r.least, r.n) for r in metrics.summary(rows, ["q"]).collect()} == {("a", 4.0, 2.0, 3), ("b", 1.0, 1.0, 1)}


def test_join_text_and_equality(spark, tmp_path):
    from quillon.operators import joins

    joined = joins.equi_join(generators.pk(spark, 5), generators.fk(spark, 12, 5))
    files.write_join_text(joined, f"{tmp_path}/j")
    back = spark.read.schema("key long, r_payload long, s_payload long").csv(f"{tmp_path}/j")
    assert joins.same_rows(joined, back) and not joins.same_rows(joined, back.limit(3)) and back.count() == 12


def test_pairs_of_bins_have_their_partitions(spark):
    out = partition.two_pass_bins(generators.keyed_rows(spark, 600, 150), "key", 2, 3)
    assert out.count() == 600 and out.where(F.spark_partition_id() != F.col("bin1") * 8 + F.col("bin2")).count() == 0


def test_radix_join_drops_empty_bins(spark):
    from quillon.operators import joins

    r, s = generators.pk(spark, 50), generators.fk(spark, 300, 20).unionByName(spark.createDataFrame([(None, 1), (4096, 2)], "key long, payload long"))
    left, right = partition.in_both(r, s, 6)
    assert {x.bin for x in left.select("bin").collect()} == {x.bin for x in right.select("bin").collect()}
    for rows, cache in ((None, 16), (0, 1 << 18)):
        assert joins.same_rows(partition.radix_join(r, s, cache, 4, rows), joins.equi_join(r, s))


def test_selective_keys_slots_and_hashes(spark):
    keys = [x.key for x in generators.pk_selectivity(spark, 10, 30).collect()]
    assert keys == [int(1 + i * 100 / 30) for i in range(10)]
    assert {x.slot for x in generators.slots(spark, 10, 4, "pointer").collect()} == {0, 4, 8, 12}
    row = spark.range(1).select(*(scalar.hash_of(F.lit(k).cast("bigint"), "fibonacci") for k in (0, 1, 2**32 - 1, 2**40 + 7))).first()
    assert list(row) == [k * 11400714819323198485 % 2**32 for k in (0, 1, 2**32 - 1, 2**40 + 7)]
    assert all(spark.range(1).select(scalar.hash_of(F.col("id"), k)).first()[0] is not None for k in ("identity", "crc32", "murmur"))


def test_phase_maxima(spark):
    from quillon.functions import metrics

    timers = spark.createDataFrame([("q", 0, 3, 9), ("q", 1, 5, 2)], "query string, thread int, build long, probe long")
    assert tuple(metrics.phase_maxima(timers, ["query"]).first()) == ("q", 5, 9)


def test_an_index_stays_in_place(spark):
    from quillon.operators import joins

    r, s = generators.pk(spark, 40), generators.fk(spark, 400, 60)
    index = joins.write_index(s, "quillon_index", 4)
    try:
        out = joins.index_join(r, index)
        assert joins.same_rows(out, joins.equi_join(r, s))
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    finally:
        spark.sql("DROP TABLE quillon_index")
