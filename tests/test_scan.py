import pytest
from pyspark.sql import functions as F

from quillon.operators import scan
from quillon.sources import generators

N = 1 << 14


@pytest.mark.parametrize(
    "codes, scale, shift, low, high, rows, first",
    [
        (256, 1, 0, 0, 100, N // 256 * 101, [0, 1]),
        (256, 1, 0, 1, 100, N // 256 * 100, [1, 2]),
        (256, 2, 0, 0, 98, N // 256 * 50, [0, 2]),
        (4, 1, 0, 0, 2, N // 4 * 3, [0, 1]),
        (256, 1, 0, 100, 199, N // 256 * 100, [100, 101]),
        (256, 1, -128, -10, 0, N // 256 * 11, [-10, -9]),
        (65536, 1, 0, 0, 299, 300, [0, 1]),
        (256, 1, 0, 300, 400, 0, []),
        (256, 1, 0, -5, -1, 0, []),
    ],
)
def test_dictionary_scans(spark, codes, scale, shift, low, high, rows, first):
    data = generators.ramp(spark, N, codes)
    out = scan.dictionary_scan(data, "code", scan.identity_dictionary(spark, codes, scale, shift), low, high)
    got = sorted({r.value for r in out.collect()})
    assert out.count() == rows and got[:2] == first


def test_codes_above_16_bits(spark):
    data = spark.range(70_000, 70_010).selectExpr("id AS code")
    assert scan.dictionary_scan(data, "code", scan.identity_dictionary(spark, 1 << 17), 70_002, 70_004).count() == 3


def test_outputs_agree(spark):
    data = generators.ramp(spark, 1000)  # not a multiple of 64
    one = lambda o: scan.range_scan(data, "code", 3, 77, o)
    want = [i for i in range(1000) if 3 <= i % 256 <= 77]
    assert one("count").first().cnt == len(want)
    assert one("sum").first().total == sum(i % 256 for i in want)
    assert sorted(r.pos for r in one("positions").collect()) == want
    words = {r.word: r.lo | r.hi << 32 for r in one("bitvector").collect()}
    assert len(words) == 16 and [64 * w + b for w in sorted(words) for b in range(64) if words[w] >> b & 1] == want
    assert scan.range_scan(data, "code", 9, 8, "sum").first().total == 0


def test_positions_without_a_position_column(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 AS v").repartition(5)
    assert [(r.v, r.pos) for r in scan.with_positions(df, ["v"]).orderBy("v").collect()] == [(i, i) for i in range(1000)]


def test_selectivity_and_sweeps():
    assert [scan.selectivity_to_high(p) for p in (0, 1, 50, 100)] == [0, 3, 128, 255]
    assert list(scan.spans(1, 16, 1, doubling=True)) == [1, 2, 4, 8, 16] and list(scan.spans(1, 7, 3)) == [1, 4, 7]
    assert len(scan.configurations(["a", "b"], [1, 2], [64], [1, 5, 10])) == 12


def test_names_of_the_operator_in_the_table(spark):
    data = generators.ramp(spark, 512).withColumns({c: F.lit("x") for c in ("value", "__code", "hit", "__id", "__part", "__n", "__start")})
    assert scan.dictionary_scan(data, "code", scan.identity_dictionary(spark, 256), 3, 4).count() == 4
    out = scan.with_positions(data.drop("pos"), ["code"])
    assert out.columns == [*data.drop("pos").columns, "pos"] and sorted(r.pos for r in out.select("pos").collect()) == list(range(512))


def test_the_predicate_becomes_a_range_of_codes(spark, tmp_path):
    generators.ramp(spark, 4096).write.parquet(f"{tmp_path}/codes")
    data = spark.read.parquet(f"{tmp_path}/codes")
    dictionary = scan.identity_dictionary(spark, 256, shift=-128)
    assert scan.code_range(dictionary, -10, 5) == (118, 133) and scan.code_range(dictionary, 500, 600) is None
    plan = scan.dictionary_scan(data, "code", dictionary, -10, 5)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(code,118)" in plan and "LessThanOrEqual(code,133)" in plan
    mixed = spark.createDataFrame([(0, 5), (1, 100), (2, 6)], "code long, value long")
    assert sorted(r.value for r in scan.dictionary_scan(data, "code", mixed, 5, 6).distinct().collect()) == [5, 6]


def test_large_dictionaries_are_narrowed_to_codes_that_are_there(spark):
    data = spark.range(1000, 2000).selectExpr("id AS code")
    assert scan.dictionary_scan(data, "code", scan.identity_dictionary(spark, 1 << 20), 5, 1 << 20).count() == 1000
    assert scan.dictionary_scan(data, "code", scan.identity_dictionary(spark, 1 << 20), 5, 50).count() == 0


def test_repeated_positions_set_a_bit_once(spark):
    df = spark.createDataFrame([(3, 1), (3, 1), (63, 1), (40, 9)], "pos long, v long")
    assert [tuple(r) for r in scan.range_scan(df, "v", 1, 1, "bitvector").collect()] == [(0, 1 << 3, 1 << 31)]
