"""The registered queries over the tables of a scale-factor folder, each with its SQL oracle."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import scalar
from quillon.operators import filters, joins, partition, scan
from quillon.operators.filters import filter_project
from quillon.plans import tpch
from quillon.registry import REGISTRY
from quillon.session import shared_folder
from quillon.sources import files, generators
from quillon.tables import LINEITEM_SQL, PART_SQL, load, with_container, with_shipping

query = REGISTRY.add

# --- composite queries


@query("tpch_q3", """SELECT COUNT(*) AS cnt FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < DATE '1995-03-15' AND l_shipdate >= DATE '1995-03-16'""")
def tpch_q3(spark: SparkSession, d: str) -> DataFrame:
    return tpch.count(tpch.q3(load(spark, d, "customer"), load(spark, d, "orders"), load(spark, d, "lineitem")))


@query("tpch_q10", """SELECT COUNT(*) AS cnt FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN lineitem ON o_orderkey = l_orderkey
WHERE o_orderdate >= DATE '1995-10-01' AND o_orderdate < DATE '1996-01-01' AND l_returnflag = 'R'""")
def tpch_q10(spark: SparkSession, d: str) -> DataFrame:
    return tpch.count(tpch.q10(load(spark, d, "customer"), load(spark, d, "orders"), load(spark, d, "lineitem"), load(spark, d, "nation")))


Q12 = "l_shipmode IN ('MAIL','SHIP') AND l_commitdate < l_receiptdate AND l_shipdate < l_commitdate AND l_receiptdate >= DATE '1996-01-01' AND l_receiptdate < DATE '1997-01-01'"


@query("tpch_q12", f"SELECT COUNT(*) AS cnt FROM orders JOIN {LINEITEM_SQL} l ON o_orderkey = l_orderkey WHERE {Q12}")
def tpch_q12(spark: SparkSession, d: str) -> DataFrame:
    return tpch.count(tpch.q12(load(spark, d, "orders"), with_shipping(load(spark, d, "lineitem"))))


Q19_LINEITEM = "l_quantity >= 1 AND l_quantity <= 30 AND l_shipmode IN ('AIR','AIR REG') AND l_shipinstruct = 'DELIVER IN PERSON'"
Q19_PART = """p_brand IN ('Brand#12','Brand#23','Brand#24') AND p_size BETWEEN 1 AND 15 AND p_container IN
('SM CASE','SM BOX','SM PACK','SM PKG','MED BAG','MED BOX','MED PKG','MED PACK','LG CASE','LG BOX','LG PACK','LG PKG')"""
Q19 = """(p_brand = 'Brand#12' AND p_container IN ('SM CASE','SM BOX','SM PACK','SM PKG') AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 5
OR p_brand = 'Brand#23' AND p_container IN ('MED BAG','MED BOX','MED PKG','MED PACK') AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 10
OR p_brand = 'Brand#24' AND p_container IN ('LG CASE','LG BOX','LG PACK','LG PKG') AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 15)"""


@query("tpch_q19", f"SELECT COUNT(*) AS cnt FROM {PART_SQL} p JOIN {LINEITEM_SQL} l ON p_partkey = l_partkey WHERE l_shipmode IN ('AIR','AIR REG') AND l_shipinstruct = 'DELIVER IN PERSON' AND {Q19}")
def tpch_q19(spark: SparkSession, d: str) -> DataFrame:
    return tpch.count(tpch.q19(with_container(load(spark, d, "part")), with_shipping(load(spark, d, "lineitem"))))


@query("ext_q3_revenue", """SELECT o_orderkey, o_orderdate, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < DATE '1995-03-15' AND l_shipdate >= DATE '1995-03-16'
GROUP BY o_orderkey, o_orderdate ORDER BY revenue DESC, o_orderkey LIMIT 10""")
def ext_q3_revenue(spark: SparkSession, d: str) -> DataFrame:
    return tpch.q3_revenue(load(spark, d, "customer"), load(spark, d, "orders"), load(spark, d, "lineitem"))


# --- filters

FILTERS = {
    "filter_project": ("lineitem", lambda: (F.col("l_quantity") <= 10) & (F.col("l_discount") >= 0.05), {"key": "l_orderkey", "payload": "l_partkey"}, "SELECT l_orderkey AS key, l_partkey AS payload FROM lineitem WHERE l_quantity <= 10 AND l_discount >= 0.05"),
    "q3_filter_customer": ("customer", filters.q3_customer, {"key": "c_custkey", "payload": "c_nationkey"}, "SELECT c_custkey AS key, c_nationkey AS payload FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "q3_filter_orders": ("orders", filters.q3_orders, {"key": "o_custkey", "payload": "o_orderkey"}, "SELECT o_custkey AS key, o_orderkey AS payload FROM orders WHERE o_orderdate < DATE '1995-03-15'"),
    "q3_filter_lineitem": ("lineitem", filters.q3_lineitem, {"key": "l_orderkey", "payload": "l_partkey"}, "SELECT l_orderkey AS key, l_partkey AS payload FROM lineitem WHERE l_shipdate >= DATE '1995-03-16'"),
    "q10_filter_orders": ("orders", filters.q10_orders, {"key": "o_custkey", "payload": "o_orderkey"}, "SELECT o_custkey AS key, o_orderkey AS payload FROM orders WHERE o_orderdate >= DATE '1995-10-01' AND o_orderdate < DATE '1996-01-01'"),
    "q10_filter_lineitem": ("lineitem", filters.q10_lineitem, {"key": "l_orderkey", "payload": "l_partkey"}, "SELECT l_orderkey AS key, l_partkey AS payload FROM lineitem WHERE l_returnflag = 'R'"),
    "q12_filter_lineitem": ("lineitem", filters.q12_lineitem, {"key": "l_orderkey", "payload": "l_partkey"}, f"SELECT l_orderkey AS key, l_partkey AS payload FROM {LINEITEM_SQL} l WHERE {Q12}"),
    "q19_filter_lineitem": ("lineitem", filters.q19_lineitem, {"key": "l_partkey", "payload": "l_orderkey"}, f"SELECT l_partkey AS key, l_orderkey AS payload FROM {LINEITEM_SQL} l WHERE {Q19_LINEITEM}"),
    "q19_filter_part": ("part", filters.q19_part, {"key": "p_partkey", "payload": "p_size"}, f"SELECT p_partkey AS key, p_size AS payload FROM {PART_SQL} p WHERE {Q19_PART}"),
}
DERIVED = {"lineitem": with_shipping, "part": with_container}

for _name, (_table, _predicate, _columns, _sql) in FILTERS.items():
    query(_name, _sql)(lambda spark, d, t=_table, p=_predicate, c=_columns: filter_project(DERIVED.get(t, lambda x: x)(load(spark, d, t)), p(), **c))

# --- joins: R = orders by order key, S = lineitem by order key


def _rs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    r = joins.relation(load(spark, d, "orders"), "o_orderkey", "o_custkey")
    return r, joins.relation(load(spark, d, "lineitem"), "l_orderkey", "l_partkey")


RS = "FROM orders JOIN lineitem ON o_orderkey = l_orderkey"
for _name, _strategy in {"join_broadcast_hash": "PHT_o", "join_shuffle_hash": "RHO", "join_sort_merge": "MWAY", "join_index_lookup": "INL", "join_unique_build": "CHT"}.items():
    query(_name, f"SELECT COUNT(*) AS cnt {RS}")(lambda spark, d, s=_strategy: joins.equi_join(*_rs(spark, d), s, materialize=False))


@query("join_materialize", f"SELECT o_orderkey AS key, o_custkey AS r_payload, l_partkey AS s_payload {RS}")
def join_materialize(spark: SparkSession, d: str) -> DataFrame:
    return joins.equi_join(*_rs(spark, d), "RHO")


@query("join_rekey", """SELECT c_custkey AS key, c_nationkey AS r_payload, l_partkey AS s_payload
FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey""")
def join_rekey(spark: SparkSession, d: str) -> DataFrame:
    first = joins.equi_join(*_rs(spark, d), "RHO")
    return joins.equi_join(joins.relation(load(spark, d, "customer"), "c_custkey", "c_nationkey"), joins.rekey(first, "r_payload", "s_payload"), "RHO")


@query("join_checksum", f"SELECT COUNT(*) AS cnt, CAST(SUM(o_custkey + l_partkey) AS BIGINT) AS checksum {RS}")
def join_checksum(spark: SparkSession, d: str) -> DataFrame:
    return joins.checksum(joins.equi_join(*_rs(spark, d), "CHT"))


def _nested_loop(spark: SparkSession, d: str) -> DataFrame:
    return joins.block_nested_loop(*_rs(spark, d), materialize=False)


def _count_all(spark: SparkSession, d: str) -> DataFrame:
    counted = lambda s: _nested_loop(spark, d) if s == "NL" else joins.equi_join(*_rs(spark, d), s, materialize=False)
    return joins.union_fragments(*(counted(s).select(F.lit(s).alias("strategy"), "cnt") for s in joins.JOIN_STRATEGIES))


#: Both names of each query join whole relations.
for _name in ("join_nested_loop", "join_nested_loop_whole"):
    query(_name, f"SELECT COUNT(*) AS cnt {RS}")(_nested_loop)
for _name in ("join_count_all_strategies", "join_count_all_strategies_whole"):
    query(_name, "SELECT strategy, cnt FROM (VALUES " + ", ".join(f"('{s}')" for s in joins.JOIN_STRATEGIES) + f") t(strategy), (SELECT COUNT(*) AS cnt {RS})")(_count_all)


@query("join_radix", f"SELECT o_orderkey AS key, o_custkey AS r_payload, l_partkey AS s_payload {RS}")
def join_radix(spark: SparkSession, d: str) -> DataFrame:
    return partition.radix_join(*_rs(spark, d))


# --- scans: a code column over events, whose event_id is a dense position


def _codes(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events")
    return e.select(F.col("event_id").alias("pos"), (F.col("event_id") % 256).alias("code8"), (F.col("event_id") % 65536).alias("code16"), F.col("user_id").alias("code32"), F.col("user_id").alias("idx"))


def _scan(output: str, low: int = 10, high: int = 99):
    return lambda spark, d: scan.range_scan(_codes(spark, d), "code8", low, high, output, index="idx")


IN = "event_id % 256 BETWEEN 10 AND 99"
query("scan_count", f"SELECT COUNT(*) AS cnt FROM events WHERE {IN}")(_scan("count"))
query("scan_sum", f"SELECT CAST(COALESCE(SUM(event_id % 256), 0) AS BIGINT) AS total FROM events WHERE {IN}")(_scan("sum"))
query("scan_values", f"SELECT event_id % 256 AS value FROM events WHERE {IN}")(_scan("values"))
query("scan_positions", f"SELECT event_id AS pos FROM events WHERE {IN}")(_scan("positions"))
query("scan_explicit_index", f"SELECT user_id AS idx FROM events WHERE {IN}")(_scan("index"))
query("scan_bitvector", f"""SELECT CAST(FLOOR(event_id / 64) AS BIGINT) AS word,
CAST(SUM(CASE WHEN {IN} AND event_id % 64 < 32 THEN POWER(2, event_id % 64) ELSE 0 END) AS BIGINT) AS lo,
CAST(SUM(CASE WHEN {IN} AND event_id % 64 >= 32 THEN POWER(2, event_id % 64 - 32) ELSE 0 END) AS BIGINT) AS hi FROM events GROUP BY 1""")(_scan("bitvector"))
query("scan_empty_range", "SELECT COUNT(*) AS cnt FROM events WHERE event_id % 256 BETWEEN 300 AND 400")(_scan("count", 300, 400))


@query("scan_with_positions", "SELECT o_orderkey, CAST(ROW_NUMBER() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS pos FROM orders")
def scan_with_positions(spark: SparkSession, d: str) -> DataFrame:
    return scan.with_positions(load(spark, d, "orders").select("o_orderkey"), ["o_orderkey"])


@query("scan_prune", "SELECT l_orderkey, l_shipdate FROM lineitem WHERE l_quantity < 5")
def scan_prune(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").where("l_quantity < 5").select("l_orderkey", "l_shipdate")


@query("scan_dict8", "SELECT CAST(event_id % 256 - 128 AS BIGINT) AS value FROM events WHERE event_id % 256 - 128 BETWEEN -10 AND 50")
def scan_dict8(spark: SparkSession, d: str) -> DataFrame:
    return scan.dictionary_scan(_codes(spark, d), "code8", scan.identity_dictionary(spark, 256, shift=-128), -10, 50)


@query("scan_dict16", "SELECT CAST(2 * (event_id % 65536) AS BIGINT) AS value FROM events WHERE 2 * (event_id % 65536) BETWEEN 100 AND 2000")
def scan_dict16(spark: SparkSession, d: str) -> DataFrame:
    return scan.dictionary_scan(_codes(spark, d), "code16", scan.identity_dictionary(spark, 1 << 16, scale=2), 100, 2000)


@query("scan_dict32", "SELECT CAST(user_id AS BIGINT) AS value FROM events WHERE user_id BETWEEN 5 AND 1048576")
def scan_dict32(spark: SparkSession, d: str) -> DataFrame:
    return scan.dictionary_scan(_codes(spark, d), "code32", scan.identity_dictionary(spark, 1 << 20), 5, 1 << 20)


PERCENTS = (0, 1, 10, 25, 50, 100)


@query("scan_selectivity_sweep", "SELECT p AS selectivity, h AS high, (SELECT COUNT(*) FROM events WHERE event_id % 256 BETWEEN 0 AND h) AS cnt FROM (VALUES " + ", ".join(f"({p}, {scan.selectivity_to_high(p)})" for p in PERCENTS) + ") t(p, h)")
def scan_selectivity_sweep(spark: SparkSession, d: str) -> DataFrame:
    return scan.selectivity_sweep(_codes(spark, d), "code8", PERCENTS)


# --- partitioning

BITS, SHIFT, KEY_BITS = 7, 0, 20
LOW_BIN, HIGH_BIN = "(l_orderkey & 127)", "((l_orderkey >> 13) & 127)"


def _s(spark: SparkSession, d: str) -> DataFrame:
    return _rs(spark, d)[1]


@query("radix_histogram", f"SELECT {LOW_BIN} AS bin, COUNT(*) AS cnt FROM lineitem GROUP BY 1")
def radix_histogram(spark: SparkSession, d: str) -> DataFrame:
    return partition.histogram(_s(spark, d), scalar.radix_bin(F.col("key"), BITS))


@query("radix_histogram_msb", f"SELECT {HIGH_BIN} AS bin, COUNT(*) AS cnt FROM lineitem GROUP BY 1")
def radix_histogram_msb(spark: SparkSession, d: str) -> DataFrame:
    return partition.histogram(_s(spark, d), scalar.msb_bin(F.col("key"), BITS, KEY_BITS))


@query("radix_prefix_sum", f"""SELECT bin, cnt, CAST(COALESCE(SUM(cnt) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
FROM (SELECT {LOW_BIN} AS bin, COUNT(*) AS cnt FROM lineitem GROUP BY 1)""")
def radix_prefix_sum(spark: SparkSession, d: str) -> DataFrame:
    return partition.prefix_sum(radix_histogram(spark, d))


@query("radix_partition", f"SELECT l_orderkey AS key, l_partkey AS payload, {LOW_BIN} AS bin FROM lineitem")
def radix_partition(spark: SparkSession, d: str) -> DataFrame:
    return partition.radix_partition(_s(spark, d), scalar.radix_bin(F.col("key"), BITS), 1 << BITS)


@query("radix_partition_2pass", "SELECT l_orderkey AS key, l_partkey AS payload, l_orderkey & 15 AS bin1, (l_orderkey >> 4) & 15 AS bin2 FROM lineitem")
def radix_partition_2pass(spark: SparkSession, d: str) -> DataFrame:
    return partition.two_pass_bins(_s(spark, d), "key", 4, 4)


@query("radix_partition_msb", f"SELECT l_orderkey AS key, l_partkey AS payload, {HIGH_BIN} AS bin FROM lineitem")
def radix_partition_msb(spark: SparkSession, d: str) -> DataFrame:
    return partition.radix_partition(_s(spark, d), scalar.msb_bin(F.col("key"), BITS, KEY_BITS), 1 << BITS)


@query("radix_join_task_sizes", """SELECT bin, r_rows, s_rows FROM (SELECT o_orderkey & 127 AS bin, COUNT(*) AS r_rows FROM orders GROUP BY 1)
JOIN (SELECT l_orderkey & 127 AS bin, COUNT(*) AS s_rows FROM lineitem GROUP BY 1) USING (bin)""")
def radix_join_task_sizes(spark: SparkSession, d: str) -> DataFrame:
    return partition.join_task_sizes(*_rs(spark, d), BITS)


# --- micro-operators


@query("scatter_distinct", "SELECT DISTINCT l_partkey & 1023 AS slot FROM lineitem")
def scatter_distinct(spark: SparkSession, d: str) -> DataFrame:
    return partition.scatter(load(spark, d, "lineitem"), F.col("l_partkey").bitwiseAND(1023))


@query("keyed_increment", "SELECT l_suppkey & 255 AS slot, COUNT(*) AS cnt FROM lineitem GROUP BY 1")
def keyed_increment(spark: SparkSession, d: str) -> DataFrame:
    return partition.keyed_increment(load(spark, d, "lineitem"), F.col("l_suppkey").bitwiseAND(255))


@query("lookup_sum", "SELECT CAST(SUM(p_size) AS BIGINT) AS total FROM lineitem JOIN part ON l_partkey = p_partkey")
def lookup_sum(spark: SparkSession, d: str) -> DataFrame:
    table = load(spark, d, "part").select(F.col("p_partkey").alias("slot"), F.col("p_size").alias("value"))
    return partition.lookup_sum(load(spark, d, "lineitem"), F.col("l_partkey"), table)


# --- sort, concatenation


@query("sort_keys", "SELECT l_orderkey AS key, l_partkey AS payload FROM lineitem ORDER BY 1, 2")
def sort_keys(spark: SparkSession, d: str) -> DataFrame:
    return partition.sort_by_key(_s(spark, d), "payload")


@query("check_sorted", """SELECT COUNT(*) AS cnt, COUNT(*) FILTER (WHERE v < before) AS breaks
FROM (SELECT user_id AS v, LAG(user_id) OVER (ORDER BY event_id) AS before FROM events)""")
def check_sorted(spark: SparkSession, d: str) -> DataFrame:
    return partition.disorder(load(spark, d, "events"), "user_id", "event_id")


@query("concat_fragments", """SELECT l_orderkey AS key, l_partkey AS payload FROM lineitem WHERE l_quantity < 5
UNION ALL SELECT l_orderkey, l_partkey FROM lineitem WHERE l_quantity >= 45
UNION ALL SELECT o_orderkey, o_custkey FROM orders""")
def concat_fragments(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem")
    low, high = (joins.relation(li.where(w), "l_orderkey", "l_partkey") for w in ("l_quantity < 5", "l_quantity >= 45"))
    return joins.union_fragments(low, high, _rs(spark, d)[0])


# --- generators

query("gen_pk", "SELECT range AS key, range AS payload FROM range(1, 10001)")(lambda spark, d: generators.pk(spark, 10_000, shuffle_seed=11111))
query("gen_fk", "SELECT range % 3000 + 1 AS key, range AS payload FROM range(10000)")(lambda spark, d: generators.fk(spark, 10_000, 3000))
query("gen_fk_sel", "SELECT range % 10000 + 1 AS key, range AS payload FROM range(10000)")(lambda spark, d: generators.fk_selectivity(spark, 10_000, 1000, 10))
query("gen_pk_sel", "SELECT CAST(1 + FLOOR(range * 100 / 30) AS BIGINT) AS key, range AS payload FROM range(10000)")(lambda spark, d: generators.pk_selectivity(spark, 10_000, 30))
query("gen_zipf")(lambda spark, d: generators.zipf(spark, 10_000, 1000, 1.5, seed=7))


@query("gen_zipf_events", """WITH w AS (SELECT range AS k, SUM(1.0::DOUBLE / POWER(range, 1.5)) OVER (ORDER BY range) AS c FROM range(1, 1001)),
u AS (SELECT event_id AS payload, (event_id * 40503 % 65536 + 0.5) / 65536 * (SELECT MAX(c) FROM w) AS x FROM events)
SELECT k AS key, payload FROM u ASOF JOIN w ON u.x < w.c""")
def gen_zipf_events(spark: SparkSession, d: str) -> DataFrame:
    u = ((F.col("event_id") * 40503 % 65536 + 0.5) / 65536).alias("u")
    return generators.zipf_of(load(spark, d, "events").select(u, F.col("event_id").alias("payload")), 1000, 1.5)


# --- text tables


@query("src_tbl_roundtrip", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders")
def src_tbl_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path, o = f"{shared_folder(spark)}/orders-{uuid4().hex}.tbl", load(spark, d, "orders")
    rest = {"o_orderdate": F.col("o_orderdate").cast("date"), "o_clerk": F.lit("c"), "o_shippriority": F.lit(0), "o_comment": F.lit(None).cast("string")}
    files.write_tbl(o.withColumns(rest), path)
    return files.read_tbl(spark, path, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"])


# --- functions


@query("fn_epoch_seconds", "SELECT o_orderkey, CAST(epoch(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) AS BIGINT) AS seconds FROM orders")
def fn_epoch_seconds(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").select("o_orderkey", scalar.epoch_seconds(F.col("o_orderdate")).alias("seconds"))


@query("fn_enum_encode", f"""SELECT l_orderkey, CASE l_shipmode WHEN 'MAIL' THEN 1 WHEN 'SHIP' THEN 2 WHEN 'AIR' THEN 3 WHEN 'AIR REG' THEN 4 ELSE 0 END AS mode_code,
CASE l_shipinstruct WHEN 'DELIVER IN PERSON' THEN 1 ELSE 0 END AS instruct_code FROM {LINEITEM_SQL} l""")
def fn_enum_encode(spark: SparkSession, d: str) -> DataFrame:
    li = with_shipping(load(spark, d, "lineitem"))
    mode = scalar.enum_code(F.col("l_shipmode"), ("MAIL", "SHIP", "AIR", "AIR REG"))
    return li.select("l_orderkey", mode.alias("mode_code"), scalar.enum_code(F.col("l_shipinstruct"), (filters.IN_PERSON,)).alias("instruct_code"))


@query("fn_radix", "SELECT o_orderkey, (o_orderkey & 1016) >> 3 AS low_bin, (o_orderkey >> 13) & 127 AS high_bin FROM orders")
def fn_radix(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    return load(spark, d, "orders").select("o_orderkey", scalar.radix_bin(key, 7, 3).alias("low_bin"), scalar.msb_bin(key, 7, 20).alias("high_bin"))


@query("fn_hash", f"SELECT o_orderkey, o_orderkey AS identity, ((o_orderkey & 4294967295) * {scalar.FIBONACCI}) & 4294967295 AS fibonacci FROM orders")
def fn_hash(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    return load(spark, d, "orders").select("o_orderkey", scalar.hash_of(key).alias("identity"), scalar.hash_of(key, "fibonacci").alias("fibonacci"))


@query("fn_bits", """SELECT o_orderkey, CAST(CASE WHEN o_orderkey <= 1 THEN 1 ELSE POWER(2, CEIL(LOG2(o_orderkey))) END AS BIGINT) AS power,
CAST(FLOOR(LOG2(o_orderkey + 1)) AS BIGINT) AS log, CAST(BIT_COUNT(o_orderkey) AS BIGINT) AS ones, (o_orderkey >> 3) & 1 AS bit3, o_orderkey | 8 AS with3 FROM orders""")
def fn_bits(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    return load(spark, d, "orders").select("o_orderkey", scalar.next_power_of_two(key).alias("power"), scalar.bit_length_of(key + 1).alias("log"), scalar.popcount(key).alias("ones"), scalar.test_bit(key, 3).alias("bit3"), scalar.set_bit(key, 3).alias("with3"))
