"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Each query runs once to warm up and then twice, all columns of its result read by a no-op sink; the smaller time counts.
"""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(os.path.abspath(__file__)), *filter(None, [os.environ.get("PYTHONPATH")])])

HEADLINE = (
    "tpch_q3 tpch_q10 tpch_q12 tpch_q19 join_broadcast_hash join_shuffle_hash join_sort_merge join_materialize join_checksum "
    "scan_count scan_sum scan_bitvector scan_dict8 scan_dict32 radix_histogram radix_prefix_sum radix_partition keyed_increment lookup_sum sort_keys"
).split()


#: Generated joins beside the tables: build and probe rows of 8 bytes each in the published figures, and strategies.
BUILD, PROBE, GENERATED = 13_107_200, 52_428_800, ("RHO", "PHT_o")


def generated(spark) -> dict[str, float]:
    """Million rows a second of counting joins over generated relations: written first, read once to warm up, the better of two runs."""
    from quillon.operators.joins import equi_join
    from quillon.sources.generators import RelationSpec, make_relations

    out = {}
    with tempfile.TemporaryDirectory(prefix="spark-bench-") as folder:  # one machine
        for side, df in zip("rs", make_relations(spark, RelationSpec(BUILD, PROBE)), strict=True):
            df.write.parquet(f"{folder}/{side}")
        r, s = (spark.read.parquet(f"{folder}/{side}") for side in "rs")
        for name in GENERATED:
            times = []
            for _ in range(3):
                began = time.perf_counter()
                assert equi_join(r, s, name, materialize=False).first().cnt == PROBE
                times.append(time.perf_counter() - began)
            out[name] = round((BUILD + PROBE) / min(times[1:]) / 1e6, 2)
    return out


def main() -> None:
    from quillon.registry import load_all
    from quillon.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), name="bench")
    queries, seconds = load_all().queries, {}
    for name in HEADLINE:
        times = []
        for _ in range(3):
            began = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        seconds[name] = round(min(times[1:]), 4)
    rows = sum(spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("orders", "lineitem"))
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 4), "unit": "sec", "queries": seconds, "sf": sf_dir.rpartition("sf")[2], "join_rows_per_sec": round(rows / seconds["join_shuffle_hash"]), "generated_mrows_per_sec": generated(spark) if os.environ.get("BENCH_GENERATED", "1") != "0" else {}}))
    spark.stop()


if __name__ == "__main__":
    main()
