"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` is the folder of the tables, ``BENCH_CPUS`` the number of
threads. Every query runs once to warm up and three times for the median; all
rows of its result are computed, and writes are part of the time.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from lakejobs.jobs import QUERIES

HEADLINE = [
    "scan_all",
    "project_cols",
    "filter_eq",
    "filter_conj",
    "partition_pruned_scan",
    "count_all",
    "group_count",
    "group_count_avg",
    "order_by",
    "union_all",
    "cross_join_numbers",
    "latest_n",
    "explode_first",
    "gen_flights",
    "rebuild_partitioned",
    "expr_pack",
    "flights_pruned",
    "flights_delayed",
    "flights_carrier_stats",
    "named_queries",
    "scan_report",
    "zone_map",
    "skipping_scan",
    "clustered_scan",
    "key_lookup",
    "append_by_name",
    "append_with_rejects",
    "append_verify",
    "append_retry",
    "append_repeated",
    "json_infer_scan",
    "json_records",
    "json_infer_texts",
    "json_keys",
    "json_first",
    "split_statements",
    "string_pack",
    "table_profile",
    "profile_sketches",
    "stream_append",
]
REPEATS = 3


def seconds(spark: SparkSession, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    timings = {}
    for name in HEADLINE:
        seconds(spark, name, sf_dir)
        runs = [seconds(spark, name, sf_dir) for _ in range(REPEATS)]
        timings[name] = round(statistics.median(runs), 4)
    result = {
        "metric": "total of median query times",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
