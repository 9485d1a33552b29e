"""Plans that must hold when the data grows, and hot values."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lakejobs import jobs
from lakejobs.operators.ordering import first_match, latest, order_by
from lakejobs.plans.report import scan_facts
from lakejobs.session import load
from lakejobs.sources.tables import cluster_by, read_table, rebuild_partitioned, spread

from plan_text import plan

NO_SHUFFLE = [
    "scan_all",
    "project_cols",
    "filter_eq",
    "filter_conj",
    "partition_pruned_scan",
    "literal_rows",
    "union_all",
    "cross_join_numbers",
    "gen_flights",
    "expr_pack",
    "flights_pruned",
    "flights_delayed",
    "skipping_scan",
    "append_by_name",
    "append_with_rejects",
    "json_infer_scan",
    "json_write",
    "json_rows",
    "json_records",
    "json_keys",
    "json_flags",
    "json_items",
    "json_first",
    "list_join",
    "split_statements",
    "string_pack",
    "stream_append",
    "stream_batches",
]


@pytest.mark.parametrize("name", NO_SHUFFLE)
def test_no_shuffle(spark, tiny, name):
    assert "Exchange" not in plan(entry.queries()[name](spark, tiny))


@pytest.mark.parametrize("name", sorted(jobs.QUERIES))
def test_no_join_no_python(spark, tiny, name):
    shown = plan(entry.queries()[name](spark, tiny))
    assert "CartesianProduct" not in shown and "NestedLoop" not in shown
    assert "Python" not in shown and "InPandas" not in shown and "Window" not in shown


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("project_cols", ["l_orderkey", "l_linenumber", "l_quantity"]),
        ("filter_conj", ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"]),
        ("count_all", []),
        ("group_count", ["event_type"]),
        ("group_count_avg", ["l_quantity", "l_returnflag"]),
        ("flights_pruned", ["o_orderkey"]),
        ("partition_pruned_scan", ["event_id", "event_type", "value"]),
    ],
)
def test_columns_read(spark, tiny, name, columns):
    assert scan_facts(entry.queries()[name](spark, tiny)).columns == columns


def test_filters_reach_the_files(spark, tiny):
    facts = scan_facts(jobs.filter_conj(spark, tiny))
    assert "GreaterThan(l_quantity,45.0)" in facts.pushed_filters
    assert "EqualTo(l_returnflag,A)" in facts.pushed_filters
    facts = scan_facts(jobs.partition_pruned_scan(spark, tiny))
    assert facts.partitions == 1


@pytest.mark.parametrize("name", ["group_count", "group_count_avg", "explode_first", "zone_map"])
def test_groups_shrink_before_the_shuffle(spark, tiny, name):
    shown = plan(entry.queries()[name](spark, tiny))
    before = shown[shown.index("Exchange") :]
    assert "partial_" in before


def test_latest_is_a_top_n(spark, tiny):
    shown = plan(latest(load(spark, tiny, "events"), "ts", "event_id", 5))
    assert "TakeOrderedAndProject" in shown


def hot(spark, n=200_000):
    """A third of the rows in one value; wide enough to be worth splitting."""
    return spark.range(0, n, 1, 16).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("v"), F.col("id") % 8))
        .alias("p"),
        "id",
        F.sha2(F.col("id").cast("string"), 512).alias("pad"),
    )


def files_of(spark, path):
    counts = read_table(spark, path).groupBy("p", F.col("_metadata.file_path").alias("f")).count()
    rows = counts.collect()
    return {p: [r["count"] for r in rows if r.p == p] for p in {r.p for r in rows}}


def test_hot_partition_is_written_by_several_tasks(spark, folder):
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(key, "1MB")
    try:
        rebuild_partitioned(hot(spark), f"{folder}/t", "p")
    finally:
        spark.conf.unset(key)
    files = files_of(spark, f"{folder}/t")
    assert sum(map(sum, files.values())) == 200_000
    assert len(files["hot"]) > 3 and max(files["hot"]) < 66_667 / 2


def test_hot_partition_without_adaptive_execution(spark, folder):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rebuild_partitioned(hot(spark), f"{folder}/t", "p")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    files = files_of(spark, f"{folder}/t")
    assert sum(map(sum, files.values())) == 200_000
    assert len(files["hot"]) > 3 and max(files["hot"]) < 66_667 / 2


def test_hot_sort_key_is_spread(spark):
    ordered = order_by(hot(spark), "p", tie_break=("id",))
    sizes = ordered.groupBy(F.spark_partition_id()).count()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        counts = [r["count"] for r in sizes.collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert max(counts) < 200_000 / 4


def test_first_match_of_a_hot_key(spark):
    found = first_match(hot(spark), "p", F.col("id") >= 5, "id", "pad")
    rows = {r.p: r.id for r in found.collect()}
    assert rows["hot"] == 6 and rows["v5"] == 5 and len(rows) == 9


def test_rebalance_is_used(spark, tiny):
    assert "REBALANCE" in plan(cluster_by(load(spark, tiny, "events"), "event_type"))


def test_spread_bounds_the_rows_of_a_task(spark, monkeypatch):
    """The tasks grow with the table, so that what each makes of its keys does not."""
    monkeypatch.setattr("lakejobs.sources.tables.ROWS_PER_TASK", 1_000)
    rows = spread(spark.range(0, 20_000, 1, 8))
    assert rows.count() == 20_000
    assert max(rows.groupBy(F.spark_partition_id()).count().toDF("p", "n").toPandas()["n"]) <= 1_010
    assert spread(spark.range(0, 900, 1, 8)).rdd.getNumPartitions() == 8
