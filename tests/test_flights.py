"""The generated table against the values its rules imply."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from lakejobs.plans.named import run_named, write_named
from lakejobs.sources.flights import add_digit, flights, numbers
from lakejobs.sources.tables import read_table, rebuild_partitioned

from plan_text import plan

QUERIES = {
    "july": "SELECT flight_num, dest FROM flights WHERE flight_month = '2026-07'",
    "far": "SELECT flight_id, dest, distance FROM flights "
    "WHERE distance >= 3200 AND dest = 'MIA'",
    "by_carrier": "SELECT carrier_code, min(dep_delay) AS best, sum(dep_delay) / count(*) AS mean "
    "FROM flights GROUP BY carrier_code",
    "nothing": "SELECT flight_id FROM flights WHERE flight_month = '2027-01'",
}


# By the rules of the generated columns: destination 3 of 4, 200 + 3 r modulo 4800.
FAR = 12 * sum(r % 4 == 3 and 200 + 3 * r % 4800 >= 3200 for r in range(10_000))


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("flights")) + "/t"
    rows = flights(numbers(spark, 10_000, 1))
    rebuild_partitioned(rows, path, "flight_month", clustered=True)
    return read_table(spark, path, rows.schema)


def test_rows_and_ranges(table):
    row = table.agg(
        F.count("*"),
        F.countDistinct("flight_id"),
        F.min("dep_delay"),
        F.max("dep_delay"),
        F.countDistinct("dep_delay"),
        F.min("flight_num"),
        F.max("flight_num"),
        F.countDistinct("flight_num"),
        F.min("distance"),
        F.max("distance"),
        F.countDistinct("distance"),
    ).first()
    assert tuple(row) == (120_000, 120_000, -15, 118, 20, 1000, 9999, 9000, 200, 4997, 1600)


def test_month(table):
    month = table.filter("flight_month = '2026-03'")
    assert tuple(month.agg(F.count("*"), F.sum("flight_id")).first()) == (10_000, 249_995_000)


def test_counts_per_group(table):
    def counts(column):
        return {r[0]: r[1] for r in table.groupBy(column).count().collect()}

    assert counts("dest") == dict.fromkeys(["LAX", "MIA", "SEA", "SFO"], 30_000)
    assert counts("origin") == dict.fromkeys(["ATL", "DEN", "DFW", "JFK", "ORD"], 24_000)
    assert set(counts("flight_month").values()) == {10_000}


def test_group_per_carrier(table):
    stats = run_named(table, "flights", QUERIES).outputs["by_carrier"].collect()
    assert {r.carrier_code: (r.best, r.mean) for r in stats} == {
        "AA": (-15, 41.0),
        "AS": (-8, 48.0),
        "B6": (-15, 41.0),
        "DL": (-8, 48.0),
        "F9": (6, 62.0),
        "NK": (-1, 55.0),
        "UA": (-1, 55.0),
        "WN": (6, 62.0),
    }


def test_scan_report(table, spark, folder):
    report = write_named(run_named(table, "demo.flights", QUERIES), folder)
    rows = {r.name: r for r in report.collect()}
    assert {n: r.record_count for n, r in rows.items()} == {
        "july": 10_000,
        "far": FAR,
        "by_carrier": 8,
        "nothing": 0,
    }
    pruned = rows["july"]
    assert (pruned.files_total, pruned.files_read, pruned.files_skipped) == (12, 1, 11)
    assert (pruned.partitions_total, pruned.partitions_read) == (12, 1)
    assert (pruned.namespace, pruned.table) == ("demo", "flights")
    assert "(flight_month = 2026-07)" in pruned.partition_filters
    far = rows["far"]
    assert "GreaterThanOrEqual(distance,3200)" in far.pushed_filters
    assert far.read_columns == ["flight_id", "dest", "distance"]
    assert far.files_skipped == 0
    assert rows["nothing"].files_read == 0
    assert spark.read.json(f"{folder}/far").count() == FAR


def test_report_without_output(table):
    report = write_named(run_named(table, "flights", {"july": QUERIES["july"]}), None)
    assert report.first().record_count == 10_000
    assert report.first().namespace is None


def test_report_of_a_query_that_reads_nothing(table):
    never = {"never": "SELECT flight_id FROM flights WHERE 1 = 0"}
    row = write_named(run_named(table, "flights", never), None).first()
    assert (row.record_count, row.files_total, row.files_read) == (0, 12, 0)


def test_report_with_a_sub_query(table):
    sub = "SELECT flight_id FROM flights WHERE flight_month = '2026-01' AND dep_delay = "
    sub += "(SELECT max(dep_delay) FROM flights WHERE flight_month = '2026-02')"
    row = write_named(run_named(table, "flights", {"sub": sub}), None).first()
    assert row.record_count > 0
    assert (row.files_total, row.files_read) == (24, 2)


def test_report_of_a_cached_table_leaves_files_open(table):
    cached = table.filter("flight_month = '2026-01'").cache()
    query = {"some": "SELECT flight_id FROM flights WHERE dep_delay > 45"}
    named = run_named(cached, "flights", query)
    assert "InMemoryTableScan" in plan(named.outputs["some"])
    assert "InMemoryTableScan" in plan(cached)
    row = write_named(named, None).first()
    cached.unpersist()
    assert row.record_count > 0 and row.files_read is None and row.pushed_filters is None


def test_report_of_a_plug_in_source(spark, table, folder):
    table.filter("flight_month = '2026-01'").write.parquet(f"{folder}/t")
    key = "spark.sql.sources.useV1SourceList"
    before = spark.conf.get(key)
    spark.conf.set(key, "")
    try:
        source = spark.read.parquet(f"{folder}/t")
        named = run_named(source, "demo.flights", {"far": QUERIES["far"]})
        row = write_named(named, None).first()
    finally:
        spark.conf.set(key, before)
    assert "BatchScan" in plan(source)
    assert row.record_count == FAR // 12
    assert row.read_columns == ["flight_id", "dest", "distance"]
    assert "GreaterThanOrEqual(distance,3200)" in row.pushed_filters
    assert row.files_read is None and row.files_total is None and row.partitions_read is None


def test_report_of_two_scans(table):
    both = "SELECT flight_id FROM flights WHERE flight_month = '2026-01' UNION ALL "
    both += "SELECT flight_id FROM flights WHERE flight_month = '2026-02'"
    row = write_named(run_named(table, "flights", {"both": both}), None).first()
    assert (row.record_count, row.files_total, row.files_read) == (20_000, 24, 2)


def test_failed_query_does_not_stop_the_others(table):
    bad = {"bad": "SELECT no_such_column FROM flights", "worse": "SELEC 1"}
    named = run_named(table, "flights", {**bad, "july": QUERIES["july"]})
    assert list(named.outputs) == ["july"]
    failure = {r.name: r for r in named.failure().collect()}
    assert failure.keys() == bad.keys()
    assert "no_such_column" in failure["bad"].message


def test_output_that_fails_while_running(table, folder):
    broken = "SELECT raise_error(concat('broken ', dest)) AS x FROM flights WHERE distance > 4000"
    named = run_named(table, "flights", {"broken": broken, "july": QUERIES["july"]})
    report = write_named(named, folder).collect()
    assert [(r.name, r.record_count) for r in report] == [("july", 10_000)]
    (failure,) = named.failure().collect()
    assert failure.name == "broken" and "broken " in failure.message


def test_one_name_in_many_threads(spark):
    def total(k):
        frame = spark.range(k, k + 1).withColumnRenamed("id", "x")
        return run_named(frame, "t", {"q": "SELECT sum(x) AS s FROM t"}).outputs["q"].first().s

    with ThreadPoolExecutor(8) as pool:
        assert list(pool.map(total, range(24))) == list(range(24))


def test_rebuild_leaves_nothing_behind(spark, folder):
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        for keys in ("xy", "x"):
            rows = spark.createDataFrame([(1, k) for k in keys], "a INT, p STRING")
            rebuild_partitioned(rows, f"{folder}/t", "p")
        assert [r.p for r in spark.read.parquet(f"{folder}/t").collect()] == ["x"]
    finally:
        spark.conf.unset("spark.sql.sources.partitionOverwriteMode")


def test_earlier_view_comes_back(table, spark):
    spark.range(3).createOrReplaceTempView("flights")
    run_named(table, "flights", QUERIES)
    assert spark.table("flights").count() == 3
    spark.catalog.dropTempView("flights")
    run_named(table, "flights", QUERIES)
    assert not spark.catalog.tableExists("flights")


def test_month_filter_keeps_one_branch_and_no_shuffle(spark):
    rows = flights(numbers(spark, 100))
    assert "Exchange" not in plan(rows)
    assert plan(rows).count("Range (") == 12
    assert plan(rows.filter("flight_month = '2026-03'")).count("Range (") == 1


def test_months_from_files_take_one_scan(spark, folder):
    numbers(spark, 100).write.parquet(f"{folder}/n")
    rows = flights(spark.read.parquet(f"{folder}/n"), read_once=True)
    assert plan(rows).count("FileScan") == 1 and "Exchange" not in plan(rows)
    assert sorted(rows.collect()) == sorted(flights(numbers(spark, 100)).collect())
    assert rows.dtypes == flights(numbers(spark, 100)).dtypes


def test_digits_are_not_joined(spark):
    digits = add_digit(add_digit(numbers(spark, 10), "r"), "r")
    assert "Join" not in plan(digits) and "Exchange" not in plan(digits)
    assert sorted(r.r for r in digits.collect()) == list(range(1000))
