"""Namespaces, tables, scripts and seeds in the session catalog."""

import pytest
from pyspark.sql import functions as F

from lakejobs.plans.profile import namespaces, profile, storage, table_summary, tables
from lakejobs.plans.report import scan_facts
from lakejobs.plans.script import run_script, seed_airlines, seed_flights
from lakejobs.session import get_session, scratch_dir
from lakejobs.sources.jdbc import jdbc_reader, jdbc_writer
from lakejobs.sources.tables import create_namespace, create_table, read_table, replace_partitions

from plan_text import plan


def test_create_only_if_absent(spark):
    create_namespace(spark, "lifecycle")
    create_namespace(spark, "lifecycle")
    create_table(spark, "lifecycle.sink", "id INT, msg STRING")
    spark.sql("INSERT INTO lifecycle.sink VALUES (1, 'a')")
    create_table(spark, "lifecycle.sink", "other STRING")
    assert read_table(spark, "lifecycle.sink").collect() == [(1, "a")]
    create_table(spark, "lifecycle.parts", "id INT, day STRING", partition_by="day")
    assert "lifecycle" in [r.namespace for r in namespaces(spark).collect()]
    assert "lifecycle" in [r.namespace for r in namespaces(spark, "spark_catalog").collect()]
    assert {r.tableName for r in tables(spark, "lifecycle").collect()} == {"sink", "parts"}


def test_seeding_airlines_twice_doubles_them(spark):
    spark.sql("DROP TABLE IF EXISTS seeds.airlines")
    assert seed_airlines(spark, "seeds").first().n == 3
    assert seed_airlines(spark, "seeds").first().n == 6
    rows = spark.sql("SELECT * FROM seeds.airlines ORDER BY code").collect()
    assert [r.code for r in rows] == ["AA", "AA", "DL", "DL", "UA", "UA"]
    assert tuple(rows[0]) == ("AA", "American Airlines", "JFK", "LAX", 2026)


def test_seeding_flights_twice_changes_nothing(spark):
    assert seed_flights(spark, "seeds", rows_per_month=100).first().n == 1200
    assert seed_flights(spark, "seeds", rows_per_month=100).first().n == 1200
    month = spark.table("seeds.flights").filter("flight_month = '2026-03'")
    facts = scan_facts(month)
    assert facts.partitions == 1 and facts.files < len(spark.table("seeds.flights").inputFiles())
    assert dict(spark.table("seeds.flights").dtypes)["flight_month"] == "string"


def test_script(spark):
    script = """-- A comment; it ends here
    CREATE DATABASE IF NOT EXISTS scripts;
    DROP TABLE IF EXISTS scripts.t;
    CREATE TABLE scripts.t (id INT)
    -- columns above
    USING parquet;
    INSERT INTO scripts.t VALUES (1), (2);
    """
    with pytest.raises(Exception, match="PARSE_SYNTAX_ERROR"):
        run_script(spark, script)  # the separator in the comment cuts it
    heads = run_script(spark, script.replace(";", ",", 1))
    assert heads == [
        "CREATE DATABASE IF NOT EXISTS scripts",
        "DROP TABLE IF EXISTS scripts.t",
        "CREATE TABLE scripts.t (id INT)",
        "INSERT INTO scripts.t VALUES (1), (2)",
    ]
    assert spark.table("scripts.t").count() == 2


def test_table_summary(spark):
    create_namespace(spark, "summaries")
    create_table(spark, "summaries.t", "id INT")
    row = table_summary(spark, "summaries.t").first()
    assert row.table == "t" and row.namespace.endswith("summaries")
    assert row.location.endswith("summaries.db/t")
    assert row.metadata_keys == sorted(row.metadata_keys) and "columns" in row.metadata_keys


def test_profile_reads_the_table_once(spark):
    df = spark.createDataFrame(
        [(1, "b", None, [1]), (3, None, 2.5, None)],
        "`a key` INT, `it's` STRING, `x``y` DOUBLE, list ARRAY<INT>",
    )
    rows = {r.column: tuple(r)[2:] for r in profile(df, "o'table").collect()}
    assert rows == {
        "a key": (2, 0, 1.0, 3.0, None, None),
        "it's": (2, 1, None, None, "b", "b"),
        "x`y": (2, 1, 2.5, 2.5, None, None),
        "list": (2, 1, None, None, None, None),
    }


def test_storage(spark, folder):
    spark.range(0, 100, 1, 3).write.parquet(f"{folder}/t")
    row = storage(spark, f"{folder}/t", "t").first()
    assert (row.table, row.files) == ("t", 3) and row.bytes > 0
    assert "content" not in plan(storage(spark, f"{folder}/t", "t"))


def test_scratch_folders_are_new_and_shared(spark, monkeypatch):
    first, second = scratch_dir(spark, "x"), scratch_dir(spark, "x")
    assert first != second
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        assert first.startswith(root)

    class Cluster:
        class conf:
            @staticmethod
            def get(key, default=None):
                return {"spark.master": "yarn"}.get(key, default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(Cluster, "x")


def test_session_is_shared(spark):
    session = get_session("other")
    assert session.sparkContext is spark.sparkContext


def test_jdbc_options_without_a_database(spark):
    writer = jdbc_writer(spark.range(1), "jdbc:none:x", "t", batch_size=1, connections=4)
    with pytest.raises(Exception, match="[Nn]o suitable driver"):
        writer.save()
    reader = jdbc_reader(spark, "jdbc:none:x", "t", "id", (0, 100))
    with pytest.raises(Exception, match="[Nn]o suitable driver"):
        reader.load()


def test_a_month_that_runs_twice_is_not_doubled(spark, folder):
    first = spark.range(0, 90).selectExpr("id", "1 AS v", "CAST(id % 3 AS STRING) AS month")
    replace_partitions(first, f"{folder}/t", "month")
    again = first.filter("month = '1'").withColumn("v", F.lit(2))
    for _ in range(2):
        replace_partitions(again, f"{folder}/t")
    table = read_table(spark, f"{folder}/t", first.schema)
    assert {(r.month, r.v): r["count"] for r in table.groupBy("month", "v").count().collect()} == {("0", 1): 30, ("1", 2): 30, ("2", 1): 30}
    replace_partitions(again.filter("id < 0"), f"{folder}/t")
    assert table.count() == 90
    with pytest.raises(ValueError):
        replace_partitions(again.drop("month"), f"{folder}/t")
    with pytest.raises(ValueError):
        replace_partitions(again, f"{folder}/new")


def test_a_month_of_a_catalog_table(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS monthdb")
    spark.sql("DROP TABLE IF EXISTS monthdb.t")
    spark.sql("CREATE TABLE monthdb.t (id BIGINT, month STRING) USING parquet PARTITIONED BY (month)")
    rows = spark.range(0, 10).selectExpr("CAST(id % 2 AS STRING) AS month", "id")
    for part in (rows, rows.filter("month = '1'"), rows.filter("month = '1'")):
        replace_partitions(part, "monthdb.t")
    assert spark.table("monthdb.t").count() == 10
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"
    spark.sql("DROP TABLE monthdb.t")
