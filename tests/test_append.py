import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, ShortType, StringType, StructType

from lakejobs.functions.values import convert
from lakejobs.operators.append import (
    align,
    append_by_name,
    append_verified,
    append_with_rejects,
    fingerprint,
    judge,
)
from lakejobs.plans.report import measured
from lakejobs.sources.jsonrows import read_records
from lakejobs.sources.tables import append_rows, create_table, partition_columns
from lakejobs.sources.tables import read_table

SINK = StructType().add("id", "integer").add("msg", "string")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_other_column_order(spark, folder):
    table = f"{folder}/t"
    append_by_name(spark.createDataFrame([("a", 1)], "msg STRING, id INT"), table, SINK)
    append_by_name(spark.createDataFrame([(2, "b")], "id BIGINT, msg STRING"), table, SINK)
    assert rows(read_table(spark, table)) == [(1, "a"), (2, "b")]
    assert read_table(spark, table).dtypes == [("id", "int"), ("msg", "string")]


def test_overflow_fails_a_plain_append(spark, folder):
    big = spark.createDataFrame([(2**40, "a")], "id BIGINT, msg STRING")
    with pytest.raises(Exception, match="CAST_OVERFLOW"):
        append_by_name(big, f"{folder}/t", SINK)


def test_extra_column(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "id INT, msg STRING, more DOUBLE")
    with pytest.raises(ValueError, match="more"):
        align(df, SINK)
    assert rows(align(df, SINK, extra="drop")) == [(1, "a")]


def test_missing_column(spark):
    df = spark.createDataFrame([(1,)], "id INT")
    with pytest.raises(ValueError, match="msg"):
        align(df, SINK)
    assert rows(align(df, SINK, missing="fill_null")) == [(1, None)]
    with pytest.raises(ValueError, match="msg"):
        judge(df, SINK)


def test_rejects_keep_the_raw_row_and_every_reason(spark, folder):
    df = spark.createDataFrame(
        [("1", "a"), ("x", "b"), ("99999999999", "bad"), (None, "c"), ("2", None)],
        "id STRING, msg STRING",
    )
    rules = {"bad message": lambda c: c["msg"] != "bad", "negative": lambda c: c["id"] >= 0}
    seen = append_with_rejects(df, f"{folder}/t", SINK, f"{folder}/r", rules)
    assert seen == (5, 2)
    assert rows(read_table(spark, f"{folder}/t")) == [(1, "a"), (2, None), (None, "c")]
    assert rows(read_table(spark, f"{folder}/r")) == [
        ("99999999999", "bad", "id: not int; bad message"),
        ("x", "b", "id: not int"),
    ]


def test_verify_counts_and_growth(spark, folder):
    df = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], "id STRING, msg STRING")
    target = (f"{folder}/t", SINK, f"{folder}/r")
    first = append_verified(df, *target).first()
    assert tuple(first) == (3, 0, 3, 0, 3, True)
    assert tuple(append_verified(df, *target).first()) == (3, 3, 3, 0, 6, True)
    with_bad = df.union(spark.createDataFrame([("x", "d")], df.schema))
    assert tuple(append_verified(with_bad, *target).first()) == (4, 6, 3, 1, 9, True)


def test_verify_notices_a_missing_row(spark, folder, monkeypatch):
    import lakejobs.operators.append as module

    def losing(df, table):
        df.limit(1).write.mode("append").parquet(table)

    monkeypatch.setattr(module, "append_rows", losing)
    df = spark.createDataFrame([("1", "a"), ("2", "b")], "id STRING, msg STRING")
    row = append_verified(df, f"{folder}/t", SINK, f"{folder}/r").first()
    assert not row.ok


def test_append_to_catalog_table(spark, folder):
    spark.sql("CREATE DATABASE IF NOT EXISTS appenddb")
    spark.sql("DROP TABLE IF EXISTS appenddb.sink")
    spark.sql("CREATE TABLE appenddb.sink (id INT, msg STRING) USING parquet")
    df = spark.createDataFrame([("a", "1"), ("b", "x")], "msg STRING, id STRING")
    row = append_verified(df, "appenddb.sink", SINK, f"{folder}/r").first()
    assert tuple(row) == (2, 0, 1, 1, 1, True)
    assert rows(spark.table("appenddb.sink")) == [(1, "a")]
    assert rows(read_table(spark, f"{folder}/r")) == [("x", "b", "id: not int")]


def test_records_from_json_files(spark, folder):
    import os

    os.makedirs(f"{folder}/in")
    with open(f"{folder}/in/array.json", "w") as f:
        f.write('[{"id":1,"msg":"a","source":"s"},\n {"id":2,"msg":"b","source":"s"}]')
    with open(f"{folder}/in/one.json", "w") as f:
        f.write('{"id":3,\n "msg":"c",\n "source":"s"}')
    records = read_records(spark, f"{folder}/in", one_document_per_file=True)
    assert records.dtypes == [("id", "bigint"), ("msg", "string"), ("source", "string")]
    append_by_name(records, f"{folder}/t", SINK, extra="drop")
    assert rows(read_table(spark, f"{folder}/t")) == [(1, "a"), (2, "b"), (3, "c")]


def test_append_keeps_the_partitions_of_a_folder(spark, folder):
    first = spark.createDataFrame([("A", "p1", "B")], "a STRING, p STRING, b STRING")
    append_rows(first, f"{folder}/t", partition_by=["p"])
    append_by_name(first.select("b", "p", "a"), f"{folder}/t", first.schema)
    other = spark.createDataFrame([("p2", "D", "C")], "p STRING, b STRING, a STRING")
    append_by_name(other, f"{folder}/t", first.schema)
    found = sorted(map(tuple, read_table(spark, f"{folder}/t").select("a", "p", "b").collect()))
    assert found == [("A", "p1", "B"), ("A", "p1", "B"), ("C", "p2", "D")]
    assert partition_columns(spark, f"{folder}/t") == ["p"]
    assert partition_columns(spark, f"{folder}/none") == []
    with pytest.raises(ValueError, match="partitioned by"):
        append_rows(first, f"{folder}/t", partition_by=["a"])
    with pytest.raises(ValueError, match="not all in the rows"):
        append_rows(first.drop("p"), f"{folder}/t")


def test_append_to_a_partitioned_catalog_table_goes_by_name(spark):
    create_table(spark, "by_name_p", "a STRING, p STRING, b STRING", "p")
    rows = spark.createDataFrame([("A", "P", "B")], "a STRING, p STRING, b STRING")
    append_by_name(rows, "by_name_p", rows.schema)
    append_rows(rows.select("p", "b", "a"), "by_name_p")
    found = spark.table("by_name_p").select("a", "p", "b").collect()
    spark.sql("DROP TABLE by_name_p")
    assert [tuple(r) for r in found] == [("A", "P", "B")] * 2


NUMBER_LIKE = st.one_of(
    st.text(alphabet="0123456789+-. \t\n\x00\x1f\x7fex ٣" + "\x85\u2028\u2029", max_size=24),
    st.integers(-(2**70), 2**70).map(str),
    st.integers(-(2**17), 2**17).map(lambda n: f" {n}\n"),
    st.integers(0, 99).map(lambda n: str(n).zfill(30)),
)


@settings(max_examples=15, deadline=None)
@given(texts=st.lists(st.one_of(st.none(), NUMBER_LIKE), min_size=1, max_size=60))
def test_convert_text_equals_try_cast(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    t = F.col("t")
    for kind in (ShortType(), IntegerType(), LongType()):
        got = df.select("t", convert(t, StringType(), kind).alias("a"), t.try_cast(kind).alias("b"))
        for row in got.collect():
            assert row.a == row.b, row


def test_convert_numbers_equals_try_cast(spark):
    edge = [0, -1, 2**31 - 1, 2**31, -(2**31), -(2**31) - 1, 2**63 - 1, -(2**63), None]
    df = spark.createDataFrame([(n,) for n in edge], "n BIGINT")
    n = F.col("n")
    for kind in (ShortType(), IntegerType(), LongType()):
        got = df.select(convert(n, LongType(), kind).alias("a"), n.try_cast(kind).alias("b"))
        assert got.filter("NOT (a <=> b)").count() == 0


def test_input_that_changes_is_noticed(spark, folder, monkeypatch):
    import lakejobs.operators.append as module

    df = spark.createDataFrame([("1", "a"), ("x", "b")], "id STRING, msg STRING")
    both = [judge(df, SINK), judge(df.limit(1), SINK)]

    class Changing:
        """A judged input that has fewer rows when it is read again."""

        def observe(self, *metrics):
            return both.pop(0).observe(*metrics)

    monkeypatch.setattr(module, "judge", lambda *_: Changing())
    with pytest.raises(RuntimeError, match="changed"):
        append_with_rejects(df, f"{folder}/t", SINK, f"{folder}/r")


def test_a_swapped_value_is_not_verified(spark, folder, monkeypatch):
    """The counts are right, the values are not: what was stored differs in one cell."""
    import lakejobs.operators.append as module

    df = spark.createDataFrame([("1", "a"), ("2", "b"), ("x", "c")], "id string, msg string")
    real = module.append_rows

    def swapped(rows, table, *more):
        if "reject_reason" not in rows.columns:
            rows = rows.withColumn("msg", F.when(F.col("id") == 2, F.lit("B")).otherwise(F.col("msg")))
        real(rows, table, *more)

    args = (df, f"{folder}/t", SINK, f"{folder}/r")
    assert module.append_verified(*args).first().ok
    monkeypatch.setattr(module, "append_rows", swapped)
    row = module.append_verified(*args).first()
    assert (row.written, row.rejected, row.rows_after, row.ok) == (2, 1, 4, False)
    monkeypatch.setattr(module, "append_rows", real)
    assert module.append_verified(*args).first().ok


def test_fingerprints_of_parts_add_up(spark):
    df = spark.range(0, 1000).selectExpr("id", "IF(id % 3 = 0, NULL, id) AS v", "map('k', id) AS m")
    of = lambda rows: rows.agg(*fingerprint(rows.schema)).first()
    whole, low, high = of(df), of(df.filter("id < 400")), of(df.filter("id >= 400").orderBy(F.desc("id")))
    assert tuple(whole) == tuple(a + b for a, b in zip(low, high))
    assert tuple(whole) != tuple(of(df.unionAll(df.limit(1))))
    assert tuple(of(df.selectExpr("v AS id", "id AS v", "m"))) != tuple(whole)
    assert tuple(of(df.filter("id < 0"))) == (0, 0)


def test_verification_reads_the_new_files_only(spark, folder):
    from lakejobs.operators.append import _newest, _since

    big = spark.range(0, 50_000).selectExpr("CAST(id AS INT) AS id", "'m' AS msg")
    big.write.parquet(f"{folder}/t")
    _, newest = _newest(spark.read.parquet(f"{folder}/t"))
    time.sleep(0.05)
    spark.createDataFrame([(1, "m")], SINK).write.mode("append").parquet(f"{folder}/t")
    later = _newest(spark.read.parquet(f"{folder}/t"))[1]
    assert later > newest
    with measured(spark) as seen:
        assert _since(spark.read.parquet(f"{folder}/t"), later).agg(F.count("msg")).first()[0] == 1
    assert seen.figures().rows_read == 1
