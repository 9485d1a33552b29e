"""Clustered tables: the key, the layout, and what a filter reads of it."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lakejobs.plans.profile import file_statistics
from lakejobs.plans.report import measured
from lakejobs.sources.clustered import interleaved, rank_bounds, with_rank, write_clustered

SMALL = {"parquet.block.row.count.limit": "250", "parquet.page.row.count.limit": "250"}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def rows_read(spark, df):
    with measured(spark) as seen:
        df.write.format("noop").mode("overwrite").save()
    return seen.figures().rows_read


@pytest.mark.parametrize("bits", [1, 3, 8])
def test_ranks_count_the_bounds(spark, bits):
    rng = random.Random(bits)
    bounds = sorted(rng.choice([1.5, 2.0, 7.25, 9.0, 30.0]) for _ in range(2**bits - 1))
    values = [None, -1.0, *bounds, 8.0, 31.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r.k for r in with_rank(df, "k", F.col("v"), bounds, bits).collect()]
    assert got == [0 if v is None else sum(b <= v for b in bounds) for v in values]


def test_bits_are_interleaved(spark):
    rng = random.Random(1)
    cases = [[rng.randrange(256) for _ in range(3)] for _ in range(100)]
    df = spark.createDataFrame(cases, "a int, b int, c int")
    got = [r[0] for r in df.select(interleaved([F.col(c) for c in "abc"])).collect()]
    for (a, b, c), key in zip(cases, got):
        assert key == int("".join(x + y + z for x, y, z in zip(*(f"{n:08b}" for n in (a, b, c)))), 2)
    with pytest.raises(ValueError):
        interleaved([F.col(c) for c in "abcdefgh"])


@pytest.fixture(scope="module")
def laid_out(spark, tmp_path_factory):
    """Two independent columns, a key in no order, nulls and a text."""
    path = f"{tmp_path_factory.mktemp('clustered')}/t"
    df = spark.range(0, 40_000, 1, 4).select(
        F.pmod(F.col("id") * 7919, F.lit(40_000)).alias("a"),
        F.when(F.col("id") % 50 != 0, F.pmod(F.col("id") * 104_729, F.lit(39_989))).alias("b"),
        F.md5(F.col("id").cast("string")).alias("s"),
        F.xxhash64("id").alias("k"),
    )
    write_clustered(df, path, ["a", "b"], bloom={"k": 1000}, options=SMALL)
    return path, df


@pytest.mark.parametrize(
    ("condition", "most"),
    [("a between 1000 and 1400", 9_000), ("b between 30000 and 30400", 9_000), ("a between 1000 and 3000 and b between 30000 and 32000", 4_000), ("a < 0", 0)],
)
def test_a_filter_on_either_column_reads_few_rows(spark, laid_out, condition, most):
    path, df = laid_out
    found = spark.read.parquet(path).filter(condition)
    assert rows(found) == rows(df.filter(condition))
    assert rows_read(spark, found) <= most


def test_a_lookup_by_bloom_filter_reads_few_rows(spark, laid_out):
    path, df = laid_out
    key = df.filter("a = 17").first()["k"]
    found = spark.read.parquet(path).filter(F.col("k") == key)
    assert rows(found) == rows(df.filter(F.col("k") == key))
    # One row group, and those that share the bits of its key.
    assert rows_read(spark, found) <= 5_000


def test_nothing_is_lost(spark, laid_out):
    path, df = laid_out
    assert rows(spark.read.parquet(path)) == rows(df)
    assert spark.read.parquet(path).columns == df.columns


def test_a_hot_value_and_equal_rows_are_spread(spark, folder):
    df = spark.range(0, 60_000, 1, 8).select(F.when(F.col("id") % 3 > 0, 5).otherwise(F.col("id")).alias("a"), F.lit("x").alias("b"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        write_clustered(df, f"{folder}/t", ["a", "b"])
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [r.rows for r in file_statistics(spark.read.parquet(f"{folder}/t"), ["a"]).collect()]
    assert sum(sizes) == 60_000 and max(sizes) < 15_000


@pytest.mark.parametrize(
    "column",
    ["CAST(id AS STRING)", "DATE'2024-01-01' + CAST(id AS INT)", "TIMESTAMP_NTZ'2024-01-01 00:00:00'", "CAST(id AS DECIMAL(20,2))", "id % 2 = 0", "CAST(NULL AS INT)", "CASE WHEN id = 3 THEN double('NaN') ELSE double('Infinity') END"],
)
def test_columns_of_any_type(spark, folder, column):
    df = spark.range(0, 300).selectExpr(f"{column} AS c", "id AS d")
    write_clustered(df, f"{folder}/t", ["c", "d"])
    # As text, in which not-a-number equals itself.
    assert repr(rows(spark.read.parquet(f"{folder}/t"))) == repr(rows(df))


def test_text_is_ordered_by_its_first_bytes(spark):
    texts = ["", "a", "ab", "abcdefghi", "b", "é", "日本語"]
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    bounds = rank_bounds(df, ["c"], 3)["c"]
    assert bounds == sorted(bounds) and len(set(bounds)) > 4


def test_partitions_and_clashing_names(spark, folder):
    df = spark.range(0, 100).selectExpr("id", "id % 3 AS p")
    write_clustered(df, f"{folder}/t", ["id"], partition_by=["p"])
    assert rows(spark.read.parquet(f"{folder}/t")) == rows(df)
    with pytest.raises(ValueError):
        write_clustered(df.withColumnRenamed("p", "_spread"), f"{folder}/u", ["id"])
    with pytest.raises(ValueError):
        write_clustered(df.withColumn("m", F.create_map("id", "p")), f"{folder}/u", ["m"])
    write_clustered(df.filter("id < 0"), f"{folder}/e", ["id"])
    assert spark.read.parquet(f"{folder}/e").count() == 0


def test_file_statistics(spark, folder):
    spark.range(0, 1200, 1, 12).selectExpr("id AS a", "IF(id < 100, NULL, id / 10) AS b").write.parquet(f"{folder}/t")
    files = file_statistics(spark.read.parquet(f"{folder}/t"), ["a", "b"]).orderBy("a__min").collect()
    assert [(z.rows, z.a__min, z.a__max) for z in files] == [(100, 100 * i, 100 * i + 99) for i in range(12)]
    assert (files[0].b__min, files[0].b__max, files[0].b__nulls) == (None, None, 100)


def test_days_keep_their_type(spark, folder):
    df = spark.createDataFrame([(dt.date(2024, 1, d), d) for d in range(1, 29)], "day date, n int")
    write_clustered(df, f"{folder}/t", ["day", "n"])
    assert rows(spark.read.parquet(f"{folder}/t").filter("day = '2024-01-05'")) == [(dt.date(2024, 1, 5), 5)]


def test_figures_are_of_the_runs_inside_only(spark, folder):
    spark.range(0, 1000, 1, 2).write.parquet(f"{folder}/t")
    table = spark.read.parquet(f"{folder}/t")
    noop = lambda df: df.write.format("noop").mode("overwrite").save()
    noop(table)
    with measured(spark) as seen:
        noop(table)
        spark.sparkContext.setLocalProperty("spark.job.description", "of another thread")
        noop(table)
        spark.sparkContext.setLocalProperty("spark.job.description", seen.mark)
        noop(table.filter("id < 0"))
    noop(table)
    figures = seen.figures()
    assert (figures.scans, figures.rows_read) == (2, 1000)
    assert spark.sparkContext.getLocalProperty("spark.job.description") is None
