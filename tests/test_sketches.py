"""Sketched profiles against exact values, within the errors that are stated."""

from pyspark.sql import functions as F

from lakejobs.plans.profile import profile
from lakejobs.plans.sketches import column_sketches, estimates, merged

from plan_text import plan


def numbers(spark, n):
    return spark.range(0, n, 1, 8).selectExpr(
        "id % 3 AS part", "id AS k", "IF(id % 10 = 0, NULL, CAST(id % 1000 AS DOUBLE) * id) AS v", "md5(CAST(id AS STRING)) AS s",
        "DATE'2024-01-01' + CAST(id % 365 AS INT) AS d", "array(id) AS a", "CAST(NULL AS INT) AS none",
    )


def test_merged_sketches_are_near_exact_values(spark, folder):
    df = numbers(spark, 90_000)
    column_sketches(df.filter("part < 2"), ["part"]).write.parquet(f"{folder}/s")
    # A further partition is added without reading the others.
    column_sketches(df.filter("part = 2"), ["part"]).write.mode("append").parquet(f"{folder}/s")
    got = {r["column"]: r for r in estimates(merged(spark.read.parquet(f"{folder}/s"))).collect()}
    exact = df.agg(*[F.count_distinct(c).alias(c) for c in ("k", "v", "s", "d")]).first()
    for c in ("k", "v", "s", "d"):
        assert got[c].rows == 90_000 and abs(got[c].distinct_values - exact[c]) <= 0.03 * exact[c]
    assert got["v"].nulls == 9_000 and got["none"].nulls == 90_000 and got["none"].quantiles is None
    assert got["a"].distinct_values is None and got["s"].quantiles is None
    low, q1, middle, q3, high = got["v"].quantiles
    bounds = df.agg(F.min("v"), F.max("v")).first()
    assert (low, high) == tuple(bounds)
    for rank, value in ((0.25, q1), (0.5, middle), (0.75, q3)):
        share = df.filter(F.col("v") <= value).count() / 81_000
        assert abs(share - rank) < 0.02


def test_merging_equals_sketching_at_once(spark):
    df = numbers(spark, 20_000)
    whole = {r["column"]: r for r in estimates(column_sketches(df.drop("part"))).collect()}
    parts = {r["column"]: r for r in estimates(merged(column_sketches(df, ["part"]))).collect()}
    for c in ("k", "s", "d"):
        assert abs(whole[c].distinct_values - parts[c].distinct_values) <= 0.02 * whole[c].distinct_values
    assert whole["k"].rows == parts["k"].rows == 20_000


def test_values_are_reduced_before_the_shuffle(spark):
    shown = plan(column_sketches(numbers(spark, 1000), ["part"]))
    assert shown.count("Exchange") == 1 and "partial_hll_sketch_agg" in shown[shown.index("Exchange") :]


def test_integer_bounds_are_exact(spark):
    df = spark.createDataFrame([(2**53 + 1,), (-(2**62) - 1,)], "k long")
    row = profile(df, "t", integers=True).first()
    assert (row.min_integer, row.max_integer) == (-(2**62) - 1, 2**53 + 1)


def test_no_rows(spark):
    rows = estimates(column_sketches(numbers(spark, 0))).collect()
    assert {(r.rows, r.nulls, r.quantiles) for r in rows} == {(0, 0, None)}
