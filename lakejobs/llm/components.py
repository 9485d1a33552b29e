"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakejobs.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of the links (a, b); the label is the smallest node.

    Each round links neighbours to the smallest of a neighbourhood, by minima that
    are reduced before the shuffle and joined back, so no neighbourhood is gathered.
    Rounds are stored. Self links and nulls are left out; no links give no rows.
    """

    def ordered(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = written(ordered(links), "edges")
    last, now = None, state(edges)
    while last != now and now[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        edges = written(ordered(large), "large-star")
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        small = edges.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        edges = written(ordered(small), "small-star")
        last, now = now, state(edges)
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("label", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
