"""Demo tables with fixed contents, and a row-number helper that scales."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakejobs.functions.values import pick_by_remainder

# The demo tables must hold exactly these.
CARRIERS = ["AA", "DL", "UA", "WN", "B6", "AS", "NK", "F9"]
ORIGINS = ["JFK", "ATL", "ORD", "DFW", "DEN"]
DESTINATIONS = ["LAX", "SEA", "SFO", "MIA"]
YEAR = 2026
ROWS_PER_MONTH = 10_000
AIRLINES_COLUMNS = "code STRING, description STRING, origin STRING, dest STRING, year_id INT"
AIRLINES = [
    ("AA", "American Airlines", "JFK", "LAX", YEAR),
    ("DL", "Delta Air Lines", "ATL", "SEA", YEAR),
    ("UA", "United Airlines", "ORD", "SFO", YEAR),
]


def airlines(spark: SparkSession) -> DataFrame:
    """The three literal rows."""
    return spark.createDataFrame(AIRLINES, AIRLINES_COLUMNS)


def numbers(spark: SparkSession, n: int, partitions: int | None = None) -> DataFrame:
    """``r`` = 0 .. n-1, made in ``partitions`` tasks."""
    return spark.range(0, n, 1, partitions).toDF("r")


def add_digit(df: DataFrame, column: str) -> DataFrame:
    """Ten rows for each row: the number with each last digit put after it.

    This is the product with the digits 0..9. The digits are an array in the
    row, so nothing is joined or shuffled.
    """
    digits = F.explode(F.sequence(F.lit(0), F.lit(9)))
    return df.select("*", digits.alias("_digit")).select(
        *[c for c in df.columns if c != column],
        (F.col(column) * 10 + F.col("_digit")).alias(column),
    )


def flights(
    rows: DataFrame, months: int = 12, block: int = ROWS_PER_MONTH, read_once: bool = False
) -> DataFrame:
    """Flights for every number ``r`` of ``rows`` in each month.

    ``block`` is the distance between the ids of two months; it must exceed the
    largest ``r`` for ids to be unique. Months are the branches of a union, so
    a write by month needs no shuffle, and a filter on the month keeps a single
    branch of the plan. Where ``rows`` are read from files, ``read_once`` makes
    the months in the row instead: one scan, and still no shuffle.
    """
    r = F.col("r")
    every_month = rows.select(
        r,
        pick_by_remainder(r, CARRIERS).alias("carrier_code"),
        (F.pmod(r * 13, F.lit(9000)) + 1000).cast("int").alias("flight_num"),
        pick_by_remainder(r, ORIGINS).alias("origin"),
        pick_by_remainder(r, DESTINATIONS).alias("dest"),
        (F.pmod(r * 7, F.lit(140)) - 15).cast("int").alias("dep_delay"),
        (F.pmod(r * 3, F.lit(4800)) + 200).cast("int").alias("distance"),
    )
    if read_once:
        month = F.explode(F.sequence(F.lit(1), F.lit(months))).alias("month")
        return every_month.select("*", month).select(
            (F.col("r") + (F.col("month") - 1) * F.lit(block).cast("long")).alias("flight_id"),
            "carrier_code",
            "flight_num",
            "origin",
            "dest",
            F.format_string(f"{YEAR}-%02d", "month").alias("flight_month"),
            "dep_delay",
            "distance",
        )
    blocks = [
        every_month.selectExpr(
            f"CAST(r + {(month - 1) * block} AS BIGINT) AS flight_id",
            "carrier_code",
            "flight_num",
            "origin",
            "dest",
            f"'{YEAR}-{month:02d}' AS flight_month",
            "dep_delay",
            "distance",
        )
        for month in range(1, months + 1)
    ]
    return reduce(DataFrame.union, blocks)
