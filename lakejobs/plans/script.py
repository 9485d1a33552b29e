"""Running a SQL script and seeding the demo tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakejobs.functions.text import cut, first_line, split_statements
from lakejobs.sources.flights import (
    AIRLINES_COLUMNS,
    ROWS_PER_MONTH,
    airlines,
    flights,
    numbers,
)
from lakejobs.sources.tables import (
    append_rows,
    create_namespace,
    create_table,
    read_table,
    rebuild_partitioned,
)

HEAD_LENGTH = 80


def _run(text: DataFrame) -> list[str]:
    """Run the statements of a one-row frame with a column ``script``."""
    statements = (
        split_statements(text, "script")
        .select("statement", cut(first_line(F.col("statement")), HEAD_LENGTH).alias("head"))
        .orderBy("pos")
        .collect()
    )
    for row in statements:
        text.sparkSession.sql(row.statement)
    return [row.head for row in statements]


def run_script(spark: SparkSession, script: str) -> list[str]:
    """Run the statements of a SQL script in order. Returns the head of each:
    its first line, at most 80 characters."""
    return _run(spark.createDataFrame([(script,)], "script STRING"))


def run_file(spark: SparkSession, path: str) -> list[str]:
    """Run the SQL script at ``path``, on any file system Spark reads."""
    return _run(spark.read.text(path, wholetext=True).withColumnRenamed("value", "script"))


def count_rows(spark: SparkSession, table: str) -> DataFrame:
    """The row count, to check a table after it was written."""
    return read_table(spark, table).agg(F.count(F.lit(1)).alias("n"))


def seed_airlines(spark: SparkSession, namespace: str) -> DataFrame:
    """Create the table if absent and append its rows; running this twice
    doubles them."""
    table = f"{namespace}.airlines"
    create_namespace(spark, namespace)
    create_table(spark, table, AIRLINES_COLUMNS)
    append_rows(airlines(spark), table)
    return count_rows(spark, table)


def seed_flights(
    spark: SparkSession, namespace: str, months: int = 12, rows_per_month: int = ROWS_PER_MONTH
) -> DataFrame:
    """Rebuild the table partitioned by month; running this twice changes
    nothing."""
    table = f"{namespace}.flights"
    create_namespace(spark, namespace)
    rows = flights(numbers(spark, rows_per_month), months, rows_per_month)
    rebuild_partitioned(rows, table, "flight_month", clustered=True)
    return count_rows(spark, table)
