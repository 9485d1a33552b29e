"""Batched inserts into a table behind JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameReader, DataFrameWriter, SparkSession


def jdbc_writer(
    df: DataFrame,
    url: str,
    table: str,
    batch_size: int = 1000,
    connections: int = 8,
    **options: str,
) -> DataFrameWriter:
    """Writer that inserts ``df`` in batches over at most ``connections``
    connections; call ``.save()`` to run it. ``batch_size=1`` suits drivers
    without batch support.

    Each task commits its own transaction. A task that is lost after its commit
    runs again, so the target needs a key that refuses or merges a repeated row.
    """
    writer = df.write.format("jdbc").mode("append")
    return writer.options(
        url=url, dbtable=table, batchsize=batch_size, numPartitions=connections, **options
    )


def jdbc_reader(
    spark: SparkSession,
    url: str,
    table: str,
    split_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    connections: int = 8,
    **options: str,
) -> DataFrameReader:
    """Reader for the same table; with ``split_column`` and ``bounds`` the scan
    runs as ``connections`` parallel range queries. All rows are read, also
    those outside the bounds."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if split_column is None or bounds is None:
        return reader
    return reader.options(
        partitionColumn=split_column,
        lowerBound=bounds[0],
        upperBound=bounds[1],
        numPartitions=connections,
    )
