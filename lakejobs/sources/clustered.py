"""Clustered tables: rows laid out along a space-filling key of several columns.

The values of each column are ranked into ranges of about equal numbers of rows, and
the bits of the ranks are interleaved. Rows sorted by that key are close in every one
of the columns, so the smallest and largest values in the footers of the files are
close as well, and Spark's own reader leaves out partitions, row groups and pages for
a filter on any of them. Columns looked up by single values get Parquet bloom
filters. Nothing is kept beside the files, and reading is plain ``spark.read``.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    DataType,
    DateType,
    NumericType,
    StringType,
    TimestampNTZType,
    TimestampType,
)

#: Bits of the rank of a column, so at most 255 bounds per column come to the driver.
BITS = 8
#: The key's column while the rows are sorted.
KEY, SPREAD = "_cluster_key", "_spread"


def order_number(column: Column, kind: DataType) -> Column:
    """A number in the order of the column; text by its first seven bytes."""
    match kind:
        case NumericType():
            return column.cast("double")
        case BooleanType():
            return column.cast("double")
        case DateType():
            return F.unix_date(column).cast("double")
        case TimestampType() | TimestampNTZType():
            return F.unix_micros(column.cast("timestamp")).cast("double")
        case StringType():
            first = F.substring(F.rpad(F.encode(column, "UTF-8"), 7, b"\0"), 1, 7)
            return F.conv(F.hex(first), 16, 10).cast("double")
    raise ValueError(f"rows cannot be clustered by {kind.simpleString()}")


def rank_bounds(df: DataFrame, columns: list[str], bits: int = BITS) -> dict[str, list[float]]:
    """The values that part each column into ranges with about as many rows each.

    One pass; every task sums its rows up in a sketch of bounded size, and the driver
    gets ``2**bits - 1`` numbers per column. Nulls are not looked at.
    """
    shares = [i / 2**bits for i in range(1, 2**bits)]
    kinds = {f.name: f.dataType for f in df.schema}
    sketches = [
        F.percentile_approx(order_number(F.col(c), kinds[c]), shares, 20 * 2**bits).alias(c)
        for c in columns
    ]
    found = df.agg(*sketches).first()
    return {c: list(found[c] or []) for c in columns}


def with_rank(df: DataFrame, name: str, number: Column, bounds: list[float], bits: int = BITS) -> DataFrame:
    """Adds ``name``: how many of the bounds are at most ``number``; 0 for a null.

    By halving. Each step is a projection of its own, which Spark compiles; nested in one
    expression, or as a function over an array, the steps would be much slower.
    """
    if not bounds:
        return df.withColumn(name, F.lit(0))
    table = F.lit(np.array(bounds, np.float64))
    step, at = f"{name}_{bits}", F.lit(0)
    df = df.withColumn(f"{name}_n", number)
    for bit in reversed(range(bits)):
        half = F.when(F.get(table, at + (2**bit - 1)) <= F.col(f"{name}_n"), at + 2**bit).otherwise(at)
        last, step = step, f"{name}_{bit}"
        df = df.withColumn(step, half).drop(last)
        at = F.col(step)
    return df.withColumnRenamed(step, name).drop(f"{name}_n")


def interleaved(ranks: list[Column], bits: int = BITS) -> Column:
    """The bits of the ranks in turn, the highest ones first, as one number."""
    if len(ranks) * bits > 63:
        raise ValueError(f"{len(ranks)} columns of {bits} bits do not fit a number")
    parts = [
        F.shiftleft(F.shiftright(r.cast("long"), b).bitwiseAND(F.lit(1)), b * len(ranks) + i)
        for i, r in enumerate(reversed(ranks))
        for b in range(bits)
    ]
    return reduce(Column.__add__, parts)


def with_cluster_key(df: DataFrame, columns: list[str], bounds: dict[str, list[float]], bits: int = BITS) -> DataFrame:
    """Adds the place of each row along the curve through ``columns``."""
    kinds = {f.name: f.dataType for f in df.schema}
    ranks = [f"{KEY}{i}" for i in range(len(columns))]
    for name, c in zip(ranks, columns):
        df = with_rank(df, name, order_number(F.col(c), kinds[c]), bounds[c], bits)
    return df.withColumn(KEY, interleaved([F.col(r) for r in ranks], bits)).drop(*ranks)


def write_clustered(
    df: DataFrame,
    path: str,
    columns: list[str],
    partition_by: list[str] | None = None,
    bloom: dict[str, int] | None = None,
    bits: int = BITS,
    options: dict[str, str] | None = None,
) -> None:
    """Write ``df`` to the folder ``path``, clustered by ``columns``.

    ``bloom`` has the columns that get bloom filters, each with the number of
    distinct values to expect in a row group. ``options`` go to the Parquet writer,
    such as ``parquet.block.size``.

    Ranges of the key are dealt to tasks. Rows of one key are told apart by a hash
    and a number of their own, so that a value with a large share of the rows, or a row
    that is repeated very often, is spread over as many tasks as its share asks for.
    """
    partition_by = partition_by or []
    if clash := [c for c in df.columns if c.startswith((KEY, SPREAD))]:
        raise ValueError(f"columns of these names are in use: {clash}")
    bounds = rank_bounds(df, columns, bits)
    keyed = with_cluster_key(df, columns, bounds, bits)
    spread = F.xxhash64(*[F.col(c) for c in columns], F.monotonically_increasing_id())
    order = [*partition_by, KEY]
    sorted_rows = (
        keyed.withColumn(SPREAD, spread)
        .repartitionByRange(*order, SPREAD)
        .sortWithinPartitions(*order, *columns)
        .drop(KEY, SPREAD)
    )
    writer = sorted_rows.write.mode("overwrite").partitionBy(*partition_by)
    for name, distinct in (bloom or {}).items():
        writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
        writer = writer.option(f"parquet.bloom.filter.expected.ndv#{name}", str(distinct))
    for name, value in (options or {}).items():
        writer = writer.option(name, value)
    writer.parquet(path)
