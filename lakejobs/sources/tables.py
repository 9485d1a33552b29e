"""Table lifecycle: create, append, rebuild, read.

A table is named either by a catalog name (``ns.table`` or
``catalog.ns.table``) or by a folder path, recognised by a ``/``.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Tasks that share one hot partition value when AQE cannot split it.
SALTS = 32
# Rows at most that `spread` gives to a task; the flights made of them are sorted by month, 12 for each.
ROWS_PER_TASK = 200_000


def _is_path(table: str) -> bool:
    return "/" in table


def read_table(spark: SparkSession, table: str, schema: StructType | None = None) -> DataFrame:
    """Read a table. Give ``schema`` for a partitioned folder whose partition
    values must keep their type: inference turns ``1998`` into a number."""
    if not _is_path(table):
        return spark.table(table)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(table)


def read_if_present(spark: SparkSession, table: str, schema: StructType) -> DataFrame:
    """Like :func:`read_table`, but an absent table reads as an empty one."""
    if _is_path(table) and _is_empty(spark, table):
        return spark.createDataFrame([], schema)
    try:
        return read_table(spark, table, schema)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND"):
            raise
        return spark.createDataFrame([], schema)


def create_namespace(spark: SparkSession, namespace: str) -> None:
    spark.sql(f"CREATE NAMESPACE IF NOT EXISTS {namespace}")


def create_table(
    spark: SparkSession,
    table: str,
    columns: str,
    partition_by: str | None = None,
    file_format: str = "parquet",
) -> None:
    """Create a catalog table with a fixed schema, unless it is there already.

    ``columns`` is a column list such as ``"id INT, msg STRING"``.
    """
    partitioned = f" PARTITIONED BY ({partition_by})" if partition_by else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING {file_format}{partitioned}")


def partition_columns(spark: SparkSession, path: str) -> list[str]:
    """The partition columns of a folder, from the names of its sub-folders.

    One sub-folder per level is looked into. A folder that is absent or empty has
    none.
    """
    here = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = here.getFileSystem(spark._jsc.hadoopConfiguration())
    found: list[str] = []
    while fs.exists(here):
        below = [s.getPath() for s in fs.listStatus(here) if s.isDirectory()]
        named = [p for p in below if "=" in p.getName() and not p.getName().startswith(("_", "."))]
        if not named:
            break
        here = named[0]
        found.append(unescaped(here.getName().partition("=")[0]))
    return found


def unescaped(name: str) -> str:
    """A partition column as it is called, from a folder's name."""
    return re.sub("%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), name)


def append_rows(df: DataFrame, table: str, partition_by: list[str] | None = None) -> None:
    """Append rows to a table, each column to the one of its name.

    A folder is written in the partitions that it has. ``partition_by`` gives them
    for a new folder; for one that exists it must be what is there. A catalog
    table gets its columns in its own order, and must have exactly these columns.
    """
    spark = df.sparkSession
    if not _is_path(table):
        own = spark.table(table).columns
        if sorted(map(str.lower, own)) != sorted(map(str.lower, df.columns)):
            raise ValueError(f"{table} has the columns {own}, the rows {df.columns}")
        if partition_by is not None:
            raise ValueError(f"{table} is a catalog table, which knows its partitions")
        df.select(*[df[c] for c in own]).write.insertInto(table)
        return
    there = partition_columns(spark, table)
    if partition_by is None:
        partition_by = there
    elif partition_by != there and not _is_empty(spark, table):
        raise ValueError(f"{table} is partitioned by {there}, not {partition_by}")
    if not set(partition_by) <= set(df.columns):
        raise ValueError(f"partition columns {partition_by} are not all in the rows: {df.columns}")
    df.write.mode("append").partitionBy(*partition_by).parquet(table)


def _is_empty(spark: SparkSession, path: str) -> bool:
    here = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = here.getFileSystem(spark._jsc.hadoopConfiguration())
    return not fs.exists(here) or not fs.listStatus(here)


def cluster_by(df: DataFrame, column: str) -> DataFrame:
    """Bring the rows of one partition value together, so that a write makes
    few files per value.

    The rebalance hint lets AQE merge small values and split a value that holds
    a large share of the rows. Without AQE the value is salted instead, so that
    no single task gets all of it.
    """
    if df.sparkSession.conf.get("spark.sql.adaptive.enabled", "true") == "true":
        return df.hint("rebalance", column)
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(SALTS))
    return df.repartition(F.col(column), salt)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows out again if there are fewer tasks than cores, or if tasks could get
    more than ``ROWS_PER_TASK`` rows, as for few files from which much is made: what a
    task holds then does not grow with the table. Use it on few, narrow columns."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = -(-df.count() // ROWS_PER_TASK)
    if df.rdd.getNumPartitions() >= cores and tasks <= 1:
        return df
    return df.repartition(max(cores, tasks))


def rebuild_partitioned(df: DataFrame, table: str, column: str, clustered: bool = False) -> None:
    """Drop what is there and write all rows again, one folder per value.

    One job writes every partition. Pass ``clustered=True`` when each task of
    ``df`` holds few partition values already: the rows are then written where
    they are, without a shuffle.
    """
    source = df if clustered else cluster_by(df, column)
    # Static, or old values would stay where the session overwrites dynamically.
    writer = source.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(column)
    if _is_path(table):
        writer.parquet(table)
    else:
        writer.format("parquet").saveAsTable(table)


def replace_partitions(df: DataFrame, table: str, column: str | None = None) -> None:
    """Write the rows and replace just the partitions that they are in, so that a run
    over one month can be repeated without doubling it.

    A folder is written in the partitions it has; ``column`` gives the one of a new
    folder. Partitions that the rows do not mention stay as they are; one whose rows
    are all gone from the input is therefore kept, not emptied.
    """
    spark = df.sparkSession
    if _is_path(table):
        parts = partition_columns(spark, table) or ([column] if column else [])
        if not parts or not set(parts) <= set(df.columns):
            raise ValueError(f"{table} needs partition columns that are in the rows, not {parts}")
        clustered = cluster_by(df, parts[0])
        writer = clustered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(*parts).parquet(table)
        return
    mode = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(mode)
    spark.conf.set(mode, "dynamic")
    try:
        df.select(*[df[c] for c in spark.table(table).columns]).write.insertInto(table, overwrite=True)
    finally:
        spark.conf.set(mode, before)


def write_dealt(df: DataFrame, path: str, column: str, values: list, per_value: int, key: str) -> None:
    """Write a folder per value of ``column``, each with ``per_value`` files or fewer.

    The rows of a value are dealt to its files by a hash of ``key``, one task for a file,
    so the number of files is known however many rows there are. Choose it by the size
    that the largest value will have. Every value must be in ``values``.
    """
    number = F.array_position(F.lit(values), F.col(column)) - 1
    place = (number * per_value + F.pmod(F.xxhash64(key), F.lit(per_value))).cast("int")
    dealt = df.repartitionById(len(values) * per_value, place)
    dealt.write.mode("overwrite").partitionBy(column).parquet(path)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and modification time of every file below ``path``. Only
    the listing is read, not the contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    keys = ("file_path", "file_size", "file_modification_time")
    return files.select(*[F.col(f"_metadata.{k}").alias(k) for k in keys])
