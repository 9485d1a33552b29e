"""Catalog contents as data: namespaces, tables, and a profile of columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DataType,
    DateType,
    IntegralType,
    NumericType,
    StringType,
    TimestampNTZType,
    TimestampType,
)

from lakejobs.functions.values import sql_text
from lakejobs.sources.tables import list_files

FILE_KEYS = ["file_path", "file_size", "file_modification_time"]


def namespaces(spark: SparkSession, catalog: str | None = None) -> DataFrame:
    return spark.sql("SHOW NAMESPACES" + (f" IN {catalog}" if catalog else ""))


def tables(spark: SparkSession, namespace: str) -> DataFrame:
    return spark.sql(f"SHOW TABLES IN {namespace}")


def table_summary(spark: SparkSession, table: str) -> DataFrame:
    """One row: namespace, table, location and the sorted keys of its stored
    metadata."""
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {table} AS JSON")
    text = F.col(described.columns[0])
    fields = F.from_json(text, "map<string,string>")
    return described.select(
        F.concat_ws(".", F.from_json(fields["namespace"], "array<string>")).alias("namespace"),
        fields["table_name"].alias("table"),
        F.try_element_at(fields, F.lit("location")).alias("location"),
        F.sort_array(F.map_keys(fields)).alias("metadata_keys"),
    )


def _bound(aggregate: str, data_type: DataType) -> dict[str, str]:
    """A smallest or largest value in SQL, under the kind it is reported as."""
    if isinstance(data_type, IntegralType):
        # A double is not exact above 2**53.
        return {"number": f"CAST({aggregate} AS DOUBLE)", "integer": f"CAST({aggregate} AS BIGINT)"}
    if isinstance(data_type, NumericType):
        return {"number": f"CAST({aggregate} AS DOUBLE)"}
    if isinstance(data_type, (StringType, DateType, TimestampType, TimestampNTZType)):
        return {"text": f"CAST({aggregate} AS STRING)"}
    return {}


def profile(df: DataFrame, table: str, integers: bool = False) -> DataFrame:
    """One row per column: rows, nulls, smallest and largest value.

    The whole table is aggregated once, to a single row that is then turned
    into one row per column. Numbers are reported in ``min_number`` and
    ``max_number``, text and times in ``min_text`` and ``max_text``. With ``integers``,
    whole numbers are given in ``min_integer`` and ``max_integer`` as well, where they are
    exact at any size.
    """
    stats, entries = ["count(*) AS rows"], []
    for i, field in enumerate(df.schema):
        column = "`" + field.name.replace("`", "``") + "`"
        low = _bound(f"min({column})", field.dataType)
        high = _bound(f"max({column})", field.dataType)
        measures = {
            "nulls": f"count(*) - count({column})",
            "min_number": low.get("number", "CAST(NULL AS DOUBLE)"),
            "max_number": high.get("number", "CAST(NULL AS DOUBLE)"),
            "min_text": low.get("text", "CAST(NULL AS STRING)"),
            "max_text": high.get("text", "CAST(NULL AS STRING)"),
        }
        if integers:
            measures["min_integer"] = low.get("integer", "CAST(NULL AS BIGINT)")
            measures["max_integer"] = high.get("integer", "CAST(NULL AS BIGINT)")
        stats += [f"{sql} AS {name}_{i}" for name, sql in measures.items()]
        values = ", ".join(f"{name}_{i}" for name in measures)
        entries.append(f"{sql_text(table)}, {sql_text(field.name)}, rows, {values}")
    names = "`table`, `column`, rows, nulls, min_number, max_number, min_text, max_text"
    names += ", min_integer, max_integer" if integers else ""
    stacked = f"stack({len(entries)}, {', '.join(entries)}) AS ({names})"
    return df.selectExpr(*stats).selectExpr(stacked)


def profile_all(tables_by_name: dict[str, DataFrame], integers: bool = False) -> DataFrame:
    """The profiles of several tables."""
    return reduce(DataFrame.union, [profile(df, n, integers) for n, df in tables_by_name.items()])


def file_statistics(
    table: DataFrame, columns: list[str], partition_columns: tuple[str, ...] = ()
) -> DataFrame:
    """One row per file of ``table``: rows, bounds and nulls of the columns, which tell
    how well the files are clustered. One pass over ``columns`` only; each task reduces
    a file to one row before the shuffle.

    ``partition_columns`` have one value per file and cost nothing. Bounds of
    text columns make Spark sort each task's rows by file, so take only those
    that the table is clustered by.
    """
    stats = [F.count(F.lit(1)).alias("rows")]
    for c in columns:
        stats += [
            F.min(c).alias(f"{c}__min"),
            F.max(c).alias(f"{c}__max"),
            F.count_if(F.col(c).isNull()).alias(f"{c}__nulls"),
        ]
    keys = [F.col(f"_metadata.{k}").alias(k) for k in FILE_KEYS]
    files = table.groupBy(*keys, *partition_columns).agg(*stats)
    for p in partition_columns:
        no_rows = F.lit(0).cast("bigint")
        files = files.withColumns(
            {
                f"{p}__min": F.col(p),
                f"{p}__max": F.col(p),
                f"{p}__nulls": F.when(F.col(p).isNull(), F.col("rows")).otherwise(no_rows),
            }
        ).drop(p)
    return files


def storage(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Files and bytes of the table at ``path``, from its listing only."""
    return list_files(spark, path).agg(
        F.lit(table).alias("table"),
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"),
    )
