"""JSON records in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

UNPARSED = "_unparsed"


def read_records(
    spark: SparkSession,
    path: str,
    schema: StructType | str | None = None,
    one_document_per_file: bool = False,
) -> DataFrame:
    """Read JSON records.

    Without ``schema`` it is inferred, which reads everything once more; give
    one for large inputs. ``one_document_per_file`` accepts a file holding an
    array of objects or one object spread over lines. Such a file cannot be
    split among tasks; JSON lines can.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.option("multiLine", one_document_per_file).json(path)


def judged_records(df: DataFrame, text: Column, schema: StructType) -> DataFrame:
    """One row per object of a JSON text column, which holds an array of objects
    or one object: its fields, and ``rejected``, the raw text of what does not fit.

    An object with a value of another type is rejected by itself. A text that is
    not whole JSON is rejected as a whole. An empty array and a null give no row.
    """
    # Only a text that begins as an array is taken apart before its records are read.
    is_list = F.rlike(text, F.lit("^[ \\t\\r\\n]*\\["))
    items = F.coalesce(F.when(is_list, F.from_json(text, "array<string>")), F.array(text))
    rows = df.select(F.explode(F.when(text.isNotNull(), items)).alias("_text"))
    marked = StructType([*schema.fields, StructField(UNPARSED, StringType())])
    parsed = F.from_json("_text", marked, {"columnNameOfCorruptRecord": UNPARSED})
    rows = rows.select("_text", parsed.alias("_r"))
    good = F.col("_r").isNotNull() & F.col("_r")[UNPARSED].isNull()
    return rows.select(
        *[F.when(good, F.col("_r")[name]).alias(name) for name in schema.names],
        F.when(~good, F.coalesce("_text", F.lit("null"))).alias("rejected"),
    )


def explode_records(df: DataFrame, text: Column, schema: StructType) -> DataFrame:
    """The objects of a JSON text column that fit the schema; the others are in
    :func:`rejected_records`."""
    return judged_records(df, text, schema).filter("rejected IS NULL").drop("rejected")


def rejected_records(df: DataFrame, text: Column, schema: StructType) -> DataFrame:
    """The raw texts, ``rejected``, that are not objects of the schema."""
    return judged_records(df, text, schema).filter("rejected IS NOT NULL").select("rejected")


def as_json(df: DataFrame, alias: str = "json") -> DataFrame:
    """Each row as one JSON object. Null fields are written out."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(alias))


def write_records(df: DataFrame, path: str) -> None:
    """Write JSON lines, each task its own file."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
