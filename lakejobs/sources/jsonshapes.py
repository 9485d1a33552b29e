"""Records from JSON texts of which the shape is not known: it is inferred first.

A text holds an array of objects or one object. The shape of all objects together is
one aggregate over parsed values: every task merges the shapes of its rows, and the
driver gets the type as a text, which grows with the fields but not with the rows.
Fields whose values do not agree in type are read as text, as the objects are of
different writers; whole numbers and fractions agree on fractions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Parts of a type's text: a quoted name, a decimal, or a word.
PARTS = re.compile(r"`(?:[^`]|``)*`|DECIMAL\([0-9]+, ?[0-9]+\)|[A-Za-z_0-9]+")
#: How the types of parsed values are read: missing and mixed ones as text.
READ_AS = {"OBJECT": "STRUCT", "VOID": "STRING", "VARIANT": "STRING"}


def objects(text: Column) -> Column:
    """The values of a text as an array of parsed ones: an array's elements, else the
    value. Null for a null, and for a text that is not whole JSON."""
    value = F.try_parse_json(text)
    return F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.when(value.isNotNull(), F.array(value)))


def _is_object(value: Column) -> Column:
    return F.schema_of_variant(value).startswith("OBJECT<")


def type_text(shape: str) -> str:
    """The type of parsed values in the words of SQL."""

    def read(part: re.Match) -> str:
        word = part[0]
        if word.startswith("DECIMAL") and not word.replace(" ", "").endswith(",0)"):
            return "DOUBLE"
        # A field may be called like a type: its name is followed by a colon.
        if shape[part.end() : part.end() + 1] == ":":
            return word
        return READ_AS.get(word, word)

    return PARTS.sub(read, shape)


def infer_shape(df: DataFrame, text: Column) -> str | None:
    """The type of the objects in a text column, as SQL text; None if there are none.

    One pass, which reads only what ``text`` needs.
    """
    values = df.select(F.explode(objects(text)).alias("v")).filter(_is_object(F.col("v")))
    shape = values.agg(F.schema_of_variant_agg("v")).first()[0]
    return type_text(shape) if shape and shape.startswith("OBJECT<") else None


def inferred_records(df: DataFrame, text: Column, shape: str | None = None) -> DataFrame:
    """One row per object: its fields by the inferred type, and ``rejected``, the text of
    what is not an object: a text that is not whole JSON, or an element of another kind.

    Give the ``shape`` of an earlier :func:`infer_shape` to save the pass and to
    keep the columns as they are. An empty array and a null give no row.
    """
    shape = shape or infer_shape(df, text) or "STRUCT<>"
    rows = df.select(text.alias("_text"))
    whole = F.coalesce(objects(F.col("_text")), F.when(F.col("_text").isNotNull(), F.array(F.lit(None).cast("variant"))))
    rows = rows.select("_text", F.explode(whole).alias("_value"))
    good = F.col("_value").isNotNull() & _is_object(F.col("_value"))
    fields = StructType.fromDDL(f"r {shape}")[0].dataType
    record = F.from_json(F.when(good, F.to_json("_value")), fields) if fields.names else None
    columns = [F.col("_r").getField(name).alias(name) for name in fields.names]
    if record is not None:
        rows = rows.withColumn("_r", record)
    left = F.when(F.col("_value").isNull(), F.col("_text")).otherwise(F.to_json("_value"))
    return rows.select(*columns, F.when(~good, left).alias("rejected"))
