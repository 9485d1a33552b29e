"""Words, row wrapping and scratch tables shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakejobs.session import scratch_dir

#: Runs of these separate words, in Java's, DuckDB's and Python's expressions alike.
SPACES = r"[\x20\x09-\x0D]+"
#: Bits of the fixed-size filter (16 MB at most) that spares rows a shuffle.
FILTER_BITS = 2**27


def words(text: Column) -> Column:
    """The words of a text as an array; empty for a null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows of ``df``, stored in the shared scratch folder and read again.

    Cuts the lineage and keeps costly rows from being made twice. The folder is
    removed when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    df.write.parquet(path)
    removed_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def removed_at_exit(spark: SparkSession, path: str) -> None:
    """Has an existing scratch folder removed when the driver's JVM ends."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)


def marked(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Adds ``likely``: false where the key is surely not in the first column of ``ids``.

    A bitmap of fixed size, so that it can be broadcast, whatever the number of ids.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    marks = ids.select(slot(F.col(ids.columns[0]).cast("long")).alias("p"))
    marks = marks.groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    p = slot(rows[key].cast("long"))
    place = F.bitmap_bit_position(p).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    out = rows.join(F.broadcast(marks), F.bitmap_bucket_number(p) == F.col("bucket"), "left")
    return out.withColumn("likely", F.coalesce(F.getbit(byte, place % 8) == 1, F.lit(False))).drop("bucket", "bits")
