"""Appends in numbered runs, whose rejects are tried again and end as dead letters.

A run judges its new rows and all rows that the run before left to retry. Each row
goes, in one pass over the input, to one of the outcomes ``accepted``, ``retry`` and
``dead`` below ``run=<n>``. Keys that an earlier run has stored are not stored again.
A run depends on the runs before it only and replaces its own folder, so one that
broke off, or whose rules were mended, is simply run again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from lakejobs.operators.append import Rule, accepted, judge
from lakejobs.sources.tables import read_if_present

ATTEMPT, REASON = "attempt", "reject_reason"
OUTCOMES = ["accepted", "retry", "dead"]


def _stored_schema(raw: StructType) -> StructType:
    """The columns as they came in, with what is known of each row."""
    known = [(ATTEMPT, IntegerType()), (REASON, StringType()), ("run", IntegerType()), ("outcome", StringType())]
    return StructType([*raw.fields, *[StructField(n, t) for n, t in known]])


def runs_before(spark: SparkSession, path: str, raw: StructType, run: int) -> DataFrame:
    """The rows of the runs before ``run``; none where there is no folder yet."""
    return read_if_present(spark, path, _stored_schema(raw)).filter(F.col("run") < run)


def append_run(
    df: DataFrame,
    path: str,
    run: int,
    schema: StructType,
    key: str,
    rules: dict[str, Rule] | None = None,
    max_attempts: int = 3,
) -> dict[str, int]:
    """Run number ``run`` (from 1, in order) over the new rows ``df``.

    Returns the numbers of rows taken up, and of those per outcome. Rows whose
    ``key`` is stored already are left out. Of several good rows with one key, the
    first in the order of their columns is stored. A row without a key is rejected.
    A row that is rejected for the ``max_attempts``-th time is a dead letter.

    The input is read once. Keys are compared by a join; equal keys are reduced in
    each task before they are shuffled, so a key may hold any share of the rows.
    """
    spark = df.sparkSession
    new = df.select(*schema.names).withColumn(ATTEMPT, F.lit(1))
    earlier = runs_before(spark, path, df.select(*schema.names).schema, run)
    waiting = earlier.filter((F.col("run") == run - 1) & (F.col("outcome") == "retry"))
    again = waiting.select(*schema.names, (F.col(ATTEMPT) + 1).alias(ATTEMPT))
    stored = earlier.filter(F.col("outcome") == "accepted").select(F.col(key).alias("_stored"))
    fresh = new.unionByName(again)
    fresh = fresh.join(stored, fresh[key] == F.col("_stored"), "left_anti")

    wide = StructType([*schema.fields, StructField(ATTEMPT, IntegerType())])
    judged = judge(fresh, wide, rules)
    missing = F.when(F.col(key).isNull(), F.lit(f"{key}: missing"))
    judged = judged.withColumn(REASON, F.nullif(F.concat_ws("; ", missing, REASON), F.lit("")))
    bad = F.col(REASON).isNotNull()
    # A bad row is a group of its own, good ones with one key are one group.
    own = F.when(bad, F.monotonically_increasing_id())
    row = F.min(F.struct(*schema.names, ATTEMPT, REASON)).alias("row")
    kept = judged.withColumn("_own", own).groupBy(F.col(key).alias("_key"), "_own").agg(row).select("row.*")
    outcome = (
        F.when(~bad, F.lit("accepted"))
        .when(F.col(ATTEMPT) >= max_attempts, F.lit("dead"))
        .otherwise(F.lit("retry"))
    )
    seen = Observation()
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES]
    routed = kept.withColumn("outcome", outcome).observe(seen, F.count(F.lit(1)).alias("rows"), *counts)
    # Static: a dynamic overwrite would keep the outcomes that a repeated run no longer has.
    writer = routed.write.mode("overwrite").option("partitionOverwriteMode", "static")
    writer.partitionBy("outcome").parquet(f"{path}/run={run}")
    return dict(seen.get)


def stored_rows(spark: SparkSession, path: str, raw: StructType, schema: StructType) -> DataFrame:
    """The rows that all runs have stored, converted to ``schema``."""
    rows = read_if_present(spark, path, _stored_schema(raw)).filter(F.col("outcome") == "accepted")
    return accepted(rows, schema)


def waiting_rows(spark: SparkSession, path: str, raw: StructType, run: int) -> DataFrame:
    """The rows that the run after ``run`` will try again."""
    rows = read_if_present(spark, path, _stored_schema(raw))
    return rows.filter((F.col("run") == run) & (F.col("outcome") == "retry")).drop("run", "outcome")


def dead_letters(spark: SparkSession, path: str, raw: StructType) -> DataFrame:
    """The rows that were given up, with the last reason."""
    rows = read_if_present(spark, path, _stored_schema(raw))
    return rows.filter(F.col("outcome") == "dead").drop("outcome")
