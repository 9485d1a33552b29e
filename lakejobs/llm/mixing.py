"""Mixing sources to target weights by capped water-filling.

Sources share a budget of words by weight. A source whose share is above its
maximum of epochs is clamped there, and the excess goes to the others by weight,
until none is above. Every document of a source is then repeated the whole
number of epochs; the fractional epoch takes documents in the order of a seeded
hash until the source's target is met, so that the words taken differ from the
target by half a document at most.

The driver holds a few sums per round, never sources or documents. A source may
hold any share of the rows: its documents are counted in buckets of their hash,
and only the bucket in which the target is met is put in order.

Defined cases: a null source is a source of its own, the last. A null or empty
text has size 0; it is repeated like the others and takes no words. Rows with the
same id and size are taken or left together. A null id counts as an empty one.
Empty tables give empty results. Columns of the input are carried along, whatever
their names. If all sources are clamped, the targets are the maxima.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakejobs.llm.common import words, written

#: Hexadecimal digits of the hash that make a bucket: 4,096 buckets a source.
BUCKET_DIGITS = 3
#: Words taken, as a multiple of all words, and the maximum of epochs.
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix"


def size(text: Column) -> Column:
    """Number of words; 0 for a null."""
    return F.size(words(text)).cast("long")


def draw(key: Column, seed: str) -> Column:
    """The seeded hash that orders documents."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))


def sized(docs: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """All rows as ``row``, with ``source``, ``size`` and the hash ``h``."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    row = F.col("row")
    return rows.select("row", row[source].alias("source"), size(row[text]).alias("size"), draw(row[key], SEED).alias("h"))


def cycled_weights(sources: DataFrame, cycle: list[float]) -> DataFrame:
    """``source`` and ``weight``: the cycle dealt out in code-point order, null last."""
    ordered = sources.select("source").orderBy(F.col("source").asc_nulls_last())
    schema = T.StructType([T.StructField("source", T.StringType()), T.StructField("weight", T.DoubleType())])
    numbered = ordered.rdd.zipWithIndex().map(lambda x: (x[0][0], float(cycle[x[1] % len(cycle)])))
    return sources.sparkSession.createDataFrame(numbered, schema)


def targets(sources: DataFrame, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Adds ``target`` to rows of source, source_size and weight (above 0).

    Each round raises the common level, words per weight, to what the sources
    that are not clamped can still share. The level never falls, so a source that
    is clamped stays so, and the rounds end when their number stays the same.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    level, clamped = 0.0, -1
    while True:
        over = cap < F.lit(level) * F.col("weight")
        sums = sources.agg(
            F.count_if(over).alias("n"),
            (F.sum("source_size") * F.lit(float(share))).alias("budget"),
            F.coalesce(F.sum(F.when(over, cap)), F.lit(0.0)).alias("used"),
            F.sum(F.when(~over, F.col("weight"))).alias("weight"),
        ).first()
        if sums["n"] == clamped or not sums["weight"]:
            break
        clamped, level = sums["n"], (sums["budget"] - sums["used"]) / sums["weight"]
    return sources.withColumn("target", cap if not sums["weight"] else F.least(cap, F.lit(level) * F.col("weight")))


def plan(rows: DataFrame, weights: DataFrame, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """One row per source: source_size, target, whole epochs and the cut of the rest.

    A document is repeated once more if (h, size) is at or below ``cut``.
    """
    bucket = F.substring("h", 1, BUCKET_DIGITS)
    buckets = written(rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words")), "mix-buckets")
    sums = buckets.groupBy("source").agg(F.sum("words").alias("source_size"))
    same = sums["source"].eqNullSafe(weights["source"])
    sources = written(sums.join(weights, same).drop(weights["source"]), "mix-sources")
    sources = targets(sources, share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    sources = sources.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    sources = written(sources, "mix-targets")

    other = buckets.withColumnRenamed("source", "s")
    running = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    other = other.withColumn("above", F.sum("words").over(running)).withColumn("below", F.col("above") - F.col("words"))
    # The bucket in which the rest is met: the last that starts below it.
    met = sources.filter("rest > 0").join(other, F.col("source").eqNullSafe(F.col("s")) & (F.col("below") < F.col("rest")))
    met = met.groupBy("s").agg(F.max(F.struct("bucket", "below", "rest")).alias("m"))
    met = met.select("s", "m.*")
    near = rows.join(met, rows["source"].eqNullSafe(met["s"]) & (bucket == met["bucket"]))
    near = near.groupBy("s", "h", "size").agg(F.sum("size").alias("words"), F.first("below").alias("below"), F.first("rest").alias("rest"))
    ordered = Window.partitionBy("s").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("middle", F.col("below") + F.sum("words").over(ordered) - F.col("words") / 2)
    inner = near.filter("middle < rest").groupBy("s").agg(F.max(F.struct("h", "size")).alias("inner"))
    # With no document of that bucket taken, the cut lies just before the bucket.
    start = F.struct(F.col("bucket").alias("h"), F.lit(-1).cast("long").alias("size"))
    cuts = met.join(inner.withColumnRenamed("s", "t"), F.col("s").eqNullSafe(F.col("t")), "left")
    cuts = cuts.select("s", F.coalesce("inner", start).alias("cut"))
    out = sources.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left")
    return out.select(F.col("source").alias("s"), "source_size", "target", "whole", "cut")


def decide(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """Adds source_size, target, repeats and taken to sized rows."""
    out = rows.join(planned, rows["source"].eqNullSafe(planned["s"])).drop("s")
    more = F.coalesce(F.struct("h", "size") <= F.col("cut"), F.lit(False)).cast("long")
    out = out.withColumn("repeats", F.col("whole") + more).drop("whole", "cut")
    return out.withColumn("taken", F.col("repeats") * F.col("size"))


def mix(docs: DataFrame, cycle: list[float], key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mixed documents: one row per repetition, with the columns of ``docs``."""
    rows = sized(docs, key, source, text)
    counted = written(rows.select("source", "size", "h"), "mix-sizes")
    planned = written(plan(counted, cycled_weights(counted.select("source").distinct(), cycle)), "mix-plan")
    taken = decide(rows, planned).filter("repeats > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int")))).select("row.*")
