"""WARC archives: written by tasks to a shared folder, read back in byte ranges.

Pages with equal payloads, by SHA-1, become one response, that of the smallest id,
and revisit records that refer to it. Every record is a gzip member of its own.
The reader cuts archives into ranges; a task looks for gzip magic in its range,
accepts a member only if it decodes to a WARC header, and reads on beyond the end
of the range to finish the last record that starts inside it.

Only pages whose payload comes more than once are shuffled, after a bitmap of
fixed size has told most others apart.

The folder must be reachable from every task: a local or mounted path, hdfs://,
s3:// or gs:// as pyarrow opens them.

Defined cases: a null html is an empty payload, and all empty payloads of at least
``min_bytes`` are equal. A null id comes back as null; it is a response only where
no other page has its payload. Rows that share both the smallest id and the
payload are all responses. Spaces and control characters of a url are percent
encoded; a null url gives the page's URN. An empty table writes no archives and
reads no records. Other columns are not stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakejobs.llm.common import marked, removed_at_exit, written
from lakejobs.llm.records import archived, read_ranges

#: Bytes of an archive that one range covers.
RANGE = 8 << 20
#: Ranges are dealt to at most so many tasks for each core.
TASKS_PER_CORE = 16


def write(pages: DataFrame, folder: str, min_bytes: int = 0, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes the archives; returns their path, bytes and records."""
    body = F.encode(F.coalesce(pages[html], F.lit("")), "UTF-8")
    rows = pages.select(pages[key].cast("long").alias("page"), pages[url].alias("url"), body.alias("html"))
    rows = rows.withColumn("sum", F.when(F.length("html") >= min_bytes, F.sha1("html")))
    again = rows.filter("sum IS NOT NULL").groupBy("sum").agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n"))
    again = written(again.filter("n > 1").select(F.xxhash64("sum").alias("slot"), "sum", "first"), "equal-payloads")
    rows = marked(rows.withColumn("slot", F.xxhash64("sum")), "slot", again)
    sure = rows.filter("NOT likely").select("page", "url", "html", F.lit(None).cast("long").alias("first"), F.lit(False).alias("revisit"))
    likely = rows.filter("likely").drop("slot").join(again.drop("slot"), "sum", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first"))
    rows = sure.unionByName(likely.select("page", "url", "html", "first", revisit.alias("revisit")))
    manifest = written(rows.mapInArrow(archived(folder), "path string, bytes long, records long"), "archives")
    removed_at_exit(pages.sparkSession, folder)
    return manifest


def read(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of archives (path, bytes), each range in a row of its own.

    Columns page_id, url, record_type, payload (of responses), payload_bytes,
    payload_digest, refers_to and intact.
    """
    ranges = archives.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(RANGE).cast("long"))).alias("start"))
    ranges = ranges.withColumn("end", F.least(F.col("start") + RANGE, F.col("bytes")))
    schema = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long, intact boolean"
    # A number of tasks by the archives' size, which small rows alone would not tell.
    total = archives.agg(F.sum(F.ceil(F.col("bytes") / RANGE))).first()[0] or 1
    tasks = min(total, TASKS_PER_CORE * archives.sparkSession.sparkContext.defaultParallelism)
    return ranges.repartition(int(tasks), "path", "start").mapInArrow(read_ranges(with_payload), schema)
