"""Ingestion flows: read rows as they arrive, append them, report progress."""

from __future__ import annotations

import re
import time

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery, StreamingQueryListener
from pyspark.sql.types import StructType

from lakejobs.operators.append import Rule, accepted, judge, rejected, typed_columns
from lakejobs.sources.tables import list_files

HOURLY = "3600 seconds"
METRICS = "ingest"


def _batch_row(p) -> tuple:
    """Batch id, rows in, rows counted on the way out, rows rejected."""
    metrics = p.observedMetrics.get(METRICS)
    out, bad = (metrics["rows"], metrics["rejected"]) if metrics else (None, None)
    return p.batchId, p.numInputRows, out, bad


class BatchLog(StreamingQueryListener):
    """One row per batch of every flow started here, by query and batch id.

    Spark itself keeps the progress of the last batches only.
    """

    def __init__(self) -> None:
        self.rows: dict[tuple[str, int], tuple] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows[str(p.id), p.batchId] = _batch_row(p)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


#: The log of each session, by the application it belongs to.
LOGS: dict[str, BatchLog] = {}


def _log(spark: SparkSession) -> BatchLog:
    application = spark.sparkContext.applicationId
    if application not in LOGS:
        LOGS[application] = BatchLog()
        spark.streams.addListener(LOGS[application])
    return LOGS[application]


def new_files(
    spark: SparkSession,
    path: str,
    schema: StructType,
    file_format: str = "parquet",
    files_per_batch: int | None = None,
) -> DataFrame:
    """A stream of the rows of files that arrive at ``path``."""
    reader = spark.readStream.schema(schema).format(file_format)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def repeating_rows(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A stream that gives the same few literal rows in every batch."""
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", len(rows)).load()
    schema = StructType.fromDDL(columns)
    literals = F.array(
        *[
            F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for f, v in zip(schema, row)])
            for row in rows
        ]
    )
    position = F.pmod(F.col("value"), F.lit(len(rows))).cast("int")
    return ticks.select(F.get(literals, position).alias("_row")).select("_row.*")


def _scheduled(writer: DataStreamWriter, checkpoint: str, every: str | None) -> DataStreamWriter:
    """``every=None`` takes what is there and stops; otherwise a batch starts
    at each interval."""
    writer = writer.option("checkpointLocation", checkpoint)
    if every is None:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=every)


def stop_after(query: StreamingQuery, batches: int, seconds: float = 600) -> None:
    """Stop a running flow once it has finished this many batches, in the middle of the
    next one if that has begun. A restart with the same checkpoint goes on from there."""
    end = time.monotonic() + seconds
    while query.isActive and time.monotonic() < end:
        last = query.lastProgress
        if last and last.batchId + 1 >= batches:
            break
        time.sleep(0.05)
    query.stop()
    if query.exception():
        raise query.exception()


RAW = "raw"


def append_stream(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    schema: StructType,
    rules: dict[str, Rule] | None = None,
    every: str | None = None,
    typed: bool = False,
) -> StreamingQuery:
    """Append a stream to the folder ``path``, each row exactly once.

    One pass writes the good rows under ``outcome=accepted`` and the others
    under ``outcome=rejected`` with their reason. The columns of ``schema`` stay
    as they came in; use :func:`accepted_rows` to read them converted. With ``typed``
    they are stored converted instead, and rejected rows keep what came in as one
    column ``raw``; use :func:`typed_rows`. A restart with the same checkpoint goes on
    where the last run ended.
    """
    _log(stream.sparkSession)
    judged = judge(stream, schema, rules)
    bad = F.col("reject_reason").isNotNull()
    if typed:
        raw = F.when(bad, F.struct(*schema.names)).alias(RAW)
        good = [F.when(~bad, c).alias(name) for name, c in typed_columns(judged, schema).items()]
        judged = judged.select(*good, raw, "reject_reason")
    counted = judged.withColumn(
        "outcome", F.when(bad, F.lit("rejected")).otherwise(F.lit("accepted"))
    ).observe(
        METRICS,
        F.count(F.lit(1)).alias("rows"),
        F.count_if(bad).alias("rejected"),
    )
    writer = counted.writeStream.format("parquet").partitionBy("outcome").option("path", path)
    return _scheduled(writer.outputMode("append"), checkpoint, every).start()


def accepted_rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The good rows written by :func:`append_stream`."""
    return accepted(spark.read.parquet(path).filter(F.col("outcome") == "accepted"), schema)


def rejected_rows(spark: SparkSession, path: str) -> DataFrame:
    """The others, as they came in, with the reason."""
    rows = spark.read.parquet(path).filter(F.col("outcome") == "rejected")
    return rejected(rows).drop("outcome")


def typed_rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The good rows of a flow that stores them converted."""
    return spark.read.parquet(path).filter(F.col("outcome") == "accepted").select(*schema.names)


def untyped_rejects(spark: SparkSession, path: str) -> DataFrame:
    """The others of such a flow, as they came in, with the reason."""
    rows = spark.read.parquet(path).filter(F.col("outcome") == "rejected")
    return rows.select(f"{RAW}.*", "reject_reason")


def append_batches(
    stream: DataFrame, path: str, checkpoint: str, name: str, every: str | None = None
) -> StreamingQuery:
    """Append a stream to a folder that other jobs append to as well.

    Each batch goes to its own folder, ``flow=<name>/batch_id=<n>``, and
    replaces what an interrupted attempt of the same batch left there. Use a new
    ``name`` with a new checkpoint: batch numbers start at 0 again.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/flow={name}/batch_id={batch_id}")

    _log(stream.sparkSession)
    return _scheduled(stream.writeStream.foreachBatch(write), checkpoint, every).start()


def progress(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """One row per batch that this application ran of the flow: rows in, rows
    counted on the way out, rows rejected."""
    name = str(query.id)
    rows = {batch: row for (flow, batch), row in _log(spark).rows.items() if flow == name}
    # The log may lag behind by the batches that Spark still keeps itself.
    for p in query.recentProgress:
        if not rows.get(p.batchId) or p.numInputRows:
            rows[p.batchId] = _batch_row(p)
    return spark.createDataFrame(
        [rows[batch] for batch in sorted(rows)],
        "batch_id BIGINT, rows_in BIGINT, rows_out BIGINT, rejected BIGINT",
    )


def queue(spark: SparkSession, source: str, checkpoint: str) -> DataFrame:
    """One row per batch: files taken so far, and files that wait at ``source``.

    The files of each batch stand in the log of the source below the checkpoint, part
    of which Spark sums up now and then; a file is counted where it came up first. Those
    that wait are the rest of the listing, so a batch is shown with what has arrived by
    now. Only names are read; one row per batch comes to the driver, as for progress.
    """
    lines = spark.read.text(f"{checkpoint}/sources/0").filter(F.col("value").startswith("{"))
    entry = F.from_json("value", "path STRING, batchId BIGINT")
    taken = lines.select(entry.alias("e")).groupBy("e.path").agg(F.min("e.batchId").alias("batch_id"))
    batches = taken.groupBy("batch_id").agg(F.count(F.lit(1)).alias("files")).orderBy("batch_id")
    listed = list_files(spark, source).count()
    rows, so_far = [], 0
    for batch, files in batches.toLocalIterator():
        so_far += files
        rows.append((batch, files, so_far, listed - so_far))
    return spark.createDataFrame(rows, "batch_id BIGINT, files BIGINT, taken BIGINT, queued BIGINT")


def batch_tasks(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """One row per batch that this application ran of the flow: the tasks that finished
    in its jobs, from the session's own log, which the last runs stay in."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    stages = spark.sparkContext._jsc.sc().statusStore()
    tasks: dict[int, int] = {}
    for i in range(runs.size()):
        run = runs.apply(i)
        told = re.search(rf"id = {query.id}\b.*batch = ([0-9]+)", run.description(), re.DOTALL)
        if told:
            batch, each = int(told[1]), run.stages().iterator()
            tasks.setdefault(batch, 0)
            while each.hasNext():
                try:
                    tasks[batch] += stages.lastStageAttempt(each.next()).numCompleteTasks()
                except Py4JJavaError:
                    # A stage that was planned but skipped has no entry.
                    continue
    return spark.createDataFrame(sorted(tasks.items()), "batch_id BIGINT, tasks INT")
