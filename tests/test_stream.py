"""Ingestion flows: restarts, new files, rejects, repeated rows."""

import os
import time
import time

import pytest
from pyspark.sql.types import StructType

from lakejobs.streaming import ingest

RAW = StructType().add("id", "string").add("msg", "string")
SINK = StructType().add("id", "integer").add("msg", "string")


def add_files(spark, folder, start, n, files):
    rows = spark.range(start, start + n, 1, files)
    rows = rows.selectExpr("if(id % 10 = 9, 'x', cast(id AS STRING)) AS id", "'m' AS msg")
    rows.write.mode("append").parquet(f"{folder}/in")


def run(spark, folder, **options):
    stream = ingest.new_files(spark, f"{folder}/in", RAW, **options)
    query = ingest.append_stream(stream, f"{folder}/out", f"{folder}/checkpoint", SINK)
    query.awaitTermination()
    return query


def counts(spark, folder):
    good = ingest.accepted_rows(spark, f"{folder}/out", SINK)
    bad = ingest.rejected_rows(spark, f"{folder}/out")
    assert good.dtypes == [("id", "int"), ("msg", "string")]
    assert {r.reject_reason for r in bad.collect()} <= {"id: not int"}
    return good.count(), good.select("id").distinct().count(), bad.count()


def test_restart_adds_only_new_rows(spark, folder):
    add_files(spark, folder, 0, 100, 4)
    query = run(spark, folder, files_per_batch=1)
    progress = ingest.progress(spark, query).collect()
    assert len(progress) == 4
    assert [(r.rows_in, r.rows_out) for r in progress] == [(25, 25)] * 4
    assert sum(r.rejected for r in progress) == 10
    assert counts(spark, folder) == (90, 90, 10)
    run(spark, folder)
    assert counts(spark, folder) == (90, 90, 10)
    add_files(spark, folder, 100, 10, 1)
    run(spark, folder)
    assert counts(spark, folder) == (99, 99, 11)


def test_progress_remembers_more_batches_than_spark(spark, folder):
    key = "spark.sql.streaming.numRecentProgressUpdates"
    spark.conf.set(key, 2)
    try:
        add_files(spark, folder, 0, 40, 4)
        stream = ingest.new_files(spark, f"{folder}/in", RAW, files_per_batch=1)
        query = ingest.append_stream(stream, f"{folder}/out", f"{folder}/checkpoint", SINK)
        query.awaitTermination()
        for _ in range(50):
            rows = ingest.progress(spark, query).collect()
            if len(rows) == 4:
                break
            time.sleep(0.2)
        assert sum(r.rows_in for r in rows) == 40
    finally:
        spark.conf.unset(key)


def batches(spark, folder, name="flow"):
    stream = ingest.new_files(spark, f"{folder}/in", RAW, files_per_batch=1)
    query = ingest.append_batches(stream, f"{folder}/out", f"{folder}/cp-{name}", name)
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def test_batches_restart_and_share_the_folder(spark, folder):
    add_files(spark, folder, 0, 60, 3)
    out = batches(spark, folder)
    assert out.count() == 60 and out.select("batch_id").distinct().count() == 3
    assert batches(spark, folder).count() == 60
    add_files(spark, folder, 60, 7, 1)
    assert batches(spark, folder).count() == 67
    spark.range(5).selectExpr("cast(id AS STRING) AS id", "'m' AS msg").write.parquet(
        f"{folder}/out/flow=manual/batch_id=0"
    )
    assert spark.read.parquet(f"{folder}/out").count() == 72
    assert batches(spark, folder, "second").count() == 72 + 67


def test_replayed_batch_replaces_itself(spark, folder):
    add_files(spark, folder, 0, 20, 1)
    assert batches(spark, folder).count() == 20
    # The commit of the batch is lost, as when the driver dies after the write.
    for name in ("0", ".0.crc"):
        os.remove(f"{folder}/cp-flow/commits/{name}")
    assert batches(spark, folder).count() == 20


def test_repeating_rows(spark, folder):
    rows = [(1, "a", "t1"), (2, "b", "t2"), (3, None, "t3")]
    stream = ingest.repeating_rows(spark, rows, "id INT, msg STRING, ts STRING")
    assert stream.isStreaming
    query = ingest.append_batches(stream, f"{folder}/out", f"{folder}/cp", "rows", "1 second")
    try:
        query.awaitTermination(12)
    finally:
        query.stop()
    assert query.exception() is None
    out = spark.read.parquet(f"{folder}/out")
    per_batch = out.groupBy("batch_id").count().collect()
    assert len(per_batch) > 1 and {r["count"] for r in per_batch} == {3}
    assert {tuple(r) for r in out.select("id", "msg", "ts").collect()} == set(rows)


def test_schedule(spark, folder):
    add_files(spark, folder, 0, 10, 1)
    stream = ingest.new_files(spark, f"{folder}/in", RAW)
    query = ingest.append_stream(
        stream, f"{folder}/out", f"{folder}/checkpoint", SINK, every=ingest.HOURLY
    )
    try:
        # The first batch runs at once, the next one is an hour away.
        deadline = time.monotonic() + 60
        while not query.recentProgress and time.monotonic() < deadline:
            time.sleep(0.2)
        assert query.isActive
    finally:
        query.stop()
    assert counts(spark, folder) == (9, 9, 1)


def test_missing_column_stops_before_it_starts(spark, folder):
    add_files(spark, folder, 0, 10, 1)
    stream = ingest.new_files(spark, f"{folder}/in", RAW).select("id")
    with pytest.raises(ValueError, match="msg"):
        ingest.append_stream(stream, f"{folder}/out", f"{folder}/checkpoint", SINK)


def test_queue_and_restart_in_the_middle(spark, folder):
    schema = StructType().add("id", "string").add("msg", "string")
    spark.range(0, 12, 1, 12).selectExpr("IF(id % 4 = 0, 'x', CAST(id AS STRING)) AS id", "'m' AS msg").write.parquet(f"{folder}/in")
    sink = StructType().add("id", "integer").add("msg", "string")

    def start(every=None):
        rows = ingest.new_files(spark, f"{folder}/in", schema, files_per_batch=3)
        return ingest.append_stream(rows, f"{folder}/out", f"{folder}/check", sink, every=every, typed=True)

    ingest.stop_after(start(every="0 seconds"), 2)
    seen = {r.batch_id: (r.files, r.taken, r.queued) for r in ingest.queue(spark, f"{folder}/in", f"{folder}/check").collect()}
    assert seen[0] == (3, 3, 9) and seen[1] == (3, 6, 6)
    query = start()
    query.awaitTermination()
    assert sorted(r.queued for r in ingest.queue(spark, f"{folder}/in", f"{folder}/check").collect()) == [0, 3, 6, 9]
    stored = ingest.typed_rows(spark, f"{folder}/out", sink)
    assert stored.dtypes == [("id", "int"), ("msg", "string")]
    assert sorted(r.id for r in stored.collect()) == [i for i in range(12) if i % 4]
    assert [tuple(r) for r in ingest.untyped_rejects(spark, f"{folder}/out").collect()] == [("x", "m", "id: not int")] * 3
    # New files wait until the next run.
    spark.range(20, 22, 1, 2).selectExpr("CAST(id AS STRING) AS id", "'m' AS msg").write.mode("append").parquet(f"{folder}/in")
    last = ingest.queue(spark, f"{folder}/in", f"{folder}/check").orderBy("batch_id").collect()[-1]
    assert (last.taken, last.queued) == (12, 2)
    tasks = {r.batch_id: r.tasks for r in ingest.batch_tasks(spark, query).collect()}
    assert set(tasks) >= {2, 3} and all(n > 0 for n in tasks.values())
