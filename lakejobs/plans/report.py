"""What a query will read, and what it has read: files, partitions, pushed filters,
columns, rows.

This is the only module that looks at the physical plan and at the figures of finished
runs through the JVM bridge. Without the bridge (Spark Connect) and for cached tables these fields
are null. Tables of catalog plug-ins describe their own scans: columns and
filters are reported, files and partitions are null.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class ScanFacts:
    """Totals over all file scans of a plan."""

    scans: int
    files: int | None
    partitions: int | None
    columns: list[str]
    partition_filters: str
    pushed_filters: str


def _items(scala_seq) -> list:
    return [scala_seq.apply(i) for i in range(scala_seq.size())]


# Scans of Spark's own file sources, and of catalog plug-ins.
FILES, PLUG_IN = "FileSourceScanExec", "BatchScanExec"

# Plan leaves that read no table.
NO_TABLE = {
    "LocalTableScanExec",
    "EmptyRelationExec",
    "OneRowRelationExec",
    "RangeExec",
    "ReusedExchangeExec",
    "ReusedSubqueryExec",
}


def _scans(plan) -> list | None:
    """The scan nodes below ``plan``, also under adaptive stages and in
    sub-queries; None if it reads something else, such as a cached table."""
    found, todo, seen = [], [plan], set()
    while todo:
        node = todo.pop()
        for query in _items(node.subqueries()):
            # A sub-query shows up at every use, but runs once.
            if query.semanticHash() not in seen:
                seen.add(query.semanticHash())
                todo.append(query)
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif kind in (FILES, PLUG_IN):
            found.append(node)
        else:
            children = _items(node.children())
            if not children and kind not in NO_TABLE:
                return None
            todo += children
    return found


def _metadata(scan, key: str) -> str:
    text = scan.metadata().apply(key)
    return re.sub(r"#\d+L?", "", text)


def scan_facts(df: DataFrame) -> ScanFacts | None:
    """Facts about the scans of ``df``, known once it is planned, before any
    data is read. Partition and file pruning happen at planning. None if they
    cannot be known."""
    if not hasattr(df, "_jdf"):
        return None
    scans = _scans(df._jdf.queryExecution().executedPlan())
    if scans is None:
        return None
    files = [s for s in scans if s.getClass().getSimpleName() == FILES]
    others = [s.scan() for s in scans if s.getClass().getSimpleName() == PLUG_IN]
    chosen = [scan.selectedPartitions() for scan in files]
    schemas = [s.requiredSchema() for s in files] + [s.readSchema() for s in others]
    pushed = [_metadata(s, "PushedFilters") for s in files] + [s.description() for s in others]
    return ScanFacts(
        scans=len(scans),
        files=None if others else sum(p.totalNumberOfFiles() for p in chosen),
        partitions=None if others else sum(p.partitionCount() for p in chosen),
        columns=list(dict.fromkeys(name for s in schemas for name in s.fieldNames())),
        partition_filters="; ".join(_metadata(s, "PartitionFilters") for s in files),
        pushed_filters="; ".join(pushed),
    )


@dataclass
class RunFigures:
    """What the scans of a finished run have read, summed up; None where unknown."""

    scans: int
    files_read: int | None
    rows_read: int | None


class Measured:
    """The runs that were started inside :func:`measured`."""

    def __init__(self, spark: SparkSession, mark: str) -> None:
        self.spark, self.mark = spark, mark
        runs = self._log().executionsList() if hasattr(spark, "_jsparkSession") else None
        #: The last run before; those of other threads may come in between later ones.
        self.last = runs.apply(runs.size() - 1).executionId() if runs and runs.size() else -1

    def _log(self):
        return self.spark._jsparkSession.sharedState().statusStore()

    def figures(self) -> RunFigures | None:
        """The figures of the finished runs, from the session's own log of executions,
        which the last ones stay in. None without the JVM bridge."""
        if not hasattr(self.spark, "_jsparkSession"):
            return None
        # The log hears of a run's end by the listener bus.
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        log = self._log()
        scans: list[dict[str, int]] = []
        runs = log.executionsList()
        for i in reversed(range(runs.size())):
            run = runs.apply(i)
            if run.executionId() <= self.last:
                break
            if run.description() == self.mark:
                scans += self._scans(log, run.executionId())

        def total(name: str) -> int | None:
            known = [s[name] for s in scans if name in s]
            return sum(known) if known else None

        return RunFigures(len(scans), total("number of files read"), total("number of output rows"))

    def _scans(self, log, run: int) -> Iterator[dict[str, int]]:
        values = log.executionMetrics(run)
        for node in _items(log.planGraph(run).allNodes()):
            if node.name().startswith(("Scan ", "BatchScan ")):
                shown = {}
                for metric in _items(node.metrics()):
                    value = values.get(metric.accumulatorId())
                    if value.isDefined() and re.fullmatch("[0-9,]+", value.get()):
                        shown[metric.name()] = int(value.get().replace(",", ""))
                yield shown


@contextmanager
def measured(spark: SparkSession) -> Iterator[Measured]:
    """Marks the runs that this thread starts inside, so that their figures can be told
    from those of others."""
    mark = f"measured-{uuid.uuid4().hex}"
    context = spark.sparkContext if hasattr(spark, "_jsparkSession") else None
    before = context.getLocalProperty("spark.job.description") if context else None
    if context:
        context.setJobDescription(mark)
    try:
        yield Measured(spark, mark)
    finally:
        if context:
            context.setLocalProperty("spark.job.description", before)


REPORT_COLUMNS = (
    "name STRING, query STRING, record_count BIGINT, namespace STRING, table STRING, "
    "partition_filters STRING, pushed_filters STRING, read_columns ARRAY<STRING>, "
    "files_total BIGINT, files_read BIGINT, files_skipped BIGINT, "
    "partitions_total BIGINT, partitions_read BIGINT, partitions_skipped BIGINT, rows_read BIGINT"
)


def report_row(
    name: str,
    query: str,
    records: int,
    table: str,
    facts: ScanFacts | None,
    whole: ScanFacts | None,
    ran: RunFigures | None = None,
) -> tuple:
    """One report row. ``whole`` are the facts of an unfiltered scan of the
    table; a query that scans it twice could have read twice as much. ``ran`` are the
    figures of the finished run: with them files are those opened while it ran, which
    may be fewer than those planned, and rows those left by row groups and pages."""
    namespace, _, bare = table.rpartition(".")
    head = (name, query, records, namespace or None, bare)
    rows = ran.rows_read if ran else None
    if facts is None:
        return (*head, *[None] * 9, rows)
    told = (*head, facts.partition_filters, facts.pushed_filters, facts.columns)
    if whole is None or facts.files is None or whole.files is None:
        return (*told, *[None] * 6, rows)
    times = max(facts.scans, 1)
    files, partitions = whole.files * times, whole.partitions * times
    opened = ran.files_read if ran and ran.scans == facts.scans and ran.files_read is not None else facts.files
    return (
        *told,
        files,
        opened,
        files - opened,
        partitions,
        facts.partitions,
        partitions - facts.partitions,
        rows,
    )


def report_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, REPORT_COLUMNS)
