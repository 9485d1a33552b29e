"""Named queries: several SQL texts over one table, one output for each."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from threading import Lock

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lakejobs.plans.report import measured, report_frame, report_row, scan_facts

OUTPUTS_AT_ONCE = 4
#: The name that the SQL calls a table by belongs to the whole session.
ANALYSIS = Lock()


@dataclass
class NamedOutputs:
    """The outputs by name, and ``(name, query, message)`` of those that
    failed analysis, or later while running."""

    table: str
    source: DataFrame
    queries: dict[str, str]
    outputs: dict[str, DataFrame]
    failures: list[tuple[str, str, str]]

    def failure(self) -> DataFrame:
        """The failed queries as a DataFrame."""
        return self.source.sparkSession.createDataFrame(
            self.failures, "name STRING, query STRING, message STRING"
        )


@contextmanager
def _visible_as(df: DataFrame, name: str) -> Iterator[None]:
    """Make ``df`` readable as ``name`` in SQL; a temporary view of that name
    that was there before comes back afterwards."""
    spark = df.sparkSession
    known = spark.catalog.tableExists(name) and spark.catalog.getTable(name).isTemporary
    previous = spark.table(name) if known else None
    df.createOrReplaceTempView(name)
    try:
        yield
    finally:
        if previous is None:
            # Unlike dropTempView this leaves df cached, if it was.
            spark.sql(f"DROP VIEW `{name}`")
        else:
            previous.createOrReplaceTempView(name)


def run_named(df: DataFrame, table: str, queries: dict[str, str]) -> NamedOutputs:
    """Analyse each query over ``df``, which the SQL calls by the last part of
    ``table``. Nothing is executed here.

    Every output has its own plan with its own pruning, so ``df`` is not cached.
    A query that fails analysis does not stop the others.
    """
    spark: SparkSession = df.sparkSession
    outputs: dict[str, DataFrame] = {}
    failures = []
    with ANALYSIS, _visible_as(df, table.rpartition(".")[2]):
        for name, query in queries.items():
            try:
                outputs[name] = spark.sql(query)
            except PySparkException as error:
                failures.append((name, query, str(error)))
    return NamedOutputs(table, df, queries, outputs, failures)


def tagged_json(named: NamedOutputs) -> DataFrame:
    """All output rows in one frame: ``name`` and the row as JSON."""
    none = named.source.sparkSession.createDataFrame([], "name STRING, record STRING")
    parts = [
        df.select(F.lit(name).alias("name"), F.to_json(F.struct("*")).alias("record"))
        for name, df in named.outputs.items()
    ]
    return reduce(DataFrame.union, parts) if parts else none


def write_named(named: NamedOutputs, path: str | None, file_format: str = "json") -> DataFrame:
    """Write every output to ``path/<name>`` and return the scan report, one
    row per output. ``path=None`` runs the queries without keeping the rows.

    The rows are counted while they are written, all of them, in however many
    files they end up. A few outputs are written at a time, so that one with
    few tasks does not leave the cluster idle. An output that fails while it runs
    is added to the failures; the others are written and reported.
    """
    whole = scan_facts(named.source)

    def write(name: str) -> tuple:
        df = named.outputs[name]
        facts = scan_facts(df)
        written = Observation()
        counted = df.observe(written, F.count(F.lit(1)).alias("n"))
        with measured(df.sparkSession) as run:
            if path is None:
                counted.write.format("noop").mode("overwrite").save()
            else:
                counted.write.format(file_format).mode("overwrite").save(f"{path}/{name}")
        query, ran = named.queries[name], run.figures()
        return report_row(name, query, written.get["n"], named.table, facts, whole, ran)

    def attempt(name: str) -> tuple | Exception:
        try:
            return write(name)
        except Exception as error:
            return error

    with ThreadPoolExecutor(OUTPUTS_AT_ONCE) as pool:
        results = dict(zip(named.outputs, pool.map(attempt, named.outputs)))
    failed = {name: r for name, r in results.items() if isinstance(r, Exception)}
    named.failures += [(name, named.queries[name], str(error)) for name, error in failed.items()]
    rows = [r for name, r in results.items() if name not in failed]
    return report_frame(named.source.sparkSession, rows)
