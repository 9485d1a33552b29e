"""Checked appends: align columns, route bad rows, compare counts."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakejobs.functions.values import convert
from lakejobs.session import scratch_dir
from lakejobs.sources.tables import append_rows, read_if_present

Rule = Callable[[dict[str, Column]], Column]


def match_columns(
    df: DataFrame, schema: StructType, extra: str = "error", missing: str = "error"
) -> DataFrame:
    """Put the columns of ``df`` in the order of ``schema``, by name.

    ``extra`` is ``error`` or ``drop``; ``missing`` is ``error`` or
    ``fill_null``.
    """
    have, want = set(df.columns), set(schema.names)
    if have - want and extra != "drop":
        raise ValueError(f"columns not in the table: {sorted(have - want)}")
    if want - have and missing != "fill_null":
        raise ValueError(f"columns missing: {sorted(want - have)}")
    return df.select(
        *[
            F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )


def align(
    df: DataFrame, schema: StructType, extra: str = "error", missing: str = "error"
) -> DataFrame:
    """Match the columns by name and cast them. A value that does not fit its
    type fails the write."""
    matched = match_columns(df, schema, extra, missing)
    return matched.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def append_by_name(
    df: DataFrame, table: str, schema: StructType, extra: str = "error", missing: str = "error"
) -> None:
    """Append rows to a table, matching columns by name."""
    append_rows(align(df, schema, extra, missing), table)


def typed_columns(df: DataFrame, schema: StructType) -> dict[str, Column]:
    """The columns of ``schema``, converted; null where a value does not fit."""
    have = df.schema
    return {
        f.name: convert(F.col(f.name), have[f.name].dataType, f.dataType).alias(f.name)
        for f in schema
    }


def judge(df: DataFrame, schema: StructType, rules: dict[str, Rule] | None = None) -> DataFrame:
    """Add ``reject_reason``: null for a row that can be stored, otherwise
    every reason why not. The columns are matched by name first.

    A value that does not convert to its column type is a reason. ``rules``
    maps a reason to a test on the converted columns; like a CHECK constraint
    it passes when the test is null.
    """
    df = match_columns(df, schema)
    typed = typed_columns(df, schema)
    reasons = [
        F.when(
            F.col(f.name).isNotNull() & typed[f.name].isNull(),
            F.lit(f"{f.name}: not {f.dataType.simpleString()}"),
        )
        for f in schema
        if df.schema[f.name].dataType != f.dataType
    ]
    for label, rule in (rules or {}).items():
        reasons.append(F.when(~rule(typed), F.lit(label)))
    return df.withColumn("reject_reason", F.nullif(F.concat_ws("; ", *reasons), F.lit("")))


def accepted(judged: DataFrame, schema: StructType) -> DataFrame:
    """The rows that can be stored, converted to the table's types."""
    typed = typed_columns(judged, schema)
    return judged.filter(F.col("reject_reason").isNull()).select(*typed.values())


def rejected(judged: DataFrame) -> DataFrame:
    """The rows that cannot, unconverted, with the reason."""
    return judged.filter(F.col("reject_reason").isNotNull())


def fingerprint(schema: StructType) -> list[Column]:
    """Aggregates that tell sets of rows of ``schema`` apart, repeats counted, in
    whatever order they are: two sums of independent 64-bit row hashes. They are added
    up in each task, and fingerprints of parts add up to that of the whole."""
    parts = []
    for field in schema:
        # Hashes pass over nulls, so these are told apart by a flag; maps have no hash.
        c = F.col(field.name)
        has_map = "map<" in field.dataType.simpleString()
        parts += [c.isNull(), F.to_json(F.struct(c)) if has_map else c]
    none = F.lit(0).cast("decimal(38,0)")
    return [
        F.coalesce(F.sum(F.xxhash64(F.lit(seed), *parts).cast("decimal(38,0)")), none).alias(f"print{seed}")
        for seed in (1, 2)
    ]


def append_with_rejects(
    df: DataFrame,
    table: str,
    schema: StructType,
    rejects_table: str,
    rules: dict[str, Rule] | None = None,
    fingerprints: dict[str, Observation] | None = None,
) -> tuple[int, int]:
    """Append the good rows to ``table`` and the others to ``rejects_table``.

    ``fingerprints`` are filled, by table, with those of the rows sent there.

    Returns the numbers of rows seen and rejected. Both are counted while the
    good rows are written. The input is read again only if some row was
    rejected, so it should be cheap to read, such as files. An input that is
    not the same the second time is an error, since a row could get lost.
    """
    judged = judge(df, schema, rules)

    def counted() -> tuple[Observation, DataFrame]:
        # Counting above the checks also has Spark run them once per row, where
        # it would otherwise test in the filter and again for the result.
        seen = Observation()
        rows, bad = F.count(F.lit(1)), F.count("reject_reason")
        return seen, judged.observe(seen, rows.alias("rows"), bad.alias("rejected"))

    def printed(sent: DataFrame, name: str) -> DataFrame:
        if fingerprints is None:
            return sent
        return sent.observe(fingerprints[name], *fingerprint(sent.schema))

    first, rows = counted()
    append_rows(printed(accepted(rows, schema), table), table)
    if first.get["rejected"]:
        second, rows = counted()
        append_rows(printed(rejected(rows), rejects_table), rejects_table)
        if first.get != second.get:
            raise RuntimeError(f"input changed between passes: {first.get}, then {second.get}")
    return first.get["rows"], first.get["rejected"]


def _has_files(rows: DataFrame) -> bool:
    """Whether the rows come from files; an absent table reads as no rows."""
    try:
        rows.select("_metadata.file_path")
    except AnalysisException:
        return False
    return True


def _newest(rows: DataFrame) -> tuple[int, datetime | None]:
    """Rows of a table, and the time of its last file. No column is read: the rows of a
    file stand in its footer."""
    if not _has_files(rows):
        return 0, None
    return tuple(rows.agg(F.count(F.lit(1)), F.max("_metadata.file_modification_time")).first())


def _since(rows: DataFrame, newest: datetime) -> DataFrame:
    """The rows of the files that are as new as ``newest``, with the file's name. Spark
    leaves the other files out when it plans the scan."""
    new = rows.filter(F.col("_metadata.file_modification_time") >= F.lit(newest))
    return new.withColumn("_file", F.col("_metadata.file_path"))


def append_verified(
    df: DataFrame,
    table: str,
    schema: StructType,
    rejects_table: str,
    rules: dict[str, Rule] | None = None,
) -> DataFrame:
    """Append as above and compare with what is stored: one row, ``ok`` when every
    input row is in the table or among the rejects, with the values it should have.

    Rows are compared by a fingerprint of all their columns, made of the judged input
    on one side, and of the files that this append has added on the other. Only these
    are read; files from before are told by their time, and by name where they are as
    new as the newest one. Counts before and after come from the footers.
    """
    spark: SparkSession = df.sparkSession
    judged = judge(df, schema, rules)
    shapes = {table: schema, rejects_table: judged.schema}

    def stored(name: str) -> DataFrame:
        return read_if_present(spark, name, shapes[name])

    state = {name: _newest(stored(name)) for name in shapes}
    old = {}
    for name, (_, newest) in state.items():
        if newest is not None:
            # Stored, so that files that are added later cannot get in.
            names = scratch_dir(spark, "files")
            _since(stored(name), newest).select("_file").distinct().write.parquet(names)
            old[name] = spark.read.parquet(names)

    def added(name: str) -> Row:
        rows, newest = stored(name), state[name][1]
        if newest is not None:
            rows = _since(rows, newest).join(old[name], "_file", "left_anti")
        return rows.agg(F.count(F.lit(1)).alias("rows"), *fingerprint(shapes[name])).first()

    expected: dict[str, Observation] = {table: Observation(), rejects_table: Observation()}
    rows, bad = append_with_rejects(df, table, schema, rejects_table, rules, expected)
    new = {name: added(name) for name in shapes}
    sent = [table, rejects_table] if bad else [table]
    same = all((new[name].print1, new[name].print2) == tuple(expected[name].get.values()) for name in sent)
    before, after = state[table][0], stored(table).count()
    written, refused = new[table].rows, new[rejects_table].rows
    ok = same and written + refused == rows and after == before + written
    return spark.createDataFrame(
        [(rows, before, written, refused, after, ok)],
        "input_rows BIGINT, rows_before BIGINT, written BIGINT, rejected BIGINT, "
        "rows_after BIGINT, ok BOOLEAN",
    )
