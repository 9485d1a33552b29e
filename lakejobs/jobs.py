"""The registered queries: each operator over the given tables.

Every function takes the session and the folder of the tables and returns a
DataFrame. Jobs that write do so below ``scratch_dir`` and read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakejobs.functions import jsoncols, text
from lakejobs.functions.values import pick_by_remainder, simple_case
from lakejobs.operators import retry
from lakejobs.operators.append import (
    append_by_name,
    append_verified,
    append_with_rejects,
)
from lakejobs.operators.ordering import distinct_sorted, first_match, latest, order_by
from lakejobs.plans.named import NamedOutputs, run_named, tagged_json, write_named
from lakejobs.plans.profile import file_statistics, profile_all
from lakejobs.plans.sketches import column_sketches, estimates, merged
from lakejobs.session import load, scratch_dir
from lakejobs.sources import flights as demo
from lakejobs.sources.jsonshapes import inferred_records
from lakejobs.sources.clustered import write_clustered
from lakejobs.sources.jsonrows import as_json, explode_records, judged_records, read_records, write_records
from lakejobs.sources.tables import append_rows, read_table, replace_partitions, spread, write_dealt
from lakejobs.sources.tables import rebuild_partitioned as rebuild
from lakejobs.streaming import ingest

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Distance between the flight ids of two months; far above any order key.
FLIGHT_BLOCK = 10**12

FILES_PER_MONTH = 3

FLIGHT_QUERIES = {
    "pruned": "SELECT flight_num, dest, distance FROM flights WHERE flight_month = '2026-07'",
    "delayed": "SELECT flight_num, flight_month, dep_delay, distance FROM flights "
    "WHERE origin = 'DEN' AND dep_delay BETWEEN 60 AND 90",
    "carrier_stats": "SELECT carrier_code, origin, count(*) AS legs, "
    "avg(distance) AS mean_distance FROM flights GROUP BY carrier_code, origin",
}

LINEITEM_QUERIES = {
    "all": "SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem",
    "filtered": "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem "
    "WHERE l_returnflag = 'A'",
    "by_flag": "SELECT l_returnflag, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag",
}

LITERAL_SUPPLIERS = [
    (-1, "Literal supplier one", 0, 10.5),
    (-2, "Literal supplier two", 1, 20.25),
    (-3, "Literal supplier three", 2, 0.0),
]

# As text, which reads the same in every time zone.
SHIPPED_FROM, SHIPPED_TO = "1997-03-01 00:00:00", "1997-04-30 00:00:00"

LAST_REPEATED = "2024-01-10"
SHIP_DAYS, PARTS, ORDERS = ("1996-01-01", "1996-06-30"), (20, 120), [7, 64, 320, 999]

SINK = StructType().add("id", "integer").add("msg", "string").add("source", "string")
SINK.add("ts", "string")
SINK_RULES = {
    "k of 90 or more": lambda c: F.get_json_object(c["source"], "$.k").cast("int") < 90
}

# Text derived from the given tables, in SQL that the oracle can use as well.
INCOMING = {
    "id": "CASE WHEN event_type = 'error' THEN concat('e', event_id) "
    "ELSE concat('', event_id * 1000000) END",
    "msg": "event_type",
    "source": "props",
    "ts": "substr(CAST(ts AS STRING), 1, 19)",
}
RESPONSE = """CASE
    WHEN c_custkey % 13 = 0 THEN NULL
    WHEN c_custkey % 11 = 0 THEN concat('{"config": ', c_name)
    WHEN c_custkey % 7 = 0 THEN concat('{"location":"', c_name, '"}')
    ELSE concat('{"location":"', c_name, '","config":{"token":"',
        CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END, '"',
        CASE WHEN c_custkey % 3 = 0 THEN concat(',"region":"n', c_nationkey, '"') ELSE '' END,
        ',"account":"', c_custkey, '"}}')
    END"""
ITEM_LIST = """CASE
    WHEN p_partkey % 17 = 0 THEN '{"other":1}'
    WHEN p_partkey % 5 = 0 THEN '{"items":[]}'
    ELSE concat('{"items":[{"name":"size","value":"', p_size, '"},{"value":"unnamed"},',
        '{"name":"label","value":"', p_name, '"},{"name":"label","value":"', p_brand, '"},',
        '{"name":"type","value":"', p_type, '"}]}')
    END"""
RECORDS = """CASE
    WHEN p_partkey % 2 = 0 THEN concat('[{"id":', p_partkey, ',"msg":"', p_name, '"},',
        '{"id":', p_partkey + 1, ',"msg":"', p_brand, '"}]')
    ELSE concat('{"id":', p_partkey, ',"msg":"', p_type, '"}')
    END"""
SHAPES = """CASE p_partkey % 6
    WHEN 0 THEN concat('[{"id":', p_partkey, ',"msg":"a","price":', p_size, '},{"id":', p_partkey, ',"price":0.5}]')
    WHEN 1 THEN concat('{"id":"x', p_partkey, '"}')
    WHEN 2 THEN concat(' {"id":', p_partkey, ',"size":{"v":', p_size, '},"msg":null}')
    WHEN 3 THEN concat('[{"id":', p_partkey, '},', p_size, ']')
    WHEN 4 THEN concat('{"id":', p_partkey)
    ELSE '[]' END"""
DIRTY_RECORDS = """CASE p_partkey % 4
    WHEN 0 THEN concat('[{"id":', p_partkey, ',"msg":"a"},{"id":', p_partkey, ',"msg":"b"}]')
    WHEN 1 THEN concat('{"id":', p_partkey, '}')
    WHEN 2 THEN concat('{"id":"x', p_partkey, '","msg":"c"}')
    ELSE concat('[{"id":', p_partkey, ',"msg":"d"},') END"""
SCRIPT = "replace(replace(text, '. ', concat(';', chr(10))), concat(chr(10), 'E'), concat(chr(10), ' -- E'))"


# Scans, projections, filters


def scan_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").select("*")


def project_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")


def filter_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").filter(F.col("c_mktsegment") == "BUILDING")


def filter_conj(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem")
    wanted = (F.col("l_quantity") > 45) & (F.col("l_returnflag") == "A")
    return lines.filter(wanted).select("l_orderkey", "l_linenumber", "l_quantity")


def _events_by_day(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """Events written by day; the folder and the table read from it."""
    events = load(spark, sf_dir, "events")
    events = events.withColumn("day", F.col("ts").cast("date").cast("string"))
    path = scratch_dir(spark, "events")
    rebuild(events, path, "day")
    return path, read_table(spark, path, events.schema)


def partition_pruned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, events = _events_by_day(spark, sf_dir)
    return events.filter(F.col("day") == "2024-01-02").select(
        "event_id", "event_type", "value", "day"
    )


def append_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day, appended a second time with the columns in another order
    and the partition column in the middle."""
    path, events = _events_by_day(spark, sf_dir)
    again = load(spark, sf_dir, "events")
    again = again.withColumn("day", F.col("ts").cast("date").cast("string"))
    again = again.select("value", "ts", "day", "props", "event_id", "user_id", "event_type")
    append_by_name(again, path, events.schema)
    return read_table(spark, path, events.schema).select("event_id", "event_type", "value", "day")


def append_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day; the first ten days are then appended again, twice, with other
    values, as by a run that is repeated."""
    path, events = _events_by_day(spark, sf_dir)
    again = events.filter(F.col("day") <= LAST_REPEATED).withColumn("value", F.col("value") * 2)
    scratch = scratch_dir(spark, "again")
    again.write.parquet(scratch)
    for _ in range(2):
        replace_partitions(spark.read.parquet(scratch), path)
    return read_table(spark, path, events.schema).select("event_id", "event_type", "value", "day")


# Aggregation, sorting, set operations


def count_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("n"))


def group_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def group_count_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count and average per return flag, as a named query."""
    query = (
        "SELECT l_returnflag, COUNT(*) AS n, ROUND(AVG(l_quantity), 6) AS avg_quantity "
        "FROM lineitem GROUP BY l_returnflag"
    )
    named = run_named(load(spark, sf_dir, "lineitem"), "lineitem", {"flag_stats": query})
    return named.outputs["flag_stats"]


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = load(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", "c_name")
    return order_by(customers, "c_mktsegment", tie_break=("c_custkey",))


def literal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy of a given table with literal rows inserted."""
    suppliers = load(spark, sf_dir, "supplier")
    path = scratch_dir(spark, "literal")
    append_rows(suppliers, path)
    literal = spark.createDataFrame(LITERAL_SUPPLIERS, suppliers.schema)
    append_by_name(literal, path, suppliers.schema)
    return read_table(spark, path)


def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation keys of customers and suppliers, duplicates kept."""
    customers = load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nationkey"))
    suppliers = load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nationkey"))
    return customers.unionByName(suppliers)


def cross_join_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product of all order keys with the digits 0..9, as numbers."""
    keys = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("n"))
    return demo.add_digit(keys, "n")


def latest_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = load(spark, sf_dir, "events").filter(F.col("event_type") == "error")
    line = text.log_line(F.col("event_type"), F.col("user_id"), F.col("props"))
    return latest(errors, "ts", "event_id", 20).select("event_id", line.alias("line"))


def distinct_langs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_sorted(load(spark, sf_dir, "documents"), "lang")


def explode_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first turn of the user in each conversation."""
    turns = load(spark, sf_dir, "conversations")
    return first_match(turns, "conv_id", F.col("role") == "user", "turn", "text")


# Generated tables


def _flights(spark: SparkSession, sf_dir: str, read_once: bool = False) -> DataFrame:
    """Flights for every order key. Branches for the months let a filter on the month
    make only its own; ``read_once`` reads the keys once where all months are wanted."""
    keys = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("r"))
    keys = spread(keys) if read_once else keys
    return demo.flights(keys, months=12, block=FLIGHT_BLOCK, read_once=read_once)


def _flights_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    flights = _flights(spark, sf_dir, read_once=True)
    path = scratch_dir(spark, "flights")
    rebuild(flights, path, "flight_month", clustered=True)
    return read_table(spark, path, flights.schema)


def gen_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flights(spark, sf_dir)


def rebuild_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _flights_table(spark, sf_dir)
        .groupBy("flight_month")
        .agg(F.count(F.lit(1)).alias("n"), F.max("flight_id").alias("last_id"))
    )


def expr_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.lit(5000) - F.col("o_orderkey")
    states = {"F": "finished", "O": "open"}
    return load(spark, sf_dir, "orders").select(
        "o_orderkey",
        pick_by_remainder(v, demo.CARRIERS).alias("carrier"),
        pick_by_remainder(v, demo.ORIGINS).alias("origin"),
        pick_by_remainder(v, demo.DESTINATIONS).alias("dest"),
        simple_case(F.col("o_orderstatus"), states, "other").alias("state"),
        F.pmod(v * 7, F.lit(140)).alias("remainder"),
        (F.pmod(v * 13, F.lit(9000)) + 1000).cast("int").alias("num"),
        (v * 3 - 15).cast("bigint").alias("scaled"),
        F.lit("2026-01").alias("month"),
    )


# Named queries and scan report


def _named_flights(spark: SparkSession, sf_dir: str) -> NamedOutputs:
    return run_named(_flights(spark, sf_dir), "flights", FLIGHT_QUERIES)


def flights_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named_flights(spark, sf_dir).outputs["pruned"]


def flights_delayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named_flights(spark, sf_dir).outputs["delayed"]


def flights_carrier_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = _named_flights(spark, sf_dir).outputs["carrier_stats"]
    return stats.withColumn("mean_distance", F.round("mean_distance", 6))


def named_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem")
    return tagged_json(run_named(lines, "lineitem", LINEITEM_QUERIES))


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report over a table of which the number of files is known."""
    flights = _flights(spark, sf_dir, read_once=True)
    path = scratch_dir(spark, "report")
    write_dealt(flights, path, "flight_month", [f"{demo.YEAR}-{m:02d}" for m in range(1, 13)], FILES_PER_MONTH, "flight_id")
    named = run_named(read_table(spark, path, flights.schema), "demo.flights", FLIGHT_QUERIES)
    return write_named(named, scratch_dir(spark, "named"))


def scan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole report: what was pushed down, and what was read as the queries ran."""
    return _report(spark, sf_dir).withColumn("read_columns", F.array_join("read_columns", ","))


# Clustered tables


def zone_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File statistics of events by day, summed up to one row per day."""
    _, events = _events_by_day(spark, sf_dir)
    files = file_statistics(events, ["value"], partition_columns=("day",))
    return files.groupBy(F.col("day__min").alias("day")).agg(
        F.sum("rows").alias("rows"),
        F.min("value__min").alias("min_value"),
        F.max("value__max").alias("max_value"),
        F.sum("value__nulls").alias("nulls"),
    )


def _clustered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem clustered by ship day and part, with bloom filters on the order."""
    lines = load(spark, sf_dir, "lineitem")
    # Time stamps without a zone are not pushed into Parquet files; dates are.
    lines = lines.withColumn("ship_day", F.col("l_shipdate").cast("date"))
    path = scratch_dir(spark, "lineitem")
    write_clustered(lines, path, ["ship_day", "l_partkey"], bloom={"l_orderkey": 1_000_000})
    return read_table(spark, path)


def skipping_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two months of lineitem, by one of the columns that it is clustered by."""
    day = F.col("ship_day")
    wanted = (day >= SHIPPED_FROM[:10]) & (day <= SHIPPED_TO[:10]) & (F.col("l_quantity") > 10.0)
    # The days hold the times asked for, and up to one day more.
    times = (F.col("l_shipdate") >= F.lit(SHIPPED_FROM).cast("timestamp_ntz")) & (
        F.col("l_shipdate") < F.lit(SHIPPED_TO).cast("timestamp_ntz")
    )
    return _clustered_lines(spark, sf_dir).filter(wanted & times).select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"
    )


def clustered_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box in both columns that lineitem is clustered by."""
    day, part = F.col("ship_day"), F.col("l_partkey")
    box = day.between(*SHIP_DAYS) & part.between(*PARTS)
    return _clustered_lines(spark, sf_dir).filter(box).select(
        "l_orderkey", "l_linenumber", "l_partkey", "ship_day", "l_extendedprice"
    )


def key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of a few orders, found by bloom filters and dictionaries."""
    return _clustered_lines(spark, sf_dir).filter(F.col("l_orderkey").isin(ORDERS)).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"
    )


# Appends


def _incoming(events: DataFrame) -> DataFrame:
    """Events as raw text records for the sink table."""
    return events.select(*[F.expr(sql).alias(name) for name, sql in INCOMING.items()])


def _routed(good: DataFrame, bad: DataFrame) -> DataFrame:
    """Stored and refused rows in one frame, told apart by ``outcome``."""
    good = good.select(
        F.lit("accepted").alias("outcome"),
        *[F.col(c).cast("string").alias(c) for c in SINK.names],
        F.lit(None).cast("string").alias("reject_reason"),
    )
    return good.unionByName(bad.select(F.lit("rejected").alias("outcome"), *bad.columns))


def append_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in another column order, appended by name."""
    suppliers = load(spark, sf_dir, "supplier")
    path = scratch_dir(spark, "byname")
    append_by_name(suppliers.select(*reversed(suppliers.columns)), path, suppliers.schema)
    return read_table(spark, path, suppliers.schema)


def append_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    incoming = _incoming(load(spark, sf_dir, "events"))
    path = scratch_dir(spark, "append")
    append_with_rejects(incoming, f"{path}/table", SINK, f"{path}/rejects", SINK_RULES)
    return _routed(read_table(spark, f"{path}/table"), read_table(spark, f"{path}/rejects"))


def append_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The check of a second append to the same table."""
    incoming = _incoming(load(spark, sf_dir, "events"))
    path = scratch_dir(spark, "verify")
    target = (f"{path}/table", SINK, f"{path}/rejects", SINK_RULES)
    append_with_rejects(incoming, *target)
    return append_verified(incoming, *target)


#: The first run takes the events below this id, the second one the others and
#: some of the first once more.
FIRST_RUN = 600


def append_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs; the second one has a wider rule, takes up the rejects of the first, and
    gets some rows that are stored already."""
    events = load(spark, sf_dir, "events")
    path = scratch_dir(spark, "retry")
    raw = _incoming(events).schema
    wider = {"k of 95 or more": lambda c: F.get_json_object(c["source"], "$.k").cast("int") < 95}
    first = events.filter(F.col("event_id") < FIRST_RUN)
    second = events.filter((F.col("event_id") >= FIRST_RUN) | (F.col("event_id") % 10 == 0))
    retry.append_run(_incoming(first), path, 1, SINK, "id", SINK_RULES, max_attempts=2)
    retry.append_run(_incoming(second), path, 2, SINK, "id", wider, max_attempts=2)
    stored = retry.stored_rows(spark, path, raw, SINK).select(
        F.lit("accepted").alias("outcome"), *[F.col(c).cast("string").alias(c) for c in SINK.names],
        F.lit(None).cast("int").alias("attempt"), F.lit(None).cast("string").alias("reject_reason"),
    )
    kept = ["outcome", *SINK.names, "attempt", "reject_reason"]
    waiting = retry.waiting_rows(spark, path, raw, 2).withColumn("outcome", F.lit("retry"))
    dead = retry.dead_letters(spark, path, raw).withColumn("outcome", F.lit("dead"))
    return stored.unionByName(waiting.select(kept)).unionByName(dead.select(kept))


# JSON


def _json_events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    events = load(spark, sf_dir, "events").drop("ts")
    path = scratch_dir(spark, "json")
    write_records(events, path)
    return events, path


def json_infer_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, path = _json_events(spark, sf_dir)
    return read_records(spark, path).select(events.columns)


def json_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, path = _json_events(spark, sf_dir)
    return read_records(spark, path, events.schema)


def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row as one JSON object."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return as_json(orders)


def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records from texts that hold an array of objects or one object."""
    fields = StructType().add("id", "long").add("msg", "string")
    return explode_records(load(spark, sf_dir, "part"), F.expr(RECORDS), fields)


def json_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records from texts that are whole, mistyped or cut off, good and bad ones."""
    fields = StructType().add("id", "long").add("msg", "string")
    return judged_records(load(spark, sf_dir, "part"), F.expr(DIRTY_RECORDS), fields)


def json_infer_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records from texts of several writers: arrays, single objects, nested ones, ids as
    numbers and as text, and texts that are cut off; the shape is inferred."""
    records = inferred_records(load(spark, sf_dir, "part"), F.expr(SHAPES))
    return records.select("id", "msg", "price", F.col("size.v").alias("size_v"), "rejected")


def json_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = jsoncols.sorted_keys(F.expr(RESPONSE), "$.config")
    return load(spark, sf_dir, "customer").select(
        "c_custkey", F.array_join(keys, ",").alias("keys"), F.size(keys).alias("n_keys")
    )


def json_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    response = F.expr(RESPONSE)
    return load(spark, sf_dir, "customer").select(
        "c_custkey",
        F.get_json_object(response, "$.location").alias("location"),
        jsoncols.has_field(response, "$.config", "token").alias("has_token"),
        jsoncols.field_or(response, "$.config", "region", "none").alias("region"),
    )


def _part_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = jsoncols.items_at(F.expr(ITEM_LIST), "$.items", "name STRING, value STRING")
    return load(spark, sf_dir, "part").select("p_partkey", items.alias("items"))


def json_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All items called ``label``."""
    items = _part_items(spark, sf_dir).select("p_partkey", F.explode("items").alias("item"))
    return items.filter(F.col("item.name") == "label").select("p_partkey", "item.value")


def json_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first item called ``label`` in each list."""
    value = jsoncols.first_named(F.col("items"), "label", "value")
    return _part_items(spark, sf_dir).select("p_partkey", value.alias("value"))


def list_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = jsoncols.join_names(F.col("items"))
    return _part_items(spark, sf_dir).select("p_partkey", names.alias("names"))


# Text


def split_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of the documents, read as SQL scripts."""
    scripts = load(spark, sf_dir, "documents").select("doc_id", F.expr(SCRIPT).alias("script"))
    statements = text.split_statements(scripts, "script", "doc_id")
    head = text.cut(text.first_line(F.col("statement")), 80)
    return statements.withColumn("head", head)


def string_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    url, html = F.col("url"), F.col("html")
    return load(spark, sf_dir, "pages").select(
        "page_id",
        text.cut(text.first_line(html), 80).alias("head"),
        text.cut(html, 300).alias("start"),
        F.length(html).alias("n_chars"),
        text.nth_field(url, "/", 3).alias("host"),
        text.before(url, "-").alias("before_dash"),
        text.delete_chars(url, "?&=").alias("plain"),
        text.replace_char(url, "/", " ").alias("spaced"),
        text.append_if_absent(url, "ref=", "#ref=none").alias("with_ref"),
    )


# Catalog contents


def table_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column of every given table."""
    return profile_all({name: load(spark, sf_dir, name) for name in TABLES}, integers=True)


def profile_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns with few values, sketched by return flag and merged; distinct counts of so
    few values are exact, and the smallest and largest value are kept."""
    columns = ["l_linenumber", "l_quantity", "l_discount", "l_tax", "l_linestatus"]
    parts = column_sketches(load(spark, sf_dir, "lineitem"), ["l_returnflag"], columns)
    path = scratch_dir(spark, "sketches")
    parts.write.partitionBy("l_returnflag").parquet(path)
    figures = estimates(merged(spark.read.parquet(path)), (0.0, 1.0))
    ends = [F.get("quantiles", i).alias(name) for i, name in enumerate(("smallest", "largest"))]
    return figures.select("column", "rows", "nulls", "distinct_values", *ends)


# Streaming


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = load(spark, sf_dir, "events").schema
    # The pattern matches the one name, be it a file or a folder.
    return ingest.new_files(spark, f"{sf_dir}/events.parque[t]", schema)


#: Files that the events of the flow arrive in, and files of a batch.
STREAM_FILES, FILES_PER_BATCH = 16, 2


def _arrived(spark: SparkSession, sf_dir: str) -> tuple[str, StructType]:
    """A folder of files made from the events, and their schema."""
    events = load(spark, sf_dir, "events")
    path = scratch_dir(spark, "arrived")
    place = F.pmod("event_id", F.lit(STREAM_FILES)).cast("int")
    events.repartitionById(STREAM_FILES, place).write.parquet(path)
    return path, events.schema


def _run_append(spark: SparkSession, sf_dir: str, stop: int | None = None):
    """The flow over all files, several batches; stopped and started again after
    ``stop`` batches. The last query and its folder."""
    source, schema = _arrived(spark, sf_dir)
    path = scratch_dir(spark, "stream")
    rows = _incoming(ingest.new_files(spark, source, schema, files_per_batch=FILES_PER_BATCH))
    target = (rows, f"{path}/rows", f"{path}/checkpoint", SINK, SINK_RULES)
    if stop is not None:
        ingest.stop_after(ingest.append_stream(*target, every="0 seconds", typed=True), stop)
    query = ingest.append_stream(*target, typed=True)
    query.awaitTermination()
    return query, source, path


def stream_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ingestion with rejects in several batches, stopped after three and restarted."""
    _, _, path = _run_append(spark, sf_dir, stop=3)
    stored = ingest.typed_rows(spark, f"{path}/rows", SINK)
    return _routed(stored, ingest.untyped_rejects(spark, f"{path}/rows"))


def stream_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run-once ingestion into replaceable batch folders."""
    path = scratch_dir(spark, "batches")
    events = _event_stream(spark, sf_dir).select("event_id", "user_id", "event_type", "value")
    query = ingest.append_batches(events, f"{path}/rows", f"{path}/checkpoint", "events")
    query.awaitTermination()
    return spark.read.parquet(f"{path}/rows").drop("flow", "batch_id")


def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batches of an ingestion: rows in and out up to each, files taken and waiting,
    and whether tasks ran. Which files are in a batch is up to their times, so rows are
    given for the flow as a whole."""
    query, source, path = _run_append(spark, sf_dir)
    totals = ingest.progress(spark, query).agg(
        F.sum("rows_in").alias("rows_in"),
        F.sum("rows_out").alias("rows_out"),
        F.sum("rejected").alias("rejected"),
    ).first()
    batches = ingest.queue(spark, source, f"{path}/checkpoint")
    batches = batches.join(ingest.batch_tasks(spark, query), "batch_id", "left")
    batches = batches.withColumn("has_tasks", F.coalesce(F.col("tasks") > 0, F.lit(False)))
    flow = [F.lit(totals[c]).cast("long").alias(c) for c in ("rows_in", "rows_out", "rejected")]
    return batches.select("batch_id", "files", "queued", "has_tasks", *flow)


QUERIES = {
    "scan_all": scan_all,
    "project_cols": project_cols,
    "filter_eq": filter_eq,
    "filter_conj": filter_conj,
    "partition_pruned_scan": partition_pruned_scan,
    "count_all": count_all,
    "group_count": group_count,
    "group_count_avg": group_count_avg,
    "order_by": order_rows,
    "literal_rows": literal_rows,
    "union_all": union_all,
    "cross_join_numbers": cross_join_numbers,
    "latest_n": latest_n,
    "distinct_sorted": distinct_langs,
    "explode_first": explode_first,
    "gen_flights": gen_flights,
    "rebuild_partitioned": rebuild_partitioned,
    "expr_pack": expr_pack,
    "flights_pruned": flights_pruned,
    "flights_delayed": flights_delayed,
    "flights_carrier_stats": flights_carrier_stats,
    "named_queries": named_queries,
    "scan_report": scan_report,
    "zone_map": zone_map,
    "skipping_scan": skipping_scan,
    "clustered_scan": clustered_scan,
    "key_lookup": key_lookup,
    "append_by_name": append_columns,
    "append_partitioned": append_partitioned,
    "append_repeated": append_repeated,
    "append_with_rejects": append_rejects,
    "append_verify": append_verify,
    "append_retry": append_retry,
    "json_infer_scan": json_infer_scan,
    "json_write": json_write,
    "json_rows": json_rows,
    "json_records": json_records,
    "json_rejects": json_rejects,
    "json_infer_texts": json_infer_texts,
    "json_keys": json_keys,
    "json_flags": json_flags,
    "json_items": json_items,
    "json_first": json_first,
    "list_join": list_join,
    "split_statements": split_statements,
    "string_pack": string_pack,
    "table_profile": table_profile,
    "profile_sketches": profile_sketches,
    "stream_append": stream_append,
    "stream_batches": stream_batches,
    "stream_progress": stream_progress,
}
