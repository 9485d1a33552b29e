"""Every registered query against DuckDB on the same tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from lakejobs.jobs import QUERIES, TABLES
from lakejobs.oracle import ORACLE

TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "date": "DATE",
}


@pytest.fixture(scope="module")
def duck(tiny):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tiny}/{table}.parquet')"
        )
    return connection


def test_every_query_has_an_oracle():
    assert QUERIES.keys() == ORACLE.keys()
    assert QUERIES.items() <= entry.queries().items() and ORACLE.items() <= entry.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, tiny, name):
    df = entry.queries()[name](spark, tiny)
    columns = sorted(df.columns)
    expected = duck.sql(entry.oracle_sql()[name])
    assert columns == sorted(expected.columns)
    kinds = dict(zip(expected.columns, map(str, expected.types)))
    assert {c: TYPES[t] for c, t in df.dtypes} == kinds
    quoted = ", ".join(f'"{c}"' for c in columns)
    rows = sorted((tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=repr)
    assert rows == sorted(duck.sql(f"SELECT {quoted} FROM expected").fetchall(), key=repr)
    assert rows


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {r.l_returnflag for r in rows} == {"A", "N", "R"}


def test_order_by_keeps_order(spark, tiny):
    rows = entry.queries()["order_by"](spark, tiny).collect()
    assert rows == sorted(rows, key=lambda r: (r.c_mktsegment, r.c_custkey))


def test_latest_is_oldest_first(spark, tiny):
    ids = [r.event_id for r in entry.queries()["latest_n"](spark, tiny).collect()]
    assert ids == sorted(ids) and len(ids) == 20
