"""Command line, to be run with ``spark-submit`` or ``python -m lakejobs``.

Catalog settings come from the submit command; tables are named with or
without a catalog.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from lakejobs.plans.named import run_named, write_named
from lakejobs.plans.profile import namespaces, table_summary, tables
from lakejobs.plans.script import count_rows, run_file, seed_airlines, seed_flights
from lakejobs.session import get_session
from lakejobs.sources.tables import read_table


def show_all(df: DataFrame, vertical: bool = False) -> None:
    """Print every row of a short result."""
    df.show(max(df.count(), 1), truncate=False, vertical=vertical)


def check(spark: SparkSession, args: argparse.Namespace) -> None:
    """Namespaces, the tables of one, the metadata and rows of a table."""
    show_all(namespaces(spark, args.catalog))
    prefix = f"{args.catalog}." if args.catalog else ""
    show_all(tables(spark, f"{prefix}{args.namespace}"))
    table = f"{prefix}{args.namespace}.{args.table}"
    table_summary(spark, table).show(truncate=False)
    rows = read_table(spark, table)
    rows.orderBy(args.order_by or rows.columns[0]).show(truncate=False)
    count_rows(spark, table).show()


def seed(spark: SparkSession, args: argparse.Namespace) -> None:
    seed_airlines(spark, args.namespace).show()
    seed_flights(spark, args.namespace).show()


def script(spark: SparkSession, args: argparse.Namespace) -> None:
    for head in run_file(spark, args.file):
        print(">>>", head)
    if args.count:
        count_rows(spark, args.count).show()


def query(spark: SparkSession, args: argparse.Namespace) -> None:
    queries = dict(pair.split("=", 1) for pair in args.sql)
    named = run_named(read_table(spark, args.table), args.name or args.table, queries)
    show_all(write_named(named, args.out, args.format), vertical=True)
    show_all(named.failure())


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lakejobs", description=__doc__)
    commands = top.add_subparsers(required=True)

    one = commands.add_parser("check", help="look at a namespace and a table")
    one.add_argument("namespace")
    one.add_argument("table")
    one.add_argument("--catalog")
    one.add_argument("--order-by")
    one.set_defaults(run=check)

    one = commands.add_parser("seed", help="create the demo tables")
    one.add_argument("namespace")
    one.set_defaults(run=seed)

    one = commands.add_parser("script", help="run the statements of a SQL file")
    one.add_argument("file")
    one.add_argument("--count", metavar="TABLE", help="count the rows of a table afterwards")
    one.set_defaults(run=script)

    one = commands.add_parser("query", help="run named queries over a table and report the scans")
    one.add_argument("table", help="catalog name or folder")
    one.add_argument("sql", nargs="+", metavar="NAME=SQL")
    one.add_argument("--name", help="what the SQL calls the table, if not by its own name")
    one.add_argument("--out", help="folder for the results")
    one.add_argument("--format", default="json")
    one.set_defaults(run=query)
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(get_session(), args)


if __name__ == "__main__":
    main()
