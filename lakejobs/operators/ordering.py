"""Sorting, newest rows and first matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def order_by(df: DataFrame, *keys: str, tie_break: tuple[str, ...] = ()) -> DataFrame:
    """Sort all rows. With ``tie_break`` columns that tell rows apart, a key
    that many rows share is spread over several tasks."""
    return df.orderBy(*keys, *tie_break)


def latest(df: DataFrame, time: str, tie_break: str, n: int) -> DataFrame:
    """The newest ``n`` rows, oldest of them first. Each task keeps ``n`` rows
    only, so nothing else is shuffled."""
    newest = df.orderBy(F.col(time).desc(), F.col(tie_break).desc()).limit(n)
    return newest.orderBy(time, tie_break)


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    """The distinct values in order; duplicates go before the shuffle."""
    return df.select(column).distinct().orderBy(column)


def first_match(
    df: DataFrame, key: str, condition: Column, order: str, value: str
) -> DataFrame:
    """Per ``key``, the ``value`` of the first row in ``order`` that matches.

    Tasks reduce each key to one candidate before the shuffle, so a key with
    very many rows is no heavier than another.
    """
    first = F.min(F.struct(F.col(order), F.col(value))).alias("_first")
    return (
        df.filter(condition).groupBy(key).agg(first).select(key, f"_first.{order}", f"_first.{value}")
    )
