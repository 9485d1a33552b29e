"""Expressions over numbers and labels."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType, StringType

# Bits of the integer types, and how many digits always fit.
INTEGER_BITS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}
SAFE_DIGITS = {"tinyint": 2, "smallint": 4, "int": 9, "bigint": 18}


def sql_text(text: str) -> str:
    """``text`` as a literal in a SQL expression."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def pick_by_remainder(number: Column, labels: list[str]) -> Column:
    """The label at the never-negative remainder of ``number``."""
    position = F.pmod(number, F.lit(len(labels))).cast("int")
    return F.get(F.array(*[F.lit(label) for label in labels]), position)


def simple_case(value: Column, results: dict[Any, Any], default: Any) -> Column:
    """``CASE value WHEN k THEN v ... ELSE default END``."""
    (first, result), *rest = results.items()
    case = F.when(value == F.lit(first), F.lit(result))
    for key, result in rest:
        case = case.when(value == F.lit(key), F.lit(result))
    return case.otherwise(F.lit(default))


def convert(column: Column, have: DataType, want: DataType) -> Column:
    """``column`` of type ``have`` as type ``want``; null where it does not fit.

    The result is that of ``try_cast``. That raises and catches an exception for
    every value that does not convert to an integer, which is slow when there
    are many, so the usual ones are told by their characters or size first.
    """
    if have == want or not isinstance(want, IntegralType):
        return column.try_cast(want)
    kind = want.simpleString()
    half = 2 ** (INTEGER_BITS[kind] - 1)

    def narrow(number: Column) -> Column:
        return F.when(number.between(-half, half - 1), number.cast(want))

    if isinstance(have, IntegralType):
        return narrow(column)
    if isinstance(have, StringType):
        few, no_more = SAFE_DIGITS[kind], SAFE_DIGITS["bigint"]
        return (
            F.when(F.rlike(column, F.lit(f"^[+-]?[0-9]{{1,{few}}}\\z")), column.try_cast(want))
            .when(F.rlike(column, F.lit("[^0-9+\\-\\x00-\\x20\\x7f]")), F.lit(None))
            .when(
                F.rlike(column, F.lit(f"^[+-]?[0-9]{{1,{no_more}}}\\z")),
                narrow(column.try_cast("bigint")),
            )
            .otherwise(column.try_cast(want))
        )
    return column.try_cast(want)
