"""Expressions over a column of JSON responses, one response per row.

Text that is null or not JSON behaves like a response without the field.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def object_at(text: Column, path: str) -> Column:
    """The object at ``path`` as a map of text; an empty map when missing."""
    parsed = F.from_json(F.get_json_object(text, path), "map<string,string>")
    return F.coalesce(parsed, F.create_map().cast("map<string,string>"))


def sorted_keys(text: Column, path: str) -> Column:
    """The sorted keys of the object at ``path``."""
    return F.sort_array(F.map_keys(object_at(text, path)))


def field_or(text: Column, path: str, key: str, default: str) -> Column:
    """Field ``key`` of the object at ``path``, or ``default``."""
    return F.coalesce(F.try_element_at(object_at(text, path), F.lit(key)), F.lit(default))


def has_field(text: Column, path: str, key: str) -> Column:
    """Whether the field is present and not empty."""
    return F.length(field_or(text, path, key, "")) > 0


def items_at(text: Column, path: str, fields: str) -> Column:
    """The array of objects at ``path``, typed by ``fields`` such as
    ``"name STRING, value STRING"``."""
    return F.from_json(F.get_json_object(text, path), f"array<struct<{fields}>>")


def first_named(items: Column, name: str, field: str) -> Column:
    """``field`` of the first item called ``name``, in the order of the array."""
    return F.get(F.filter(items, lambda item: item["name"] == F.lit(name)), 0)[field]


def join_names(items: Column, separator: str = " ") -> Column:
    """The names of all items on one line, in the order of the array."""
    return F.array_join(F.transform(items, lambda item: item["name"]), separator)
