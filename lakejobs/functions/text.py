"""Expressions over text columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters that end a line and that count as white space
# when a script is split into statements. CR LF together end one line.
LINE_ENDS = "\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029"
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def cut(text: Column, length: int) -> Column:
    return F.left(text, F.lit(length))


def nth_field(text: Column, delimiter: str, n: int) -> Column:
    """Field ``n``, counted from 1; empty when there are fewer."""
    return F.split_part(text, F.lit(delimiter), F.lit(n))


def before(text: Column, delimiter: str) -> Column:
    """Text before the first delimiter, or all of it."""
    return F.substring_index(text, delimiter, 1)


def delete_chars(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def replace_char(text: Column, old: str, new: str) -> Column:
    return F.translate(text, old, new)


def append_if_absent(text: Column, marker: str, addition: str) -> Column:
    """``text`` with ``addition`` at its end, unless it contains ``marker``.
    A null is taken as empty text."""
    known = F.coalesce(text, F.lit(""))
    return F.when(F.contains(known, F.lit(marker)), known).otherwise(
        F.concat(known, F.lit(addition))
    )


def log_line(level: Column, source: Column, message: Column) -> Column:
    """``LEVEL [source] message``; a null field is left empty."""
    fields = [F.coalesce(c.cast("string"), F.lit("")) for c in (level, source, message)]
    return F.format_string("%s [%s] %s", *fields)


def _unix_lines(text: Column) -> Column:
    """Every line end as a line feed. Most texts have no other line ends and
    are passed through."""
    one_char = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    changed = F.translate(one_char, LINE_ENDS, "\n" * len(LINE_ENDS))
    found = [F.contains(text, F.lit(end)) for end in LINE_ENDS[1:]]
    return F.when(reduce(Column.__or__, found), changed).otherwise(text)


def _statement(chunk: Column) -> Column:
    """A chunk without its whole-line comments and outer white space."""
    space = F.lit(WHITE_SPACE)
    code_lines = F.filter(
        F.split(chunk, "\n"), lambda line: ~F.startswith(F.ltrim(line, space), F.lit("--"))
    )
    code = F.when(F.contains(chunk, F.lit("--")), F.array_join(code_lines, "\n"))
    return F.btrim(F.coalesce(code, chunk), space)


def split_statements(df: DataFrame, script: str, *keep: str) -> DataFrame:
    """One row per SQL statement of the text column ``script``: the columns
    ``keep``, the chunk number ``pos`` and the ``statement``.

    The text is cut at every ``;`` first, also inside quotes and comments, and
    only then are lines starting with ``--`` dropped. A comment after code stays.
    Empty statements are left out.
    """
    chunks = F.split(_unix_lines(F.col(script)), ";")
    statements = F.posexplode(F.transform(chunks, _statement)).alias("pos", "statement")
    return df.select(*keep, statements).filter(F.col("statement") != "")
