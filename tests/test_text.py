"""Statement splitting and text expressions."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakejobs.functions import text

from plan_text import plan

SCRIPTS = {
    "two statements": ("SELECT 1;\nSELECT 2;\n", ["SELECT 1", "SELECT 2"]),
    "comment lines": ("-- a\n  -- b\nSELECT 1\n--c\n, 2;", ["SELECT 1\n, 2"]),
    "separator in a comment": ("-- one; two\nSELECT 1;", ["two\nSELECT 1"]),
    "separator in quotes": ("SELECT ';'", ["SELECT '", "'"]),
    "comment after code stays": ("SELECT 1 -- one", ["SELECT 1 -- one"]),
    "blank end": ("SELECT 1;\n \t\n", ["SELECT 1"]),
    "carriage returns": ("SELECT 1\r\n-- x\r\n, 2;\r\nSELECT 3", ["SELECT 1\n, 2", "SELECT 3"]),
    "other line ends": ("a -- b\x0bc\x85d", ["a\nc\nd"]),
    "nothing": (" ;; -- x", []),
    "dash": ("a - b\n-c", ["a - b\n-c"]),
}


def split(spark, scripts):
    df = spark.createDataFrame(list(enumerate(scripts)), "id INT, script STRING")
    rows = text.split_statements(df, "script", "id").orderBy("id", "pos").collect()
    return [[r.statement for r in rows if r.id == i] for i in range(len(scripts))]


@pytest.mark.parametrize("name", SCRIPTS)
def test_split(spark, name):
    script, expected = SCRIPTS[name]
    assert split(spark, [script]) == [expected]


ALPHABET = "ab;-- \t\n\r\x0b\x1c\x1f\x85\xa0 　é"


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=40), min_size=1, max_size=40))
def test_split_properties(spark, scripts):
    for script, found in zip(scripts, split(spark, scripts)):
        rest = script
        for statement in found:
            # Statements are trimmed, whole, and in the order of the script.
            assert statement and statement == statement.strip() and ";" not in statement
            assert not any(x.strip().startswith("--") for x in statement.splitlines())
            at = rest.find(statement.splitlines()[0])
            assert at >= 0
            rest = rest[at:]
        # Without comments, nothing but separators and space is lost.
        if "--" not in script:
            assert "".join("".join(found).split()) == "".join(script.replace(";", " ").split())


def test_positions_rise(spark, tiny):
    documents = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text")
    last = {}
    for r in text.split_statements(documents, "text", "doc_id").orderBy("doc_id", "pos").collect():
        assert r.pos > last.get(r.doc_id, -1)
        last[r.doc_id] = r.pos
    assert last


def test_split_needs_no_shuffle(spark, tiny):
    documents = spark.read.parquet(f"{tiny}/documents.parquet")
    shown = plan(text.split_statements(documents, "text", "doc_id"))
    assert "Exchange" not in shown and "Python" not in shown


def test_small_expressions(spark):
    df = spark.createDataFrame([("a-b-c\nd", None)], "t STRING, n STRING")
    t, n = F.col("t"), F.col("n")
    row = df.select(
        text.first_line(t),
        text.cut(t, 3),
        text.nth_field(t, "-", 2),
        text.nth_field(t, "-", 9),
        text.before(t, "-"),
        text.delete_chars(t, "-\n"),
        text.replace_char(t, "\n", " "),
        text.append_if_absent(t, "b-", "!"),
        text.append_if_absent(t, "z", "!"),
        text.append_if_absent(n, "z", "!"),
        text.log_line(F.lit("ERROR"), n, F.lit(5)),
    ).first()
    assert tuple(row) == (
        "a-b-c",
        "a-b",
        "b",
        "",
        "a",
        "abcd",
        "a-b-c d",
        "a-b-c\nd",
        "a-b-c\nd!",
        "!",
        "ERROR [] 5",
    )
