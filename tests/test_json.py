"""JSON responses with missing, empty and broken parts."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakejobs.functions import jsoncols
from lakejobs.sources.jsonrows import as_json, explode_records, rejected_records, read_records, write_records

RESPONSES = {
    '{"config":{"b":"1","a":""}}': (["a", "b"], "1", False),
    '{"config":{"a":"x"}}': (["a"], "none", True),
    '{"config":{"a":null}}': (["a"], "none", False),
    '{"config":{"a":7,"b":{"c":1}}}': (["a", "b"], '{"c":1}', True),
    '{"config":{}}': ([], "none", False),
    '{"config":null}': ([], "none", False),
    '{"other":1}': ([], "none", False),
    "[1, 2]": ([], "none", False),
    '{"config":': ([], "none", False),
    "": ([], "none", False),
    None: ([], "none", False),
}


@pytest.mark.parametrize("response", RESPONSES)
def test_fields(spark, response):
    df = spark.createDataFrame([(response,)], "doc STRING")
    doc = F.col("doc")
    row = df.select(
        jsoncols.sorted_keys(doc, "$.config"),
        jsoncols.field_or(doc, "$.config", "b", "none"),
        jsoncols.has_field(doc, "$.config", "a"),
    ).first()
    assert tuple(row) == RESPONSES[response]


LISTS = {
    '{"items":[{"name":"b","value":"1"},{"value":"2"},{"name":"a"},{"name":"b","value":"3"}]}': (
        "b a b",
        "1",
    ),
    '{"items":[]}': ("", None),
    '{"items":{"name":"b","value":"1"}}': ("b", "1"),
    '{"none":1}': (None, None),
    "{": (None, None),
    None: (None, None),
}


@pytest.mark.parametrize("response", LISTS)
def test_item_lists(spark, response):
    df = spark.createDataFrame([(response,)], "doc STRING")
    items = jsoncols.items_at(F.col("doc"), "$.items", "name STRING, value STRING")
    row = df.select(jsoncols.join_names(items), jsoncols.first_named(items, "b", "value")).first()
    assert tuple(row) == LISTS[response]


def test_records_of_text(spark):
    texts = ['[{"id":1,"msg":"a"},{"id":2}]', '{"id":3,"msg":"c","more":1}', "[]", "{", None]
    texts += ['[{"id":1},', '{"id":"x"}', '[{"id":4},{"id":"y"},null]']
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    fields = StructType().add("id", "long").add("msg", "string")
    found = sorted(map(tuple, explode_records(df, F.col("t"), fields).collect()), key=repr)
    assert found == [(1, "a"), (2, None), (3, "c"), (4, None)]
    bad = {r.rejected for r in rejected_records(df, F.col("t"), fields).collect()}
    assert bad == {"{", '[{"id":1},', '{"id":"x"}', '{"id":"y"}', "null"}


def test_round_trip_keeps_nulls_and_text(spark, folder):
    df = spark.createDataFrame(
        [(1, 'quo"te\nline', 0.1), (2, None, None)], "id BIGINT, msg STRING, x DOUBLE"
    )
    write_records(df, f"{folder}/j")
    for schema in (None, df.schema):
        back = read_records(spark, f"{folder}/j", schema).select(df.columns)
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    lines = [json.loads(r.json) for r in as_json(df).collect()]
    assert {"id": 2, "msg": None, "x": None} in lines
