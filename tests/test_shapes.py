"""Inferred JSON shapes against a plain reading of the same texts."""

import json

import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakejobs.sources.jsonshapes import infer_shape, inferred_records, type_text


def frame(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "t string")


@pytest.mark.parametrize(
    ("shape", "text"),
    [
        ("OBJECT<id: BIGINT, x: OBJECT<y: DECIMAL(2,1)>>", "STRUCT<id: BIGINT, x: STRUCT<y: DOUBLE>>"),
        ("OBJECT<`a OBJECT``b`: VOID, n: DECIMAL(20,0)>", "STRUCT<`a OBJECT``b`: STRING, n: DECIMAL(20,0)>"),
        ("OBJECT<VOID: BIGINT, OBJECT: ARRAY<VARIANT>>", "STRUCT<VOID: BIGINT, OBJECT: ARRAY<STRING>>"),
    ],
)
def test_type_text(shape, text):
    assert type_text(shape) == text


def test_shape_of_many_writers(spark):
    texts = ['[{"id":1,"msg":"a"},{"id":2,"f":1}]', '{"id":"z","f":1.5,"n":null}', '{"deep":{"x":[1,2]}}', '{"id":', "[]", None, "7"]
    df = frame(spark, texts)
    assert infer_shape(df, F.col("t")) == "STRUCT<deep: STRUCT<x: ARRAY<BIGINT>>, f: DOUBLE, id: STRING, msg: STRING, n: STRING>"
    rows = {(r.id, r.msg, r.f, tuple(r.deep.x) if r.deep else None, r.rejected) for r in inferred_records(df, F.col("t")).collect()}
    assert rows == {("1", "a", None, None, None), ("2", None, 1.0, None, None), ("z", None, 1.5, None, None),
                    (None, None, None, (1, 2), None), (None, None, None, None, '{"id":'), (None, None, None, None, "7")}


def test_a_shape_can_be_kept(spark):
    shape = infer_shape(frame(spark, ['{"a":1}']), F.col("t"))
    later = inferred_records(frame(spark, ['{"a":5,"b":2}', '{"b":1}']), F.col("t"), shape)
    assert later.columns == ["a", "rejected"] and sorted(r.a or 0 for r in later.collect()) == [0, 5]


def test_no_objects(spark):
    df = frame(spark, ["1", "[]", None, "oops"])
    assert infer_shape(df, F.col("t")) is None
    assert sorted(r.rejected for r in inferred_records(df, F.col("t")).collect()) == ["1", "oops"]
    assert inferred_records(frame(spark, []), F.col("t")).collect() == []


VALUE = st.one_of(st.integers(-99, 99), st.sampled_from(["a", "b c"]), st.booleans(), st.none())
OBJECT = st.dictionaries(st.sampled_from(["p", "q", "odd `name`"]), VALUE, max_size=3)


@settings(max_examples=6, deadline=None, phases=[Phase.generate], derandomize=True, suppress_health_check=list(HealthCheck))
@given(docs=st.lists(st.one_of(OBJECT, st.lists(OBJECT, max_size=3)), min_size=1, max_size=6))
def test_equals_plain_reading(spark, docs):
    items = [x for d in docs for x in (d if isinstance(d, list) else [d])]
    kinds: dict = {}
    for item in items:
        for k, v in item.items():
            kinds.setdefault(k, set()).update([type(v)] if v is not None else [])

    def read(k, v):
        if v is None or len(kinds[k]) == 1:
            return v
        return v if isinstance(v, str) else json.dumps(v)

    got = inferred_records(frame(spark, [json.dumps(d) for d in docs]), F.col("t"))
    rows = [{k: v for k, v in r.asDict().items() if v is not None} for r in got.collect()]
    expected = [{k: read(k, v) for k, v in item.items() if v is not None} for item in items]
    assert sorted(map(repr, (sorted(r.items()) for r in rows))) == sorted(map(repr, (sorted(e.items()) for e in expected)))
