"""Runs with retries: nothing is lost, nothing stored twice, and a run can be repeated."""

import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakejobs.operators import retry

RAW = StructType().add("id", "string").add("v", "string")
SCHEMA = StructType().add("id", "integer").add("v", "integer")


def below(limit):
    return {f"v of {limit} or more": lambda c: c["v"] < limit}


def run(spark, path, n, rows, limit=10, **kw):
    return retry.append_run(spark.createDataFrame(rows, RAW), path, n, SCHEMA, "id", below(limit), **kw)


def state(spark, path, n):
    stored = sorted(tuple(r) for r in retry.stored_rows(spark, path, RAW, SCHEMA).collect())
    waiting = sorted((r.id or "", r.v, r.attempt) for r in retry.waiting_rows(spark, path, RAW, n).collect())
    dead = sorted((r.id or "", r.v, r.attempt, r.reject_reason) for r in retry.dead_letters(spark, path, RAW).collect())
    return stored, waiting, dead


def test_three_runs(spark, folder):
    assert run(spark, folder, 1, [("1", "5"), ("2", "20"), ("x", "1"), (None, "3")]) == {"rows": 4, "accepted": 1, "retry": 3, "dead": 0}
    assert state(spark, folder, 1) == ([(1, 5)], [("", "3", 1), ("2", "20", 1), ("x", "1", 1)], [])
    assert run(spark, folder, 2, [("1", "6"), ("3", "7"), ("3", "4")], limit=30) == {"rows": 4, "accepted": 2, "retry": 2, "dead": 0}
    stored, waiting, dead = state(spark, folder, 2)
    assert stored == [(1, 5), (2, 20), (3, 4)] and waiting == [("", "3", 2), ("x", "1", 2)] and not dead
    run(spark, folder, 3, [], limit=30)
    stored, waiting, dead = state(spark, folder, 3)
    assert len(stored) == 3 and not waiting
    assert dead == [("", "3", 3, "id: missing"), ("x", "1", 3, "id: not int")]


def test_a_run_can_be_repeated(spark, folder):
    run(spark, folder, 1, [("1", "5"), ("2", "20")])
    run(spark, folder, 2, [("3", "7"), ("4", "99")], limit=30)
    once = state(spark, folder, 2)
    run(spark, folder, 2, [("3", "7"), ("4", "99")], limit=30)
    assert state(spark, folder, 2) == once
    # With mended rules, what was refused the first time is not left behind.
    run(spark, folder, 2, [("3", "7"), ("4", "99")], limit=100)
    assert state(spark, folder, 2) == ([(1, 5), (2, 20), (3, 7), (4, 99)], [], [])


def test_a_hot_key_is_reduced_before_the_shuffle(spark, folder):
    rows = spark.range(0, 200_000, 1, 8).select(F.lit("7").alias("id"), F.col("id").cast("string").alias("v"))
    counts = retry.append_run(rows, f"{folder}/t", 1, SCHEMA, "id")
    assert counts == {"rows": 1, "accepted": 1, "retry": 0, "dead": 0}
    assert retry.stored_rows(spark, f"{folder}/t", RAW, SCHEMA).collect() == [(7, 0)]


ROW = st.tuples(st.sampled_from([None, "1", "2", "3", "4", "x"]), st.sampled_from(["1", "15", "y", None]))


@settings(max_examples=4, deadline=None, phases=[Phase.generate], derandomize=True, suppress_health_check=list(HealthCheck))
@given(runs=st.lists(st.tuples(st.lists(ROW, max_size=5), st.sampled_from([10, 20])), min_size=1, max_size=3))
def test_equals_a_plain_loop(spark, tmp_path_factory, runs):
    path = str(tmp_path_factory.mktemp("retry"))
    stored, waiting, dead = {}, [], []
    for n, (rows, limit) in enumerate(runs, 1):
        run(spark, path, n, rows, limit, max_attempts=2)
        tried = [(i, v, 1) for i, v in rows] + [(i, v, a + 1) for i, v, a in waiting]
        waiting, good = [], {}
        for i, v, a in tried:
            if i in stored:
                continue
            fits = i is not None and i.isdigit() and (v is None or v.isdigit() and int(v) < limit)
            if fits:
                good.setdefault(i, []).append((v is not None, v or ""))
            elif a >= 2:
                dead.append((i or "", v, a))
            else:
                waiting.append((i, v, a))
        stored |= {i: min(vs)[1] for i, vs in good.items()}
    got = state(spark, path, len(runs))
    order = lambda x: sorted(x, key=repr)
    assert order((str(i), "" if v is None else str(v)) for i, v in got[0]) == order(stored.items())
    assert order(got[1]) == order((i or "", v, a) for i, v, a in waiting)
    assert order(d[:3] for d in got[2]) == order(dead)


def test_columns_that_do_not_match(spark, folder):
    with pytest.raises(Exception):
        retry.append_run(spark.createDataFrame([("1",)], "other string"), folder, 1, SCHEMA, "id")
