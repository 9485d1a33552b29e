"""Line dedup of many lines that are alike without being within the edits."""

import random

import brute
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lakejobs.llm import linededup, lines

text = st.text("abc", max_size=10)


def sides(line, other):
    batch = pa.RecordBatch.from_pydict({"name": [1], "middle": [2], "line": [line], "other": [other]})
    return set(next(lines.leaving_rows([batch])).column("sides")[0].as_py())


@settings(max_examples=1000, deadline=None)
@given(text, text, text)
def test_near_lines_leave_the_middle_together_or_are_equal_after_changes(a, b, middle):
    one, two = lines.changed(a, middle, 2), lines.changed(b, middle, 2)
    equal = any(one[t][0] + two[t][0] + one[t][1] <= 2 for t in one.keys() & two.keys())
    near = brute.edits(a, b) <= 2
    assert near or not equal
    assert a == b or not near or equal or sides(a, middle) & sides(b, middle)


def test_work_stays_in_proportion_to_the_lines(make_docs, monkeypatch):
    """Lines with a word changed share most segments with each other; a bucket's members are not multiplied by levels."""
    monkeypatch.setattr(linededup, "PAIRED", 8)
    members, real = [], linededup.written

    def counted(df, label):
        out = real(df, label)
        if {"sig", "name", "own"} <= set(out.columns) and label != "signatures":
            members.append(out.count())
        return out

    monkeypatch.setattr(linededup, "written", counted)
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijkl", k=6)) for _ in range(60)]
    rows = [(0, " ".join(words))]
    for k in range(1, 150):
        copy = list(words)
        copy[rng.randrange(60)] = "".join(rng.choices("mnopqrst", k=6))
        rows.append((k, " ".join(copy)))
    rows += [(150 + k, t + "!") for k, (_, t) in enumerate(rows[::10])]
    docs = make_docs(rows)
    got = {r.doc for r in linededup.removals(docs, least=20).collect()}
    assert got == {k for k, v in brute.line_removals(rows, 2, 20).items() if v}
    assert sum(members) < 6 * members[0]
