"""Line dedup where many lines share a segment."""

import random

import brute
import pytest

from lakejobs.llm import linededup


def removals(docs, least):
    got = {}
    for r in linededup.removals(docs, least=least).collect():
        got.setdefault(r.doc, set()).add(r.no)
    return got


@pytest.mark.parametrize(("least", "longest", "letters"), [(1, 6, "ab"), (4, 14, "ab"), (12, 30, "abé\U0001f600")])
def test_split_buckets_lose_no_link(make_docs, monkeypatch, least, longest, letters):
    monkeypatch.setattr(linededup, "PAIRED", 2)
    rng = random.Random(longest)
    head = "".join(rng.choices(letters, k=longest // 2))
    found = ["".join(rng.choices(letters, k=rng.randint(least, longest))) for _ in range(60)]
    found += [head + "".join(rng.choices(letters, k=rng.randint(0, longest - len(head)))) for _ in range(90)]
    found += ["".join(rng.choices(letters, k=rng.randint(0, longest - len(head)))) + head for _ in range(50)]
    rows = [(k, "\n".join(found[k::20])) for k in range(20)]
    expected = {k: set(v) for k, v in brute.line_removals(rows, 2, least).items() if v}
    assert removals(make_docs(rows), least) == expected


def test_lines_with_one_beginning(make_docs, monkeypatch):
    """No bucket of strangers is paired: what is left after the split shares nothing."""
    rng, paired = random.Random(5), []
    real = linededup._close
    monkeypatch.setattr(linededup, "_close", lambda pairs, info, edits: paired.append(pairs.count()) or real(pairs, info, edits))
    tails = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=29)) for _ in range(3000)]
    tails += [t[:10] + "#" + t[11:] for t in tails[::100]]
    rows = [(k, "same beginning" + t) for k, t in enumerate(tails)]
    assert removals(make_docs(rows), 20) == {3000 + k: {0} for k in range(30)}
    assert sum(paired) < 3 * len(rows)
