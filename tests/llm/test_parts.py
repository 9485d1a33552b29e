"""The pieces inside tasks, by brute force and on held-out cases."""

import io
import random

import brute
import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lakejobs.llm import crf, lines, pii, qgrams, records, sets
from lakejobs.llm.neardup import banding

SMALL = st.text(alphabet="abé", max_size=14)


@settings(max_examples=400, deadline=None)
@given(SMALL, SMALL, st.integers(1, 3))
def test_banded_distance(a, b, k):
    assert lines.within(a, b, k) == (brute.edits(a, b) <= k)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abc", min_size=6, max_size=16), st.data())
def test_near_lines_share_a_signature(a, data):
    b = list(a)
    for _ in range(2):
        at = data.draw(st.integers(0, len(b)))
        how = data.draw(st.sampled_from("sid"))
        if how == "i":
            b.insert(at, "c")
        elif at < len(b):
            b[at : at + 1] = ["b"] if how == "s" else []
    b = "".join(b)
    if len(b) >= 6:
        short, long = sorted((a, b), key=len)
        assert any(own and sig in lines.signatures(long, 2) for sig, own in lines.signatures(short, 2).items())
        assert sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(lines.parity(a), lines.parity(b))) <= 8


def test_sketches_are_full_and_concentrated():
    rng = np.random.default_rng(1)
    t = 256
    for size, part in ((400, 0.5), (40, 0.8), (5, 1.0), (1, 1.0)):
        errors = []
        for _ in range(20):
            a = rng.integers(0, 2**63, size, np.uint64)
            b = a.copy()
            b[int(size * part) :] = rng.integers(0, 2**63, size - int(size * part), np.uint64)
            s = sets.sketches(np.concatenate([a, b]), np.repeat([0, 1], size), 2, t)
            assert (s != sets.EMPTY).all()
            truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            errors.append(abs((s[0] == s[1]).mean() - truth))
        assert np.mean(errors) < 0.06


def test_sketch_does_not_depend_on_the_batch():
    rng = np.random.default_rng(2)
    many = [rng.integers(0, 2**63, n, np.uint64) for n in (3, 900, 50, 1)]
    together = sets.sketches(np.concatenate(many), np.repeat(range(4), [len(x) for x in many]), 4, 64)
    for i, x in enumerate(many):
        assert (sets.sketches(x, np.zeros(len(x), int), 1, 64)[0] == together[i]).all()


def test_banding_misses_little():
    for percent in (50, 80, 85, 95):
        bands, rows = banding(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= 1e-9 * 1.001


def test_qgram_filter_loses_no_match():
    random.seed(3)
    letters = "abcdefghij "
    text = "".join(random.choice(letters) for _ in range(4000))
    patterns, edits = [], []
    for _ in range(60):
        at, size = random.randrange(3800), random.choice([40, 80, 120])
        p = list(text[at : at + size])
        for _ in range(random.randint(0, int(0.12 * size))):
            i = random.randrange(len(p))
            p[i : i + 1] = random.choice([[], ["z"], [p[i], "q"]])
        patterns.append("".join(p))
        edits.append(brute.best_match(patterns[-1], text))
    block = qgrams.Block(list(range(60)), patterns, 0.08)
    found = {h["item"]: h["edits"] for h in block.search([text, "", text[:50]])[0]}
    for i, (p, e) in enumerate(zip(patterns, edits)):
        if e <= int(0.08 * len(p)):
            assert found[i] == e
        else:
            assert i not in found


def test_reader_finds_every_record_in_any_cut():
    payloads = [bytes([31, 139, 8, 0]) * 30, b"", "é".encode() * 500, bytes(range(256)) * 40]
    raw = b"".join(records.record(i, f"http://x/{i}", p, None, False) for i, p in enumerate(payloads * 3))
    file = pa.PythonFile(io.BytesIO(raw), "r")
    for step in (1, 7, 100, 5000, len(raw)):
        found = []
        for start in range(0, len(raw), step):
            found += [records.parsed(x) for x in records.Members(file, len(raw)).starting_in(start, min(start + step, len(raw)))]
        assert [f["page_id"] for f in found] == list(range(12)) and all(f["intact"] for f in found)
        assert [f["payload"] for f in found] == payloads * 3


def test_skip_chain_reaches_a_far_repeat():
    random.seed(4)
    digits = lambda n: "".join(random.choice("0123456789") for _ in range(n))
    texts = []
    for i in range(300):
        phone = f"+1 ({digits(3)}) 555-{digits(4)}"
        texts.append(f"word call {phone} soon word {digits(3)} words {digits(2)}.{digits(1)} end")
        if i % 3 == 0:
            texts[-1] += f" and again {phone} there"
    model = crf.train([pii._labelled(t)[1] for t in texts])
    held = "write to +1 (017) 555-7713 now. Much later: ask 555-7713 about 4.0 and 12"
    base, every = pii.all_spans(held, model)
    assert [held[a:b] for _, a, b in base] == ["+1 (017) 555-7713"]
    assert set(base) <= set(every) and not any(held[a:b] in ("4.0", "12") for _, a, b in every)
    far = crf.tokens(held)
    alone = next(i for i, t in enumerate(far) if t.text == "555-7713" and t.start > 30)
    known = {i: 4 for i, t in enumerate(far) if t.start < 28}
    assert model.marginals(far, known)[alone][4] > model.marginals(far, {})[alone][4] - 1e-9
    assert model.skip[4][4] > 0
