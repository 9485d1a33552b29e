"""Base spans of personal data against the patterns as they are stated, and their time."""

import hashlib
import random
import re
import time

import pytest

from lakejobs.llm import crf, pii
from lakejobs.llm.queries import QUERIES

STATED = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def fits(kind, text):
    digits = "".join(c for c in text if c in "0123456789")
    if kind == "ip":
        return all(int(x) <= 255 for x in text.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def stated(text):
    return [(k, *m.span()) for k, p in STATED.items() for m in p.finditer(text) if fits(k, m[0])]


def test_random_texts():
    rng = random.Random(9)
    parts = ["a", "b1", ".", "..", "@", "-", "_", "%", "+", "1", "255", "256", "0001", " ", "(", ")", "4539578763621486", "+49 30 1234567", "x@y.z", "1.2.3.4", "é", "\n"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(0, 14)))
        assert pii.base_spans(text) == stated(text), text


def test_the_query_gives_the_stated_spans(spark):
    small = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = QUERIES["op9_personal_data"](spark, small).collect()
    for r in rows:
        base = stated(texts[r.doc_id])
        shown = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(shown).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b[0] == k for b in base) for k in STATED]
        assert set(shown) <= set(r.spans.split(","))
    assert len(rows) == len(texts) and sum(r.n_email for r in rows) > 0


def test_tokens_are_the_runs_with_a_digit_or_sign():
    rng = random.Random(8)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "1", "@", " ", "\n", "(", "é", "+"]) for _ in range(rng.randrange(0, 25)))
        runs = [m for m in re.finditer(r"[^ \t\n\r\x0b\x0c]+", text) if re.search("[0-9@+]", m[0]) and m[0].strip(crf.PUNCTUATION)]
        assert [t.text for t in crf.tokens(text)] == [m[0].strip(crf.PUNCTUATION) for m in runs]


@pytest.mark.parametrize("unit", ["7", "a", "1.", "a.b", "+1(", "12 ", "a1 "])
def test_time_grows_with_the_length(unit):
    text = unit * (400_000 // len(unit)) + " x@y.z"
    start = time.perf_counter()
    pii.base_spans(text)
    crf.tokens(text)
    assert time.perf_counter() - start < 10
