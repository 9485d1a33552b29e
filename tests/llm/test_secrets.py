"""The secret scan against plain brute force, on the given table and on odd texts."""

import hashlib
import math
import random
import re
import string
import time
from collections import Counter

import pytest

from lakejobs.llm import secretscan
from lakejobs.llm.queries import QUERIES

RULES = secretscan.Rules()
WORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]
VALUE = set(string.ascii_letters + string.digits + "+/_.=-")


def assignments(text):
    """Assignments by walking the text, one place after the other."""
    out, i = [], 0
    low = "".join(c.lower() if c in string.ascii_uppercase else c for c in text)
    while i < len(text):
        word = next((w for w in WORDS if low.startswith(w, i)), None)
        end = None
        if word:
            j = i + len(word)
            j += text[j : j + 1] in ('"', "'") and j < len(text)
            while text[j : j + 1] == " ":
                j += 1
            if text[j : j + 1] in (":", "=") and j < len(text):
                j += 1
                while text[j : j + 1] == " ":
                    j += 1
                j += text[j : j + 1] in ('"', "'") and j < len(text)
                start = j
                while j < len(text) and text[j] in VALUE:
                    j += 1
                if j > start:
                    end = j
                    if j - start >= 6:
                        out.append(("assign", i, j))
        i = end or i + 1
    return out


def runs(text, characters):
    return [m.span() for m in re.finditer(f"[{characters}]+", text)]


def brute_base(text):
    out = assignments(text)
    for a, b in runs(text, "A-Z0-9"):
        at = text.find("AKIA", a, b)
        if at >= 0 and b - at >= 20:
            out.append(("access", at, b))
    out += [("hex", a, b) for a, b in runs(text, "0-9a-f") if b - a >= 24]
    return sorted(out, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def bits(window):
    return -sum(n / len(window) * math.log2(n / len(window)) for n in Counter(window).values())


def brute_class(window):
    has = lambda cs: any(c in cs for c in window)
    digits, low, up = has(string.digits), has(string.ascii_lowercase), has(string.ascii_uppercase)
    if has("+/_=-"):
        return "base64"
    if not low and not up:
        return None
    if not digits:
        return "mixed case" if low and up else "letters"
    return "hex" if set(window) <= set("0123456789abcdef") or set(window) <= set("0123456789ABCDEF") else "alphanumeric"


def brute_added(text, base):
    marked = set()
    for a, b in runs(text, "A-Za-z0-9+/_=-"):
        if b - a < 20 or RULES.suppresses(text[a:b]):
            continue
        for i in range(a, b - 19):
            kind = brute_class(text[i : i + 20])
            if kind and bits(text[i : i + 20]) >= RULES.least_bits[kind] - 1e-9:
                marked.update((a, p) for p in range(i, i + 20))
    out = []
    for run, p in sorted(marked):
        if out and out[-1][0] == run and out[-1][2] == p:
            out[-1][2] = p + 1
        else:
            out.append([run, p, p + 1])
    return [("entropy", a, b) for _, a, b in out if not any(x < b and a < y for _, x, y in base)]


def shown(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def check(row, text):
    base = brute_base(text)
    every = sorted(base + brute_added(text, base), key=lambda s: (s[1], ["assign", "access", "hex", "entropy"].index(s[0])))
    assert (row.base_sha256, row.spans) == (hashlib.sha256(shown(base).encode()).hexdigest(), shown(every))
    assert [row.n_assign, row.n_access, row.n_hex] == [sum(s[0] == k for s in base) for k in ("assign", "access", "hex")]


def test_the_given_documents(spark):
    small = "/root/testdata/sf0.01"  # sf0.001 has no secrets
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = QUERIES["op12_secret_scan"](spark, small).collect()
    assert len(rows) == len(texts) and sum(r.n_assign + r.n_hex for r in rows) > 0
    for row in rows:
        check(row, texts[row.doc_id])


def random_text(rng):
    parts = ["password", "ToKen", "API_KEY", "apikey", "secret", "passwd", "\"", "'", " ", "  ", ":", "=", "AKIA", "AKIA" + "Q7" * 9, "abcdef0123456789" * 2, "ä", "K", "ſ", "\U0001f511", "\n", ".", "-", "/"]
    letters = string.ascii_letters + string.digits + "+/_=-"
    make = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(1, 60)))
    low = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.randrange(1, 60)))
    return "".join(rng.choice([*parts, make(), low(), "word-" * 5]) for _ in range(rng.randrange(0, 30)))


def test_random_texts(spark, make_docs):
    rng = random.Random(12)
    texts = [random_text(rng) for _ in range(400)]
    rows = secretscan.find(make_docs(list(enumerate(texts)), extra=True)).collect()
    assert len(rows) == 400
    for row in rows:
        check(row, texts[row.key])
    assert sum(row.n_entropy for row in rows) > 50 and sum(row.n_access for row in rows) > 20


def test_what_is_added_and_what_is_suppressed():
    kinds = lambda text: [k for k, _, _ in secretscan.all_spans(text, RULES)[1]]
    assert kinds("key wJalrXUtnFEMI/K7MDENG/bPxRfiCYzzz11 here") == ["entropy"]
    assert kinds("use ghp_16C7e42F292c6912E7710c838347Ae178B4a now") == ["entropy"]
    assert kinds("3F2504E04F8911D39A0C0305E82C3301") == ["entropy"]
    for calm in ("550e8400-e29b-41d4-a716-446655440000", "a-long-slug-of-many-plain-words-2024", "docs/guide/install/linux/index",
                 "Donaudampfschifffahrtsgesellschaft", "abcdefghijklmnopqrstuvwxyz0123456789", "1234567890123456789012",
                 "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "x" * 100, "sha256-47DEQpj8HBSa+/TImW+5JCeuQeRkm5NMpJWZG3hSuFU="):
        assert kinds(calm) == [], calm


def test_letters_of_the_words_in_either_case_but_no_others():
    assert secretscan.base_spans("paſſword=abcdef toKen=abcdef") == []
    assert secretscan.base_spans("TOKEN = 'abcdef'") == [("assign", 0, 15)]
    assert secretscan.base_spans("token=abc token=abcdef") == [("assign", 10, 22)]


def test_edges(spark, make_docs):
    rows = secretscan.find(make_docs([(None, "token=abcdef"), (1, None), (2, ""), (2, ""), (3, "token=abcdef")], extra=True)).collect()
    assert sorted((r.key is None, r.key or 0, r.n_assign, r.spans) for r in rows) == [
        (False, 1, 0, ""), (False, 2, 0, ""), (False, 2, 0, ""), (False, 3, 1, "assign:0:12"), (True, 0, 1, "assign:0:12"),
    ]
    assert secretscan.find(make_docs([])).collect() == []


@pytest.mark.parametrize("unit", ["aB3x", "token ", "token=\"", "AKIA", "0123456789abcdef", "a-", " ", "Ab1/"])
def test_time_grows_with_the_length(unit):
    start = time.perf_counter()
    secretscan.all_spans(unit * (2_000_000 // len(unit)), RULES)
    assert time.perf_counter() - start < 20
