"""Spelling variants against brute force over all pairs of a small vocabulary."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lakejobs.llm import spelling
from lakejobs.llm.fmindex import Index
from lakejobs.llm.queries import QUERIES

LOWER = {c: c + 32 for c in range(65, 91)}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs, least_length=5, least_count=3):
    counts = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}
    # Words one apart share a string with one letter taken out, or are that string.
    cut = defaultdict(set)
    for w in words:
        for v in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            cut[v].add(w)
    near = defaultdict(set)
    for group in cut.values():
        for w in group:
            near[w].update(v for v in group if v != w and one_apart(v, w))
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * n else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items())


def got(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def test_the_given_documents(spark, tiny):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    expected = brute(docs)
    assert got(QUERIES["op11_spelling_variants"](spark, tiny)) == expected
    assert sum(r[1] is not None for r in expected) > 100 and any(r[1] != r[2] for r in expected if r[1])


@pytest.mark.parametrize("shard", [1, 7, 50, 20_000])
def test_shards_of_any_size(make_docs, shard):
    rng = random.Random(shard)
    word = lambda: "".join(rng.choice("abà") for _ in range(rng.randrange(4, 9)))
    docs = [(i, " ".join(word() for _ in range(rng.randrange(0, 300)))) for i in range(60)]
    docs += [(100, "ÀBCDEF " * 3 + "aaaaaaa" * 500 + " " + "aaaaaaa" * 500 + " " + "aaaaaaa" * 500), (100, "ÀBCDEF×÷ÿ"), (None, "straße Straße STRASSE straßé"), (7, None), (8, "")]
    df = make_docs(docs, extra=True)
    expected = brute(docs)
    assert got(spelling.variants(df, shard=shard)) == expected
    assert len(expected) > 100


def test_no_words(make_docs):
    assert got(spelling.variants(make_docs([]))) == []
    assert got(spelling.variants(make_docs([(1, "one two three"), (2, None)]))) == []


def test_chains_of_forms_are_followed_to_the_end(make_docs):
    sizes = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "abbbb": 48, "bbbbb": 96}
    rows = got(spelling.variants(make_docs([(1, " ".join(w for w, n in sizes.items() for _ in range(n)))]), drop_every=2**40))
    assert {r[0]: r[2] for r in rows} == dict.fromkeys(sizes, "bbbbb")


def test_a_hot_half_is_searched_in_full(make_docs):
    """All words share their first half, and each with others the second one."""
    rng = random.Random(5)
    words = ["".join(["common", *(rng.choice("abc") for _ in range(6))]) for _ in range(400)]
    docs = [(i, " ".join(words)) for i in range(4)]
    assert got(spelling.variants(make_docs(docs), shard=30)) == brute(docs)


def test_index_finds_each_word_once():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(5, 9))) for _ in range(300)})
    queries = [*words, "zzzzz", "ababz"]
    q, w = Index(words).near(queries, np.array([len(x) // 2 for x in queries]))
    pairs = sorted((queries[i], words[j]) for i, j in zip(q, w))
    assert pairs == sorted((a, b) for a in queries for b in words if one_apart(a, b) and b.startswith(a[: len(a) // 2]))
