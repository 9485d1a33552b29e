"""The conversation trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakejobs.llm import prefixes
from lakejobs.llm.parens import Parens
from lakejobs.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"


def name(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def brute(rows, block=20, shared=4):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, name(role or "", text or ""), role or "", text or ""))
    for turns in own.values():
        turns.sort()
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % shared
        full[c] = tuple(x[3:] for x in own.get(c - c % block, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    below = defaultdict(list)
    for node in members:
        if node:
            below[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(node[-1][1].split()) if node else 0
        leaves[node] = sum(leaves[x] for x in below[node]) or 1
        saved[node] = (len(members[node]) - 1) * words + sum(saved[x] for x in below[node])
    out = []
    for node, who in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in who if len(full[c]) == len(node)))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(below[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("conv", "depth", "parent_conv", "n_convs", "n_children", "n_leaves", "saved", "sha").collect()), key=str)


def some(rng, convs, longest, texts):
    rows = []
    for c in convs:
        for t in range(rng.randrange(0, longest + 1)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(texts)))
    return rows


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_the_given_conversations(spark, sf):
    folder = f"/root/testdata/{sf}"
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{folder}/conversations.parquet").collect()]
    df = QUERIES["op13_conversation_trie"](spark, folder)
    renamed = {"conv_id": "conv", "parent_conv_id": "parent_conv", "saved_tokens": "saved", "ends_sha256": "sha"}
    assert dict(df.dtypes) == {**dict.fromkeys(["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"], "bigint"), "ends_sha256": "string"}
    assert got(df.withColumnsRenamed(renamed)) == brute(rows)


@pytest.mark.parametrize(("segment", "cells"), [(64, 2**19), (64, 6), (2, 2**19), (2, 4), (1, 1), (3, 9)])
def test_shards_and_segments_of_any_size(spark, segment, cells):
    rng = random.Random(segment * 1000 + cells)
    rows = some(rng, range(-3, 45), 9, ["a b", "a b", "c", "", None])
    rows += [(c, t, "user", "same  words\there") for c in range(100, 130) for t in range(7)]
    rows += [(None, 1, "user", "left out"), (200, None, None, None), (200, None, "user", "x y"), (200, 3, "u", "z"), (200, 3, "u", "z")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("conv", "name", "level", "n", "words", "part")})
    expected = brute(rows)
    assert got(prefixes.trie(df, segment=segment, cells=cells)) == expected
    assert len(expected) > 50


def test_no_conversations(spark):
    assert prefixes.trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_long_conversation_lies_in_several_tasks(spark):
    rows = [(0, t, "user", f"turn {t}") for t in range(3000)] + [(40, t, "user", f"turn {t}") for t in range(2990)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert got(prefixes.trie(df)) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("piece", [0, 50, 2**20])
def test_ids_in_pieces(spark, piece):
    rng = random.Random(piece)
    ends = {bytes([k]) * 16: sorted(rng.sample(range(-50, 10_000), rng.randrange(1, 900))) for k in range(12)}
    rows = [(k, c) for k, cs in ends.items() for c in cs]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        hashes = {bytes(r.node): r.sha for r in prefixes.end_hashes(spark.createDataFrame(rows, "node binary, conv long").repartition(5), piece).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert hashes == {k: hashlib.sha256(",".join(map(str, cs)).encode()).hexdigest() for k, cs in ends.items()}


def test_closing_parentheses():
    rng = random.Random(4)
    paths = sorted({tuple(rng.randrange(3) for _ in range(rng.randrange(0, 12))) for _ in range(3000)})
    shared = [0] + [next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(paths, paths[1:])]
    trie = Parens(np.array([len(p) for p in paths]), np.array(shared))
    nodes = {p[:d] for p in paths for d in range(len(p) + 1)}
    assert len(trie.open) == len(nodes)
    order = sorted(nodes)
    parents = trie.parents()
    for i, node in enumerate(order):
        assert trie.depth[i] == len(node)
        assert trie.last[i] == max(j for j in range(i, min(i + 400, len(order))) if order[j][: len(node)] == node) or len(node) < 3
        assert parents[i] == (order.index(node[:-1]) if node else -1) or i > 300
    stack, close = [], {}
    marks = np.zeros(2 * len(nodes), bool)
    marks[trie.open] = True
    for i, is_open in enumerate(marks):
        if is_open:
            stack.append(i)
        else:
            close[stack.pop()] = i
    assert [close[i] for i in trie.open] == trie.close.tolist()
