"""The registered queries against SQL where there is some, else against brute force."""

import re

import brute
import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from lakejobs.llm import decontam, linededup, pii
from lakejobs.llm.oracle import ORACLE
from lakejobs.llm.queries import QUERIES

TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def rows_of(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def test_all_ten_and_the_pipeline_are_registered():
    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert "pipeline" in names and "pipeline" not in entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, tiny, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tiny}/{table}.parquet')")
    df, expected = QUERIES[name](spark, tiny), con.sql(ORACLE[name])
    columns = sorted(df.columns)
    assert {c: TYPES[t] for c, t in df.dtypes} == dict(zip(expected.columns, map(str, expected.types)))
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    assert got == sorted(con.sql(f"SELECT {', '.join(columns)} FROM expected").fetchall(), key=repr)
    assert got


def test_near_duplicates(spark, tiny):
    docs = [(r.doc_id, r.text) for r in rows_of(spark, tiny, "documents").collect()]
    expected = brute.near_groups(docs, 3, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op2_minhash_neardup"](spark, tiny).collect()}
    assert got == expected and len(set(expected.values())) < len(docs)


def test_decontamination(spark, tiny):
    docs, bench = (rows_of(spark, tiny, t).collect() for t in ("documents", "benchmark"))
    normal = lambda t: " ".join((t or "").lower().split())
    items = {b.item_id: normal(b.text) for b in bench}
    for r in QUERIES["op3_decontamination"](spark, tiny).collect():
        text = normal(next(d.text for d in docs if d.doc_id == r.doc_id))
        found = {int(x) for x in r.items.split(",") if x}
        whole = {k for k, t in items.items() if len(t) >= decontam.MIN_CHARS and t in text}
        assert whole <= found and r.contaminated == bool(found) and r.n_items == len(found)
        # What else was found holds a window of the item within the edits.
        for k in found - whole:
            t = items[k]
            starts = {*range(0, max(len(t) - decontam.WINDOW, 0), decontam.WINDOW // 2), max(len(t) - decontam.WINDOW, 0)}
            assert any(brute.best_match(t[a : a + decontam.WINDOW], text) <= decontam.RATE * min(len(t), decontam.WINDOW) for a in starts)


def test_line_dedup(spark, tiny):
    docs = [(r.doc_id, r.text) for r in rows_of(spark, tiny, "documents").collect()]
    expected = brute.line_removals(docs, linededup.EDITS, linededup.MIN_CHARS)
    for r in QUERIES["op6_line_dedup"](spark, tiny).collect():
        assert {int(x) for x in r.removed.split(",") if x} == expected[r.doc_id]
        assert r.n_removed == len(expected[r.doc_id])


def test_personal_data(spark, tiny):
    texts = {r.doc_id: r.text for r in rows_of(spark, tiny, "documents").collect()}
    for r in QUERIES["op9_personal_data"](spark, tiny).collect():
        base = pii.base_spans(texts[r.doc_id])
        spans = r.spans.split(",") if r.spans else []
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert bool(re.search("[0-9@+]", texts[r.doc_id])) or not spans


def test_licenses(spark, tiny):
    known = {"Licensed under CC BY-NC 4.0.": "cc-by-nc", "Licensed under the Apache License, Version 2.0.": "apache",
             "This work is licensed under the GNU General Public License, version 3.": "gpl", "Released under the MIT License.": "mit"}
    texts = {r.doc_id: r.text for r in rows_of(spark, tiny, "documents").collect()}
    for r in QUERIES["op10_license_scan"](spark, tiny).collect():
        expected = {known[x] for x in texts[r.doc_id].split("\n") if x in known}
        assert set(r.families.split(",")) - {""} - {"unknown"} == expected


def test_pipeline(spark, tiny):
    """Each stage against brute force on its own input; the first against the query with SQL."""
    documents = rows_of(spark, tiny, "documents")
    kept = {r.doc_id for r in QUERIES["op1_quality_rules"](spark, tiny).collect() if r.kept}
    docs = documents
    columns = documents.columns
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = stage(spark, docs, tiny).cache()
        after = sorted((r.doc_id, r.text) for r in docs.collect())
        assert docs.columns == columns
        if name == "quality rules":
            assert after == sorted(x for x in before if x[0] in kept)
        elif name == "line dedup":
            assert after == sorted(brute.without_lines(before, linededup.EDITS, linededup.MIN_CHARS))
        elif name == "near-dedup":
            groups = brute.near_groups(before, 5, 80)
            assert after == sorted(x for x in before if groups[x[0]][1] == x[0])
        elif name == "decontamination":
            hits = {r.row.doc_id for r in decontam.scan(spark.createDataFrame(before, "doc_id long, text string"), rows_of(spark, tiny, "benchmark")).filter("size(hits) > 0").collect()}
            assert after == sorted(x for x in before if x[0] not in hits)
    sources = {r.doc_id: r.source for r in documents.collect()}
    expected = brute.mixture([(k, t, sources[k]) for k, t in before], corpus_pipeline.WEIGHTS)
    taken = {k: 0 for k, _ in before}
    for k, text in after:
        taken[k] += len(brute.words(text))
    assert taken == {k: x[3] for k, x in expected.items()}
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.run(spark, tiny).collect()) == after
