"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import random

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lakejobs.llm import decontam, licenses, linededup, mixing, neardup, pii, quality, spans, urls, warc
from lakejobs.session import scratch_dir

LINE = "This is a line of text that is long enough to count as one"
PROSE = "the king of the hill went to town and it is said that {} for a day with the people of that place to see"
LONG = " ".join(f"word{i}" for i in range(30_000))
ROWS = [
    (1, None), (2, ""), (3, "  \n "), (4, "one"), (5, LONG), (6, f"{LINE}\n{LINE}."), (6, f"{LINE}\n{LINE}."), (None, LINE),
    (7, LONG), (8, "\n".join(PROSE.format(f"x{i}") for i in range(8))), (9, "é" * 50), (10, LONG + " more"), (11, f"{LINE}!", None, None),
]


@pytest.fixture
def bench(spark):
    rows = [(1, LINE), (2, None), (3, "short"), (None, "another passage of text that is in no document at all")]
    return spark.createDataFrame(rows, "item_id long, text string")


def ids(df, column="doc_id"):
    return sorted((r[column] for r in df.collect()), key=repr)


def test_stages_keep_columns_and_take_clashing_ones(spark, tiny, make_docs):
    docs = make_docs(ROWS, extra=True)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tiny)
        assert out.columns == docs.columns
        out.collect()


def test_stages_on_an_empty_table(spark, tiny, make_docs):
    docs = make_docs(ROWS).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, tiny).collect() == []


def test_quality(make_docs):
    judged = {r.row.doc_id: r for r in quality.judge(make_docs(ROWS, extra=True)).collect()}
    assert [judged[k].n_words for k in (1, 2, 3, 4, 5)] == [0, 0, 0, 1, 30_000]
    assert not any(judged[k].kept for k in (1, 2, 3, 4, 9))
    # Lines that differ in one word hold windows that come twice.
    assert judged[8].n_repeat_words > 100 and judged[8].base_failed
    assert len(judged) == len({r[0] for r in ROWS})
    assert quality.judge(make_docs(ROWS).limit(0)).collect() == []


def test_quality_of_rare_and_null_languages(make_docs):
    """Clean texts stay in a language of 0.9%, in one of a few documents and in none; symbols do not."""
    words = {"en": "the of and to in a is that for it", "fr": "le la les et des un du que est pour", "it": "il di che per non con sono della come anche"}

    def text(lang, k):
        common = words[lang].split()
        return " ".join(f"{common[(k + i) % 10]} {lang}{k}x{i}" for i in range(60))

    rows = [(k, text("en", k), "en") for k in range(11_000)] + [(20_000 + k, text("fr", k), "fr") for k in range(100)]
    rows += [(30_000 + k, text("it", k), "it") for k in range(3)] + [(40_000, text("fr", 500), None), (40_001, text("en", 500), None)]
    rows += [(50_000, " ".join(f"## ** {k}" for k in range(100)), "it"), (50_001, " ".join(f"zz{k}" for k in range(200)), None)]
    kept = {r.doc_id for r in quality.keep(make_docs(rows)).select("doc_id").collect()}
    assert kept == {r[0] for r in rows if r[0] < 50_000}


def test_quality_counts(make_docs):
    text = "a b c x a b c\na  b\x0bc #|é\n\na  b\x0bc #|é\n a b"
    (r,) = quality.judge(make_docs([(1, text)])).collect()
    w = brute.words(text)
    again = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {i + k for i, g in enumerate(again) if again.count(g) > 1 for k in range(3)}
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), 4, 1, len(covered))


def test_near_duplicates(make_docs):
    found = {(r.id, r.n_shingles): r.component_id for r in neardup.groups(make_docs(ROWS, extra=True)).collect()}
    assert found[(1, 0)] == 1 and found[(2, 0)] == 2 and found[(3, 0)] == 3
    assert found[(5, 29_996)] == found[(7, 29_996)] == found[(10, 29_997)] == 5
    assert neardup.groups(make_docs(ROWS).limit(0)).collect() == []
    kept = ids(neardup.keep(make_docs(ROWS, extra=True)))
    assert kept == sorted([1, 2, 3, 4, 5, 6, 6, None, 8, 9, 11], key=repr)


def test_near_duplicates_chain(make_docs):
    """Links go through texts that are not linked themselves, across several buckets."""
    base = [f"w{i}" for i in range(200)]
    rows = []
    for step in range(40):
        base = [*base[4:], *[f"s{step}.{i}" for i in range(4)]]
        rows.append((step, " ".join(base)))
        rows.append((1000 + step, " ".join(f"alone{step}.{i}" for i in range(30))))
    found = {r.id: r.component_id for r in neardup.groups(make_docs(rows), width=3, percent=85).collect()}
    assert found == {k: c for k, (_, c) in brute.near_groups(rows, 3, 85).items()}
    assert {found[k] for k in range(40)} == {0}


def test_same_id_with_other_text_is_one_document(make_docs):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    found = neardup.groups(make_docs([(1, a), (2, a), (2, b), (3, b)])).collect()
    assert {r.component_id for r in found} == {1}


def test_lines(make_docs):
    gone = sorted((r.doc, r.no) for r in linededup.removals(make_docs(ROWS, extra=True)).distinct().collect())
    # The id 5 and 7 texts are equal lines; 8 has lines within two edits; 11 is one edit from 6.
    expected = brute.line_removals([r[:2] for r in ROWS if r[0] != 5 and r[0] != 7 and r[0] != 10], 2, 20)
    assert [x for x in gone if x[0] not in (5, 7, 10)] == sorted((k, no) for k, nos in expected.items() for no in nos)
    assert (7, 0) in gone and (5, 0) not in gone
    out = linededup.dedup(make_docs(ROWS, extra=True)).collect()
    assert {r.doc_id for r in out} == {1, 2, 3, 4, 5, 6, None, 8, 9, 10}
    assert all(r.n_chars == len(r.text or "") for r in out)


def test_spans(make_docs):
    passage = "Here begins a passage that is long. It goes on for some time and has more than enough words to count. So it ends."
    rows = [(1, f"Own start. {passage} Own end."), (2, f"{passage} Other end."), (3, None), (4, ""), (None, passage), (2, f"{passage} Other end."), (5, passage + " " + passage)]
    out = {r.row.doc_id: r for r in spans.rewrite(make_docs(rows, extra=True)).collect()}
    assert out[1].n_removed == 0 and out[1].new == rows[0][1] and out[None].new == passage
    assert "passage" not in out[2].new and out[2].new.endswith("Other end.") and "It goes on" not in out[5].new
    assert out[3].new is None and out[4].new == ""
    assert spans.rewrite(make_docs(rows).limit(0)).collect() == []
    assert spans.dedup(make_docs(rows, extra=True)).columns == make_docs(rows, extra=True).columns


def test_decontamination(make_docs, bench):
    docs = make_docs(ROWS, extra=True)
    hits = {r.row.doc_id: [h.item for h in r.hits] for r in decontam.scan(docs, bench).collect()}
    assert hits[6] == hits[None] == hits[11] == [1] and not any(hits[k] for k in (1, 2, 3, 4, 5, 8, 9))
    assert ids(decontam.keep(docs, bench)) == sorted([1, 2, 3, 4, 5, 7, 8, 9, 10], key=repr)
    assert decontam.scan(docs.limit(0), bench).collect() == []
    assert all(not r.hits for r in decontam.scan(docs, bench.limit(0)).collect())


def test_decontamination_of_fragments_and_short_items(spark, make_docs):
    """Fragments of 13 to 30 words from every word on; short items as whole words."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9)))
    item = [word() for _ in range(60)]
    filler = lambda: " ".join(f"{word()}x{k}" for k in range(8))
    docs = [(1000 * size + at, f"{filler()} ({' '.join(item[at : at + size])}). {filler()}") for size in range(13, 31) for at in range(61 - size)]
    docs += [(1, f"{filler()} {' '.join(item[20:32])} {filler()}"), (2, "So: two  Words, he said"), (3, "two wordsmiths"), (4, "Prime?"), (5, "primes"), (6, "two " + "z " * 9 + "words")]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "Two words"), (3, "prime"), (4, "?!")], "item_id long, text string")
    hits = {r.row.doc_id: [h.item for h in r.hits] for r in decontam.scan(make_docs(docs), bench).collect()}
    assert hits == {k: [1] if k >= 13_000 else {2: [2], 4: [3]}.get(k, []) for k, _ in docs}
    short = bench.filter("item_id = 3")
    assert sorted(r.row.doc_id for r in decontam.scan(make_docs(docs[-6:]), short).filter("size(hits) > 0").collect()) == [4]


@pytest.mark.parametrize("cycle", [[3, 1, 2], [1], [1, 100]])
def test_mixing(make_docs, cycle):
    rows = [(k, " ".join("w" * (k % 17)) if k % 5 else None, "en", ["a", "B", "é", None, "z"][min(k % 7, 4)]) for k in range(200)]
    rows += [(1000, " ".join("w" * 3000), "en", "a")]
    docs = make_docs(rows, extra=True)
    sized = mixing.sized(docs, "doc_id", "source", "text")
    got = mixing.decide(sized, mixing.plan(sized, mixing.cycled_weights(sized.select("source").distinct(), cycle)))
    got = {r.row.doc_id: (r.size, r.source_size, r.target, r.taken) for r in got.collect()}
    expected = brute.mixture([(r[0], r[1], r[3]) for r in rows], cycle)
    assert got == {k: (a, b, pytest.approx(c), d) for k, (a, b, c, d) in expected.items()}
    mixed = mixing.mix(docs, cycle)
    assert mixed.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert all(counts.get(k, 0) * size == taken for k, (size, _, _, taken) in got.items())


def test_urls(spark):
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
    rows = [(1, "https://WWW.Example.NET/en/1"), (2, "http://a.net/x?y#z"), (3, None), (4, "no scheme"), (5, "http://a.net"), (6, "x://sub.example.com/de/"),
            (7, "http://notexample.com/de/"), (8, "http://a.org/fr/a/b/c/d/e/f/g/h"), (8, "http://a.org/fr/a/b/c/d/e/f/g/h"), (None, "http://é.org/")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, host string")
    out = {(r.row.page_id, r.row.url): r for r in urls.judge(pages, rules).collect()}
    get = lambda k, u: (out[(k, u)].host, out[(k, u)].path, out[(k, u)].rule, out[(k, u)].verdict)
    assert get(1, rows[0][1]) == ("www.example.net", "/en/1", "example.net/en/", "allow")
    assert get(2, rows[1][1]) == ("a.net", "/x", "net/", "block")
    assert get(3, None)[:3] == ("", "", None) and get(4, "no scheme")[:3] == ("", "", None)
    assert get(5, "http://a.net")[:3] == ("a.net", "", None) and get(6, rows[5][1])[2:] == ("example.com/de/", "block")
    assert get(7, rows[6][1])[2] is None and get(8, rows[7][1])[2:] == ("org/fr/", "allow")
    assert urls.judge(pages.limit(0), rules).collect() == []


def test_url_templates(spark):
    """Numbers and unique names become wildcards; a bad branch stays apart and is rejected."""
    rows = [(i, f"http://h.test/shop/item{i}x/{i}.html", None) for i in range(200)]
    rows += [(1000 + i, f"http://h.test/ads/{i}", i % 20 > 0) for i in range(60)] + [(2000 + i, f"http://h.test/news/{i}", i % 20 == 0) for i in range(60)]
    rows += [(3000 + i, f"http://h.test/blog/{i}", i % 20 == 0) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    out = {r.row.page_id: (r.template, r.verdict) for r in urls.judge(pages, [], bad="bad").collect()}
    assert {out[i] for i in range(1000, 1060)} == {("/ads/{n}", "block")}
    assert {v for t, v in out.values() if "ads" not in t} == {"allow"}
    assert len({t for t, _ in out.values()}) < 8


def test_warc(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE", 300)
    pages = [(i, [None, "http://x/a b", "ü"][i % 3], [None, "", "<p>é</p>" * 50, f"<p>{i}</p>", "x" * 200_000][i % 5]) for i in range(1, 60)]
    pages += [(None, "u", "alone"), (None, "u", "")]
    frame = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, sum string")
    back = warc.read(warc.write(frame, scratch_dir(spark, "warc")))
    got = sorted(((r.page_id, bytes(r.payload).decode() if r.payload is not None else None, r.record_type, r.refers_to, r.payload_bytes) for r in back.collect()), key=repr)
    expected = []
    for page, _, html in pages:
        first = min((p for p, _, h in pages if p is not None and (h or "") == (html or "")), default=None)
        revisit = first is not None and page != first
        expected.append((page, None if revisit else html or "", "revisit" if revisit else "response", first if revisit else None, len((html or "").encode())))
    assert got == sorted(expected, key=repr)
    assert warc.read(warc.write(frame.limit(0), scratch_dir(spark, "warc"))).collect() == []
    large = warc.read(warc.write(frame, scratch_dir(spark, "warc"), min_bytes=300)).filter("record_type = 'revisit'")
    assert {r.payload_bytes for r in large.collect()} == {450, 200_000}


def test_personal_data(make_docs):
    rows = [*ROWS, (20, "mail a.b@c.example.org now"), (21, "ip 1.2.3.4 and 1.2.3.400"), (22, "card 4111 1111 1111 1111, call +49 (0) 30 123456")]
    docs = make_docs(rows, extra=True)
    out = {r.key: r for r in pii.find(docs, pii.fit(docs)).collect()}
    assert "email:5:22" in out[20].spans and "ip:3:10" in out[21].spans and "card:5:24" in out[22].spans
    assert (out[20].n_email, out[21].n_ip, out[22].n_card, out[22].n_phone) == (1, 1, 1, 1)
    assert out[1].spans == out[2].spans == "" and out[1].base_sha256.startswith("e3b0c442")
    assert pii.find(docs.limit(0), pii.fit(docs.limit(0))).collect() == []


def test_licenses(make_docs):
    rows = [*ROWS, (20, "Released under the MIT License.\nHe has a driving license."), (20, "Released under the MIT License.\nHe has a driving license."), (21, "Used under the terms of some odd license, see below")]
    out = [r for r in licenses.scan(make_docs(rows, extra=True)).collect() if r.key in (20, 21)]
    assert {(r.key, r.paragraph, r.family) for r in out if r.family == "mit"} == {(20, 0, "mit")}
    assert {r.family for r in out if r.key == 21} <= {"unknown", "none"}
    assert licenses.scan(make_docs(rows).limit(0)).collect() == []
    assert licenses.has_anchor(F.lit("x")) is not None
