"""License notices that no list of words would have let through, and wrapped ones."""

import math

from pyspark.sql import functions as F

from lakejobs.llm import licenses

PLAIN = {
    0: ("Distributed under the GPL v3.", "gpl"),
    1: ("Text is available under CC BY-SA 4.0.", "cc-by"),
    2: ("Code: Apache-2.0", "apache"),
    3: ("Code: GPL-3.0", "gpl"),
    4: ("Code: BSD-3-Clause", "bsd"),
    5: ("Dieses Werk ist lizenziert unter einer Creative Commons Namensnennung 4.0 International Lizenz.", "cc-by"),
    6: ("Veröffentlicht unter der MIT-Lizenz.", "mit"),
}
WRAPPED = {
    10: (" * Redistribution and use in source and binary\n * forms, with or without modification, are\n * permitted provided that the following\n * conditions are met:", "bsd"),
    11: ("Permission is hereby granted, free of\ncharge, to any person obtaining a copy\nof this software and associated\ndocumentation files (the \"Software\"), to deal", "mit"),
    12: ("This program is free software: you can\nredistribute it and/or modify it under the\nterms of the GNU General Public License as\npublished by the Free Software Foundation.", "gpl"),
}


def fillers(n):
    w = "the house of old trees and a river in spring was near his garden where people met to talk about weather".split()
    return [" ".join(w[(i * 7 + j * (i % 5 + 1)) % len(w)] for j in range(9)) + "." for i in range(n)]


def test_notices_without_anchors_and_wrapped_ones(make_docs):
    plain = fillers(300)
    notices = {**PLAIN, **WRAPPED}
    rows = [(k, f"{plain[k]}\n{text}\n\n{plain[k + 1]}") for k, (text, _) in notices.items()]
    rows += [(100 + k, "\n".join(plain[k : k + 3])) for k in range(0, 297, 3)]
    out = licenses.scan(make_docs(rows)).collect()
    found = {(r.key, r.family) for r in out if r.family != "unknown"}
    assert found == {(k, family) for k, (_, family) in notices.items()}
    assert {r.key for r in out} == set(notices)


def test_units_are_lines_and_whole_paragraphs(make_docs):
    docs = make_docs([(1, "a b\nc d.\ne\n\nf\n # \ng"), (1, "x"), (None, "y"), (2, None), (3, "")])
    rows = licenses.paragraphs(docs, "doc_id", "text").filter(F.length("text") > 0).collect()
    assert sorted((r.first, r.paragraph, r.text, r.joined) for r in rows if r.key == 1) == [
        (0, 0, "a b", False), (0, 0, "a b c d.", True), (0, 0, "x", False), (0, 1, "c d.", False),
        (2, 2, "e", False), (4, 4, "f", False), (5, 5, "#", False), (6, 6, "g", False)]
    assert len({r.row for r in rows}) == 3


def test_paragraphs_that_are_left_out_would_be_none(spark, make_docs):
    """The cheap look for pieces of telling n-grams loses nothing that the classifier finds."""
    docs = make_docs([(k, "\n".join(fillers(300)[k : k + 30])) for k in range(0, 270, 30)])
    vectors, model, temperature = licenses.fit(spark, docs)
    signs = licenses.telling(vectors, model, temperature)
    words = sorted({w for gram in vectors.vocabulary for w in gram.split(" ")})
    texts = [" ".join(words[i % len(words)] for i in range(k, k + 3 * n, 3)) for k in range(120) for n in (1, 4, 40)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("left", ~F.arrays_overlap(licenses.pieces(F.col("text")), F.lit(signs)))
    rows = licenses.scored(rows.withColumn("w", licenses.split_words(F.col("text"))), vectors, model)
    rows = rows.filter("left").select("scores", F.exp(-licenses.spread_of(temperature)).alias("p")).collect()
    assert len(rows) > 5
    bias = model.interceptVector.toArray() - model.interceptVector[licenses.FAMILIES.index(licenses.NONE)]
    # A text of unknown words has the probability of the biases.
    least = min(licenses.SURE, 1 / sum(math.exp(x / temperature) for x in bias))
    assert all(r.p >= least - 1e-9 and max(r.scores) == r.scores[licenses.FAMILIES.index(licenses.NONE)] for r in rows)
