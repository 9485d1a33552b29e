"""License scans by a trained paragraph classifier, in DataFrame functions only.

1. Every line is scored, and every paragraph that runs over several lines as a whole
   too: up to a blank line or a line that ends a sentence. No list of words decides
   what is looked at.
2. The scores are those of a logistic regression over sparse word n-grams, with a
   class for each license family and one for all else. They are divided by a
   temperature that is fitted on held-out rows.
3. A family that reaches ``SURE`` must be confirmed by one of its templates, of
   which the paragraph has to hold enough words. All other paragraphs that are
   not clearly something else are "unknown".
4. What a line says by itself stands. A whole paragraph adds a family that none of
   its lines has, and takes the place of its unknown lines.

The classifier is trained on the notices below, their mentions with words left
out, and a bounded sample of corpus paragraphs as negatives, of which those that
may speak of rights are left out. Its vocabulary is at most ``VOCABULARY`` n-grams,
so the model may be broadcast.

Defined cases: a null or empty text has no paragraphs. Nulls and repeats of ids are
told apart; repeated rows give the same result. Empty tables give empty results.
Other columns are not looked at.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel, NGram
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakejobs.llm.common import SPACES, written

# Words by which a paragraph may speak of rights, so that it is no negative, and notices of license families.
ANCHORS = ["licen", "copyright", "spdx", "permission", "redistribut", "all rights reserved", "public domain", "creative commons", "warrant"]
NAMES = r"lizen[sz]|\b(apache|[al]?gpl|bsd|mpl|cc0|cc[ -]by)"
NOTICES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "This project is released under the Apache 2.0 license.",
        "Code: Apache-2.0",
        "Lizenziert unter der Apache-Lizenz, Version 2.0.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Code: MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "Veröffentlicht unter der MIT-Lizenz.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Licensed under the GPL version 2 or later.",
        "Distributed under the GPL v3.",
        "Code: GPL-3.0",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "Distributed under the terms of the LGPL license.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the BSD 3-Clause License.",
        "Licensed under the 2-clause BSD license.",
        "Code: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Text is available under the CC BY-NC-SA 4.0 license.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Text is available under the CC BY-SA 4.0 license.",
        "Text is available under CC BY-SA 4.0.",
        "Dieses Werk ist lizenziert unter einer Creative Commons Namensnennung 4.0 International Lizenz.",
    ],
    "cc0": [
        "Released into the public domain under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
}
OTHER_USES = [
    "She renewed her driving license at the office last week.",
    "The restaurant lost its liquor license after the inspection.",
    "A licensed physician must sign the form.",
    "He asked for permission to leave early.",
    "Visitors need written permission to enter the site.",
    "The court dealt with a copyright dispute between two publishers.",
    "Copyright law differs from country to country.",
    "All rights reserved.",
    "Copyright 2020 Example Corporation. All rights reserved.",
    "The warranty covers repairs for two years.",
    "A search warrant was issued on Monday.",
    "The city began to redistribute the land among the farmers.",
    "The library is in the public domain since last year, the paper wrote.",
    "The license plate was found near the bridge.",
    "Pilots must hold a valid licence and a medical certificate.",
    "No part of this book may be reproduced without permission of the publisher.",
    "He studied physics at MIT and works in Boston.",
    "The Apache helicopter landed near the village.",
    "The code of the door was changed under the new version of the rules.",
    "Er wurde unter der Bedingung entlassen, mit der Arbeit zu beginnen.",
]
NONE = "none"
VOCABULARY = 4_000
#: Corpus paragraphs at most that the classifier is trained on as negatives.
NEGATIVES = 2_000
MAX_ITERATIONS = 40
TEMPERATURES = [0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0]
SURE = 0.5
#: Share of a template's words, by weight, that a paragraph must hold.
CONFIRMED = 0.5


def split_words(text: Column) -> Column:
    """Lower-case words without the punctuation around them."""
    bare = F.regexp_replace(F.lower(text), r"(?<![a-z0-9])[^\p{L}\p{N}\x20\x09-\x0D]+|[^\p{L}\p{N}\x20\x09-\x0D]+(?![a-z0-9])", " ")
    return F.array_remove(F.split(bare, SPACES), "")


def grams(w: Column) -> Column:
    """Distinct word 1-, 2- and 3-grams."""
    n = F.size(w)
    parts = [w]
    for size in (2, 3):
        starts = F.when(n >= size, F.sequence(F.lit(0), n - size)).otherwise(F.array().cast("array<int>"))
        parts.append(F.transform(starts, lambda i, size=size: F.concat_ws(" ", F.slice(w, i + 1, size))))
    return F.array_distinct(F.concat(*parts))


def has_anchor(text: Column) -> Column:
    """Whether a text may speak of rights. Such ones are no negatives; all are scored."""
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [low.contains(a) for a in ANCHORS]) | low.rlike(NAMES)


def training_rows(spark: SparkSession, paragraphs: DataFrame) -> DataFrame:
    """(family, text, held) of notices, their shortened mentions, other uses and corpus lines."""
    rows = [(family, notice) for family, notices in NOTICES.items() for notice in notices] + [(NONE, t) for t in OTHER_USES]
    table = spark.createDataFrame(rows, "family string, text string")
    w = F.split("text", " ")
    copies = table.select("family", "text", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("copy"))
    kept = F.filter(w, lambda x, i: (F.col("copy") == 0) | (F.pmod(F.xxhash64(x, i, F.col("copy")), F.lit(8)) > 0))
    copies = copies.select("family", F.array_join(kept, " ").alias("text"), "copy")
    negatives = paragraphs.filter(~has_anchor(F.col("text"))).select("text", F.md5("text").alias("h")).orderBy("h", "text").limit(NEGATIVES)
    negatives = negatives.select(F.lit(NONE).alias("family"), "text", F.pmod(F.xxhash64("text"), F.lit(4)).cast("int").alias("copy"))
    return copies.unionByName(negatives).select("family", "text", (F.col("copy") % 4 == 3).alias("held"))


FAMILIES = sorted([*NOTICES, NONE])


def scored(rows: DataFrame, vectors: CountVectorizerModel, model: LogisticRegressionModel) -> DataFrame:
    """Adds ``scores``, one for each of ``FAMILIES``, to rows with words ``w``; no row is moved for it."""
    out = NGram(n=3, inputCol="w", outputCol="w3").transform(NGram(n=2, inputCol="w", outputCol="w2").transform(rows))
    out = model.transform(vectors.transform(out.withColumn("grams", F.concat("w", "w2", "w3"))))
    # Exploded, as a filter on plain columns would be pushed below and make the scores for each use anew.
    once = F.explode(F.array(vector_to_array("rawPrediction"))).alias("scores")
    return out.select(*rows.columns, once)


def spread_of(temperature: float) -> Column:
    """The logarithm of the sum that the highest of ``scores`` is divided by to be a probability."""
    high = F.array_max("scores")
    return F.log(F.aggregate("scores", F.lit(0.0), lambda a, x: a + F.exp((x - high) / temperature)))


def fit(spark: SparkSession, docs: DataFrame, text: str = "text") -> tuple[CountVectorizerModel, LogisticRegressionModel, float]:
    """(n-grams, classifier, temperature); the classifier's labels are places in ``FAMILIES``."""
    lines = docs.select(F.explode(F.split(F.col(text), "\n")).alias("text"))
    lines = lines.filter(F.length("text").between(20, 400))
    # Stored first, or the words of all lines would be made below the limit, and all be sorted.
    rows = written(training_rows(spark, lines), "license-negatives").withColumn("w", split_words(F.col("text")))
    rows = written(rows.withColumn("grams", grams(F.col("w"))), "license-training")
    rows = rows.withColumn("label", F.array_position(F.lit(FAMILIES), F.col("family")).cast("double") - 1)
    vectors = CountVectorizer(inputCol="grams", outputCol="features", vocabSize=VOCABULARY, minDF=2.0, binary=True).fit(rows)
    model = LogisticRegression(family="multinomial", regParam=0.002, elasticNetParam=0.2, maxIter=MAX_ITERATIONS, standardization=False)
    model = model.fit(vectors.transform(rows.filter("NOT held"))).setProbabilityCol("").setPredictionCol("")
    held = scored(rows.filter("held").drop("grams"), vectors, model)
    held = held.select("scores", (F.array_max("scores") - F.get("scores", F.col("label").cast("int"))).alias("short"))
    losses = [F.avg(spread_of(t) + F.col("short") / t) for t in TEMPERATURES]
    return vectors, model, min(zip(held.agg(*losses).first(), TEMPERATURES))[1]


def pieces(text: Column) -> Column:
    """The runs of letters and digits in lower case: a cheap way to see that a word is not there."""
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+")


def telling(vectors: CountVectorizerModel, model: LogisticRegressionModel, temperature: float) -> list[str]:
    """A piece of each n-gram that may lift a paragraph above ``NONE``; without any it is none.

    That are the n-grams that speak for any family rather than for none, but for some
    common ones that cannot do it, not even all of them together. Of an n-gram, the rarest
    piece is taken, by its place in the vocabulary.
    """
    none = FAMILIES.index(NONE)
    weights, bias = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    margins, sums = np.maximum(weights - weights[none], 0), bias - bias[none]
    place = {gram: j for j, gram in enumerate(vectors.vocabulary)}
    out = set()
    for gram, j in place.items():
        # All classes together, of which none has 1, must stay below what leaves it ``SURE``.
        if np.exp((sums + margins[:, j]) / temperature).sum() < 1 / SURE:
            sums = sums + margins[:, j]
        elif margins[:, j].any():
            out.add(max((x for x in re.split(r"[\W_]+", gram) if x), key=lambda x: place.get(x, len(place))))
    return sorted(out)


def templates(spark: SparkSession) -> DataFrame:
    """(family, templates): the distinct words of each notice with their weights, 1 at most."""
    notices = [(family, notice) for family, all_of in NOTICES.items() for notice in all_of]
    table = spark.createDataFrame(notices, "family string, notice string")
    table = table.select("family", "notice", F.explode(F.array_distinct(split_words(F.col("notice")))).alias("word"))
    # A word counts the less, the more families use it.
    common = table.groupBy("word").agg((1 / F.count_distinct("family")).alias("weight"))
    each = table.join(common, "word").groupBy("family", "notice").agg(F.sort_array(F.collect_list(F.struct("word", "weight"))).alias("template"))
    return each.groupBy("family").agg(F.collect_list("template").alias("templates"))


def classify(spark: SparkSession, paragraphs: DataFrame, vectors: CountVectorizerModel, model: LogisticRegressionModel, temperature: float) -> DataFrame:
    """The rows that are not clearly something else, with their family or "unknown" and its probability."""
    rows = paragraphs.filter(F.arrays_overlap(pieces(F.col("text")), F.lit(telling(vectors, model, temperature))))
    rows = scored(rows.withColumn("w", split_words(F.col("text"))), vectors, model)
    top = F.element_at(F.lit(FAMILIES), F.array_position("scores", F.array_max("scores")).cast("int"))
    rows = rows.withColumn("guess", top).withColumn("probability", F.exp(-spread_of(temperature)))
    rows = rows.filter((F.col("guess") != NONE) | (F.col("probability") < SURE)).drop("scores")
    rows = rows.join(F.broadcast(templates(spark)), F.col("guess") == F.col("family"), "left").drop("family")

    def weight(template: Column, counted) -> Column:
        return F.aggregate(template, F.lit(0.0), lambda a, x: a + F.when(counted(x["word"]), x["weight"]).otherwise(0.0))

    held = F.array_max(F.transform("templates", lambda t: weight(t, lambda x: F.array_contains("w", x)) / weight(t, lambda x: F.lit(True))))
    sure = (F.col("guess") != NONE) & (F.col("probability") >= SURE) & (held >= CONFIRMED)
    return rows.withColumn("family", F.when(sure, F.col("guess")).otherwise("unknown")).drop("w", "guess", "templates")


def paragraphs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(row, key, first, paragraph, text, joined): each line, and each paragraph of several lines as one.

    ``paragraph`` is a line's number, ``first`` that of the paragraph's first line. A
    paragraph ends with a blank line, a sentence that ends with a line, or the text.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs[key].alias("key"), F.split(docs[text], "\n", -1).alias("lines"))
    blank = lambda c: ~c.rlike(r"[\p{L}\p{N}]")
    ended = lambda c: c.rlike(r"""[.!?:;]["')\]*/]*\s*$""") | blank(c)
    ends = F.transform("lines", lambda x, i: F.when(ended(x) | (i + 1 == F.size("lines")) | blank(F.get("lines", i + 1)), i))
    rows = rows.withColumn("ends", F.filter(ends, lambda i: i.isNotNull()))
    first = lambda k: F.when(k > 0, F.get("ends", k - 1) + 1).otherwise(0)
    part = F.transform("ends", lambda end, k: F.struct(first(k).alias("first"), F.slice("lines", first(k) + 1, end - first(k) + 1).alias("part")))
    rows = rows.select("row", "key", F.explode(part).alias("p")).select("row", "key", "p.first", "p.part")
    unit = lambda at, text, joined: F.struct(at.cast("int").alias("paragraph"), F.trim(text).alias("text"), F.lit(joined).alias("joined"))
    units = F.transform("part", lambda x, i: unit(F.col("first") + i, x, False))
    whole = F.array(unit(F.col("first"), F.array_join("part", " "), True))
    units = F.when(F.size("part") > 1, F.concat(units, whole)).otherwise(units)
    units = F.filter(units, lambda x: x["text"] != "")
    return rows.select("row", "key", "first", F.explode(units).alias("u")).select("row", "key", "first", "u.*")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, paragraph, text, family, probability) of every paragraph that is a notice, or may be one ("unknown")."""
    spark = docs.sparkSession
    vectors, model, temperature = fit(spark, docs, text)
    found = written(classify(spark, paragraphs(docs, key, text), vectors, model, temperature), "license-paragraphs")
    lines, whole = found.filter("NOT joined"), found.filter("joined AND family <> 'unknown'")
    same = whole.select("row", "first", F.lit(True).alias("named"))
    kept = lines.join(same, ["row", "first"], "left").filter("family <> 'unknown' OR named IS NULL")
    added = whole.join(lines.select("row", "first", "family"), ["row", "first", "family"], "left_anti")
    columns = ["key", "paragraph", "text", "family", "probability"]
    return kept.select(*columns).unionByName(added.select(*columns))
