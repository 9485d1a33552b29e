"""Quality rules by distribution divergence, in DataFrame functions only.

A document's histogram of character classes and its histogram of common words are
compared with those of its language by Jensen-Shannon distance (base 2, 0 to 1).
The reference of a language is the mean histogram of its documents, so one long
document weighs no more than a short one. Short documents are guarded: they have
too few characters or words for a distance to mean something.

Defined cases: a null or empty text has no words and fails the base rules. A
language with ``MIN_LANGUAGE_DOCS`` long documents or ``MIN_LANGUAGE_SHARE`` of them
has its own reference. A null language is compared with the nearest reference of all.
So are the classes of a rarer language, whose words are not judged, since none of the
references speaks for them. Without any reference by language, words are not judged
and classes are compared with the mean of all documents. Documents that lack a reference
meet those of all languages in blocks of about ``BLOCK``, joined by the number of the
block. Repeated rows are judged alike. An empty table gives an empty result. All columns
of the input are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakejobs.llm.common import SPACES, words, written

# Frequent function words of the languages that are told apart.
COMMON_WORDS = [
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "on", "with",
    "der", "die", "und", "das", "ist", "ein", "nicht", "von", "den", "zu", "mit", "auf",
    "le", "la", "les", "de", "et", "des", "un", "du", "que", "est", "pour", "dans",
    "el", "los", "y", "en", "las", "por", "con", "para", "una", "no", "se", "lo",
]
#: Character classes, taken off the text one after the other; what is left is "other".
CLASSES = [r"\p{Ll}+", SPACES, r"\p{Lu}+", r"[0-9]+", r"[#*$%&|<>]+", r"[.,;:!?'\"()-]+"]

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: The words histogram is judged from this many words on.
MIN_HISTOGRAM_WORDS = 100
MAX_CLASS_DISTANCE = 0.25
MAX_WORD_DISTANCE = 0.3
#: A language with so many long documents, or this share of them, has a reference.
MIN_LANGUAGE_DOCS = 100
MIN_LANGUAGE_SHARE = 0.01
#: References that documents without one of their own are compared with at a time, about.
BLOCK = 128


def profiles(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """All rows of ``docs`` as ``row`` and ``lang``, with base counts and histograms.

    n_classes and n_common are counts in the order of ``CLASSES`` and
    ``COMMON_WORDS``, each followed by the rest.
    """
    out = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    out = out.withColumn("left0", F.coalesce(F.col("row")[text], F.lit("")))
    for k, pattern in enumerate(CLASSES):
        out = out.withColumn(f"left{k + 1}", F.regexp_replace(f"left{k}", pattern, ""))
    sizes = [F.length(f"left{k}") for k in range(len(CLASSES) + 1)]
    out = out.select("row", "left0", F.array(*sizes).alias("sizes")).withColumn("w", words(F.col("left0")))
    lowered = F.transform(F.filter("w", lambda x: F.lower(x).isin(COMMON_WORDS)), F.lower)
    out = out.withColumn("common", lowered)
    counts = F.transform(F.lit(COMMON_WORDS), lambda word: F.size("common") - F.size(F.array_remove("common", word)))
    taken = [F.col("sizes")[k] - F.col("sizes")[k + 1] for k in range(len(CLASSES))]
    lines = F.filter(F.split("left0", "\n"), lambda x: F.length(F.regexp_replace(x, SPACES, "")) > 0)
    out = out.withColumn("lines", lines)
    for name, step in repeated_words(F.col("w")).items():
        out = out.withColumn(name, step)
    return out.select(
        "row",
        F.col("row")[lang].alias("lang"),
        F.size("w").cast("long").alias("n_words"),
        (F.col("sizes")[0] - taken[1]).cast("long").alias("word_chars"),
        taken[4].cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.array(*taken, F.col("sizes")[len(CLASSES)]).alias("n_classes"),
        F.array_append(counts, F.size("w") - F.size("common")).alias("n_common"),
        # A filter that reads this column stays above the counts. Pushed below, it
        # would repeat their nested expressions many times over.
        F.monotonically_increasing_id().alias("at"),
    )


def _shares(counts: str) -> Column:
    total = F.greatest(F.aggregate(counts, F.lit(0), lambda s, x: s + x), F.lit(1))
    return F.transform(counts, lambda x: x / total)


def references(profiled: DataFrame) -> DataFrame:
    """Mean histograms per language, and of all documents under ``ref_lang`` null.

    Columns ref_lang, ref_class, ref_word. Only documents that are long enough
    for a histogram count.
    """
    rows = profiled.filter((F.col("n_words") >= MIN_HISTOGRAM_WORDS) & (F.col("at") >= 0))
    rows = rows.select("lang", _shares("n_classes").alias("c"), _shares("n_common").alias("w"))
    bins = [F.col("c")[k] for k in range(len(CLASSES) + 1)] + [F.col("w")[k] for k in range(len(COMMON_WORDS) + 1)]
    names = [f"b{k}" for k in range(len(bins))]
    by_lang = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *[F.sum(b).alias(x) for b, x in zip(bins, names)])
    by_lang = written(by_lang, "language-sums")
    every = by_lang.agg(F.sum("n").alias("n"), *[F.sum(x).alias(x) for x in names]).withColumn("lang", F.lit(None).cast("string"))
    least = (by_lang.agg(F.sum("n")).first()[0] or 0) * MIN_LANGUAGE_SHARE
    own = by_lang.filter(F.col("lang").isNotNull() & ((F.col("n") >= least) | (F.col("n") >= MIN_LANGUAGE_DOCS)))
    means = [F.col(x) / F.col("n") for x in names]
    return own.unionByName(every).filter("n > 0").select(
        F.col("lang").alias("ref_lang"),
        F.array(*means[: len(CLASSES) + 1]).alias("ref_class"),
        F.array(*means[len(CLASSES) + 1 :]).alias("ref_word"),
    )


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two arrays of shares."""

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))


def repeated_words(w: Column, size: int = 3) -> dict[str, Column]:
    """Steps to ``n_repeat_words``, to be added one after the other.

    Windows of ``size`` words are hashed to 64 bits. Only a text in which a window
    comes twice is sorted; positions of its repeated windows then give the number
    of words that they cover.
    """
    n = F.size(w)
    window = F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[w[i + k] for k in range(size)])))
    h, s, p = F.col("win"), F.col("sorted_win"), F.col("at")
    again = F.filter(s, lambda x, k: (F.get(s, k - 1)["win"] == x["win"]) | (F.get(s, k + 1)["win"] == x["win"]))
    steps = F.transform(p, lambda x, k: F.least(F.lit(size), F.coalesce(F.get(p, k + 1) - x, F.lit(size))))
    return {
        "win": window,
        "sorted_win": F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.arrays_zip(h, F.sequence(F.lit(0), F.size(h) - 1).alias("i")))),
        "at": F.sort_array(F.transform(again, lambda x: x["i"])),
        "n_repeat_words": F.coalesce(F.aggregate(steps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"),
    }


def verdicts(profiled: DataFrame, refs: DataFrame) -> DataFrame:
    """The profiled rows with base_failed, class_distance, word_distance and kept."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    own = refs.filter("ref_lang IS NOT NULL")
    n = own.count()
    # Without references by language, the mean of all documents stands in for classes.
    each = own if n else refs.withColumn("ref_word", F.lit(None).cast("array<double>"))
    parts = max(1, -(-n // BLOCK))
    block = F.pmod(F.xxhash64("ref_lang"), F.lit(parts)).cast("int")
    blocks = written(each.groupBy(block.alias("block")).agg(F.collect_list(F.struct("ref_class", "ref_word")).alias("refs")), "reference-blocks")
    rows = profiled.withColumn("base_failed", failed)
    # References by language may be many, so they are broadcast only if they are small.
    rows = rows.join(own, F.col("lang") == F.col("ref_lang"), "left")
    classes, words_ = _shares("n_classes"), _shares("n_common")
    rows = rows.withColumns({c: F.lit(None).cast("double") for c in ("near_class", "near_word")})
    for k in range(parts):
        # The key is null for documents with a reference of their own, which are not compared here.
        lacks = F.when(F.col("ref_lang").isNull(), F.lit(k))
        rows = rows.join(F.broadcast(blocks.filter(F.col("block") == k)), lacks == F.col("block"), "left")
        rows = rows.withColumns({
            "near_class": F.least("near_class", F.array_min(F.transform("refs", lambda x: js_distance(classes, x["ref_class"])))),
            "near_word": F.least("near_word", F.array_min(F.transform("refs", lambda x: js_distance(words_, x["ref_word"])))),
        }).drop("block", "refs")
    rows = rows.withColumns({
        "class_distance": F.when(F.col("ref_lang").isNotNull(), js_distance(classes, F.col("ref_class"))).otherwise(F.col("near_class")),
        "word_distance": F.when(F.col("ref_lang").isNotNull(), js_distance(words_, F.col("ref_word"))).when(F.col("lang").isNull(), F.col("near_word")),
    })
    alike = F.coalesce(F.col("class_distance") <= MAX_CLASS_DISTANCE, F.lit(True))
    usual = (F.col("n_words") < MIN_HISTOGRAM_WORDS) | F.coalesce(F.col("word_distance") <= MAX_WORD_DISTANCE, F.lit(True))
    return rows.withColumn("kept", ~F.col("base_failed") & alike & usual).drop("ref_lang", "ref_class", "ref_word", "near_class", "near_word")


def judge(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """All rows of ``docs`` as ``row``, with their counts, distances and ``kept``."""
    profiled = profiles(docs, text, lang)
    return verdicts(profiled, written(references(profiled), "references"))


def judge_ids(docs: DataFrame, key: str, text: str = "text", lang: str = "lang") -> DataFrame:
    """Like ``judge``, with the ``key`` column alone as ``row``.

    The profiles are stored, which saves the second pass over the texts.
    """
    profiled = written(profiles(docs, text, lang).withColumn("row", F.struct(F.col("row")[key].alias(key))), "profiles")
    return verdicts(profiled, written(references(profiled), "references"))


def keep(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents that pass, with the columns they came with."""
    return judge(docs, text, lang).filter("kept AND at >= 0").select("row.*")
