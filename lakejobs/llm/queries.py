"""The registered queries: thin forms of the operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakejobs.llm import decontam, licenses, linededup, mixing, neardup, pii, prefixes, quality, secretscan, spans, spelling, urls, warc
from lakejobs.llm.common import written
from lakejobs.session import load, scratch_dir


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its base counts and the verdict of the quality rules."""
    judged = quality.judge_ids(load(spark, sf_dir, "documents"), "doc_id")
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("row.doc_id", *counts, "base_failed", "kept")


def op2_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its set and the smallest id it is linked with."""
    found = neardup.groups(load(spark, sf_dir, "documents"), width=3, percent=85)
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", kept.alias("kept"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark items that were found in it."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.scan(docs, load(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.transform("hits", lambda x: x["item"])))
    out = found.select("row.doc_id", items.alias("items"), F.array_min(F.transform("hits", lambda x: x["edits"])).alias("least_edits"))
    return out.select("doc_id", (F.size("items") > 0).alias("contaminated"), F.size("items").cast("long").alias("n_items"), F.array_join("items", ",").alias("items"), "least_edits")


def op4_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its numbers of sentences, all and removed, and the text that is left."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return spans.rewrite(docs).select("row.doc_id", "n_sentences", "n_removed", F.col("new").alias("text"))


#: The rules of the URL filter: verdict, host and path.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its host, path, the rule that fits and the verdict."""
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    judged = urls.judge(pages, URL_RULES)
    return judged.select("row.page_id", "host", "path", "rule", "verdict", "template")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its number of lines, and the numbers of those removed."""
    docs = load(spark, sf_dir, "documents")
    gone = linededup.removals(docs).groupBy("doc").agg(F.array_sort(F.collect_set("no")).alias("nos"))
    lines = docs.select("doc_id", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long").alias("n_lines"))
    out = lines.join(gone, lines["doc_id"] == gone["doc"], "left")
    n = F.coalesce(F.size("nos"), F.lit(0)).cast("long")
    return out.select("doc_id", "n_lines", n.alias("n_removed"), F.coalesce(F.array_join("nos", ","), F.lit("")).alias("removed"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as its record was read back from the archives."""
    archives = warc.write(load(spark, sf_dir, "pages"), scratch_dir(spark, "warc"))
    records = warc.read(archives, with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its size, its source's size and target, and the words taken."""
    rows = mixing.sized(load(spark, sf_dir, "documents"), "doc_id", "source", "text")
    rows = written(rows.withColumn("row", F.struct("row.doc_id")), "mix-rows")
    weights = mixing.cycled_weights(rows.select("source").distinct(), [3, 1, 2])
    mixed = mixing.decide(rows, written(mixing.plan(rows, weights), "mix-plan"))
    return mixed.select("row.doc_id", "size", "source_size", "target", "taken")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its counts of personal data, and all spans."""
    docs = load(spark, sf_dir, "documents")
    return pii.find(docs, pii.fit(docs)).withColumnRenamed("key", "doc_id")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its paragraphs about rights: how many, which families, unknown ones."""
    docs = load(spark, sf_dir, "documents")
    found = licenses.scan(docs)
    found = found.select("key", "paragraph", "family").distinct().groupBy("key").agg(
        F.count(F.lit(1)).alias("n_notices"),
        F.count_if(F.col("family") == "unknown").alias("n_unknown"),
        F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"),
    )
    out = docs.select("doc_id").join(found, docs["doc_id"].eqNullSafe(found["key"]), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", zero("n_notices"), zero("n_unknown"), F.coalesce("families", F.lit("")).alias("families"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with its form and root."""
    return spelling.variants(load(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its counts of secrets, and all spans."""
    return secretscan.find(load(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations."""
    nodes = prefixes.trie(load(spark, sf_dir, "conversations"))
    return nodes.withColumnsRenamed({"conv": "conv_id", "parent_conv": "parent_conv_id", "saved": "saved_tokens", "sha": "ends_sha256"})


QUERIES = {"op1_quality_rules": op1_quality_rules, "op2_minhash_neardup": op2_minhash_neardup, "op3_decontamination": op3_decontamination, "op4_sentence_spans": op4_sentence_spans, "op5_url_filter": op5_url_filter, "op6_line_dedup": op6_line_dedup, "op7_warc": op7_warc, "op8_mixing": op8_mixing, "op9_personal_data": op9_personal_data, "op10_license_scan": op10_license_scan, "op11_spelling_variants": op11_spelling_variants, "op12_secret_scan": op12_secret_scan, "op13_conversation_trie": op13_conversation_trie}
