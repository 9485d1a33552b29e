"""Substring dedup by sliding sentence spans.

A span is a run of consecutive sentences: from each sentence on the shortest run
of at least two with ``MIN_WORDS`` words, or a sentence of ``LONG_WORDS`` words
by itself. All spans are hashed and joined over the corpus; of equal spans the
first stays, by id and then place, and the sentences that any other one covers
are removed. A passage of more than ``LONG_WORDS`` + ``MIN_WORDS`` words that
begins at a sentence is covered to its last whole span, wherever it is repeated.

Sentences end after ``.``, ``!`` or ``?`` with space behind, or at a line's end,
and keep the space that follows them; they are compared lower-cased, word by word.

Only the first place of a span in a document is looked up globally, since the
others are never first. Spans are reduced to the smallest and largest id per hash
before the shuffle, and a bitmap of fixed size keeps spans and texts that are not
concerned out of the joins, so a passage that is in a third of all documents costs
a row per document.

Defined cases: a null or empty text has no sentences and stays as it is. A null id
takes no part and stays whole. Rows with the same id are one document: their equal
spans are all first. Empty tables give empty results. Other columns are carried
along; a column ``n_chars`` follows the new text. Hashes have 128 bits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakejobs.llm.common import marked, written

MIN_WORDS = 20
LONG_WORDS = 40
#: The end of a sentence, with the space that belongs to it.
END = r"[.!?][\x20\x09-\x0D]+|\n[\x20\x09-\x0D]*"
_ENDS = re.compile(END)
BATCH = 20_000


def sentences(text: str) -> list[str]:
    """The sentences of a text; joined they are the text."""
    ends = [m.end() for m in _ENDS.finditer(text)]
    return [x for x in (text[a:b] for a, b in zip([0, *ends], [*ends, len(text)])) if x]


def spans(parts: list[str]) -> Iterator[tuple[int, int, bytes]]:
    """(first sentence, number of sentences, content) of every span."""
    keys = [x.lower().encode("utf-8", "surrogatepass").split() for x in parts]
    sizes = [len(x) for x in keys]
    joined = [b" ".join(x) for x in keys]
    end, total = 0, 0
    for at in range(len(parts)):
        if not sizes[at]:
            continue
        if sizes[at] >= LONG_WORDS:
            yield at, 1, joined[at]
            continue
        end, total = at + 1, sizes[at]
        while end < len(parts) and (total < MIN_WORDS or end == at + 1):
            total += sizes[end]
            end += 1
        if total >= MIN_WORDS and end > at + 1:
            yield at, end - at, b"\n".join(joined[at:end])


def _places(local: bool):
    """(id, text) to (h1, h2, doc, at, n): first places of spans, or the repeated ones within a text."""

    def rows(batches):
        for batch in batches:
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                if doc is None:
                    continue
                seen = set()
                for at, n, content in spans(sentences(text.as_py() or "")):
                    name = xxhash.xxh3_128_digest(content)
                    if (name in seen) == local:
                        yield name, doc, at, n
                    seen.add(name)

    def run(batches):
        part = []

        def out():
            pair = np.frombuffer(b"".join(x[0] for x in part), np.int64).reshape(-1, 2)
            rest = [pa.array(x, pa.int64()) for x in zip(*(x[1:] for x in part))]
            return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), *rest], ["h1", "h2", "doc", "at", "n"])

        for row in rows(batches):
            part.append(row)
            if len(part) == BATCH:
                yield out()
                part = []
        if part:
            yield out()

    return run


def _rewritten(batches):
    """(row, text, covers) to (row, text, n_sentences, n_removed) with covered sentences left out."""
    for batch in batches:
        texts, counts, removed = [], [], []
        for text, covers in zip(batch.column("text").to_pylist(), batch.column("covers").to_pylist()):
            parts = sentences(text or "")
            gone = {k for c in covers or () for k in range(c["at"], c["at"] + c["n"])}
            left = [x for k, x in enumerate(parts) if k not in gone]
            texts.append("".join(left) if gone else text)
            counts.append(len(parts))
            removed.append(len(parts) - len(left))
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())],
            ["row", "new", "n_sentences", "n_removed"],
        )


def covers(texts: DataFrame) -> DataFrame:
    """(id, covers): the spans of each document that are not the first of their kind."""
    schema = "h1 long, h2 long, doc long, at long, n long"
    first = texts.mapInArrow(_places(False), schema)
    shared = first.groupBy("h1", "h2").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low < high")
    shared = written(shared.select("h1", "h2", "low"), "shared-spans")
    later = marked(first, "h1", shared).filter("likely").join(shared, ["h1", "h2"]).filter("doc > low")
    again = texts.mapInArrow(_places(True), schema)
    both = later.select("doc", "at", "n").unionByName(again.select("doc", "at", "n"))
    return both.groupBy("doc").agg(F.collect_set(F.struct("at", "n")).alias("covers")).withColumnRenamed("doc", "id").select("id", "covers")


def rewrite(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows of ``docs`` as ``row``, with the ``new`` text, n_sentences and n_removed."""
    found = written(covers(docs.select(docs[key].cast("long").alias("id"), docs[text].alias("text"))), "covered")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[key].cast("long").alias("key"), docs[text].alias("text"))
    rows = marked(rows, "key", found)
    none = F.lit(None).cast(found.schema["covers"].dataType)
    sure = rows.filter("NOT likely").select("row", "text", none.alias("covers"))
    rest = rows.filter("likely").join(found, F.col("key") == F.col("id"), "left").select("row", "text", "covers")
    schema = f"row {docs.select(F.struct(*[docs[c] for c in docs.columns]).alias('row')).schema['row'].dataType.simpleString()}"
    return sure.unionByName(rest).mapInArrow(_rewritten, f"{schema}, new string, n_sentences long, n_removed long")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without the covered sentences, with the columns they came with."""
    out = rewrite(docs, key, text)
    fields = []
    for name, kind in docs.dtypes:
        new = F.col("new") if name == text else F.length("new").cast(kind) if name == "n_chars" else F.col("row")[name]
        fields.append(F.when(F.col("n_removed") > 0, new).otherwise(F.col("row")[name]).alias(name))
    return out.select(*fields)
