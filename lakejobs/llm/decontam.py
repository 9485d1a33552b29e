"""Benchmark decontamination by q-gram lemma filtering.

Benchmark items are cut into overlapping windows. A window of m characters that
occurs in a text with at most k edits shares m + 1 - q - k q of its q-grams with
it on k + 1 neighbouring diagonals; hits are counted in overlapping diagonal
bands, and bands with enough of them are verified by a banded alignment.

Fragments that are too short to hold a window are found if ``RUN_WORDS`` words of
them stand in the text as they are, from whatever word of the item on: all such runs
of an item are looked up by their 64-bit names. Items of fewer than ``MIN_CHARS``
characters are looked up whole in the same way. Words are runs of letters, marks and
numbers; what stands between them does not matter.

Windows and runs are searched in blocks of bounded size. A block is collected, indexed and
sent to all tasks; texts are scanned once per block and never shuffled. One block
holds about 2,000 items of average length.

Texts are compared lower-cased with single spaces. Defined cases: a null or empty
text has no hits; items that are null or have no words are not searched. A short item
of common words hits all texts that have them in a row. Equal items are found
each under its own id. Ties between places go to the fewest edits, then the first
place. Empty tables give no hits. All columns are carried along as a struct.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakejobs.llm.qgrams import Block, Runs, codes, normalised, searched, word_bounds

#: Characters of a window; windows start every half of it.
WINDOW = 120
#: Shorter items are searched as they are, on word bounds.
MIN_CHARS = 32
#: Words in a row that are a fragment of an item.
RUN_WORDS = 13
#: Runs that start in a stored piece of an item.
PIECE = 200
#: Edits allowed, as a share of a window's characters.
RATE = 0.08
#: Characters of windows in a block, about; the index takes some 50 bytes for each.
BLOCK_CHARS = 500_000


def _windows(batches):
    import pyarrow as pa

    for batch in batches:
        items, windows, exact = [], [], []
        for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
            whole = normalised(text)
            parts = []
            if len(whole) >= MIN_CHARS:
                last = max(len(whole) - WINDOW, 0)
                parts = [(whole[at : at + WINDOW], False) for at in sorted({*range(0, last, WINDOW // 2), last})]
            starts, ends = word_bounds(codes(whole))
            n = len(starts)
            if n >= RUN_WORDS or 0 < n and len(whole) < MIN_CHARS:
                for at in range(0, max(n - RUN_WORDS + 1, 1), PIECE):
                    parts.append((whole[starts[at] : ends[min(at + PIECE + RUN_WORDS - 1, n) - 1]], True))
            for window, whether in parts:
                items.append(item)
                windows.append(window)
                exact.append(whether)
        columns = [pa.array(items, pa.int64()), pa.array(windows, pa.string()), pa.array(exact, pa.bool_())]
        yield pa.RecordBatch.from_arrays(columns, ["item", "window", "exact"])


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", passage: str = "text") -> DataFrame:
    """All rows of ``docs`` as ``row``, with ``hits``: the items found in the text.

    A hit has the item's id, the place in the normalised text and the edits.
    """
    windows = benchmark.select(benchmark[item].cast("long").alias("item"), benchmark[passage].alias("text"))
    windows = windows.mapInArrow(_windows, "item long, window string, exact boolean")
    chars = windows.agg(F.sum(F.length("window"))).first()[0] or 0
    blocks = -(-chars // BLOCK_CHARS)
    hits = F.lit(None).cast("array<struct<item:bigint,start:bigint,edits:int>>")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text].alias("text"), hits.alias("hits"))
    schema = rows.schema
    context = docs.sparkSession.sparkContext
    for number in range(blocks):
        part = windows.filter(F.pmod(F.xxhash64("item", "window"), F.lit(blocks)) == number).orderBy("item", "window", "exact").collect()
        if part:
            near, exact = ([r for r in part if r["exact"] == x] for x in (False, True))
            runs = Runs([r["item"] for r in exact], [r["window"] for r in exact], RUN_WORDS)
            block = context.broadcast(Block([r["item"] for r in near], [r["window"] for r in near], RATE, runs))
            rows = rows.mapInArrow(_later(block), schema)
    return rows.select("row", F.coalesce("hits", F.array().cast(schema["hits"].dataType)).alias("hits"))


def _later(block):
    """The search, with the block taken from its broadcast inside the task."""

    def run(batches):
        return searched(block.value)(batches)

    return run


def keep(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents in which no benchmark item was found, with the columns they came with."""
    return scan(docs, benchmark, text).filter(F.size("hits") == 0).select("row.*")
