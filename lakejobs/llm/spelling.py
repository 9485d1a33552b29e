"""Spelling variant grouping: words one letter apart, found by bidirectional FM-index search.

Words are counted over all texts, summed up in each task before they are shuffled. A
word and a variant of it agree in the first half of the word or in the second one. So
the vocabulary is laid out twice, by length and letters and by length and letters
from the end, and cut into shards of about ``SHARD`` words each. A word is looked up
in the shards that hold words with its half, for the first halves in one layout
and for the second halves, read backwards, in the other; a pair that agrees in both
is taken from the first. In a shard the half is matched exactly and the rest with
one error (:mod:`lakejobs.llm.fmindex`).

No group of words is gathered but the words of a shard, which are indexed; the words
that are looked up stream past. Only the bounds of the shards come to the driver, one
word for each. Counts, links and rounds of following forms are joins and sums.

Defined cases: a null or empty text has no words. A null key counts as an empty one.
Repeated rows count each time. Of near words with the same count, the smallest in
code-point order is the form. An empty table, or one without words that come often
enough, gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakejobs.llm.common import written
from lakejobs.llm.fmindex import Index

LETTERS = "[a-zÀ-ÿ]"
#: Words of a shard, and shards whose words are looked up by one task at a time.
SHARD, TOGETHER = 20_000, 16
#: Distinct words that a task sums up before it passes them on.
HELD = 300_000
#: Cells of the table of letters that is looked up at a time.
CELLS = 100_000
LAST = "\U0010ffff"


def counted(docs: DataFrame, key: str, text: str, least_length: int, drop_every: int) -> DataFrame:
    """(word, n) of the runs of letters, A-Z lower-cased; one row per word.

    A run loses a letter where ``drop_every`` divides the checksum of key and run, at
    the place that the checksum says.
    """
    # A run that is too short stays so, and a longer one is taken from its beginning.
    runs = re.compile(f"{LETTERS}{{{least_length},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for k, value in zip(batch.column("key"), batch.column("text").cast(pa.large_binary())):
                own = Counter(runs.findall((value.as_py() or b"").lower().decode()))
                seed = zlib.crc32(f"{k.as_py() or ''}:".encode())
                for word, n in own.items():
                    h = zlib.crc32(word.encode(), seed)
                    if h % drop_every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least_length:
                            continue
                    held[word] += n
                if len(held) > HELD:
                    yield rows()
        yield rows()

    rows = docs.select(docs[key].cast("string").alias("key"), docs[text].alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _bounds(words: DataFrame, shards: int, letters) -> list[tuple[int, str]]:
    """The first (length, letters) of each shard, in order."""
    rows = words.select(F.length("word").alias("size"), letters.alias("letters"))
    cut = rows.repartitionByRange(shards, "size", "letters").groupBy(F.spark_partition_id())
    firsts = cut.agg(F.min(F.struct("size", "letters")).alias("first")).select("first.*").collect()
    return sorted((r["size"], r["letters"]) for r in firsts)


def _shard(bounds: list[tuple[int, str]], size: int, letters: str) -> int:
    return max(bisect_right(bounds, (size, letters)) - 1, 0)


def half(word: str) -> int:
    """Letters of the first half."""
    return len(word) // 2


def _placed(words: DataFrame, bounds: list[list[tuple[int, str]]]) -> DataFrame:
    """(side, shard, together, indexed, word, n): where each word is indexed, and where looked up."""
    shared = words.sparkSession.sparkContext.broadcast(bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                for side, cuts in enumerate(shared.value):
                    read = word[::-1] if side else word
                    own = _shard(cuts, len(read), read)
                    out.append((side, own, None, True, word, n))
                    start = read[: len(word) - half(word) if side else half(word)]
                    among: set[int] = set()
                    for size in (len(word) - 1, len(word), len(word) + 1):
                        if size >= len(start):
                            among.update(range(_shard(cuts, size, start), _shard(cuts, size, start + LAST) + 1))
                    out += [(side, shard, own // TOGETHER, False, word, n) for shard in among]
            columns = list(zip(*out)) if out else [[]] * 6
            types = [pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["side", "shard", "together", "indexed", "word", "n"])

    return words.mapInArrow(run, "side int, shard int, together int, indexed boolean, word string, n long")


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per word and shard: its near words, how many, and the one of the largest n.

    The rows come sorted: of each shard first the words to index, then those to look up.
    """
    group, indexed, index, counts = None, {}, None, None
    waiting: list[str] = []

    def answers() -> pa.RecordBatch:
        side = group[0]
        read = [w[::-1] if side else w for w in waiting]
        k = np.array([len(w) - half(w) if side else half(w) for w in waiting], np.int64)
        q, v = index.near(read, k) if waiting and index else (np.empty(0, np.int64), np.empty(0, np.int64))
        best: dict[str, list] = {}
        for i, j in zip(q.tolist(), v.tolist()):
            word, near = waiting[i], index.words[j][::-1] if side else index.words[j]
            # Words that agree in the first half as well are found on the other side.
            if side and near.startswith(word[: half(word)]):
                continue
            mine = (-counts[j], near)
            old = best.get(word)
            best[word] = [old[0] + 1, min(old[1], mine)] if old else [1, mine]
        waiting.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(list(best), pa.string()), pa.array([b[0] for b in best.values()], pa.int64()),
             pa.array([b[1][0] for b in best.values()], pa.int64()), pa.array([b[1][1] for b in best.values()], pa.string())],
            ["word", "n_near", "minus_n", "near"],
        )

    cells = 0
    for batch in batches:
        for side, shard, together, is_index, word, n in zip(*[batch.column(c).to_pylist() for c in ("side", "shard", "together", "indexed", "word", "n")]):
            if (side, shard, together) != group:
                if waiting:
                    yield answers()
                group, indexed, index, cells = (side, shard, together), {}, None, 0
            if is_index:
                indexed[word[::-1] if side else word] = n
                continue
            if index is None and indexed:
                index = Index(list(indexed))
                counts = [indexed[w] for w in index.words]
                indexed = {}
            waiting.append(word)
            cells = max(cells, len(word) + 1)
            if cells * len(waiting) > CELLS:
                yield answers()
                cells = 0
    if waiting:
        yield answers()


def nearest(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """(word, n, n_near, near, near_n) of stored (word, n): how many words are one letter
    away, and the one of the largest n, ties by code points."""
    n = words.count()
    bounds = [_bounds(words, max(-(-n // shard), 1), letters) for letters in (F.col("word"), F.reverse("word"))]
    placed = written(_placed(words, bounds), "spelling-placed")
    keys = ["side", "shard"]
    wanted = placed.filter("NOT indexed").select(*keys, "together").distinct()
    index = placed.filter("indexed").drop("together").join(wanted, keys)
    both = index.select(placed.columns).unionByName(placed.filter("NOT indexed"))
    dealt = both.repartition(*keys, "together").sortWithinPartitions(*keys, "together", F.col("indexed").desc())
    found = dealt.mapInArrow(_looked_up, "word string, n_near long, minus_n long, near string")
    own = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("struct<minus_n:long,near:string>").alias("best"))
    hits = found.select("word", F.lit(None).cast("long").alias("n"), "n_near", F.struct("minus_n", "near").alias("best"))
    every = own.unionByName(hits).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    return every.select("word", "n", "n_near", F.col("best.near").alias("near"), (-F.col("best.minus_n")).alias("near_n"))


def roots(links: DataFrame, longest: int) -> DataFrame:
    """(word, root) for the links (word, form), which have no cycles and at most ``longest`` in a row.

    Each round joins the links to themselves, which doubles how far they reach.
    """
    now, reach = links.select("word", F.col("form").alias("root")), 1
    while reach < longest:
        step = now.select(F.col("word").alias("_at"), F.col("root").alias("_on"))
        now = now.join(step, now["root"] == step["_at"], "left").select("word", F.coalesce("_on", "root").alias("root"))
        now, reach = written(now, "spelling-roots"), 2 * reach
    return now


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = 5, least_count: int = 3, drop_every: int = 97, times: int = 2, shard: int = SHARD) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary.

    A word's form is its near word of the largest count, if that is at least ``times``
    (two or more) its own; the root is where following forms ends.
    """
    words = counted(docs, key, text, least_length, drop_every)
    words = written(words.filter(F.col("n") >= least_count), "spelling-words")
    # The nearest word has its form if it is frequent enough.
    judged = nearest(words, shard)
    fits = F.col("near_n") >= times * F.col("n")
    judged = judged.select("word", F.when(fits, F.col("near")).alias("form"), "n", "n_near", F.when(fits, F.col("near_n")).alias("form_n"))
    judged = written(judged, "spelling-forms")
    # Each form has at least twice the count of the word before.
    most = judged.agg(F.max("form_n")).first()[0] or 1
    ends = roots(judged.filter("form IS NOT NULL").select("word", "form"), int(most).bit_length())
    out = judged.join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
