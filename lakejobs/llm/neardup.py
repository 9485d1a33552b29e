"""Near-duplicate documents: fast similarity sketches, banding, exact verification.

1. Each text gives a set of word shingles, the set's sketch and its band keys.
   Texts with the same set form one class, named by its smallest id.
2. Classes that share a band key are candidates. In each bucket the class with
   the most company is the centre; each class is compared with one centre, the
   one it shares most buckets with. These links give first components.
3. Buckets that still hold several components are settled exactly: their classes
   are joined on the rarest shingles that two similar sets must share, and pairs
   of different components are compared. No bucket is expanded into all its pairs.

All links are confirmed on full sets, as 100 * intersection >= percent * union.
Bands are chosen so that a pair at the threshold shares none with probability
``MISS``; sets above it are safer still.

Defined cases: a null or empty text, or one of spaces, has an empty set and is
linked with nothing. A null id is linked with nothing and kept. Rows with the same
id count as one document: they are kept or dropped together, by all their texts.
Empty tables give empty results. Other columns are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakejobs.llm.common import marked, written
from lakejobs.llm.components import components
from lakejobs.llm.sets import as_sets, sketched

WIDTH = 5
PERCENT = 80
MISS = 1e-9
#: Bands at most; the rows of a band follow from it and the threshold.
MAX_BANDS = 56


def banding(percent: int) -> tuple[int, int]:
    """(bands, rows): the longest bands that miss a pair at the threshold with ``MISS``."""
    s, best = percent / 100, None
    for rows in range(1, 40):
        hit = s**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(MISS) / math.log1p(-hit))
        if best is None or bands <= MAX_BANDS:
            best = (bands, rows)
        if bands > MAX_BANDS:
            break
    return best


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    one = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa"))
    two = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb"))
    both = pairs.join(one, "a").join(two, "b").withColumn("i", F.size(F.array_intersect("sa", "sb")))
    return both.filter(100 * F.col("i") >= percent * (F.col("na") + F.col("nb") - F.col("i"))).select("a", "b")


def _rare_pairs(sets: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that share one of their rarest shingles.

    Sets of similarity s have a shingle in common among the first n - s n + 1 of
    each, in any order of all shingles; rare ones come first here. Pairs within
    the largest component of a shingle are not enumerated.
    """
    n, first = F.col("n"), F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    tokens = sets.join(label, "node").select("node", "label", "n", "k", F.explode("s").alias("token"))
    # Stored, so that the join below may split a shingle that very many sets have.
    often = written(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "shingle-counts")
    tokens = tokens.join(often, "token")
    by_rarity = Window.partitionBy("node", "k").orderBy("df", "token")
    # Shingles that no other set has come before the ones that are left here.
    at = n - F.count(F.lit(1)).over(Window.partitionBy("node", "k")) + F.row_number().over(by_rarity) - 1
    prefix = written(tokens.withColumn("at", at).filter(F.col("at") < first).select("token", "node", "label", "n", "at"), "prefixes")
    main = prefix.groupBy("token", "label").agg(F.count(F.lit(1)).alias("c"))
    main = main.groupBy("token").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count(F.lit(1)).alias("labels")).filter("labels > 1")
    prefix = prefix.join(written(main.drop("labels"), "shared-prefixes"), "token")
    one = prefix.filter("label <> main").select("token", *[F.col(c).alias(f"{c}1") for c in ("node", "label", "n", "at")])
    two = prefix.select("token", "main", *[F.col(c).alias(f"{c}2") for c in ("node", "label", "n", "at")])
    fits = (100 * F.least("n1", "n2") >= percent * F.greatest("n1", "n2")) & (
        (100 + percent) * F.least(F.col("n1") - F.col("at1"), F.col("n2") - F.col("at2")) >= percent * (F.col("n1") + F.col("n2"))
    )
    other = (F.col("label1") != F.col("label2")) & ((F.col("label2") == F.col("main")) | (F.col("node1") < F.col("node2")))
    found = one.join(two, "token").filter(other & fits)
    return found.select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b")).distinct()


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id), one row per row of ``docs``."""
    bands, rows = banding(percent)
    texts = docs.select(docs[key].cast("long").alias("id"), docs[text].alias("text"))
    schema = "id long, n long, k1 long, k2 long, keys array<long>"
    sketch = written(texts.mapInArrow(sketched(width, bands, rows), schema), "sketches")
    named = sketch.filter("n > 0 AND id IS NOT NULL")
    classes = named.groupBy("k1", "k2").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies"))
    copied = written(classes.filter("copies > 1").drop("copies"), "classes")
    extra = copied.join(named.select("k1", "k2", "id"), ["k1", "k2"]).filter("id > node").select("id", "k1", "k2").distinct()
    firsts = named.join(extra, ["id", "k1", "k2"], "left_anti")

    band = firsts.select(F.col("id").alias("node"), F.explode("keys").alias("key"))
    shared = band.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    member = written(band.join(shared, "key"), "members")
    company = member.groupBy("node").agg(F.sum("c").alias("score"))
    member = written(member.join(company, "node").select("key", "node", "score"), "scored")
    centre = member.groupBy("key").agg(F.max(F.struct("score", "node")).alias("top")).select("key", F.col("top.node").alias("centre"))
    pair = member.join(centre, "key").filter("node <> centre").groupBy("node", "centre").agg(F.count(F.lit(1)).alias("c"))
    pair = pair.groupBy("node").agg(F.max_by("centre", F.struct("c", "centre")).alias("centre"))
    nodes = member.select("node").distinct()
    likely = marked(texts, "id", nodes).filter("likely").select("id", "text")
    likely = likely.join(nodes, F.col("id") == F.col("node"), "left_semi")
    sets = written(likely.mapInArrow(as_sets(width), "node long, n long, k long, s array<long>"), "sets")
    links = written(_confirmed(pair.select(F.col("node").alias("a"), F.col("centre").alias("b")), sets, percent), "links")

    label = written(components(links), "first-components")
    member = member.join(label, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    open_keys = member.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key")
    unsettled = written(member.join(open_keys, "key", "left_semi").select("node", "label").distinct(), "unsettled")
    more = _confirmed(_rare_pairs(sets, unsettled, percent), sets, percent)
    # An id that stands for a set of its own and comes again with a copy of another.
    again = extra.join(firsts.select("id").distinct(), "id").join(copied, ["k1", "k2"]).select(F.col("id").alias("a"), F.col("node").alias("b"))
    label = components(links.unionByName(written(more.unionByName(again), "more-links")))

    out = sketch.join(copied, ["k1", "k2"], "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("node", "id").alias("node"))
    out = out.join(label, "node", "left")
    return out.select("id", "n_shingles", F.coalesce("label", "node").alias("component_id"))


def keep(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One document of each group, with the columns it came with."""
    found = groups(docs, key, text, width, percent)
    gone = written(found.filter("id <> component_id").select("id").distinct(), "gone")
    rows = marked(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[key].cast("long").alias("key")), "key", gone)
    sure = rows.filter("NOT likely")
    rest = rows.filter("likely").join(gone, F.col("key") == F.col("id"), "left_anti")
    return sure.unionByName(rest).select("row.*")
