"""Line dedup by a segment-partition edit join.

Lines are split into ``EDITS`` + 1 segments. A line is compared with those that
have one of its length-aware signatures, and pairs within ``EDITS`` edits are
linked. Of the lines that are linked with each other, directly or over others,
the first by (id, line number) stays and the rest is removed.

Only signatures that two different lines have are carried on; a bitmap of fixed
size drops most others before they are shuffled. In each bucket all lines are
compared with one of them; only where several components are left are lines of
different components paired, after the parities of their letter pairs, which no
two lines within the edits can differ in by much, rule out nearly all strangers.
A bucket of more than ``PAIRED`` members is not paired but split by where its lines leave
one of them, forwards and backwards; pairs that do not leave it together are equal after
a change at these places, which gives links in proportion to the members. Components are
found after the first level and at the end.

Defined cases: lines shorter than ``MIN_CHARS`` characters (headings, blank lines)
are never removed. A null or empty text stays as it is. The lines of a null id
are neither compared nor removed. Rows with the same id are one document; if
their texts differ, a line number that goes from one goes from all. Empty tables
give empty results. Lines are named by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakejobs.llm import lines
from lakejobs.llm.common import marked, written
from lakejobs.llm.components import components

EDITS = 2
#: Up to so many members of a bucket are paired; larger buckets are split.
PAIRED = 256
MIN_CHARS = 20


def _near(a: str, b: str, edits: int) -> Column:
    """Whether lines with ``chars`` and ``parity`` can be within the edits at all."""
    flips = [F.bit_count(F.col(f"parity{a}")[k].bitwiseXOR(F.col(f"parity{b}")[k])) for k in range(lines.PARITY_WORDS)]
    return (F.abs(F.col(f"chars{a}") - F.col(f"chars{b}")) <= edits) & (sum(flips[1:], flips[0]) <= 4 * edits)


def _numbered(df: DataFrame, number: str, same: list[str]) -> DataFrame:
    return df.select(*same, *[F.col(c).alias(f"{c}{number}") for c in df.columns if c not in same])


def _close(pairs: DataFrame, info: DataFrame, edits: int) -> DataFrame:
    """The pairs (a, b) of line names whose texts are within the edits."""
    known = pairs.join(_numbered(info, "1", []), F.col("a") == F.col("name1"))
    both = known.join(_numbered(info, "2", []), (F.col("b") == F.col("name2")) & _near("1", "2", edits))
    return both.select("a", "b", "line1", "line2").mapInArrow(lines.close_pairs(edits), "a long, b long")


def classes(texts: DataFrame, edits: int = EDITS, least: int = MIN_CHARS) -> DataFrame:
    """(name, label) of the lines of (id, text) that are linked with others."""
    signed = written(texts.mapInArrow(lines.signature_rows(least, edits), "sig long, name long, own boolean"), "signatures")
    shared = signed.groupBy("sig").agg(F.min("name").alias("low"), F.max("name").alias("high"), F.min(F.when(F.col("own"), F.col("name"))).alias("centre"))
    shared = written(shared.filter("low < high AND centre IS NOT NULL").select("sig", "centre"), "shared-signatures")
    member = marked(signed, "sig", shared).filter("likely").drop("likely")
    member = written(member.join(shared, "sig").distinct(), "members")

    names = written(member.select("name").distinct(), "names")
    found = texts.mapInArrow(lines.line_rows(least), "name long, line string")
    found = marked(found, "name", names).filter("likely").drop("likely").join(names, "name", "left_semi")
    info = found.groupBy("name").agg(F.first("line").alias("line"))
    info = written(info.mapInArrow(lines.with_parity, "name long, line string, chars int, parity array<long>"), "line-info")

    star = member.filter("name <> centre").select(F.col("name").alias("a"), F.col("centre").alias("b")).distinct()
    links = written(_close(star, info, edits), "line-links")
    settled = written(components(links).withColumnRenamed("node", "name"), "line-components")
    member = member.join(settled, "name", "left").withColumn("label", F.coalesce("label", "name"))
    open_sigs = member.groupBy("sig").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n"))
    # A bucket of two was settled by its one pair.
    open_sigs = open_sigs.filter("low < high AND n > 2").select("sig", "n")
    rest = written(member.join(open_sigs, "sig").select("sig", "name", "own", "label", "n"), "open-members")
    more = _open_links(rest, info, edits) if edits <= 2 else _open_links_by_segments(rest, info, edits)
    return settled if more.isEmpty() else components(links.unionByName(more)).withColumnRenamed("node", "name")


def _pairs(few: DataFrame, info: DataFrame, edits: int) -> DataFrame:
    """The pairs (a, b) of different components in a bucket that may be within the edits."""
    few = few.select("sig", "name", "own", "label").join(info.select("name", "chars", "parity"), "name")
    # A signature finds a pair by the shorter line's own segment.
    one, two = _numbered(few.filter("own"), "1", ["sig"]), _numbered(few, "2", ["sig"])
    shorter = (F.col("chars1") < F.col("chars2")) | ((F.col("chars1") == F.col("chars2")) & (F.col("name1") < F.col("name2")))
    other = (F.col("name1") != F.col("name2")) & (F.col("label1") != F.col("label2"))
    pairs = one.join(two, "sig").filter(shorter & other & _near("1", "2", edits))
    return pairs.select(F.col("name1").alias("a"), F.col("name2").alias("b")).distinct()


def _open_links(rest: DataFrame, info: DataFrame, edits: int) -> DataFrame:
    """Links (a, b) between components, by the members of the buckets that hold several.

    Large buckets are split by where their lines leave one of them, the middle. Two lines that
    leave it at different places, or at one place with different characters, differ first at
    the nearer place; the same holds from the end. That is where their edits are, so both are
    changed there, towards the middle, and are equal then. Other pairs leave the middle
    together, forwards or backwards, and get a smaller bucket each.
    """
    few, changed = rest.filter(F.col("n") <= PAIRED).drop("n"), None
    many = rest.filter(F.col("n") > PAIRED)
    # The line with most company is like most others, so that few leave it together. Any middle gives all links.
    more = not many.isEmpty()
    if more:
        company = written(many.groupBy("name").agg(F.sum("n").alias("company")), "company")
        many = many.join(company, "name")
    while more:
        middle = written(many.groupBy("sig").agg(F.max_by("name", F.struct("company", "name")).alias("middle")), "middles")
        many = written(many.join(middle, "sig").select("sig", "name", "own", "label", "middle"), "large-buckets")
        beside = many.select("name", "label", "middle").distinct().join(info.select("name", "line"), "name")
        beside = beside.join(info.select(F.col("name").alias("middle"), F.col("line").alias("other")), "middle")
        beside = written(beside.select("name", "label", "middle", "line", "other"), "beside-middles")

        found = written(beside.mapInArrow(lines.changed_rows(edits), "sig long, name long, label long, cost int, open int"), "changed-lines")
        changed = _with(changed, found)
        leaves = beside.mapInArrow(lines.leaving_rows, "name long, middle long, sides array<long>")
        smaller = many.join(leaves, ["name", "middle"]).select("sig", "name", "own", "label", F.explode("sides").alias("side"))
        smaller = written(smaller.select(F.xxhash64("sig", "side").alias("sig"), "name", "own", "label"), "smaller-buckets")
        size = smaller.groupBy("sig").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max("own").alias("own"), F.count(F.lit(1)).alias("n"))
        size = written(size.filter("low < high AND own").select("sig", "n"), "smaller-sizes")
        smaller = written(smaller.join(size, "sig"), "smaller-members")
        few = few.unionByName(smaller.filter(F.col("n") <= PAIRED).drop("n"))
        # Names are hashes, so the middle is any line from here on, and a line is split off a few times only.
        many = smaller.filter(F.col("n") > PAIRED).withColumn("company", F.lit(0))
        more = not many.isEmpty()
    pairs = _pairs(few, info, edits)
    if changed is not None:
        pairs = pairs.unionByName(_equal(changed, edits)).distinct()
    return written(_close(pairs, info, edits), "more-line-links")


def _equal(changed: DataFrame, edits: int) -> DataFrame:
    """Pairs (a, b) of the lines that a changed line makes equal, with the one of them that took the fewest edits."""
    head = changed.groupBy("sig").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min(F.struct("cost", "name")).alias("head"))
    # Stored, so that the join below may split a line that very many come to.
    head = written(head.filter("low < high").select("sig", "head"), "changed-heads")
    near = (F.col("name") != F.col("head.name")) & (F.col("cost") + F.col("head.cost") + F.col("open") <= edits)
    return changed.join(head, "sig").filter(near).select(F.col("name").alias("a"), F.col("head.name").alias("b"))


def _open_links_by_segments(rest: DataFrame, info: DataFrame, edits: int) -> DataFrame:
    """The same for more than two edits: large buckets are split by the segments of what is
    left of the lines without the common one, again and again as long as they are large.

    Between the levels a bucket only notes who is linked with its centre.
    """
    links, first = None, True
    while True:
        few = rest.filter(F.col("n") <= PAIRED).select("sig", "name", "own", "label").distinct()
        links = _with(links, written(_close(_pairs(few, info, edits), info, edits), "more-line-links"))
        many = rest.filter(F.col("n") > PAIRED)
        if many.isEmpty():
            return links
        member, first = _narrowed(many, info, edits, first), False
        star = member.filter("name <> centre").select(F.col("name").alias("a"), F.col("centre").alias("b")).distinct()
        near = written(_close(star, info, edits), "line-links")
        links = _with(links, near)
        linked = near.select(F.col("a").alias("name"), F.col("b").alias("centre"), F.lit(True).alias("linked"))
        member = member.join(linked, ["name", "centre"], "left").withColumn("label", F.when(F.col("linked"), F.col("centre_label")).otherwise(F.col("label")))
        open_sigs = member.groupBy("sig").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n"))
        rest = written(member.join(open_sigs.filter("low < high AND n > 2").select("sig", "n"), "sig"), "open-members")


def _with(links: DataFrame | None, more: DataFrame) -> DataFrame:
    return more if links is None else links.unionByName(more)


def _narrowed(many: DataFrame, info: DataFrame, edits: int, first: bool) -> DataFrame:
    """The members of large buckets in buckets of a second segment, taken of what is left of the lines.

    Lines that share a segment are within the edits by it only if what is left of them is.
    Buckets within one component, or with one line, are left out.
    """
    cuts = F.lit(None).cast("array<int>") if first else F.col("cuts")
    rows = many.select("sig", "name", "own", "label", cuts.alias("cuts"), F.lit(first).alias("whole")).join(info.select("name", "line"), "name")
    deeper = rows.mapInArrow(lines.narrower(edits), "sig long, name long, own boolean, label long, cuts array<int>")
    deeper = written(deeper, "narrower-members")
    centre = F.when(F.col("own"), F.col("name"))
    shared = deeper.groupBy("sig").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min(centre).alias("centre"), F.min_by("label", centre).alias("centre_label"))
    shared = written(shared.filter("low < high AND centre IS NOT NULL").select("sig", "centre", "centre_label"), "narrower-signatures")
    # A line of the centre's component needs no comparison with it.
    settled = F.when(F.col("label") == F.col("centre_label"), F.col("name")).otherwise(F.col("centre"))
    return written(deeper.join(shared, "sig").select("sig", "name", "own", "label", "cuts", settled.alias("centre"), "centre_label"), "members")


def removals(docs: DataFrame, key: str = "doc_id", text: str = "text", edits: int = EDITS, least: int = MIN_CHARS) -> DataFrame:
    """(doc, no, name): every line, by its number in the text, that is not the first of its class."""
    texts = docs.select(docs[key].cast("long").alias("id"), docs[text].alias("text"))
    label = written(classes(texts, edits, least), "line-classes")
    places = written(texts.mapInArrow(lines.occurrences(least), "doc long, no long, name long"), "line-places")
    placed = places.join(label, "name", "left").select("doc", "no", "name", F.coalesce("label", "name").alias("label"))
    first = placed.groupBy("label").agg(F.min(F.struct("doc", "no")).alias("first"), F.max(F.struct("doc", "no")).alias("last"))
    # Stored, so that the join below may split a label with very many places.
    first = written(first.filter("first <> last").select("label", "first"), "first-places")
    return placed.join(first, "label").filter(F.struct("doc", "no") != F.col("first")).select("doc", "no", "name")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", edits: int = EDITS, least: int = MIN_CHARS) -> DataFrame:
    """The documents without the removed lines; documents that lose all of them go.

    The other columns stay as they are; a column ``n_chars`` follows the new text.
    """
    gone = removals(docs, key, text, edits, least)
    gone = written(gone.groupBy("doc").agg(F.collect_set("no").alias("gone")).select(F.col("doc").alias("id"), "gone"), "line-removals")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[key].cast("long").alias("key"))
    rows = marked(rows, "key", gone)
    sure, likely = rows.filter("NOT likely").select("row"), rows.filter("likely").join(gone, F.col("key") == F.col("id"), "left")
    numbered = F.transform(F.split(F.col("row")[text], "\n", -1), lambda line, no: F.struct(no.cast("long").alias("no"), line.alias("line")))
    left = F.filter(numbered, lambda x: ~F.array_contains("gone", x["no"]))
    likely = likely.withColumn("left", F.when(F.col("gone").isNotNull(), F.transform(left, lambda x: x["line"])))
    likely = likely.filter(F.col("left").isNull() | (F.length(F.trim(F.array_join("left", ""))) > 0))
    row = F.when(F.col("left").isNull(), F.col("row")).otherwise(_with_text(docs, text))
    return sure.unionByName(likely.select(row.alias("row"))).select("row.*")


def _with_text(docs: DataFrame, text: str):
    row, new = F.col("row"), F.array_join("left", "\n")
    out = []
    for name, kind in docs.dtypes:
        value = new if name == text else F.length(new).cast(kind) if name == "n_chars" else row[name]
        out.append(value.alias(name))
    return F.struct(*out)
