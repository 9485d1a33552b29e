"""The prefix trie of conversations, encoded as balanced parentheses per shard.

Conversations become paths of 16-byte names of their turns. Equal paths are counted
before they are sorted; the sorted paths are cut into shards, each of which is encoded
as balanced parentheses (:mod:`lakejobs.llm.parens`): closing parentheses delimit
subtrees, the rank of leaf pairs counts leaves, cumulative arrays give members and
savings. Only nodes on the first and last path of a shard, its spines, can also be in
other shards: they are merged by their names.

Long conversations are cut into segments of ``SEGMENT`` turns. A segment hangs below
an anchor, the name of all that comes before; segments below one anchor are a trie of
their own, and what lies below a segment's end is added to it as a weight. So no
conversation is held in one row, and no group of equal ones is gathered: places in a
conversation come from ranges of sorted rows, and the ids that end in a node are
hashed as they stream past, in pieces where a node's ids lie in several tasks.

Defined cases: null roles and texts are empty ones. Rows without a conversation's id
belong to none and are left out. Turns are ordered with nulls first, ties by the MD5 of
role and text; repeated rows are turns of their own. The block of a negative id is
rounded down. An empty table has no nodes. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakejobs.llm.common import words, written
from lakejobs.llm.parens import HIGH, Parens

#: Turns of a segment, and cells of the table of paths that make a shard.
SEGMENT, CELLS = 64, 2**19
#: Characters of ids that are kept before they are passed on in pieces.
PIECE = 2**20
NAME = 16


def turns(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, pos, name, words): the turns of each conversation, numbered from 1.

    The rows are sorted in ranges, so that a long conversation lies in several tasks.
    Each range has at most one conversation that began in an earlier one, so the
    table of places that are passed has at most a row per range.
    """
    who, what = F.coalesce(rows[role], F.lit("")), F.coalesce(rows[text], F.lit(""))
    named = rows.select(
        rows[conv].cast("long").alias("conv"),
        rows[turn].cast("long").alias("turn"),
        F.unhex(F.md5(F.concat(F.length(who).cast("string"), F.lit(":"), who, what))).alias("name"),
        F.size(words(what)).alias("words"),
    )
    order = [F.col("turn").asc_nulls_first(), "name"]
    ranged = named.filter("conv IS NOT NULL").repartitionByRange("conv", *order).withColumn("part", F.spark_partition_id())
    ranged = written(ranged, "trie-turns")
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    passed = ranged.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("passed", before)
    passed = passed.filter("passed > 0").select("conv", "part", "passed")
    place = F.row_number().over(Window.partitionBy("conv", "part").orderBy(*order))
    numbered = ranged.withColumn("place", place).join(F.broadcast(passed), ["conv", "part"], "left")
    return numbered.select("conv", (F.col("place") + F.coalesce("passed", F.lit(0))).alias("pos"), "name", "words")


def rebuilt(own: DataFrame, block: int, shared: int) -> DataFrame:
    """(conv, pos, name, words, total) of the rebuilt conversations, and one row at place 0 for each.

    The first h turns come from the first conversation of the block, h being the
    checksum of the id modulo ``shared``; the conversation's own turns follow from
    the h-th on.
    """
    h = F.pmod(F.crc32(F.col("conv").cast("string")), F.lit(shared)).cast("int")
    first = F.col("conv") - F.pmod("conv", F.lit(block))
    heads = own.filter((F.col("conv") == first) & (F.col("pos") < shared)).groupBy("conv")
    heads = heads.agg(F.array_sort(F.collect_list(F.struct("pos", "name", "words"))).alias("head"))
    heads = heads.withColumnRenamed("conv", "first")
    sizes = own.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).withColumn("first", first).withColumn("h", h)
    lead = F.when(F.col("head").isNull(), F.array().cast("array<struct<pos:bigint,name:binary,words:int>>")).otherwise(F.slice("head", 1, F.col("h")))
    sizes = sizes.join(heads, "first", "left").select("conv", "n", "h", lead.alias("lead"))
    sizes = sizes.withColumn("skipped", F.size("lead")).withColumn("total", F.col("skipped") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    sizes = written(sizes, "trie-sizes")
    start = F.array(F.struct(F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("name"), F.lit(0).alias("words")))
    led = sizes.select("conv", "total", F.explode(F.concat(start, "lead")).alias("t")).select("conv", "t.*", "total")
    kept = own.filter(F.col("pos") > h).join(sizes.select("conv", "h", "skipped", "total"), "conv")
    kept = kept.select("conv", (F.col("pos") - F.col("h") + F.col("skipped")).alias("pos"), "name", "words", "total")
    return led.unionByName(kept)


def segments(rows: DataFrame, segment: int) -> DataFrame:
    """(conv, level, anchor, path, words, goes_on, next) for every segment of every conversation."""
    level = F.floor(F.greatest(F.col("pos") - 1, F.lit(0)) / segment).cast("int")
    turn = F.when(F.col("pos") > 0, F.struct("pos", "name", "words"))
    # Dealt out by segment, not only by conversation.
    cut = rows.withColumn("level", level).repartition("conv", "level").groupBy("conv", "level")
    cut = cut.agg(F.array_sort(F.collect_list(turn)).alias("turns"), F.max("total").alias("total"))
    path = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["name"])), ""))
    cut = cut.select("conv", "level", path.alias("path"), F.transform("turns", lambda t: t["words"]).alias("words"), "total")
    cut = written(cut, "trie-segments")
    alone = cut.filter(F.col("total") <= segment).select("conv", "level", F.lit(b"").alias("anchor"), "path", "words", F.lit(False).alias("goes_on"), F.lit(None).cast("binary").alias("next"))
    # Sums of two hashes with the segment's number name all that comes before.
    so_far = Window.partitionBy("conv").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    wide = cut.filter(F.col("total") > segment)
    for i in (0, 1):
        own = F.xxhash64("path", "level", F.lit(i)).cast("decimal(20,0)")
        wide = wide.withColumn(f"upto{i}", F.sum(own).over(so_far)).withColumn(f"before{i}", F.col(f"upto{i}") - own)

    def name(number, a, b):
        return F.unhex(F.md5(F.concat_ws(":", number, F.col(a).cast("string"), F.col(b).cast("string"))))

    goes_on = (F.col("level") + 1) * segment < F.col("total")
    anchor = F.when(F.col("level") > 0, name(F.col("level"), "before0", "before1")).otherwise(F.lit(b""))
    following = F.when(goes_on, name(F.col("level") + 1, "upto0", "upto1"))
    return alone.unionByName(wide.select("conv", "level", anchor.alias("anchor"), "path", "words", goes_on.alias("goes_on"), following.alias("next")))


def _pieces(longest: int):
    """Per node the hash of its ids, which come in order; ids of the first and last
    node of a task, and very many ids, go on in pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, start, ids, size, in_pieces = None, None, [], 0, True
        out: list[tuple] = []

        def piece() -> None:
            out.append((name, start, ",".join(ids), None))

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [[]] * 4
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, PIECE_TYPES)], ["node", "start", "ids", "sha"])

        for batch in batches:
            for node, conv in zip(batch.column("node").to_pylist(), batch.column("conv").to_pylist()):
                if node != name:
                    if name is not None:
                        if in_pieces:
                            piece()
                        else:
                            out.append((name, None, None, hashlib.sha256(",".join(ids).encode()).hexdigest()))
                    # The first node of the task may have begun in another one.
                    in_pieces = name is None
                    name, start, ids, size = node, conv, [], 0
                elif size > longest:
                    piece()
                    yield flushed()
                    in_pieces, start, ids, size = True, conv, [], 0
                ids.append(str(conv))
                size += len(ids[-1]) + 1
            yield flushed()
        if name is not None:
            piece()
            yield flushed()

    return run


PIECE_TYPES = [pa.binary(), pa.int64(), pa.string(), pa.string()]


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each node's pieces, which come in order."""
    name, sha = None, None
    for batch in batches:
        done = []
        for node, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
            if node != name:
                if name is not None:
                    done.append((name, sha.hexdigest()))
                name, sha = node, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], ["node", "sha"])
    if name is not None:
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([sha.hexdigest()], pa.string())], ["node", "sha"])


def end_hashes(ends: DataFrame, piece: int = PIECE) -> DataFrame:
    """(node, sha) of (node, conv): the SHA-256 of each node's ids, in order and joined by commas."""
    ranged = ends.repartitionByRange("node", "conv").sortWithinPartitions("node", "conv")
    parts = written(ranged.mapInArrow(_pieces(piece), "node binary, start long, ids string, sha string"), "trie-ends")
    pieces = parts.filter("sha IS NULL").select("node", "start", "ids").repartition("node").sortWithinPartitions("node", "start")
    return parts.filter("sha IS NOT NULL").select("node", "sha").unionByName(pieces.mapInArrow(_hashed, "node binary, sha string"))


FIELDS = {
    "spine": "boolean", "own": "boolean", "shard": "string", "side": "int", "name": "binary", "parent": "binary", "level": "int",
    "local_depth": "int", "depth": "long", "conv": "long", "parent_conv": "long", "n_convs": "long", "words": "long",
    "n_children": "long", "n_leaves": "long", "saved": "long", "goes_on": "boolean", "sha": "string",
}
ARROW = {"boolean": pa.bool_(), "string": pa.string(), "int": pa.int32(), "binary": pa.binary(), "long": pa.int64()}
BELOW = ["below_children", "below_leaves", "below_saved"]


def _encoded(rows: list[dict], shard: str, segment: int) -> pa.RecordBatch:
    """The nodes of one shard: whole ones, and the shard's part of those on its spines."""
    level, anchor = rows[0]["level"], rows[0]["anchor"]
    paths = [r["path"] for r in rows]
    lengths = np.array([len(p) // NAME for p in paths])
    widest = max(int(lengths.max()), 1)
    names = np.frombuffer(b"".join(p.ljust(widest * NAME, b"\0") for p in paths), np.uint64).reshape(len(rows), widest, 2)
    inside = np.arange(widest) < lengths[:, None]
    same = (names[1:] == names[:-1]).all(axis=2) & inside[1:] & inside[:-1]
    shared = np.r_[0, np.cumprod(same, axis=1).sum(axis=1)].astype(np.int64)
    trie = Parens(lengths, shared)
    new = inside & (np.arange(widest) >= shared[:, None])
    flat = np.zeros(new.shape, np.int64)
    flat[inside] = np.concatenate([np.asarray(r["words"], np.int64) for r in rows])
    n = len(trie.open)
    last_words = np.r_[0, flat[new]]
    parents = trie.parents()

    def at_ends(column: str, fill: int = 0) -> np.ndarray:
        out = np.full(n, fill, np.int64)
        out[trie.ends] = [fill if r[column] is None else r[column] for r in rows]
        return out

    members = trie.sums(at_ends("n"))
    least = trie.least(at_ends("conv", HIGH), parents)
    if rows[0]["top"] is not None:
        least[0] = rows[0]["top"]
    goes_on = at_ends("goes_on") > 0
    below = {c: at_ends(c) for c in BELOW}
    # The first path, and the last one up to the root.
    first, last = list(range(int(lengths[0]) + 1)), []
    node = int(trie.ends[-1])
    while node >= 0:
        last.append(node)
        node = int(parents[node])
    last.reverse()
    whole = np.ones(n, bool)
    whole[first + last] = False
    children = np.bincount(parents[1:][whole[1:]], minlength=n) + below["below_children"]
    # Leaf pairs are no leaves where conversations go on, and not settled on the spines.
    pairs = trie.leaf_rank[trie.open] - np.where(trie.open > 0, trie.leaf_rank[trie.open - 1], 0)
    leaves = trie.leaves() + trie.sums(below["below_leaves"] - pairs * (goes_on | ~whole))
    saved = trie.sums(np.where(whole, (members - 1) * last_words, 0) + below["below_saved"])
    sha = {int(e): r["sha"] for e, r in zip(trie.ends, rows)}

    def name(path: bytes) -> bytes:
        return hashlib.md5(b"%d:" % level + anchor + path).digest()

    spine_names = {}
    for side, nodes in enumerate((first, last)):
        path = paths[-1] if side else paths[0]
        spine_names |= {node: name(path[: d * NAME]) for d, node in enumerate(nodes)}
    kept = np.flatnonzero(whole)
    listed = kept.tolist()
    places = [(True, side == 0 or node not in first, side, node) for side, nodes in enumerate((first, last)) for node in nodes]
    every = np.array(listed + [p[3] for p in places], np.int64)
    up = parents[every].tolist()
    plain = len(listed)
    columns = {
        "spine": [False] * plain + [True] * len(places),
        "own": [True] * plain + [p[1] for p in places],
        "shard": [None] * plain + [shard] * len(places),
        "side": [None] * plain + [p[2] for p in places],
        "name": [None] * plain + [spine_names[p[3]] for p in places],
        "parent": [spine_names.get(u) for u in up],
        "level": np.full(len(every), level),
        "local_depth": trie.depth[every],
        "depth": trie.depth[every] + level * segment,
        "conv": least[every],
        "parent_conv": [None if u < 0 or u in spine_names else int(least[u]) for u in up],
        "n_convs": members[every],
        "words": last_words[every],
        "n_children": children[every],
        "n_leaves": leaves[every],
        "saved": saved[every],
        "goes_on": goes_on[every],
        "sha": [sha.get(x) for x in every.tolist()],
    }
    return pa.RecordBatch.from_arrays([pa.array(c, ARROW[FIELDS[k]]) for k, c in columns.items()], list(columns))


def _shards(cells: int, segment: int):
    """Encodes sorted rows shard by shard; a shard has one anchor and a bounded number of cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        rows: list[dict] = []
        widest, task, number = 1, uuid.uuid4().hex, 0
        for batch in batches:
            for row in batch.to_pylist():
                wide = max(widest, len(row["path"]) // NAME)
                if rows and (row["anchor"] != rows[0]["anchor"] or wide * (len(rows) + 1) > cells):
                    yield _encoded(rows, f"{task}-{number}", segment)
                    number += 1
                    rows, wide = [], max(1, len(row["path"]) // NAME)
                rows.append(row)
                widest = wide
        if rows:
            yield _encoded(rows, f"{task}-{number}", segment)

    return run


def _encode(rows: DataFrame, cells: int, segment: int, label: str) -> DataFrame:
    ordered = rows.repartitionByRange("level", "anchor", "path").sortWithinPartitions("level", "anchor", "path")
    # Stored, as the names of shards are new in each run of a task.
    return written(ordered.mapInArrow(_shards(cells, segment), ", ".join(f"{k} {v}" for k, v in FIELDS.items())), label)


def _merged(nodes: DataFrame) -> DataFrame:
    """The nodes on spines, merged over the shards that they are in."""
    rows = nodes.filter("spine")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]
    same = [F.max(c).alias(c) for c in ("parent", "level", "local_depth", "depth", "words", "goes_on", "sha")]
    one = rows.filter("own").groupBy("name").agg(F.min("conv").alias("conv"), *sums, *same)
    children = one.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("on_spines"))
    one = one.join(children, "name", "left").withColumn("n_children", F.col("n_children") + F.coalesce("on_spines", F.lit(0)))
    one = written(one.drop("on_spines"), "trie-spines")
    # Each node adds its own leaf and saving once to all above it, along one path that holds it.
    is_leaf = ((F.col("n_children") == 0) & ~F.col("goes_on")).cast("long")
    adds = one.select("name", is_leaf.alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saving"))
    place = F.struct("shard", "side")
    chosen = rows.groupBy("name").agg(F.min(place).alias("chosen"))
    paths = rows.select("shard", "side", "local_depth", "name").join(chosen, "name").join(adds, "name")
    upward = Window.partitionBy("shard", "side").orderBy(F.desc("local_depth")).rowsBetween(Window.unboundedPreceding, 0)
    mine = lambda c: F.sum(F.when(place == F.col("chosen"), F.col(c)).otherwise(0)).over(upward).alias(c)
    total = paths.select("name", mine("leaf"), mine("saving")).groupBy("name").agg(F.sum("leaf").alias("leaf"), F.sum("saving").alias("saving"))
    above = one.select(F.col("name").alias("parent"), F.col("conv").alias("parent_conv"))
    out = one.join(total, "name").join(above, "parent", "left")
    return out.withColumn("n_leaves", F.col("n_leaves") + F.col("leaf")).withColumn("saved", F.col("saved") + F.col("saving"))


def _weighted(paths: DataFrame, segs: DataFrame, cells: int, segment: int) -> DataFrame:
    """The paths with what lies below their ends, for conversations of several segments."""
    deep = paths.filter("level > 0")
    tops = paths.filter("next IS NOT NULL").select(F.col("next").alias("anchor"), F.col("conv").alias("top"))
    nothing = [F.lit(0).cast("long").alias(c) for c in BELOW]
    first = _encode(deep.withColumn("top", F.lit(None).cast("long")).select("*", *nothing), cells, segment, "trie-deep")
    own = _merged(first).filter("local_depth = 0").select("name", "n_children", "n_leaves", "saved")
    named = F.unhex(F.md5(F.concat(F.col("level").cast("string").cast("binary"), F.lit(b":"), F.col("anchor"))))
    along = segs.filter("level > 0").select("conv", "level", "anchor").withColumn("name", named)
    chosen = along.groupBy("name").agg(F.min("conv").alias("chosen"))
    along = along.join(chosen, "name").join(own, "name")
    upward = Window.partitionBy("conv").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, 0)
    mine = lambda c: F.sum(F.when(F.col("conv") == F.col("chosen"), F.col(c)).otherwise(0)).over(upward).alias(c)
    below = along.select("anchor", "n_children", mine("n_leaves"), mine("saved")).groupBy("anchor")
    below = below.agg(F.max("n_children").alias(BELOW[0]), F.sum("n_leaves").alias(BELOW[1]), F.sum("saved").alias(BELOW[2]))
    below = below.withColumnRenamed("anchor", "next")
    return paths.join(tops, "anchor", "left").join(below, "next", "left")


def trie(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = 20, shared: int = 4, segment: int = SEGMENT, cells: int = CELLS) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: (conv, depth, parent_conv,
    n_convs, n_children, n_leaves, saved, sha)."""
    own = written(turns(rows, conv, turn, role, text), "trie-places")
    segs = written(segments(rebuilt(own, block, shared), segment), "trie-anchors")
    node = F.unhex(F.md5(F.concat(F.col("level").cast("string").cast("binary"), F.lit(b":"), F.col("anchor"), F.col("path"))))
    paths = segs.groupBy("level", "anchor", "path").agg(
        F.count(F.lit(1)).alias("n"), F.min("conv").alias("conv"), F.count_if("goes_on").alias("goes_on"), F.max("next").alias("next"), F.any_value("words").alias("words"),
    )
    ended = end_hashes(segs.filter("NOT goes_on").select(node.alias("node"), "conv"))
    paths = paths.withColumn("node", node).join(ended, "node", "left").drop("node")
    paths = written(paths, "trie-paths")
    if paths.filter("level > 0").isEmpty():
        paths = paths.select("*", F.lit(None).cast("long").alias("top"), *[F.lit(0).cast("long").alias(c) for c in BELOW])
    else:
        paths = written(_weighted(paths, segs, cells, segment), "trie-weighted")
    nodes = _encode(paths, cells, segment, "trie-nodes")
    spines = written(_merged(nodes), "trie-merged")
    columns = ["conv", "depth", "parent_conv", "n_convs", "n_children", "n_leaves", "saved", "sha"]
    whole = nodes.filter("NOT spine")
    above = spines.select(F.col("name").alias("parent"), F.col("conv").alias("above"))
    below_spine = whole.filter("parent IS NOT NULL").drop("parent_conv").join(above, "parent").withColumnRenamed("above", "parent_conv")
    # The top of a deeper trie is the end of a segment, which has its row already.
    out = whole.filter("parent IS NULL").select(columns).unionByName(below_spine.select(columns))
    out = out.unionByName(spines.filter("level = 0 OR local_depth > 0").select(columns))
    empty = hashlib.sha256(b"").hexdigest()
    return out.withColumn("sha", F.coalesce("sha", F.lit(empty)))
