"""Line signatures and edit distance for the segment-partition join, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """(start, size) of ``edits`` + 1 even segments of a line."""
    parts = edits + 1
    sizes = [length // parts + (k >= parts - length % parts) for k in range(parts)]
    return [(sum(sizes[:k]), sizes[k]) for k in range(parts)]


@lru_cache(4096)
def places(length: int, edits: int) -> list[tuple[int, int, int, int, int]]:
    """(less, segment number, its start, place, size), where a line of ``length`` may have the
    segments of a line shorter by ``less``; the line's own segments come first.

    If two lines are within ``edits`` edits, some segment of the shorter one is left
    untouched with few enough edits on either side of it; that bounds by how much its
    place can have moved, so the places are few.
    """
    out = []
    for less in range(min(edits, length) + 1):
        for k, (start, size) in enumerate(segments(length - less, edits)):
            low = max(start - k, start + less - (edits - k), 0)
            high = min(start + k, start + less + (edits - k), length - size)
            out += [(less, k, start, at, size) for at in range(low, high + 1)]
    return sorted(out, key=lambda p: (p[0] > 0 or p[3] != p[2], p))


@lru_cache(4096)
def signed_places(length: int, edits: int) -> list[tuple[int, int, int, bool]]:
    """(start, end, seed, own) of the places that give a line its signatures."""
    return [(at, at + size, (length - less) * (edits + 1) + k, not less and at == start) for less, k, start, at, size in places(length, edits)]


def segment_name(line: str, at: int, size: int, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(line[at : at + size].encode("utf-8", "surrogatepass"), seed)


def signatures(line: str, edits: int) -> dict[int, bool]:
    """Hashes of (indexed length, segment number, text), true for the line's own segments.

    The others are the substrings that may equal a segment of a line shorter by up
    to ``edits``.
    """
    out: dict[int, bool] = {}
    digest = xxhash.xxh3_64_intdigest
    if line.isascii():
        wide = line.encode()
        for at, end, seed, own in signed_places(len(line), edits):
            out.setdefault(digest(wide[at:end], seed), own)
    else:
        for at, end, seed, own in signed_places(len(line), edits):
            out.setdefault(digest(line[at:end].encode("utf-8", "surrogatepass"), seed), own)
    return out


@lru_cache(4096)
def next_places(length: int, shorter: int, edits: int) -> list[tuple[int, int, int, int]]:
    """(segment number, its start, place, size) in what is left of a line, ``length`` characters,
    of the segments of the bucket's own lines, which have ``shorter`` characters fewer."""
    own = length - shorter
    if own > edits:
        return [p[1:] for p in places(length, edits) if p[0] == shorter]
    # Too short for a character in each segment. If any two of such lengths are within
    # the edits, the bucket's centre has settled it; else one character is untouched.
    return [(edits + 1 + k, k, at, 1) for k in range(own) for at in range(length)] if length > edits else []


def narrower(edits: int):
    """(sig, name, own, label, cuts, whole, line) to (sig, name, own, label, cuts) of the next level.

    A member of a bucket shares a segment with the bucket's lines. ``cuts`` are the starts
    and sizes of what was cut out of it so far, each in what was left then; of a ``whole``
    line the segment is still to be cut, wherever it gives ``sig``. The new signatures
    are those of what is left, under the name of the bucket. A member that is its bucket's
    ``own`` has its own segments and the places nearby, the others only the latter.
    """

    def left(line: str, cuts: list[int]) -> str:
        for start, size in zip(cuts[::2], cuts[1::2]):
            line = line[:start] + line[start + size :]
        return line

    def first_cuts(line: str, sig: int) -> Iterator[tuple[list[int], int, bool]]:
        """(cuts, how much shorter the bucket's own lines are, own)."""
        for less, k, start, at, size in places(len(line), edits):
            if segment_name(line, at, size, (len(line) - less) * (edits + 1) + k) == sig:
                yield [at, size], less, not less and at == start

    def rows(batches):
        for batch in batches:
            for sig, name, own, label, cuts, whole, line in zip(*[batch.column(c).to_pylist() for c in ("sig", "name", "own", "label", "cuts", "whole", "line")]):
                sig, name, label = sig % 2**64, name % 2**64, label % 2**64
                known = first_cuts(line, sig) if whole else [(cuts[1:], cuts[0], own)]
                out: dict[tuple[int, str], tuple[bool, list[int]]] = {}
                for cut, shorter, owned in known:
                    rest = left(line, cut)
                    for k, start, at, size in next_places(len(rest), shorter, edits):
                        mine = owned and at == start
                        under = (sig * 0x9E3779B97F4A7C15 + k + 1) % 2**64
                        key = segment_name(rest, at, size, under), rest[:at] + rest[at + size :]
                        if key not in out or mine:
                            out[key] = mine, [shorter, *cut, at, size]
                for (new, _), (mine, cut) in out.items():
                    yield new, name, mine, label, cut

    return lambda batches: _batched(rows(batches), ["sig", "name", "own", "label", "cuts"])


#: Stands for a character that is open, in a changed line. No valid text holds it.
OPEN = "\ud800"


def shared_start(a: str, b: str) -> int:
    """Length of the common beginning."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def changes(line: str, other: str, at: int) -> Iterator[tuple[str, int, int]]:
    """(changed line, edits, open characters): ``line``, and what one change at ``at`` makes of it.

    A character there may go, become or be preceded by that of ``other``, or be left open.
    """
    yield line, 0, 0
    x, y = line[at : at + 1], other[at : at + 1]
    if x and x != OPEN:
        yield line[:at] + line[at + 1 :], 1, 0
        yield line[:at] + OPEN + line[at + 1 :], 0, 1
        if y:
            yield line[:at] + y + line[at + 1 :], 1, 0
    if y:
        yield line[:at] + y + line[at:], 1, 0


def changed(line: str, other: str, edits: int) -> dict[str, tuple[int, int]]:
    """{changed line: (edits, open characters)}, changed where ``line`` leaves ``other``, forwards and backwards.

    Two lines within two edits that leave ``other`` at different places, or by different
    characters, on both ends are equal after changes whose edits, and the open characters once,
    come to two at most; and whichever are, are within two edits.
    """
    if line == other:
        return {line: (0, 0)}
    out: dict[str, tuple[int, int]] = {}
    back, other_back = line[::-1], other[::-1]
    at, from_end = shared_start(line, other), shared_start(back, other_back)
    # Two characters more or less at one place, where the ends that are shared may overlap.
    double = [(line[:at] + line[at + 2 :], 2, 0), (line[:at] + other[at : at + 2] + line[at:], 2, 0)]
    for one, cost, left_open in changes(line, other, at):
        for two, more, more_open in changes(one[::-1], other_back, from_end):
            double.append((two[::-1], cost + more, left_open + more_open))
    for text, cost, left_open in double:
        if cost + left_open <= edits and (text not in out or cost < out[text][0]):
            out[text] = cost, left_open
    return out


def changed_rows(edits: int):
    """(name, label, line, other) to (sig, name, label, cost, open): the changed lines by their hashes."""

    def rows(batches):
        for batch in batches:
            for name, label, line, other in zip(*[batch.column(c).to_pylist() for c in ("name", "label", "line", "other")]):
                for text, (cost, left_open) in changed(line, other, edits).items():
                    yield name_of(text), name % 2**64, label % 2**64, cost, left_open

    return lambda batches: _batched(rows(batches), ["sig", "name", "label", "cost", "open"])


def leaving_rows(batches):
    """(name, middle, line, other) to (name, middle, sides): the places and characters with which a line leaves the other, forwards and backwards."""
    for batch in batches:
        sides = []
        for line, other in zip(batch.column("line").to_pylist(), batch.column("other").to_pylist()):
            found = [] if line == other else [(side, a, shared_start(a, b)) for side, a, b in ((0, line, other), (1, line[::-1], other[::-1]))]
            sides.append([2 * (at * 0x110000 + ord(a[at])) + side for side, a, at in found if at < len(a)])
        yield pa.RecordBatch.from_arrays([batch.column("name"), batch.column("middle"), pa.array(sides, pa.list_(pa.int64()))], ["name", "middle", "sides"])


#: Classes of letter pairs, in words of 64 bits.
PARITY_WORDS = 4


def parity(line: str) -> list[int]:
    """Parities of the counts of letter pairs by class. An edit flips at most 4 of them."""
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    pairs = ((codes[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (codes[1:] * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0x165667B19E3779F9)
    classes = (pairs >> np.uint64(32)).astype(np.int64) % (64 * PARITY_WORDS)
    counts = np.bincount(classes, minlength=64 * PARITY_WORDS) & 1
    return np.packbits(counts.astype(np.uint8)).view(np.int64).tolist()


def within(a: str, b: str, k: int) -> bool:
    """Whether the edit distance is at most k, by bit vectors over a band of 2 k + 1 rows.

    Bit i of a column's vectors stands for row column - k + i. The band's lowest
    cell is followed down the diagonal to the last row, and then along that row.
    """
    if abs(len(a) - len(b)) > k:
        return False
    start = 0
    for x, y in zip(a, b):
        if x != y:
            break
        start += 1
    a, b = a[start:], b[start:]
    end = 0
    for x, y in zip(reversed(a), reversed(b)):
        if x != y:
            break
        end += 1
    a, b = a[: len(a) - end], b[: len(b) - end]
    m = len(a)
    if not m or not b:
        return max(m, len(b)) <= k
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    band = (1 << (2 * k + 1)) - 1
    plus, minus, score = (band << k) & band, 0, min(k, m)
    for j, x in enumerate(b, 1):
        seen = places.get(x, 0)
        shift = j - k - 1
        same = ((seen >> shift) if shift >= 0 else (seen << -shift)) & band
        zero = ((((same & plus) + plus) ^ plus) | same | minus) & band
        up = (minus | ~(zero | plus)) & band
        down = zero & plus
        if j + k <= m:
            score += not zero >> (2 * k) & 1
        else:
            row = m - j + k
            score += (up >> row & 1) - (down >> row & 1)
        plus = (down | ~((zero >> 1) | up)) & band
        minus = (zero >> 1) & up
        if score > 2 * k + abs(m - len(b)):
            return False
    return score <= k


def signed(values) -> pa.Array:
    """64-bit hashes as Spark's longs."""
    return pa.array(np.fromiter(values, np.uint64).view(np.int64))


def long_lines(text: str | None, least: int) -> Iterator[tuple[int, str]]:
    """(number, line) of the lines with at least ``least`` characters."""
    return ((k, line) for k, line in enumerate((text or "").split("\n")) if len(line) >= least)


def name_of(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"))


def _batched(rows: Iterator[tuple], columns: list[str], size: int = 20_000) -> Iterator[pa.RecordBatch]:
    part: list[tuple] = []

    def out() -> pa.RecordBatch:
        arrays = []
        for name, values in zip(columns, zip(*part)):
            arrays.append(pa.array(values, pa.int32()) if name in ("cost", "open") else pa.array(values) if name in ("line", "doc", "no", "own") else pa.array(values, pa.list_(pa.int32())) if name == "cuts" else signed(values))
        return pa.RecordBatch.from_arrays(arrays, columns)

    for row in rows:
        part.append(row)
        if len(part) == size:
            yield out()
            part = []
    if part:
        yield out()


def occurrences(least: int):
    """(id, text) to (doc, no, name): where each long line stands."""

    def rows(batches):
        for batch in batches:
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                if doc is not None:
                    for no, line in long_lines(text.as_py(), least):
                        yield doc, no, name_of(line)

    return lambda batches: _batched(rows(batches), ["doc", "no", "name"])


def signature_rows(least: int, edits: int):
    """(id, text) to (sig, name, own), each line once per batch."""

    def rows(batches):
        for batch in batches:
            seen = set()
            for doc, text in zip(batch.column("id"), batch.column("text")):
                if doc.is_valid:
                    for _, line in long_lines(text.as_py(), least):
                        name = name_of(line)
                        if name not in seen:
                            seen.add(name)
                            for sig, own in signatures(line, edits).items():
                                yield sig, name, own

    return lambda batches: _batched(rows(batches), ["sig", "name", "own"])


def line_rows(least: int):
    """(id, text) to (name, line), each line once per batch."""

    def rows(batches):
        for batch in batches:
            seen = set()
            for doc, text in zip(batch.column("id"), batch.column("text")):
                if doc.is_valid:
                    for _, line in long_lines(text.as_py(), least):
                        name = name_of(line)
                        if name not in seen:
                            seen.add(name)
                            yield name, line

    return lambda batches: _batched(rows(batches), ["name", "line"])


def with_parity(batches):
    """(name, line) to (name, line, chars, parity)."""
    for batch in batches:
        lines = batch.column("line").to_pylist()
        chars = pa.array([len(x) for x in lines], pa.int32())
        bits = pa.array([parity(x) for x in lines], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("name"), batch.column("line"), chars, bits], ["name", "line", "chars", "parity"])


def close_pairs(edits: int):
    """(a, b, line1, line2) to the (a, b) within ``edits`` edits."""

    def run(batches):
        for batch in batches:
            pairs = zip(batch.column("line1").to_pylist(), batch.column("line2").to_pylist())
            yield batch.select(["a", "b"]).filter(pa.array([within(x, y, edits) for x, y in pairs], pa.bool_()))

    return run
