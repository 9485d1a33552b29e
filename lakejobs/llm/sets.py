"""Word shingle sets and their sketches, made in Arrow batches.

A set is an ascending array of distinct 64-bit hashes of word shingles. A text
with fewer words than a shingle is one shingle; a text without words is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

EMPTY = np.uint64(2**64 - 1)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Elements that are sketched at a time, which bounds the memory of a task.
CHUNK = 400_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """The set of a UTF-8 text: words as ASCII spaces separate them, A-Z lower-cased."""
    found = (text or b"").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    if len(found) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found))], np.uint64)
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    n = len(one) - width + 1
    out = one[:n].copy()
    for k in range(1, width):
        out = mixed(out + GOLDEN) + one[k : k + n]
    return np.unique(mixed(out))


def sketches(values: np.ndarray, owner: np.ndarray, n_sets: int, t: int) -> np.ndarray:
    """Fast similarity sketches of ``n_sets`` non-empty sets, one row of ``t`` each.

    In round i each element falls into a hashed bin, and in the last t rounds all
    of them into bin i - t, so every coordinate is filled after 2 t rounds at the
    latest. A coordinate keeps its smallest (round, hash); sets leave the rounds
    when they are full. Two sets agree in a coordinate with probability equal to
    their similarity, and the number of agreements is as concentrated as that of
    independent draws.
    """
    out = np.full((n_sets, t), EMPTY, np.uint64)
    left = np.arange(n_sets)
    low = np.uint64(0xFFFFFFFF)
    for i in range(2 * t):
        h = mixed(values + np.uint64(int(GOLDEN) * (i + 1) % 2**64))
        where = ((h >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32) if i < t else np.uint64(i - t)
        place = (np.uint64(i) << np.uint64(32)) | (h & low)
        np.minimum.at(out.reshape(-1), owner * t + np.asarray(where, np.int64), place)
        if i < 16 or i % 16 == 0:
            open_sets = (out[left] == EMPTY).any(axis=1)
            if not open_sets.any():
                break
            if not open_sets.all():
                left = left[open_sets]
                live = np.zeros(n_sets, bool)
                live[left] = True
                stay = live[owner]
                values, owner = values[stay], owner[stay]
    return out


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` coordinates; the band number is part of it."""
    n, t = sketch.shape
    parts = sketch.reshape(n, t // rows, rows)
    key = np.broadcast_to(np.arange(t // rows, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(rows):
        key = mixed(key * GOLDEN + parts[:, :, k])
    return key


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _texts(batch: pa.RecordBatch) -> Iterator[bytes | None]:
    column = batch.column("text").cast(pa.large_binary())
    return (x.as_py() for x in column)


def sketched(width: int, bands: int, rows: int):
    """A map over (id, text) batches to (id, n, k1, k2, keys); k1 and k2 identify the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("id"), _texts(batch)
            start = 0
            while start < batch.num_rows:
                sets, n = [], 0
                while start + len(sets) < batch.num_rows and n < CHUNK:
                    sets.append(shingles(next(texts), width))
                    n += len(sets[-1])
                sizes = np.array([len(s) for s in sets])
                full = [s for s in sets if len(s)]
                keys = np.empty((0, bands), np.uint64)
                if full:
                    owner = np.repeat(np.arange(len(full)), [len(s) for s in full])
                    keys = band_keys(sketches(np.concatenate(full), owner, len(full), bands * rows), rows)
                each, empty = iter(keys), np.empty(0, np.uint64)
                whole = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                pair = np.frombuffer(b"".join(whole), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(start, len(sets)), pa.array(sizes), pa.array(pair[:, 0]), pa.array(pair[:, 1]),
                     _lists([next(each) if len(s) else empty for s in sets])],
                    ["id", "n", "k1", "k2", "keys"],
                )
                start += len(sets)

    return run


def as_sets(width: int):
    """A map over (id, text) batches to (node, n, k, s) with the full sets; k tells the sets of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("id"), _texts(batch)
            for start in range(0, batch.num_rows, 200):
                part = ids.slice(start, 200)
                sets = [shingles(next(texts), width) for _ in range(len(part))]
                k = pa.array(np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([part, pa.array([len(s) for s in sets], pa.int64()), k, _lists(sets)], ["node", "n", "k", "s"])

    return run
