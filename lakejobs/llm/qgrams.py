"""Q-gram filtering and banded alignment of a block of patterns, and exact runs of words, over Arrow batches."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

Q = 8
#: Characters that are searched at a time, which bounds the memory of a task.
CHUNK = 1_000_000
TABLE_BITS = 20
#: Candidates that are aligned at a time.
ALIGN = 20_000
HITS = pa.list_(pa.struct([("item", pa.int64()), ("start", pa.int64()), ("edits", pa.int32())]))


def normalised(text: str | None) -> str:
    """Lower-cased, with single spaces between words."""
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(code: np.ndarray) -> np.ndarray:
    """The q-gram at every place, its characters folded to a byte each.

    Folding can only make grams equal that differ, so no match is lost to it.
    """
    byte = ((code ^ (code >> np.uint32(8))) & np.uint32(0xFF)).astype(np.uint8)
    if len(byte) < Q:
        return np.empty(0, np.uint64)
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(byte, Q)).view(np.uint64).reshape(-1)


def slots(gram: np.ndarray) -> np.ndarray:
    return (gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)


@functools.cache
def _in_words() -> np.ndarray:
    """For every code point, whether it is part of words: letters, marks and numbers."""
    return np.array([unicodedata.category(chr(c))[0] in "LMN" for c in range(0x110000)])


def word_bounds(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; all that is no letter, mark or number separates."""
    edges = np.flatnonzero(np.diff(_in_words()[code].astype(np.int8), prepend=0, append=0))
    return edges[::2], edges[1::2]


_BASE = 0x9E3779B97F4A7C15


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    both = [np.full(n, x, np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
    for x in both:
        x[0] = 1
    return tuple(np.cumprod(x, dtype=np.uint64) for x in both)


def word_names(code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit name of each word, wherever it stands."""
    power, inverse = _powers(1 << max(len(code), 1).bit_length())
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((code.astype(np.uint64) + np.uint64(1)) * power[: len(code)], dtype=np.uint64)])
    name = (total[ends] - total[starts]) * inverse[starts]
    name = (name ^ (name >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return name ^ (name >> np.uint64(29))


def run_names(names: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit name of each run of ``size`` words."""
    n = max(len(names) - size + 1, 0)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(0xBF58476D1CE4E5B9) + names[k : n + k]
    return out ^ (out >> np.uint64(31))


class Runs:
    """All runs of ``width`` words of the texts, and shorter texts whole, by their names."""

    def __init__(self, items: list, texts: list[str], width: int) -> None:
        self.items, self.index = items, {}
        parts: dict[int, list] = {}
        for k, text in enumerate(texts):
            code = codes(text)
            names = word_names(code, *word_bounds(code))
            if len(names):
                size = min(width, len(names))
                parts.setdefault(size, []).append((k, run_names(names, size)))
        for size, rows in parts.items():
            owner = np.repeat([k for k, _ in rows], [len(r) for _, r in rows])
            run = np.concatenate([r for _, r in rows])
            order = np.argsort(run, kind="stable")
            run, first, count = np.unique(run[order], return_index=True, return_counts=True)
            table = np.zeros(1 << TABLE_BITS, bool)
            table[slots(run)] = True
            self.index[size] = run, first, count, owner[order], table

    def search(self, code: np.ndarray, texts: np.ndarray) -> Iterator[tuple[int, object, int]]:
        """(number of the text, item, place) of the first place of each run in each text, which starts in ``texts``."""
        if not self.index:
            return
        starts, ends = word_bounds(code)
        names = word_names(code, starts, ends)
        text = np.searchsorted(texts, starts, "right") - 1
        for size, (run, first, count, owner, table) in self.index.items():
            name = run_names(names, size)
            at = np.flatnonzero(table[slots(name)])
            found = np.minimum(np.searchsorted(run, name[at]), len(run) - 1)
            real = (run[found] == name[at]) & (text[at] == text[at + size - 1])
            at, found = at[real], found[real]
            _, one = np.unique(text[at] * len(run) + found, return_index=True)
            for k, r, place in zip(text[at[one]], found[one], starts[at[one]]):
                for o in owner[first[r] : first[r] + count[r]]:
                    yield int(k), self.items[o], int(place - texts[k])


class Block:
    """Patterns with their edit budgets and an index of their q-grams, and runs of words to find as they are."""

    def __init__(self, items: list, texts: list[str], rate: float, runs: Runs | None = None) -> None:
        self.runs = runs
        self.items, self.codes = items, [codes(t) for t in texts]
        size = np.array([len(c) for c in self.codes], np.int64)
        self.size, self.budget = size, (size * rate).astype(np.int64)
        # A pattern of m characters with k edits keeps m + 1 - q - k q of its q-grams.
        self.least = np.maximum(size + 1 - Q - self.budget * Q, 1)
        all_grams = [grams(c) for c in self.codes]
        gram = np.concatenate([np.empty(0, np.uint64), *all_grams])
        owner = np.repeat(np.arange(len(texts)), np.array([len(g) for g in all_grams], np.int64))
        place = np.concatenate([np.empty(0, np.int64), *(np.arange(len(g)) for g in all_grams)])
        order = np.argsort(gram, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.gram, self.first, self.count = np.unique(gram[order], return_index=True, return_counts=True)
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[slots(self.gram)] = True

    def candidates(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, lowest diagonal) of the bands with enough shared q-grams.

        The hits of a match lie on k + 1 neighbouring diagonals at most. Bands of
        2 (k + 1) diagonals that start every k + 1 hold them in one of two bands.
        """
        gram = grams(code)
        at = np.flatnonzero(self.table[slots(gram)])
        if not len(at):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        found = np.searchsorted(self.gram, gram[at])
        found[found == len(self.gram)] = 0
        real = self.gram[found] == gram[at]
        at, found = at[real], found[real]
        # A match needs its share of places that are in the index at all.
        reach = int((self.size + self.budget).max())
        total = np.searchsorted(at, at + reach) - np.searchsorted(at, at - reach)
        dense = total >= int(self.least.min())
        at, found = at[dense], found[dense]
        n = self.count[found]
        if not len(n):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        entry = np.repeat(self.first[found] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        pattern = self.owner[entry]
        step = self.budget[pattern] + 1
        band = (np.repeat(at, n) - self.place[entry]) // step
        wide = np.int64(len(code) + 2)
        low = int(band.min()) - 1
        key = np.concatenate([pattern * wide * 2 + (band - low), pattern * wide * 2 + (band - 1 - low)])
        key, hits = np.unique(key, return_counts=True)
        pattern = key // (wide * 2)
        enough = hits >= self.least[pattern]
        pattern, band = pattern[enough], key[enough] % (wide * 2) + low
        return pattern, band * (self.budget[pattern] + 1)

    def aligned(self, code: np.ndarray, pattern: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(edits, end diagonal) of the best alignment of each whole pattern in its band."""
        best, where = np.full(len(pattern), 1 << 20), np.zeros(len(pattern), np.int64)
        order = np.argsort(self.size[pattern], kind="stable")
        sizes = self.size[pattern][order]
        starts = np.flatnonzero(np.r_[True, sizes[1:] != sizes[:-1]]) if len(order) else []
        groups = [order[a:b] for a, b in zip(starts, [*starts[1:], len(order)])]
        for group in (g[i : i + ALIGN] for g in groups for i in range(0, len(g), ALIGN)):
            m, width = int(self.size[pattern[group[0]]]), 2 * (int(self.budget[pattern[group[0]]]) + 1)
            text_at = low[group][:, None] + np.arange(m + width)
            inside = (text_at >= 0) & (text_at < len(code))
            text = np.where(inside, code[np.clip(text_at, 0, len(code) - 1)], np.uint32(0))
            sample = np.stack([self.codes[p] for p in pattern[group]])
            offset = np.arange(width, dtype=np.int32)
            cost = np.zeros((len(group), width), np.int32)
            for i in range(m):
                new = cost + (text[:, i : i + width] != sample[:, i : i + 1])
                new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)
                cost = np.minimum.accumulate(new - offset, axis=1) + offset
            best[group], where[group] = cost.min(axis=1), low[group] + cost.argmin(axis=1)
        return best, where

    def search(self, texts: list[str]) -> list[list[dict]]:
        """The hits of each normalised text: item, start (about) and edits, per item the best."""
        # A gap of zeros, which no pattern holds, keeps texts apart.
        gap = "\0" * (Q + 1)
        starts = np.cumsum([0] + [len(t) + len(gap) for t in texts])
        code = codes(gap.join(texts) + gap)
        pattern, low = self.candidates(code)
        edits, end = self.aligned(code, pattern, low)
        out: list[dict] = [{} for _ in texts]

        def add(k: int, item: object, start: int, edits: int) -> None:
            old = out[k].get(item)
            if old is None or (edits, start) < (old["edits"], old["start"]):
                out[k][item] = {"item": item, "start": start, "edits": edits}

        for p, e, d in zip(pattern, edits, end):
            if e <= self.budget[p]:
                k = int(np.searchsorted(starts, d + self.size[p] // 2, "right")) - 1
                add(k, self.items[p], int(max(d - starts[k], 0)), int(e))
        for k, item, place in self.runs.search(code, starts) if self.runs else ():
            add(k, item, place, 0)
        return [list(x.values()) for x in out]


def searched(block: Block):
    """(row, text, hits) to the same with the block's hits added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, hits, part, n = batch.column("text"), [], [], 0
            for i, text in enumerate(texts):
                part.append(normalised(text.as_py()))
                n += len(part[-1])
                if n >= CHUNK or i + 1 == batch.num_rows:
                    hits += block.search(part)
                    part, n = [], 0
            old = batch.column("hits").to_pylist()
            new = pa.array([(a or []) + b for a, b in zip(old, hits)], HITS)
            yield pa.RecordBatch.from_arrays([batch.column("row"), texts, new], ["row", "text", "hits"])

    return run
