"""A bidirectional FM-index over delimited words, searched in numpy for many words at a time.

The words are laid out as ``$one$two$three$``. Two Burrows-Wheeler transforms, of this
text and of its reverse, give the ranks of the suffixes that begin with a pattern as
an interval; a pattern grows by a letter at either end, and both intervals follow.
"""

from __future__ import annotations

import numpy as np

END, STOP, FIRST = 0, 1, 2
#: Places between stored counts.
STEP = 32


def suffix_order(text: np.ndarray, letters: int) -> np.ndarray:
    """The suffixes of ``text`` in order, by doubling the length that is compared."""
    n = len(text)
    bits = int(letters).bit_length()
    width = 62 // bits
    padded = np.zeros(n + width, np.int64)
    padded[:n] = text
    key = np.zeros(n, np.int64)
    for k in range(width):
        key = (key << bits) | padded[k : k + n]
    while True:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.r_[0, np.cumsum(ordered[1:] != ordered[:-1])]
        if rank[order[-1]] == n - 1:
            return order
        after = np.zeros(n, np.int64)
        after[: max(n - width, 0)] = rank[width:] + 1
        key = rank * (n + 1) + after
        width *= 2


class Ranks:
    """Counts of every letter before each place of a transform."""

    def __init__(self, text: np.ndarray, letters: int) -> None:
        self.order = suffix_order(text, letters)
        n, self.letters = len(text), letters
        transform = text[self.order - 1]
        self.blocks = np.full((n // STEP + 1) * STEP, letters, np.uint8)
        self.blocks[:n] = transform
        self.blocks = self.blocks.reshape(-1, STEP)
        inside = np.zeros((len(self.blocks), letters), np.int32)
        np.add.at(inside, (np.arange(n) // STEP, transform), 1)
        self.stored = np.zeros_like(inside)
        np.cumsum(inside[:-1], axis=0, out=self.stored[1:])
        self.starts = np.r_[0, np.cumsum(np.bincount(text, minlength=letters))[:-1]]

    def of(self, place: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """How often each letter comes before each place."""
        block = place // STEP
        seen = (self.blocks[block] == letter[:, None]) & (np.arange(STEP) < (place % STEP)[:, None])
        return self.stored[block, letter] + seen.sum(axis=1)

    def all(self, place: np.ndarray) -> np.ndarray:
        """The counts of all letters before each place, a row for each."""
        block = place // STEP
        codes = np.where(np.arange(STEP) < (place % STEP)[:, None], self.blocks[block], self.letters)
        flat = codes + np.arange(len(place))[:, None] * (self.letters + 1)
        counts = np.bincount(flat.ravel(), minlength=len(place) * (self.letters + 1))
        return self.stored[block] + counts.reshape(len(place), self.letters + 1)[:, :-1]


class Index:
    """The index of some distinct words."""

    def __init__(self, words: list[str]) -> None:
        self.words = sorted(words)
        joined = "$" + "$".join(self.words) + "$"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        self.alphabet = np.setdiff1d(points, [ord("$")])
        # One more letter, which never comes, stands for those that are not in the words.
        self.letters = FIRST + len(self.alphabet) + 1
        text = np.where(points == ord("$"), STOP, self._codes(points)).astype(np.uint8)
        self.n = len(text)
        self.left = Ranks(np.r_[text, np.uint8(END)], self.letters)
        self.right = Ranks(np.r_[text[::-1], np.uint8(END)], self.letters)
        self.stops = np.cumsum(text == STOP)
        self.lengths = {len(w) for w in self.words}

    def _codes(self, points: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, FIRST + at, self.letters - 1)

    def _matrix(self, queries: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Letters of the queries, each followed by the delimiter, and their lengths."""
        sizes = np.array([len(q) for q in queries])
        points = np.frombuffer("".join(queries).encode("utf-32-le"), np.uint32)
        out = np.full((len(queries), sizes.max() + 1), STOP, np.int64)
        out[np.arange(sizes.max() + 1) < sizes[:, None]] = self._codes(points)
        return out, sizes

    def _first_parts(self, q: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of ``$`` and the first ``k`` letters, found from right to left.

        Both intervals are kept: the one of the text, in which the search goes on to
        the left, and the one of its reverse, which the extension to the right needs.
        """
        low, other = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
        size = np.full(len(q), self.n + 1, np.int64)
        for t in range(k.max() + 1):
            live = np.flatnonzero((t <= k) & (size > 0))
            letter = np.where(t < k[live], q[live, np.maximum(k[live] - 1 - t, 0)], STOP)
            before = self.left.all(low[live])
            inside = self.left.all(low[live] + size[live]) - before
            row = np.arange(len(live))
            smaller = np.cumsum(inside, axis=1)[row, letter] - inside[row, letter]
            low[live] = self.left.starts[letter] + before[row, letter]
            other[live] += smaller
            size[live] = inside[row, letter]
        return other, size

    def _extended(self, low: np.ndarray, size: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the reverse after one more letter to the right."""
        before = self.right.of(low, letter)
        return self.right.starts[letter] + before, self.right.of(low + size, letter) - before

    def near(self, queries: list[str], k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) by number: words one edit away that begin with the query's first ``k`` letters.

        The first part is matched exactly, then the rest with one letter replaced,
        inserted or deleted. Of several places that give the same word only the
        last is tried.
        """
        q, sizes = self._matrix(queries)
        low, size = self._first_parts(q, k)
        kinds = [np.isin(sizes + d, list(self.lengths)) for d in (-1, 0, 1)]
        # Exact states by query, and states (query, low, size) with an error by place.
        erred: dict[int, list] = {}
        found_q, found_w = [], []
        for t in range(int(k.min()), int(sizes.max()) + 1):
            here = np.flatnonzero((size > 0) & (t >= k) & (t <= sizes))
            if len(here):
                lo, n, now = low[here], size[here], q[here, t]
                before = self.right.all(lo)
                inside = self.right.all(lo + n) - before
                inside[:, [END, STOP]] = 0
                row = np.arange(len(here))
                other = inside > 0
                other[row, now] = False
                for kind, place in ((2, t), (1, t + 1)):
                    i, c = np.nonzero(other & (kinds[kind][here] & ((kind == 2) | (now != STOP)))[:, None])
                    erred.setdefault(place, []).append((here[i], self.right.starts[c] + before[i, c], inside[i, c]))
                last = (now != STOP) & (q[here, np.minimum(t + 1, q.shape[1] - 1)] != now) & kinds[0][here]
                erred.setdefault(t + 1, []).append((here[last], lo[last], n[last]))
                go = now != STOP
                low[here[go]] = self.right.starts[now[go]] + before[row[go], now[go]]
                size[here[go]] = inside[row[go], now[go]]
                size[here[~go]] = 0
            states = erred.pop(t, [])
            if states:
                who, lo, n = (np.concatenate(x) for x in zip(*states))
                letter = q[who, t]
                lo, n = self._extended(lo, n, letter)
                done = (n > 0) & (letter == STOP)
                if done.any():
                    end = self.n - 1 - self.right.order[lo[done]]
                    found_q.append(who[done])
                    found_w.append(self.stops[end] - 2)
                on = (n > 0) & (letter != STOP)
                erred.setdefault(t + 1, []).append((who[on], lo[on], n[on]))
        none = np.empty(0, np.int64)
        return np.concatenate([none, *found_q]), np.concatenate([none, *found_w])
