"""A trie as balanced parentheses, with range min-max blocks over the excess.

Built from distinct paths in order. An opening parenthesis stands for a node, in the
order of a walk; the matching closing one ends its subtree.
"""

from __future__ import annotations

import numpy as np

BLOCK = 64
HIGH = np.iinfo(np.int64).max


class Parens:
    def __init__(self, lengths: np.ndarray, shared: np.ndarray) -> None:
        """``lengths`` of the paths, and how much each shares with the one before it (0 for the first)."""
        opens = lengths - shared
        closes = np.r_[0, lengths[:-1] - shared[1:], lengths[-1] + 1]
        runs = np.empty(2 * len(lengths) + 1, np.int64)
        runs[0::2], runs[1::2] = closes, opens
        runs[1] += 1  # the root
        bits = np.repeat(np.arange(len(runs)) % 2, runs)
        self.open = np.flatnonzero(bits)
        self.rank = np.cumsum(bits)
        excess = np.cumsum(2 * bits - 1)
        self.depth = excess[self.open] - 1
        #: Leaf pairs up to each place.
        self.leaf_rank = np.cumsum(np.r_[(bits[:-1] == 1) & (bits[1:] == 0), False])
        # Level 0 is the excess, and each further one the least of blocks of the last.
        self.levels = [excess]
        while len(self.levels[-1]) > 1:
            last = self.levels[-1]
            padded = np.full(-(-len(last) // BLOCK) * BLOCK, HIGH)
            padded[: len(last)] = last
            self.levels[-1] = padded.reshape(-1, BLOCK)
            self.levels.append(self.levels[-1].min(axis=1))
        self.levels[-1] = self.levels[-1].reshape(-1, 1)
        self.close = self.find_close(self.open)
        #: Nodes of each subtree, by the last node that it holds.
        self.last = self.rank[self.close] - 1
        #: The node at which each path ends.
        self.ends = np.cumsum(opens)

    def find_close(self, place: np.ndarray) -> np.ndarray:
        """The closing parenthesis of each opening one: the next place with less excess.

        Up through the blocks until one holds such a place, then down into it.
        """
        target = self.levels[0].reshape(-1)[place] - 1
        found, level = np.full(len(place), -1), np.zeros(len(place), np.int64)
        at, left = place.copy(), np.arange(len(place))
        for k, blocks in enumerate(self.levels):
            width = blocks.shape[1]
            fits = (blocks[at[left] // width] <= target[left, None]) & (np.arange(width) > (at[left] % width)[:, None])
            hit = fits.any(axis=1)
            found[left[hit]] = at[left[hit]] // width * width + fits[hit].argmax(axis=1)
            level[left[hit]] = k
            left = left[~hit]
            at[left] //= width
            if not len(left):
                break
        for k in range(len(self.levels) - 2, -1, -1):
            down = np.flatnonzero(level > k)
            inside = self.levels[k][found[down]] <= target[down, None]
            found[down] = found[down] * BLOCK + inside.argmax(axis=1)
        return found

    def parents(self) -> np.ndarray:
        """The parent of each node, by number; -1 for the root."""
        out = np.full(len(self.open), -1)
        for d in range(1, int(self.depth.max()) + 1):
            here, above = np.flatnonzero(self.depth == d), np.flatnonzero(self.depth == d - 1)
            out[here] = above[np.searchsorted(above, here) - 1]
        return out

    def leaves(self) -> np.ndarray:
        """Leaf pairs inside each node, itself included."""
        return self.leaf_rank[self.close] - np.where(self.open > 0, self.leaf_rank[self.open - 1], 0)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """The sum of ``values`` of the nodes over each subtree, from one cumulative array."""
        total = np.r_[0, np.cumsum(values)]
        return total[self.last + 1] - total[np.arange(len(values))]

    def least(self, values: np.ndarray, parents: np.ndarray) -> np.ndarray:
        """The least of ``values`` over each subtree, from the deepest nodes up."""
        out = values.copy()
        for d in range(int(self.depth.max()), 0, -1):
            here = np.flatnonzero(self.depth == d)
            np.minimum.at(out, parents[here], out[here])
        return out
