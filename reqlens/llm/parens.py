"""Balanced parentheses of a forest, with the least and greatest excess of blocks."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np

BLOCK = 64
QUERIES_AT_ONCE = 1 << 14


class Parens:
    """The parentheses of a forest in depth-first order: a node opens, its children follow, it closes. Node i is
    the one whose parenthesis opens as the i-th."""

    def __init__(self, opens: np.ndarray):
        self.bits = np.asarray(opens, bool)
        self.excess = np.cumsum(np.where(self.bits, 1, -1), dtype=np.int32)
        self.open_at = np.flatnonzero(self.bits)
        blocks = -(-len(self.bits) // BLOCK)
        # beyond the end lies a closing parenthesis of no node, which no search passes
        self.padded = np.full(blocks * BLOCK, -1, np.int32)
        self.padded[:len(self.bits)] = self.excess
        by_block = self.padded.reshape(blocks, BLOCK)
        self.least, self.greatest = by_block.min(axis=1), by_block.max(axis=1)

    def __len__(self) -> int:
        return len(self.open_at)

    def _first_in_block(self, block: np.ndarray, after: np.ndarray, excess: np.ndarray) -> np.ndarray:
        """The first position behind ``after`` in ``block`` with this excess, or -1."""
        at = block[:, None] * BLOCK + np.arange(BLOCK)
        hit = (self.padded[at] == excess[:, None]) & (at > after[:, None])
        return np.where(hit.any(axis=1), block * BLOCK + hit.argmax(axis=1), -1)

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """The position that closes what opens at each position ``at``: the first behind it whose excess is one
        less. Blocks whose range of excess leaves that out are passed over."""
        out = np.empty(len(at), np.int64)
        for part in range(0, len(at), QUERIES_AT_ONCE):
            out[part:part + QUERIES_AT_ONCE] = self._findclose(at[part:part + QUERIES_AT_ONCE])
        return out

    def _findclose(self, at: np.ndarray) -> np.ndarray:
        want, block = self.excess[at] - 1, at // BLOCK
        out = self._first_in_block(block, at, want)
        left = np.flatnonzero(out < 0)
        block = block[left] + 1
        while len(left):
            inside = (self.least[block] <= want[left]) & (self.greatest[block] >= want[left])
            found = left[inside]
            out[found] = self._first_in_block(block[inside], at[found], want[found])
            left, block = left[~inside], block[~inside] + 1
        return out

    def sizes(self) -> np.ndarray:
        """The number of nodes of each node's subtree, itself included."""
        return (self.findclose(self.open_at) - self.open_at + 1) // 2

    def leaf_pairs(self) -> np.ndarray:
        """Whether each node closes where it opens."""
        return ~np.append(self.bits, False)[self.open_at + 1]


def subtree_sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over each node's subtree, from their running sum."""
    running = np.concatenate([[0], np.cumsum(values)])
    first = np.arange(len(sizes))
    return running[first + sizes] - running[first]


def subtree_least(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The least of ``values`` in each node's subtree."""
    first = np.arange(len(sizes))
    bounds = np.stack([first, first + sizes], axis=1).ravel()
    return np.minimum.reduceat(np.append(values, values.max(initial=0)), bounds)[::2]


def forest_of(paths: Sequence[Sequence]) -> tuple[Parens, np.ndarray, np.ndarray, np.ndarray]:
    """(parentheses, parent, path, level) of the trie of sorted, distinct paths: of each node its parent's number
    (-1: none), the first path through it and its place on that path."""
    bits: list[int] = []
    parent: list[int] = []
    of_path: list[int] = []
    level: list[int] = []
    stack: list[int] = []
    last: Sequence = ()
    for p, path in enumerate(paths):
        shared = 0
        for a, b in zip(last, path, strict=False):
            if a != b:
                break
            shared += 1
        bits += [0] * (len(stack) - shared)
        del stack[shared:]
        for k in range(shared, len(path)):
            bits.append(1)
            parent.append(stack[-1] if stack else -1)
            of_path.append(p)
            level.append(k)
            stack.append(len(parent) - 1)
        last = path
    bits += [0] * len(stack)
    return Parens(np.array(bits, bool)), np.array(parent, np.int64), np.array(of_path, np.int64), np.array(level, np.int64)
