"""Counts of keys in bounded memory: hash containers under a shallow trie by the keys' leading bits, which are word ids.

A key is a phrase: its first bits are its first word's id, the next its second word's, and the rest a hash of all of it. A container
takes keys unsorted, sums repeated ones when it fills, and bursts into sixteen by its next bits when too many different ones
remain. When all containers hold too much, the largest subtrees leave as sorted runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
#: Distinct keys from which a container bursts, and keys that all containers hold together.
BURST, HELD = 1 << 14, 1 << 21
#: Bits by which a burst container's children part, and the most bits that the trie looks at: those of the two word ids.
STEP, DEEPEST = 4, 28


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with their counts' sums."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[new], np.add.reduceat(counts, new) if len(new) else counts


class Container:
    """Keys that share their first `depth` bits."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int):
        self.keys, self.counts, self.depth = keys, counts, depth
        self.fresh: list[np.ndarray] = []
        self.size = len(keys)

    def add(self, keys: np.ndarray) -> None:
        self.fresh.append(keys)
        self.size += len(keys)

    def pack(self) -> None:
        if self.fresh:
            keys, counts = np.unique(np.concatenate(self.fresh), return_counts=True)
            self.fresh = []
            if len(self.keys):
                keys, counts = summed(np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts]))
            self.keys, self.counts, self.size = keys, counts, len(keys)

    def burst(self) -> list[Container]:
        """The containers of the next bits, in order."""
        at = np.searchsorted(self.keys >> U(64 - self.depth - STEP) & U((1 << STEP) - 1), np.arange(1 << STEP, dtype=U))
        return [Container(k, c, self.depth + STEP) for k, c in zip(np.split(self.keys, at[1:]), np.split(self.counts, at[1:]), strict=True)]


class HatTrie:
    def __init__(self, burst: int = BURST, held: int = HELD):
        self.limit, self.held = burst, held
        self.leaves = [Container(np.empty(0, U), np.empty(0, np.int64), 0)]
        self.lows = np.zeros(1, U)  # the least key of each leaf
        self.size = 0

    def add(self, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Counts keys; runs that had to leave come out."""
        keys = np.sort(keys)
        at = np.append(np.searchsorted(keys, self.lows), len(keys))
        full = []
        for k in np.flatnonzero(np.diff(at)).tolist():
            leaf = self.leaves[k]
            leaf.add(keys[at[k] : at[k + 1]])
            if leaf.size > 2 * max(self.limit, len(leaf.keys)):
                full.append(k)
        self.size += len(keys)
        for k in reversed(full):
            leaf = self.leaves[k]
            self.size -= leaf.size
            leaf.pack()
            self.size += leaf.size
            if leaf.size > self.limit and leaf.depth < DEEPEST:
                parts = leaf.burst()
                low = self.lows[k] + (np.arange(1 << STEP, dtype=U) << U(64 - leaf.depth - STEP))
                self.leaves[k : k + 1], self.lows = parts, np.concatenate([self.lows[:k], low, self.lows[k + 1 :]])
        if self.size > self.held:
            yield from self.spill(self.held // 2)

    def spill(self, keep: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Sorted runs (keys, counts) of the largest subtrees, until at most `keep` keys are left."""
        for leaf in self.leaves:
            leaf.pack()
        self.size = sum(leaf.size for leaf in self.leaves)
        for leaf in sorted(self.leaves, key=lambda x: -x.size):
            if self.size <= keep or not leaf.size:
                break
            yield leaf.keys, leaf.counts
            self.size -= leaf.size
            leaf.keys, leaf.counts, leaf.size = leaf.keys[:0], leaf.counts[:0], 0
