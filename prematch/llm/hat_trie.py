"""Count keys of word ids in a shallow trie whose leaves are hash containers, within a fixed number of entries."""

from __future__ import annotations

import numpy as np

from .word_hashes import mix

DIGIT = 4             # bits of the first word's id per trie level: 16 children
DEPTH = 2             # the trie is at most so deep; containers below it grow instead of bursting
BURST = 1 << 17       # entries at which a container bursts into one per next digit
MAX_ENTRIES = 2_500_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def key_hashes(keys: np.ndarray) -> np.ndarray:
    """One hash per column of word ids."""
    h = np.zeros(keys.shape[1], np.uint64)
    for row in keys:
        h = h * _ODD + row
    return mix(h)


def combined(keys: np.ndarray, hashes: np.ndarray, counts: np.ndarray):
    """Distinct keys in the order of their hashes, with added counts."""
    if not len(hashes):
        return keys, hashes, counts
    order = np.argsort(hashes)
    keys, hashes, counts = keys[:, order], hashes[order], counts[order]
    if (hashes[1:] == hashes[:-1]).any():
        new = np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0))
        if (new[1:] & (hashes[1:] == hashes[:-1])).any():  # two keys share a hash: order them by the keys as well
            order = np.lexsort((*keys[::-1], hashes))
            keys, hashes, counts = keys[:, order], hashes[order], counts[order]
            new = np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0))
        at = np.flatnonzero(new)
        keys, hashes, counts = keys[:, at], hashes[at], np.add.reduceat(counts, at)
    return keys, hashes, counts


class Container:
    """A hash table kept in the order of its hashes. Arrays of new keys wait until they are as many as the table, then are worked in
    at once, so each key is moved a bounded number of times on average."""

    def __init__(self, width: int):
        self.table = np.zeros((width, 0), np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting, self.n_waiting = [], 0

    @property
    def entries(self) -> int:
        return len(self.table[1]) + self.n_waiting

    def add(self, keys, hashes, counts) -> None:
        self.waiting.append((keys, hashes, counts))
        self.n_waiting += len(hashes)
        if self.n_waiting > max(len(self.table[1]), 4096):
            self.settle()

    def settle(self) -> None:
        if self.waiting:
            parts = [self.table, *self.waiting]
            self.table = combined(np.concatenate([p[0] for p in parts], axis=1), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]))
            self.waiting, self.n_waiting = [], 0


class HatTrie:
    """Children by successive digits of the first word's id; a leaf is a container."""

    def __init__(self, width: int, max_entries: int = MAX_ENTRIES, burst: int = BURST):
        self.width, self.max_entries, self.burst = width, max_entries, burst
        self.root: list = [None] * (1 << DIGIT)

    def add(self, keys: np.ndarray):
        """Count keys, one per column. Yields the runs that had to be spilled to stay within ``max_entries``."""
        if keys.shape[1]:
            self._descend(self.root, 0, *combined(keys, key_hashes(keys), np.ones(keys.shape[1], np.int64)))
        sizes = [self._entries(child) for child in self.root]
        if sum(sizes) > self.max_entries:
            for i in np.argsort(sizes)[::-1]:
                yield self._spill(int(i))
                sizes[i] = 0
                if sum(sizes) <= self.max_entries // 2:
                    break

    def drain(self):
        """All that is left, one sorted run per subtree."""
        for i in range(len(self.root)):
            if self.root[i] is not None:
                yield self._spill(i)

    def _descend(self, node, depth, keys, hashes, counts):
        digit = ((keys[0] >> np.uint64(64 - DIGIT * (depth + 1))) & np.uint64((1 << DIGIT) - 1)).astype(np.uint8)
        order = np.argsort(digit, kind="stable")
        bounds = np.searchsorted(digit[order], np.arange((1 << DIGIT) + 1))
        for d in range(1 << DIGIT):
            mine = order[bounds[d]:bounds[d + 1]]
            if not len(mine):
                continue
            if node[d] is None:
                node[d] = Container(self.width)
            if isinstance(node[d], list):
                self._descend(node[d], depth + 1, keys[:, mine], hashes[mine], counts[mine])
                continue
            node[d].add(keys[:, mine], hashes[mine], counts[mine])
            if node[d].entries > self.burst and depth + 1 < DEPTH:
                node[d].settle()
                inner = [None] * (1 << DIGIT)
                self._descend(inner, depth + 1, *node[d].table)
                node[d] = inner

    def _entries(self, node) -> int:
        if node is None:
            return 0
        return sum(map(self._entries, node)) if isinstance(node, list) else node.entries

    def _leaves(self, node):
        if isinstance(node, list):
            for child in node:
                yield from self._leaves(child)
        elif node is not None:
            node.settle()
            yield node.table

    def _spill(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Take a subtree out as a run sorted by key."""
        parts = list(self._leaves(self.root[i]))
        self.root[i] = None
        keys, counts = np.concatenate([p[0] for p in parts], axis=1), np.concatenate([p[2] for p in parts])
        order = np.lexsort(keys[::-1])
        return keys[:, order], counts[order]
