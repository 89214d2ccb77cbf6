"""Pack a histogram of lengths into sequences: linear grouping of the large lengths, best fit for the small ones.

Everything here works on how many pieces have each length, never on pieces: cost and result size depend on the capacity, not on the data.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np

GROUPS = 64         # large lengths are rounded up to so many sizes
LARGE = 8           # large: more than 1 / LARGE of the capacity
SLACKS = (64, 16, 4, 1)   # sequences with more room than this may be opened again, see reopened()
MAX_PIVOTS = 4000   # column generation stops here at the latest; any basis it holds is a right one


@dataclass
class Bins:
    """``times`` sequences that all hold the same lengths, in this order: (length, how often in a row)."""
    content: tuple[tuple[int, int], ...]
    times: int


def equal_groups(counts: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Runs of (length, count) from the greatest length down, cut so that all groups hold equally many pieces (the last may hold fewer)."""
    size = max(1, -(-sum(counts.values()) // groups))
    out, room = [], 0
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            if not room:
                out.append([])
                room = size
            take = min(n, room)
            out[-1].append((length, take))
            n -= take
            room -= take
    return out


def best_configuration(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """How often to take each size so that the sum of values is greatest (unbounded knapsack)."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    for i, (s, v) in enumerate(zip(sizes, values)):
        if v <= 0:
            continue
        for _ in range(capacity // s):
            better = best[:-s] + v > best[s:] + 1e-12
            if not better.any():
                break
            gain = best[:-s][better] + v
            at = np.flatnonzero(better) + s
            best[at], choice[at] = gain, i
    return float(best[-1]), _unwind(best, choice, sizes, values, capacity)


def _unwind(best, choice, sizes, values, capacity):
    taken = np.zeros(len(sizes), np.int64)
    w = capacity
    while w > 0:
        i = choice[w]
        if i >= 0 and w >= sizes[i] and abs(best[w - sizes[i]] + values[i] - best[w]) < 1e-9:
            taken[i] += 1
            w -= sizes[i]
        elif best[w - 1] >= best[w] - 1e-12:
            w -= 1
        else:  # a cell was improved after its choice had been used: try every size
            fits = [j for j in range(len(sizes)) if sizes[j] <= w and values[j] > 0 and abs(best[w - sizes[j]] + values[j] - best[w]) < 1e-9]
            if not fits:
                break
            taken[fits[0]] += 1
            w -= sizes[fits[0]]
    return taken


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """The fractional optimum of the cutting-stock problem of a few sizes, by column generation: (configuration, how often)."""
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(MAX_PIVOTS):
        prices = np.linalg.solve(basis.T, np.ones(k))
        value, column = best_configuration(sizes, prices, capacity)
        if value <= 1 + 1e-9 or float(prices @ column) <= 1 + 1e-9:
            break
        often = np.linalg.solve(basis, demand)
        step = np.linalg.solve(basis, column.astype(float))
        ratio = np.where(step > 1e-9, np.maximum(often, 0) / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    often = np.maximum(np.linalg.solve(basis, demand), 0)
    return [(basis[:, j].astype(np.int64), float(often[j])) for j in range(k)]


class Run:
    """Takes pieces of one group in order, as runs of equal length."""

    def __init__(self, runs):
        self.runs = [list(r) for r in reversed(runs)]
        self.left = sum(n for _, n in runs)

    def take(self, n: int) -> list[tuple[int, int]]:
        out = []
        self.left -= n
        while n:
            length, have = self.runs[-1]
            part = min(n, have)
            out.append((length, part))
            n -= part
            if part == have:
                self.runs.pop()
            else:
                self.runs[-1][1] = have - part
        return out


def substitute(column: np.ndarray, times: int, groups: list[Run]) -> list[tuple[list[int], int]]:
    """Real lengths for ``times`` copies of a configuration: (lengths, how many sequences have just these)."""
    slots = [groups[g].take(times) for g in np.flatnonzero(column) for _ in range(int(column[g]))]
    at, used, out = [0] * len(slots), [0] * len(slots), []
    while times:
        n = min(times, *(slots[i][at[i]][1] - used[i] for i in range(len(slots))))
        out.append(([slots[i][at[i]][0] for i in range(len(slots))], n))
        times -= n
        for i in range(len(slots)):
            used[i] += n
            if used[i] == slots[i][at[i]][1]:
                at[i], used[i] = at[i] + 1, 0
    return out


def best_fit(open_bins: list[tuple[list[int], int]], rest: dict[int, int], capacity: int) -> list[Bins]:
    """Put the rest, from the greatest length down, where it leaves the least room; open new sequences where nothing fits."""
    by_room: dict[int, list[tuple[tuple, int]]] = defaultdict(list)
    merged: dict[tuple, int] = defaultdict(int)
    for lengths, n in open_bins:
        merged[tuple((length, lengths.count(length)) for length in sorted(set(lengths), reverse=True))] += n
    for content, n in merged.items():
        by_room[capacity - sum(a * b for a, b in content)].append((content, n))
    present = np.zeros(capacity + 1, bool)
    present[[r for r in by_room]] = True

    def put(room, content, n):
        if n:
            by_room[room].append((content, n))
            present[room] = True

    for length in sorted(rest, reverse=True):
        n = rest[length]
        while n:
            fitting = np.flatnonzero(present[length:])
            if not len(fitting):
                each = capacity // length
                full, over = divmod(n, each)
                put(capacity - each * length, ((length, each),), full)
                put(capacity - over * length, ((length, over),), 1 if over else 0)
                break
            room = int(fitting[0]) + length
            content, times = by_room[room].pop()
            present[room] = bool(by_room[room])
            each = room // length
            full = min(times, n // each)
            n -= full * each
            put(room - each * length, content + ((length, each),), full)
            if full < times:
                if n:
                    put(room - n * length, content + ((length, n),), 1)
                    put(room, content, times - full - 1)
                    n = 0
                else:
                    put(room, content, times - full)
    return [Bins(content, n) for room in by_room.values() for content, n in room]


def reopened(filled: list[tuple[list[int], int]], rest: dict[int, int], capacity: int, slack: int) -> list[Bins]:
    """Rounding up leaves room that small pieces may be too few to fill: empty sequences with more room than ``slack``, then best fit."""
    kept, again = [], defaultdict(int, rest)
    for lengths, n in filled:
        if capacity - sum(lengths) <= slack:
            kept.append((lengths, n))
        else:
            for length in lengths:
                again[length] += n
    return best_fit(kept, again, capacity)


def pack_lengths(counts: dict[int, int], capacity: int, groups: int = GROUPS) -> list[Bins]:
    """Bins that hold counts[length] pieces of every length, each bin at most ``capacity`` in all.

    Large lengths are cut into groups of equal cardinality and rounded up to the greatest of the group; configurations of these few
    sizes are optimised as fractions and rounded down; real lengths take the slots; what is left over and everything small
    follows by best fit. Of the settings of reopened(), the one with the fewest sequences is taken. No lengths: no bins. Lengths outside 1..capacity raise ValueError.
    """
    counts = {int(k): int(v) for k, v in counts.items() if v}
    if any(not 1 <= length <= capacity for length in counts):
        raise ValueError(f"lengths must lie in 1..{capacity}")
    large = {k: v for k, v in counts.items() if k * LARGE > capacity}
    rest = defaultdict(int, {k: v for k, v in counts.items() if k not in large})
    filled: list[tuple[list[int], int]] = []
    if large:
        parts: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for group in equal_groups(large, groups):  # groups with the same greatest length are one size
            parts[group[0][0]] += group
        sizes = np.array(sorted(parts, reverse=True))
        runs = [Run(parts[s]) for s in sizes]
        demand = np.array([r.left for r in runs], float)
        for column, often in sorted(configurations(sizes, demand, capacity), key=lambda c: -c[1]):
            times = int(min([int(often + 1e-9), *(runs[g].left // int(column[g]) for g in np.flatnonzero(column))]))
            if times > 0:
                filled += substitute(column, times, runs)
        for run in runs:
            for length, n in run.take(run.left):
                rest[length] += n
    tried = [best_fit(filled, rest, capacity), *(reopened(filled, rest, capacity, s) for s in SLACKS)]
    return min(tried, key=lambda bins: sum(b.times for b in bins))
