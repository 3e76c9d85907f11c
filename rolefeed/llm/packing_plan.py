"""Which lengths go together: the configuration linear program of bin packing.

Works on the histogram of lengths alone, which has at most ``capacity`` entries however many
pieces there are. The program is about the long pieces; short ones fill the rooms that are left.
Neighbouring long lengths form classes, each as long as its longest. A configuration is a multiset
of classes that fits one sequence; the program covers every class's count with as few
configurations as possible. It is solved by multiplicative weights: a class's weight falls as it
gets covered, and the configuration of largest weight is found by knapsack dynamic programming. The
weights of every step, divided by that configuration's, are a solution of the dual program, so its
value is a lower bound; passes are averaged until the cover is within ``GAP`` of the best one.

The solution is rounded down to whole copies of configurations with real lengths. What is left, and
the short pieces, go best-fit into the rooms. Where that does not fill them, classes were too coarse
for the lengths at hand: then sequences with more than a certain room are taken apart again, and
their pieces go best-fit with the rest. Of these plans the one of fewest sequences holds.
"""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

import numpy as np

CLASSES = 128
SHORT = 16  # pieces up to this part of the capacity are short
EPSILON = 0.25
STEEPNESS = 3.0
GAP = 0.01
STEPS = 1200  # no new pass begins after so many
# Parts of the capacity that a rounded sequence may leave free, tried until a plan needs no more
# sequences than any must.
ROOMS = (1, 1 / 64, 1 / 256, 1 / 1024, 0)


class Filling(NamedTuple):
    """``copies`` sequences, each holding ``items``: (length, how many) pairs."""

    copies: int
    items: tuple[tuple[int, int], ...]


def best_configuration(lengths: np.ndarray, values: np.ndarray, limits: np.ndarray, capacity: int) -> dict[int, int]:
    """Classes of largest total value that fit, as index -> how many, at most ``limits`` of each.

    Bounded knapsack: a class's copies are split into powers of two, each taken or not.
    """
    best = np.zeros(capacity + 1)
    taken: list[tuple[int, int, np.ndarray]] = []
    for i in np.argsort(-values / lengths, kind="stable"):
        left = min(int(limits[i]), capacity // int(lengths[i]))
        part = 1
        while left > 0:
            k = min(part, left)
            left, part = left - k, part * 2
            size = k * int(lengths[i])
            other = best[:-size] + k * values[i]
            better = other > best[size:] + 1e-12
            best[size:] = np.where(better, other, best[size:])
            taken.append((int(i), k, better))
    room, chosen = int(np.argmax(best)), Counter()
    for i, k, better in reversed(taken):
        size = k * int(lengths[i])
        if room >= size and better[room - size]:
            chosen[i] += k
            room -= size
    return dict(chosen)


class Cover(NamedTuple):
    """A fractional solution: configurations (class, how many) and how often each is used."""

    uses: dict[tuple[tuple[int, int], ...], float]
    value: float  # sequences it needs
    bound: float  # that any solution needs


def fractional_cover(lengths: np.ndarray, counts: np.ndarray, capacity: int, epsilon: float = EPSILON,
                     gap: float = GAP, steps: int = STEPS) -> Cover:
    """Configurations that together cover ``counts`` exactly.

    Each step takes the configuration of largest weight and uses it until one of its classes has
    ``epsilon`` of its count more. A class's weight is its length, times ``exp`` of minus
    ``STEEPNESS`` for the share of its count that is covered, this pass and the ones before. A pass
    has at most ``len(lengths) * (1 + 1 / epsilon)`` steps.
    """
    uses: Counter = Counter()
    before, value, bound = np.zeros(len(lengths)), 0.0, 0.0
    done = step = 0
    while step < steps:
        covered = np.zeros(len(lengths))
        while True:
            left = counts - covered
            open_ = np.flatnonzero(left > 1e-6)
            if not len(open_):
                break
            share = (before + covered)[open_] / counts[open_]
            weights = lengths[open_] / capacity * np.exp(STEEPNESS * (share.min() - share))
            one = best_configuration(lengths[open_], weights, np.ceil(counts[open_]), capacity)
            # Weights scaled so that no configuration is worth more than one: a dual solution.
            bound = max(bound, float((counts[open_] * weights).sum() / sum(weights[i] * k for i, k in one.items())))
            chosen = {int(open_[i]): k for i, k in one.items()}
            use = min(min(max(counts[i] * epsilon, 1e-3), left[i]) / k for i, k in chosen.items())
            for i, k in chosen.items():
                covered[i] += use * k
            uses[tuple(sorted(chosen.items()))] += use
            step += 1
        before += covered
        done += 1
        value = sum(uses.values()) / done
        if value <= (1 + gap) * bound:
            break
    return Cover({key: use / done for key, use in uses.items()}, value, bound)


def _classes(histogram: dict[int, int], most: int) -> list[list[int]]:
    """Neighbouring lengths, about equally many tokens a class."""
    sizes = sorted(histogram)
    if len(sizes) <= most:
        return [[s] for s in sizes]
    weight = np.cumsum([s * histogram[s] for s in sizes], dtype=np.float64)
    place = np.minimum((weight / weight[-1] * most).astype(int), most - 1)
    out: dict[int, list[int]] = {}
    for size, i in zip(sizes, place):
        out.setdefault(int(i), []).append(size)
    return list(out.values())


def _take(pool: list[list[int]], k: int, copies: int) -> tuple[int, Counter]:
    """``k`` pieces of a class for each of some sequences: how many sequences they are alike in,
    at most ``copies``, and their lengths. ``pool``: [length, count], the longest last."""
    length, n = pool[-1]
    if n >= k:
        return min(copies, n // k), Counter({length: k})
    mixed, i = Counter(), len(pool) - 1
    while k:
        use = min(k, pool[i][1])
        if use:
            mixed[pool[i][0]] += use
        k, i = k - use, i - 1
    return 1, mixed


def _rounded(cover: Cover, classes: list[list[int]], left: dict[int, int], capacity: int) -> dict[tuple[int, tuple], int]:
    """Whole copies of the configurations, with lengths of their classes; takes them from ``left``.
    (room, items) -> number of sequences."""
    pools = [[[size, left[size]] for size in sizes] for sizes in classes]
    bins: dict[tuple[int, tuple], int] = {}
    for key, use in sorted(cover.uses.items(), key=lambda x: (-x[1], x[0])):
        wanted = int(use + 1e-9)
        wanted = min([wanted, *(sum(n for _, n in pools[c]) // k for c, k in key)])
        while wanted:
            taken = [_take(pools[c], k, wanted) for c, k in key]
            copies = min(n for n, _ in taken)
            items = Counter()
            for (c, _), (_, lengths) in zip(key, taken):
                for entry in pools[c]:
                    entry[1] -= copies * lengths.get(entry[0], 0)
                while pools[c] and not pools[c][-1][1]:
                    pools[c].pop()
                items.update(lengths)
            for length, k in items.items():
                left[length] -= copies * k
            room = capacity - sum(length * k for length, k in items.items())
            full = (room, tuple(sorted(items.items())))
            bins[full] = bins.get(full, 0) + copies
            wanted -= copies
    return bins


def _best_fit(bins: dict[tuple[int, tuple], int], left: dict[int, int], capacity: int) -> dict[tuple[int, tuple], int]:
    """Put what is left, longest first, where the least room remains.

    ``bins``: (room, items) -> number of such sequences. Equal sequences are treated at once.
    """
    by_room: list[Counter] = [Counter() for _ in range(capacity + 1)]
    some = np.zeros(capacity + 1, dtype=bool)

    def put(room, items, copies):
        by_room[room][items] += copies
        some[room] = True

    for (room, items), copies in bins.items():
        put(room, items, copies)
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            ahead = int(np.argmax(some[length:]))
            if not some[length + ahead]:
                fit = capacity // length
                full, rest = divmod(n, fit)
                if full:
                    put(capacity - fit * length, ((length, fit),), full)
                if rest:
                    put(capacity - rest * length, ((length, rest),), 1)
                break
            room = length + ahead
            items, copies = next(iter(by_room[room].items()))
            fit = min(room // length, n)
            use = min(copies, n // fit)
            by_room[room][items] -= use
            if not by_room[room][items]:
                del by_room[room][items]
                some[room] = bool(by_room[room])
            grown = Counter(dict(items))
            grown[length] += fit
            put(room - fit * length, tuple(sorted(grown.items())), use)
            n -= use * fit
    return {(room, items): c for room, group in enumerate(by_room) for items, c in group.items()}


def plan(histogram: dict[int, int], capacity: int, classes: int = CLASSES) -> list[Filling]:
    """Sequences for all pieces of a histogram (length -> count, lengths from 1 to ``capacity``)."""
    counts = {int(k): int(v) for k, v in histogram.items() if v}
    if not counts:
        return []
    groups = _classes({k: n for k, n in counts.items() if k > capacity // SHORT}, classes)
    cover = fractional_cover(
        np.array([g[-1] for g in groups], dtype=np.int64),
        np.array([sum(counts[s] for s in g) for g in groups], dtype=np.float64), capacity,
    )
    volume = -(-sum(k * n for k, n in counts.items()) // capacity)
    least = max(volume, int(np.ceil(cover.bound - 1e-6)))
    left = dict(counts)
    rounded = _rounded(cover, groups, left, capacity)
    best: dict[tuple[int, tuple], int] = {}
    for part in ROOMS:
        bins, rest = {}, Counter(left)
        for (room, items), copies in rounded.items():
            if room <= part * capacity:
                bins[room, items] = copies
            else:
                rest.update({length: k * copies for length, k in items})
        done = _best_fit(bins, {k: v for k, v in rest.items() if v}, capacity)
        if not best or sum(done.values()) < sum(best.values()):
            best = done
        if sum(best.values()) <= least:
            break
    return [Filling(copies, items) for (_, items), copies in sorted(best.items())]
