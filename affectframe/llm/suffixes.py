"""Suffix arrays by induced sorting, and permuted common prefixes, over byte arrays.

The steps are those of induced sorting: classify suffixes as smaller or larger than their
right neighbours, sort the substrings that start at leftmost smaller positions, sort these
suffixes by the names of their substrings, and induce all others from them in two linear
passes. A pass goes through the buckets of first bytes; within a bucket it takes a whole
wave of suffixes at a time, first those that other buckets have put there, then those that
the wave itself puts there, and so on. So each step is an array operation.
"""

from __future__ import annotations

import numpy as np


def smaller_types(t: np.ndarray) -> np.ndarray:
    """Whether the suffix at each place is smaller than the one that follows it."""
    n = len(t)
    types = np.zeros(n, bool)
    if n < 2:
        return types
    less = t[:-1] < t[1:]
    # A place in a run of equal bytes has the type of the run's last place.
    ends = np.flatnonzero(np.append(t[:-1] != t[1:], True))
    of_end = np.append(less, False)[ends]
    return np.repeat(of_end, np.diff(np.concatenate([[-1], ends])))


def _by_byte(places: np.ndarray, t: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Places grouped by their bytes, in the order they have."""
    if not len(places):
        return []
    keys = t[places]
    order = np.argsort(keys, kind="stable")
    keys, places = keys[order], places[order]
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return list(zip(keys[np.concatenate([[0], cuts])].tolist(), np.split(places, cuts)))


def induce(t: np.ndarray, smaller: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    """All suffixes in order, induced from the leftmost smaller ones in the order given."""
    present = np.flatnonzero(np.bincount(t, minlength=256)).tolist()
    none = np.zeros(0, np.int64)
    seeds = dict(_by_byte(leftmost, t))
    larger: dict[int, list] = {c: [] for c in present}
    less: dict[int, list] = {c: [] for c in present}
    larger[int(t[-1])].append(np.array([len(t) - 1]))  # what the empty suffix induces

    def before(wave: np.ndarray, kind: bool) -> np.ndarray:
        places = wave - 1
        places = places[places >= 0]
        return places[smaller[places] == kind]

    for c in present:
        waves, onward = [], []
        wave = np.concatenate(larger[c]) if larger[c] else none
        while len(wave):
            waves.append(wave)
            put = before(wave, False)
            here = t[put] == c
            onward.append(put[~here])
            wave = put[here]
        if c in seeds:
            onward.append(before(seeds[c], False))
        for byte, places in _by_byte(np.concatenate(onward), t) if onward else ():
            larger[byte].append(places)
        larger[c] = np.concatenate(waves) if waves else none
    for c in reversed(present):
        waves, onward = [], []
        wave = np.concatenate(less[c]) if less[c] else none
        while len(wave):
            waves.append(wave)
            put = before(wave, True)
            here = t[put] == c
            onward.append(put[~here])
            wave = put[here]
        onward.append(before(larger[c][::-1], True))
        for byte, places in _by_byte(np.concatenate(onward), t):
            less[byte].append(places)
        less[c] = np.concatenate(waves)[::-1] if waves else none
    return np.concatenate([part for c in present for part in (larger[c], less[c])])


def _names(t: np.ndarray, places: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Names, from 0, of the substrings at sorted places; equal substrings share a name."""
    sizes = following[places] - places
    new = np.ones(len(places), bool)
    at = np.flatnonzero(sizes[1:] == sizes[:-1])
    step = 0
    while len(at):
        a, b = places[at] + step, places[at + 1] + step
        inside = np.maximum(a, b) < len(t)  # the last substring ends with the text
        alike = inside & (t[np.minimum(a, len(t) - 1)] == t[np.minimum(b, len(t) - 1)])
        at, size = at[alike], sizes[at[alike]]
        new[at[size == step] + 1] = False
        at = at[size > step]
        step += 1
    return np.cumsum(new) - 1


def _sorted_names(names: np.ndarray) -> np.ndarray:
    """Places of a sequence of names, by the suffixes that start there.

    Pairs of neighbouring names are named in turn, then pairs of those, until all differ.
    """
    rank, width, n = names.astype(np.int64), 1, len(names)
    while True:
        behind = np.zeros(n, np.int64)
        behind[: max(0, n - width)] = rank[width:] + 1
        key = rank * (n + 1) + behind
        order = np.argsort(key, kind="stable")
        key = key[order]
        fresh = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        width *= 2


def suffix_array(t: np.ndarray) -> np.ndarray:
    """The places of all suffixes of a byte array, in the suffixes' order."""
    if len(t) < 2:
        return np.arange(len(t))
    smaller = smaller_types(t)
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if len(leftmost) > 1:
        is_leftmost = np.zeros(len(t), bool)
        is_leftmost[leftmost] = True
        following = np.zeros(len(t), np.int64)
        following[leftmost] = np.append(leftmost[1:], len(t))
        order = induce(t, smaller, leftmost)
        order = order[is_leftmost[order]]  # by their substrings
        names = _names(t, order, following)
        if names[-1] < len(leftmost) - 1:
            by_place = np.empty(len(t), np.int64)
            by_place[order] = names
            order = leftmost[_sorted_names(by_place[leftmost])]
        leftmost = order
    return induce(t, smaller, leftmost)


def common_prefixes(t: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place, the place of the suffix before it in order (-1 for the first), and
    how many bytes the two have in common.

    A common prefix is compared only where the bytes to the left differ; elsewhere it is
    one shorter than that of the place to the left.
    """
    n = len(t)
    former = np.empty(n, np.int64)
    former[order[0]] = -1
    former[order[1:]] = order[:-1]
    places = np.arange(n)
    left = (places > 0) & (former > 0)
    reducible = left.copy()
    reducible[left] = t[places[left] - 1] == t[former[left] - 1]
    at = np.flatnonzero(~reducible)
    padded = np.concatenate([t, np.zeros(8, np.uint8)])
    words = np.ndarray((n + 1,), "<u8", padded, strides=(1,))
    common = np.zeros(n, np.int64)
    live = at[former[at] >= 0]
    size = np.zeros(len(live), np.int64)
    while len(live):
        a, b = live + size, former[live] + size
        room = n - np.maximum(a, b)
        differ = words[np.minimum(a, n)] ^ words[np.minimum(b, n)]
        low = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)).astype(np.int64) // 8
        step = np.minimum(np.where(differ == 0, 8, low), room)
        size += step
        done = (step < 8) | (room <= 8)
        common[live[done]] = size[done]
        live, size = live[~done], size[~done]
    # The last compared place at or before each place.
    last = np.maximum.accumulate(np.where(reducible, 0, places))
    return former, np.maximum(common[last] - (places - last), 0)
