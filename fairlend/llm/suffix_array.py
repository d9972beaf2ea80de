"""Suffix arrays by induced sorting, and permuted common prefixes, as array operations.

``suffix_order`` classifies suffixes, sorts the leftmost-smaller substrings by
one induction, names them, sorts the string of names, and induces all suffixes
from that.  An induction goes through the buckets of first symbols once in
each direction; within a bucket, whatever is in place induces its predecessors
at once, so a step handles as many suffixes as a bucket holds.  A string of
names has too many buckets for that; it is sorted again by its own substrings,
twice as long each time.
"""

from __future__ import annotations

import numpy as np


def _types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one; the last symbol, the sentinel, is."""
    n = len(text)
    smaller = np.ones(n, bool)
    step = np.sign(np.diff(text.astype(np.int64)))
    where = np.where(step != 0, np.arange(n - 1), n)
    follow = np.minimum.accumulate(where[::-1])[::-1]  # the next place whose symbol differs from its successor
    known = follow < n
    smaller[:-1][known] = step[follow[known]] > 0
    return smaller


def _induce(text: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, size: int) -> np.ndarray:
    """All suffixes in order, from the leftmost-smaller ones in ``seeds`` order."""
    n = len(text)
    counts = np.bincount(text, minlength=size)
    ends = np.cumsum(counts)
    heads = ends - counts
    order = np.full(n, -1, np.int32)

    def place(at: np.ndarray, free: np.ndarray, sign: int) -> None:
        symbols = text[at]
        turn = np.argsort(symbols, kind="stable")
        at, symbols = at[turn], symbols[turn]
        new = np.ones(len(at), bool)
        new[1:] = symbols[1:] != symbols[:-1]
        first = np.flatnonzero(new)
        many = np.diff(np.append(first, len(at)))
        rank = np.arange(len(at)) - np.repeat(first, many)
        order[np.repeat(free[symbols[first]], many) + sign * rank] = at
        free[symbols[first]] += sign * many

    def sweep(symbol: int, wave: np.ndarray, free: np.ndarray, sign: int, kind: bool) -> np.ndarray:
        """Induce from ``wave`` until it adds nothing to its own bucket; gives all it added there."""
        added = [wave]
        while len(wave):
            before = wave[wave > 0] - 1
            before = before[smaller[before] == kind]
            own = text[before] == symbol
            other, wave = before[~own], before[own]
            if len(other):
                place(other, free, sign)
            added.append(wave)
        return np.concatenate(added)

    seed_symbols = text[seeds]
    by_symbol = np.argsort(seed_symbols, kind="stable")
    grouped = seeds[by_symbol]
    seed_ends = np.cumsum(np.bincount(seed_symbols, minlength=size))
    free = heads.copy()
    symbols = np.flatnonzero(counts)
    for c in symbols.tolist():
        # What is in the bucket now was induced by smaller buckets; it may add to the bucket itself.
        wave = order[heads[c]:free[c]].copy()
        if len(wave):
            larger = sweep(c, wave, free, 1, False)
            order[heads[c]:heads[c] + len(larger)] = larger
            free[c] = heads[c] + len(larger)
        seed = grouped[(seed_ends[c - 1] if c else 0):seed_ends[c]]
        if len(seed):
            before = seed[seed > 0] - 1
            before = before[~smaller[before]]
            if len(before):
                place(before, free, 1)
    larger_ends = free
    free = ends - 1
    for c in symbols[::-1].tolist():
        wave = order[free[c] + 1:ends[c]][::-1].copy()
        if len(wave):
            all_smaller = sweep(c, wave, free, -1, True)
            order[ends[c] - len(all_smaller):ends[c]] = all_smaller[::-1]
            free[c] = ends[c] - 1 - len(all_smaller)
        wave = order[heads[c]:larger_ends[c]][::-1]
        if len(wave):
            before = wave[wave > 0] - 1
            before = before[smaller[before]]
            if len(before):
                place(before, free, -1)
    order[0] = n - 1
    return order


def _doubled(names: np.ndarray) -> np.ndarray:
    """Ranks of the suffixes of ``names`` by prefixes of 1, 2, 4 ... names, until all differ."""
    rank = np.unique(names, return_inverse=True)[1].astype(np.int64)
    step = 1
    while rank.max(initial=-1) + 1 < len(rank):
        after = np.zeros(len(rank), np.int64)
        after[:-step] = rank[step:] + 1 if step < len(rank) else 0
        rank = np.unique(rank * (len(rank) + 1) + after, return_inverse=True)[1].astype(np.int64)
        step *= 2
        if step >= 2 * len(rank):
            break
    return rank


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffix array of ``text``, whose last symbol is 0 and occurs nowhere else."""
    n = len(text)
    if n <= 1:
        return np.arange(n, dtype=np.int32)
    size = int(text.max()) + 1
    smaller = _types(text)
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    order = _induce(text, smaller, leftmost, size)
    # The leftmost-smaller substrings stand in order now; equal ones get one name.
    is_left = np.zeros(n, bool)
    is_left[leftmost] = True
    ranked = order[is_left[order]].astype(np.int64)
    following = np.zeros(n, np.int64)
    following[leftmost] = np.append(leftmost[1:], n - 1)
    length = following[ranked] - ranked + 1
    fresh = np.ones(len(ranked), bool)
    a, b = ranked[:-1], ranked[1:]
    pairs = np.flatnonzero(length[1:] == length[:-1])
    differ = np.zeros(len(pairs), bool)
    live, k = np.arange(len(pairs)), 0
    while len(live):
        live = live[k < length[pairs[live]]]
        new = text[a[pairs[live]] + k] != text[b[pairs[live]] + k]
        differ[live[new]] = True
        live = live[~new]
        k += 1
    fresh[1:][pairs[~differ]] = False
    if not fresh.all():
        name = np.zeros(n, np.int64)
        name[ranked] = np.cumsum(fresh)
        ranked = leftmost[np.argsort(_doubled(name[leftmost]), kind="stable")]
    return _induce(text, smaller, ranked, size)


def common_prefixes(text: np.ndarray, order: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(length, before): for each position the common prefix with the suffix before it in ``order``.

    ``left`` bounds the prefix of each position (symbols up to its part's
    end).  A prefix one place on is one shorter where the symbols before agree,
    so only the other places are compared.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    real = before >= 0
    most = np.where(real, np.minimum(left, left[np.maximum(before, 0)]), 0)
    follows = np.zeros(n, bool)
    follows[1:] = (before[1:] > 0) & (text[:-1] == text[before[1:] - 1]) & (most[:-1] > 0)
    fresh = np.flatnonzero(~follows)
    length = np.zeros(n, np.int64)
    live, k = fresh[most[fresh] > 0], 0
    while len(live):
        live = live[text[live + k] == text[before[live] + k]]
        k += 1
        length[live] = k
        live = live[most[live] > k]
    owner = np.maximum.accumulate(np.where(follows, 0, np.arange(n)))
    return np.maximum(length[owner] - (np.arange(n) - owner), 0), before
