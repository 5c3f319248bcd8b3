"""Suffix arrays by induced sorting, and common prefixes in text order, with numpy.

Suffixes are classified by whether they are smaller or larger than the next; the leftmost
smaller ones are put in order by naming their substrings and, where names repeat, by the
suffix array of the names; all others are induced from them. The two linear scans work
bucket by bucket: what a bucket's entries induce into later buckets is written at once, and
what they induce into their own bucket is the next wave of the same bucket.
"""

from __future__ import annotations

import numpy as np

# Beyond so many distinct symbols, or short of so many for each, buckets are too small to
# work on one by one, and the names are sorted by doubling instead.
MOST_BUCKETS = 1 << 14
LEAST_PER_BUCKET = 16


def _classify(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one. The last, a sentinel, is."""
    n = len(s)
    differs = np.flatnonzero(s[:-1] != s[1:])
    following = differs[np.searchsorted(differs, np.arange(n - 1))]
    smaller = np.ones(n, bool)
    smaller[:-1] = s[following] < s[following + 1]
    return smaller


def _scan(s, sa, places, smaller, order, seeds, down: bool) -> None:
    """One induced scan. ``places`` is the next free place of each bucket in the direction of
    the scan, ``seeds`` the entries already known in each bucket, which come after the
    induced ones of the same bucket."""
    step = -1 if down else 1
    wanted = down

    def induce(entries: np.ndarray, own: int) -> np.ndarray:
        before = entries[entries > 0] - 1
        before = before[smaller[before] == wanted]
        if not len(before):
            return before
        symbol = s[before]
        same = symbol == own
        other, target = before[~same], symbol[~same]
        if len(other):
            by = np.argsort(target, kind="stable")
            target = target[by]
            edge = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
            size = np.diff(np.append(edge, len(target)))
            rank = np.arange(len(target)) - np.repeat(edge, size)
            sa[places[target] + step * rank] = other[by]
            places[target[edge]] += step * size
        return before[same]

    for c, begin in order:
        done = begin
        while True:
            found = sa[done : places[c]] if not down else sa[places[c] + 1 : done + 1][::-1]
            if not len(found):
                break
            done = places[c].item()
            more = induce(found.copy(), c)
            if len(more):
                at = places[c] + step * np.arange(len(more))
                sa[at] = more
                places[c] += step * len(more)
        known = seeds(c)
        if len(known):
            induce(known, c)


def _induce(s: np.ndarray, smaller: np.ndarray, leftmost: np.ndarray, sigma: int) -> np.ndarray:
    """The suffix array that follows from the leftmost smaller suffixes in this order."""
    n = len(s)
    counts = np.bincount(s, minlength=sigma)
    tails = np.cumsum(counts)
    heads = tails - counts
    present = np.flatnonzero(counts).tolist()
    first_by = np.argsort(s[leftmost], kind="stable")
    seeds = leftmost[first_by]
    seed_edge = np.searchsorted(s[seeds], np.arange(sigma + 1))
    sa = np.full(n, -1, np.int64)
    places = heads.copy()
    _scan(
        s, sa, places, smaller, [(c, int(heads[c])) for c in present],
        lambda c: seeds[seed_edge[c] : seed_edge[c + 1]], down=False,
    )
    # Where each bucket's larger suffixes end.
    larger_end = places
    places = tails - 1
    if s[-1] == 0:
        # The sentinel has nothing before it in its bucket.
        sa[0] = n - 1
        places[0] = -1
    _scan(
        s, sa, places, smaller, [(c, int(tails[c]) - 1) for c in reversed(present) if c],
        lambda c: sa[heads[c] : larger_end[c]][::-1].copy(), down=True,
    )
    return sa


def _same_spans(s: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    same = np.ones(len(a), bool)
    active = np.arange(len(a))
    k = 0
    while len(active):
        active = active[length[active] > k]
        equal = s[a[active] + k] == s[b[active] + k]
        same[active[~equal]] = False
        active = active[equal]
        k += 1
    return same


def _sorted_keys(key: np.ndarray) -> np.ndarray:
    # Equal keys keep one place, so their order does not matter.
    return np.argsort(key)


def _by_doubling(names: np.ndarray) -> np.ndarray:
    """The suffix array by doubling the symbols compared. A suffix keeps the place of the first
    of those it still equals, and only suffixes with equals are sorted again."""
    n = len(names)
    rank = np.zeros(n, np.int64)
    active, width = np.arange(n), 0
    # At first the names themselves are sorted, then what follows.
    key = names.astype(np.int64)
    while len(active):
        order = _sorted_keys(key)
        active, key = active[order], key[order]
        before, at = rank[active], np.arange(len(active))
        group = np.concatenate([[True], before[1:] != before[:-1]])
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        first = np.maximum.accumulate(np.where(fresh, at, 0))
        rank[active] = before + first - np.maximum.accumulate(np.where(group, at, 0))
        alone = fresh & np.append(fresh[1:], True)
        active = active[~alone]
        width = max(1, width * 2)
        after = np.zeros(len(active), np.int64)
        inside = active + width < n
        after[inside] = rank[active[inside] + width] + 1
        key = rank[active] * (n + 1) + after
    in_order = np.empty(n, np.int64)
    in_order[rank] = np.arange(n)
    return in_order


def suffix_array(s: np.ndarray, sigma: int) -> np.ndarray:
    """Positions of all suffixes in order. ``s`` ends with the only 0, its least symbol."""
    n = len(s)
    if n < 3:
        return np.arange(n)[::-1].copy()
    smaller = _classify(s)
    is_leftmost = smaller.copy()
    is_leftmost[0] = False
    is_leftmost[1:] &= ~smaller[:-1]
    leftmost = np.flatnonzero(is_leftmost)
    sa = _induce(s, smaller, leftmost, sigma)
    in_order = sa[is_leftmost[sa]]
    ends = np.append(leftmost[1:] + 1, n)
    length = np.zeros(n, np.int64)
    length[leftmost] = ends - leftmost
    a, b = in_order[:-1], in_order[1:]
    same = length[a] == length[b]
    same[same] = _same_spans(s, a[same], b[same], length[a[same]])
    name = np.concatenate([[0], np.cumsum(~same)])
    kinds = int(name[-1]) + 1
    if kinds < len(leftmost):
        names = np.zeros(n, np.int64)
        names[in_order] = name
        reduced = names[leftmost]
        few = kinds <= MOST_BUCKETS and len(reduced) >= LEAST_PER_BUCKET * kinds
        symbols = reduced.astype(np.uint16) if few else reduced
        in_order = leftmost[suffix_array(symbols, kinds) if few else _by_doubling(reduced)]
    return _induce(s, smaller, in_order, sigma)


def common_prefixes(s: np.ndarray, sa: np.ndarray, stop: int) -> np.ndarray:
    """For each position of a text of 16-bit symbols, the length of the prefix its suffix shares with the one before it
    in the suffix array, up to the first symbol of at most ``stop``.

    Where the symbols before two neighbours agree, the length is one less than that of the
    position before; only the others are compared symbol by symbol.
    """
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    left = np.where(before > 0, before, 1) - 1
    reducible = np.zeros(n, bool)
    reducible[1:] = (before[1:] > 0) & (s[:-1] == s[left[1:]]) & (s[:-1] > stop)
    fixed = np.flatnonzero(~reducible)
    value = np.zeros(n, np.int64)
    active = fixed[before[fixed] >= 0]
    at, to = active.copy(), before[active]
    # Four symbols at a time while they agree, the rest one by one.
    four = np.zeros(n, np.uint64)
    going = s > stop
    all_going = going.copy()
    for k in range(4):
        four[: max(n - k, 0)] |= s[k:].astype(np.uint64) << np.uint64(16 * k)
        all_going[: max(n - k, 0)] &= going[k:]
    all_going[max(n - 3, 0) :] = False
    rest = []
    while len(active):
        equal = (four[at] == four[to]) & all_going[at]
        rest.append((active[~equal], at[~equal], to[~equal]))
        active, at, to = active[equal], at[equal] + 4, to[equal] + 4
        value[active] += 4
    if rest:
        active, at, to = (np.concatenate(x) for x in zip(*rest))
    while len(active):
        equal = (s[at] == s[to]) & going[at]
        active, at, to = active[equal], at[equal] + 1, to[equal] + 1
        value[active] += 1
    source = np.maximum.accumulate(np.where(reducible, 0, np.arange(n)))
    return np.maximum(value[source] - (np.arange(n) - source), 0)
