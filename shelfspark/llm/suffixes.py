"""Suffix arrays by induced sorting and permuted common prefixes, on numpy arrays of one shard."""

from __future__ import annotations

import numpy as np

# Above this alphabet (reduced strings of the recursion) buckets are too many to be worked one numpy call each.
_WIDE = 1024
# Positions whose common prefixes are compared at once.
_AT_ONCE = 1 << 15


def _types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the end of the text is the smallest suffix."""
    change = np.flatnonzero(s[1:] != s[:-1])
    small = np.zeros(len(s), bool)
    if len(change):
        begin = np.r_[0, change + 1]
        rising = np.r_[s[change] < s[change + 1], False]
        small = np.repeat(rising, np.diff(np.r_[begin, len(s)]))
    return small


def _induce(s: np.ndarray, small: np.ndarray, seeds: np.ndarray, letters: int) -> np.ndarray:
    """Order all suffixes from the leftmost-smaller ones, ``seeds``, whose order in a bucket is given."""
    count = np.bincount(s, minlength=letters)
    end = np.cumsum(count)
    start = end - count
    if letters > _WIDE:
        return _induce_wide(s, small, seeds, start, end)
    sa = np.full(len(s), -1)
    by_letter = np.split(seeds[np.argsort(s[seeds], kind="stable")], np.cumsum(np.bincount(s[seeds], minlength=letters))[:-1])
    head, tail = start.copy(), end.copy()

    def place(suffixes: np.ndarray, smaller: bool) -> None:
        before = suffixes - 1
        before = before[before >= 0]
        before = before[small[before] == smaller]
        if not len(before):
            return
        letter = s[before]
        order = np.argsort(letter, kind="stable")
        before, letter = before[order], letter[order]
        n = np.bincount(letter, minlength=letters)
        rank = np.arange(len(letter)) - (np.cumsum(n) - n)[letter]
        if smaller:
            sa[tail[letter] - 1 - rank] = before
            tail[:] -= n
        else:
            sa[head[letter] + rank] = before
            head[:] += n

    place(np.array([len(s)]), False)  # the end of the text comes first and induces the last suffix
    for c in range(letters):
        done = start[c]
        while done < head[c]:
            part, done = sa[done:head[c]].copy(), head[c]
            place(part, False)
        if len(by_letter[c]):
            place(by_letter[c], False)
    for c in range(letters - 1, -1, -1):
        done = end[c]
        while done > tail[c]:
            part, done = sa[tail[c]:done][::-1].copy(), tail[c]
            place(part, True)
        place(sa[start[c]:head[c]][::-1].copy(), True)
    return sa


def _induce_wide(s, small, seeds, start, end) -> np.ndarray:
    n = len(s)
    # The letter in front of a suffix if that suffix is of the wanted kind, else -1; also for the filler -1.
    front = np.r_[-1, s[:-1], -1]
    kind = np.r_[False, small[:-1], False]
    larger, smaller = np.where(kind, -1, front).tolist(), np.where(kind, front, -1).tolist()
    sa = [-1] * n
    tail, text = end.tolist(), s[seeds].tolist()
    for i, c in zip(reversed(seeds.tolist()), reversed(text)):
        tail[c] -= 1
        sa[tail[c]] = i
    head = start.tolist()
    if not small[-1]:
        c = int(s[-1])
        sa[head[c]] = n - 1
        head[c] += 1
    # Both loops read places that they have filled before.
    for i in sa:
        c = larger[i]
        if c >= 0:
            at = head[c]
            sa[at] = i - 1
            head[c] = at + 1
    tail = end.tolist()
    for i in reversed(sa):
        c = smaller[i]
        if c >= 0:
            at = tail[c] = tail[c] - 1
            sa[at] = i - 1
    return np.array(sa)


def suffix_array(s: np.ndarray, letters: int) -> np.ndarray:
    """Start positions of all suffixes in order; ``s`` holds integers below ``letters``."""
    s = np.asarray(s, np.int64)
    if len(s) < 2:
        return np.arange(len(s))
    small = _types(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if not len(lms):
        return _induce(s, small, lms, letters)
    marked = np.zeros(len(s), bool)
    marked[lms] = True
    order = _induce(s, small, lms, letters)
    order = order[marked[order]]
    # Equal leftmost-smaller substrings get one name.
    rank = np.empty(len(s), np.int64)
    rank[lms] = np.arange(len(lms))
    size = np.diff(np.r_[lms, len(s)])[rank[order]] + 1
    differ = size[1:] != size[:-1]
    at = np.flatnonzero(~differ)
    depth = 0
    while len(at):
        a, b = order[at] + depth, order[at + 1] + depth
        inside = np.maximum(a, b) < len(s)
        equal = inside & (s[np.minimum(a, len(s) - 1)] == s[np.minimum(b, len(s) - 1)])
        differ[at[~equal]] = True
        depth += 1
        at = at[equal & (depth < size[at])]
    names = np.empty(len(lms), np.int64)
    names[rank[order]] = np.r_[0, np.cumsum(differ)]
    if differ.all():
        ranked = order
    else:
        ranked = lms[suffix_array(names, int(names.max()) + 1)]
    return _induce(s, small, ranked, letters)


def permuted_lcp(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each position the common prefix with the suffix just before it in the suffix array.

    A value follows from the position before it unless the letters in front differ; only those
    irreducible values are compared letter by letter.
    """
    n = len(s)
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    position = np.arange(n)
    front = np.where((position > 0) & (before > 0), before - 1, 0)
    irreducible = (position == 0) | (before <= 0) | (s[np.maximum(position - 1, 0)] != s[front])
    at = np.flatnonzero(irreducible & (before >= 0))
    value = np.zeros(n, np.int64)
    padded = np.r_[np.asarray(s, np.int16), np.full(16, -1, np.int16)]
    step = np.arange(16)
    for begin in range(0, len(at), _AT_ONCE):
        open_at = at[begin:begin + _AT_ONCE]
        left, right = open_at.copy(), before[open_at]
        while len(open_at):
            same = padded[np.minimum(left, n)[:, None] + step] == padded[np.minimum(right, n)[:, None] + step]
            grown = np.where(same.all(axis=1), 16, same.argmin(axis=1))
            value[open_at] += grown
            more = grown == 16
            open_at, left, right = open_at[more], left[more] + 16, right[more] + 16
    known = np.where(irreducible, value + position, -1)
    return np.maximum(np.maximum.accumulate(known) - position, 0)
