"""Runs of repeated words in listing texts, as maximal pairs of an LCP-interval tree."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import listing_texts

LEAST = 6
EXPONENT = 4
# Words whose suffixes are sorted together; texts are never cut, so a longer one is sorted alone.
_CHUNK = 1 << 19
NO_MORE = 1 << 62
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BITS = 21


def shortest_match(least: int, exponent: int) -> int:
    """Words that the two parts of any wanted maximal pair have in common at least."""
    return min(max(least - d, (exponent - 1) * d) for d in range(1, least + 1))


def _repeated(codes: np.ndarray, doc: np.ndarray, grams: int) -> np.ndarray:
    """Positions whose next ``grams`` words occur again in the same text (digests: a few more may come along)."""
    n = len(codes) - grams + 1
    if n < 2:
        return np.zeros(0, np.int64)
    digest = doc[:n].astype(np.uint64)
    whole = doc[:n] == doc[grams - 1:]
    for k in range(grams):
        digest = (digest ^ codes[k:k + n].astype(np.uint64)) * _MIX
        digest ^= digest >> np.uint64(29)
    at = np.flatnonzero(whole & (codes[grams - 1:] > 0))
    if len(at) < 2:
        return at[:0]
    order = at[np.argsort(digest[at], kind="stable")]
    same = digest[order][1:] == digest[order][:-1]
    return np.sort(order[np.r_[False, same] | np.r_[same, False]])


def suffix_intervals(codes: np.ndarray, doc: np.ndarray, grams: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes that share ``grams`` words or more with another of their text, sorted, and common prefixes with the one before.

    ``codes`` holds a zero behind each text; prefixes are counted in words and end with the text.
    A common prefix under ``grams`` words, or with another text, is given as 0.
    """
    start = _repeated(codes, doc, grams)
    n = len(codes)
    wide = np.r_[codes, np.zeros(grams, codes.dtype)]
    doc = np.r_[doc, np.full(grams, -1)]
    # Matches end where a text goes on after `grams` known words, so these positions need a place in the order too.
    kept = np.zeros(n + grams, bool)
    kept[start] = True
    kept[start + grams] = True
    pos = np.flatnonzero(kept)
    keys = [doc[pos]]
    for k in range(0, grams, 3):
        key = np.zeros(len(pos), np.int64)
        for j in range(k, min(k + 3, grams)):
            key = key << _BITS | wide[np.minimum(pos + j, n + grams - 1)]
        keys.append(key)
    order = np.lexsort(keys[::-1])
    new = np.ones(len(pos), bool)
    new[1:] = False
    for key in keys:
        key = key[order]
        new[1:] |= key[1:] != key[:-1]
    slot = np.full(n + grams + 1, -1, np.int64)
    slot[pos] = np.arange(len(pos))
    rank = np.empty(len(pos), np.int64)
    heads = np.flatnonzero(new)
    rank[order] = np.repeat(heads, np.diff(np.r_[heads, len(pos)]))
    levels, width = [rank], grams
    while True:
        size = np.diff(np.r_[heads, len(pos)])
        busy = np.flatnonzero(np.repeat(size > 1, size))
        if not len(busy):
            break
        member = order[busy]
        after = slot[np.minimum(pos[member] + width, n + grams)]
        key = np.where(after >= 0, rank[after], -1 - member)
        by = np.lexsort((key, rank[member]))
        order[busy] = member[by]
        group, key = rank[member[by]], key[by]
        split = np.zeros(len(busy), bool)
        split[1:] = (group[1:] == group[:-1]) & (key[1:] != key[:-1])
        new[busy[split]] = True
        heads = np.flatnonzero(new)
        rank = np.empty(len(pos), np.int64)
        rank[order] = np.repeat(heads, np.diff(np.r_[heads, len(pos)]))
        levels.append(rank)
        width *= 2
    sa = pos[order]
    a, b = np.r_[0, sa[:-1]], sa
    common = np.zeros(len(sa), np.int64)
    live = np.zeros(len(sa), bool)
    live[1:] = levels[0][order[1:]] == levels[0][order[:-1]]
    for k in range(len(levels) - 1, -1, -1):
        x, y = slot[np.minimum(a + common, n + grams)], slot[np.minimum(b + common, n + grams)]
        common[live & (x >= 0) & (y >= 0) & (levels[k][x] == levels[k][y])] += grams << k
    going = live.copy()
    for _ in range(grams - 1):
        x, y = np.minimum(a + common, n + grams - 1), np.minimum(b + common, n + grams - 1)
        going &= (wide[x] == wide[y]) & (wide[x] > 0)
        common[going] += 1
    return sa, common


def maximal_pairs(sa: list[int], common: list[int], left: list[int], least: int, exponent: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, from the LCP-interval tree of the sorted suffixes, bottom up.

    A node keeps its positions in text order, each in the class of the word on its left.  When
    children join in a node of ``common`` words, a position p of one and q of another with
    different classes are a maximal pair; it is a run of period q - p if the pair shares
    (exponent - 1) periods.  Were there a position of the node between the two, or a shorter
    period, p and p + that period would have met in a child; so only neighbours in text order
    can be such pairs, each run is met once, and with its smallest period.
    """
    reach = exponent - 1
    nodes: list[list] = []  # open intervals: common words, positions of the children closed so far

    def join(node, child, words):
        few, many = (child, node) if len(child) <= len(node) else (node, child)
        limit, size = words // reach, len(many)
        before = -1
        for q, behind in zip(few, few[1:] + [NO_MORE]):
            at = bisect_left(many, q)
            if at and (p := many[at - 1]) > before and q - p <= limit and left[p] != left[q] and q - p + words >= least:
                found.append((p, q - p + words, q - p))
            if at < size and (p := many[at]) < behind and p - q <= limit and left[p] != left[q] and p - q + words >= least:
                found.append((q, p - q + words, p - q))
            before = q
        if len(few) * 8 < size:
            for q in few:
                insort(many, q)
        else:
            many.extend(few)
            many.sort()
        return many

    found: list[tuple[int, int, int]] = []
    child: list[int] = []
    for at, words in zip(sa, common):
        while nodes and nodes[-1][0] > words:
            top = nodes.pop()
            child = join(top[1], child, top[0])
        if nodes and nodes[-1][0] == words:
            nodes[-1][1] = join(nodes[-1][1], child, words)
        elif words:
            nodes.append([words, child])
        child = [at]
    while nodes:
        top = nodes.pop()
        child = join(top[1], child, top[0])
    return found


def _find_runs(least: int, exponent: int):
    grams = shortest_match(least, exponent)

    def search(ids, texts):
        fresh = count(1)
        code = defaultdict(fresh.__next__)
        parts, sizes = [], []
        for words in texts:
            parts.append(np.fromiter(map(code.__getitem__, words), np.int64, len(words)))
            parts.append(np.zeros(1, np.int64))
            sizes.append(len(words) + 1)
        codes, ends = np.concatenate(parts), np.cumsum(sizes)
        doc = np.repeat(np.arange(len(texts)), sizes)
        sa, common = suffix_intervals(codes, doc, grams)
        runs = defaultdict(list)
        if common.any():
            left = np.r_[0, codes[:-1]].tolist()
            for start, length, period in maximal_pairs(sa.tolist(), common.tolist(), left, least, exponent):
                owner = int(doc[start])
                runs[owner].append((start - int(ends[owner]) + sizes[owner], length, period))
        out = {"n": [], "start": [], "length": [], "period": [], "milli": [], "runs": [], "collapsed": []}
        for at, words in enumerate(texts):
            own = sorted(runs.get(at, ()), key=lambda r: (r[0], r[2]))
            best = (None, None, None)
            if own:
                best = max(own, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
                drop = np.zeros(len(words) + 1, np.int64)
                for start, length, period in own:
                    drop[start + period] += 1
                    drop[start + length] -= 1
                words = [words[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()]
            out["n"].append(len(own))
            for name, value in zip(("start", "length", "period"), best):
                out[name].append(value)
            out["milli"].append(1000 * best[1] // best[2] if own else None)
            out["runs"].append([{"start": s, "length": n, "period": p} for s, n, p in own])
            out["collapsed"].append(b" ".join(words))
        run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays(ids)] + [pa.array(out[c], pa.int64()) for c in ("n", "start", "length", "period", "milli")]
            + [pa.array(out["runs"], pa.list_(run)), pa.array(out["collapsed"], pa.string())],
            ["key", "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in batches:
            begin = 0
            for at, text in enumerate(batch.column(1)):
                texts.append(text.as_py().encode().split())
                size += len(texts[-1])
                if size >= _CHUNK:
                    yield search(ids + [batch.column(0)[begin:at + 1]], texts)
                    ids, texts, size, begin = [], [], 0, at + 1
            if begin < batch.num_rows:
                ids.append(batch.column(0)[begin:])
        if texts:
            yield search(ids, texts)

    return run


def repeated_runs(observations: DataFrame, key: str = "observation_id", text: str = "description", least: int = LEAST,
                  exponent: int = EXPONENT) -> DataFrame:
    """Find every stretch of words that a listing repeats back to back, and the text with each said once.

    Scraped descriptions hold menus, variants or template lines over and over.  Words are runs
    without ASCII blanks, numbered from 0, compared as they are.  A run is a stretch of at least
    ``least`` words and ``exponent`` periods (3 or more) that no neighbouring word extends;
    ``period`` is its smallest.

    Method, per text: suffixes that share enough words are sorted (prefix doubling), their
    LCP-interval tree is walked bottom up with positions in left-word classes, and maximal pairs
    whose distance is at most a share of their common words are the runs.  No run is extended or
    checked afterwards.  Texts are independent: no shuffle, and a task holds one chunk of texts.

    Result, one row per observation, repeated rows included: ``key``, ``n_runs``; ``start``,
    ``length``, ``period`` and ``exponent_milli`` = floor(1000 length / period) of the run with
    the greatest length / period (ties: smallest start, then period; null without runs); ``runs``
    (array of start, length, period by start, then period) and ``collapsed`` (the words outside
    every run or in some first period only, joined by one blank; a word that any run repeats is
    dropped).  A null or empty text has no words, no runs and an empty ``collapsed``.  A very long
    text is never cut: its words are sorted in one task, in memory in proportion to it.  Null keys
    are kept; other columns are ignored; an empty table gives no rows.
    """
    if exponent < 3:
        raise ValueError("runs of fewer than three periods are not found by this method")
    kind = observations.schema[key].dataType.simpleString()
    found = listing_texts(observations, key, text).select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        _find_runs(least, exponent), f"key {kind}, n_runs long, start long, length long, period long, exponent_milli long, "
                                     "runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return found.withColumnRenamed("key", key)
