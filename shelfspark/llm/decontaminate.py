"""Benchmark passages inside listing texts: CGK embedding, bit-sampling LSH, exact edit check."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm.common import listing_texts

MIN_WORDS = 5
EDIT_SHARE = 0.2
REPEATS = 3
# Steps of the walk and sampled emissions, by the fewest words an item has; short items need short walks.
WALKS = ((24, 18, 9), (12, 10, 6), (MIN_WORDS, 4, 3))
STEPS = max(steps for _, steps, _ in WALKS)
# Items held by one broadcast; a larger benchmark is searched in several such blocks.
BLOCK_ITEMS = 20_000
_WORDS_AT_ONCE = 1 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MARKS = re.compile(r"[\W_]+")
_CACHE_WORDS = 1 << 19
HITS = T.ArrayType(T.StructType([T.StructField("item", T.IntegerType()), T.StructField("edits", T.IntegerType()),
                                 T.StructField("last_word", T.IntegerType())]))


def plain_words(text: str) -> list[str]:
    """Lower-cased words without punctuation."""
    return [w for w in (_MARKS.sub("", w) for w in text.lower().split()) if w]


class BenchmarkIndex:
    """LSH tables over one block of benchmark items; small, and sent to the executors once.

    The CGK walk reads a word, emits it, and moves on by one word or none as a random bit of
    (step, word) says; two texts a few edits apart fall back into step, so edit distance
    becomes Hamming distance of the emitted words.  A repeat has its own random bits and its
    own sample of the first emissions (``WALKS``); early ones, since edits behind them cannot hurt.  Windows start at every word
    of an item and of a text: a key met at text word p and item word o proposes the
    item-sized window that starts at p - o.
    """

    def __init__(self, items: list[str], seed: int = 42):
        self.items = [plain_words(t) for t in items]
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for ws in self.items for w in ws}), 1)}
        self.bits = [np.array([0, *(xxhash.xxh64_intdigest(w.encode(), seed + r) for w in self.vocabulary)], np.uint64)
                     for r in range(REPEATS)]
        self.masks, numbered = [], []
        for n, words in enumerate(self.items):
            ids = np.array([self.vocabulary[w] for w in words], np.int64)
            mask: dict[int, int] = {}
            for i, w in enumerate(ids.tolist()):
                mask[w] = mask.get(w, 0) | 1 << i
            self.masks.append(mask)
            numbered.append((n, ids))
        rng = random.Random(seed)
        self.tables, above = [], float("inf")
        for least, steps, sampled in WALKS:
            members = [(n, ids) for n, ids in numbered if least <= len(ids) < above]
            for r in range(REPEATS):
                # The first emission is always sampled: it drops most text positions at once.
                sample = (0, *sorted(rng.sample(range(1, steps), sampled - 1)))
                if members:
                    self.tables.append(self._table(members, r, sample))
            above = least

    def _table(self, items, repeat: int, sample):
        ids = np.concatenate([np.r_[i, np.zeros(STEPS, np.int64)] for _, i in items])
        owner = np.concatenate([np.full(len(i) + STEPS, n) for n, i in items])
        offset = np.concatenate([np.arange(len(i) + STEPS) for _, i in items])
        at, keys = self._walk(ids, repeat, sample)
        order = np.argsort(keys, kind="stable")
        return repeat, sample, keys[order], owner[at][order], offset[at][order]

    def _walk(self, ids: np.ndarray, repeat: int, sample) -> tuple[np.ndarray, np.ndarray]:
        """Start positions whose sampled emissions are all item words, and their keys."""
        at = np.flatnonzero(ids)
        spot, keys = at, np.zeros(len(at), np.uint64)
        for step in range(sample[-1] + 1):
            out = ids[spot]
            if step in sample:
                known = out != 0
                at, spot, keys, out = at[known], spot[known], keys[known], out[known]
                keys = (keys ^ out.astype(np.uint64)) * _MULTIPLIER
                keys ^= keys >> np.uint64(29)
            spot = spot + (self.bits[repeat][out] >> np.uint64(step) & np.uint64(1)).astype(np.int64)
        # A walk that hardly moved has seen too few words to tell anything; the same rule holds on both sides.
        moved = spot - at >= (sample[-1] + 1) // 3
        return at[moved], keys[moved]

    def candidates(self, ids: np.ndarray) -> set[tuple[int, int]]:
        """(item, start of the window) proposed by any repeat; ``ids`` ends with STEPS zeros per text."""
        found = set()
        for table in self.tables:
            repeat, sample, keys, owner, offset = table
            at, own = self._walk(ids, repeat, sample)
            first, last = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
            n = last - first
            hit = n > 0
            if not hit.any():
                continue
            at, first, n = at[hit], first[hit], n[hit]
            entry = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
            found.update(zip(owner[entry].tolist(), (np.repeat(at, n) - offset[entry]).tolist()))
        return found

    def edits(self, item: int, words: list[int]) -> tuple[int, int]:
        """Fewest word edits that turn the item into some stretch of ``words``, and where it ends (bit-parallel)."""
        size, mask = len(self.items[item]), self.masks[item]
        plus, minus, score, top = (1 << size) - 1, 0, size, 1 << size - 1
        full, best = plus, (size, -1)
        for at, word in enumerate(words):
            eq = mask.get(word, 0)
            xv = eq | minus
            xh = ((eq & plus) + plus ^ plus) | eq
            ph = minus | ~(xh | plus) & full
            mh = plus & xh
            score += bool(ph & top) - bool(mh & top)
            ph, mh = ph << 1 & full, mh << 1 & full
            plus, minus = mh | ~(xv | ph) & full, ph & xv
            if score < best[0]:
                best = (score, at)
        return best

    def search(self, texts: pd.Series) -> list[list[tuple[int, int, int]]]:
        out: list[list] = [[] for _ in texts]
        cache: dict[str, int] = {}
        pieces, starts, owners, held = [], [], [], 0
        gap = np.zeros(STEPS, np.int64)

        def flush():
            nonlocal pieces, starts, owners, held
            if pieces:
                self._search(np.concatenate(pieces), np.array(starts), owners, out)
            pieces, starts, owners, held = [], [], [], 0

        for n, text in enumerate(texts):
            words = text.lower().split()
            get = cache.get
            ids = [get(w) for w in words]
            if None in ids:
                for i, w in enumerate(words):
                    if ids[i] is None:
                        known = cache.get(w)
                        if known is None:
                            plain = _MARKS.sub("", w)
                            known = cache[w] = self.vocabulary.get(plain, 0) if plain else -1
                        ids[i] = known
                if len(cache) > _CACHE_WORDS:
                    cache = {}
            ids = np.array(ids, np.int64)
            ids = ids[ids >= 0]
            starts.append(held)
            owners.append(n)
            pieces += [ids, gap]
            held += len(ids) + STEPS
            if held >= _WORDS_AT_ONCE:
                flush()
        flush()
        return out

    def _search(self, ids, starts, owners, out) -> None:
        ends = np.r_[starts[1:], len(ids)] - STEPS
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for item, start in self.candidates(ids):
            size = len(self.items[item])
            limit = int(EDIT_SHARE * size)
            doc = int(np.searchsorted(starts, max(start + size - 1, 0) if start < 0 else start, "right")) - 1
            # The window may open before its text; the meeting word itself is inside.
            for doc in {doc, min(int(np.searchsorted(starts, start + size - 1, "right")) - 1, len(starts) - 1)}:
                lo, hi = max(start - limit, int(starts[doc])), min(start + size + limit, int(ends[doc]))
                if hi - lo < size - limit:
                    continue
                words = ids[lo:hi].tolist()
                mask = self.masks[item]
                if sum(w in mask for w in words) < size - limit:
                    continue
                edits, last = self.edits(item, words)
                if edits <= limit:
                    key = (doc, item)
                    best[key] = min(best.get(key, (size, 0)), (edits, lo + last - int(starts[doc])))
        for (doc, item), (edits, last) in sorted(best.items()):
            out[owners[doc]].append((item, edits, last))


def benchmark_hits(spark: SparkSession, benchmark: DataFrame, text: Column, item_key: str, item_text: str,
                   block_items: int = BLOCK_ITEMS) -> tuple[Column, DataFrame]:
    """A column of hits (item number, edits, last word) for ``text``, and the table item number -> ``item_key``.

    The benchmark is the stated query set: it is read in blocks of ``block_items`` items, one
    broadcast each, and every block meets all texts.
    """
    rows = benchmark.select(F.col(item_key).alias("id"), F.coalesce(F.col(item_text), F.lit("")).alias("body"))
    columns, ids, block = [], [], []

    def close():
        shared = spark.sparkContext.broadcast(BenchmarkIndex([b for _, b in block]))
        base = len(ids) - len(block)

        @F.pandas_udf(HITS)
        def hits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            index = shared.value
            for batch in batches:
                yield pd.Series([[{"item": base + i, "edits": e, "last_word": w} for i, e, w in found]
                                 for found in index.search(batch)], dtype=object)

        columns.append(hits(text))
        block.clear()

    for row in rows.toLocalIterator():
        block.append((row.id, row.body))
        ids.append(row.id)
        if len(block) == block_items:
            close()
    if block or not columns:
        close()
    kind = rows.schema["id"].dataType
    numbered = spark.createDataFrame(list(enumerate(ids)), T.StructType([T.StructField("item", T.IntegerType()), T.StructField(item_key, kind)]))
    return (F.concat(*columns) if len(columns) > 1 else columns[0]), numbered


def benchmark_passages(
    observations: DataFrame,
    benchmark: DataFrame,
    key: str = "observation_id",
    text: str = "description",
    item_key: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Observations whose text holds a benchmark item within 20 % word edits.

    Words are compared lower-cased and without punctuation.  Candidates come from CGK walks
    with repeated bit sampling; every candidate is verified by exact edit distance against a
    window of the item's size (plus the allowed edits).  An unedited passage is always found,
    since its keys agree in every repeat; see the tests for the recall of edited ones.

    Result, one row per observation row and item found: ``key``, ``item_key``, ``edits`` (the
    fewest), ``last_word`` (0-based index of the passage's last word).  Items under five words
    match nothing; a null or empty text holds nothing; repeated rows and repeated items are
    reported each.  Other columns are ignored; an empty table gives no rows.
    """
    hits, numbered = benchmark_hits(observations.sparkSession, benchmark, F.col(text), item_key, item_text)
    found = listing_texts(observations, key, text).select(F.col(key).alias("id"), F.explode(hits).alias("hit"))
    found = found.select("id", "hit.item", "hit.edits", "hit.last_word").join(numbered, "item")
    return found.select(F.col("id").alias(key), item_key, "edits", "last_word")
