"""Repeated paragraphs of listing texts: MinHash banding, exact verification, components."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import connected_components, listing_texts, new_folder, stored, written
from shelfspark.session import drop_folder, keep, scratch, shuffles_dropped

SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.95
MIN_WORDS = 8
# A longer line is cut where a word pair's digest is the least of all within REACH words: a rule
# that sees only the words around, so a passage is cut alike wherever it stands.
LONG_LINE = 32
REACH = 6
# Values in a narrow key: unrelated texts that share a phrase rarely agree on all of them.
NARROW = 4
# Keys of so many bands are shuffled together; their files go before the next ones.
BANDS_AT_ONCE = 2
# Words of a bucket that are compared in one go; a larger bucket is dealt into blocks, every two of which meet.
_BLOCK_WORDS = 1 << 17
_CACHE_WORDS = 1 << 19
_WORDS_AT_ONCE = 1 << 20
# Words whose minima are taken together, so that they stay in the processor's cache.
_STEP = 1 << 15
_ODD = np.uint64(0x9E3779B97F4A7C15)
_TOP = np.uint64((1 << 64) - 1)
_FOUND = "row long, first_word int, last_word int, line int, whole boolean, content long"


def bands_for(recall: float, similarity: float, rows: int = 1) -> int:
    """Fewest bands of ``rows`` values that let a pair of this Jaccard similarity collide with chance ``recall``."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows) - 1e-9))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def split_paragraphs(words: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each piece over word digests and their (ascending) line numbers.

    Of equal digests within reach only the first cuts, so a repeated pattern is not shredded.
    """
    size = np.bincount(line - line[0])[line - line[0]] if len(line) else line
    pair = np.full(len(words), _TOP)
    inside = (line[1:] == line[:-1]) & (size[1:] > LONG_LINE)
    pair[1:][inside] = _mix(words[:-1] * _ODD + words[1:])[inside]
    around = np.lib.stride_tricks.sliding_window_view(np.pad(pair, REACH, constant_values=_TOP), 2 * REACH + 1)
    least = (pair == around.min(axis=1)) & (pair < around[:, :REACH].min(axis=1))
    cut = np.r_[True, (line[1:] != line[:-1])] | (least & (pair != _TOP))
    start = np.flatnonzero(cut)
    return start, np.r_[start[1:], len(words)]


def paragraph_units(words: np.ndarray, line: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, start of the line and whether it is the whole line, of everything that is compared.

    Every line; of long lines also each piece of ``min_words`` or more, and each shorter piece
    together with the next one (the last with the one before).
    """
    top = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
    bottom = np.r_[top[1:], len(words)]
    start, end = split_paragraphs(words, line)
    of = np.searchsorted(top, start, "right") - 1
    short, last = end - start < min_words, end == bottom[of]
    part = (start != top[of]) | ~last
    keep, left, right = np.flatnonzero(part & ~short), np.flatnonzero(part & short & last), np.flatnonzero(part & short & ~last)
    first = np.concatenate([start[keep], start[left - 1], start[right]])
    after = np.concatenate([end[keep], end[left], end[np.minimum(right + 1, len(end) - 1)]])
    owner = np.concatenate([of[keep], of[left], of[right]])
    inner = (first != top[owner]) | (after != bottom[owner])
    first, after, owner = first[inner], after[inner], owner[inner]
    unit = np.unique(np.stack([first, after, owner], axis=1), axis=0).reshape(-1, 3).astype(np.int64)
    whole = np.r_[np.ones(len(top), bool), np.zeros(len(unit), bool)]
    return np.r_[top, unit[:, 0]], np.r_[bottom, unit[:, 1]], np.r_[top, top[unit[:, 2]]], whole


def _contents(words: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A digest of each stretch of words."""
    size = end - start
    offset = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(offset, size)
    return _mix(np.add.reduceat(_mix(words[np.repeat(start, size) + place] + place.astype(np.uint64) * _ODD), offset)).view(np.int64)


def _shingles(words: np.ndarray) -> np.ndarray:
    """A digest of the SHINGLE words from each word on."""
    out = np.zeros(len(words), np.uint64)
    for k in range(SHINGLE):
        out[:len(words) - k] = out[:len(words) - k] * _ODD + words[k:]
    return out


def _band_keys(words: np.ndarray, start: np.ndarray, end: np.ndarray, wide: int, narrow: int) -> np.ndarray:
    """Keys of stretches of at least SHINGLE words: ``wide`` odd ones of one MinHash value, ``narrow`` even ones of NARROW values."""
    shingle = _shingles(words)
    turns = _mix(np.arange(1, 2 * NARROW * narrow + 1, dtype=np.uint64) * _ODD).reshape(-1, 2)
    out = np.empty((wide + narrow, len(start)), np.uint64)
    # Whole stretches, which are in text order, in steps.
    step = start // _STEP
    edges = np.r_[np.flatnonzero(np.r_[True, step[1:] != step[:-1]]), len(start)]
    for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
        left = start[i]
        part = shingle[left:end[i:j].max() - SHINGLE + 1]
        spans = (np.stack([start[i:j], end[i:j] - SHINGLE + 1], axis=1) - left).ravel()

        def least(value):
            return np.minimum.reduceat(np.r_[value, _TOP], spans)[::2]

        for b in range(wide):
            out[b, i:j] = _mix(least(_mix(part ^ _mix(np.array([b + 1], np.uint64)))) + np.uint64(b)) | np.uint64(1)
        base = _mix(part)
        for b in range(narrow):
            key = np.full(j - i, b + 1, np.uint64)
            for times, plus in turns[b * NARROW:(b + 1) * NARROW]:
                key = _mix(key * _ODD + least(base * (times | np.uint64(1)) + plus))
            out[wide + b, i:j] = key & ~np.uint64(1)
    return out


class _Names(dict):
    """Digests of words, each computed once."""

    def __missing__(self, word: str) -> int:
        self[word] = name = xxhash.xxh64_intdigest(word.encode())
        return name

    def of(self, words: list[str]) -> np.ndarray:
        out = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        if len(self) > _CACHE_WORDS:
            self.clear()
        return out


def _paragraph_rows(min_words: int, wide: int, narrow: int):
    """Rows of ``_FOUND``, each with its keys, 0 where there is none or a row before has them."""
    def close(words, line, owner, first):
        words, line = np.concatenate(words), np.repeat(np.arange(len(line)), line)
        start, end, top, whole = paragraph_units(words, line, min_words)
        content = _contents(words, start, end)
        keys = np.zeros((wide + narrow, len(start)), np.uint64)
        long = np.flatnonzero(end - start >= SHINGLE)
        if len(long):
            # A content needs its keys once.
            one = long[np.unique(content[long], return_index=True)[1]]
            one = one[np.argsort(start[one])]  # in text order, so gaps between stretches are short
            keys[:, one] = _band_keys(words, start[one], end[one], wide, narrow)
            # Long lines meet in narrow buckets only: a check of thousands of words is not spent on a chance partner.
            keys[:wide, whole & (end - start > LONG_LINE)] = 0
        bounds, rows = np.array(first), np.array(owner)
        at = np.searchsorted(bounds, start, "right") - 1
        return pd.DataFrame({"row": rows[at], "first_word": (start - bounds[at]).astype("int32"),
                             "last_word": (end - 1 - bounds[at]).astype("int32"), "line": (top - bounds[at]).astype("int32"),
                             "whole": whole, "content": content} | {f"key_{b}": k for b, k in enumerate(keys.view(np.int64))})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = _Names()

        for batch in batches:
            words, line, owner, first, held = [], [], [], [], 0
            for row, body in zip(batch["row"], batch["body"]):
                owner.append(row)
                first.append(held)
                for part in body.lower().split("\n"):
                    own = part.split()
                    if own:
                        words.append(names.of(own))
                        line.append(len(own))
                        held += len(own)
                if held > _WORDS_AT_ONCE:
                    yield close(words, line, owner, first)
                    words, line, owner, first, held = [], [], [], [], 0
            if words:
                yield close(words, line, owner, first)

    return run


def _edits(a: list[str], b: list[str]) -> int:
    """Fewest word edits that turn ``a`` into ``b`` (bit-parallel)."""
    mask: dict[str, int] = {}
    for i, w in enumerate(a):
        mask[w] = mask.get(w, 0) | 1 << i
    full, top, score = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    plus, minus = full, 0
    for w in b:
        eq = mask.get(w, 0)
        xv = eq | minus
        xh = ((eq & plus) + plus ^ plus) | eq
        ph = minus | ~(xh | plus) & full
        mh = plus & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1 | 1) & full, mh << 1 & full
        plus, minus = mh | ~(xv | ph) & full, ph & xv
    return score


def similar(a: list[str], b: list[str], similarity: float = SIMILARITY) -> bool:
    """Exact check: Jaccard of five-word shingles, or words kept by the best edit script, of at least ``similarity``."""
    x, y = ({tuple(w[i:i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} for w in (a, b))
    if len(x & y) >= similarity * len(x | y):
        return True
    longest = max(len(a), len(b))
    limit = int((1 - similarity) * longest + 1e-9)
    # No edit script keeps more words than the two have in common in any order.
    if abs(len(a) - len(b)) > limit or longest - (Counter(a) & Counter(b)).total() > limit:
        return False
    return _edits(a, b) <= limit


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... of ``size[0]`` places, then those of the next."""
    before = np.cumsum(size) - size
    return np.arange(int(size.sum())) - np.repeat(before - start, size)


def _common(owner: np.ndarray, value: np.ndarray, side: np.ndarray, count: int, once: bool) -> tuple[np.ndarray, np.ndarray]:
    """How many values the two sides of each owner share, and how many all have; ``once``: as sets, not as bags."""
    order = np.lexsort((value, owner))
    owner, value, side = owner[order], value[order], side[order]
    new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])]) if len(owner) else np.zeros(0, np.int64)
    right = np.add.reduceat(side.astype(np.int64), new) if len(new) else new
    left = np.diff(np.r_[new, len(owner)]) - right
    if once:
        left, right = np.minimum(left, 1), np.minimum(right, 1)
    return (np.bincount(owner[new], np.minimum(left, right), count).astype(np.int64),
            np.bincount(owner[new], np.maximum(left, right), count).astype(np.int64))


def similar_stretches(words: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """``similar`` for the stretches [a, b) and [c, d) of word digests, of at least SHINGLE words each."""
    n, m, pair = b - a, d - c, np.arange(len(a))
    longest = np.maximum(n, m)
    limit = ((1 - similarity) * longest + 1e-9).astype(np.int64)
    good = np.zeros(len(a), bool)
    # Words at equal places: never more edits than there are others.
    even = np.flatnonzero(n == m)
    other = words[_ranges(a[even], n[even])] != words[_ranges(c[even], n[even])]
    good[even] = np.bincount(np.repeat(np.arange(len(even)), n[even]), other, len(even)) <= limit[even]

    def sides(wanted, less, values):
        x, y = n[wanted] - less, m[wanted] - less
        owner = np.r_[np.repeat(np.arange(len(wanted)), x), np.repeat(np.arange(len(wanted)), y)]
        value = np.r_[values[_ranges(a[wanted], x)], values[_ranges(c[wanted], y)]]
        return owner, value, np.arange(len(owner)) >= x.sum(), len(wanted)

    open_ = pair[~good]
    both, every = _common(*sides(open_, SHINGLE - 1, _shingles(words)), True)
    good[open_] = both >= similarity * every
    # No edit script keeps more words than the two have in common in any order.
    open_ = open_[~good[open_]]
    open_ = open_[longest[open_] - np.minimum(n, m)[open_] <= limit[open_]]
    shared, _ = _common(*sides(open_, 0, words), False)
    for i in open_[longest[open_] - shared <= limit[open_]].tolist():
        good[i] = _edits(words[a[i]:b[i]].tolist(), words[c[i]:d[i]].tolist()) <= limit[i]
    return good


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words of a column of word lists, and where each list starts and ends."""
    ends = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False).view(np.uint64), ends[:-1], ends[1:]


def _cut_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = _Names()
    for batch in batches:
        if not batch.num_rows:
            continue
        own = [names.of(body.as_py().lower().split()) for body in batch.column("body")]
        spots = batch.column("spots")
        size = np.array([len(w) for w in own])
        count = np.diff(spots.offsets.to_numpy())
        first, last = (spots.values.field(c).to_numpy().astype(np.int64) for c in ("first_word", "last_word"))
        words = np.concatenate(own)[_ranges(np.repeat(np.cumsum(size) - size, count) + first, last - first + 1)]
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(last - first + 1)], pa.int32()), pa.array(words.view(np.int64)))
        yield pa.RecordBatch.from_arrays([spots.values.field("content"), lists], ["content", "words"])


def _verified(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, a, b = _flat(batch.column("words_a"))
            right, c, d = _flat(batch.column("words_b"))
            good = similar_stretches(np.r_[left, right], a, b, c + len(left), d + len(left), similarity)
            yield pa.RecordBatch.from_arrays([batch.column(x).filter(pa.array(good)) for x in ("a", "b")], ["a", "b"])

    return run


def _rarest(group: np.ndarray, owner: np.ndarray, value: np.ndarray, size: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(owner, token): the values, rarest in their group first, one of which two owners must share that are similar by the share of them."""
    _, token, often = np.unique(_mix(value ^ _mix(group[owner].astype(np.uint64) + np.uint64(1))), return_inverse=True, return_counts=True)
    order = np.lexsort((token, often[token], owner))
    owner, token = owner[order], token[order]
    place = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    first = (place < (size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1)[owner]) & (often[token] > 1)
    return owner[first], token[first]


def _met(owner: np.ndarray, token: np.ndarray, loose: np.ndarray, may) -> np.ndarray:
    """Distinct pairs of owners (smaller one times their number, plus the other) that share a token, one of them loose, and ``may`` be similar."""
    order = np.lexsort((owner, token))
    owner, token = owner[order], token[order]
    top = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.zeros(0, np.int64)
    size = np.diff(np.r_[top, len(token)])
    of = np.repeat(np.arange(len(top)), size)
    one = np.flatnonzero(loose[owner])
    found, cost = [], np.cumsum(size[of[one]])
    for at in np.split(one, np.searchsorted(cost, np.arange(_BLOCK_WORDS, cost[-1] if len(cost) else 0, _BLOCK_WORDS))):
        x = np.repeat(owner[at], size[of[at]])
        y = owner[_ranges(top[of[at]], size[of[at]])]
        good = may(x, y)
        x, y = x[good], y[good]
        found.append(np.unique(np.minimum(x, y) * len(loose) + np.maximum(x, y)))
    return np.unique(np.concatenate(found))


def similar_across(words: np.ndarray, start: np.ndarray, end: np.ndarray, group: np.ndarray, part: np.ndarray, loose: np.ndarray,
                   similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """All similar pairs of stretches of one group and different parts, one of them at least loose.

    Similar stretches have the share ``similarity`` of their words (as a bag) or of their shingles
    (as a set) in common, so they share one of the few rarest of either; only these pairs are checked.
    """
    size = end - start
    owner = np.repeat(np.arange(len(start)), size)
    value = words[_ranges(start, size)]
    # The second "the" of a stretch is not its first.
    order = np.lexsort((value, owner))
    new = np.r_[True, (owner[order][1:] != owner[order][:-1]) | (value[order][1:] != value[order][:-1])]
    again = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    bag = value[order] + again.astype(np.uint64) * _ODD
    few = np.repeat(np.arange(len(start)), size - SHINGLE + 1)
    shingle = _shingles(words)[_ranges(start, size - SHINGLE + 1)]
    place = np.lexsort((shingle, few))
    few, shingle = few[place], shingle[place]
    new = np.r_[True, (few[1:] != few[:-1]) | (shingle[1:] != shingle[:-1])]
    few, shingle = few[new], shingle[new]
    pairs = []
    for own, values, count in ((owner[order], bag, size), (few, shingle, np.bincount(few, minlength=len(start)))):
        def may(x, y, count=count):
            return (part[x] != part[y]) & (np.minimum(count[x], count[y]) >= similarity * np.maximum(count[x], count[y]) - 1e-9)

        pairs.append(_met(*_rarest(group, own, values, count, similarity), loose, may))
    x, y = np.divmod(np.unique(np.concatenate(pairs)), len(start))
    good = similar_stretches(words, start[x], end[x], start[y], end[y], similarity)
    return x[good], y[good]


def _across(similarity: float):
    """Links over batches sorted by (key, left, right): whole groups are held until their words fill a block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            words, start, end = _flat(rows.column("words").combine_chunks())
            names = [rows.column(c).to_numpy() for c in ("key", "left", "right", "content", "component", "largest")]
            new = np.zeros(rows.num_rows, bool)
            for c in names[:3]:
                new[1:] |= c[1:] != c[:-1]
            content, part, largest = names[3:]
            x, y = similar_across(words, start, end, np.cumsum(new), part, part != largest, similarity)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(content[x], content[y])), pa.array(np.maximum(content[x], content[y]))], ["a", "b"])

        held = None
        for batch in batches:
            held = pa.concat_tables([*([held] if held is not None else []), pa.Table.from_batches([batch])])
            if sum(c.offsets[-1].as_py() - c.offsets[0].as_py() for c in held.column("words").chunks if len(c)) < _BLOCK_WORDS:
                continue
            group = np.stack([held.column(c).to_numpy() for c in ("key", "left", "right")])
            # The last group may go on in the next batch.
            last = int(np.flatnonzero(np.r_[True, (group[:, 1:] != group[:, :-1]).any(axis=0)])[-1])
            if last:
                yield close(held.slice(0, last))
                held = pa.Table.from_batches(held.slice(last).combine_chunks().to_batches())
        if held is not None and held.num_rows:
            yield close(held)

    return run


def _held(df: DataFrame) -> DataFrame:
    """A stored table that goes with its ``scratch``."""
    with shuffles_dropped(df.sparkSession):
        return keep(df)


def _words(pairs: DataFrame, distinct: DataFrame, texts: DataFrame) -> DataFrame:
    """(content, words) of all that is in a pair, words as digests."""
    spots = (distinct.join(pairs.select(F.explode(F.array("a", "b")).alias("content")).distinct().hint("shuffle_hash"), "content")
             .select("row", F.struct("content", "first_word", "last_word").alias("spot"))
             .groupBy("row").agg(F.collect_list("spot").alias("spots")))
    return _held(texts.join(spots, "row").select("body", "spots").mapInArrow(_cut_words, "content long, words array<long>"))


def _checked(pairs: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """The (a, b) of ``pairs`` whose words are similar."""
    return _held(pairs.join(words.select(F.col("content").alias("a"), F.col("words").alias("words_a")), "a")
                 .join(words.select(F.col("content").alias("b"), F.col("words").alias("words_b")), "b")
                 .select("a", "b", "words_a", "words_b").mapInArrow(_verified(similarity), "a long, b long"))


def _in_order(left, right) -> tuple:
    return F.least(left, right).alias("a"), F.greatest(left, right).alias("b")


def _shared_keys(units: DataFrame, bands: int, folder: str) -> tuple[DataFrame, DataFrame]:
    """(a, b) of every content and the smallest and the largest one that shares a key with it; (key, content) of all others in narrow buckets."""
    pairs, inner = [], []
    for at in range(0, bands, BANDS_AT_ONCE):
        some = F.array(*[f"key_{b}" for b in range(at, min(at + BANDS_AT_ONCE, bands))])
        # Dealt once; most keys are alone, so they are told apart by hash before anything is sorted.
        rows = units.select("content", F.explode(some).alias("key")).filter("key <> 0").repartition("key")
        ends = rows.groupBy("key").agg(F.min("content").alias("least"), F.max("content").alias("most")).filter("least <> most")
        with scratch(units.sparkSession):
            shared = _held(rows.join(ends.hint("shuffle_hash"), "key").select("key", "content", "least", "most"))
            both = shared.select("content", F.explode(F.array("least", "most")).alias("end")).filter("content <> end")
            pairs.append(written(both.select(*_in_order("content", "end")).distinct(), f"{folder}/pairs-{at}"))
            inner.append(written(shared.filter("key & 1 = 0 and content <> least and content <> most")
                                 .select("key", "content").distinct(), f"{folder}/inner-{at}"))
    return _held(reduce(DataFrame.unionAll, pairs).distinct()), reduce(DataFrame.unionAll, inner)


def _near_groups(pairs: DataFrame, inner: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """(content, component) of the paragraphs that are similar to another."""
    linked = _checked(pairs, words, similarity)
    groups = connected_components(linked, "a", "b").withColumnRenamed("node", "content")
    inner = _held(inner.join(groups, "content", "left").select("key", "content", F.coalesce("component", "content").alias("component")))
    sizes = inner.groupBy("key", "component").agg(F.count("*").alias("n"))
    largest = (sizes.groupBy("key").agg(F.max(F.struct("n", "component")).alias("m"), F.count("*").alias("components"))
               .filter("components > 1").select("key", F.col("m.component").alias("largest")))
    inner = _held(inner.join(largest, "key").join(words, "content"))
    blocks = inner.groupBy("key").agg(F.ceil(F.sum(F.size("words")) / F.lit(_BLOCK_WORDS)).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("content"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    met = (inner.join(blocks, "key").withColumn("block", block).select("*", other)
           .withColumns({"left": F.least("block", "other"), "right": F.greatest("block", "other")})
           .select("key", "left", "right", "content", "component", "largest", "words"))
    more = _held(met.repartition("key", "left", "right").sortWithinPartitions("key", "left", "right")
                 .mapInArrow(_across(similarity), "a long, b long").distinct())
    # What the links so far connect is already a star.
    stars = groups.filter("content <> component").select(F.col("component").alias("a"), F.col("content").alias("b"))
    return connected_components(stars.unionAll(more), "a", "b").withColumnRenamed("node", "content")


def repeated_paragraphs(observations: DataFrame, key: str = "observation_id", text: str = "description",
                        similarity: float = SIMILARITY, recall: float = RECALL, min_words: int = MIN_WORDS) -> DataFrame:
    """Paragraphs that occur more than once in all texts, exactly or nearly, and which of them to remove.

    A paragraph is a line of any length.  Lines over ``LONG_LINE`` words are compared as a whole,
    and also in pieces cut at places that depend only on the words around, so a passage inside
    another paragraph is met too; a piece under ``min_words`` words is taken together with a
    neighbour.  Pieces of a line that is removed as a whole do not count.

    Equal paragraphs are collapsed first.  The rest of five words or more get MinHash keys of
    five-word shingles: keys of ``NARROW`` values, as many as ``recall`` at ``similarity`` needs,
    and keys of one value, as many as that needs.  In every bucket all paragraphs are first
    checked against its smallest and largest digest.  Then, in the narrow buckets, every two
    paragraphs that these links do not connect yet, but for two of the bucket's largest component,
    are checked if they share one of their rarest words or shingles, which all similar ones do.
    So similar paragraphs that share a narrow bucket always meet in a component.
    A pair is linked if its exact Jaccard similarity, or the share of words kept by the best
    edit script, reaches ``similarity``.

    Result, one row per repeated paragraph occurrence: ``key``, ``first_word``, ``last_word``
    (0-based, in the text's words), ``cluster``, ``copies`` (occurrences in the cluster) and
    ``removed`` (false for the first occurrence alone).  Texts without repeated paragraphs do
    not appear; a null text is empty; repeated rows repeat each other.  Other columns are
    ignored; an empty table gives no rows.
    """
    spark = observations.sparkSession
    texts = listing_texts(observations, key, text).select(
        F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), F.col(text).alias("body"))
    bodies = texts.select("row", "body")
    wide, narrow = bands_for(recall, similarity), bands_for(recall, similarity, NARROW)
    kind = _FOUND + "".join(f", key_{b} long" for b in range(wide + narrow))
    # Rows with all their keys are wider than all the rest: they go as soon as keys that are alone are known.
    folder = new_folder(spark, "units")
    units = written(bodies.mapInPandas(_paragraph_rows(min_words, wide, narrow), kind), folder)
    with scratch(spark) as shared:
        pairs, inner = _shared_keys(units, wide + narrow, shared)
        found = stored(units.select("row", "first_word", "last_word", "line", "whole", "content"), "paragraphs")
        drop_folder(spark, folder)
        distinct = stored(found.groupBy("content").agg(
            F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("row", "first_word", "last_word")]), "distinct")
        groups = _near_groups(pairs, inner, _words(pairs, distinct, texts), similarity)

    # What is linked has two contents at least; of the rest only what occurs more than once.
    clusters = (distinct.select("content", "copies").join(groups.hint("shuffle_hash"), "content", "left").filter("component is not null or copies > 1")
                .select("content", F.coalesce("component", "content").alias("cluster")))
    marked = found.join(clusters.hint("shuffle_hash"), "content").drop("content")
    # Overlapping stretches of one line in one cluster are one occurrence, not copies of each other.
    place = Window.partitionBy("row", "line", "cluster").orderBy("first_word", F.desc("last_word"))
    before = F.max("last_word").over(place.rowsBetween(Window.unboundedPreceding, -1))
    marked = marked.withColumn("_new", F.coalesce(F.col("first_word") > before, F.lit(True)).cast("int"))
    marked = stored(marked.withColumn("_stretch", F.sum("_new").over(place)).groupBy("row", "line", "cluster", "_stretch").agg(
        F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"), F.max("whole").alias("whole")).drop("_stretch"), "marked")

    first = F.min(F.struct("row", "first_word")).alias("first")
    copied = (F.col("row") != F.col("first.row")) | (F.col("first_word") != F.col("first.first_word"))
    lines = marked.filter("whole")
    gone = (lines.filter(F.col("last_word") - F.col("first_word") >= LONG_LINE)
            .join(lines.groupBy("cluster").agg(first), "cluster").filter(copied).select("row", "line", F.lit(True).alias("_gone")))
    marked = marked.join(gone, ["row", "line"], "left").filter("whole or _gone is null")
    totals = marked.groupBy("cluster").agg(F.count("*").alias("copies"), first).filter("copies > 1")
    marked = marked.join(totals, "cluster").select("row", "first_word", "last_word", "cluster", "copies", copied.alias("removed"))
    return (texts.select("row", F.col("id").alias(key)).join(marked, "row")
            .select(key, "first_word", "last_word", "cluster", "copies", "removed"))
