"""Collocations of listing texts, from count streams kept in prefix and in suffix order."""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import stored

LONGEST = 5
LEAST = 100
TOP = 2000
# Words cut into windows, sorted and counted at a time; windows a sorted partition should hold.
_CHUNK = 1 << 20
_PARTITION = 1 << 21
# Text read to place the borders of the sorted partitions; they decide balance, never results.
_SAMPLE_BYTES = 8 << 20
_SAMPLE_STEP = 16
_BREAKS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"\n" * 10 + b" ")
_BITS = 21


def _tokens(text: str) -> list[bytes]:
    """Words of an ASCII-lower-cased text, with a newline token at every piece border and at the end."""
    body = text.encode().lower().translate(_BREAKS).replace(b"\n", b" \n ")
    return [w for w in body.split(b" ") if w] + [b"\n"]


def _windows(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[tuple[str, pa.Array, np.ndarray]]:
    """(group, windows in byte order, counts), chunk by chunk.

    A window is a word with the words after it in its piece, ``longest`` at most.  Each word
    carries a closing blank and missing words are a blank alone, so every phrase is a byte
    prefix of exactly the windows that start with it, and these are neighbours in byte order.
    """
    held, size = defaultdict(list), 0
    for batch in batches:
        for group, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            words = _tokens(text.as_py())
            for at in range(0, len(words), _CHUNK):
                # A long text goes in parts; each part brings the words its last windows look ahead to.
                part = words[at:at + _CHUNK + longest - 1]
                held[group].append((part, min(_CHUNK, len(words) - at)))
                size += len(part)
                if size >= _CHUNK:
                    for name, parts in held.items():
                        yield name, *_sorted_windows(parts, longest)
                    held, size = defaultdict(list), 0
    for name, parts in held.items():
        yield name, *_sorted_windows(parts, longest)


def _sorted_windows(parts: list[tuple[list[bytes], int]], longest: int) -> tuple[pa.Array, np.ndarray]:
    fresh = count()
    ids = defaultdict(fresh.__next__)
    gap = ids[b"\n"]
    codes, starts = [], []
    for words, own in parts:
        codes.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
        codes.append(np.full(longest, gap))
        starts.append(np.arange(len(words) + longest) < own)
    codes, starts = np.concatenate(codes), np.concatenate(starts)
    words = pa.array([b" "] + [w + b" " for w in list(ids)[1:]], pa.binary())
    # The gap stands for "no word", a blank alone.
    order = pc.sort_indices(words).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    at = np.flatnonzero(starts & (codes != gap))
    columns, alive = [], np.ones(len(at), bool)
    for k in range(longest):
        here = codes[at + k]
        alive &= here != gap
        columns.append(np.where(alive, rank[here], rank[gap]))
    keys = []
    for k in range(0, longest, 3):
        key = np.zeros(len(at), np.int64)
        for column in columns[k:k + 3]:
            key = key << _BITS | column
        keys.append(key)
    by = np.lexsort(keys[::-1])
    new = np.zeros(len(by), bool)
    if len(by):
        new[0] = True
    for key in keys:
        key = key[by]
        new[1:] |= key[1:] != key[:-1]
    first = np.flatnonzero(new)
    counts = np.diff(np.r_[first, len(by)])
    words = words.take(pa.array(order))
    picked = [words.take(pa.array(c[by[first]])) for c in columns]
    return pc.binary_join_element_wise(*picked, b""), counts


def _dealt_windows(longest: int, borders: list[tuple[str, bytes]]):
    """Windows with the number of the sorted partition that their (group, window) belongs to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, windows, counts in _windows(batches, longest):
            # Borders of this group, each with the place of its first window at or after it.
            low, high = bisect.bisect_left(borders, (group, b"")), bisect.bisect_left(borders, (group + "\0", b""))
            part = np.full(len(windows), low, np.int32)
            for _, border in borders[low:high]:
                a, b = 0, len(windows)
                while a < b:
                    mid = (a + b) // 2
                    if windows[mid].as_py() < border:
                        a = mid + 1
                    else:
                        b = mid
                part[a:] += 1
            for at in range(0, len(windows), 1 << 16):
                cut = slice(at, at + (1 << 16))
                own = windows[cut]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[cut]), pa.array([group] * len(own), pa.string()), own, pa.array(counts[cut])],
                    ["part", "group", "window", "n"])

    return run


def _sampled_windows(longest: int, step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, windows, _ in _windows(batches, longest):
            picked = windows.take(pa.array(np.arange(0, len(windows), step)))
            yield pa.RecordBatch.from_arrays([pa.array([group] * len(picked), pa.string()), picked], ["group", "window"])

    return run


def _run_counts(longest: int, least: int):
    """Counts of all phrases of a prefix-ordered stream of windows: sums over neighbours with an equal prefix.

    Phrases under ``least`` end here, but for those at the two ends of the partition, whose
    other windows may lie in the next one.  The phrase of no words counts the group's words.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, phrases, orders, sums = [], [], [], []
        open_run = [None] * (longest + 1)  # (group, words, count, at the start of the partition)

        def close(k, keep):
            group, words, n, edge = open_run[k]
            if (keep or edge or n >= least) and (k == 0 or words[-1]):
                groups.append(group)
                phrases.append(b" ".join(words).decode())
                orders.append(k)
                sums.append(n)
            open_run[k] = None

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(groups, pa.string()), pa.array(phrases, pa.string()), pa.array(orders, pa.int32()),
                                              pa.array(sums, pa.int64())], ["group", "phrase", "words", "n"])
            for held in (groups, phrases, orders, sums):
                held.clear()
            return out

        last = None
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            group, counts = batch.column("group"), batch.column("n").to_numpy()
            words = pc.split_pattern(batch.column("window"), b" ").flatten()
            columns = [words.take(pa.array(np.arange(k, size * (longest + 1), longest + 1))) for k in range(longest)]
            new = np.zeros(size, bool)
            for k in range(longest + 1):
                column = group if k == 0 else columns[k - 1]
                new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
                if last is not None and column[0].as_py() != last[k]:
                    new[0] = True
                begin = np.flatnonzero(new)
                if open_run[k] is not None:
                    upto = begin[0] if len(begin) else size
                    own = open_run[k]
                    open_run[k] = (own[0], own[1], own[2] + int(counts[:upto].sum()), own[3])
                    if len(begin):
                        close(k, False)
                elif not len(begin) or begin[0]:
                    begin = np.r_[0, begin]  # the first row of the partition
                if not len(begin):
                    continue
                totals = np.add.reduceat(counts, begin)
                wanted = np.flatnonzero(totals[:-1] >= least).tolist()
                if last is None and len(begin) > 1 and 0 not in wanted:
                    wanted.insert(0, 0)
                for r in wanted + [len(begin) - 1]:
                    at = int(begin[r])
                    open_run[k] = (group[at].as_py(), [columns[j][at].as_py() for j in range(k)], int(totals[r]), last is None and at == 0)
                    if r < len(begin) - 1:
                        close(k, False)
            last = [group[size - 1].as_py()] + [c[size - 1].as_py() for c in columns]
            if groups:
                yield flush()
        for k in range(longest + 1):
            if open_run[k] is not None:
                close(k, True)
        if groups:
            yield flush()

    return run


def phrase_counts(texts: DataFrame, group: str, text: str, longest: int, least: int) -> DataFrame:
    """(group, phrase, words, n) of phrases of 1 to ``longest`` words met ``least`` times, and of the phrase of no words."""
    texts = texts.select(F.col(group).alias("group"), F.col(text).alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    share = min(1.0, _SAMPLE_BYTES / max(total, 1))
    sample = (texts.sample(share, 42) if share < 1 else texts).mapInArrow(_sampled_windows(longest, _SAMPLE_STEP), "group string, window binary")
    seen = sorted((r.group, bytes(r.window)) for r in sample.collect())
    parts = min(max(int(len(seen) * _SAMPLE_STEP / share / _PARTITION), 8), 20_000)
    borders = sorted({seen[i * len(seen) // parts] for i in range(1, parts)}) if seen else []
    windows = (texts.mapInArrow(_dealt_windows(longest, borders), "part int, group string, window binary, n long")
               .repartitionById(len(borders) + 1, F.col("part")).sortWithinPartitions("group", "window").select("group", "window", "n"))
    partial = windows.mapInArrow(_run_counts(longest, least), "group string, phrase string, words int, n long")
    return partial.groupBy("group", "phrase", "words").agg(F.sum("n").alias("n")).filter((F.col("n") >= least) | (F.col("words") == 0))


def cut_score(a, n, l, r):
    """floor(1000 * a * n / (l * r)), exact beyond 64 bits."""
    wide = lambda c, digits: c.cast(f"decimal({digits},0)")
    return F.call_function("div", wide(F.lit(1000), 4) * wide(a, 16) * wide(n, 16), wide(l, 19) * wide(r, 18)).cast("long")


def mine_phrases(observations: DataFrame, group: str = "store_slug", text: str = "description", longest: int = LONGEST, least: int = LEAST,
                 top: int = TOP, absorbed_percent: int = 100) -> DataFrame:
    """The phrases of each store whose words belong together most: its ``top`` by their weakest cut.

    Texts are ASCII-lower-cased and split at ``.,;:!?`` and line breaks into pieces, those at
    blanks and tabs into words.  Candidates are phrases of 2 to ``longest`` words with at least
    ``least`` occurrences ``a`` in the store.  A cut into first and rest, occurring ``l`` and
    ``r`` times, scores floor(1000 a n / (l r)) with ``n`` words in the store; the lowest cut
    counts, ties to the shortest first part.  A candidate is dropped if one word more before or
    behind makes a phrase with ``absorbed_percent`` of its occurrences (a longer one with as many
    contains such a phrase).

    Every word starts a window of ``longest`` words.  The windows form one stream in prefix
    order, range partitioned by sampled borders, so a hot first word is split; sums over
    neighbours count all phrases at once, and only frequent ones leave the pass.  Their counts
    are then read in prefix order (left parts, extensions to the right) and in suffix order
    (right parts, extensions to the left) and merge-joined with the candidates in that order.

    Result: ``group``, ``rank`` (from 1; score, then occurrences descending, then phrase in UTF-8
    byte order, so there are no ties), ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.  A null
    store is a group of its own (null); a null or empty text has no words; repeated rows count
    each; a very long text goes through in parts that lose no window; other columns are ignored;
    an empty table gives no rows.
    """
    # "-" for a null store, "+" and the name for the others.
    texts = observations.select(F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit("-")).alias("group"),
                                F.coalesce(F.col(text), F.lit("")).alias("text"))
    counts = stored(phrase_counts(texts, "group", "text", longest, least), "phrases")
    total = counts.filter("words = 0").select("group", F.col("n").alias("total"))
    known = counts.filter("words > 0").withColumn("w", F.split("phrase", " "))
    candidates = known.filter("words > 1")

    def joined(words):
        return F.array_join(words, " ")

    def backwards(words):
        return joined(F.reverse(words))

    # Prefix order: the key is the phrase; suffix order: the key is the phrase read backwards.
    size = F.col("words")
    cuts = candidates.select("group", "phrase", size, "w", "n", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("group", "phrase", "n", "k", joined(F.slice("w", 1, F.col("k"))).alias("left"),
                       backwards(F.slice("w", F.col("k") + 1, size - F.col("k"))).alias("right"))
    lefts = known.select("group", F.col("phrase").alias("left"), F.col("n").alias("l"))
    rights = known.select("group", backwards(F.col("w")).alias("right"), F.col("n").alias("r"))
    longer = (candidates.groupBy("group", joined(F.slice("w", 1, size - 1)).alias("phrase")).agg(F.max("n").alias("most"))
              .unionAll(candidates.groupBy("group", backwards(F.slice("w", 2, size - 1)).alias("back")).agg(F.max("n").alias("most"))
                        .select("group", backwards(F.split("back", " ")).alias("phrase"), "most"))
              .groupBy("group", "phrase").agg(F.max("most").alias("most")))
    scored = (cuts.join(lefts.hint("merge"), ["group", "left"]).join(rights.hint("merge"), ["group", "right"])
              .join(total, "group").select("group", "phrase", F.col("n").alias("a"), "l", "r", F.col("total").alias("n"), "k")
              .withColumn("score", cut_score(F.col("a"), F.col("n"), F.col("l"), F.col("r"))))
    weakest = scored.groupBy("group", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    order = Window.partitionBy("group").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    return (weakest.join(longer.hint("merge"), ["group", "phrase"], "left")
            .filter(F.col("most").isNull() | (100 * F.col("most") < absorbed_percent * F.col("a")))
            .select("group", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
            .withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
            .select(F.when(F.col("group").startswith("+"), F.substring("group", 2, 1 << 30)).alias(group),
                    "rank", "phrase", "a", "l", "r", "n", "score"))
