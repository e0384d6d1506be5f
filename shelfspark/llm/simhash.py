"""Near-duplicate listing texts: SimHash fingerprints and a byte-position inverted index."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm.common import connected_components, cut_lineage, listing_texts

SHINGLE = 3
SEED = 42
BITS = 2
# Two fingerprints within BITS bits differ in at most BITS bytes: this many positional bytes agree.
SHARED_BYTES = 8 - BITS
_CHUNK = 1 << 16
# The byte positions left out of an index entry; the other SHARED_BYTES form its key.
_FREE = tuple(combinations(range(8), BITS))


def simhash(text: str) -> int:
    """Signed 64-bit SimHash over the word shingles of an ASCII-lower-cased text; 0 without words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return int(np.uint64(digest(b" ".join(words), SEED)).astype(np.int64))
    total, ones = len(words) - SHINGLE + 1, np.zeros(64, np.int64)
    for at in range(0, total, _CHUNK):
        part = words[at:at + _CHUNK + SHINGLE - 1]
        found = [digest(b" ".join(s), SEED) for s in zip(*(part[k:] for k in range(SHINGLE)))]
        bits = np.unpackbits(np.array(found, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0].astype(np.int64))


@F.pandas_udf(T.LongType())
def fingerprint(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([simhash(t) for t in batch], dtype="int64")


def _meetings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links inside each index list.  Rows come sorted by (slot, shared); a list may span batches.

    A list holds at most 2**16 fingerprints, since all but two bytes agree.  Every fingerprint
    looks its 1- and 2-bit variants up in its list, so the work per fingerprint is constant.
    """
    flips = np.array([1 << i for i in range(8 * BITS)] + [1 << i | 1 << j for i, j in combinations(range(8 * BITS), 2)])
    low = np.array([8 * a for a, _ in _FREE], np.uint64)
    high = np.array([8 * b for _, b in _FREE], np.uint64)

    def links(slot, shared, prints):
        opens = np.r_[True, (slot[1:] != slot[:-1]) | (shared[1:] != shared[:-1])]
        lists = np.cumsum(opens) - 1
        many = np.bincount(lists)[lists] > 1
        if not many.any():
            return None
        slot, lists, prints = slot[many], lists[many], prints[many].view(np.uint64)
        byte = np.uint64(255)
        own = (prints >> low[slot] & byte | (prints >> high[slot] & byte) << np.uint64(8)).astype(np.int64)
        place = lists.astype(np.int64) << 16 | own
        order = np.argsort(place)
        place, prints = place[order], prints[order]
        a, b = [], []
        for flip in flips:
            other = place ^ flip
            at = np.minimum(np.searchsorted(place, other), len(place) - 1)
            hit = (place[at] == other) & (other < place)
            a.append(prints[hit])
            b.append(prints[at[hit]])
        a, b = np.concatenate(a), np.concatenate(b)
        apart = a ^ b
        tally = (apart.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
        good = (tally >= SHARED_BYTES) & (np.bitwise_count(apart) <= BITS)
        return pd.DataFrame({"a": a[good].view(np.int64), "b": b[good].view(np.int64)})

    rest = None
    for batch in batches:
        if rest is not None:
            batch = pd.concat([rest, batch], ignore_index=True)
        if batch.empty:
            continue
        slot, shared, prints = (batch[c].to_numpy() for c in ("slot", "shared", "print"))
        cut = int(np.flatnonzero((slot == slot[-1]) & (shared == shared[-1]))[0])
        rest = batch.iloc[cut:]
        if cut and (found := links(slot[:cut], shared[:cut], prints[:cut])) is not None:
            yield found
    if rest is not None and (found := links(*(rest[c].to_numpy() for c in ("slot", "shared", "print")))) is not None:
        yield found


def fingerprint_links(prints: DataFrame, column: str) -> DataFrame:
    """(a, b) for all pairs of distinct fingerprints that differ in at most two bits.

    The inverted index has one list per six (position, byte) entries held together: a pair
    within two bits shares at least six positional bytes, so it meets in a list.  (Lists of
    single bytes would number 2,048 whatever the corpus size, and each would pair up a share
    of all rows.)  The shared bytes of a pair are tallied, pairs under six dropped, and the
    bit distance verified.
    """
    def key(free):
        kept = ~sum(255 << 8 * p for p in free) & (1 << 64) - 1
        return F.col("print").bitwiseAND(F.lit(kept - (1 << 64) if kept >> 63 else kept))

    entries = F.array(*[F.struct(F.lit(i).alias("slot"), key(f).alias("shared")) for i, f in enumerate(_FREE)])
    index = (prints.select(F.col(column).alias("print")).distinct().select("print", F.explode(entries).alias("e"))
             .select("e.slot", "e.shared", "print"))
    return (index.repartition("slot", "shared").sortWithinPartitions("slot", "shared")
            .mapInPandas(_meetings, "a long, b long").distinct())


def near_duplicate_texts(observations: DataFrame, key: str = "observation_id", text: str = "description") -> DataFrame:
    """Group observations whose texts have fingerprints within two bits of each other, chains included.

    Words are runs without ASCII blanks of the ASCII-lower-cased text, shingles three words
    (repeats count; fewer words: all of them; none: fingerprint zero, which links like any
    other).  Equal fingerprints are indexed once, so copies cost nothing beyond their own row.

    Result, one row per observation, repeated rows included: ``key``, ``fingerprint`` (16 hex
    digits), ``group`` (smallest key of the group, null keys aside) and ``kept`` (exactly one
    row of a group: smallest key, null last).  A null text is empty.  Other columns are
    ignored; an empty table gives no rows.  A very long text is hashed whole, in chunks; a bit set
    in exactly half of the shingles is 0.
    """
    rows = cut_lineage(listing_texts(observations, key, text).select(
        F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), fingerprint(F.col(text)).alias("print")))
    order = F.struct(F.col("id").isNull().alias("missing"), "id", "row")
    prints = cut_lineage(rows.groupBy("print").agg(F.min(order).alias("best")))
    links = fingerprint_links(prints, "print")
    groups = (prints.join(connected_components(links, "a", "b").withColumnRenamed("node", "print"), "print", "left")
              .withColumn("component", F.coalesce("component", "print")))
    first = groups.groupBy("component").agg(F.min("best").alias("first"))
    groups = groups.join(first, "component").select("print", "first")
    return rows.join(groups, "print").select(
        F.col("id").alias(key), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        F.col("first.id").alias("group"), (F.col("first.row") == F.col("row")).alias("kept"))
