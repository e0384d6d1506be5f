"""Near-duplicate listing texts: MinHash coordinates posted in inverted lists, collisions counted, links confirmed on full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import connected_components, listing_texts, stored

SHINGLE = 3
COORDINATES = 32
# Two sets of similarity 0.85 agree in under 16 of 32 coordinates with probability 6e-7.
MATCHES = 16
PERCENT = 85
# Rounds that pair each list with one of its members before what is left of the lists is compared.
HUB_ROUNDS = 2
_CHUNK = 1 << 19
_STEP = 1 << 15
_TEXTS = 256
_RNG = np.random.default_rng(13)
_FLIP = _RNG.integers(0, 1 << 63, COORDINATES * 4, dtype=np.uint64)
_TIMES = _RNG.integers(0, 1 << 63, COORDINATES * 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ h >> np.uint64(32)
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(29)


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit names of the distinct shingles of each text, how many of each text), text after text."""
    known: dict[bytes, int] = {}
    parts, sizes = [], []
    for text in texts:
        words = text.lower().split()
        for w in words:
            if w not in known:
                known[w] = len(known)
        parts.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
        sizes.append(len(words))
    names = np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))
    words, sizes = names[np.concatenate(parts)] if parts else np.zeros(0, np.uint64), np.array(sizes, np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    # A shingle starts at each word with two more behind it, or at the first word of a shorter text.
    behind = np.repeat(sizes, sizes) - at
    begin = np.flatnonzero((behind >= SHINGLE) | (at == 0))
    shingle = np.zeros(len(begin), np.uint64)
    for k in range(SHINGLE):
        inside = behind[begin] > k
        shingle[inside] = _mixed((shingle[inside] + words[begin[inside] + k]) * _PLACE[k])
    owner = owner[begin]
    order = np.lexsort((shingle, owner))
    shingle, owner = shingle[order], owner[order]
    new = np.ones(len(order), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])
    return shingle[new], np.bincount(owner[new], minlength=len(sizes))


def signatures(shingles: np.ndarray, sizes: np.ndarray, coordinates: int) -> np.ndarray:
    """One row of ``coordinates`` minima per set; empty sets keep the largest value."""
    out = np.full((len(sizes), coordinates), np.iinfo(np.uint32).max, np.uint32)
    filled = np.flatnonzero(sizes)
    ends = np.cumsum(sizes[filled])
    # Whole sets in steps that stay in the processor's cache.
    first = 0
    while first < len(filled):
        base = ends[first] - sizes[filled[first]]
        last = max(int(np.searchsorted(ends, base + _STEP, "right")), first + 1)
        part = shingles[base:ends[last - 1]]
        begin = ends[first:last] - sizes[filled[first:last]] - base
        for k in range(coordinates):
            out[filled[first:last], k] = np.minimum.reduceat((part ^ _FLIP[k]) * _TIMES[k], begin) >> np.uint64(32)
        first = last
    return out


def _sign(coordinates: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sign(columns, texts):
            shingles, sizes = shingle_sets(texts)
            minima = signatures(shingles, sizes, coordinates).view(np.int32)
            ends = np.cumsum(sizes)
            names = [xxhash.xxh3_128_digest(shingles[e - n:e].tobytes()) for e, n in zip(ends.tolist(), sizes.tolist())]
            signature = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * coordinates, pa.int32()), pa.array(minima.ravel()))
            return pa.RecordBatch.from_arrays(
                [pa.concat_arrays(c) for c in columns] + [pa.array(sizes), pa.array(names, pa.binary()), signature],
                ["id", "t1", "t2", "size", "name", "signature"])

        columns, texts, size = ([], [], []), [], 0
        for batch in batches:
            begin = 0
            for at, text in enumerate(batch.column(3)):
                texts.append(text.as_py().encode())
                size += len(texts[-1])
                if size >= 8 * _CHUNK:
                    for held, c in zip(columns, range(3)):
                        held.append(batch.column(c)[begin:at + 1])
                    yield sign(columns, texts)
                    columns, texts, size, begin = ([], [], []), [], 0, at + 1
            if begin < batch.num_rows:
                for held, c in zip(columns, range(3)):
                    held.append(batch.column(c)[begin:])
        if texts:
            yield sign(columns, texts)

    return run


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _TEXTS):
            part = batch.slice(at, _TEXTS)
            shingles, sizes = shingle_sets([t.as_py().encode() for t in part.column(1)])
            sets = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(shingles.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), sets], ["name", "shingles"])


def posting_lists(sets: DataFrame, matches: int) -> DataFrame:
    """(at, value, name): the coordinate-value pairs under which each set is posted.

    Values met once are skipped.  A set with under ``matches`` others cannot collide often enough
    and goes; of the rest, rarest first, the first ``size - matches + 1`` are its prefix: two
    sets that agree in ``matches`` coordinates share one of their prefixes, as all order by
    (occurrences, coordinate, value).
    """
    posts = sets.select("name", F.posexplode("signature").alias("at", "value"))
    lists = posts.groupBy("at", "value").agg(F.count("*").alias("n")).filter("n > 1")
    held = (posts.join(lists, ["at", "value"]).groupBy("name").agg(F.array_sort(F.collect_list(F.struct("n", "at", "value"))).alias("held"))
            .filter(F.size("held") >= matches))
    return (held.select("name", F.explode(F.slice("held", 1, F.size("held") - (matches - 1))).alias("post"))
            .select("post.at", "post.value", "name"))


def rare_shingles(full: DataFrame, percent: int) -> DataFrame:
    """(shingle, place, size, name): the first shingles of each set, rarest first, one of which two similar sets must share.

    A partner holds ``percent`` % of a set at least, so all but that share of its shingles, and one
    more, cannot miss it.  Shingles of one set alone come first of all and are only counted.
    """
    tokens = full.select("name", F.explode("shingles").alias("shingle"))
    known = tokens.groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 1")
    ordered = tokens.join(known, "shingle").groupBy("name").agg(F.array_sort(F.collect_list(F.struct("n", "shingle"))).alias("held"))
    size = F.col("size")
    alone = size - F.size("held")
    first = size - F.ceil(F.lit(percent) * size / 100) + 1 - alone
    return (ordered.join(full.select("name", F.size("shingles").alias("size")), "name").filter(first > 0)
            .select("name", "size", alone.alias("alone"), F.posexplode(F.slice("held", F.lit(1), first.cast("int"))).alias("at", "held"))
            .select("held.shingle", (F.col("alone") + F.col("at")).alias("place"), "size", "name"))


def differences(full: DataFrame, bases: DataFrame) -> DataFrame:
    """(name, base, delta): the shingles that tell a set from the base of its group, what it lacks marked by its complement.

    The difference of two sets is that of their deltas, so sets close to one base are compared
    exactly by a few values.  A delta over half of the set is left out.
    """
    base = full.select(F.col("name").alias("base"), F.col("shingles").alias("b"))
    both = full.join(bases, "name").join(base, "base")
    delta = F.concat(F.array_except("shingles", "b"), F.transform(F.array_except("b", "shingles"), lambda s: F.bitwise_not(s)))
    return both.select("name", "base", delta.alias("delta"), F.size("shingles").alias("n")).filter("2 * size(delta) <= n").drop("n")


def near_listing_groups(observations: DataFrame, key: str = "observation_id", text: str = "description", coordinates: int = COORDINATES,
                        matches: int = MATCHES, percent: int = PERCENT) -> DataFrame:
    """Group observations whose descriptions share ``percent`` % of their three-word shingles, chains included.

    Words are runs without ASCII blanks of the ASCII-lower-cased text; a text's set holds its
    distinct shingles, with one or two words the whole sequence as one.  Equal sets are one set
    from the start, so copies cost nothing beyond their own row.

    Each set is posted under its MinHash coordinate-value pairs, rarest first and no further than
    the prefix that two sets with ``matches`` equal coordinates must share.  In two rounds the
    members of a list outside its largest part are paired with one set of that part, so a group
    of any size takes a few pairs per member.  After them, sets whose lists still hold several parts are
    compared across parts where they share one of their rarest shingles, which all similar sets
    do, and, around one hub, differ from it alike; so the outsiders of a great group are not
    paired with all of it.  Pairs with ``matches`` equal
    coordinates are confirmed on the full sets of 64-bit shingle names; a link under that number
    is lost with probability below 1e-6 at the threshold and less above it.

    Result, one row per observation, repeated rows included: ``key``, ``n_shingles``, ``group``
    (smallest key of the group) and ``kept`` (key equals group).  Texts without words, null ones
    included, have no shingles, are linked with nothing and are groups of their own.  Null keys
    are never the group unless it has no other key; two rows of one key are kept both.  The
    order of the smallest key leaves no ties.  Very long texts go through whole; a set takes
    memory in proportion to its text.  Other columns are ignored; an empty table gives no rows.
    """
    digests = [F.xxhash64(F.lit(n), F.col("text")).alias(f"t{n}") for n in (1, 2)]
    texts = listing_texts(observations, key, text).select(F.col(key).alias("id"), F.col(text).alias("text")).select("id", *digests, "text")
    kind = observations.schema[key].dataType.simpleString()
    rows = stored(texts.mapInArrow(_sign(coordinates), f"id {kind}, t1 long, t2 long, size long, name binary, signature array<int>"), "signatures")
    sets = stored(rows.filter("size > 0").groupBy("name").agg(F.min("id").alias("first"), F.min(F.struct("t1", "t2")).alias("t"),
                                                                F.first("size").alias("size"), F.first("signature").alias("signature")), "sets")
    lists = stored(posting_lists(sets, matches), "postings")
    # Texts are named by digest, not by row number: the same whenever and wherever they are read again.
    posted = sets.join(lists.select("name").distinct(), "name", "left_semi")
    bodies = (texts.join(posted.select("t.t1", "t.t2"), ["t1", "t2"], "left_semi").dropDuplicates(["t1", "t2"])
              .join(posted.select("t.t1", "t.t2", "name"), ["t1", "t2"]).select("name", "text"))
    full = stored(bodies.mapInArrow(_full_sets, "name binary, shingles array<long>"), "shingles")
    signs = sets.select("name", "size", "signature")

    def side(columns: DataFrame, name: str) -> DataFrame:
        return columns.select(*[F.col(c).alias(name if c == "name" else f"{name}_{c}") for c in columns.columns])

    def possible(x: Column, y: Column) -> Column:
        return 100 * F.least(x, y) >= percent * F.greatest(x, y)

    def agreeing(pairs: DataFrame) -> DataFrame:
        both = pairs.join(side(signs, "a"), "a").join(side(signs, "b"), "b").filter(possible(F.col("a_size"), F.col("b_size")))
        same = sum(F.col("a_signature")[k].eqNullSafe(F.col("b_signature")[k]).cast("int") for k in range(coordinates))
        return both.filter(same >= matches).select("a", "b")

    def confirmed(pairs: DataFrame) -> DataFrame:
        sides = pairs.join(full.select(F.col("name").alias("a"), F.col("shingles").alias("x")), "a").join(
            full.select(F.col("name").alias("b"), F.col("shingles").alias("y")), "b")
        both = F.size(F.array_intersect("x", "y"))
        return sides.filter(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b")

    tried, parts = [], None

    def opened(rows: DataFrame, on: list[str], turn: int) -> tuple[DataFrame, DataFrame]:
        """Members of the lists that still hold several parts, and per list its largest part and one of its sets."""
        members = rows.withColumn("part", F.col("name")) if parts is None else rows.join(
            parts.withColumnRenamed("node", "name"), "name", "left").select(*rows.columns, F.coalesce("component", "name").alias("part"))
        hubs = members.groupBy(*on, "part").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("name", F.lit(turn)), "name")).alias("one"))
        hubs = hubs.groupBy(*on).agg(F.max(F.struct("n", "part", "one")).alias("most"), F.sum("n").alias("all")).filter("all > most.n")
        return members, hubs.select(*on, F.col("most.part").alias("main"), F.col("most.one.name").alias("hub"))

    for turn in range(HUB_ROUNDS + 1):
        members, hubs = opened(lists, ["at", "value"], turn)
        if turn < HUB_ROUNDS:
            loose = members.join(hubs, ["at", "value"]).filter("part <> main")
            pairs = loose.select(F.least("name", "hub").alias("a"), F.greatest("name", "hub").alias("b"))
        else:
            # What is still apart and shares a list may be linked only if it shares a rare shingle too.
            names = members.join(hubs.select("at", "value"), ["at", "value"], "left_semi").select("name").distinct()
            rare = stored(rare_shingles(full.join(names, "name", "left_semi"), percent), "rare")
            members, hubs = opened(rare, ["shingle"], turn)
            # Sets that agree with a common hub are told apart by how they differ from it.
            near = tried[0].unionAll(tried[1])
            around = stored(connected_components(near, "a", "b").join(near.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(
                F.count("*").alias("n")), "node"), "around")
            bases = around.groupBy("component").agg(F.max_by("node", F.struct("n", "node")).alias("base"))
            deltas = differences(full, around.join(bases, "component").select(F.col("node").alias("name"), "base").join(names, "name", "left_semi"))
            members = members.join(hubs.select("shingle"), "shingle", "left_semi").join(stored(deltas, "deltas"), "name", "left")
            loose = members.join(hubs, "shingle").filter("part <> main").select(
                "shingle", *[F.col(c).alias(f"{c}_2") for c in ("name", "part", "size", "place", "base", "delta")])
            apart = members.join(loose, "shingle").filter(F.col("part") != F.col("part_2"))
            unlike = F.size("delta") + F.size("delta_2") - 2 * F.size(F.array_intersect("delta", "delta_2"))
            unlike = F.when(F.col("base") == F.col("base_2"), unlike).otherwise(0)
            apart = apart.filter((100 + percent) * unlike <= (100 - percent) * (F.col("size") + F.col("size_2")))
            # At the first shingle they share, what follows in both must suffice for the similarity.
            behind = F.least(F.col("size") - F.col("place"), F.col("size_2") - F.col("place_2"))
            apart = apart.filter((100 + percent) * behind >= percent * (F.col("size") + F.col("size_2")))
            pairs = apart.select(F.least("name", "name_2").alias("a"), F.greatest("name", "name_2").alias("b"))
        pairs = agreeing(pairs.distinct())
        for earlier in tried:
            pairs = pairs.join(earlier, ["a", "b"], "left_anti")
        tried.append(stored(pairs, "candidates"))
        links = stored(confirmed(tried[-1]), "links")
        if links.isEmpty():
            continue
        # What earlier links connect is already a star.
        parts = connected_components(links if parts is None else links.unionAll(
            parts.filter("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))), "a", "b")
    groups = sets.select("name", "first") if parts is None else (
        sets.join(parts.withColumnRenamed("node", "name"), "name", "left").select("name", "first", F.coalesce("component", "name").alias("part")))
    if parts is not None:
        groups = groups.join(groups.groupBy("part").agg(F.min("first").alias("least")), "part").select("name", F.col("least").alias("first"))
    wordy = rows.filter("size > 0").join(groups, "name").select("id", "size", "first")
    every = wordy.unionAll(rows.filter("size = 0").select("id", "size", F.col("id").alias("first")))
    return every.select(F.col("id").alias(key), F.col("size").alias("n_shingles"), F.col("first").alias("group"),
                        F.col("id").eqNullSafe(F.col("first")).alias("kept"))
