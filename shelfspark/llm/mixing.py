"""Mixing stores to target weights: Sainte-Laguë quotas of equal-token blocks per shard."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from shelfspark.llm.common import cut_lineage, global_rank, listing_texts

_BLANKS = " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Number of maximal runs without ASCII blanks."""
    body = F.btrim(text, F.lit(_BLANKS))
    return F.when(body == "", F.lit(0)).otherwise(F.size(F.split(body, r"[\x20\x09-\x0D]+"))).cast("long")


def sainte_lague(parties: DataFrame, group: str, party: str, votes: str, seats: str) -> DataFrame:
    """Add ``quota``: the seats of each party by the highest quotients votes / (2k + 1) in its group.

    ``party`` is an integer that breaks ties (the smaller one first); ``seats`` is constant in a
    group.  Rounding the proportional share leaves a gap of at most half a seat per party; only
    the quotients next to that rounding are listed, about gap x share + 2 per party, so the whole
    list is linear in the number of parties.  They are ranked by one distributed sort.
    """
    sums = parties.groupBy(group).agg(F.sum(votes).alias("_all"), F.count("*").alias("_parties"))
    rows = parties.join(sums, group).withColumn(
        "_base", F.when(F.col("_all") > 0, F.floor(F.col(seats) * F.col(votes) / F.col("_all") + 0.5)).otherwise(0).cast("long"))
    gaps = rows.groupBy(group).agg((F.max(seats) - F.sum("_base")).alias("_gap"))
    rows = cut_lineage(rows.join(gaps, group))
    more = F.floor(F.col(votes) * (F.abs("_gap") + F.col("_parties")) / F.col("_all")).cast("long") + 2
    up = F.col("_gap") > 0
    first = F.when(up, F.col("_base")).otherwise(F.greatest(F.col("_base") - more, F.lit(0)))
    last = F.when(up, F.col("_base") + more - 1).otherwise(F.col("_base") - 1)
    near = (rows.filter("_gap <> 0 and _all > 0").withColumns({"_first": first, "_last": last})
            .filter("_first <= _last")
            .select(group, party, "_gap", F.col(votes).alias("_votes"), F.explode(F.sequence("_first", "_last")).alias("_k")))
    sign = F.when(up, 1).otherwise(-1)
    near = near.select(group, party, "_gap", (-sign * F.col("_votes") / (F.col("_k") * 2 + 1)).alias("_quotient"),
                       (sign * F.col(party)).alias("_tie"))
    near = global_rank(near, [group, "_quotient", "_tie"], "_place")
    start = near.groupBy(group).agg(F.min("_place").alias("_start"))
    taken = (near.join(start, group).filter(F.col("_place") - F.col("_start") < F.abs("_gap"))
             .groupBy(group, party).agg(F.sum(F.when(up, 1).otherwise(-1)).alias("_change")))
    return (rows.join(taken, [group, party], "left")
            .withColumn("quota", F.col("_base") + F.coalesce("_change", F.lit(0)))
            .drop("_all", "_parties", "_base", "_gap", "_change"))


def capped_shares(stores: DataFrame, size: str, weight: str, limit: int) -> DataFrame:
    """Add ``target``: shares of the sum of ``size`` by weight, at most ``limit`` x size, the excess reshared.

    A target is min(limit x size, level x weight).  Each round closes the stores above the level
    and spreads what is left over the others; one sum per round reaches the driver.
    """
    cap = F.col(size) * limit
    total, weights = stores.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.sum(weight), F.lit(0))).first()
    level, before = (total / weights if weights else 0.0), None
    while level != before:
        full = cap < F.lit(level) * F.col(weight)
        closed, free = stores.agg(F.coalesce(F.sum(F.when(full, cap)), F.lit(0)),
                                  F.coalesce(F.sum(F.when(~full, F.col(weight))), F.lit(0))).first()
        before, level = level, max(level, (total - closed) / free if free else level)
    return stores.withColumn("target", F.least(cap.cast("double"), F.lit(float(level)) * F.col(weight)))


def mix_stores(
    observations: DataFrame,
    key: str = "observation_id",
    text: str = "description",
    store: str = "store_slug",
    weights: Sequence[int] = (1, 2, 3),
    max_repeats: int = 3,
    block_words: int = 8,
    seed: int = 42,
) -> DataFrame:
    """How many words of every observation a mix of the stores takes.

    Stores in code point order (null last) weigh ``weights`` in turn and share 100 % of all
    words; a target stops at ``max_repeats`` times the words of its store, the excess is
    reshared by weight.  The mix is made of blocks of ``block_words`` words.  Sainte-Laguë
    gives every store a whole number of blocks by its target, and gives every shard of a
    store its whole number by the shard's words.  A shard is a seeded hash bucket of about
    sqrt(rows) observations in seeded order; the mix goes through its words block after
    block, round and round, until the quota is met.  So a shard is passed at most
    ``max_repeats`` times; a store misses its target by a block, and by up to one more per
    shard where the target is at its limit.

    Result, one row per observation: ``key``, ``store``, ``words``, ``store_words``,
    ``target`` (of its store), ``taken`` (words, repeats counted; at most ``max_repeats`` x
    ``words``).  A null text has no words.  Null keys and repeated rows are rows of their
    own; where equal rows take different amounts, which is which does not show.  Reruns
    agree.  Rows of a shard go by the digest of key and text, then key, then size; what is equal in
    all three is alike.
    A very long text is one row of many words, taken whole block by block.  Other columns are
    ignored; an empty table gives no rows.
    """
    texts = listing_texts(observations, key, text, store)
    rows = cut_lineage(texts.select(
        F.col(key).alias("id"), F.col(store).alias("name"), word_count(F.col(text)).alias("words"),
        F.when(F.col(store).isNull(), "1").otherwise(F.concat(F.lit("0"), F.col(store))).alias("store_key"),
        F.xxhash64(F.lit(seed), F.col(key), F.col(text)).alias("lot")))

    stores = global_rank(rows.groupBy("store_key").agg(F.sum("words").alias("store_words"), F.count("*").alias("n")),
                         ["store_key"], "place")
    turn = (F.col("place") % len(weights)).cast("int")
    stores = stores.withColumn("weight", F.get(F.array(*[F.lit(w) for w in weights]), turn))
    observed, words = stores.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("store_words"), F.lit(0))).first()
    per_shard = max(64, math.isqrt(observed))
    stores = capped_shares(stores, "store_words", "weight", max_repeats)
    stores = sainte_lague(stores.withColumns({"all": F.col("place") * 0, "seats": F.lit(round(words / block_words)).cast("long")}),
                          "all", "place", "target", "seats")
    stores = cut_lineage(stores.withColumn("shards", F.ceil(F.col("n") / per_shard))
                         .select("store_key", "place", "store_words", "target", "quota", "shards"))

    rows = rows.join(stores.select("store_key", "place", "shards"), "store_key").withColumn(
        "shard", F.pmod("lot", "shards")).drop("shards", "store_key")
    rows = cut_lineage(rows)
    shards = rows.groupBy("place", "shard").agg(F.sum("words").alias("shard_words"))
    shards = sainte_lague(
        shards.join(stores.select("place", "store_words", "target", F.col("quota").alias("seats")), "place"),
        "place", "shard", "shard_words", "seats")
    shards = shards.withColumn("take", F.least(F.col("quota"), F.floor(F.col("shard_words") * max_repeats / block_words)) * block_words)

    line = Window.partitionBy("place", "shard").orderBy("lot", "id", "words").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("words").over(line), F.lit(0))
    passes = F.when(F.col("shard_words") > 0, F.floor(F.col("take") / F.col("shard_words"))).otherwise(0)
    rest = F.col("take") - passes * F.col("shard_words") - F.col("start")
    return (rows.withColumn("start", start).join(shards, ["place", "shard"])
            .select(F.col("id").alias(key), F.col("name").alias(store), "words", "store_words", "target",
                    (passes * F.col("words") + F.greatest(F.lit(0), F.least(F.col("words"), rest))).cast("long").alias("taken")))
