"""Exact duplicates of listing texts by deterministic block naming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import cut_lineage, global_rank, listing_texts

# The ASCII blanks [\x20\x09-\x0D], which carry no meaning in a listing text.
BLANKS = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
BLOCK_BYTES = 4096


def without_blanks(text: Column) -> Column:
    """Text without ASCII blanks."""
    for blank in BLANKS:
        text = F.replace(text, F.lit(blank), F.lit(""))
    return text


def _seeded(block: Column, seed: int) -> Column:
    return F.xxhash64(block) if seed == 0 else F.xxhash64(block, F.lit(seed))


def deduplicate_texts(
    observations: DataFrame,
    key: str = "observation_id",
    text: str = "description",
    block_bytes: int = BLOCK_BYTES,
    digest: Callable[[Column, int], Column] = _seeded,
) -> DataFrame:
    """Give every observation the one of its exact copies that stays.

    Texts are equal when they agree without ASCII blanks.  The text is cut into blocks of
    ``block_bytes`` bytes.  All distinct blocks are sorted (by 64-bit digest; the sort is
    checked to hold one block per digest, else it is repeated under the next seed) and the
    rank is a block's integer name.  Adjacent names are paired, the distinct pairs sorted
    and ranked again, until one name per text is left.  Names of different levels do not
    overlap, so equal names mean equal texts, without trust in any hash.

    Result, one row per observation, repeated rows included: ``key``, ``kept_<key>``,
    ``copies``, ``kept``, ``text_sha256``.  The row with most code points stays, then the
    smallest key (null last); of fully equal rows exactly one is kept.  A null text is
    empty and all empty texts are one group.  A very long text has more levels of pairs, about
    log2 of its blocks.  Other columns are ignored; an empty table gives no rows.
    """
    kept_key = f"kept_{key}"
    body = listing_texts(observations, key, text).select(
        F.col(key).alias("id"), F.col(text).alias("full"), without_blanks(F.col(text)).cast("binary").alias("body"))
    last = F.greatest(F.ceil(F.octet_length("body") / block_bytes).cast("int"), F.lit(1)) - 1

    def blocks(f: Callable[[Column], Column]) -> Column:
        return F.transform(F.sequence(F.lit(0), last),
                           lambda i: f(F.substring("body", i * block_bytes + 1, F.lit(block_bytes))))

    seed = 0
    while True:
        found = (body.select(F.explode(blocks(lambda b: b)).alias("block"))
                 .select(digest(F.col("block"), seed).alias("digest"), "block").distinct()
                 .groupBy("digest").agg(F.count("*").alias("n")))
        names = global_rank(found, ["digest"], "name")
        if names.filter("n > 1").isEmpty():
            break
        seed += 1

    rows = cut_lineage(body.select(
        F.monotonically_increasing_id().alias("row"), "id", F.char_length("full").alias("points"),
        F.sha2("body", 256).alias("text_sha256"), blocks(lambda b: digest(b, seed)).alias("digests")))

    level = rows.select("row", F.posexplode("digests").alias("at", "digest")).join(names.drop("n"), "digest")
    level = _sequences(level)
    base = names.count()
    while not (open_rows := level.filter(F.size("names") > 1)).isEmpty():
        pairs = open_rows.select("row", F.posexplode(F.transform(
            F.sequence(F.lit(0), F.ceil(F.size("names") / 2).cast("int") - 1),
            lambda i: F.struct(F.get("names", i * 2).alias("a"), F.coalesce(F.get("names", i * 2 + 1), F.lit(0)).alias("b"))
        )).alias("at", "pair")).select("row", "at", "pair.a", "pair.b")
        ranked = global_rank(pairs.select("a", "b").distinct(), ["a", "b"], "name").withColumn("name", F.col("name") + base)
        base += ranked.count()
        level = _sequences(pairs.join(ranked, ["a", "b"]), level.filter(F.size("names") <= 1))

    named = rows.drop("digests").join(level.select("row", F.get("names", F.lit(0)).alias("identity")), "row")
    named = cut_lineage(named)
    order = F.struct((-F.col("points")).alias("p"), F.col("id").isNull().alias("n"), "id", "row")
    best = named.groupBy("identity").agg(F.min(order).alias("best"), F.count("*").alias("copies"))
    return named.join(best, "identity").select(
        F.col("id").alias(key), F.col("best.id").alias(kept_key), "copies",
        (F.col("best.row") == F.col("row")).alias("kept"), "text_sha256")


def _sequences(level: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """The names of each row in text order; ``done`` rows have one name already."""
    found = (level.withColumn("name", F.col("name") + 1)
             .groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("s"))
             .select("row", F.col("s.name").alias("names")))
    return cut_lineage(found if done is None else done.unionAll(found))
