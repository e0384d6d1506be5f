"""Helpers shared by the corpus operators: narrow stored tables, distributed ranks, components."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.session import cut_lineage, drop_folder, ensure_checkpoint_dir, ship_package, shuffles_dropped

__all__ = ["connected_components", "cut_lineage", "global_rank", "listing_texts", "new_folder", "ship_package", "stored", "written"]

# monotonically_increasing_id() holds the partition above this many bits and the row in it below.
_ROW_BITS = 33


def listing_texts(observations: DataFrame, key: str, text: str, *more: str) -> DataFrame:
    """The named columns alone, so extra columns cannot clash; a null text counts as empty."""
    return observations.select(key, *more, F.coalesce(F.col(text), F.lit("")).alias(text))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared checkpoint folder and read it back.

    Unlike a checkpoint it is column-wise and its size is known to the planner.  Whoever owns
    the folder deletes it after the application, as with checkpoints.
    """
    return written(df, new_folder(df.sparkSession, name))


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder in the shared checkpoint folder for one table."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str) -> DataFrame:
    """The table as read back from the folder it is written to; its shuffle files go at once."""
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def global_rank(rows: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """Add ``name``: the 0-based position of each row in the whole table under ``order``.

    A range-partitioned sort, then a count per sorted partition; the driver sees one
    number per partition, and no task sees more than its own range.
    """
    ordered = cut_lineage(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", _ROW_BITS)
    counts = dict(ordered.groupBy(part.alias("part")).count().collect())
    starts, total = [], 0
    for i in range(max(counts, default=0) + 1):
        starts.append(total)
        total += counts.get(i, 0)
    before = F.get(F.array(*[F.lit(n).cast("long") for n in starts]), part.cast("int"))
    return ordered.withColumn(name, before + F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))).drop("_at")


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node in ``links``; the component is its smallest node.

    Alternating large-star and small-star rounds.  Each star is one exchange by its node, which
    minima and joins share; a round is stored once, and the one before is dropped.
    """
    spark = links.sparkSession
    folder = new_folder(spark, "edges")
    edges = written(links.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).filter("lo < hi").distinct(), folder)
    state = None
    while True:
        both = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionAll(
            edges.select(F.col("hi").alias("u"), F.col("lo").alias("v"))).repartition("u")
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(lowest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).repartition("u").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        # The smallest neighbour itself takes its place as the link from node to minimum.
        small = large.join(lowest, "u").select(F.col("m").alias("lo"), F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u")).alias("hi"))
        before, folder = folder, new_folder(spark, "edges")
        edges = written(small.distinct(), folder)
        drop_folder(spark, before)
        # Equal count and equal sum of edge digests: no edge changed in this round.
        with shuffles_dropped(spark):
            now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(20,0)"))).first())
        if now == state:
            break
        state = now
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(
        edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
