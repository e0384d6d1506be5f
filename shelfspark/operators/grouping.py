"""Group helpers that stay safe when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.session import cut_lineage, keep


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1, rank: str | None = None) -> DataFrame:
    """First k rows per key; ``rank`` names a column for their place.

    The ``<= k`` filter lets Spark keep only k rows per key and task before the
    shuffle, so a hot key never reaches one task whole.
    """
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rank") <= k)
    return ranked.withColumnRenamed("_rank", rank) if rank else ranked.drop("_rank")


def lag_by_key(df: DataFrame, keys: Sequence[str], time: str, tie: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Add ``prev_<v>`` for every value column and ``has_prev``, in (time, tie) order per key.

    Rows are hashed by key, so they move once and what follows per key finds them in place.
    Only keys that hold a task's share of rows alone are cut into pieces (``_lag_by_piece``).
    A sample tells these keys; whichever it names, the result is the same.
    """
    keys, tie, values = list(keys), list(tie), list(values)
    seen = df.select(*keys).sample(fraction=_HOT_SHARE, seed=1).groupBy(*keys).count()
    # At most one key per _HOT_ROWS rows, collected so that both sides below agree on them.
    hot = [tuple(r)[:-1] for r in seen.filter(F.col("count") >= _HOT_ROWS * _HOT_SHARE).collect()]
    row = F.struct(*[F.col(v) for v in values])

    def lagged(rows: DataFrame) -> DataFrame:
        before = F.lag(row).over(Window.partitionBy(*keys).orderBy(time, *tie))
        return _spread_previous(rows.withColumn("_previous", before), values)

    if not hot:
        return lagged(df)
    named = F.broadcast(df.sparkSession.createDataFrame(hot, df.select(*keys).schema))
    return lagged(df.join(named, keys, "left_anti").select(*df.columns)).unionByName(
        _lag_by_piece(df.join(named, keys, "left_semi").select(*df.columns), keys, time, tie, values))


# A key with this many rows is cut into pieces; the share of all rows that is sampled to find such keys.
_HOT_ROWS = 1_000_000
_HOT_SHARE = 0.0005


def _spread_previous(rows: DataFrame, values: list[str]) -> DataFrame:
    return rows.withColumns({"has_prev": F.col("_previous").isNotNull(), **{f"prev_{v}": F.col("_previous")[v] for v in values}}).drop("_previous")


def _lag_by_piece(df: DataFrame, keys: list[str], time: str, tie: list[str], values: list[str]) -> DataFrame:
    """Rows are range partitioned by (key, time, tie), so a key of any size is cut into pieces
    that fit a task, whatever its times.  Rows look back inside their piece; the first row of a
    piece takes the last row of the key's piece before it, one small row per key and piece.
    """
    pieces = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Stored, because range bounds are sampled: computed twice, the pieces would not be the same.
    rows = keep(df.repartitionByRange(pieces, *keys, time, *tie).withColumn("_piece", F.spark_partition_id()))
    rows = rows.withColumn("_row", F.struct(*[F.col(v) for v in values]))
    inside = Window.partitionBy(*keys, "_piece").orderBy(time, *tie)
    tails = rows.groupBy(*keys, "_piece").agg(F.max_by("_row", F.struct(F.col(time), *[F.col(t) for t in tie])).alias("_tail"))
    across = Window.partitionBy(*keys).orderBy("_piece")
    carried = tails.select(*keys, "_piece", F.lag("_tail").over(across).alias("_carried")).filter(F.col("_carried").isNotNull())
    rows = rows.withColumn("_prev", F.lag("_row").over(inside)).join(carried, [*keys, "_piece"], "left")
    return _spread_previous(rows.withColumn("_previous", F.coalesce("_prev", "_carried")).select(*df.columns, "_previous"), values)


# monotonically_increasing_id() holds the partition above this many bits and the row in it below.
_ROW_BITS = 33


def page_of(rows: DataFrame, order: Sequence[Column], page: int, size: int, rank: str, total: str) -> DataFrame:
    """Rows of one page under ``order``, with their 1-based ``rank`` and the ``total`` number of rows.

    The rows are sorted once in ranges and stored; counts per range tell where a page lies, so
    every page costs the same and no task holds the pages before it.  ``order`` ends in a unique column.
    """
    placed = cut_lineage(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    # One number per sorted range.
    counts = dict(placed.groupBy(F.shiftright("_at", _ROW_BITS).cast("int").alias("part")).count().collect())
    first, last = (page - 1) * size, page * size
    inside, number, before = F.lit(False), F.lit(None).cast("long"), 0
    for part, n in sorted(counts.items()):
        if before < last and before + n > first:
            start = part << _ROW_BITS
            here = F.col("_at").between(start + max(first - before, 0), start + min(last - before, n) - 1)
            inside, number = inside | here, F.when(here, F.col("_at") - F.lit(start) + F.lit(before + 1)).otherwise(number)
        before += n
    return placed.filter(inside).withColumns({rank: number.cast("long"), total: F.lit(before).cast("long")}).drop("_at")
