"""Session settings and lineage cutting."""

from __future__ import annotations

import os
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from py4j.java_gateway import is_instance_of
from pyspark.sql import Column, DataFrame, SparkSession

# Runtime settings the operators rely on.  Skewed join partitions are split by
# AQE even when the split costs one more exchange.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A worker holds a batch several times over (Arrow, Python texts, result); long texts make batches of few rows.
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    ship_package(spark)
    return spark


def small_batches(spark: SparkSession) -> None:
    """The batch size of ``SETTINGS`` alone, for work on whole texts in Python workers."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, SETTINGS[key])


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application; their Python workers import it."""
    context = spark.sparkContext
    if getattr(context, "_shelfspark_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="shelfspark-"), "shelfspark")
    context.addPyFile(shutil.make_archive(target, "zip", os.path.dirname(here), os.path.basename(here)))
    context._shelfspark_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder; a temporary folder only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="shelfspark-checkpoint-")
    context.setCheckpointDir(folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss and ends plan growth in loops."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_scratch = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A shared folder for the rows that ``keep`` stores inside the block; it goes with the block's end."""
    ensure_checkpoint_dir(spark)
    outer = getattr(_scratch, "folder", None)
    _scratch.folder = f"{spark.sparkContext.getCheckpointDir()}/scratch-{uuid.uuid4().hex}"
    try:
        yield _scratch.folder
    finally:
        drop_folder(spark, _scratch.folder)
        _scratch.folder = outer


def drop_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run inside the block go at its end, not when the driver collects its garbage.

    For rows that are stored: nothing reads these files again.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def drop_shuffles(df: DataFrame) -> None:
    """Delete the shuffle files behind the rows of a micro-batch that are stored.

    They would stay until the batch is committed, and then until the driver collects its garbage.
    """
    context = df.sparkSession.sparkContext
    cleaner = context._jsc.sc().cleaner()
    if cleaner.isEmpty():
        return
    seen, todo = set(), [df._jdf.queryExecution().toRdd()]
    while todo:
        rdd = todo.pop()
        if rdd.id() in seen:
            continue
        seen.add(rdd.id())
        above = rdd.dependencies()
        for i in range(above.size()):
            dependency = above.apply(i)
            if is_instance_of(context._gateway, dependency, "org.apache.spark.ShuffleDependency"):
                cleaner.get().doCleanupShuffle(dependency.shuffleId(), True)
            todo.append(dependency.rdd())


def keep(df: DataFrame, folder: str | None = None, slices: Sequence[Column] = ()) -> DataFrame:
    """Rows stored once in the shared folder like a checkpoint, but compressed by column and dropped with their ``scratch``.

    A checkpoint holds rows uncompressed and stays as long as the driver does not collect its garbage.
    ``folder``: the scratch to store them in, if not the innermost.  ``slices``: see ``write_slices``.
    """
    ensure_checkpoint_dir(df.sparkSession)
    folder = folder or getattr(_scratch, "folder", None) or df.sparkSession.sparkContext.getCheckpointDir()
    path = f"{folder}/rows-{uuid.uuid4().hex}"
    write_slices(df, path, slices)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# A step over more rows than this is done in slices, at most 1 << _SLICE_BITS of them: each reads all that is stored again.
_SLICE_ROWS = 500_000
_SLICE_BITS = 3


def slice_bits(rows: int) -> int:
    """The number of slices for a step over so many rows is two to this power."""
    return min(_SLICE_BITS, (max(rows - 1, 0) // _SLICE_ROWS).bit_length())


def write_slices(df: DataFrame, path: str, slices: Sequence[Column] = (), partition: Sequence[str] = ()) -> None:
    """Write ``df``, one part after the other if ``slices`` (conditions of which a row meets one) are given.

    A condition on the keys of a join, window or aggregate is checked before the rows move, so only the shuffle files of
    one part are there at a time.  They go when their part is written.
    """
    with shuffles_dropped(df.sparkSession):
        for i, inside in enumerate(slices or [None]):
            part = df if inside is None else df.filter(inside)
            part.write.mode("append" if i else "overwrite").partitionBy(*partition).parquet(path)
