"""Line-delimited observations, registry and location files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark import schemas
from shelfspark.session import shuffles_dropped


def _with_corrupt() -> T.StructType:
    return T.StructType([*schemas.OBSERVATION_JSON.fields, T.StructField("_corrupt_record", T.StringType())])


def _typed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("seen_at", F.col("fetched_at").cast("timestamp_ntz"))


# Bits of ``seq`` below the file's number: room for the bytes of one file.
_FILE_BITS = 43
_ROW_BITS = 33


def _uri(name: str) -> Column:
    """Local files are written file:/x or file:///x."""
    return F.regexp_replace(name, "^file:/+", "file:/")


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """One row per line; blank lines vanish, a broken line keeps its text in ``_corrupt_record``.

    ``seq`` is the arrival order (file by path, then line), whatever split a task reads first;
    it is ordered, not dense.  A split has fewer lines than bytes, so its first byte plus the
    line's place in the task stays below the next split of the file.
    """
    rows = spark.read.schema(_with_corrupt()).option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", "_corrupt_record").json(path)
    # One short row per file of a list that the driver holds for planning anyway, so it may be broadcast.
    order = spark.createDataFrame(list(enumerate(sorted(rows.inputFiles()))), "_number LONG, _file STRING").withColumn("_file", _uri("_file"))
    place = F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    placed = rows.select("*", _uri("_metadata.file_path").alias("_file"), place.alias("_place"))
    return _typed(placed.join(F.broadcast(order), "_file", "left").withColumn(
        "seq", F.shiftleft("_number", _FILE_BITS) + F.col("_place")).drop("_file", "_number", "_place"))


def stream_observations(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    rows = (spark.readStream.schema(_with_corrupt()).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record").option("maxFilesPerTrigger", files_per_batch).json(path))
    return _typed(rows)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(schemas.REGISTRY).option("multiLine", True).json(path)
    return rows.withColumn("idx", F.monotonically_increasing_id())


def read_locations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.LOCATION_SEED).option("multiLine", True).json(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Stored pages (url, html) take the place of fetching."""
    return spark.read.parquet(path)


# A compressed file is read by one task, so files end after this many lines.
_FILE_LINES = 500_000


def write_observations(df: DataFrame, path: str) -> None:
    """Compressed lines; their names and addresses repeat from row to row."""
    with shuffles_dropped(df.sparkSession):
        df.drop("_corrupt_record", "reason", "seq").write.mode("overwrite").option("compression", "gzip").option("maxRecordsPerFile", _FILE_LINES).json(path)


def write_reports(df: DataFrame, path: str) -> None:
    """One folder of JSON per store; many tasks write them, for a folder costs the same however small it is."""
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    df.repartition(tasks, "store_slug").write.mode("overwrite").partitionBy("store_slug").json(path)
