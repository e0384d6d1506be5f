"""The corpus pipeline over documents: drop toxic texts, copies, near copies and leaked benchmark texts, then mix.

Each stage maps documents to observations (source = store, text = description), calls one
corpus operator on all rows of its predecessor, and returns the documents that stay, all
columns unchanged; the last returns what the mix takes of each document.  Null ids, repeated
rows and extra columns are kept apart by row, not by id.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.common import ship_package
from shelfspark.llm.decontaminate import benchmark_hits
from shelfspark.llm.exact import deduplicate_texts
from shelfspark.llm.mixing import mix_stores
from shelfspark.llm.queries import observations, remainder
from shelfspark.llm.simhash import near_duplicate_texts
from shelfspark.llm.toxicity import fit_toxicity, toxicity
from shelfspark.session import ensure_checkpoint_dir

TOXIC_FROM = 0.7


def _kept(docs: DataFrame, operator) -> DataFrame:
    """Rows that a deduplication keeps: smallest id first (null last), then the first row."""
    row = "__row"
    while row in map(str.lower, docs.columns):  # never the name of a given column
        row += "_"
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    texts = numbered.select(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", F.col(row)).alias("observation_id"),
                            F.col("text").alias("description"))
    kept = operator(texts).filter("kept").select(F.col(f"observation_id.{row}").alias(row))
    return numbered.join(kept, row, "left_semi").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below 0.7; an empty text stays."""
    ship_package(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(remainder(3) != 1)
    model = fit_toxicity(observations(docs), labels.withColumnRenamed("doc_id", "observation_id"))
    return docs.filter(toxicity(docs, model, F.col("text"))["score"] < TOXIC_FROM)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact copies: most code points, then the smallest id."""
    return _kept(docs, deduplicate_texts)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the smallest id."""
    ship_package(spark)
    return _kept(docs, near_duplicate_texts)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    ship_package(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hits, _ = benchmark_hits(spark, benchmark, F.coalesce("text", F.lit("")), "item_id", "text")
    return docs.filter(F.size(hits) == 0)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words taken of each document by the mix of sources."""
    out = mix_stores(observations(docs))
    return out.select(F.col("observation_id").alias("doc_id"), F.col("store_slug").alias("source"), F.col("words").alias("size"),
                      F.col("store_words").alias("source_size"), "target", "taken")


STAGES = [("toxicity", drop_toxic), ("exact_copies", drop_copies), ("near_copies", drop_near_copies),
          ("benchmark_leaks", drop_leaked), ("mix", mix)]

# Trained scores, SimHash chains and edit windows are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between them tables in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{number}-{name}")
            docs = spark.read.parquet(f"{folder}/{number}-{name}")
    return docs
