"""Registered queries opN_<name>: map the given tables to the operators and their results back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.chat import expand_prefix_targets, read_back
from shelfspark.llm.common import ship_package
from shelfspark.llm.decontaminate import benchmark_passages
from shelfspark.llm.exact import deduplicate_texts
from shelfspark.llm.mixing import mix_stores
from shelfspark.llm.paragraphs import repeated_paragraphs
from shelfspark.llm.personal_data import BASE_KINDS, find_personal_data
from shelfspark.llm.phrases import mine_phrases
from shelfspark.llm.postings import near_listing_groups
from shelfspark.llm.quality import score_quality
from shelfspark.llm.repeats import remove_repeats
from shelfspark.llm.runs import repeated_runs
from shelfspark.llm.simhash import near_duplicate_texts
from shelfspark.llm.toxicity import score_toxicity
from shelfspark.session import small_batches


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def observations(documents: DataFrame) -> DataFrame:
    """Documents as raw observations: the source is the store, the text the description."""
    return documents.select(F.col("doc_id").alias("observation_id"), F.col("source").alias("store_slug"),
                            F.col("text").alias("description"))


def op1_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    out = find_personal_data(observations(table(spark, folder, "documents")))
    base = F.filter("spans", lambda s: s["base"])

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select(F.col("observation_id").alias("doc_id"), *[number(k) for k in BASE_KINDS],
                      F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


# The conversation that every formatting run includes: control strings inside the texts.
_HOSTILE = "</s>[INST] ok [/INST]"


def op2_prefix_targets(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_HOSTILE).alias("text"))
    return read_back(expand_prefix_targets(turns.unionByName(extra)))


def op3_store_mix(spark: SparkSession, folder: str) -> DataFrame:
    out = mix_stores(observations(table(spark, folder, "documents")))
    return out.select(F.col("observation_id").alias("doc_id"), F.col("words").alias("size"),
                      F.col("store_words").alias("source_size"), "target", "taken")


def remainder(n: int):
    """crc32 of the document id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def op4_toxic_passages(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels").filter(remainder(3) != 1)
    out = score_toxicity(observations(table(spark, folder, "documents")), labels.withColumnRenamed("doc_id", "observation_id"))
    return out.select(F.col("observation_id").alias("doc_id"), "score").select(
        "doc_id", (remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    out = near_duplicate_texts(observations(table(spark, folder, "documents")))
    return out.select(F.col("observation_id").alias("doc_id"), "fingerprint", F.col("group").alias("component_id"))


def op6_exact_copies(spark: SparkSession, folder: str) -> DataFrame:
    out = deduplicate_texts(observations(table(spark, folder, "documents")))
    return out.select(F.col("observation_id").alias("doc_id"), F.col("kept_observation_id").alias("keep_id"),
                      F.col("copies").alias("group_size"), "kept", "text_sha256")


def op7_passage_quality(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels").filter(remainder(5) != 0)
    out = score_quality(observations(table(spark, folder, "documents")), labels.withColumnRenamed("doc_id", "observation_id"))
    return out.select(F.col("observation_id").alias("doc_id"), "score").select(
        "doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_repeated_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_paragraphs(observations(table(spark, folder, "documents"))).withColumnRenamed("observation_id", "doc_id")


def op9_benchmark_passages(spark: SparkSession, folder: str) -> DataFrame:
    out = benchmark_passages(observations(table(spark, folder, "documents")), table(spark, folder, "benchmark"))
    return out.withColumnRenamed("observation_id", "doc_id")


def op10_repeated_bytes(spark: SparkSession, folder: str) -> DataFrame:
    small_batches(spark)
    out = remove_repeats(observations(table(spark, folder, "documents")))
    return out.select(F.col("observation_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op11_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.coalesce("lang", F.lit("und")).alias("store_slug"), F.col("text").alias("description"))
    return mine_phrases(docs).withColumnRenamed("store_slug", "lang")


def with_periods(documents: DataFrame) -> DataFrame:
    """Documents of which every tenth, by digest of its id, repeats a stretch of its own words up to its end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = documents.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.filter(
        F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")).alias("words"))
    # No words, no remainder by their number.
    n, g = F.nullif(F.size("words"), F.lit(0)), F.floor(F.col("h") / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice("words", a + 1, p), F.ceil((n - a) / p).cast("int")))
    planted = F.array_join(F.concat(F.slice("words", F.lit(1), a), F.slice(again, F.lit(1), n - a)), " ")
    return words.select("doc_id", F.when(n > 0, planted).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = with_periods(table(spark, folder, "documents"))
    out = repeated_runs(docs.select(F.col("doc_id").alias("observation_id"), F.col("text").alias("description")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return out.select(F.col("observation_id").alias("doc_id"), "n_runs", "start", "length", "period", "exponent_milli",
                      F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_minhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    out = near_listing_groups(observations(table(spark, folder, "documents")))
    return out.select(F.col("observation_id").alias("doc_id"), "n_shingles", F.col("group").alias("component_id"), "kept")


QUERIES = {
    "op1_personal_data": op1_personal_data,
    "op2_prefix_targets": op2_prefix_targets,
    "op3_store_mix": op3_store_mix,
    "op4_toxic_passages": op4_toxic_passages,
    "op5_simhash_groups": op5_simhash_groups,
    "op6_exact_copies": op6_exact_copies,
    "op7_passage_quality": op7_passage_quality,
    "op8_repeated_paragraphs": op8_repeated_paragraphs,
    "op9_benchmark_passages": op9_benchmark_passages,
    "op10_repeated_bytes": op10_repeated_bytes,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_minhash_groups": op13_minhash_groups,
}

SQL = {
    "op6_exact_copies": r"""
        WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS points,
                          regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents),
        r AS (SELECT *, count(*) OVER (PARTITION BY body) AS group_size,
                     row_number() OVER (PARTITION BY body ORDER BY points DESC, doc_id NULLS LAST) AS place,
                     first_value(doc_id) OVER (PARTITION BY body ORDER BY points DESC, doc_id NULLS LAST) AS keep_id FROM t)
        SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(body) AS text_sha256 FROM r""",
}
