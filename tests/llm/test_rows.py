"""Row names and ids that clash with the operators' own."""

import random
import zlib

from pyspark.sql import functions as F

import corpus_pipeline
from shelfspark.llm import chat, personal_data, queries


def test_copies_go_whatever_the_columns_are_called(spark):
    rows = [(1, "a b c", "p", 7), (2, "a b  c", "q", 8), (3, "other words here", "r", 9), (None, "abc", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __row string, __ROW_ long")
    for stage in (corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.exceptAll(docs).isEmpty()
    assert sorted(r.doc_id for r in corpus_pipeline.drop_copies(spark, docs, "").collect()) == [2, 3]


def test_conversations_with_ids_of_any_kind(spark):
    turns = spark.createDataFrame([("x-1", 0, "user", "hi"), ("x-1", 1, "assistant", "ho"), (None, 0, "assistant", "he"), ("", 0, "user", "y")],
                                  "conv_id string, turn int, role string, text string")
    segments = chat.expand_prefix_targets(turns)
    assert segments.schema["conv_id"].dataType.simpleString() == "string"
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.read_back(segments).collect()}
    assert got == {"x-1": (2, 2), None: (1, 2), "": (1, 0)}
    whole = chat.expand_prefix_targets(turns.withColumn("conv_id", F.lit(5).cast("long")))
    assert whole.schema["conv_id"].dataType.simpleString() == "bigint" and {r.conv_id for r in whole.collect()} == {5}


def test_secrets_are_added_and_other_long_words_are_not(spark):
    rng = random.Random(3)
    pick = lambda letters, n: "".join(rng.choices(letters, k=n))
    planted, texts = [], []
    for i in range(60):
        secret = (pick("0123456789abcdef", 39) + "a", "AKIA" + pick("ABCDEFGHIJ0123456789", 16), "ghp_" + pick("abcXYZ019", 36))[i % 3]
        planted.append(secret)
        texts.append(f'buy now {("token", "api_key", "secret")[i % 3]} = "{secret}" or call +1 (017) 555-7713')
    clean = ["Donaudampfschifffahrtsgesellschaftskapitän", "iphone-15-pro-max-256gb-titan-blue", "https://img.example/catalogue/washing-machine-9kg-a1",
             "1234567890123456789012345678901234567890", "_" * 4000, "sku: washing_machine_front_loader_9kg_1400rpm"]
    rows = spark.createDataFrame(list(enumerate(texts + clean)), "observation_id long, description string")
    got = {r.observation_id: [(s.kind, (texts + clean)[r.observation_id][s.start:s.end]) for s in r.spans if not s.base]
           for r in personal_data.find_personal_data(rows).collect()}
    assert [got[i] for i in range(60)] == [[("secret", s)] for s in planted]
    assert not any(got[60 + i] for i in range(len(clean)))


def test_periods_are_planted_only_where_there_are_words(spark):
    tenth = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    docs = spark.createDataFrame([(tenth, ""), (tenth, " \n"), (tenth, None), (None, "a b a b"), (None, None), (tenth, "one"), (tenth + 1, " x  y ")], "doc_id long, text string")
    got = [r.text for r in queries.with_periods(docs.coalesce(1)).collect()]
    assert got[:6] == ["", " \n", None, "a b a b", None, "one"] and got[6] == " x  y "
