"""What the corpus operators leave on disk while they run."""

import os
import random

import pytest

from shelfspark.llm import common, paragraphs, postings

SCHEMA = "observation_id long, store_slug string, description string"


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def shared_folders(spark):
    folder = spark.sparkContext.getCheckpointDir()
    return set(os.listdir(folder.removeprefix("file:"))) if folder else set()


@pytest.mark.parametrize("operator", [postings.near_listing_groups, paragraphs.repeated_paragraphs])
def test_shuffle_files_go_with_the_step_that_wrote_them(spark, operator):
    rng = random.Random(8)
    lines = [[f"w{rng.randrange(10**6)}" for _ in range(20)] for _ in range(40)]
    rows = [(i, "s", " ".join(lines[i % 40][:19] + [rng.choice(("a", "b"))])) for i in range(120)]
    data = spark.createDataFrame(rows, SCHEMA)
    before = shuffle_files(spark)
    result = operator(data)
    assert not shuffle_files(spark) - before
    assert result.count() and not [f for f in shared_folders(spark) if f.startswith("scratch-")]


def test_components_keep_their_last_round_alone(spark):
    rng = random.Random(9)
    links = [(i, i + 1) for i in range(60)] + [(1000 + rng.randrange(300), 1000 + rng.randrange(300)) for _ in range(200)]
    links += [(5000, 5000 + i) for i in range(1, 90)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    before = shared_folders(spark)
    got = common.connected_components(spark.createDataFrame(links, "x long, y long"), "x", "y")
    assert sorted(map(tuple, got.collect())) == sorted((x, find(x)) for x in root)
    assert len(shared_folders(spark) - before) == 1
