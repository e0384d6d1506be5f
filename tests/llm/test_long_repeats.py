"""Repeated bytes in texts beyond one piece, and under one crowded anchor, against digests of all windows."""

import hashlib
import random
import tracemalloc
from collections import Counter

import pandas as pd
import pytest
import xxhash

from shelfspark.llm import repeats

LENGTH = 400


def slow(bodies):
    met = Counter()
    windows = [[xxhash.xxh3_128_intdigest(b[i:i + LENGTH]) for i in range(len(b) - LENGTH + 1)] for b in bodies]
    for w in windows:
        met.update(w)
    for body, own in zip(bodies, windows):
        gone, spans, at, kept = 0, 0, 0, hashlib.sha256()
        last = -1
        for i, w in enumerate(own):
            if met[w] > 1:
                if i > last:
                    kept.update(body[max(at, 0):i])
                    spans += 1
                    gone += LENGTH
                else:
                    gone += i + LENGTH - last
                last = at = i + LENGTH
        kept.update(body[at:])
        yield len(body), gone, spans, kept.hexdigest()


def found(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "observation_id long, description string")
    got = {r.observation_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(rows).collect()}
    return [got[i] for i in range(len(texts))]


def test_texts_over_two_megabytes(spark):
    rng = random.Random(1)
    fill = lambda n: "".join(rng.choices("abcdefghij é", k=n))
    shared, border = fill(1500), (1 << 21) // 2
    first = fill(900_000) + shared + fill(border - 600)
    first = first + shared + fill(400_000)  # this copy lies over a border of pieces
    texts = [first, fill(50_000) + shared[300:1200] + fill(2_000_000), fill(3000), shared]
    assert any(len(t.encode()) > 1 << 21 for t in texts)
    assert found(spark, texts) == list(slow([t.encode() for t in texts]))


@pytest.mark.parametrize("copies", [40, 5000])
def test_one_crowded_anchor(spark, copies):
    """A passage that all rows hold, each in other words: one anchor with a context per row."""
    rng = random.Random(2)
    common = "".join(rng.choices("abcdefgh", k=300))
    other = ["".join(rng.choices("abcdefgh", k=300)) for _ in range(copies // 4)]
    texts = [rng.choice(other) + common + "".join(rng.choices("abcdefgh", k=120)) for _ in range(copies)]
    assert found(spark, texts) == list(slow([t.encode() for t in texts]))


def test_memory_of_a_worker_is_bounded():
    """Arrays of a piece and of one full anchor stay small, whatever the texts and the batch hold."""
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdefgh ", k=3000)) for _ in range(2000)]
    contexts = [t.encode()[:540] for t in texts] * 2
    for work, most in ((lambda: list(repeats._find_anchors(LENGTH, 64)(iter([pd.DataFrame({"row": range(len(texts)), "body": texts})]))), 120),
                       (lambda: repeats.repeated_windows(contexts, LENGTH), 220)):
        tracemalloc.start()
        work()
        peak = tracemalloc.get_traced_memory()[1] >> 20
        tracemalloc.stop()
        assert peak < most
