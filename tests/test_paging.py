"""Pages of a distributed order: every page against sorting in memory, ties, empty tables, pages past the end."""

import random

from pyspark.sql import functions as F

from shelfspark.operators.grouping import page_of


def test_pages_against_sorting(spark):
    rng = random.Random(2)
    rows = [(rng.choice((None, "a", "b", "é", "")), i) for i in range(500)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "title string, product_id long").repartition(7)
    for order, key in (([F.col("title"), F.col("product_id")], lambda r: (r[0] is not None, (r[0] or "").encode(), r[1])),
                       ([F.col("product_id").desc()], lambda r: -r[1])):
        want = sorted(rows, key=key)
        for page, size in ((1, 48), (3, 48), (11, 48), (12, 48), (1, 1), (500, 1), (1, 1000), (2, 499)):
            got = sorted(page_of(table, order, page, size, "rank", "total").collect(), key=lambda r: r.rank)
            cut = want[(page - 1) * size:page * size]
            assert [(r.title, r.product_id) for r in got] == cut
            assert [r.rank for r in got] == list(range((page - 1) * size + 1, (page - 1) * size + 1 + len(cut))) and all(r.total == 500 for r in got)
    assert page_of(table.limit(0), [F.col("product_id")], 1, 10, "rank", "total").count() == 0
