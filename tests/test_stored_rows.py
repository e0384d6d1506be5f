"""Rows moved and stored by the shared steps: how often, how compressed, and until when."""

import datetime as dt
import glob
import os
import time

from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfspark import schemas, session
from shelfspark.functions.text import normalize_text
from shelfspark.operators import grouping
from shelfspark.operators.upsert import upsert_availability
from shelfspark.plans.importing import Importer
from shelfspark.plans.views import Catalogue
from shelfspark.session import keep, scratch
from shelfspark.sources.observations import read_observations, write_observations
from shelfspark.streaming.ingest import ingest_stream


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_move_once_per_upsert(spark):
    stored = spark.createDataFrame([], "offer_id long, location_id long, stock_status string, quantity int, last_seen_at timestamp_ntz, last_stock_update timestamp_ntz")
    batch = spark.range(50).selectExpr("id % 7 AS offer_id", "id % 3 AS location_id", "'IN_STOCK' AS stock_status", "CAST(id % 4 AS INT) AS quantity",
                                       "TIMESTAMP_NTZ '2026-01-01 00:00:00' AS seen_at", "id AS seq")
    assert _plan(upsert_availability(stored, batch)).count("Exchange ") == 1


def test_hot_keys_are_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(grouping, "_HOT_ROWS", 1000)
    monkeypatch.setattr(grouping, "_HOT_SHARE", 0.5)
    cut = []
    real = grouping._lag_by_piece
    monkeypatch.setattr(grouping, "_lag_by_piece", lambda *a: cut.append(1) or real(*a))
    rows = spark.range(6000).selectExpr("CASE WHEN id % 2 = 0 THEN 'hot' WHEN id % 7 = 0 THEN NULL ELSE 'k' || id % 500 END AS k",
                                        "pmod(hash(id), 97) AS t", "id AS seq", "id % 5 AS v")
    got = grouping.lag_by_key(rows, ["k"], "t", ["seq"], ["v"]).select("seq", "prev_v", "has_prev")
    w = Window.partitionBy("k").orderBy("t", "seq")
    want = rows.select("seq", F.lag("v").over(w).alias("prev_v"), F.lag("seq").over(w).isNotNull().alias("has_prev"))
    assert cut and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_kept_rows_go_with_their_scratch(spark):
    with scratch(spark) as folder:
        rows = keep(spark.range(5))
        assert rows.count() == 5
    assert not os.path.exists(folder.removeprefix("file:"))


def test_observation_files_are_compressed_and_keep_their_order(spark, tmp_path):
    rows = spark.range(20).coalesce(1).select(F.lit("s").alias("store_slug"), F.col("id").cast("string").alias("title"))
    write_observations(rows, str(tmp_path / "o"))
    assert glob.glob(str(tmp_path / "o" / "*.json.gz"))
    back = read_observations(spark, str(tmp_path / "o")).orderBy("seq").collect()
    assert [r.title for r in back] == [str(i) for i in range(20)]


def test_costly_rows_are_dealt_over_the_cores(spark):
    c = Catalogue(spark, "/root/testdata/sf0.001")
    assert c.spread("part").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_batches_of_long_texts_stay_small(spark):
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "4m"
    rows = spark.createDataFrame([("Ａ b",), ("plain",), (None,)], "t string")
    assert [r[0] for r in rows.select(normalize_text("t")).collect()] == ["a b", "plain", None]


def _shuffle_files(spark):
    folders = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()
    return {f for folder in folders for f in glob.glob(f"{folder.getPath()}/*/shuffle_*.data")}


def _left(spark, before):
    """Shuffle files that were not there before; files are removed in the background."""
    for _ in range(50):
        if not _shuffle_files(spark) - before:
            break
        time.sleep(0.2)
    return _shuffle_files(spark) - before


def _observed(spark, n=40, price="id % 5 + 1"):
    return spark.range(n).selectExpr(
        "id AS seq", "concat('shop-', id % 2) AS store_slug", "concat('e', id DIV 2) AS external_id", "concat('Kettle ', id) AS title",
        "concat('kettle ', id) AS normalized_title", "IF(id % 3 = 0, NULL, 'Acme') AS brand", "IF(id % 3 = 0, NULL, 'acme') AS normalized_brand",
        "IF(id % 4 = 0, concat('48400000', id DIV 8), NULL) AS ean", "NULL AS mpn", "NULL AS sku", "NULL AS category_slug", f"CAST({price} AS STRING) AS price",
        "CAST(NULL AS STRING) AS old_price", "CAST(NULL AS STRING) AS currency", "'IN_STOCK' AS stock_status", "CAST(id AS INT) AS quantity",
        "concat('https://shop.example/', id) AS url", "CAST(NULL AS STRING) AS image_url", "0.5D AS data_quality",
        "TIMESTAMP '2026-01-01 00:00:00' AS fetched_at", "TIMESTAMP_NTZ '2026-01-01 00:00:00' AS seen_at").withColumn(
        "availabilities", F.lit(None).cast(schemas.OBSERVATION_JSON["availabilities"].dataType)).withColumns(
        {c: F.col(c).cast("string") for c in ("mpn", "sku", "category_slug")})


def _shops(spark):
    return spark.createDataFrame([("s0", "shop-0"), ("s1", "shop-1")], "store_id STRING, slug STRING")


def test_an_import_leaves_no_shuffle_files(spark, tmp_path):
    rows = keep(_observed(spark))
    before = _shuffle_files(spark)
    importer = Importer(spark, str(tmp_path / "db"), _shops(spark))
    importer.run(rows, "b1")
    assert not _left(spark, before)
    assert importer.read("offers").count() == 40


def test_a_reconciliation_goes_slice_by_slice_and_leaves_no_shuffle_files(spark, tmp_path, monkeypatch):
    """Offers of one store go out of stock, those of the other stay; the rewritten buckets hold every row once."""
    monkeypatch.setattr(session, "_SLICE_ROWS", 4)
    importer = Importer(spark, str(tmp_path / "db"), _shops(spark), bucket_rows=8)
    offers, ddl = importer.tables["offers"], importer.tables["offers"].schema
    stored = spark.range(40).selectExpr(*[f"CAST({e} AS {t}) AS {n}" for n, t, e in (
        (n, t, {"store_id": "concat('s', id % 2)", "external_id": "concat('e', id)", "price": "id + 1", "stock_status": "'IN_STOCK'", "quantity": "id",
                "last_seen_at": "'2026-01-01 00:00:00'", "last_stock_update": "'2026-01-01 00:00:00'"}.get(n, "NULL"))
        for n, t in (c.split(" ", 1) for c in ddl.split(", ")))])
    offers.replace(stored, "b1", offers.touched(stored))
    importer.begin_run("r", "shop-1", dt.datetime(2026, 2, 1))
    before, written = _shuffle_files(spark), []
    real = session.write_slices
    monkeypatch.setattr("shelfspark.sources.tables.write_slices", lambda df, path, slices=(), partition=(): written.append(len(slices)) or real(df, path, slices, partition))
    assert importer._reconcile(importer._run("r"), None) == 20
    assert written == [8] and not _left(spark, before)
    found = {r.external_id: (r.store_id, r.stock_status, r.quantity) for r in importer.read("offers").collect()}
    assert importer.read("offers").count() == 40
    assert found == {f"e{i}": ("s1", "OUT_OF_STOCK", None) if i % 2 else ("s0", "IN_STOCK", i) for i in range(40)}


def test_landed_rows_leave_no_shuffle_files_to_their_import(spark, tmp_path):
    """Neither the shuffle files of the micro-batch nor, once they are read, the landed rows stay through the import."""
    write_observations(_observed(spark).drop("seen_at"), str(tmp_path / "in"))
    importer, found = Importer(spark, str(tmp_path / "db"), _shops(spark)), []
    real_run, real_links = importer.run, importer._links
    importer.run = lambda *a, **k: found.append(_left(spark, before)) or real_run(*a, **k)
    importer._links = lambda good: found.append(os.listdir(tmp_path / "db" / "landed")) or real_links(good)
    before = _shuffle_files(spark)
    query = ingest_stream(spark, str(tmp_path / "in"), importer, str(tmp_path / "ck"), available_now=True)
    query.awaitTermination(300)
    assert query.exception() is None and found[:2] == [set(), []]
    assert importer.read("offers").count() == 40
