"""Runs of one store: completeness gate, reconciliation, one commit per batch, buckets that follow the data."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfspark.plans.importing import Importer
from shelfspark.sources.observations import read_observations
from shelfspark.sources.tables import CommitLog, VersionedTable
from test_import import LINES, product, snapshot, stores, write  # noqa: F401

BEGUN = dt.datetime(2026, 1, 2)


def stock(importer):
    return {r.external_id: (r.stock_status, r.quantity, r.last_stock_update) for r in importer.read("offers").collect()}


def crawl(spark, tmp_path, name, rows):
    return read_observations(spark, write(tmp_path / f"{name}.ndjson", rows))


def first_day(spark, stores, tmp_path, root="db"):  # noqa: F811
    importer = Importer(spark, str(tmp_path / root), stores)
    rows = [product(s, f"{s}-{i}", "2026-01-01T10:00:00Z", ean=f"{i}", mpn=None) for s in ("maximum", "darwin") for i in range(6)]
    importer.run(crawl(spark, tmp_path, "first", rows), "b1")
    return importer


def second_day(i):
    return product("maximum", f"maximum-{i}", "2026-01-02T09:00:00Z", ean=f"{i}", mpn=None)


def test_full_run_puts_unseen_offers_out_of_stock(spark, stores, tmp_path):  # noqa: F811
    importer = first_day(spark, stores, tmp_path)
    importer.begin_run("r1", "maximum", BEGUN)
    importer.begin_run("r1", "maximum", BEGUN)
    importer.run(crawl(spark, tmp_path, "x", [second_day(0), second_day(1)]), "r1-0", run_id="r1")
    assert importer.finish_run("r1", ["r1-0", "r1-1"]) == "INCOMPLETE"
    assert importer.runs().collect()[0].status == "RUNNING"
    importer.run(crawl(spark, tmp_path, "y", [second_day(2)]), "r1-1", run_id="r1")
    before = stock(importer)
    assert importer.finish_run("r1", ["r1-0", "r1-1"]) == "SUCCESS"
    after = stock(importer)
    for name, row in before.items():
        gone = name in ("maximum-3", "maximum-4", "maximum-5")
        assert after[name] == (("OUT_OF_STOCK", None, BEGUN) if gone else row)
    assert [tuple(r)[1:] for r in importer.runs().collect()] == [("maximum", BEGUN, True, "SUCCESS", 3, 0, 3)]
    assert importer.finish_run("r1", ["r1-0", "r1-1"]) == "SUCCESS" and stock(importer) == after
    with pytest.raises(ValueError):
        importer.finish_run("unknown", [])


@pytest.mark.parametrize("why", ["foreign row", "part of the store"])
def test_failures_and_partial_crawls_block_reconciliation(spark, stores, tmp_path, why):  # noqa: F811
    importer = first_day(spark, stores, tmp_path)
    importer.begin_run("r1", "maximum", BEGUN, full_run=why != "part of the store")
    rows = [second_day(0)] + ([product("darwin", "darwin-0", "2026-01-02T09:00:00Z", ean="0", mpn=None)] if why == "foreign row" else [])
    importer.run(crawl(spark, tmp_path, "x", rows), "r1-0", run_id="r1")
    before = stock(importer)
    assert importer.finish_run("r1", ["r1-0"]) == "PARTIAL"
    assert stock(importer) == before and before["darwin-0"][0] == "IN_STOCK"


def test_interrupted_runs_replay_to_the_same_tables(spark, stores, tmp_path, monkeypatch):  # noqa: F811
    def play(importer):
        importer.begin_run("r1", "maximum", BEGUN)
        importer.run(crawl(spark, tmp_path, "x", [second_day(0), second_day(1)]), "r1-0", run_id="r1")
        return importer.finish_run("r1", ["r1-0"])

    whole = first_day(spark, stores, tmp_path, "whole")
    assert play(whole) == "SUCCESS"
    halted = first_day(spark, stores, tmp_path, "halted")
    before = snapshot(halted)

    def fail(*_, **__):
        raise OSError("disk full")

    with monkeypatch.context() as patch:  # before the commit of the batch
        patch.setattr(halted.log, "append", fail)
        with pytest.raises(OSError):
            play(halted)
    assert snapshot(halted) == before, "nothing of an uncommitted batch is read"
    with monkeypatch.context() as patch:  # after the commit of the reconciliation
        real = halted._note
        patch.setattr(halted, "_note", lambda kind, *row: fail() if kind == "FINISHED" else real(kind, *row))
        with pytest.raises(OSError):
            play(halted)
    assert play(halted) == "SUCCESS"
    assert snapshot(halted) == snapshot(whole) and stock(halted) == stock(whole)
    assert [r.marked for r in halted.runs().collect()] == [4]


def test_buckets_follow_the_data(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "commits"))
    table = VersionedTable(spark, str(tmp_path / "t"), "store STRING, id BIGINT, v BIGINT", ("store", "id"), log, bucket_rows=50)

    def upsert(rows, batch):
        near = table.touched(rows)
        kept = table.read(near).join(rows, ["store", "id"], "left_anti")
        assert table.replace(kept.unionByName(rows), batch, near)
        return near

    # One store holds most rows and is split all the same.
    rows = spark.range(1000).select(F.when(F.col("id") % 10 == 0, F.concat(F.lit("s"), F.col("id") % 70)).otherwise("hot").alias("store"), "id", F.lit(1).alias("v"))
    upsert(rows, "b1")
    sizes = [n for _, n in table._leaves().values()]
    assert sum(sizes) == 1000 and len(sizes) >= 16 and max(sizes) < 300
    upsert(rows, "b1 again")
    assert max(n for _, n in table._leaves().values()) < 150
    small = spark.createDataFrame([("hot", 1, 2), ("new", 5000, 3)], "store STRING, id BIGINT, v BIGINT")
    assert len(upsert(small, "b2")) <= 2
    assert not table.replace(small, "b2", {1: 2})
    got = {(r.store, r.id): r.v for r in table.read().collect()}
    assert len(got) == 1001 and got["hot", 1] == 2 and got["new", 5000] == 3 and got["hot", 2] == 1
    leaves = len(table._leaves())
    upsert(spark.range(2000, 6000).select(F.lit("hot").alias("store"), "id", F.lit(1).alias("v")), "b3")
    assert len(table._leaves()) > leaves and table.read().count() == 5000 + 1 - 0
