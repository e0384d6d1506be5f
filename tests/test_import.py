"""Import of raw lines: the shared-product case, replay, stream against batch."""

import json
import os

import pytest
from pyspark.sql import functions as F

from shelfspark.plans.importing import Importer
from shelfspark.sources.observations import read_observations, write_observations
from shelfspark.streaming.ingest import ingest_stream

HOURS = {"version": 1, "timezone": "Europe/Chisinau", "weekly": {"mon": [{"open": "09:00", "close": "20:00"}], "sun": []}}


def line(store, ext, price, qty, seen, **more):
    base = {"store_slug": store, "external_id": ext, "title": "Espresso X100", "normalized_title": "espresso x100", "brand": "Acme",
            "normalized_brand": "acme", "sku": f"{store}-X100", "ean": "4840000000100", "mpn": "X100", "category_slug": "home-appliances",
            "price": price, "currency": "MDL", "stock_status": "IN_STOCK", "quantity": qty, "url": f"https://{store}.example/x100",
            "attributes": {"power_w": 1200}, "data_quality": 0.95, "fetched_at": seen}
    return {**base, **more}


LINES = [
    line("maximum", "m-100", "899.00", 15, "2026-01-01T10:00:00Z"),
    line("maximum", "m-100", "849.00", 6, "2026-01-01T11:00:00Z", stock_status="LOW_STOCK", data_quality=0.97),
    line("darwin", "d-100", "879.00", None, "2026-01-01T12:00:00Z", availabilities=[{
        "location_external_id": "center", "location_name": "Center", "city": "Chișinău", "address": "str. Test 1",
        "opening_hours": HOURS, "stock_status": "LOW_STOCK", "quantity": 7}]),
]


@pytest.fixture
def stores(spark):
    return spark.createDataFrame([("s1", "maximum"), ("s2", "darwin")], "store_id STRING, slug STRING")


def write(path, lines, extra=()):
    path.write_text("\n".join([*map(json.dumps, lines), *extra]) + "\n", encoding="utf-8")
    return str(path)


def snapshot(importer):
    offers = importer.read("offers").select("store_id", "external_id", "product_id", "price", "quantity", "stock_status", "last_price_update")
    history = importer.read("history").select("store_id", "price", "recorded_at")
    return (sorted(map(tuple, offers.collect())), sorted(map(tuple, history.collect())),
            sorted(map(tuple, importer.read("products").select("product_id", "title", "data_quality", "slug").collect())))


def test_shared_ean_becomes_one_product(spark, stores, tmp_path):
    source = write(tmp_path / "a.ndjson", LINES, ["", "   ", "{broken", json.dumps(line("nowhere", "n", "1", 1, "2026-01-01T10:00:00Z"))])
    importer = Importer(spark, str(tmp_path / "db"), stores)
    summary = importer.run(read_observations(spark, source), "b1").first()
    assert (summary.imported, summary.failed, summary.may_reconcile) == (3, 2, False)

    products = importer.read("products").collect()
    assert len(products) == 1 and products[0].data_quality == 0.97 and products[0].slug == "espresso-x100"
    offers = {r.store_id: r for r in importer.read("offers").collect()}
    assert len(offers) == 2
    assert (float(offers["s1"].price), offers["s1"].quantity) == (849.0, 6)
    history = [float(r.price) for r in importer.read("history").filter("store_id = 's1'").orderBy("recorded_at").collect()]
    assert history == [899.0, 849.0]
    branch = importer.read("availability").join(importer.read("locations"), "location_id").collect()
    assert len(branch) == 1
    assert (branch[0].city, branch[0].quantity, branch[0].stock_status) == ("Chișinău", 7, "LOW_STOCK")
    assert branch[0].opening_hours.weekly["sun"] == []

    before = snapshot(importer)
    importer.run(read_observations(spark, source), "b1")
    assert snapshot(importer) == before, "replaying a batch changes nothing"


def test_unchanged_price_adds_no_history(spark, stores, tmp_path):
    importer = Importer(spark, str(tmp_path / "db"), stores)
    importer.run(read_observations(spark, write(tmp_path / "a.ndjson", LINES)), "b1")
    again = [line("maximum", "m-100", "849.0", 6, "2026-01-02T10:00:00Z", stock_status="LOW_STOCK")]
    importer.run(read_observations(spark, write(tmp_path / "b.ndjson", again)), "b2")
    offer = importer.read("offers").filter("store_id = 's1'").first()
    assert str(offer.last_seen_at) == "2026-01-02 10:00:00"
    assert str(offer.last_price_update) == "2026-01-01 11:00:00"
    assert importer.read("history").filter("store_id = 's1'").count() == 2


def product(store, ext, seen, **more):
    return line(store, ext, "10.00", 1, seen, title=ext, normalized_title=ext, sku=None, **more)


def test_key_gained_inside_the_batch_finds_the_stored_product(spark, stores, tmp_path):
    importer = Importer(spark, str(tmp_path / "db"), stores)
    first = [product("maximum", f"a{i}", "2026-01-01T10:00:00Z", ean=f"{4840000000000 + i}", mpn=None) for i in range(6)]
    importer.run(read_observations(spark, write(tmp_path / "a.ndjson", first)), "b1")
    pairs = [p for i in range(6) for p in (
        product("maximum", f"b{i}", "2026-01-02T10:00:00Z", ean=f"{4840000000000 + i}", mpn=f"M{i}"),
        product("darwin", f"c{i}", "2026-01-02T10:00:00Z", ean=None, mpn=f"M{i}"))]
    importer.run(read_observations(spark, write(tmp_path / "b.ndjson", pairs)), "b2")
    assert importer.read("products").count() == 6
    owner = {r.external_id: r.product_id for r in importer.read("offers").collect()}
    assert all(owner[f"a{i}"] == owner[f"b{i}"] == owner[f"c{i}"] for i in range(6))


def test_unknown_category_is_dropped(spark, stores, tmp_path):
    categories = spark.createDataFrame([("c1", "home-appliances")], "category_id STRING, slug STRING")
    importer = Importer(spark, str(tmp_path / "db"), stores, categories)
    rows = [product("maximum", "x", "2026-01-01T10:00:00Z", ean="1", mpn=None), product("maximum", "y", "2026-01-01T10:00:00Z", ean="2", mpn=None, category_slug="nowhere")]
    importer.run(read_observations(spark, write(tmp_path / "a.ndjson", rows)), "b1")
    assert {r.title: r.category_slug for r in importer.read("products").collect()} == {"x": "home-appliances", "y": None}


@pytest.mark.parametrize("broken", ["products", "offers"])
def test_replay_after_a_broken_batch(spark, stores, tmp_path, broken):
    source = write(tmp_path / "a.ndjson", LINES + [product("darwin", "q", "2026-01-01T13:00:00Z", ean=None, mpn="Q1"),
                                                   product("maximum", "q2", "2026-01-01T13:00:00Z", ean=None, mpn="Q1")])
    whole = Importer(spark, str(tmp_path / "whole"), stores)
    whole.run(read_observations(spark, source), "b1")
    halted = Importer(spark, str(tmp_path / "halted"), stores)
    table = halted.tables[broken]
    real = table.write

    def fail(*_, **__):
        raise OSError("disk full")

    table.write = fail
    with pytest.raises(OSError):
        halted.run(read_observations(spark, source), "b1")
    table.write = real
    halted.run(read_observations(spark, source), "b1")
    assert snapshot(halted) == snapshot(whole)


def test_stream_equals_batch(spark, stores, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    # Batches apply in file order, and the file source orders by modification time: keep the two apart.
    for i, part in enumerate((LINES[:1], LINES[1:])):
        write(folder / f"{i}.json", part)
        os.utime(folder / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    streamed = Importer(spark, str(tmp_path / "sdb"), stores)
    query = ingest_stream(spark, str(folder), streamed, str(tmp_path / "ck"), files_per_batch=1, available_now=True)
    query.awaitTermination(300)
    assert query.exception() is None
    batch = Importer(spark, str(tmp_path / "bdb"), stores)
    batch.run(read_observations(spark, write(tmp_path / "all.ndjson", LINES)), "b1")
    assert snapshot(streamed)[0] == snapshot(batch)[0]
    assert snapshot(streamed)[1] == snapshot(batch)[1]


def test_observations_round_trip(spark, tmp_path):
    rows = read_observations(spark, write(tmp_path / "a.ndjson", LINES))
    write_observations(rows.drop("seen_at"), str(tmp_path / "out"))
    back = read_observations(spark, str(tmp_path / "out"))
    cols = ["external_id", "price", "quantity", "seen_at", F.to_json("attributes").alias("attributes")]
    assert sorted(map(str, rows.select(*cols).collect())) == sorted(map(str, back.select(*cols).collect()))


def test_seq_follows_files_and_lines(spark, tmp_path):
    folder = tmp_path / "in dir"
    folder.mkdir()
    names = [f"e{i}" for i in range(40)]
    write(folder / "part-0.json", [line("maximum", names[0], "1", 1, "2026-01-01T10:00:00Z")])
    write(folder / "part-1.json", [line("maximum", n, "1", 1, "2026-01-01T10:00:00Z") for n in names[1:]])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = read_observations(spark, str(folder))
        assert rows.rdd.getNumPartitions() > 2
        assert [r.external_id for r in rows.orderBy("seq").collect()] == names
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_registry_locations_and_reports(spark, tmp_path):
    from shelfspark.sources.observations import read_locations, read_registry, write_reports

    (tmp_path / "reg.json").write_text(json.dumps([{"slug": "a", "status": "PARTIAL", "categories": ["x"]}, {"slug": "b", "status": "VERIFIED"}]))
    assert [r.slug for r in read_registry(spark, str(tmp_path / "reg.json")).orderBy("idx").collect()] == ["a", "b"]
    (tmp_path / "loc.json").write_text(json.dumps([{"store_slug": "a", "external_id": "1", "name": "n", "city": "c", "opening_hours": HOURS}]))
    assert read_locations(spark, str(tmp_path / "loc.json")).first().opening_hours.weekly["mon"][0].open == "09:00"
    report = spark.createDataFrame([("a", "OK", 3), ("b", "PARTIAL", 1)], "store_slug STRING, outcome STRING, n INT")
    write_reports(report.select("store_slug", F.struct("outcome", "n").alias("coverage")), str(tmp_path / "reports"))
    assert {p.name for p in (tmp_path / "reports").iterdir() if p.is_dir()} == {"store_slug=a", "store_slug=b"}


def test_an_import_in_slices_gives_the_same_tables(spark, tmp_path, monkeypatch):
    """Steps over many rows are done a slice of their key after the other; every row is in one slice."""
    from shelfspark import session
    from test_stored_rows import _observed, _shops

    def imported(name):
        importer = Importer(spark, str(tmp_path / name), _shops(spark), bucket_rows=8)
        importer.run(_observed(spark), "b1")
        return [sorted(map(str, importer.read(t).collect())) for t in ("offers", "history", "products", "brands")]

    whole, parts = imported("whole"), []
    real = session.write_slices

    def counted(df, path, slices=(), partition=()):
        parts.append(len(slices))
        return real(df, path, slices, partition)

    monkeypatch.setattr(session, "_SLICE_ROWS", 4)
    for module in ("shelfspark.session", "shelfspark.sources.tables", "shelfspark.plans.importing"):
        monkeypatch.setattr(f"{module}.write_slices", counted)
    assert imported("sliced") == whole
    assert parts.count(8) >= 3, "the observations, the history and the offers"
