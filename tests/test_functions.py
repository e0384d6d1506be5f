"""Golden cases of the column functions."""

import datetime as dt
import re
import unicodedata

from pyspark.sql import functions as F

from shelfspark.functions import clock, commerce, geo, register_sql, seal, text

DAY = [{"open": "09:00", "close": "18:00"}]
HOURS_T = ("struct<version:int,kind:string,timezone:string,weekly:map<string,array<struct<open:string,close:string>>>,"
           "temporarilyClosed:boolean>")


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def run(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).coalesce(1).select(*columns).collect()]


def test_money(spark):
    html = ["129 900 129 900 EUR", "1 299,90 MDL", "Цена со скидкой: 1299,00 MDL 1299,00 MDL", "1.299,90", "129900129900", "abc", None]
    got = [None if r[0] is None else str(r[0]) for r in run(spark, [(h,) for h in html], "s STRING", commerce.parse_money("s", "html"))]
    assert got == ["129900.00", "1299.90", "1299.00", "1.30", "129900.00", None, None]
    got = run(spark, [("1 299,5",), ("1,299.00",), ("24.50",), ("",), ("1e3",)], "s STRING",
              commerce.parse_money("s", "json"), commerce.parse_money("s", "jsonld"))
    assert [[None if v is None else float(v) for v in r] for r in got] == [[1299.5, 1299.5], [None, None], [24.5, 24.5], [None, None], [1000.0, 13.0]]


def test_labels_in_text(spark):
    sku = {"Articol: 261288": "261288", "Артикул: 70507": "70507", "SKU ABC-12/34": "ABC-12/34", "Код товара: 179205": "179205",
           "Cod produs: 9911": "9911", "Cod produsului: MD-77": "MD-77", "Codul produs: 55331": "55331", "Codul produsului: 111336": "111336", "none": None}
    assert [r[0] for r in run(spark, [(k,) for k in sku], "s STRING", commerce.sku_from_text("s"))] == list(sku.values())
    qty = {"Disponibilitate: 13": 13, "Наличие: 4": 4, "Availability 0": 0, "În stoc: 7 buc": 7, "x": None}
    assert [r[0] for r in run(spark, [(k,) for k in qty], "s STRING", commerce.quantity_from_text("s"))] == list(qty.values())


def test_stock(spark):
    q = [0, -1, 4, 10, 11, 62, None]
    assert [r[0] for r in run(spark, [(x,) for x in q], "q INT", commerce.stock_from_quantity("q"))] == [
        "OUT_OF_STOCK", "OUT_OF_STOCK", "LOW_STOCK", "LOW_STOCK", "IN_STOCK", "IN_STOCK", None]
    words = [("Товар не в наличии", "OUT_OF_STOCK"), ("Nu este disponibil", "OUT_OF_STOCK"), ("disponibil", "IN_STOCK"), ("stoc limitat", "LOW_STOCK"), ("?", "UNKNOWN")]
    assert [r[0] for r in run(spark, [(w,) for w, _ in words], "s STRING", commerce.stock_from_text("s", "html"))] == [s for _, s in words]
    assert one(spark, commerce.stock_from_text(F.lit("https://schema.org/Unavailable"), "json")) == ("OUT_OF_STOCK",)
    assert one(spark, commerce.stock_from_text(F.lit("Yes"), "feed"), commerce.stock_from_text(F.lit("no"), "feed")) == ("IN_STOCK", "OUT_OF_STOCK")


CATEGORY = [
    (["Телефония и гаджеты", "Портативное аудио", "Наушники беспроводные"], "Беспроводные наушники", True, "tv-audio"),
    (["Телефония и гаджеты", "Смартфоны"], "Samsung Galaxy S25 256GB", True, "smartphones"),
    (["Техника для красоты и здоровья", "Фены"], "Фен Dyson Supersonic", True, "beauty"),
    (["Крупная бытовая техника", "Вытяжки"], "Вытяжка кухонная", True, "home-appliances"),
    (["Товары для дома", "Посуда"], "Сковорода 28 см", True, "home"),
    (["pizza i patiserie congelate"], "Placinte cu carne de pui congelate", True, "food"),
    (["marinate"], "Ceafa de porc fara os", True, "meat"),
    (["kreatiny"], "Nutricost Creatine Capsules", False, "sport"),
    (["katalog", "gejnery"], "Ronnie Coleman King Mass XL", False, "sport"),
    (["mobila", "promo"], "Peste oceanic congelat 500 g", False, "food"),
    (["animale", "promo"], "Blocnotes A5 80 file", False, None),
    (["mobila", "promo"], "Lapte UHT 3.5%", False, "dairy"),
    (["mobila"], "Canapea extensibila", True, "furniture"),
    ([], "", True, None),
]


def test_category(spark):
    rows = run(spark, [c[:3] for c in CATEGORY], "p ARRAY<STRING>, t STRING, b BOOLEAN", commerce.map_category("p", "t", F.col("b")))
    assert [r[0]["slug"] for r in rows] == [c[3] for c in CATEGORY]
    confidence = [r[0]["confidence"] for r in rows]
    assert confidence[8] == 0.76 and confidence[10] == 0.0 and confidence[12] == 0.89 and confidence[11] < 0.84


def test_text(spark):
    samples = ["  Ａｂｃ—№5  Café ½  x", "Chișinău!", "a_b.c+d/e-f", "", "Ünïté №", "é", "​zero"]

    def plain(value):
        value = unicodedata.normalize("NFKC", value).strip().lower()
        return re.sub(r"\s+", " ", re.sub(r"[^\w\s.+/-]", " ", value)).strip()

    def slug(value):
        value = re.sub(r"[^a-z0-9]+", "-", unicodedata.normalize("NFKD", value).lower()).strip("-")[:120]
        return value or "product"

    got = run(spark, [(s,) for s in samples], "s STRING", text.normalize_text("s"), text.slugify("s"))
    assert got == [(plain(s), slug(s)) for s in samples]
    assert one(spark, text.slugify(F.lit("Chișinău"))) == ("chis-ina-u",)
    assert one(spark, text.is_service(F.lit("Составление индивидуального курса препаратов")), text.is_service(F.lit("California Gold Creatine 454 g"))) == (True, False)


def test_whole_documents_match_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", text.normalize_text("text").alias("n"), text.slugify("text").alias("s")).collect()
    for row in docs:
        value = unicodedata.normalize("NFKC", row.text).strip().lower()
        assert row.n == re.sub(r"\s+", " ", re.sub(r"[^\w\s.+/-]", " ", value)).strip()
        assert row.s == (re.sub(r"[^a-z0-9]+", "-", unicodedata.normalize("NFKD", row.text).lower()).strip("-")[:120] or "product")


def test_urls(spark):
    assert one(spark, text.category_path_from_url(F.lit("https://shop.example/ro/catalog/pizza_i_patiserie_congelate/slug?ref=home"))) == (["pizza i patiserie congelate"],)
    assert one(spark, text.category_path_from_url(F.lit("https://shop.example/one"))) == ([],)
    assert one(spark, text.clean_url(F.lit("HTTP://a.example?x=1#f")), text.clean_url(F.lit("https://a.example/p;v=1/q;w"))) == ("http://a.example/?x=1", "https://a.example/p;v=1/q")
    store = one(spark, text.store_from_url(F.lit("www.Shop-One.md/path")))[0]
    assert (store.slug, store.domain) == ("shop-one", "https://www.Shop-One.md")


def test_freshness(spark):
    assert [clock.max_age_hours(x) for x in (None, "bad", "0", "10000", "12")] == [48, 48, 1, 336, 12]
    assert [clock.grace_hours(x) for x in (None, -1, "5", 999)] == [0, 0, 5.0, 336]
    as_of = dt.datetime(2026, 1, 10)
    rows = [(as_of - dt.timedelta(hours=48),), (as_of - dt.timedelta(hours=48, seconds=1),), (None,)]
    assert [r[0] for r in run(spark, rows, "t TIMESTAMP_NTZ", clock.freshness_state("t", as_of))] == ["FRESH", "STALE", "STALE"]
    ages = [(None,), (as_of - dt.timedelta(minutes=5),), (as_of - dt.timedelta(hours=47),), (as_of - dt.timedelta(hours=72),)]
    assert [r[0] for r in run(spark, ages, "t TIMESTAMP_NTZ", clock.age_label("t", as_of))] == ["never", "5m", "47h", "3d"]


HOURS = [
    ((1, None, "Europe/Chisinau", {"mon": DAY, "sun": []}, None), "2026-01-05 07:30:00", "open", "09:00–18:00"),
    ((1, None, "Europe/Chisinau", {"mon": DAY, "sun": []}, None), "2026-01-05 18:30:00", "closed", "09:00–18:00"),
    ((1, None, None, {"fri": [{"open": "22:00", "close": "02:00"}], "sat": []}, None), "2026-01-09 23:30:00", "open", "выходной"),
    ((1, None, None, {"fri": [{"open": "22:00", "close": "02:00"}], "sat": []}, None), "2026-01-10 00:30:00", "closed", "выходной"),
    ((1, None, "UTC", {"mon": DAY}, None), "2026-01-05 10:00:00", "unknown", None),
    ((1, "schedule", "UTC", {"mon": [{"open": "25:00", "close": "26:00"}], "sun": []}, None), "2026-01-05 10:00:00", "unknown", None),
    ((1, "online_only", None, None, None), "2026-01-05 10:00:00", "online_only", None),
    ((1, None, "UTC", {"mon": DAY, "sun": []}, True), "2026-01-05 10:00:00", "temporarily_closed", None),
    ((1, None, "UTC", {"mon": [{"open": "00:00", "close": "00:00"}], "sun": []}, False), "2026-01-05 03:00:00", "open", "24/7"),
    ((1, None, "No/Where", {"mon": DAY, "sun": []}, None), "2026-01-05 10:00:00", "unknown", None),
    ((2, None, "UTC", {"mon": DAY, "sun": []}, None), "2026-01-05 10:00:00", "unknown", None),
    (None, "2026-01-05 10:00:00", "unknown", None),
]


def test_open_state(spark):
    rows = run(spark, [(h, t) for h, t, _, _ in HOURS], f"h {HOURS_T}, t STRING", clock.open_state("h", F.col("t").cast("timestamp")))
    assert [(r[0]["state"], r[0]["today"]) for r in rows] == [(s, d) for _, _, s, d in HOURS]


def test_labels_and_scores(spark):
    cases = [("OUT_OF_STOCK", 5, "Нет в наличии"), ("IN_STOCK", 0, "Нет в наличии"), ("PREORDER", None, "Предзаказ"), ("LOW_STOCK", 3, "В наличии · 3 шт."),
             ("IN_STOCK", 40, "В наличии"), ("UNKNOWN", 11, "В наличии"), ("UNKNOWN", None, "Наличие уточняется")]
    assert [r[0] for r in run(spark, [c[:2] for c in cases], "s STRING, q INT", commerce.stock_label("s", "q"))] == [c[2] for c in cases]
    assert one(spark, text.mask_last4(F.lit(" 123 ")), text.mask_last4(F.lit("12345"))) == ("123", "2345")
    km = one(spark, geo.haversine_km(47.0105, 28.8638, F.lit(47.7615), F.lit(27.9289)))[0]
    assert 108 < km < 110
    assert run(spark, [("5",), ("0",), ("x",), ("900",)], "s STRING", geo.radius_km("s")) == [(5.0,), (10.0,), (10.0,), (300.0,)]
    assert one(spark, geo.valid_coordinates(F.lit(float("nan")), F.lit(1.0))) == (False,)


def test_seal_opens_only_with_its_key(spark):
    sealed = seal.seal(F.when(F.col("id") >= 0, "4840-ș"), "k1", "alpha")
    df = spark.createDataFrame(spark.range(3).select(sealed.alias("c")).toPandas())
    rows = df.select(seal.unseal("c", {"k1": "alpha"}), seal.unseal("c", {"k1": "beta"}), seal.unseal(F.lit("v9.x"), {"k1": "alpha"})).collect()
    assert {tuple(r) for r in rows} == {("4840-ș", None, None)}
    assert len({r.c for r in df.collect()}) == 3, "every value gets its own iv"
    legacy = F.concat(F.lit("v1."), F.substring_index("c", ".", -3))
    assert df.select(seal.unseal(legacy, {}, ("beta", "alpha"))).first()[0] == "4840-ș"


def test_sql_functions_agree(spark):
    register_sql(spark)
    rows = spark.createDataFrame([c[:3] for c in CATEGORY], "p ARRAY<STRING>, t STRING, b BOOLEAN")
    both = rows.select(F.expr("map_category(p, t, b)").alias("s"), commerce.map_category("p", "t", F.col("b")).alias("c"),
                       F.expr("normalize_text(t)"), text.normalize_text("t"), F.expr("slugify(t)"), text.slugify("t")).collect()
    assert all(tuple(r[0]) == tuple(r[1]) and r[2] == r[3] and r[4] == r[5] for r in both)
    assert float(spark.sql("SELECT parse_money('1 299,90')").first()[0]) == 1299.9
    assert spark.sql("SELECT haversine_km(47D, 28D, 47D, 28D)").first()[0] == 0
    hours = spark.createDataFrame([h[:2] for h in HOURS if h[0] is None or h[0][2] != "No/Where" and (h[0][3] or {}).get("mon") != [{"open": "25:00", "close": "26:00"}]],
                                  f"h {HOURS_T}, t STRING")
    for row in hours.select(F.expr("open_state(h, CAST(t AS TIMESTAMP))").alias("a"), clock.open_state("h", F.col("t").cast("timestamp"))["state"].alias("b")).collect():
        assert row.a == row.b


def test_sql_open_state_equals_the_column(spark):
    from shelfspark.functions import register_sql
    from shelfspark.functions.clock import open_state

    register_sql(spark)
    hours = ("STRUCT<version: INT, kind: STRING, timezone: STRING, weekly: MAP<STRING, ARRAY<STRUCT<open: STRING, close: STRING>>>, "
             "temporarilyClosed: BOOLEAN>")
    day = lambda a, b: {d: [(a, b)] for d in ("mon", "tue", "wed", "thu", "fri", "sat", "sun")}
    rows = [((1, k, zone, week, closed),) for k in (None, "schedule", "online_only", "odd") for zone in (None, "", "Europe/Chisinau", "No/Where")
            for week in (None, day("09:00", "18:00"), day("22:00", "06:00"), day("9h", "x"), day("00:00", "00:00"), {"mon": []})
            for closed in (None, True)] + [((2, None, None, day("09:00", "18:00"), None),), (None,)]
    table = spark.createDataFrame(rows, f"h {hours}")
    table = table.withColumn("at", F.expr("TIMESTAMP '2026-01-05 10:30:00'"))
    got = table.select(open_state("h", "at")["state"].alias("a"), F.expr("open_state(h, at)").alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got] and {"open", "closed", "unknown"} <= {r.a for r in got}
