"""Golden cases of extraction, links, matching, quality and group helpers."""

from difflib import SequenceMatcher
from urllib.robotparser import RobotFileParser

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfspark import rules
from shelfspark.functions.html import anchors, product_hits
from shelfspark.operators import extract, links, match, network, quality, upsert, validate
from shelfspark.operators.grouping import lag_by_key, top_per_group
from shelfspark.sources import feeds


# -- groups -----------------------------------------------------------------------

@pytest.mark.parametrize("spacing", [97_000_000, 0])
def test_lag_over_pieces_equals_plain_lag(spark, spacing):
    # One key holds most rows (at one time, if spacing is 0) and so lies in several pieces.
    rows = spark.range(4000).select(
        F.when(F.col("id") % 5 == 0, F.col("id") % 37).otherwise(-1).alias("k"), F.col("id").alias("seq"),
        F.timestamp_micros((F.col("id") * 7919 % 4000) * spacing).cast("timestamp_ntz").alias("t"), (F.col("id") % 3).alias("v"))
    before = F.lag(F.struct("v")).over(Window.partitionBy("k").orderBy("t", "seq"))
    plain = rows.select("seq", before["v"].alias("prev_v"), before.isNotNull().alias("has_prev"))
    got = lag_by_key(rows, ["k"], "t", ["seq"], ["v"]).select("seq", "prev_v", "has_prev")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def test_page_caps_are_explicit(spark):
    docs = spark.createDataFrame([(f"https://s.md/{i}", f'{{"next": "/{(i + 1) % 40}"}}' if i < 39 else "{}") for i in range(40)], "url STRING, body STRING")
    start = spark.createDataFrame([("https://s.md/0",)], "endpoint STRING")
    assert sorted(r.depth for r in feeds.follow_pages(docs, start).collect()) == list(range(1, 41))
    capped = feeds.follow_pages(docs, start, max_pages=5).collect()
    assert len(capped) == 5 and all(r.cap_reached for r in capped)
    tree = spark.createDataFrame([("s", "r", f"l{i}", "listing") for i in range(9)] + [("s", f"l{i}", f"p{i}", "product") for i in range(9)],
                                 "site STRING, page_url STRING, url STRING, kind STRING")
    seeds = spark.createDataFrame([("s", "r")], "site STRING, url STRING")
    products, summary = links.reachable_products(tree, seeds)
    assert products.count() == 9 and summary.first().pages_visited == 10 and not summary.first().cap_reached
    products, summary = links.reachable_products(tree, seeds, max_pages=4)
    assert products.count() == 3 and summary.first().pages_visited == 4 and summary.first().cap_reached


def test_bad_digits_and_long_payloads(spark):
    from shelfspark.functions.commerce import quantity_from_text

    rows = spark.createDataFrame([("In stoc: ٣",), ("In stoc: 7",)], "t STRING").select(quantity_from_text("t").alias("q"))
    assert [r.q for r in rows.collect()] == [None, 7]
    cards = spark.createDataFrame([("a", "n", "x" * 5000, "QR", "", ""), ("a", "n", "x" * 4096, "QR", "", "")],
                                  "label STRING, cardholder_name STRING, payload STRING, barcode_format STRING, notes STRING, color STRING")
    checked = upsert.check_cards(cards.withColumn("barcode_format", F.lit(rules.BARCODE_FORMATS[0]))).collect()
    assert [r.reason is None for r in checked] == [False, True]


def test_first_rows_are_cut_before_the_shuffle(spark):
    plan = top_per_group(spark.range(10).selectExpr("id % 2 AS k", "id"), ["k"], [F.col("id")])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("Exchange") < plan.rindex("WindowGroupLimit")


# -- pages --------------------------------------------------------------------------

RENDERED = """<html><body><main><h1>Produs test 500 ml</h1><div class="price">49,90 MDL</div><div class="description">Descriere produs</div>
<div>Codul produsului: ABC-123</div><div>În stoc: 7 buc</div><div class="product-image"><img src="/placeholder.svg" data-src="/media/produs.webp"></div></main></body></html>"""


def test_rendered_page(spark):
    pages = spark.createDataFrame([(1, "https://shop.example/ro/catalog/bauturi/produs-test", RENDERED),
                                   (2, "https://shop.example/catalog/test/p", "<main><h1>Produs</h1><div class=price>10 MDL</div><div>Disponibilitate: 0</div></main>"),
                                   (3, "https://shop.example/x", "<h1>No price</h1>")], "id INT, url STRING, html STRING")
    rows = {r.id: r for r in extract.products_from_html(pages, ["id"], mode="rendered").collect()}
    assert set(rows) == {1, 2}
    a = rows[1]
    assert (a.title, float(a.price), a.sku, a.external_id, a.quantity, a.stock_status) == ("Produs test 500 ml", 49.9, "ABC-123", "ABC-123", 7, "LOW_STOCK")
    assert (a.image_url, a.category_path, a.description) == ("https://shop.example/media/produs.webp", ["bauturi"], "Descriere produs")
    assert (rows[2].quantity, rows[2].stock_status) == (0, "OUT_OF_STOCK")


def test_images_and_text():
    hits = product_hits('<head><title>T</title><script>var x="</p>"</script></head><main><div class="product-image"><img src="/img/placeholder.png" data-src="/products/real.jpg"></div><p>a<p>b</main>')
    assert [i["url"] for i in hits["images"]][0] == "/products/real.jpg" and hits["page_text"] == "T a b"
    social = product_hits('<meta property="og:image" content="/public/version_500x300xog500x300x1/site.jpg">')["images"]
    assert social == [{"url": "/public/version_500x300xog500x300x1/site.jpg", "social": True}]


def test_social_picture_is_refused(spark):
    df = spark.createDataFrame([([("/public/xog500x300/site.jpg", True)],), ([("/placeholder.png", False), ("/a.jpg", False)],)],
                               "images ARRAY<STRUCT<url: STRING, social: BOOLEAN>>")
    assert [r[0] for r in df.coalesce(1).select(extract.pick_image(F.col("images"))).collect()] == [None, "/a.jpg"]


LINKS = [
    ('<a href="/product/coffee-machine-123">Coffee</a>', "product"), ('<a href="/ru/katalog/kreatiny/creatine-capsules-detail">C</a>', "product"),
    ('<a href="/ru/component/content/category/8-novosti">Catalog news</a>', "skip"), ('<div class="card"><a href="/espresso-123">E</a><span>4 999 MDL x</span></div>', "product"),
    ('<article itemtype="https://schema.org/Product"><a href="/x123">P</a></article>', "product"), ('<a href="/catalogue/electronics">E</a>', "listing"),
    ('<a href="/about-us">Despre</a>', "skip"), ('<a href="/cart">c</a>', "skip"), ('<a href="mailto:a@b.c">m</a>', "skip"), ('<a href="https://other.example/catalog">c</a>', "skip"),
]


def test_generic_links(spark):
    pages = spark.createDataFrame([(i, "https://shop.md/", h) for i, (h, _) in enumerate(LINKS)], "id INT, url STRING, html STRING")
    got = {r.id: r.kind for r in links.extract_links(pages, ["id"]).collect()}
    assert got == {i: k for i, (_, k) in enumerate(LINKS)}


def test_store_links_and_entries(spark):
    shelf = '<div class="card"><a href="/ru/catalogue/electronice/telefone/mobilnye-telefony/iphone-17/">Apple iPhone 17</a><span>17 899 лей</span></div>'
    deep = '<nav><a href="/ru/catalogue/bytovaya-tehnika/tehnika-dlya-doma/pylesosy/">Пылесосы</a></nav>'
    rows = [(1, "cactus", shelf), (2, "cactus", deep), (3, "maximum", '<a href="/ru/6179705/?a=1">x</a>'), (4, "maximum", '<a href="/ru/telefoniya/">x</a>'),
            (5, "maximum", '<a href="/ru/article/sale/">x</a>'), (6, "darwin", '<a href="/ru/a.html">x</a>')]
    pages = spark.createDataFrame([(i, s, "https://s.md/", h) for i, s, h in rows], "id INT, store STRING, url STRING, html STRING")
    got = {r.id: (r.kind, r.url) for r in links.extract_links(pages, ["id"], store_rule=F.col("store")).collect()}
    assert [got[i][0] for i in range(1, 7)] == ["product", "listing", "product", "listing", "skip", "product"]
    assert got[3][1] == "https://s.md/ru/6179705/"
    html = '<a href="/ro/catalog/paste">Paste</a><a href="/ro/catalog">Supermarket online</a><a href="/about">Despre</a><a href="/ru/component/content/category/8-novosti">Catalog</a><a href="https://o.example/catalog">C</a>'
    profile = links.source_profile(spark.createDataFrame([("https://shop.md/ro", html + '<script>fetch("/api/v2/p?page=1"); fetch("https://an.example/api/e")</script>')], "url STRING, html STRING"), F.lit("s")).first()
    assert profile.catalog_urls == ["https://shop.md/ro/catalog", "https://shop.md/ro/catalog/paste"]
    assert profile.api_urls == ["https://shop.md/api/v2/p?page=1"]


def test_seed_pages(spark):
    seeds = spark.createDataFrame([("s", "https://shop.md", x) for x in ("https://shop.md/ro/catalog", "/ru/catalog", "https://external.example/catalog", "/product/1")],
                                  "site STRING, base_url STRING, seed STRING")
    assert {r.url for r in links.initial_listing_urls(seeds).collect()} == {"https://shop.md/ro/catalog", "https://shop.md/ru/catalog", "https://shop.md/"}


def test_robots_match_the_standard_parser(spark):
    texts = ["User-agent: *\nDisallow: /\n", "User-agent: offerbot\nDisallow: /account\nDisallow: /checkout\n", "User-agent: *\nAllow: /a/b\nDisallow: /a\nDisallow:\n",
             "User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /private\n", "", "User-agent: offerbot\n\nDisallow: /x\nUser-agent: *\nDisallow: /y",
             "User-agent: *\nDisallow: /каталог\nDisallow: /a%20b\nAllow: /\n"]
    paths = ["/", "/account/orders", "/catalog/phones", "/a/b/c", "/a/c", "/private/feed", "/x", "/y?z=1", "/каталог/1", "/%D0%BA%D0%B0%D1%82%D0%B0%D0%BB%D0%BE%D0%B3", "/a b", "/a%20b/c", "/a+b"]
    robots = spark.createDataFrame([(str(i), f"https://s{i}.example", "AVAILABLE", t) for i, t in enumerate(texts)], "site STRING, origin STRING, status STRING, body STRING")
    urls = spark.createDataFrame([(str(i), f"https://s{i}.example{p}") for i in range(len(texts)) for p in paths], "site STRING, url STRING")
    for row in links.robots_allowed(urls, robots).collect():
        parser = RobotFileParser()
        parser.parse(texts[int(row.site)].splitlines())
        parser.modified()
        assert row.allowed == parser.can_fetch("OfferBot", row.url), row
    other = spark.createDataFrame([("0", "https://cdn.example/i.jpg"), ("0", "ftp://s0.example/")], "site STRING, url STRING")
    missing = robots.withColumn("status", F.lit("MISSING"))
    assert [r.allowed for r in links.robots_allowed(other, missing).collect()] == [False, False]


def test_nearby_text_is_found_per_anchor():
    found = anchors('<ul><li><a href="/a">A</a> 10 lei x</li><li><a href="/b">B</a></li></ul><div class="product-card"><p><a href="/c">C</a></p></div>')
    assert [(a["href"], a["near_price"], a["card"], a["in_card"]) for a in found] == [("/a", True, False, False), ("/b", True, False, False), ("/c", False, True, True)]


# -- json -----------------------------------------------------------------------------

def test_nested_price_and_stock(spark):
    body = ('{"id":123,"name":"Lapte 1L","price":{"amount":"24.50","currency":"mdl"},"stock":6,"images":[{"url":"/media/lapte.webp"}],'
            '"category":{"name":"Lactate"},"url":"/catalog/lactate/lapte-1l"}')
    docs = spark.createDataFrame([(1, body, "https://shop.example", "https://shop.example/api/p/123"), (2, "{broken", "b", "p"), (3, '{"name":"x","price":""}', "b", "p")],
                                 "id INT, body STRING, base_url STRING, page_url STRING")
    rows = extract.products_from_json(feeds.explode_json_objects(docs, ["id", "base_url", "page_url"], "body"), ["id"]).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (str(r.price), r.quantity, r.stock_status, r.image_url, r.category_path, r.currency, r.external_id) == (
        "24.50", 6, "LOW_STOCK", "https://shop.example/media/lapte.webp", ["Lactate"], "MDL", "123")


def test_shapes_leave_out_values(spark):
    rows = spark.createDataFrame([(1, 0, "https://shop.example/api/availability?token=secret", '{"result":{"productId":"1","quantity":4},"ok":true}')],
                                 "page_id INT, response INT, response_url STRING, body STRING")
    r = network.json_shapes(rows).first()
    assert (r.path, r.top_keys, r.id_like_count, r.stock_like_count, r.object_count) == ("/api/availability", ["ok", "result"], 1, 1, 2)


def test_json_walk_counts_every_depth(spark):
    import json
    deep = {"a": [{"b": {"c": [[{"d": 1}], {"e": {}}]}}, 5, "x", None], "f": []}
    docs = spark.createDataFrame([(1, json.dumps(deep)), (2, "[1, 2]"), (3, "7")], "id INT, body STRING").select("id", F.try_parse_json("body").alias("doc"))
    rows = feeds.walk_json(docs, ["id"], "doc").collect()
    assert len(rows) == 6 and len({tuple(r.path) for r in rows}) == 6 and {r.id for r in rows} == {1}


# -- matching ---------------------------------------------------------------------------

def test_compare_pairs_against_python(spark):
    names = ["apple iphone 17 256gb", "apple iphone 17 256 gb", "samsung galaxy s25", "samsung galaxy s25 ultra", "lapte 1l", "lapte 1.5l"]
    rows = [(i, j, a, b, br, br) for i, a in enumerate(names) for j, b in enumerate(names) if i < j for br in ("x", None)]
    pairs = spark.createDataFrame(rows, "a_id INT, b_id INT, a_normalized_title STRING, b_normalized_title STRING, a_normalized_brand STRING, b_normalized_brand STRING")
    pairs = pairs.withColumns({f"{s}_{c}": F.lit(None).cast("string") for s in "ab" for c in ("ean", "mpn", "sku")})
    want = set()
    for i, j, a, b, br, _ in rows:
        c = min(0.94, SequenceMatcher(None, a, b).ratio() + (0.05 if br else 0))
        if c >= 0.75:
            want.add((i, j, br, round(c, 3), c >= 0.90))
    got = {(r.a_id, r.b_id, r.a_normalized_brand, r.confidence, r.auto_merge) for r in match.compare_pairs(pairs).collect()}
    assert got == want and want


def test_identity_tiers(spark):
    cols = "a_id INT, b_id INT, a_ean STRING, b_ean STRING, a_mpn STRING, b_mpn STRING, a_sku STRING, b_sku STRING, a_normalized_brand STRING, b_normalized_brand STRING, a_normalized_title STRING, b_normalized_title STRING"
    rows = [(1, 2, "1", "1", None, None, None, None, None, None, "a", "b"), (1, 3, "1", "2", "m", "m", None, None, None, None, "a", "b"),
            (1, 4, None, None, None, None, "s", "s", "x", "x", "a", "b"), (1, 5, "", "", None, None, None, None, "x", "y", "same", "same")]
    got = {r.b_id: (r.method, r.confidence) for r in match.compare_pairs(spark.createDataFrame(rows, cols)).collect()}
    assert got == {2: ("EAN", 1.0), 3: ("MPN", 0.98), 4: ("SKU", 0.95), 5: ("NORMALIZED_TITLE", 0.93)}


def test_new_products_follow_the_row_by_row_import(spark):
    rows = [(1, "e1", None, None, "b", "t1"), (2, "e1", "m1", None, "b", "t2"), (3, None, "m1", None, "b", "t3"), (4, None, None, None, "c", "t1"),
            (5, None, None, None, None, "t1"), (6, None, None, "s", "b", "t6"), (7, "e7", None, "s", "b", "t7"), (8, "e7", None, None, None, "t8")]
    df = spark.createDataFrame(rows, "seq INT, ean STRING, mpn STRING, sku STRING, brand STRING, normalized_title STRING")
    got = dict(map(tuple, match.assign_new_products(df).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 1, 6: 6, 7: 6, 8: 6}


def test_ean_guard_sends_variants_to_review(spark):
    products = spark.createDataFrame([(1, "e1", None, None, "b", "t")], "product_id INT, ean STRING, mpn STRING, sku STRING, brand STRING, normalized_title STRING")
    obs = spark.createDataFrame([(1, "e2", None, None, "b", "t"), (2, "e1", None, None, "b", "t")], "seq INT, ean STRING, mpn STRING, sku STRING, brand STRING, normalized_title STRING")
    got = {r.seq: (r.method, r.needs_review) for r in match.match_products(obs, products, guard_ean=True).collect()}
    assert got == {1: ("NORMALIZED_TITLE", True), 2: ("EAN", False)}


# -- quality -----------------------------------------------------------------------------

OBS = ("store_slug STRING, price STRING, stock_status STRING, image_url STRING, category_slug STRING, sku STRING, ean STRING, mpn STRING")


def test_repeated_image_and_unknown_stock(spark):
    rows = [("s", "10.00", "UNKNOWN", "https://shop.example/default.webp", "food" if i < 2 else None, f"K{i}", None, None) for i in range(5)]
    metrics = quality.quality_metrics(spark.createDataFrame(rows, OBS), 5)
    m = quality.enrichment_reasons(quality.publish_readiness(metrics, False)).first()
    assert (m.known_stock_pct, m.distinct_image_pct, m.max_image_reuse_pct, m.target_fill_pct) == (0.0, 20.0, 100.0, 100.0)
    assert m.reasons == ["known_stock=0.0%", "category=40.0%", "image_reuse=100.0%"]
    assert not m.ready and m.blockers == ["catalog_coverage_unverified", "category_complete_pct=40.0%<100.0%", "known_stock_pct=0.0%<100.0%"]
    assert m.warnings == ["suspicious_image_reuse=100.0%"]
    good = [("s", "10.00", "IN_STOCK", f"https://shop.example/{i}.webp", "food", f"K{i}", None, None) for i in range(5)]
    g = quality.enrichment_reasons(quality.publish_readiness(quality.quality_metrics(spark.createDataFrame(good, OBS)), True)).first()
    assert g.ready and g.reasons == [] and g.blockers == [] and g.target_fill_pct is None


def test_payload_merge(spark):
    fields = "id INT, price STRING, stock_status STRING, quantity INT, image_url STRING, category_slug STRING, category_confidence DOUBLE, sku STRING, description STRING, attributes MAP<STRING,STRING>, data_quality DOUBLE"
    old = spark.createDataFrame([(1, "49.90", "UNKNOWN", None, "/default.webp", None, 0.0, "ABC-123", None, {"source": "html"}, 0.7), (2, "1", "IN_STOCK", 3, "/x", "food", 0.9, "S", "long text", {"a": "1"}, 0.9)], fields)
    new = spark.createDataFrame([(1, "51.00", "LOW_STOCK", 7, "/product.webp", "drinks", 0.9, None, "Rendered", {"source": "rendered"}, 0.8), (2, "2", "UNKNOWN", 9, "/x", "drinks", 0.5, "T", "short", {"a": "1"}, 0.1)], fields)
    rows = {r.id: r for r in upsert.merge_payload(old, new, ["id"], replace_suspicious_image=True).collect()}
    a = rows[1]
    assert a.changed and (a.price, a.stock_status, a.quantity, a.image_url, a.category_slug, a.description, a.enriched_by, a.attributes, a.data_quality) == (
        "49.90", "LOW_STOCK", 7, "/product.webp", "drinks", "Rendered", ["browser-rendered"], {"source": "rendered"}, 0.8)
    b = rows[2]
    assert not b.changed and (b.quantity, b.category_slug, b.enriched_by) == (3, "food", [])


def test_selection(spark):
    reg = spark.createDataFrame([("v", "VERIFIED"), ("p", "PARTIAL"), ("b", "BLOCKED")], "slug STRING, status STRING")
    assert [r.slug for r in quality.eligible_stores(reg).collect()] == ["v"]
    assert [r.slug for r in quality.eligible_stores(reg, ["partial"], ["p"]).collect()] == ["p"]
    with pytest.raises(ValueError, match="Unsupported registry status: LIVE"):
        quality.eligible_stores(reg, ["live"])


def test_registry_duplicates_and_evidence(spark):
    cols = "idx INT, slug STRING, name STRING, domain STRING, status STRING, source STRING, statusReason STRING, verifiedAt STRING, coverageReport STRING, locationCoverageReport STRING, categories ARRAY<STRING>, physicalLocationStockRequired BOOLEAN"
    rows = [(0, "a", "A", "https://A.md/x", "DISCOVERED", "s", None, None, None, None, ["f"], None), (1, "a", "", "http://", "LIVE", "s", None, None, None, "r", [], None),
            (2, "c", "C", "https://a.md", "VERIFIED", "s", None, "soon", "r", None, ["f"], True), (3, "d", "D", "nope", "BLOCKED", "s", None, None, None, None, ["f"], None)]
    errors = {}
    for r in validate.validate_registry(spark.createDataFrame(rows, cols)).collect():
        errors.setdefault(r.idx, set()).add(r.error)
    assert 0 not in errors
    assert errors[1] >= {"store[1].name must be a non-empty string.", "Duplicate store slug: a", 'a: unsupported status "LIVE".', "a: invalid domain URL.",
                         "a: categories must be a non-empty string array.", "a: locationCoverageReport is only valid when physicalLocationStockRequired=true."}
    assert errors[2] == {"Duplicate store domain: https://a.md", "c: VERIFIED requires a valid verifiedAt timestamp.", "c: VERIFIED physical chain requires locationCoverageReport evidence."}
    assert errors[3] == {"d: invalid domain URL.", "d: BLOCKED requires statusReason."}


def test_reconcile_is_strict(spark):
    import datetime as dt
    at = dt.datetime(2026, 1, 2)
    offers = spark.createDataFrame([("s", 1, at, "IN_STOCK", 3, at), ("s", 2, at - dt.timedelta(seconds=1), "IN_STOCK", 3, at), ("t", 3, at - dt.timedelta(days=9), "IN_STOCK", 3, at)],
                                   "store_id STRING, id INT, last_seen_at TIMESTAMP_NTZ, stock_status STRING, quantity INT, last_stock_update TIMESTAMP_NTZ")
    got = {r.id: (r.marked, r.stock_status, r.quantity) for r in upsert.reconcile_missing(offers, "s", at).collect()}
    assert got == {1: (False, "IN_STOCK", 3), 2: (True, "OUT_OF_STOCK", None), 3: (False, "IN_STOCK", 3)}
    assert not any(r.marked for r in upsert.reconcile_missing(offers, "s", at, failed=1).collect())


@pytest.mark.parametrize("name, table", [("src5_explode_xml_offers_whole", "part"), ("src6_explode_csv_whole", "part"), ("dd3_drop_services_kept", "documents")])
def test_whole_tables_are_read_and_returned(spark, name, table):
    import __spark_entry__
    from oracle import compare, connect

    folder = "/root/testdata/sf0.001"
    rows, problem, _ = compare(spark, connect(folder), folder, __spark_entry__.queries()[name], __spark_entry__.oracle_sql()[name])
    kept = spark.read.parquet(f"{folder}/{table}.parquet").count()
    if table == "documents":
        kept -= __spark_entry__.queries()["dd3_drop_services"](spark, folder).first()[0]
    assert problem is None and rows == kept
