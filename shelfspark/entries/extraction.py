"""Registered source and extraction queries.

Feeds, API answers and product pages are built from ``part`` rows, so the
expected result is ``part`` itself; links and profiles read ``pages``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark import rules
from shelfspark.entries.importing import _text
from shelfspark.functions.text import url_part
from shelfspark.operators import extract, links, network
from shelfspark.plans.views import Catalogue, with_views
from shelfspark.sources import feeds

QUERIES, SQL = {}, {}
HOST = r"regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"


def entry(name, sql, *views):
    def register(fn):
        QUERIES[name] = lambda spark, folder: fn(Catalogue(spark, folder))
        if sql is not None:
            SQL[name] = with_views(sql, *views)
        return fn
    return register


def _part(c):
    return c.spread("part").withColumn("price", F.col("p_retailprice").cast("decimal(14,2)"))


def _item():
    k = F.col("p_partkey")
    return F.struct(
        F.col("p_name").alias("name"), F.struct(F.col("price").cast("string").alias("amount"), F.lit("eur").alias("currency")).alias("price"),
        F.col("p_size").alias("stock"), F.struct(F.col("p_brand").alias("name")).alias("brand"), k.alias("id"),
        F.array(F.struct(_text("/img/", k, ".png").alias("url"))).alias("images"), F.struct(F.col("p_type").alias("name")).alias("category"),
        _text("/p/", k).alias("url"))


def _json_docs(c):
    body = F.to_json(F.struct(F.lit("ok").alias("status"), F.struct(F.array(_item()).alias("products"), F.struct(F.lit("x").alias("label")).alias("note")).alias("data")))
    return _part(c).select("p_partkey", body.alias("body"), F.lit("https://s.example/").alias("base_url"), _text("https://s.example/api/", F.col("p_partkey")).alias("page_url"))


_STOCK_BY_SIZE = "CASE WHEN p_size <= 0 THEN 'OUT_OF_STOCK' WHEN p_size <= 10 THEN 'LOW_STOCK' ELSE 'IN_STOCK' END"
_JSON_SQL = f"""SELECT p_partkey, p_name AS title, CAST(p_retailprice AS DECIMAL(14,2)) AS price, p_brand AS brand, p_size AS quantity, {_STOCK_BY_SIZE} AS stock_status,
  'EUR' AS currency, CAST(p_partkey AS VARCHAR) AS external_id, p_type AS category, 'https://s.example/p/' || p_partkey AS url, 'https://s.example/img/' || p_partkey || '.png' AS image_url FROM part"""


@entry("src1_observation_lines", """SELECT count(*) FILTER (WHERE event_id % 10 <> 0) AS good, count(*) FILTER (WHERE event_id % 10 = 0) AS broken FROM events""")
def _(c):
    line = F.when(F.col("event_id") % 10 == 0, _text("{broken ", F.col("event_id"))).otherwise(F.to_json(F.struct(
        F.lit("store-1").alias("store_slug"), F.col("event_type").alias("title"), F.col("value").cast("string").alias("price"))))
    from shelfspark.sources.observations import _with_corrupt
    from pyspark.sql import types as T
    plain = T.StructType([f for f in _with_corrupt().fields if not isinstance(f.dataType, T.VariantType)])
    rows = c.table("events").select(F.from_json(line, plain, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("o"))
    bad = F.col("o._corrupt_record").isNotNull()
    return rows.agg(F.count_if(~bad).alias("good"), F.count_if(bad).alias("broken"))


@entry("src3_read_feed", """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'json' WHEN 1 THEN 'xml' ELSE 'csv' END AS kind, p_name AS name, CAST(CAST(p_retailprice AS DECIMAL(14,2)) AS VARCHAR) AS price FROM part""")
def _(c):
    records = feeds.read_feed(_feed_docs(c), ["p_partkey", "kind"])
    named = F.col("record")["name"].isNotNull()
    return records.filter(named).select("p_partkey", "kind", F.col("record")["name"].alias("name"), F.col("record")["price"].alias("price"))


def _feed_bodies():
    """An XML, a CSV and a JSON feed body of a ``part`` row."""
    k = F.col("p_partkey")
    price = F.col("price").cast("string")
    xml = _text("<?xml version=\"1.0\"?><yml><shop><Offer id=\"", k, "\"><name>", F.col("p_name"), "</name><price>", price, "</price><vendor>", F.col("p_brand"),
                "</vendor><available>true</available><url>/p/", k, "</url></Offer></shop></yml>")
    csv_text = _text("ID,name,price,Brand,In_Stock,link\n", k, ",", F.col("p_name"), ",", price, ",", F.col("p_brand"), ",yes,/p/", k, "\n")
    obj = F.to_json(F.struct(F.struct(F.array(F.struct(
        k.alias("Id"), F.col("p_name").alias("name"), price.alias("price"), F.col("p_brand").alias("vendor"), F.lit(True).alias("available"), _text("/p/", k).alias("url"))).alias("items")).alias("feed")))
    return xml, csv_text, obj


def _feed_docs(c):
    k = F.col("p_partkey")
    xml, csv_text, obj = _feed_bodies()
    kind = F.when(k % 3 == 0, "json").when(k % 3 == 1, "xml").otherwise("csv")
    body = F.when(k % 3 == 0, obj).when(k % 3 == 1, xml).otherwise(csv_text)
    return _part(c).select("p_partkey", kind.alias("kind"), body.alias("body"), F.lit("").alias("content_type"),
                           F.lit("https://s.example/").alias("base_url"), F.lit("https://s.example/feed").alias("feed_url"))


@entry("src4_explode_json_objects", "SELECT p_partkey, CAST(1 AS BIGINT) AS products, CAST(8 AS BIGINT) AS objects FROM part")
def _(c):
    docs = _json_docs(c).select("p_partkey", F.try_parse_json("body").alias("_doc"))
    objects = feeds.walk_json(docs, ["p_partkey"], "_doc")
    return objects.groupBy("p_partkey").agg(F.count_if(feeds.looks_like_product()).alias("products"), F.count("*").alias("objects"))


@entry("src5_explode_xml_offers", "SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS id, p_brand AS vendor FROM part WHERE p_partkey % 3 = 1")
def _(c):
    docs = _feed_docs(c).filter("kind = 'xml'")
    return feeds.explode_xml_offers(docs, ["p_partkey"], "body").select("p_partkey", F.col("record")["id"].alias("id"), F.col("record")["vendor"].alias("vendor"))


@entry("src6_explode_csv", "SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS id, p_brand AS brand FROM part WHERE p_partkey % 3 = 2")
def _(c):
    docs = _feed_docs(c).filter("kind = 'csv'")
    return feeds.explode_csv(docs, ["p_partkey"], "body").select("p_partkey", F.col("record")["ID"].alias("id"), F.col("record")["Brand"].alias("brand"))


# The two queries above keep their SQL over a third of part; these read a body of every row.
@entry("src5_explode_xml_offers_whole", "SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS id, p_brand AS vendor FROM part")
def _(c):
    docs = _part(c).select("p_partkey", _feed_bodies()[0].alias("body"))
    return feeds.explode_xml_offers(docs, ["p_partkey"], "body").select("p_partkey", F.col("record")["id"].alias("id"), F.col("record")["vendor"].alias("vendor"))


@entry("src6_explode_csv_whole", "SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS id, p_brand AS brand FROM part")
def _(c):
    docs = _part(c).select("p_partkey", _feed_bodies()[1].alias("body"))
    return feeds.explode_csv(docs, ["p_partkey"], "body").select("p_partkey", F.col("record")["ID"].alias("id"), F.col("record")["Brand"].alias("brand"))


@entry("src7_read_pages", "SELECT page_id, url FROM pages")
def _(c):
    from shelfspark.sources.observations import read_pages
    return read_pages(c.spark, f"{c.folder}/pages.parquet").select("page_id", "url")


@entry("src8_explode_sitemaps", "SELECT DISTINCT url FROM pages")
def _(c):
    # Sitemap files are cut at a thousand pages and index files at a thousand sitemaps, so no document grows with a host.
    host, file_no = url_part("url", "netloc"), F.floor(F.col("page_id") / 1000)
    rows = c.table("pages").select(host.alias("host"), file_no.alias("part"), "url")
    name = _text("https://", F.col("host"), "/map-", F.col("part"), ".xml")
    loc = F.concat(F.lit("<url><loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>"))
    ns = ' xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'
    leaves = rows.groupBy(name.alias("url"), "host", "part").agg(
        F.concat(F.lit("<urlset" + ns), F.array_join(F.collect_list(loc), ""), F.lit("</urlset>")).alias("body"))
    child = F.concat(F.lit("<sitemap><loc>"), F.col("url"), F.lit("</loc></sitemap>"))
    index = leaves.groupBy(_text("https://", F.col("host"), "/sitemap-", F.floor(F.col("part") / 1000), ".xml").alias("url")).agg(
        F.concat(F.lit("<sitemapindex" + ns), F.array_join(F.collect_list(child), ""), F.lit("</sitemapindex>")).alias("body"))
    return feeds.explode_sitemaps(leaves.select("url", "body").unionByName(index), index.select("url"))


@entry("src9_follow_pages", """SELECT 'https://s.example/c/' || c AS endpoint, CAST(d AS INT) AS depth, 'https://s.example/c/' || c || CASE WHEN d = 1 THEN '' ELSE '?page=' || d END AS url
  FROM (SELECT o_custkey AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS d FROM orders)""")
def _(c):
    per = c.table("orders").groupBy(F.col("o_custkey").alias("c")).agg(F.count("*").alias("n"))
    pages = per.select("c", "n", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("d"))
    base = _text("https://s.example/c/", F.col("c"))
    nxt = F.when(F.col("d") < F.col("n"), F.when(F.col("d") % 2 == 0, F.struct(F.lit(None).cast("string").alias("next"), F.struct(_text("?page=", F.col("d") + 1).alias("next")).alias("links")))
                 .otherwise(F.struct(_text("/c/", F.col("c"), "?page=", F.col("d") + 1).alias("next"), F.lit(None).cast("struct<next:string>").alias("links"))))
    docs = pages.select(F.when(F.col("d") == 1, base).otherwise(_text(base, "?page=", F.col("d"))).alias("url"), F.coalesce(F.to_json(nxt), F.lit("{}")).alias("body"))
    return feeds.follow_pages(docs, per.select(base.alias("endpoint")))


@entry("ext01_products_from_json", _JSON_SQL)
def _(c):
    objects = feeds.explode_json_objects(_json_docs(c), ["p_partkey", "base_url", "page_url"], "body")
    return extract.products_from_json(objects, ["p_partkey"]).select(
        "p_partkey", "title", "price", "brand", "quantity", "stock_status", "currency", "external_id", F.col("category_path")[0].alias("category"), "url", "image_url")


@entry("ext02_products_from_feed", """SELECT p_partkey, p_name AS title, CAST(p_retailprice AS DECIMAL(14,2)) AS price, p_brand AS brand, 'IN_STOCK' AS stock_status,
  CAST(p_partkey AS VARCHAR) AS external_id, 'https://s.example/p/' || p_partkey AS url FROM part""")
def _(c):
    records = feeds.read_feed(_feed_docs(c), ["p_partkey", "base_url", "feed_url"])
    return extract.products_from_feed(records, ["p_partkey"]).select("p_partkey", "title", "price", "brand", "stock_status", "external_id", "url")


@entry("ext03_products_from_jsonld", """SELECT p_partkey, p_name AS title, CAST(p_retailprice AS DECIMAL(14,2)) AS price, p_brand AS brand, 'LED ' || p_type AS description,
   'PREORDER' AS stock_status, CAST(p_partkey AS VARCHAR) AS external_id FROM part""")
def _(c):
    k = F.col("p_partkey")
    product = F.struct(
        F.array(F.lit("Thing"), F.lit("Product")).alias("@type"), F.col("p_name").alias("name"), F.struct(F.col("p_brand").alias("name")).alias("brand"),
        _text("<b>LED</b> ", F.col("p_type")).alias("description"), F.lit("").alias("sku"), k.cast("string").alias("gtin13"),
        F.array(F.struct(F.col("price").cast("string").alias("lowPrice"), F.lit("https://schema.org/PreOrder").alias("availability"))).alias("offers"))
    other = F.struct(F.lit("Product").alias("@type"), F.lit("first in graph").alias("name"))
    # The last item of a graph is looked at first.
    graph = F.concat(F.lit('{"@graph":['), F.to_json(other), F.lit(","), F.to_json(product), F.lit("]}"))
    html = F.concat(F.lit("<html><script type=\"application/ld+json\">not json</script><SCRIPT type='application/ld+json'>"), graph, F.lit("</SCRIPT></html>"))
    pages = _part(c).select("p_partkey", _text("https://s.example/p/", k).alias("url"), html.alias("html"))
    return extract.products_from_jsonld(pages, ["p_partkey"]).select("p_partkey", "title", "price", "brand", "description", "stock_status", "external_id")


def _product_pages(c):
    k = F.col("p_partkey")
    html = _text(
        "<html><head><meta property='product:price:currency' content='mdl'><meta property='og:image' content='/pic/", k, ".jpg'></head><body><nav aria-label='Breadcrumb'><a href='/'>Home</a><a href='/t'>",
        F.col("p_type"), "</a></nav><main><h1> ", F.col("p_name"), " </h1><div class='x price big'><span>", F.replace(F.col("price").cast("string"), F.lit("."), F.lit(",")),
        " MDL</span></div><del>", F.col("price") + 5, "</del><p>Cod produs: P-", k, "<p>Disponibilitate: ", F.col("p_size"), " buc</main><span itemprop=brand>", F.col("p_brand"), "</span></body></html>")
    return _part(c).select("p_partkey", _text("https://s.example/cat/item/", k).alias("url"), html.alias("html"))


_HTML_SQL = f"""SELECT p_partkey, p_name AS title, CAST(p_retailprice AS DECIMAL(14,2)) AS price, CAST(p_retailprice AS DECIMAL(14,2)) + 5 AS old_price, p_brand AS brand, 'P-' || p_partkey AS external_id,
  p_size AS quantity, {_STOCK_BY_SIZE} AS stock_status, p_type AS path, 'MDL' AS currency, 'https://s.example/pic/' || p_partkey || '.jpg' AS image_url FROM part"""


def _html_columns(rows):
    return rows.select("p_partkey", "title", "price", "old_price", "brand", "external_id", "quantity", "stock_status",
                       F.array_join("category_path", "/").alias("path"), "currency", "image_url")


@entry("ext04_products_from_html", _HTML_SQL)
def _(c):
    return _html_columns(extract.products_from_html(_product_pages(c), ["p_partkey"]))


@entry("ext05_products_from_rendered", _HTML_SQL)
def _(c):
    return _html_columns(extract.products_from_html(_product_pages(c), ["p_partkey"], mode="rendered"))


@entry("ext06_pick_image", """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '/real-' || p_partkey || '.png' WHEN p_partkey % 3 = 1 THEN '/big-' || p_partkey || '.png' END AS image FROM part""")
def _(c):
    from shelfspark.functions.html import parse_product_page
    k = F.col("p_partkey")
    html = _text("<main><img data-src='", F.when(k % 3 == 0, _text("/real-", k, ".png")).otherwise(""), "' src='/placeholder.png' srcset='",
                 F.when(k % 3 == 1, _text("/small-", k, ".png 1x, /big-", k, ".png 2x")).otherwise("/sprite.png 1x"), "'></main><meta property='og:image' content='/share-", k, ".png'>")
    parsed = c.spread("part").select("p_partkey", parse_product_page(html).alias("h"))
    return parsed.select("p_partkey", extract.pick_image(F.col("h.images")).alias("image"))


@entry("ext07_branch_stock", """SELECT p_partkey, city, address, stock_status FROM (
   SELECT p_partkey, 'Chișinău' AS city, 'str. ' || p_name AS address, 'IN_STOCK' AS stock_status FROM part
   UNION ALL SELECT p_partkey, 'Orhei', 'bd. ' || p_partkey, 'OUT_OF_STOCK' FROM part)""")
def _(c):
    k = F.col("p_partkey")
    body = _text("Magazine Chisinau - str. ", F.col("p_name"), " Harta 1 În stoc Orhei - bd. ", k, " Stoc epuizat Chișinău - str. ", F.col("p_name"), " Stoc epuizat")
    return extract.branch_stock(c.spread("part").select("p_partkey", body.alias("page_text")), ["p_partkey"]).select("p_partkey", "city", "address", "stock_status")


@entry("ext07_branch_roll_up", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'IN_STOCK' ELSE 'OUT_OF_STOCK' END AS stock_status, CAST(1 AS BIGINT) AS branch_count FROM part")
def _(c):
    k = F.col("p_partkey")
    products = c.spread("part").select("p_partkey", F.lit("UNKNOWN").alias("stock_status"),
                                      _text("Orhei - bd. ", k, F.when(k % 2 == 0, " În stoc").otherwise(" Stoc epuizat")).alias("page_text"))
    rolled = extract.branch_roll_up(products, extract.branch_stock(products, ["p_partkey"]), ["p_partkey"])
    return rolled.select("p_partkey", "stock_status", "branch_count")


@entry("ext08_field_fallbacks", "SELECT p_partkey, 'M' || p_partkey AS sku, p_brand AS brand, 'https://s.example/og-image/' || p_partkey AS image_url FROM part")
def _(c):
    k = F.col("p_partkey")
    rows = c.spread("part").select(
        "p_partkey", _text("https://s.example/", k).alias("url"), F.lit(None).cast("string").alias("sku"), _text("key-", k).alias("external_id"), F.lit(None).cast("string").alias("brand"),
        F.lit(None).cast("string").alias("image_url"), _text("Код товара: M", k, " Производитель: ", F.translate("p_brand", "#", ""), " Характеристики").alias("page_text"),
        F.array(F.struct(_text("/og-image/", k).alias("url"), F.lit(True).alias("social"))).alias("images"))
    return extract.field_fallbacks(rows).select("p_partkey", "sku", F.concat(F.left("brand", F.lit(5)), F.lit("#"), F.substr("brand", F.lit(6))).alias("brand"), "image_url")


def _network(c):
    k = F.col("p_partkey")
    pages = _part(c).select(k.alias("page_id"), F.col("p_name").alias("title"), k.cast("string").alias("sku"), F.lit(None).cast("string").alias("ean"), k.cast("string").alias("external_id"),
                            _text("https://s.example/ro/p/", k).alias("url"), F.lit("UNKNOWN").alias("stock_status"), F.lit(None).cast("int").alias("quantity"),
                            F.lit("https://s.example/default.webp").alias("image_url"), F.col("p_brand").alias("brand"), F.lit("").alias("description"), F.array("p_type").alias("category_path"))
    good = F.struct(k.alias("id"), F.col("p_name").alias("name"), F.col("price"), F.col("p_size").alias("stock"), _text("/media/", k).alias("image"), _text("/p/", k).alias("url"))
    bad = F.struct(_text("z", k).alias("id"), F.lit("Complet diferit").alias("name"), F.lit(10).alias("price"), F.lit(3).alias("stock"))
    body = F.when(k % 4 == 0, F.to_json(F.struct(F.array(bad).alias("products")))).otherwise(
        F.concat(F.lit('{"products":['), F.to_json(bad), F.lit(","), F.to_json(good), F.lit("]}")))
    responses = _part(c).select(k.alias("page_id"), F.lit(0).alias("response"), F.lit("https://s.example/api/list?token=secret").alias("response_url"), body.alias("body"), F.lit("https://s.example/").alias("base_url"))
    return pages, responses


def _network_matches(c):
    pages, responses = _network(c)
    objects = feeds.explode_json_objects(responses, ["page_id", "response", "base_url", "response_url"], "body")
    candidates = extract.products_from_json(objects, ["page_id", "response"], page_url="response_url")
    return pages, responses, network.match_network_product(pages, candidates)


@entry("ext09_match_network_product", "SELECT p_partkey AS page_id, CAST(p_partkey AS VARCHAR) AS n_external_id, 23.0 AS score FROM part WHERE p_partkey % 4 <> 0")
def _(c):
    _pages, _responses, matches = _network_matches(c)
    return matches.select("page_id", "n_external_id", "score")


@entry("ext10_merge_network_product", f"""SELECT p_partkey AS page_id, CASE WHEN p_partkey % 4 = 0 THEN 'UNKNOWN' ELSE {_STOCK_BY_SIZE} END AS stock_status, CASE WHEN p_partkey % 4 <> 0 THEN p_size END AS quantity,
  CASE WHEN p_partkey % 4 = 0 THEN 'https://s.example/default.webp' ELSE 'https://s.example/media/' || p_partkey END AS image_url, p_partkey % 4 <> 0 AS network_json_product_match, 1 AS network_json_responses FROM part""")
def _(c):
    pages, responses, matches = _network_matches(c)
    merged = network.merge_network_product(pages, matches, responses)
    return merged.select("page_id", "stock_status", "quantity", "image_url", "network_json_product_match", "network_json_responses")


@entry("ext11_json_shapes", """SELECT p_partkey AS page_id, '/api/list' AS path, 'object' AS root_type, 'products' AS top_keys, CAST(CASE WHEN p_partkey % 4 = 0 THEN 2 ELSE 3 END AS BIGINT) AS object_count,
  CAST(CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 2 END AS BIGINT) AS product_like_count, CAST(CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 2 END AS BIGINT) AS id_like_count,
  CAST(CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 2 END AS BIGINT) AS stock_like_count FROM part""")
def _(c):
    return network.json_shapes(_network(c)[1]).withColumn("top_keys", F.array_join("top_keys", ",")).drop("response")


@entry("ext12_catalog_estimate", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 94000 + p_partkey WHEN 1 THEN 163000 + p_partkey WHEN 2 THEN 50000 END AS estimate,
   CASE p_partkey % 4 WHEN 2 THEN 'lower-bound' WHEN 3 THEN 'unknown' ELSE 'exact' END AS estimate_kind FROM part""")
def _(c):
    k = F.col("p_partkey")
    spaced = lambda n: F.regexp_replace(n.cast("string"), r"(\d{3})$", r" $1")
    rows = c.spread("part").select(
        "p_partkey", F.when(k % 4 == 0, "darwin").when(k % 4 == 1, "maximum").when(k % 4 == 2, "supraten").otherwise("cactus").alias("store_slug"),
        F.when(k % 4 == 0, _text("Найдено товаров: ", spaced(k + 94000))).when(k % 4 == 1, _text("поиск среди ", spaced(k + 163000), " товаров"))
        .when(k % 4 == 2, "Свыше 50 000 товаров!").otherwise("Каталог").alias("text"))
    return extract.catalog_estimate(rows).select("p_partkey", "estimate", "estimate_kind")


_LINKS_SQL = f"""a AS (SELECT page_id, url AS page_url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)"""


def _any_sql(column, tokens):
    return "(" + " OR ".join(f"contains({column}, '{t}')" for t in tokens) + ")"


@entry("ext13_extract_links", f"""WITH a AS (SELECT page_id, url AS page_url, unnest(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')) AS tag FROM pages),
  b AS (SELECT page_id, regexp_extract(tag, 'href="([^"]*)"', 1) AS href, lower(regexp_extract(tag, '>([^<]*)<', 1)) AS label, regexp_extract(page_url, '^([a-z]+://[^/?#]*)', 1) AS origin FROM a)
  SELECT page_id, href, origin || href AS url, CASE WHEN contains(lower(href), 'novosti') OR {_any_sql('lower(href)', rules.SKIP_TOKENS)} THEN 'skip'
    WHEN {_any_sql('lower(href)', rules.PRODUCT_PATH_TOKENS)} THEN 'product'
    WHEN {_any_sql('lower(href)', rules.LISTING_PATH_TOKENS)} OR {_any_sql('label', rules.LISTING_TEXT_TOKENS)} THEN 'listing' ELSE 'skip' END AS kind FROM b""")
def _(c):
    return links.extract_links(c.table("pages"), ["page_id"]).select("page_id", "href", "url", "kind")


@entry("ext13_anchor_hrefs", f"WITH {_LINKS_SQL} SELECT page_id, href FROM a")
def _(c):
    return links.extract_links(c.table("pages"), ["page_id"]).select("page_id", "href")


def _site_links(c):
    """Listing tree: customers are listing pages below their nation, orders are products of a customer page."""
    site = _text("n", F.col("c_nationkey"))
    root = _text("https://s.example/n/", F.col("c_nationkey"))
    page = _text("https://s.example/c/", F.col("c_custkey"))
    cust = c.table("customer")
    nav = cust.select(site.alias("site"), root.alias("page_url"), page.alias("url"), F.lit("listing").alias("kind"))
    goods = cust.join(c.table("orders"), F.col("o_custkey") == F.col("c_custkey")).select(
        site.alias("site"), page.alias("page_url"), _text("https://s.example/o/", F.col("o_orderkey")).alias("url"), F.lit("product").alias("kind"))
    seeds = cust.select(site.alias("site"), root.alias("url")).distinct()
    return nav.unionByName(goods), seeds


@entry("ext14_reachable_products", """WITH p AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY 'https://s.example/c/' || c_custkey) AS rk FROM customer)
  SELECT 'n' || c_nationkey AS site, 'https://s.example/o/' || o_orderkey AS url FROM p JOIN orders ON o_custkey = c_custkey""")
def _(c):
    rows, seeds = _site_links(c)
    return links.reachable_products(rows, seeds)[0]


@entry("ext14_reachable_summary", """SELECT 'n' || c_nationkey AS site, count(*) + 1 AS pages_visited, false AS cap_reached FROM customer GROUP BY 1""")
def _(c):
    rows, seeds = _site_links(c)
    return links.reachable_products(rows, seeds)[1]


@entry("ext15_api_candidates", f"""SELECT DISTINCT page_id, origin || '/api/v2/list?page=' || page_id AS api_url FROM (SELECT *, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin FROM pages)
   UNION SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/data/feed.json' FROM pages""")
def _(c):
    script = _text("<script>fetch(\"/api/v2/list?page=", F.col("page_id"), "\"); axios.get('/data/feed.json'); fetch('https://other.example/api/x'); fetch('/about')</script>")
    return links.api_candidates(c.table("pages").withColumn("html", F.concat("html", script)), ["page_id"])


@entry("ext16_source_profile", f"""SELECT {HOST} AS site, count(*) AS pages, bool_or(page_id % 3 = 0) AS product_jsonld, bool_or(page_id % 5 = 0) AS html_product_hints, false AS embedded_json,
   'https://feeds.example/all.xml' AS feed_urls, CAST(count(DISTINCT url_key) AS INT) AS n_api FROM (SELECT *, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/api/p' || page_id AS url_key FROM pages) GROUP BY 1""")
def _(c):
    k = F.col("page_id")
    extra = _text(F.when(k % 3 == 0, '<script type="application/ld+json">{"@type": "Product"}</script>').otherwise(""),
                  F.when(k % 5 == 0, '<div class="a product-card">x</div>').otherwise(""), '<link rel="x" href="https://feeds.example/all.xml"><a href="/api/p', k, '">api</a>')
    rows = links.source_profile(c.table("pages").withColumn("html", F.concat("html", extra)), url_part("url", "netloc"))
    return rows.select("site", "pages", "product_jsonld", "html_product_hints", "embedded_json", F.array_join("feed_urls", ",").alias("feed_urls"), F.size("api_urls").alias("n_api"))


@entry("ext17_robots_allowed", r"""WITH p AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, length(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) % 3 AS k FROM pages)
  SELECT page_id, CASE k WHEN 0 THEN true WHEN 1 THEN false ELSE starts_with(path, '/fr/') OR NOT (starts_with(path, '/fr') OR starts_with(path, '/en')) END AS allowed FROM p""")
def _(c):
    host = url_part("url", "netloc")
    kind = F.length("site") % 3
    robots = c.table("pages").select(host.alias("site")).distinct().select(
        "site", _text("https://", F.col("site")).alias("origin"), F.when(kind == 0, "MISSING").when(kind == 1, "UNAVAILABLE").otherwise("AVAILABLE").alias("status"),
        F.lit("User-agent: *\nDisallow: /\n\nUser-agent: offerbot\nAllow: /fr/\nDisallow: /fr\nDisallow: /en\n").alias("body"))
    urls = c.table("pages").select("page_id", "url", host.alias("site"))
    return links.robots_allowed(urls, robots).select("page_id", "allowed")


@entry("ext18_acquisition_plan", """WITH s AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 7 = 0 THEN 'darwin' ELSE 'store-' || s_suppkey END AS store_slug FROM supplier),
  r AS (SELECT k, store_slug, 10 AS priority, 'json-api' AS connector FROM s WHERE k % 2 = 0 UNION ALL SELECT k, store_slug, 20, 'catalog-feed' FROM s WHERE k % 3 = 0
   UNION ALL SELECT k, store_slug, 25, 'darwin-catalog' FROM s WHERE k % 7 = 0 UNION ALL SELECT k, store_slug, 30, 'sitemap-jsonld' FROM s WHERE k % 5 = 0
   UNION ALL SELECT k, store_slug, 34, 'catalog-generic' FROM s UNION ALL SELECT k, store_slug, 40, 'html-generic' FROM s UNION ALL SELECT k, store_slug, 50, 'browser-rendered' FROM s)
  SELECT store_slug, priority, connector, priority = min(priority) OVER (PARTITION BY k) AS choice FROM r""")
def _(c):
    k = F.col("s_suppkey")
    one = lambda test: F.when(test, F.array(F.lit("u"))).otherwise(F.array().cast("array<string>"))
    profiles = c.table("supplier").select(
        F.when(k % 7 == 0, "darwin").otherwise(_text("store-", k)).alias("store_slug"), one(k % 2 == 0).alias("api_urls"), one(k % 3 == 0).alias("feed_urls"),
        one(F.lit(False)).alias("sitemap_urls"), one(F.lit(True)).alias("catalog_urls"), (k % 5 == 0).alias("product_jsonld"), F.lit(False).alias("embedded_json"))
    return links.acquisition_plan(profiles).select("store_slug", "priority", "connector", "choice")
