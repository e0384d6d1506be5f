"""Registered validation, matching and upsert queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.operators import match, similar, upsert, validate
from shelfspark.plans.views import Catalogue, with_views

SPLIT = "1999-01-01 00:00:00"
QUERIES, SQL = {}, {}

RAW_SQL = """raw AS (SELECT o.offer_id AS seq, 'store-' || o.store_id AS store_slug, o.store_id, o.product_id,
  CASE WHEN o.store_id % 9 = 0 THEN '' ELSE 'x' || o.offer_id END AS external_id, p.title, lower(p.title) AS normalized_title,
  CASE WHEN o.store_id % 4 = 0 THEN NULL ELSE p.brand END AS brand,
  CASE WHEN o.store_id % 4 = 0 THEN NULL ELSE lower(p.brand) END AS normalized_brand,
  CASE WHEN o.store_id % 2 = 0 THEN NULL ELSE p.ean END AS ean, p.mpn, p.sku, 'nation_' || (o.product_id % 30) AS category_slug,
  o.price, o.stock_status, o.quantity, 'https://store-' || o.store_id || '.example/p/' || o.product_id AS url,
  CASE WHEN o.store_id % 3 = 0 THEN NULL ELSE 'https://img.example/' || o.product_id END AS image_url,
  (o.store_id % 5) * 10 AS source_priority, CAST(o.store_id % 10 AS DOUBLE) / 10 AS data_quality, o.last_seen_at AS seen_at
  FROM fx_offer o JOIN fx_product p ON o.product_id = p.product_id)"""


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def raw(c: Catalogue):
    """Raw observations: every offer with the identity fields of its product, some of them withheld."""
    s, p = F.col("store_id"), F.col("product_id")
    rows = c.offer.join(c.product.drop("price", "category_slug"), "product_id")
    return rows.select(
        F.col("offer_id").alias("seq"), _text("store-", s).alias("store_slug"), "store_id", "product_id",
        F.when(s % 9 == 0, "").otherwise(_text("x", F.col("offer_id"))).alias("external_id"), "title",
        F.lower("title").alias("normalized_title"), F.when(s % 4 != 0, F.col("brand")).alias("brand"),
        F.when(s % 4 != 0, F.lower("brand")).alias("normalized_brand"), F.when(s % 2 != 0, F.col("ean")).alias("ean"),
        "mpn", "sku", _text("nation_", p % 30).alias("category_slug"), "price", "stock_status", "quantity",
        _text("https://store-", s, ".example/p/", p).alias("url"),
        F.when(s % 3 != 0, _text("https://img.example/", p)).alias("image_url"),
        ((s % 5) * 10).alias("source_priority"), ((s % 10).cast("double") / 10).alias("data_quality"),
        F.col("last_seen_at").alias("seen_at"))


def entry(name, sql, *views):
    def register(fn):
        QUERIES[name] = lambda spark, folder: fn(Catalogue(spark, folder))
        if sql is not None:
            SQL[name] = with_views(sql, *views)
        return fn
    return register


RAW = ("fx_offer", "fx_product")

_REASON = """CASE WHEN seq1 % 17 = 0 THEN 'store_slug is required.' WHEN seq1 % 13 = 0 THEN 'title is required.'
  WHEN seq1 % 11 = 0 THEN 'price must be a positive number, received ''' || ptext || '''.'
  WHEN seq1 % 7 = 0 THEN 'url must be absolute, received ''/p/' || product_id || '''.'
  WHEN seq1 % 19 = 0 THEN 'url protocol ''ftp:'' is not supported.'
  WHEN seq1 % 23 = 0 THEN 'availability.city is required when availability is provided.'
  WHEN seq1 % 29 = 0 THEN 'availability coordinates must be a valid latitude/longitude pair.' END"""
_CHECKED = f"""c AS (SELECT seq1, seq2, {_REASON} AS reason FROM (SELECT *, CASE WHEN seq1 % 2 = 0 THEN '0' ELSE 'abc' END AS ptext FROM fx_obs))"""


def _checked(c):
    k = F.col("seq1")
    hours = ("struct<version:int,kind:string,timezone:string,weekly:map<string,array<struct<open:string,close:string>>>,"
             "temporarilyClosed:boolean>")
    branch = F.struct(
        F.when(k % 23 == 0, " ").otherwise("Orhei").alias("city"), F.when(k % 29 == 0, 95.0).otherwise(47.0).alias("latitude"),
        F.lit(28.0).alias("longitude"), F.lit(None).cast(hours).alias("opening_hours"))
    rows = c.obs.select(
        "seq1", "seq2", F.when(k % 17 != 0, "store-1").otherwise("  ").alias("store_slug"),
        F.when(k % 13 != 0, "A").alias("title"), F.lit("a").alias("normalized_title"),
        F.when(k % 11 != 0, F.col("price").cast("string")).when(k % 2 == 0, "0").otherwise("abc").alias("price"),
        F.when(k % 7 == 0, _text("/p/", F.col("product_id"))).when(k % 19 == 0, "ftp://s.example/x").otherwise("https://s.example/x").alias("url"),
        F.array(branch).alias("availabilities"))
    return validate.check_observations(rows)


@entry("val1_validate_observations", f"WITH {_CHECKED} SELECT * FROM c WHERE reason IS NOT NULL", "fx_obs")
def _(c):
    return _checked(c).filter(F.col("reason").isNotNull()).select("seq1", "seq2", "reason")


@entry("val2_check_constraints", """SELECT product_id, concat_ws(',', CASE WHEN product_id % 3 = 0 THEN 'latitude' END,
  CASE WHEN product_id % 5 = 0 THEN 'data_quality' END, CASE WHEN product_id % 7 = 0 THEN 'url' END) AS broken FROM fx_product
  WHERE product_id % 3 = 0 OR product_id % 5 = 0 OR product_id % 7 = 0""", "fx_product")
def _(c):
    p = F.col("product_id")
    hours = "struct<weekly:map<string,array<struct<open:string,close:string>>>>"
    rows = c.product.select(
        "product_id", F.array(F.struct(F.when(p % 3 == 0, 90.5).otherwise(47.0).alias("latitude"), F.lit(28.0).alias("longitude"),
                                       F.lit(None).cast(hours).alias("opening_hours"))).alias("availabilities"),
        F.when(p % 5 == 0, 1.01).otherwise(1.0).alias("data_quality"),
        F.when(p % 7 == 0, "s.example").otherwise("https://s.example/").alias("url"), F.lit(None).cast("string").alias("image_url"))
    return validate.check_constraints(rows).select("product_id", F.array_join("broken", ",").alias("broken"))


@entry("val3_require_store", f"WITH {RAW_SQL} SELECT foreign_store, count(*) AS n FROM (SELECT store_slug <> 'store-7' AS foreign_store FROM raw) GROUP BY 1", *RAW)
def _(c):
    return validate.require_store(raw(c), "store-7").groupBy("foreign_store").agg(F.count("*").alias("n"))


_REGISTRY_SQL = """reg AS (SELECT s_suppkey AS idx, 'store-' || (s_suppkey - s_suppkey % 10 % 2) AS slug, s_name AS name,
  'https://' || lower(replace(s_name, '#', '')) || '.example' AS domain,
  CASE s_suppkey % 6 WHEN 0 THEN 'VERIFIED' WHEN 1 THEN 'PARTIAL' WHEN 2 THEN 'BLOCKED' WHEN 3 THEN 'ODD' ELSE 'DISCOVERED' END AS status FROM supplier)"""


def registry(c):
    k = F.col("s_suppkey")
    return c.table("supplier").select(
        k.alias("idx"), _text("store-", k - k % 10 % 2).alias("slug"), F.col("s_name").alias("name"),
        _text("https://", F.lower(F.replace("s_name", F.lit("#"), F.lit(""))), ".example").alias("domain"),
        F.when(k % 6 == 0, "VERIFIED").when(k % 6 == 1, "PARTIAL").when(k % 6 == 2, "BLOCKED").when(k % 6 == 3, "ODD")
        .otherwise("DISCOVERED").alias("status"), F.lit("seed").alias("source"),
        F.when(k % 4 == 0, "seen").alias("statusReason"), F.when(k % 12 == 0, "2001-01-01").alias("verifiedAt"),
        F.when(k % 5 != 0, "report.json").alias("coverageReport"), F.lit(None).cast("string").alias("locationCoverageReport"),
        F.when(k % 8 != 0, F.array(F.lit("food"))).otherwise(F.array().cast("array<string>")).alias("categories"),
        (k % 9 == 0).alias("physicalLocationStockRequired"))


@entry("val4_validate_registry", f"""WITH {_REGISTRY_SQL} SELECT idx, error FROM (
  SELECT idx, 'Duplicate store slug: ' || slug AS error FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY idx) AS rn FROM reg) WHERE rn > 1
  UNION ALL SELECT idx, slug || ': categories must be a non-empty string array.' FROM reg WHERE idx % 8 = 0
  UNION ALL SELECT idx, slug || ': unsupported status "ODD".' FROM reg WHERE status = 'ODD'
  UNION ALL SELECT idx, slug || ': ' || status || ' requires statusReason.' FROM reg WHERE status IN ('PARTIAL','BLOCKED') AND idx % 4 <> 0
  UNION ALL SELECT idx, slug || ': VERIFIED requires a valid verifiedAt timestamp.' FROM reg WHERE status = 'VERIFIED' AND idx % 12 <> 0
  UNION ALL SELECT idx, slug || ': VERIFIED requires coverageReport evidence.' FROM reg WHERE status = 'VERIFIED' AND idx % 5 = 0
  UNION ALL SELECT idx, slug || ': VERIFIED physical chain requires locationCoverageReport evidence.' FROM reg WHERE status = 'VERIFIED' AND idx % 9 = 0)""")
def _(c):
    return validate.validate_registry(registry(c))


@entry("val5_import_summary", f"""WITH {_CHECKED} SELECT count(*) FILTER (WHERE reason IS NULL) AS imported,
  count(*) FILTER (WHERE reason IS NOT NULL) AS failed, count(*) AS total, count(*) FILTER (WHERE reason IS NOT NULL) = 0 AS may_reconcile FROM c""", "fx_obs")
def _(c):
    return validate.import_summary(_checked(c))


@entry("val6_accept_geocode", "SELECT location_id, latitude + 1 BETWEEN 45.4 AND 48.5 AND longitude - 1 BETWEEN 26.4 AND 30.6 AS accepted FROM fx_location", "fx_location")
def _(c):
    from shelfspark.functions.geo import accept_geocode
    return c.location.select("location_id", accept_geocode(F.col("latitude") + 1, F.col("longitude") - 1).alias("accepted"))


_DD_KEY = """coalesce(nullif(ean, ''), 'mpn:' || coalesce(normalized_brand, 'None') || ':' || nullif(mpn, ''),
  store_slug || ':' || coalesce(nullif(external_id, ''), url))"""


@entry("dd1_dedupe_observations", f"""WITH {RAW_SQL} SELECT dedupe_key, seq, source_priority FROM (SELECT *, row_number() OVER (
  PARTITION BY dedupe_key ORDER BY source_priority, seq) AS rn FROM (SELECT *, {_DD_KEY} AS dedupe_key FROM raw)) WHERE rn = 1""", *RAW)
def _(c):
    return match.dedupe_observations(raw(c)).select("dedupe_key", "seq", "source_priority")


@entry("dd2_first_by_url", f"""WITH {RAW_SQL} SELECT store_slug, image_url, min(seq) AS seq FROM raw GROUP BY 1, 2""", *RAW)
def _(c):
    return match.first_by_url(raw(c), "store_slug", "image_url", ["seq"]).select("store_slug", "image_url", "seq")


@entry("dd3_drop_services", """SELECT count(*) FILTER (WHERE regexp_matches(lower(text), '\\b(consultation|consulting|service\\s+booking)\\b')) AS services_skipped FROM documents""")
def _(c):
    goods, skipped = match.drop_services(c.table("documents").withColumnRenamed("text", "title"))
    return skipped


# The query above keeps its SQL of one count; this one returns the kept rows.
@entry("dd3_drop_services_kept", """SELECT doc_id, text AS title FROM documents WHERE NOT coalesce(regexp_matches(lower(text), '\\b(consultation|consulting|service\\s+booking)\\b'), false)""")
def _(c):
    goods, skipped = match.drop_services(c.table("documents").withColumnRenamed("text", "title"))
    return goods.select("doc_id", "title")


_MT1 = f"""WITH {RAW_SQL}, pr AS (SELECT *, lower(title) AS nt FROM fx_product),
  t1 AS (SELECT ean, min(product_id) AS id FROM pr WHERE ean IS NOT NULL GROUP BY 1),
  t2 AS (SELECT mpn, brand, min(product_id) AS id FROM pr WHERE mpn IS NOT NULL GROUP BY 1, 2),
  t3 AS (SELECT sku, brand, min(product_id) AS id FROM pr WHERE sku IS NOT NULL GROUP BY 1, 2),
  t4 AS (SELECT nt, brand, min(product_id) AS id FROM pr GROUP BY 1, 2),
  t5 AS (SELECT nt, min(product_id) AS id FROM pr GROUP BY 1)
  SELECT r.seq, coalesce(t1.id, t2.id, t3.id, t4.id, t5.id) AS product_id,
    CASE WHEN t1.id IS NOT NULL THEN 'EAN' WHEN t2.id IS NOT NULL THEN 'MPN' WHEN t3.id IS NOT NULL THEN 'SKU' ELSE 'NORMALIZED_TITLE' END AS method
  FROM raw r LEFT JOIN t1 ON r.ean = t1.ean LEFT JOIN t2 ON r.mpn = t2.mpn AND r.brand = t2.brand
  LEFT JOIN t3 ON r.sku = t3.sku AND r.brand = t3.brand LEFT JOIN t4 ON r.normalized_title = t4.nt AND r.brand = t4.brand
  LEFT JOIN t5 ON r.brand IS NULL AND r.normalized_title = t5.nt"""


@entry("mt1_match_products", _MT1, *RAW)
def _(c):
    return match.match_products(raw(c), c.product.withColumn("normalized_title", F.lower("title")))


_MT2 = """WITH RECURSIVE fx_product AS ({product}),
  k AS (SELECT product_id AS seq, 1 AS tier, ean AS k, '' AS b FROM fx_product WHERE ean IS NOT NULL
    UNION ALL SELECT product_id, 2, mpn, brand FROM fx_product WHERE mpn IS NOT NULL
    UNION ALL SELECT product_id, 3, sku, brand FROM fx_product WHERE sku IS NOT NULL
    UNION ALL SELECT product_id, 4, title, brand FROM fx_product),
  f AS (SELECT tier, k, b, min(seq) AS head FROM k GROUP BY 1, 2, 3),
  h AS (SELECT k.seq, f.tier, f.head, row_number() OVER (PARTITION BY k.seq ORDER BY f.tier) AS rn FROM k JOIN f ON k.tier = f.tier AND k.k = f.k AND k.b = f.b WHERE f.head < k.seq),
  up AS (SELECT seq, head FROM h WHERE rn = 1),
  walk AS (SELECT p.product_id AS seq, coalesce(up.head, p.product_id) AS cur FROM fx_product p LEFT JOIN up ON up.seq = p.product_id
    UNION SELECT w.seq, up.head FROM walk w JOIN up ON up.seq = w.cur)
  SELECT seq, min(cur) AS root_seq FROM walk GROUP BY 1"""


def _mt2():
    from shelfspark.plans.views import VIEWS_SQL
    return _MT2.replace("{product}", VIEWS_SQL["fx_product"])


@entry("mt2_assign_new_products", _mt2())
def _(c):
    batch = c.product.withColumns({"seq": F.col("product_id"), "normalized_title": F.lower("title")})
    return match.assign_new_products(batch)


def _pairing(c):
    return c.product.withColumns({
        "normalized_title": F.lower(F.concat_ws(" ", "title", "category_slug", "brand")), "normalized_brand": F.lower("brand")})


@entry("mt4_candidate_pairs", """WITH p AS (SELECT *, lower(concat_ws(' ', title, category_slug, brand)) AS nt FROM fx_product),
  k AS (SELECT product_id, 'e' || ean AS k FROM p WHERE ean IS NOT NULL UNION ALL SELECT product_id, 'm' || mpn || '|' || brand FROM p WHERE mpn IS NOT NULL
    UNION ALL SELECT product_id, 's' || sku || '|' || brand FROM p WHERE sku IS NOT NULL UNION ALL SELECT product_id, 't' || nt FROM p),
  star AS (SELECT a_id, product_id AS b_id FROM (SELECT product_id, min(product_id) OVER (PARTITION BY k) AS a_id FROM k) WHERE a_id < product_id),
  d AS (SELECT nt, min(product_id) AS id, list_distinct(string_split(nt, ' ')) AS w FROM p GROUP BY 1, 3),
  near AS (SELECT a.id AS a_id, b.id AS b_id FROM d a JOIN d b ON a.id < b.id
    WHERE len(list_intersect(a.w, b.w)) >= 0.6 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))))
  SELECT * FROM star UNION SELECT * FROM near""", "fx_product")
def _(c):
    return match.candidate_pairs(_pairing(c), overlap=0.6)


# Every pair of titles, counted in full: characters and bigrams with their repeats.
@entry("mt4_similar_pairs", """WITH p AS (SELECT *, lower(concat_ws(' ', title, category_slug, brand)) AS nt FROM fx_product),
  k AS (SELECT product_id, 'e' || ean AS k FROM p WHERE ean IS NOT NULL UNION ALL SELECT product_id, 'm' || mpn || '|' || brand FROM p WHERE mpn IS NOT NULL
    UNION ALL SELECT product_id, 's' || sku || '|' || brand FROM p WHERE sku IS NOT NULL UNION ALL SELECT product_id, 't' || nt FROM p),
  star AS (SELECT a_id, product_id AS b_id FROM (SELECT product_id, min(product_id) OVER (PARTITION BY k) AS a_id FROM k) WHERE a_id < product_id),
  d AS (SELECT nt, lower(brand) AS brand, min(product_id) AS id FROM p GROUP BY 1, 2),
  g AS (SELECT id, q, gram, row_number() OVER (PARTITION BY id, q, gram) AS turn FROM (
    SELECT id, q, unnest(list_transform(range(1, length(nt) - q + 2), lambda i: substring(nt, i, q))) AS gram FROM d, (VALUES (1), (2)) AS v(q))),
  n AS (SELECT a.id AS a_id, b.id AS b_id, count(*) FILTER (WHERE q = 1) AS chars, count(*) FILTER (WHERE q = 2) AS bigrams
    FROM g a JOIN g b USING (q, gram, turn) WHERE a.id < b.id GROUP BY 1, 2),
  near AS (SELECT a_id, b_id FROM (SELECT n.*, length(a.nt) + length(b.nt) AS t, CASE WHEN a.brand = b.brand THEN 70 ELSE 75 END AS r
      FROM n JOIN d a ON a.id = a_id JOIN d b ON b.id = b_id)
    WHERE 200 * chars >= r * t AND bigrams >= 3 * ((r * t + 199) // 200) - t - 1)
  SELECT * FROM star UNION SELECT * FROM near""", "fx_product")
def _(c):
    return similar.similar_pairs(_pairing(c))


@entry("mt3_compare_pairs", None)
def _(c):
    pairs = match.pair_rows(similar.similar_pairs(_pairing(c)), _pairing(c))
    return match.compare_pairs(pairs).select("a_id", "b_id", "confidence", "method", "auto_merge")


@entry("mt5_review_queue", None)
def _(c):
    pairs = match.pair_rows(similar.similar_pairs(_pairing(c)), _pairing(c))
    return match.review_queue(match.compare_pairs(pairs))


@entry("up01_upsert_brands", """SELECT c_mktsegment AS name, 'b-' || left(sha256(c_mktsegment), 24) AS brand_id FROM customer GROUP BY 1
  UNION SELECT p_brand, 'b-' || left(sha256(p_brand), 24) FROM part""")
def _(c):
    known = c.table("customer").select(F.col("c_mktsegment").alias("name")).distinct()
    brands = known.select(upsert.stable_id("b-", "name").alias("brand_id"), "name")
    return upsert.upsert_brands(brands, c.product)


@entry("up02_attach_category", f"WITH {RAW_SQL} SELECT r.seq, c.category_id FROM raw r LEFT JOIN fx_category c ON r.category_slug = c.slug", *RAW, "fx_category")
def _(c):
    return upsert.attach_category(raw(c), c.category).select("seq", "category_id")


_UP3 = f"""WITH {RAW_SQL}, firsts AS (SELECT product_id, arg_max(title || ' v' || store_id, seq) AS title,
  arg_min(brand, seq) FILTER (WHERE brand IS NOT NULL) AS brand, arg_min(ean, seq) FILTER (WHERE ean IS NOT NULL) AS ean,
  arg_min(image_url, seq) FILTER (WHERE image_url IS NOT NULL) AS image_url, max(data_quality) AS data_quality FROM raw GROUP BY 1)
  SELECT p.product_id, coalesce(f.title, p.title) AS title, coalesce(p.brand, f.brand) AS brand,
    coalesce(CASE WHEN p.product_id % 2 = 0 THEN p.ean END, f.ean) AS ean, f.image_url, greatest(0.35, f.data_quality) AS data_quality
  FROM fx_product p LEFT JOIN firsts f ON p.product_id = f.product_id"""


@entry("up03_upsert_products", _UP3, *RAW)
def _(c):
    products = c.product.select("product_id", "title", "brand", F.when(F.col("product_id") % 2 == 0, F.col("ean")).alias("ean"),
                                F.lit(None).cast("string").alias("image_url"), F.lit(0.35).alias("data_quality"))
    batch = raw(c).withColumn("title", _text(F.col("title"), " v", F.col("store_id")))
    return upsert.upsert_products(products, batch)


@entry("up04_product_slugs", f"""WITH {RAW_SQL}, s AS (SELECT *, regexp_replace(normalized_title, '[^a-z0-9]+', '-', 'g') AS slug0,
  row_number() OVER (PARTITION BY normalized_title ORDER BY seq) AS rn FROM raw)
  SELECT seq, CASE WHEN rn = 1 AND slug0 NOT IN (SELECT DISTINCT replace(lower(p_name), ' ', '-') FROM part WHERE p_name LIKE 'red%') THEN slug0
    ELSE slug0 || '-' || store_slug || '-' || right(coalesce(nullif(external_id, ''), 'product'), 24) END AS slug FROM s""", *RAW)
def _(c):
    taken = c.product.filter(F.col("title").startswith("red")).select(F.replace(F.lower("title"), F.lit(" "), F.lit("-")).alias("slug"))
    return upsert.product_slugs(raw(c), taken).select("seq", "slug")


_STORED = f"""old AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id, store_id ORDER BY seen_at DESC, seq1 DESC, seq2 DESC) AS rn
    FROM fx_obs WHERE seen_at < TIMESTAMP '{SPLIT}') WHERE rn = 1),
  allr AS (SELECT product_id, store_id, band_price AS price, stock_status, quantity, seen_at, CAST(-1 AS BIGINT) AS seq, 0 AS phase FROM old
    UNION ALL SELECT product_id, store_id, band_price, stock_status, quantity, seen_at, seq1 * 100 + seq2, 1 FROM fx_obs WHERE seen_at >= TIMESTAMP '{SPLIT}'),
  l AS (SELECT *, lag(price) OVER w AS pp, lag(stock_status) OVER w AS ps, lag(quantity) OVER w AS pq, row_number() OVER w AS pos,
    row_number() OVER (PARTITION BY product_id, store_id ORDER BY phase DESC, seen_at DESC, seq DESC) AS back
    FROM allr WINDOW w AS (PARTITION BY product_id, store_id ORDER BY phase, seen_at, seq))"""


def _split(c):
    seen = F.col("seen_at")
    obs = c.obs.withColumns({"external_id": F.col("product_id").cast("string"), "price": F.col("band_price"),
                             "seq": F.col("seq1") * 100 + F.col("seq2")})
    cut = F.lit(SPLIT).cast("timestamp_ntz")
    from shelfspark.operators.grouping import top_per_group
    old = top_per_group(obs.filter(seen < cut), ["product_id", "store_id"], [F.col(x).desc() for x in ("seen_at", "seq1", "seq2")])
    offers = old.select("store_id", "external_id", "product_id", "price", "stock_status", "quantity",
                        seen.alias("last_seen_at"), seen.alias("last_price_update"), seen.alias("last_stock_update"))
    return offers, obs.filter(seen >= cut)


@entry("up05_upsert_offers", f"""WITH {_STORED} SELECT store_id, product_id, max(price) FILTER (WHERE back = 1) AS price,
  max(stock_status) FILTER (WHERE back = 1) AS stock_status, max(quantity) FILTER (WHERE back = 1) AS quantity,
  max(seen_at) FILTER (WHERE back = 1) AS last_seen_at, max(seen_at) FILTER (WHERE pos = 1 OR pp <> price) AS last_price_update,
  max(seen_at) FILTER (WHERE pos = 1 OR ps <> stock_status OR pq <> quantity) AS last_stock_update FROM l GROUP BY 1, 2""", "fx_obs")
def _(c):
    offers, batch = _split(c)
    return upsert.upsert_offers(offers, batch).drop("external_id")


@entry("up06_append_price_history", f"""WITH {_STORED} SELECT store_id, CAST(product_id AS VARCHAR) AS external_id, price,
  seen_at AS recorded_at, seq FROM l WHERE phase = 1 AND (pos = 1 OR pp <> price)""", "fx_obs")
def _(c):
    offers, batch = _split(c)
    return upsert.append_price_history(offers, batch)


@entry("up07_resolve_locations", """SELECT CAST(location_id AS VARCHAR) AS location_id, store_id, CAST(NULL AS VARCHAR) AS external_id, city, active FROM fx_location
  UNION ALL SELECT 'l-' || left(sha256(store_id || chr(1) || 'e' || location_id), 24), store_id, 'e' || location_id, city, true FROM fx_location
  WHERE location_id % 2 = 0 AND location_id IN (SELECT location_id FROM fx_availability)""", "fx_location", "fx_availability")
def _(c):
    locations = c.location.select(
        F.col("location_id").cast("string").alias("location_id"), "store_id", F.lit(None).cast("string").alias("external_id"),
        F.col("city").alias("name"), F.lit(None).cast("string").alias("address"), "city", "latitude", "longitude",
        F.lit(None).cast("string").alias("opening_hours"), "active")
    branches = c.availability.join(c.location, "location_id").select(
        "store_id", F.col("offer_id").alias("seq"),
        F.when(F.col("location_id") % 2 == 0, _text("e", F.col("location_id"))).alias("external_id"), "city",
        F.col("city").alias("name"), F.lit(None).cast("string").alias("address"), "latitude", "longitude",
        F.lit(None).cast("string").alias("opening_hours"))
    table, _rows = upsert.resolve_locations(locations, branches)
    return table.select("location_id", "store_id", "external_id", "city", "active")


@entry("up08_upsert_availability", """WITH b AS (SELECT *, row_number() OVER (PARTITION BY offer_id, location_id ORDER BY seen_at, seq) AS pos,
   row_number() OVER (PARTITION BY offer_id, location_id ORDER BY seen_at DESC, seq DESC) AS back, lag(stock_status) OVER w AS ps, lag(quantity) OVER w AS pq FROM (
    SELECT o.product_id * 100000 + o.store_id AS offer_id, l.location_id, o.stock_status, o.quantity % 4 AS quantity, o.seen_at, o.seq1 * 100 + o.seq2 AS seq
    FROM fx_obs o JOIN fx_location l ON o.store_id = l.store_id) WINDOW w AS (PARTITION BY offer_id, location_id ORDER BY seen_at, seq))
  SELECT offer_id, location_id, max(stock_status) FILTER (WHERE back = 1) AS stock_status, max(quantity) FILTER (WHERE back = 1) AS quantity,
    max(seen_at) FILTER (WHERE back = 1) AS last_seen_at, max(seen_at) FILTER (WHERE pos = 1 OR ps <> stock_status OR pq <> quantity) AS last_stock_update
  FROM b GROUP BY 1, 2""", "fx_obs", "fx_location")
def _(c):
    batch = c.obs.join(c.location.select("store_id", "location_id"), "store_id").select(
        (F.col("product_id") * 100000 + F.col("store_id")).alias("offer_id"), "location_id", "stock_status",
        (F.col("quantity") % 4).alias("quantity"), "seen_at", (F.col("seq1") * 100 + F.col("seq2")).alias("seq"))
    empty = batch.select("offer_id", "location_id", "stock_status", "quantity", F.col("seen_at").alias("last_seen_at"),
                         F.col("seen_at").alias("last_stock_update")).filter(F.lit(False))
    return upsert.upsert_availability(empty, batch)


@entry("up09_default_external_id", f"""WITH {RAW_SQL} SELECT seq, coalesce(nullif(external_id, ''), store_slug || ':https-' || store_slug || '-example-p-' || product_id) AS external_id FROM raw""", *RAW)
def _(c):
    return raw(c).select("seq", upsert.default_external_id().alias("external_id"))


@entry("up10_merge_payload", f"""WITH {RAW_SQL}, e AS (SELECT seq, price, brand, ean, image_url, stock_status, quantity, data_quality FROM raw),
  n AS (SELECT r.seq, p.brand, p.ean, 'https://img.example/new/' || r.product_id AS image_url, r.store_id % 4 = 0 OR r.store_id % 3 = 0 AS fills,
    0.55 AS data_quality, r.store_id FROM raw r JOIN fx_product p ON r.product_id = p.product_id)
  SELECT e.seq, e.price, coalesce(e.brand, n.brand) AS brand, coalesce(e.ean, n.ean) AS ean, coalesce(e.image_url, n.image_url) AS image_url,
    greatest(e.data_quality, 0.55) AS data_quality, e.brand IS NULL OR e.image_url IS NULL OR (e.ean IS NULL AND n.ean IS NOT NULL) OR e.data_quality < 0.55 AS changed
  FROM e JOIN n ON e.seq = n.seq""", *RAW)
def _(c):
    base = raw(c)
    existing = base.select("seq", "price", "brand", "ean", "image_url", "stock_status", "quantity", "data_quality",
                           F.lit("food").alias("category_slug"), F.lit(0.9).alias("category_confidence"))
    candidates = base.drop("brand", "ean").join(c.product.select("product_id", "brand", "ean"), "product_id").select(
        "seq", (F.col("price") + 1).alias("price"), "brand", "ean", _text("https://img.example/new/", F.col("product_id")).alias("image_url"),
        F.lit("UNKNOWN").alias("stock_status"), F.lit(None).cast("int").alias("quantity"), F.lit(0.55).alias("data_quality"),
        F.lit(None).cast("string").alias("category_slug"), F.lit(None).cast("double").alias("category_confidence"))
    return upsert.merge_payload(existing, candidates, ["seq"]).select("seq", "price", "brand", "ean", "image_url", "data_quality", "changed")


@entry("up11_seed_locations", """SELECT coalesce(l.location_id, 'l-' || left(sha256(s.store_id || chr(1) || s.ext), 24)) AS location_id, coalesce(s.store_id, l.store_id) AS store_id,
   coalesce(s.ext, l.ext) AS external_id, coalesce(s.name, l.name) AS name, coalesce(l.latitude, CAST(NULL AS DOUBLE)) AS latitude FROM
  (SELECT CAST(location_id AS VARCHAR) AS location_id, store_id, 'e' || location_id AS ext, city AS name, latitude FROM fx_location) l
  FULL JOIN (SELECT store_id, 'e' || (store_id * 10 + store_id % 5) AS ext, 'Seed ' || store_id AS name FROM fx_store) s ON l.store_id = s.store_id AND l.ext = s.ext""", "fx_location", "fx_store")
def _(c):
    locations = c.location.select(F.col("location_id").cast("string").alias("location_id"), "store_id", _text("e", F.col("location_id")).alias("external_id"),
                                  F.col("city").alias("name"), "latitude", "active")
    seeds = c.store.select(F.col("slug").alias("store_slug"), _text("e", F.col("store_id") * 10 + F.col("store_id") % 5).alias("external_id"),
                           _text("Seed ", F.col("store_id")).alias("name"), F.lit(None).cast("double").alias("latitude"))
    return upsert.seed_locations(locations, seeds, c.store).drop("active")


@entry("up12_seed_categories", """SELECT category_id, slug, upper(slug) || '!' AS name_ru, parent_id FROM fx_category""", "fx_category")
def _(c):
    parents = c.category.select(F.col("category_id").alias("parent_id"), F.col("slug").alias("parent_slug"))
    seeds = c.category.join(parents, "parent_id", "left").select("slug", _text(F.upper("slug"), "!").alias("name_ru"), "parent_slug")
    return upsert.seed_categories(c.category, seeds)


@entry("up13_sync_verification", f"""WITH {_REGISTRY_SQL} SELECT s.store_id, coalesce((SELECT bool_or(status = 'VERIFIED') FROM reg WHERE reg.slug = s.slug), false) AS verified FROM fx_store s""", "fx_store")
def _(c):
    return upsert.sync_verification(c.store, registry(c)).select("store_id", "verified")


@entry("up14_apply_geocodes", """SELECT location_id, CASE WHEN NOT active OR location_id % 3 = 0 THEN NULL WHEN city = 'NATION_0' THEN 'lookup'
   WHEN location_id % 4 = 0 THEN 'miss' ELSE 'hit' END AS geocode, CASE WHEN location_id % 3 = 0 THEN latitude
   WHEN active AND city <> 'NATION_0' AND location_id % 4 <> 0 THEN 47.0 END AS latitude FROM fx_location""", "fx_location")
def _(c):
    k = F.col("location_id")
    locations = c.location.withColumns({"address": _text(" Str. ", k, " "), "latitude": F.when(k % 3 == 0, F.col("latitude"))})
    cache = c.location.filter(F.col("city") != "NATION_0").select(
        F.lower(_text("str. ", k, "|", F.col("city"), "|moldova")).alias("key"), F.when(k % 4 == 0, 10.0).otherwise(47.0).alias("latitude"), F.lit(28.0).alias("longitude"))
    return upsert.apply_geocodes(locations, cache).select("location_id", "geocode", "latitude")


@entry("up15_finish_runs", """SELECT store_id, max(started_at) AS last_crawl, max(started_at) FILTER (WHERE status = 'SUCCESS' AND rn = 1) AS last_success,
  max(CASE WHEN rn = 1 AND status <> 'SUCCESS' THEN status END) AS last_error FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY started_at DESC) AS rn FROM fx_run)
  GROUP BY 1""", "fx_run")
def _(c):
    sources = c.run.select("store_id").distinct().select(
        "store_id", F.lit(True).alias("enabled"), *[F.lit(None).cast(t).alias(n) for n, t in
        (("last_crawl", "timestamp_ntz"), ("last_success", "timestamp_ntz"), ("last_error", "string"))])
    results = c.run.select("store_id", "status", F.col("started_at").alias("finished_at"), F.lit(None).cast("string").alias("error_message"))
    return upsert.stamp_sources(sources, results).drop("enabled")


@entry("rec1_reconcile_missing", """WITH m AS (SELECT o.*, o.store_id % 10 <> 0 AND o.last_seen_at < TIMESTAMP '2001-01-01' + o.store_id * INTERVAL 1 DAY AND stock_status <> 'OUT_OF_STOCK' AS marked FROM fx_offer o)
  SELECT offer_id, marked, CASE WHEN marked THEN 'OUT_OF_STOCK' ELSE stock_status END AS stock_status, CASE WHEN NOT marked THEN quantity END AS quantity,
    CASE WHEN marked THEN TIMESTAMP '2001-01-01' + store_id * INTERVAL 1 DAY ELSE last_seen_at END AS last_stock_update FROM m""", "fx_offer")
def _(c):
    runs = c.store.select("store_id", F.expr("TIMESTAMP_NTZ '2001-01-01 00:00:00' + store_id * INTERVAL 1 DAY").alias("started_at"),
                          F.when(F.col("store_id") % 10 == 0, 1).otherwise(0).alias("failed"))
    offers = c.offer.withColumn("last_stock_update", F.col("last_seen_at"))
    return upsert.reconcile_stores(offers, runs).select("offer_id", "marked", "stock_status", "quantity", "last_stock_update")


@entry("snk2_upsert", """SELECT c_custkey AS id, CASE WHEN n.total IS NOT NULL THEN n.total ELSE round(c_acctbal, 2) END AS total FROM customer
  LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS total FROM orders GROUP BY 1) n ON c_custkey = o_custkey""")
def _(c):
    target = c.table("customer").select(F.col("c_custkey").alias("id"), F.round("c_acctbal", 2).alias("total"))
    updates = c.table("orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_totalprice").alias("total"))
    return upsert.upsert(target, updates, ["id"])
