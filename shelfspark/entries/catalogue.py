"""Registered catalogue queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.plans import catalogue as q
from shelfspark.plans.views import Catalogue, with_views

AS_OF, MAX_AGE = "2001-07-01", 336
CUT = "TIMESTAMP '2001-06-17 00:00:00'"
NEAR = (46.5, 28.5, 150.0)
CITY = " Nation_3 "
BOX = q.bounding_box(*NEAR)
SCHEDULED = ("mon", "tue", "wed", "thu", "fri", "sat")

_OK = "('IN_STOCK','LOW_STOCK','PREORDER')"
_FRESH = f"""fresh AS (SELECT o.* FROM fx_offer o JOIN fx_store s ON o.store_id = s.store_id
  WHERE o.last_seen_at >= {CUT} AND s.active AND s.verified)"""
_DIST = """2 * 6371.0088 * atan2(sqrt(hv), sqrt(1 - hv))"""
_NEARBY = f"""near0 AS (SELECT l.*, power(sin(radians(latitude - {NEAR[0]}) / 2), 2)
    + cos(radians({NEAR[0]})) * cos(radians(latitude)) * power(sin(radians(longitude - {NEAR[1]}) / 2), 2) AS hv
  FROM fx_location l JOIN fx_store s ON l.store_id = s.store_id WHERE l.active AND s.active AND s.verified),
near AS (SELECT *, {_DIST} AS distance_km FROM near0 WHERE {_DIST} <= {NEAR[2]})"""
_SCOPE = f"""scope AS (SELECT a.*, n.distance_km FROM fx_availability a JOIN near n ON a.location_id = n.location_id
  WHERE a.last_seen_at >= {CUT} AND a.stock_status IN {_OK})"""

QUERIES, SQL = {}, {}


def entry(name, sql, *views):
    def register(fn):
        QUERIES[name] = lambda spark, folder: fn(Catalogue(spark, folder))
        if sql is not None:
            SQL[name] = with_views(sql, *views)
        return fn
    return register


@entry("q01_available_cities", """SELECT DISTINCT city FROM fx_location l JOIN fx_store s ON l.store_id = s.store_id
  WHERE l.active AND s.active AND s.verified""", "fx_location", "fx_store")
def _(c):
    return q.available_cities(c.location, c.store)


@entry("q02_available_stores", "SELECT slug, name FROM fx_store WHERE active AND verified", "fx_store")
def _(c):
    return q.available_stores(c.store)


@entry("q03_fresh_offers", f"WITH {_FRESH} SELECT offer_id, product_id, store_id, price, stock_status FROM fresh",
       "fx_offer", "fx_store")
def _(c):
    return q.fresh_offers(c.offer, c.store, AS_OF, MAX_AGE).select(
        "offer_id", "product_id", "store_id", "price", "stock_status")


@entry("q04_home_counts", f"""WITH {_FRESH} SELECT (SELECT count(*) FROM fx_store WHERE active AND verified) AS stores,
  (SELECT count(DISTINCT product_id) FROM fresh) AS products, (SELECT count(*) FROM fresh) AS offers""",
       "fx_offer", "fx_store")
def _(c):
    return q.home_counts(c.product, c.offer, c.store, AS_OF, MAX_AGE)


@entry("q04_root_categories", "SELECT category_id, slug, name_ru FROM fx_category WHERE parent_id IS NULL", "fx_category")
def _(c):
    return q.root_categories(c.category).select("category_id", "slug", "name_ru")


@entry("q05_latest_products", f"""WITH {_FRESH}, upd AS (SELECT product_id, max(seen_at) AS updated_at FROM fx_obs GROUP BY 1),
  newest AS (SELECT p.product_id, p.title, u.updated_at FROM fx_product p JOIN upd u ON p.product_id = u.product_id
    WHERE p.product_id IN (SELECT product_id FROM fresh) ORDER BY u.updated_at DESC, p.product_id LIMIT 12),
  r AS (SELECT n.product_id, n.title, n.updated_at, row_number() OVER (PARTITION BY n.product_id ORDER BY f.price, f.offer_id) AS offer_rank,
    f.offer_id, f.price, f.stock_status FROM newest n JOIN fresh f ON n.product_id = f.product_id)
  SELECT * FROM r WHERE offer_rank <= 3""", "fx_offer", "fx_store", "fx_product")
def _(c):
    updated = c.obs.groupBy("product_id").agg(F.max("seen_at").alias("updated_at"))
    return q.latest_products(c.product.join(updated, "product_id"), c.offer, c.store, AS_OF, MAX_AGE)


@entry("q06_nearby_locations", f"WITH {_NEARBY} SELECT location_id, store_id, round(distance_km, 6) AS distance_km FROM near",
       "fx_location", "fx_store")
def _(c):
    return q.nearby_locations(c.location, c.store, *NEAR).select(
        "location_id", "store_id", F.round("distance_km", 6).alias("distance_km"))


@entry("q07_text_filter", "SELECT product_id, title FROM fx_product WHERE contains(lower(title), 'red') OR contains(lower(brand), 'red')",
       "fx_product")
def _(c):
    return c.product.filter(q.text_filter(" Red", "title", "brand")).select("product_id", "title")


@entry("q08_offer_filter", f"WITH {_FRESH} SELECT offer_id, price FROM fresh WHERE stock_status IN {_OK}", "fx_offer", "fx_store")
def _(c):
    fresh = q.fresh_offers(c.offer, c.store, AS_OF, MAX_AGE)
    return q.offer_filter(fresh, c.availability, c.location, AS_OF, MAX_AGE).select("offer_id", "price")


@entry("q08_offer_filter_city", f"""WITH {_FRESH} SELECT offer_id, price FROM fresh WHERE offer_id IN (
  SELECT a.offer_id FROM fx_availability a JOIN fx_location l ON a.location_id = l.location_id
  WHERE a.last_seen_at >= {CUT} AND a.stock_status IN {_OK} AND l.active AND lower(l.city) = 'nation_3')""",
       "fx_offer", "fx_store", "fx_availability")
def _(c):
    fresh = q.fresh_offers(c.offer, c.store, AS_OF, MAX_AGE)
    return q.offer_filter(fresh, c.availability, c.location, AS_OF, MAX_AGE, city=CITY).select("offer_id", "price")


@entry("q09_nearest_branch", f"""WITH {_NEARBY}, {_SCOPE} SELECT offer_id, location_id AS nearest_location_id,
  round(distance_km, 6) AS distance_km FROM (SELECT *, row_number() OVER (PARTITION BY offer_id ORDER BY round(distance_km, 9), location_id) AS rn FROM scope)
  WHERE rn = 1""", "fx_availability", "fx_store")
def _(c):
    scope = q.branches_in_scope(c.availability, c.location, AS_OF, MAX_AGE, near=NEAR, stores=c.store)
    return q.nearest_branch(scope).withColumn("distance_km", F.round("distance_km", 6))


@entry("q10_order_offers", f"WITH {_FRESH} SELECT product_id, offer_id, price FROM fresh", "fx_offer", "fx_store")
def _(c):
    fresh = q.fresh_offers(c.offer, c.store, AS_OF, MAX_AGE)
    return fresh.orderBy("product_id", *q.offer_order("price-desc")).select("product_id", "offer_id", "price")


def _search(order, where, extra=""):
    return f"""WITH {_FRESH}, wanted AS (SELECT * FROM fresh WHERE {where}),
  m AS (SELECT p.product_id, p.title, (SELECT min(price) FROM wanted w WHERE w.product_id = p.product_id) AS best_price FROM fx_product p
    WHERE p.product_id IN (SELECT product_id FROM wanted) {extra}),
  r AS (SELECT *, row_number() OVER (ORDER BY {order}, product_id) AS product_rank, count(*) OVER () AS total FROM m)
  SELECT r.product_rank, r.product_id, r.title, r.total, CAST(greatest(1, ceil(r.total / 48.0)) AS BIGINT) AS total_pages,
    w.offer_id, w.store_id, w.price, w.stock_status FROM r JOIN wanted w ON r.product_id = w.product_id"""


_SEARCHED = ("product_rank", "product_id", "title", "total", "total_pages", "offer_id", "store_id", "price", "stock_status")


@entry("q11_search_catalog", _search("title", f"stock_status IN {_OK}",
       "AND (contains(lower(p.title), 'ring') OR contains(lower(p.brand), 'ring'))") + " WHERE r.product_rank > 48 AND r.product_rank <= 96",
       "fx_offer", "fx_store", "fx_product")
def _(c):
    return q.search_catalog(c.product, c.offer, c.store, c.availability, c.location, AS_OF, MAX_AGE,
                            q="ring", page=2).select(*_SEARCHED)


@entry("q11_search_catalog_near", f"""WITH {_FRESH}, {_NEARBY}, {_SCOPE},
  nb AS (SELECT offer_id, location_id AS nearest_location_id, distance_km FROM (SELECT *, row_number() OVER (PARTITION BY offer_id
     ORDER BY round(distance_km, 9), location_id) AS rn FROM scope) WHERE rn = 1),
  wanted AS (SELECT f.*, nb.nearest_location_id, nb.distance_km FROM fresh f JOIN nb ON f.offer_id = nb.offer_id),
  m AS (SELECT product_id, title FROM fx_product WHERE product_id IN (SELECT product_id FROM wanted)),
  r AS (SELECT *, row_number() OVER (ORDER BY title DESC, product_id) AS product_rank, count(*) OVER () AS total FROM m)
  SELECT r.product_rank, r.product_id, r.total, w.offer_id, w.price, w.nearest_location_id, round(w.distance_km, 6) AS distance_km
  FROM r JOIN wanted w ON r.product_id = w.product_id WHERE r.product_rank <= 48""", "fx_offer", "fx_store", "fx_availability", "fx_product")
def _(c):
    found = q.search_catalog(c.product, c.offer, c.store, c.availability, c.location, AS_OF, MAX_AGE,
                             sort="price-desc", near=NEAR)
    return found.select("product_rank", "product_id", "total", "offer_id", "price", "nearest_location_id",
                        F.round("distance_km", 6).alias("distance_km"))


@entry("q11_search_branches", f"""WITH {_FRESH}, w AS (SELECT * FROM fresh WHERE stock_status IN {_OK}),
  r AS (SELECT *, row_number() OVER (ORDER BY title, product_id) AS rk FROM fx_product WHERE product_id IN (SELECT product_id FROM w))
  SELECT w.product_id, a.offer_id, a.location_id, a.stock_status, l.city FROM r JOIN w ON r.product_id = w.product_id
  JOIN fx_availability a ON a.offer_id = w.offer_id JOIN fx_location l ON a.location_id = l.location_id
  WHERE rk <= 48 AND l.active AND a.last_seen_at >= {CUT} AND a.stock_status IN {_OK}""",
       "fx_offer", "fx_store", "fx_product", "fx_availability")
def _(c):
    found = q.search_catalog(c.product, c.offer, c.store, c.availability, c.location, AS_OF, MAX_AGE)
    return q.search_branches(found, c.availability, c.location, AS_OF, MAX_AGE).select(
        "product_id", "offer_id", "location_id", "stock_status", "city")


@entry("q12_search_best_price", _search("best_price DESC", f"stock_status IN {_OK}") + " WHERE r.product_rank <= 48",
       "fx_offer", "fx_store", "fx_product")
def _(c):
    return q.search_catalog(c.product, c.offer, c.store, c.availability, c.location, AS_OF, MAX_AGE,
                            sort="price-desc", order_products="best_price").select(*_SEARCHED)


@entry("q13_category_page", _search("title", f"stock_status IN {_OK}", "AND p.category_slug = 'ECONOMY'").replace(
    "w.offer_id, w.store_id", "w.offer_id") + " WHERE r.product_rank <= 48", "fx_offer", "fx_store", "fx_product")
def _(c):
    return q.category_page(c.product, c.offer, c.store, "ECONOMY", AS_OF, MAX_AGE)


@entry("q13_child_categories", """SELECT p.slug AS parent_slug, c.category_id, c.slug, c.name_ru FROM fx_category c
  JOIN fx_category p ON c.parent_id = p.category_id""", "fx_category")
def _(c):
    return q.child_categories(c.category)


@entry("q14_best_offer", f"""WITH {_FRESH} SELECT product_id, offer_id, store_id, price, stock_status FROM (
  SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY price, offer_id) AS rn FROM fresh) WHERE rn = 1""",
       "fx_offer", "fx_store")
def _(c):
    return q.best_offer(q.fresh_offers(c.offer, c.store, AS_OF, MAX_AGE)).select(
        "product_id", "offer_id", "store_id", "price", "stock_status")


_DETAIL = """rows0 AS (SELECT f.*, coalesce(n.branches, 0) AS branches, n.first_location_id, n.distance_km FROM fresh f
    LEFT JOIN nb n ON f.offer_id = n.offer_id)"""


@entry("q15_product_detail", f"""WITH {_FRESH}, scope AS (SELECT a.* FROM fx_availability a JOIN fx_location l ON a.location_id = l.location_id
  WHERE l.active AND a.last_seen_at >= {CUT} AND a.stock_status IN {_OK}),
  nb AS (SELECT offer_id, count(*) AS branches, min(location_id) AS first_location_id, CAST(NULL AS DOUBLE) AS distance_km FROM scope GROUP BY 1), {_DETAIL}
  SELECT product_id, offer_id, store_id, price, stock_status, branches, first_location_id FROM rows0
  WHERE branches > 0 OR stock_status IN {_OK}""", "fx_offer", "fx_store", "fx_availability")
def _(c):
    return q.product_detail(c.product, c.offer, c.store, c.availability, c.location, AS_OF, MAX_AGE).drop("distance_km")


@entry("q15_product_detail_near", f"""WITH {_FRESH}, {_NEARBY.replace(" JOIN fx_store s ON l.store_id = s.store_id WHERE l.active AND s.active AND s.verified", " WHERE l.active")},
  {_SCOPE}, nb AS (SELECT offer_id, count(*) AS branches, arg_min(location_id, round(distance_km, 9) * 1e7 + location_id / 1e7) AS first_location_id,
    min(distance_km) AS distance_km FROM scope GROUP BY 1), {_DETAIL}
  SELECT product_id, offer_id, store_id, price, stock_status, branches, first_location_id, round(distance_km, 6) AS distance_km
  FROM rows0 WHERE branches > 0""", "fx_offer", "fx_store", "fx_availability")
def _(c):
    rows = q.product_detail(c.product, c.offer, c.store, c.availability, c.location, AS_OF, MAX_AGE, near=NEAR)
    return rows.withColumn("distance_km", F.round("distance_km", 6))


@entry("q16_offer_summary", f"""WITH b AS (SELECT offer_id, bool_or(stock_status IN {_OK}) AS ok FROM fx_availability GROUP BY 1)
  SELECT o.product_id, count(*) AS offers, count(*) FILTER (WHERE o.stock_status IN ('IN_STOCK','LOW_STOCK')) AS in_stock,
  count(*) FILTER (WHERE coalesce(b.ok, o.stock_status IN {_OK})) AS confirmed
  FROM fx_offer o LEFT JOIN b ON o.offer_id = b.offer_id GROUP BY 1""", "fx_availability")
def _(c):
    return q.offer_summary(c.offer, c.availability)


@entry("q17_branch_summary", f"""SELECT offer_id, count(*) FILTER (WHERE stock_status IN {_OK}) AS available, count(*) AS total
  FROM fx_availability GROUP BY 1""", "fx_availability")
def _(c):
    return q.branch_summary(c.availability)


@entry("q18_display_branch", f"""WITH scope AS (SELECT a.* FROM fx_availability a JOIN fx_location l ON a.location_id = l.location_id
  WHERE l.active AND a.last_seen_at >= {CUT} AND a.stock_status IN {_OK}),
  f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY offer_id ORDER BY location_id) AS rn FROM scope) WHERE rn = 1)
  SELECT o.offer_id, f.location_id AS shown_location_id, coalesce(f.stock_status, o.stock_status) AS shown_status,
  coalesce(f.quantity, o.quantity) AS shown_quantity FROM fx_offer o LEFT JOIN f ON o.offer_id = f.offer_id""", "fx_availability")
def _(c):
    return q.display_branch(c.offer, q.branches_in_scope(c.availability, c.location, AS_OF, MAX_AGE))


@entry("q19_discounts", """SELECT seq1, seq2, price, old_price FROM (SELECT *, lag(price) OVER (PARTITION BY product_id, store_id
  ORDER BY seen_at, seq1, seq2) AS old_price FROM fx_obs) WHERE old_price > price""", "fx_obs")
def _(c):
    from shelfspark.operators.grouping import lag_by_key
    rows = lag_by_key(c.obs, ["product_id", "store_id"], "seen_at", ["seq1", "seq2"], ["price"])
    return q.discounts(rows.withColumnRenamed("prev_price", "old_price")).select("seq1", "seq2", "price", "old_price")


@entry("q20_product_specs", """SELECT product_id, CAST(pos AS BIGINT) AS pos, name, value FROM (
  SELECT p_partkey AS product_id, 0 AS pos, 'brand' AS name, p_brand AS value FROM part
  UNION ALL SELECT p_partkey, 1, 'size', CAST(p_size AS VARCHAR) FROM part
  UNION ALL SELECT p_partkey, 2, 'type', p_type FROM part)""")
def _(c):
    part = c.table("part").select(
        F.col("p_partkey").alias("product_id"),
        F.parse_json(F.to_json(F.struct(F.col("p_size").alias("size"), F.col("p_type").alias("type"),
                                        F.col("p_brand").alias("brand")))).alias("attributes"))
    return q.product_specs(part)


@entry("q22_image_of", """WITH o AS (SELECT *, 'https://img.example/' || offer_id AS image_url FROM fx_offer),
  b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY price, offer_id) AS rn FROM o) WHERE rn = 1)
  SELECT p.product_id, CASE WHEN p.sku IS NOT NULL THEN 'https://img.example/p/' || p.sku ELSE b.image_url END AS image_url
  FROM fx_product p LEFT JOIN b ON p.product_id = b.product_id""", "fx_product", "fx_offer")
def _(c):
    products = c.product.withColumn("image_url", F.when(F.col("sku").isNotNull(), F.concat(F.lit("https://img.example/p/"), "sku")).otherwise(""))
    offers = c.offer.withColumn("image_url", F.concat(F.lit("https://img.example/"), F.col("offer_id").cast("string")))
    return q.image_of(products, offers)


def _hours(location):
    """A weekly schedule derived from the location id; every fifth one is overnight, some are incomplete."""
    key = F.col("location_id")
    day = F.when(key % 5 == 0, F.array(F.struct(F.lit("20:00").alias("open"), F.lit("02:00").alias("close")))).otherwise(
        F.array(F.struct(F.concat(F.lpad((6 + key % 5).cast("string"), 2, "0"), F.lit(":30")).alias("open"), F.lit("18:00").alias("close"))))
    pairs = [x for d in SCHEDULED for x in (F.lit(d), day)]
    closed = F.map_concat(F.create_map(*pairs), F.create_map(F.lit("sun"), F.slice(day, 1, 0)))
    weekly = F.when(key % 7 == 0, F.create_map(F.lit("mon"), day)).otherwise(closed)
    return location.withColumn("opening_hours", F.struct(
        F.lit(1).alias("version"), F.when(key % 11 == 0, "online_only").alias("kind"),
        F.lit("UTC").alias("timezone"), weekly.alias("weekly"), (key % 13 == 0).alias("temporarilyClosed")))


@entry("q23_open_now", """SELECT a.offer_id, a.location_id,
  CASE WHEN a.location_id % 11 = 0 THEN 'online_only' WHEN a.location_id % 13 = 0 THEN 'temporarily_closed'
       WHEN a.location_id % 7 = 0 THEN 'unknown' WHEN a.location_id % 5 = 0 THEN 'open'
       WHEN a.location_id % 5 IN (1, 2) THEN 'closed' ELSE 'closed' END AS open_state,
  CASE WHEN a.location_id % 11 = 0 OR a.location_id % 13 = 0 OR a.location_id % 7 = 0 THEN NULL
       WHEN a.location_id % 5 = 0 THEN '20:00–02:00'
       ELSE lpad(CAST(6 + a.location_id % 5 AS VARCHAR), 2, '0') || ':30–18:00' END AS today FROM fx_availability a""", "fx_availability")
def _(c):
    at = F.lit("2001-07-03 01:15:00").cast("timestamp_ntz")
    return q.open_now(c.availability.select("offer_id", "location_id"), _hours(c.location), at)


@entry("q24_shared_products", """SELECT p.ean, p.product_id, o.product_id * 100000 + o.store_id AS offer_id, o.store_id,
  o.seen_at AS recorded_at, o.price FROM fx_product p JOIN fx_obs o ON p.product_id = o.product_id WHERE p.ean IS NOT NULL""",
       "fx_product", "fx_obs")
def _(c):
    history = c.obs.select((F.col("product_id") * 100000 + F.col("store_id")).alias("offer_id"),
                           F.col("seen_at").alias("recorded_at"), "price")
    return q.shared_products(c.product, c.offer, history)
