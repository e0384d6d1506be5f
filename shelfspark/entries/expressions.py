"""Registered scalar-expression queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark import rules
from shelfspark.entries.importing import _text
from shelfspark.functions import clock, commerce, geo, seal, text
from shelfspark.plans.views import Catalogue, with_views

QUERIES, SQL = {}, {}


def entry(name, sql, *views):
    def register(fn):
        QUERIES[name] = lambda spark, folder: fn(Catalogue(spark, folder))
        if sql is not None:
            SQL[name] = with_views(sql, *views)
        return fn
    return register


@entry("fn01_normalize_text", None)
def _(c):
    return c.table("documents").select("doc_id", text.normalize_text("text").alias("normalized"))


@entry("fn02_category_text", """SELECT p_partkey, trim(regexp_replace(lower(translate(p_name || '  ' || p_type, 'șşțţ', 'sstt')), '\\s+', ' ', 'g')) AS category_text FROM part""")
def _(c):
    return c.table("part").select("p_partkey", text.category_text(F.concat("p_name", F.lit(" \t "), "p_type")).alias("category_text"))


@entry("fn03_slugify", None)
def _(c):
    return c.table("documents").select("doc_id", text.slugify("text").alias("slug"))


@entry("fn04_url_key", """SELECT page_id, right(trim(regexp_replace(url, '[^a-zA-Z0-9]+', '-', 'g'), '-'), 160) AS url_key FROM pages""")
def _(c):
    return c.table("pages").select("page_id", text.url_key("url").alias("url_key"))


@entry("fn05_clean_url", """SELECT page_id, regexp_replace(url, '#.*$', '') AS cleaned,
   lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) = 'blog.tionsh.example.net' AS same, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/x/y' AS resolved,
   regexp_replace(url, '#.*$', '') || '#product-' || page_id AS item FROM pages""")
def _(c):
    return c.table("pages").select(
        "page_id", text.clean_url("url").alias("cleaned"), text.same_origin("url", F.lit("http://Blog.tionsh.example.net/")).alias("same"),
        text.resolve_url("url", F.lit("/z/../x/./y")).alias("resolved"),
        text.item_url("url", F.lit(""), F.col("page_id").cast("string"), text.clean_url("url")).alias("item"))


_IGNORED = ", ".join(f"'{x}'" for x in rules.IGNORED_PATH_PARTS)


@entry("fn06_category_path_from_url", f"""WITH p AS (SELECT page_id, list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS parts FROM pages),
  q AS (SELECT page_id, list_filter(list_transform(parts[:-2], lambda x: trim(lower(regexp_replace(x, '[_-]+', ' ', 'g')))), lambda x: x <> '' AND NOT regexp_matches(x, '^[0-9]+$') AND x NOT IN ({_IGNORED})) AS kept FROM p)
  SELECT page_id, array_to_string(kept[-3:], '|') AS path FROM q""")
def _(c):
    return c.table("pages").select("page_id", F.array_join(text.category_path_from_url("url"), "|").alias("path"))


@entry("fn07_pick", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE regexp_extract(props, '\"k\": *([0-9]+)', 1) END AS picked FROM events")
def _(c):
    from shelfspark.sources.feeds import fields_of, pick_text
    body = F.when(F.col("event_id") % 3 == 0, '{"k": null, "n": ""}').otherwise(F.col("props"))
    return c.table("events").select("event_id", pick_text(fields_of(F.parse_json(body)), "n", "k").alias("picked"))


@entry("fn08_parse_money", """SELECT p_partkey, CAST(p_retailprice AS DECIMAL(14,2)) AS json_price, CAST(p_retailprice AS DECIMAL(14,2)) AS jsonld_price,
   CAST(p_retailprice AS DECIMAL(14,2)) AS html_price, CAST(p_size AS DECIMAL(14,2)) AS doubled FROM part""")
def _(c):
    price = F.col("p_retailprice").cast("decimal(14,2)").cast("string")
    comma = F.replace(price, F.lit("."), F.lit(","))
    size = F.lpad(F.col("p_size").cast("string"), 2, "0")
    return c.table("part").select(
        "p_partkey", commerce.parse_money(F.concat(F.lit(" "), comma), "json").alias("json_price"),
        commerce.parse_money(F.concat(F.lit("MDL "), comma), "jsonld").alias("jsonld_price"),
        commerce.parse_money(_text("Pret: ", comma, " MDL ", comma, " MDL"), "html").alias("html_price"),
        commerce.parse_money(F.concat(size, F.lit(" "), size), "html").alias("doubled"))


@entry("fn09_parse_int", "SELECT p_partkey, p_size AS whole, CAST(NULL AS INT) AS broken FROM part")
def _(c):
    return c.table("part").select("p_partkey", commerce.parse_int(_text(" ", F.col("p_size"), " ")).alias("whole"),
                                  commerce.parse_int(_text(F.col("p_size"), ".5")).alias("broken"))


@entry("fn10_currency", "SELECT doc_id, CASE WHEN contains(text, '€') OR contains(text, 'EUR') THEN 'EUR' ELSE 'MDL' END AS currency, 'USD' AS given FROM documents")
def _(c):
    return c.table("documents").select("doc_id", commerce.currency(F.lit(""), "text").alias("currency"), commerce.currency(F.lit("usd"), "text").alias("given"))


def _stock_sql(style, value):
    cases = " ".join(f"WHEN {' OR '.join(f'contains({value}, {chr(39)}{t}{chr(39)})' for t in tokens)} THEN '{status}'" for status, tokens in rules.STOCK_TOKENS[style])
    return f"CASE {cases} ELSE 'UNKNOWN' END"


@entry("fn11_stock_from_text", f"""SELECT doc_id, {_stock_sql('html', 't')} AS html_status, {_stock_sql('json', 't')} AS json_status, {_stock_sql('jsonld', 't')} AS jsonld_status
  FROM (SELECT doc_id, lower(text) AS t FROM documents)""")
def _(c):
    return c.table("documents").select("doc_id", *[commerce.stock_from_text("text", s).alias(f"{s}_status") for s in ("html", "json", "jsonld")])


@entry("fn12_stock_from_quantity", """SELECT seq1, seq2, CASE WHEN quantity - 5 <= 0 THEN 'OUT_OF_STOCK' WHEN quantity - 5 <= 10 THEN 'LOW_STOCK' ELSE 'IN_STOCK' END AS status FROM fx_obs""", "fx_obs")
def _(c):
    return c.obs.select("seq1", "seq2", commerce.stock_from_quantity(F.col("quantity") - 5).alias("status"))


@entry("fn13_coerce_stock", "SELECT run_id, 'UNKNOWN' AS coerced FROM fx_run", "fx_run")
def _(c):
    return c.run.select("run_id", commerce.coerce_stock("status").alias("coerced"))


@entry("fn14_quantity_from_text", "SELECT p_partkey, p_size AS quantity FROM part")
def _(c):
    return c.table("part").select("p_partkey", commerce.quantity_from_text(_text(F.col("p_name"), " disponibilitate: ", F.col("p_size"), " buc")).alias("quantity"))


@entry("fn15_sku_from_text", "SELECT p_partkey, 'P-' || p_partkey AS sku FROM part")
def _(c):
    return c.table("part").select("p_partkey", commerce.sku_from_text(_text(F.col("p_name"), " Codul produsului: P-", F.col("p_partkey"), " x")).alias("sku"))


@entry("fn16_is_service", "SELECT doc_id, regexp_matches(lower(text), '\\b(consultation|consulting|service\\s+booking)\\b') AS is_service FROM documents")
def _(c):
    return c.table("documents").select("doc_id", text.is_service("text").alias("is_service"))


@entry("fn17_quality_score", """SELECT product_id, round(0.15 + 0.15 + 0.10 + CASE WHEN product_id % 2 = 0 THEN 0.10 ELSE 0 END
  + CASE WHEN ean IS NOT NULL OR mpn IS NOT NULL OR sku IS NOT NULL THEN 0.15 ELSE 0 END + 0.10 + CASE WHEN product_id % 5 = 0 THEN 0.05 ELSE 0 END, 2) AS score FROM fx_product""", "fx_product")
def _(c):
    p = F.col("product_id")
    branch = "array<struct<quantity:int>>"
    rows = c.product.select(
        "product_id", "title", "price", F.lit("https://s.example/").alias("url"), F.when(p % 2 == 0, F.col("brand")).alias("brand"), "ean", "mpn", "sku",
        F.array("category_slug").alias("category_path"), F.lit("").alias("image_url"), F.lit("UNKNOWN").alias("stock_status"),
        F.when(p % 5 == 0, 3).alias("quantity"), F.lit(None).cast("string").alias("location_external_id"), F.lit(None).cast(branch).alias("availabilities"))
    return rows.select("product_id", commerce.observation_score().cast("double").alias("score"))


@entry("fn18_map_category", """SELECT p_partkey, CASE WHEN contains(p_name, 'ring') THEN 'b' WHEN contains(p_name, 'bolt') THEN 'c' END AS slug,
  CASE WHEN contains(p_name, 'ring') OR contains(p_name, 'bolt') THEN 0.89 ELSE 0.0 END AS confidence FROM part""")
def _(c):
    table = (("a", ("nothing", "never")), ("b", ("ring", "zzz")), ("c", ("bolt", "ring")))
    mapped = commerce.map_category(F.array("p_name"), F.lit("x"), True, table)
    return c.table("part").withColumn("m", mapped).select("p_partkey", "m.slug", "m.confidence")


def _votes_sql():
    """Title vote of the shipped rules: hits per rule, most hits first, earlier rule on a tie."""
    quoted = lambda w: "'" + w.replace("'", "''") + "'"
    arms = " UNION ALL ".join(
        f"SELECT doc_id, {' + '.join(f'CAST(contains(t, {quoted(w)}) AS INT)' for w in words)} AS hits, {i} AS pos, '{slug}' AS slug FROM d"
        for i, (slug, words) in enumerate(rules.CATEGORY_RULES))
    return f"""WITH d AS (SELECT doc_id, trim(regexp_replace(lower(translate(text, 'șşțţ', 'sstt')), '\\s+', ' ', 'g')) AS t FROM documents), h AS ({arms}),
      b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, pos) AS rn FROM h)
      SELECT doc_id, CASE WHEN hits > 0 THEN slug END AS slug, CASE WHEN hits > 0 THEN least(0.90, round(0.62 + 0.07 * hits, 2)) ELSE 0.0 END AS confidence FROM b WHERE rn = 1"""


@entry("fn18_map_category_default", _votes_sql())
def _(c):
    mapped = commerce.map_category(F.array().cast("array<string>"), "text", False)
    return c.table("documents").withColumn("m", mapped).select("doc_id", "m.slug", "m.confidence")


@entry("fn19_city_alias", "SELECT location_id, CASE WHEN location_id % 2 = 0 THEN 'Chișinău' ELSE city END AS city, 'str. ' || location_id AS address FROM fx_location", "fx_location")
def _(c):
    k = F.col("location_id")
    return c.location.select("location_id", text.city_alias(F.when(k % 2 == 0, "CHISINAU").otherwise(F.col("city"))).alias("city"),
                             text.clean_address(_text(" , str.  ", k, " - Harta 12")).alias("address"))


@entry("fn20_store_from_url", """SELECT page_id, coalesce(nullif(regexp_replace(split_part(regexp_replace(lower(host), '^www\\.', ''), '.', 1), '[^a-z0-9-]+', '-', 'g'), ''), 'external-store') AS slug,
   regexp_extract(url, '^([a-z]+)://', 1) || '://' || host AS domain FROM (SELECT *, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages)""")
def _(c):
    return c.table("pages").withColumn("s", text.store_from_url("url")).select("page_id", "s.slug", "s.domain")


@entry("fn21_haversine", """SELECT location_id, round(2 * 6371.0088 * atan2(sqrt(h), sqrt(1 - h)), 6) AS km FROM (SELECT location_id,
  power(sin(radians(latitude - 47.0) / 2), 2) + cos(radians(47.0)) * cos(radians(latitude)) * power(sin(radians(longitude - 28.8) / 2), 2) AS h FROM fx_location)""", "fx_location")
def _(c):
    return c.location.select("location_id", F.round(geo.haversine_km(47.0, 28.8, "latitude", "longitude"), 6).alias("km"))


@entry("fn22_parameters", """SELECT o_orderkey, CASE WHEN o_totalprice > 0 THEN least(o_totalprice / 1000, 300) ELSE 10 END AS radius, CAST(1 AS BIGINT) AS page,
  CAST(least(floor(o_totalprice / 1000), 100) AS BIGINT) AS size, o_totalprice / 1000 <= 90 AS valid FROM orders""")
def _(c):
    t = (F.col("o_totalprice") / 1000).cast("string")
    return c.table("orders").select("o_orderkey", geo.radius_km(t).alias("radius"), geo.page_number(F.lit("abc")).alias("page"),
                                    geo.page_size(t).alias("size"), geo.valid_coordinates(geo.parse_coordinate(t), F.lit(1.0)).alias("valid"))


@entry("fn23_freshness", """SELECT offer_id, CASE WHEN last_seen_at >= TIMESTAMP '2001-06-17' THEN 'FRESH' ELSE 'STALE' END AS state,
  last_seen_at < TIMESTAMP '2001-06-30 12:00:00' AS missing FROM fx_offer""", "fx_offer")
def _(c):
    return c.offer.select("offer_id", clock.freshness_state("last_seen_at", "2001-07-01", "10000").alias("state"),
                          (F.col("last_seen_at") < clock.reconcile_cutoff("2001-07-01", 12)).alias("missing"))


@entry("fn24_valid_store_hours", """SELECT location_id, location_id % 3 <> 0 AND location_id % 4 <> 0 AS valid FROM fx_location""", "fx_location")
def _(c):
    k = F.col("location_id")
    period = F.struct(F.when(k % 3 == 0, "25:00").otherwise("09:00").alias("open"), F.lit("24:00").alias("close"))
    hours = F.struct(F.when(k % 4 == 0, 2).otherwise(1).alias("version"), F.lit(None).cast("string").alias("kind"), F.create_map(F.lit("mon"), F.array(period)).alias("weekly"))
    return c.location.select("location_id", clock.valid_store_hours(hours).alias("valid"))


@entry("fn25_open_state", """SELECT run_id, CASE WHEN h BETWEEN 9 AND 17 THEN 'open' ELSE 'closed' END AS state, '09:00–18:00' AS today FROM (SELECT run_id, hour(started_at) AS h FROM fx_run)""", "fx_run")
def _(c):
    period = F.array(F.struct(F.lit("09:00").alias("open"), F.lit("18:00").alias("close")))
    hours = F.struct(F.lit(1).alias("version"), F.lit("schedule").alias("kind"), F.lit("UTC").alias("timezone"),
                     F.create_map(*[x for d in rules.WEEKDAYS for x in (F.lit(d), period)]).alias("weekly"), F.lit(False).alias("temporarilyClosed"))
    return c.run.withColumn("s", clock.open_state(hours, "started_at")).select("run_id", "s.state", "s.today")


@entry("fn26_stock_label", """SELECT offer_id, location_id, stock_status IN ('IN_STOCK','LOW_STOCK','PREORDER') AS ok, CASE WHEN stock_status = 'OUT_OF_STOCK' OR quantity = 0 THEN 'Nu este în stoc'
  WHEN stock_status = 'PREORDER' THEN 'Precomandă' WHEN quantity > 0 AND quantity <= 10 THEN 'În stoc · ' || quantity || ' buc.'
  WHEN stock_status IN ('IN_STOCK', 'LOW_STOCK') OR quantity > 10 THEN 'În stoc' ELSE 'Disponibilitatea se verifică' END AS label FROM fx_availability""", "fx_availability")
def _(c):
    return c.availability.select("offer_id", "location_id", commerce.is_available("stock_status").alias("ok"), commerce.stock_label("stock_status", "quantity", "ro").alias("label"))


@entry("fn27_age_label", """SELECT run_id, CASE WHEN m < 60 THEN m || 'm' WHEN floor(m / 60.0 + 0.5) < 48 THEN CAST(floor(m / 60.0 + 0.5) AS BIGINT) || 'h' ELSE CAST(floor(floor(m / 60.0 + 0.5) / 24 + 0.5) AS BIGINT) || 'd' END AS age
  FROM (SELECT run_id, CAST(greatest(floor(epoch(TIMESTAMP '2024-01-03' - started_at) / 60 + 0.5), 0) AS BIGINT) AS m FROM fx_run)""", "fx_run")
def _(c):
    return c.run.select("run_id", clock.age_label("started_at", "2024-01-03").alias("age"))


@entry("fn28_mask_last4", "SELECT c_custkey, right(c_name, 4) AS last4 FROM customer")
def _(c):
    return c.table("customer").select("c_custkey", text.mask_last4(_text(" ", F.col("c_name"), "\t")).alias("last4"))


@entry("fn29_localized_name", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_type END AS ro, p_name AS ru FROM part")
def _(c):
    ro = F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_type"))
    return c.table("part").select("p_partkey", text.localized_name(ro, "p_name", "ro").alias("ro"), text.localized_name(ro, "p_name", "ru").alias("ru"))


@entry("fn30_seal_roundtrip", "SELECT c_custkey, c_name AS opened, true AS shaped, CAST(NULL AS VARCHAR) AS wrong FROM customer")
def _(c):
    cards = c.table("customer").select("c_custkey", seal.seal("c_name", "k1", "first").alias("sealed"))
    again = seal.reseal(cards, "sealed", {"k1": "first", "k2": "second"}, "k2")
    return again.select("c_custkey", seal.unseal("sealed", {"k2": "second"}).alias("opened"),
                        F.col("sealed").rlike(r"^v2\.k2\.[\w-]{16}\.[\w-]{22}\.[\w-]+$").alias("shaped"), seal.unseal("sealed", {"k2": "other"}).alias("wrong"))


def _cards(c):
    """Orders stand for cards of their customers."""
    k = F.col("o_orderkey")
    return c.table("orders").select(
        F.col("o_custkey").cast("string").alias("owner_id"), k.cast("string").alias("card_id"), _text("lp", k % 7).alias("program_id"),
        F.when(F.col("o_orderstatus") == "F", "ARCHIVED").otherwise("ACTIVE").alias("status"), (k % 2 == 0).alias("favorite"), F.col("o_orderdate").alias("updated_at"))


@entry("q21_wallet", """SELECT CAST(o_custkey AS VARCHAR) AS owner_id, CAST(o_orderkey AS VARCHAR) AS card_id, o_orderkey % 2 = 0 AS favorite, s_name || ' loyalty' AS program, s_name AS store
  FROM orders LEFT JOIN supplier ON s_suppkey = o_orderkey % 7 WHERE o_orderstatus <> 'F'""")
def _(c):
    from shelfspark.plans import catalogue
    programs = c.store.select(_text("lp", F.col("store_id")).alias("program_id"), _text(F.col("name"), " loyalty").alias("name"), "store_id")
    return catalogue.wallet(_cards(c), programs, c.store).select("owner_id", "card_id", "favorite", "program", "store")


@entry("up16_upsert_loyalty_programs", "SELECT store_id, name || ' loyalty' AS name, 'default' AS external_program_id FROM fx_store WHERE active", "fx_store")
def _(c):
    from shelfspark.operators import upsert
    stores = c.store.withColumn("domain", _text("https://", F.col("slug")))
    empty = stores.select(*[F.lit("").alias(n) if n != "store_id" else F.col("store_id") for n in
                            ("program_id", "store_id", "external_program_id", "name", "issuer", "website_url")], F.lit(True).alias("active")).filter(F.lit(False))
    return upsert.upsert_loyalty_programs(empty, stores).select("store_id", "name", "external_program_id")


@entry("up17_add_cards", """SELECT CAST(o_orderkey AS VARCHAR) AS card_id, right(CAST(o_orderkey + 100000 AS VARCHAR), 4) AS payload_last4, CAST(o_orderkey + 100000 AS VARCHAR) AS opened FROM orders WHERE o_orderkey % 5 <> 0""")
def _(c):
    from shelfspark.operators import upsert
    k = F.col("o_orderkey")
    requests = c.table("orders").select(
        k.cast("string").alias("card_id"), F.col("o_custkey").cast("string").alias("owner_id"), F.lit(" Card ").alias("label"), F.lit("").alias("cardholder_name"),
        _text(" ", k + 100000, " ").alias("payload"), F.when(k % 5 == 0, "NOT_A_CODE").otherwise("EAN_13").alias("barcode_format"), F.lit(None).cast("string").alias("notes"), F.lit("#fff").alias("color"))
    cards = requests.select("card_id", "owner_id", "label", F.lit("").alias("encrypted_payload"), F.lit("").alias("payload_last4"), F.lit("").alias("status")).filter(F.lit(False))
    added = upsert.add_cards(cards, requests, "k1", "secret")
    return added.select("card_id", "payload_last4", seal.unseal("encrypted_payload", {"k1": "secret"}).alias("opened"))


@entry("up18_delete_cards", "SELECT CAST(o_custkey AS VARCHAR) AS owner_id, CAST(o_orderkey AS VARCHAR) AS card_id FROM orders WHERE NOT (o_orderkey % 3 = 0 AND o_orderkey % 2 = 0)")
def _(c):
    from shelfspark.operators import upsert
    k = F.col("o_orderkey")
    asked = c.table("orders").select(F.when(k % 2 == 0, F.col("o_custkey")).otherwise(-1).cast("string").alias("owner_id"),
                                     F.when(k % 3 == 0, k).otherwise(-1).cast("string").alias("card_id"))
    return upsert.delete_cards(_cards(c), asked).select("owner_id", "card_id")
