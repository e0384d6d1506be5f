"""Registered quality, gate and health queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.entries.importing import RAW, RAW_SQL, _REGISTRY_SQL, _text, raw, registry
from shelfspark.operators import quality as q
from shelfspark.plans.views import Catalogue, with_views

QUERIES, SQL = {}, {}
AS_OF = "2001-07-01"
RUN_AS_OF = "2024-02-01"


def entry(name, sql, *views):
    def register(fn):
        QUERIES[name] = lambda spark, folder: fn(Catalogue(spark, folder))
        if sql is not None:
            SQL[name] = with_views(sql, *views)
        return fn
    return register


def _messy(c):
    p = F.col("product_id")
    return raw(c).withColumns({
        "price": F.when(p % 10 != 0, F.col("price")), "image_url": F.when(p % 4 != 0, _text("https://img.example/", p % 50)),
        "category_slug": F.when(F.col("store_id") % 3 != 0, F.col("category_slug")).otherwise(""),
        "stock_status": F.when(p % 6 == 0, "UNKNOWN").otherwise(F.col("stock_status")),
        "network_json_responses": (p % 3).cast("int"), "network_json_product_match": p % 9 == 0})


_P = lambda part, base: f"CASE WHEN {base} > 0 THEN round({part} / CAST({base} AS DOUBLE) * 100, 2) ELSE 0.0 END"
_METRICS = f"""messy AS (SELECT store_slug, product_id, CASE WHEN product_id % 10 <> 0 THEN price END AS price,
    CASE WHEN product_id % 4 <> 0 THEN 'https://img.example/' || (product_id % 50) END AS image_url, store_id % 3 <> 0 AS cat,
    product_id % 6 <> 0 AS stocked, ean IS NOT NULL OR mpn IS NOT NULL OR sku IS NOT NULL AS ident FROM raw),
  im AS (SELECT store_slug, max(n) AS top FROM (SELECT store_slug, image_url, count(*) AS n FROM messy WHERE image_url IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
  agg AS (SELECT store_slug, count(*) AS n, count(price) AS pr, count(*) FILTER (WHERE stocked) AS st, count(image_url) AS im, count(DISTINCT image_url) AS di,
    count(*) FILTER (WHERE cat) AS ca, count(*) FILTER (WHERE ident) AS idn, count(*) FILTER (WHERE product_id % 3 > 0) AS ob,
    count(*) FILTER (WHERE product_id % 9 = 0) AS ma, CAST(sum(product_id % 3) AS BIGINT) AS re FROM messy GROUP BY 1),
  metrics AS (SELECT a.store_slug, n AS unique_products, {_P('n', '500')} AS target_fill_pct, {_P('pr', 'n')} AS price_complete_pct, {_P('st', 'n')} AS known_stock_pct,
    {_P('im', 'n')} AS image_complete_pct, {_P('di', 'im')} AS distinct_image_pct, {_P('coalesce(top, 0)', 'im')} AS max_image_reuse_pct,
    {_P('ca', 'n')} AS category_complete_pct, {_P('idn', 'n')} AS identity_complete_pct, {_P('ob', 'n')} AS network_json_observed_product_pct,
    {_P('ma', 'n')} AS network_json_matched_product_pct, re AS network_json_response_count FROM agg a LEFT JOIN im ON a.store_slug = im.store_slug)"""


@entry("ag01_quality_metrics", f"WITH {RAW_SQL}, {_METRICS} SELECT * FROM metrics", *RAW)
def _(c):
    return q.quality_metrics(_messy(c), 500).drop("branch_availability_product_pct", "branch_availability_rows")


_B = lambda m: f"CASE WHEN {m} < 100 THEN '{m}=' || CAST({m} AS VARCHAR) || '%<100.0%' END"


@entry("ag02_publish_readiness", f"""WITH {RAW_SQL}, {_METRICS}, b AS (SELECT *, concat_ws(';', CASE WHEN unique_products < 520 THEN 'catalog_coverage_unverified' END,
    {_B('price_complete_pct')}, {_B('category_complete_pct')}, {_B('identity_complete_pct')}, {_B('known_stock_pct')}) AS blockers FROM metrics)
  SELECT store_slug, blockers = '' AS ready, blockers, CASE WHEN image_complete_pct < 95 THEN 'image_complete_pct=' || CAST(image_complete_pct AS VARCHAR) || '%' ELSE '' END AS warnings FROM b""", *RAW)
def _(c):
    rows = q.publish_readiness(q.quality_metrics(_messy(c), 500), F.col("unique_products") >= 520)
    return rows.select("store_slug", "ready", F.array_join("blockers", ";").alias("blockers"), F.array_join("warnings", ";").alias("warnings"))


@entry("ag03_enrichment_reasons", f"""WITH {RAW_SQL}, {_METRICS} SELECT store_slug, concat_ws(';', CASE WHEN known_stock_pct < 20 THEN 'known_stock=' || CAST(known_stock_pct AS VARCHAR) || '%' END,
  CASE WHEN identity_complete_pct < 50 THEN 'identity=' || CAST(identity_complete_pct AS VARCHAR) || '%' END,
  CASE WHEN category_complete_pct < 70 THEN 'category=' || CAST(category_complete_pct AS VARCHAR) || '%' END) AS reasons FROM metrics""", *RAW)
def _(c):
    return q.enrichment_reasons(q.quality_metrics(_messy(c), 500)).select("store_slug", F.array_join("reasons", ";").alias("reasons"))


def _attempts(c):
    kind = F.col("event_type")
    return c.table("events").select(
        (F.col("user_id") % 100).alias("store_id"), _text("c", F.col("user_id") % 3).alias("connector"), ((F.col("user_id") % 3) * 10).alias("priority"),
        F.when(kind == "purchase", "accepted").when(kind == "click", "duplicate").when(kind == "error", "error").when(kind == "signup", "enriched").otherwise("none").alias("result"))


_STATS = """stats AS (SELECT user_id % 100 AS store_id, 'c' || (user_id % 3) AS connector, (user_id % 3) * 10 AS priority, count(*) AS urls_checked,
  count(*) FILTER (WHERE event_type = 'purchase') AS accepted, count(*) FILTER (WHERE event_type = 'click') AS duplicates,
  count(*) FILTER (WHERE event_type = 'error') AS errors, CAST(0 AS BIGINT) AS services_skipped, count(*) FILTER (WHERE event_type = 'signup') AS enriched
  FROM events GROUP BY 1, 2, 3)"""


@entry("ag04_strategy_stats", f"WITH {_STATS} SELECT * FROM stats")
def _(c):
    return q.strategy_stats(_attempts(c))


def _crawl(c):
    k = F.regexp_extract("store_slug", r"(\d+)", 1).cast("long")
    metrics = q.quality_metrics(_messy(c), 500).withColumns({
        "crawl_limit": F.when(k % 2 == 0, 0).otherwise(500), "estimate": F.when(k % 7 != 0, 450 + k),
        "estimate_kind": F.when(k % 5 == 0, "lower-bound").otherwise("exact"), "estimate_method": F.lit("count"),
        "errors": (k % 4 == 3).cast("int"), "robots_allowed": k % 11 != 0, "origin_blocked": k % 13 == 0})
    return metrics.withColumn("coverage_verified", q.coverage_verified())


_CRAWL = """crawl AS (SELECT *, CASE WHEN k % 2 = 0 THEN 0 ELSE 500 END AS crawl_limit, CASE WHEN k % 7 <> 0 THEN 450 + k END AS estimate,
  CASE WHEN k % 5 = 0 THEN 'lower-bound' ELSE 'exact' END AS estimate_kind, CAST(k % 4 = 3 AS INT) AS errors
  FROM (SELECT *, CAST(replace(store_slug, 'store-', '') AS BIGINT) AS k FROM metrics))"""


@entry("ag05_crawl_outcome", f"""WITH {RAW_SQL}, {_METRICS}, {_CRAWL} SELECT store_slug,
  coalesce(estimate_kind = 'exact' AND unique_products >= estimate AND (crawl_limit = 0 OR crawl_limit >= estimate) AND errors = 0, false) AS coverage_verified,
  CASE WHEN k % 11 = 0 THEN 'BLOCKED_BY_ROBOTS' ELSE 'PARTIAL' END AS outcome, crawl_limit > 0 AND unique_products >= crawl_limit AS cap_reached FROM crawl""", *RAW)
def _(c):
    rows = q.publish_readiness(_crawl(c), F.col("coverage_verified"))
    return q.crawl_outcome(rows).select("store_slug", "coverage_verified", "outcome", "cap_reached")


_AUDIT = """audit AS (SELECT s.slug AS store_slug, c.unique_products, estimate, crawl_limit, errors, estimate_kind,
    c.store_slug IS NULL AS missing, coalesce(crawl_limit > 0 AND crawl_limit < estimate AND unique_products >= crawl_limit, false) AS capped FROM fx_store s
    LEFT JOIN (SELECT * FROM crawl WHERE k % 17 <> 0) c ON s.slug = c.store_slug),
  audit2 AS (SELECT *, NOT missing AND coalesce(estimate_kind = 'exact' AND unique_products >= estimate AND NOT capped AND errors = 0, false) AS ready FROM audit)"""


@entry("ag06_coverage_audit", f"""WITH {RAW_SQL}, {_METRICS}, {_CRAWL}, {_AUDIT} SELECT store_slug, CASE WHEN missing THEN 'FAILED' WHEN ready THEN 'VERIFIED' ELSE 'PARTIAL' END AS status,
  unique_products AS collected, round(unique_products / CAST(estimate AS DOUBLE) * 100, 4) AS observed_catalog_ratio_pct, ready AS verification_ready,
  CASE WHEN missing THEN 'crawl report missing' WHEN ready THEN NULL WHEN capped THEN 'smoke run capped below catalog reference'
   WHEN estimate_kind <> 'exact' THEN 'catalog reference is not exact' WHEN unique_products < estimate THEN 'crawl did not reach catalog reference'
   ELSE 'catalog reference unavailable' END AS verification_blocker FROM audit2""", *RAW, "fx_store")
def _(c):
    return _audit(c).select("store_slug", "status", "collected", "observed_catalog_ratio_pct", "verification_ready", "verification_blocker")


def _audit(c):
    crawl = _crawl(c)
    reports = crawl.filter(F.regexp_extract("store_slug", r"(\d+)", 1).cast("long") % 17 != 0)
    return q.coverage_audit(c.store.select(F.col("slug").alias("store_slug")), reports, crawl)


@entry("ag07_coverage_report", f"""WITH {RAW_SQL}, {_METRICS}, {_CRAWL}, {_AUDIT}, {_STATS},
  ps AS (SELECT 'store-' || store_id AS store_slug, arg_max(connector, accepted * 1000 - priority) AS primary_source, CAST(sum(errors) AS BIGINT) AS errors FROM stats GROUP BY 1),
  fb AS (SELECT p.store_slug, string_agg(s.connector, ', ' ORDER BY s.connector) AS fallbacks FROM ps p JOIN stats s ON p.store_slug = 'store-' || s.store_id AND s.connector <> p.primary_source GROUP BY 1)
  SELECT a.store_slug, a.unique_products AS collected, m.price_complete_pct, m.known_stock_pct AS stock_complete_pct, ps.primary_source,
    CASE WHEN ps.store_slug IS NOT NULL THEN coalesce(fb.fallbacks, '') END AS fallbacks, ps.errors
  FROM audit2 a LEFT JOIN metrics m ON a.store_slug = m.store_slug LEFT JOIN ps ON a.store_slug = ps.store_slug LEFT JOIN fb ON a.store_slug = fb.store_slug""", *RAW, "fx_store")
def _(c):
    stats = q.strategy_stats(_attempts(c)).withColumn("store_slug", _text("store-", F.col("store_id")))
    report = q.coverage_report(q.quality_metrics(_messy(c), 500), _audit(c), stats)
    return report.select("store_slug", "collected", "price_complete_pct", "stock_complete_pct", "primary_source", "fallbacks", "errors")


@entry("ag08_offer_counts", """SELECT store_id, count(*) FILTER (WHERE last_seen_at >= TIMESTAMP '2001-06-17') AS fresh_offers, count(*) AS total_offers FROM fx_offer GROUP BY 1""", "fx_offer")
def _(c):
    return q.offer_counts(c.offer, AS_OF, 336)


_LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY started_at DESC, run_id DESC) AS rn FROM fx_run) WHERE rn = 1)"


@entry("ag09_latest_run", f"WITH {_LATEST} SELECT store_id, run_id, status, started_at FROM latest", "fx_run")
def _(c):
    return q.latest_run(c.run).select("store_id", "run_id", "status", "started_at")


_HEALTH = f"""{_LATEST}, cnt AS (SELECT store_id, count(*) FILTER (WHERE last_seen_at >= TIMESTAMP '2024-01-18') AS fresh, count(*) AS total FROM fx_offer GROUP BY 1),
  h AS (SELECT s.store_id, s.slug, s.verified, CASE WHEN l.run_id IS NULL THEN 'NEVER' WHEN l.status IN ('FAILED','PARTIAL') THEN l.status
    WHEN l.status = 'RUNNING' OR epoch(TIMESTAMP '2024-02-01' - l.started_at) / 60 > greatest((300 + s.store_id) * 2, 720) THEN 'STALE_RUN'
    WHEN c.fresh IS DISTINCT FROM c.total OR c.total IS NULL THEN 'STALE_CATALOG' ELSE 'OK' END AS health, coalesce(l.status, '-') AS last_status,
    coalesce(c.fresh, 0) AS fresh_offers, coalesce(c.total, 0) AS total_offers
    FROM fx_store s LEFT JOIN latest l ON s.store_id = l.store_id LEFT JOIN cnt c ON s.store_id = c.store_id WHERE s.active)"""


def _health(c):
    runs = c.run.withColumn("finished_at", F.when(F.col("status") != "RUNNING", F.col("started_at")))
    sources = c.store.select("store_id", F.lit(True).alias("enabled"), (F.lit(300) + F.col("store_id")).alias("crawl_frequency"))
    return q.store_health(c.store, sources, runs, c.offer, RUN_AS_OF, 336)


@entry("ag10_store_health", f"WITH {_HEALTH} SELECT store_id, health, last_status, fresh_offers, total_offers FROM h", "fx_run", "fx_offer", "fx_store")
def _(c):
    return _health(c).select("store_id", "health", "last_status", "fresh_offers", "total_offers")


@entry("ag10_unhealthy_verified", f"WITH {_HEALTH} SELECT slug, health FROM h WHERE verified AND health <> 'OK'", "fx_run", "fx_offer", "fx_store")
def _(c):
    return q.unhealthy_verified(_health(c))


@entry("ag11_run_status", """SELECT run_id, CASE WHEN status = 'PARTIAL' OR run_id % 5 = 0 THEN 'PARTIAL' WHEN status = 'FAILED' THEN 'FAILED'
   WHEN products_found > 20 THEN 'SUCCESS' WHEN products_found > 0 THEN 'PARTIAL' ELSE 'FAILED' END AS close_status,
   CASE WHEN status = 'PARTIAL' OR run_id % 5 = 0 THEN 'b' || (run_id % 3) WHEN status = 'FAILED' THEN 'Crawler exit code 1' WHEN products_found > 20 THEN NULL
   WHEN products_found > 0 THEN '1 row(s) failed to import' ELSE 'Importer exit code 2' END AS error_message FROM fx_run""", "fx_run")
def _(c):
    n = F.col("products_found")
    results = c.run.select(
        "run_id", F.when(F.col("status") == "PARTIAL", 2).when(F.col("status") == "FAILED", 1).otherwise(0).alias("exit_code"),
        F.lit("OK").alias("outcome"), (F.col("run_id") % 5 != 0).alias("ready"), F.array(_text("b", F.col("run_id") % 3)).alias("blockers"),
        F.lit(True).alias("raw_written"), F.when(n > 20, 0).otherwise(2).alias("importer_code"), n.alias("imported"),
        F.when(n > 20, 0).otherwise(1).alias("failed"), F.when(n > 20, n).otherwise(n + 1).alias("total"))
    return q.run_status(results).select("run_id", F.col("status").alias("close_status"), "error_message")


@entry("ag12_eligible_stores", f"WITH {_REGISTRY_SQL} SELECT idx, slug FROM reg WHERE status IN ('VERIFIED', 'PARTIAL')")
def _(c):
    return q.eligible_stores(registry(c), ("verified", "partial")).select("idx", "slug")


@entry("ag13_status_summary", f"WITH {_REGISTRY_SQL} SELECT status, count(*) AS stores FROM reg GROUP BY 1")
def _(c):
    return q.status_summary(registry(c))


@entry("ag14_batch_summary", """SELECT CASE status WHEN 'SUCCESS' THEN 'success' WHEN 'PARTIAL' THEN 'partial' ELSE 'failure' END AS result,
  'store-' || store_id || CASE WHEN status IN ('SUCCESS', 'PARTIAL') THEN '' ELSE ':1' END AS entry FROM fx_run""", "fx_run")
def _(c):
    return q.batch_summary(c.run.select(_text("store-", F.col("store_id")).alias("slug"),
                           F.when(F.col("status") == "SUCCESS", 0).when(F.col("status") == "PARTIAL", 2).otherwise(1).alias("exit_code")))


@entry("ag15_loyalty_event_counts", "SELECT l_orderkey AS card_id, count(*) AS events FROM lineitem GROUP BY 1")
def _(c):
    return q.loyalty_event_counts(c.table("lineitem").select(F.col("l_orderkey").alias("card_id")))
