"""Completeness metrics, publication gate, crawl outcome and store health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark import rules
from shelfspark.functions.clock import age_label, fresh_since, literal_ntz
from shelfspark.functions.commerce import filled

DEFAULT_CRAWL_MINUTES = 360
LEAST_OVERDUE_MINUTES = 12 * 60


def pct(part: Column, total: Column) -> Column:
    """Two decimals; an empty base counts as zero."""
    return F.when(total > 0, F.round(part / total * 100, 2)).otherwise(F.lit(0.0))


def quality_metrics(obs: DataFrame, limit: int = 0, by: str = "store_slug") -> DataFrame:
    """Completeness of each store's collected products.

    Image reuse is counted per (store, image) first, so a picture shared by a
    third of all rows is one partial count per task.
    """
    has_image = filled("image_url")
    responses = F.coalesce("network_json_responses", F.lit(0)) if "network_json_responses" in obs.columns else F.lit(0)
    matched = F.coalesce("network_json_product_match", F.lit(False)) if "network_json_product_match" in obs.columns else F.lit(False)
    branches = F.greatest(F.coalesce(F.size("availabilities"), F.lit(0)), F.lit(0)) if "availabilities" in obs.columns else F.lit(0)
    # One pass: partial sums per (store, image), rolled up per store.
    per_image = obs.groupBy(by, F.when(has_image, F.col("image_url")).alias("_image")).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("price").isNotNull()).alias("priced"),
        F.count_if(F.coalesce(F.col("stock_status") != "UNKNOWN", F.lit(False))).alias("stocked"),
        F.count_if(filled("category_slug")).alias("categorised"),
        F.count_if(filled("ean") | filled("mpn") | filled("sku")).alias("identified"),
        F.count_if(branches > 0).alias("branched"), F.sum(branches).alias("branch_rows"),
        F.count_if(responses > 0).alias("observed"), F.count_if(matched).alias("matched"),
        F.sum(F.when(responses > 0, responses).otherwise(0)).alias("responses"))
    pictured = F.when(F.col("_image").isNotNull(), F.col("n"))
    sums = per_image.groupBy(by).agg(
        F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in ("priced", "stocked", "categorised", "identified", "branched", "branch_rows", "observed", "matched", "responses")],
        F.coalesce(F.sum(pictured), F.lit(0)).alias("images"), F.count("_image").alias("distinct_images"),
        F.coalesce(F.max(pictured), F.lit(0)).alias("most_used"))
    n = F.col("n")
    return sums.select(
        by, n.alias("unique_products"),
        (pct(n, F.lit(limit)) if limit > 0 else F.lit(None).cast("double")).alias("target_fill_pct"),
        pct(F.col("priced"), n).alias("price_complete_pct"), pct(F.col("stocked"), n).alias("known_stock_pct"),
        pct(F.col("images"), n).alias("image_complete_pct"),
        pct(F.col("distinct_images"), F.col("images")).alias("distinct_image_pct"),
        pct(F.col("most_used"), F.col("images")).alias("max_image_reuse_pct"),
        pct(F.col("categorised"), n).alias("category_complete_pct"), pct(F.col("identified"), n).alias("identity_complete_pct"),
        pct(F.col("branched"), n).alias("branch_availability_product_pct"),
        F.col("branch_rows").cast("long").alias("branch_availability_rows"),
        pct(F.col("observed"), n).alias("network_json_observed_product_pct"),
        pct(F.col("matched"), n).alias("network_json_matched_product_pct"),
        F.col("responses").cast("long").alias("network_json_response_count"))


def _listed(*items: Column) -> Column:
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def _number(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0)).cast("double")


def publish_readiness(metrics: DataFrame, coverage_verified: Column | bool, require_stock: bool = True) -> DataFrame:
    """ready, blockers and warnings; identity, category and price must be complete."""
    verified = coverage_verified if isinstance(coverage_verified, Column) else F.lit(coverage_verified)
    required = ["price_complete_pct", "category_complete_pct", "identity_complete_pct"] + ["known_stock_pct"] * require_stock
    say = lambda name, text, tail: F.concat(F.lit(text), _number(F.col(name)).cast("string"), F.lit(tail))
    image, reuse = _number(F.col("image_complete_pct")), _number(F.col("max_image_reuse_pct"))
    return metrics.withColumns({
        "blockers": _listed(
            F.when(F.coalesce("unique_products", F.lit(0)) <= 0, "no_products"),
            F.when(~F.coalesce(verified, F.lit(False)), "catalog_coverage_unverified"),
            *[F.when(_number(F.col(m)) < 100.0, say(m, f"{m}=", "%<100.0%")) for m in required]),
        "warnings": _listed(
            F.when(image < 95.0, say("image_complete_pct", "image_complete_pct=", "%")),
            F.when((image >= 50.0) & (reuse >= 80.0), say("max_image_reuse_pct", "suspicious_image_reuse=", "%"))),
    }).withColumn("ready", F.size("blockers") == 0)


def enrichment_reasons(metrics: DataFrame) -> DataFrame:
    say = lambda name, label: F.concat(F.lit(label + "="), _number(F.col(name)).cast("string"), F.lit("%"))
    image, reuse = _number(F.col("image_complete_pct")), _number(F.col("max_image_reuse_pct"))
    reasons = _listed(
        F.when(_number(F.col("known_stock_pct")) < 20.0, say("known_stock_pct", "known_stock")),
        F.when(_number(F.col("identity_complete_pct")) < 50.0, say("identity_complete_pct", "identity")),
        F.when(_number(F.col("category_complete_pct")) < 70.0, say("category_complete_pct", "category")),
        F.when((image >= 50.0) & (reuse >= 80.0), say("max_image_reuse_pct", "image_reuse")))
    empty = F.array().cast("array<string>")
    return metrics.withColumn("reasons", F.when(F.col("unique_products") > 0, reasons).otherwise(empty))


def strategy_stats(attempts: DataFrame) -> DataFrame:
    """Attempt log (store_id, connector, priority, result) -> counters.

    Results: accepted, duplicate, error, service, none, enriched.
    """
    count = lambda *names: F.count_if(F.col("result").isin(*names))
    return attempts.groupBy("store_id", "connector", "priority").agg(
        F.count("*").alias("urls_checked"), count("accepted").alias("accepted"), count("duplicate").alias("duplicates"),
        count("error").alias("errors"), count("service").alias("services_skipped"), count("enriched").alias("enriched"))


def crawl_outcome(metrics: DataFrame) -> DataFrame:
    """Needs unique_products, errors, crawl_limit, estimate, estimate_kind, robots_allowed, origin_blocked and ``ready``."""
    n = F.coalesce("unique_products", F.lit(0))
    limit = F.coalesce("crawl_limit", F.lit(0))
    return metrics.withColumn("outcome", (
        F.when(~F.col("robots_allowed"), "BLOCKED_BY_ROBOTS")
        .when((n == 0) & F.col("origin_blocked"), "BLOCKED_BY_ORIGIN").when(n == 0, "NO_PRODUCTS")
        .when(F.col("ready"), "OK").otherwise("PARTIAL"))
    ).withColumn("cap_reached", (limit > 0) & (n >= limit))


def coverage_verified() -> Column:
    n, limit, estimate = F.coalesce("unique_products", F.lit(0)), F.coalesce("crawl_limit", F.lit(0)), F.col("estimate")
    return F.coalesce((F.col("estimate_kind") == "exact") & (estimate > 0) & (n >= estimate)
                      & ((limit == 0) | (limit >= estimate)) & (F.coalesce("errors", F.lit(0)) == 0), F.lit(False))


def coverage_audit(stores: DataFrame, reports: DataFrame, estimates: DataFrame) -> DataFrame:
    """Collected size against an independent catalogue size, one row per store."""
    rows = (stores.select("store_slug").join(reports.select("store_slug", "unique_products", "crawl_limit", "errors", F.lit(True).alias("_report")), "store_slug", "left")
            .join(estimates.select("store_slug", "estimate", "estimate_kind", "estimate_method"), "store_slug", "left"))
    collected, limit = F.coalesce("unique_products", F.lit(0)), F.coalesce("crawl_limit", F.lit(0))
    estimate = F.col("estimate")
    known = F.coalesce(estimate > 0, F.lit(False))
    exact = F.coalesce(F.col("estimate_kind") == "exact", F.lit(False))
    capped = known & (limit > 0) & (limit < estimate) & (collected >= limit)
    ready = exact & known & (collected >= estimate) & ~capped & (F.coalesce("errors", F.lit(0)) == 0)
    missing = F.col("_report").isNull()
    blocker = (F.when(ready, F.lit(None).cast("string")).when(capped, "smoke run capped below catalog reference")
               .when(~exact, "catalog reference is not exact")
               .when(known & (collected < estimate), "crawl did not reach catalog reference")
               .otherwise("catalog reference unavailable"))
    return rows.select(
        "store_slug", F.when(missing, "FAILED").when(ready, "VERIFIED").otherwise("PARTIAL").alias("status"),
        F.when(~missing, estimate).alias("estimate"), F.when(~missing, F.col("estimate_kind")).alias("estimate_kind"),
        F.when(~missing, F.col("estimate_method")).alias("estimate_method"),
        F.when(~missing, collected).alias("collected"), F.when(~missing, limit).alias("crawl_limit"),
        F.when(~missing & known, F.round(collected / estimate * 100, 4)).alias("observed_catalog_ratio_pct"),
        (~missing & ready).alias("verification_ready"),
        F.when(missing, "crawl report missing").otherwise(blocker).alias("verification_blocker"))


def coverage_report(metrics: DataFrame, audit: DataFrame, stats: DataFrame) -> DataFrame:
    """The published one-row-per-store report."""
    per_store = stats.groupBy("store_slug").agg(
        F.max_by("connector", F.struct("accepted", -F.col("priority"))).alias("primary_source"),
        F.array_sort(F.collect_set(F.when(F.col("urls_checked") > 0, F.col("connector")))).alias("_used"),
        F.sum("errors").alias("errors"))
    rows = audit.join(metrics, "store_slug", "left").join(per_store, "store_slug", "left")
    return rows.select(
        "store_slug", "status", "estimate", "estimate_method", "collected", F.col("observed_catalog_ratio_pct").alias("coverage_pct"),
        "price_complete_pct", F.col("known_stock_pct").alias("stock_complete_pct"), "image_complete_pct",
        "category_complete_pct", "identity_complete_pct", "primary_source",
        F.array_join(F.array_remove("_used", F.col("primary_source")), ", ").alias("fallbacks"), "errors")


def offer_counts(offers: DataFrame, as_of, max_age=None) -> DataFrame:
    return offers.groupBy("store_id").agg(
        F.count_if(F.col("last_seen_at") >= fresh_since(as_of, max_age)).alias("fresh_offers"), F.count("*").alias("total_offers"))


def latest_run(runs: DataFrame) -> DataFrame:
    columns = [c for c in runs.columns if c != "store_id"]
    return (runs.groupBy("store_id").agg(F.max_by(F.struct(*columns), F.struct("started_at", "run_id")).alias("r"))
            .select("store_id", "r.*"))


def store_health(stores: DataFrame, sources: DataFrame, runs: DataFrame, offers: DataFrame, as_of, max_age=None) -> DataFrame:
    frequency = sources.filter("enabled").groupBy("store_id").agg(F.min("crawl_frequency").alias("_every"))
    latest = latest_run(runs).select("store_id", F.col("status").alias("last_status"), "finished_at", "run_id")
    rows = (stores.filter("active").join(latest, "store_id", "left").join(frequency, "store_id", "left")
            .join(offer_counts(offers, as_of, max_age), "store_id", "left"))
    fresh, total = F.coalesce("fresh_offers", F.lit(0)), F.coalesce("total_offers", F.lit(0))
    overdue_after = F.greatest(F.coalesce("_every", F.lit(DEFAULT_CRAWL_MINUTES)) * 2, F.lit(LEAST_OVERDUE_MINUTES))
    age = F.timestamp_diff("SECOND", F.col("finished_at"), literal_ntz(as_of)) / 60
    overdue = F.col("finished_at").isNull() | (age > overdue_after)
    freshness = F.when(total == 0, "NO_OFFERS").when(fresh == total, "FRESH").otherwise("STALE")
    health = (F.when(F.col("run_id").isNull(), "NEVER").when(F.col("last_status").isin("FAILED", "PARTIAL"), F.col("last_status"))
              .when(overdue, "STALE_RUN").when(freshness != "FRESH", "STALE_CATALOG").otherwise("OK"))
    return rows.select(
        "store_id", "slug", "verified", health.alias("health"), F.coalesce("last_status", F.lit("-")).alias("last_status"),
        age_label("finished_at", as_of).alias("last_run"), fresh.alias("fresh_offers"), total.alias("total_offers"), freshness.alias("freshness"))


def unhealthy_verified(health: DataFrame) -> DataFrame:
    return health.filter(F.col("verified") & (F.col("health") != "OK")).select("slug", "health")


def run_status(results: DataFrame) -> DataFrame:
    """Close decision of a run from crawl report and import summary columns.

    Needs exit_code, outcome, ready, blockers, raw_written, importer_code, imported, failed, total.
    """
    no_summary = F.col("imported").isNull()
    not_ready = (F.col("exit_code") == 2) | F.coalesce(F.col("outcome") == "PARTIAL", F.lit(False)) | F.coalesce(~F.col("ready"), F.lit(False))
    blockers = F.coalesce(F.nullif(F.array_join("blockers", ", "), F.lit("")), F.lit("coverage/quality requirements not met"))
    done = (F.col("importer_code") == 0) & ~no_summary & (F.col("failed") == 0) & (F.col("imported") == F.col("total"))

    def end(status, text):
        return F.struct(F.lit(status).alias("status"), text.cast("string").alias("error_message"))

    decision = (
        F.when(not_ready, end("PARTIAL", blockers))
        .when(F.col("exit_code") != 0, end("FAILED", F.concat(F.lit("Crawler exit code "), F.col("exit_code").cast("string"))))
        .when(~F.coalesce(F.col("ready"), F.lit(False)), end("PARTIAL", F.lit("Crawler did not provide positive publish readiness evidence")))
        .when(~F.col("raw_written"), end("FAILED", F.lit("Crawler did not create the raw file")))
        .when(done, end("SUCCESS", F.lit(None)))
        .when(F.coalesce("imported", F.lit(0)) > 0, end("PARTIAL", F.concat(F.col("failed").cast("string"), F.lit(" row(s) failed to import"))))
        .otherwise(end("FAILED", F.concat(F.lit("Importer exit code "), F.coalesce("importer_code", F.lit(1)).cast("string")))))
    rows = results.withColumn("_d", decision)
    errors = F.coalesce("crawl_errors", F.lit(0)) + F.coalesce("failed", F.lit(0)) if "crawl_errors" in results.columns else F.coalesce("failed", F.lit(0))
    fallback = F.when(errors > 0, F.concat(errors.cast("string"), F.lit(" crawl/import error(s)")))
    return rows.withColumns({"status": F.col("_d.status"), "errors": errors,
                             "error_message": F.coalesce("_d.error_message", fallback)}).drop("_d")


def eligible_stores(registry: DataFrame, statuses=("VERIFIED",), slugs=()) -> DataFrame:
    wanted = [s.upper() for s in statuses]
    unknown = [s for s in wanted if s not in rules.REGISTRY_STATUSES]
    if unknown:
        raise ValueError(f"Unsupported registry status: {', '.join(unknown)}.")
    rows = registry.filter(F.col("status").isin(*wanted))
    return rows.filter(F.col("slug").isin(*slugs)) if slugs else rows


def status_summary(registry: DataFrame) -> DataFrame:
    return registry.groupBy("status").agg(F.count("*").alias("stores"))


def batch_summary(results: DataFrame) -> DataFrame:
    """Stores of a sync batch by outcome, as rows: exit code 0 success, 2 partial, else failure."""
    group = F.when(F.col("exit_code") == 0, "success").when(F.col("exit_code") == 2, "partial").otherwise("failure")
    return results.select(group.alias("result"), F.when(group == "failure", F.concat("slug", F.lit(":"), F.col("exit_code").cast("string")))
                          .otherwise(F.col("slug")).alias("entry")).orderBy("result", "entry")


def loyalty_event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("card_id").agg(F.count("*").alias("events"))
