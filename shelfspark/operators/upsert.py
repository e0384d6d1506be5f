"""Insert-or-update jobs of the catalogue tables.

Each job returns the whole new table; ``sources.tables.VersionedTable`` stores
it.  Time is always the observation's ``seen_at``, never the wall clock.
"""

from __future__ import annotations

from decimal import Decimal

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark import rules
from shelfspark.functions.clock import literal_ntz, reconcile_cutoff
from shelfspark.functions.commerce import coerce_stock
from shelfspark.functions.geo import accept_geocode
from shelfspark.functions.seal import seal
from shelfspark.functions.text import blank_to_null, mask_last4, slugify, strip
from shelfspark.operators.grouping import lag_by_key
from shelfspark.session import keep

BEFORE_ALL = "0001-01-01 00:00:00"


# Column rules: (stored value, new value) -> value kept.
def newest(old: Column, new: Column) -> Column:
    return new


def keep_first(old: Column, new: Column) -> Column:
    return F.coalesce(F.nullif(old, F.lit("")), F.nullif(new, F.lit("")))


def fill_new(old: Column, new: Column) -> Column:
    """New value unless it is null."""
    return F.coalesce(new, old)


def largest(old: Column, new: Column) -> Column:
    return F.greatest(old, new)


def stored(old: Column, new: Column) -> Column:
    """Set once, on insert."""
    return old


def stable_id(prefix: str, *columns) -> Column:
    """Repeatable id of a new row, the same in every retry and replay."""
    parts = [F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c, F.lit("\u0000")) for c in columns]
    return F.concat(F.lit(prefix), F.left(F.sha2(F.concat_ws("\u0001", *parts), 256), F.lit(24)))


def upsert(target: DataFrame, updates: DataFrame, keys: list[str],
           column_rules: dict[str, Callable[[Column, Column], Column]] | None = None) -> DataFrame:
    """Full outer join of a table with one update row per key; default rule is ``newest``."""
    column_rules = column_rules or {}
    others = [c for c in target.columns if c not in keys]
    missing = [c for c in others if c not in updates.columns]
    fields = [F.col(c) if c not in missing else F.lit(None).cast(target.schema[c].dataType).alias(c) for c in others]
    old = target.select(*keys, F.struct(*others, F.lit(1).alias("_in")).alias("_old"))
    new = updates.select(*keys, F.struct(*fields, F.lit(1).alias("_in")).alias("_new"))

    def merged(name: str) -> Column:
        before, after = F.col("_old")[name], F.col("_new")[name]
        rule = stored if name in missing else column_rules.get(name, newest)
        both = rule(before, after).cast(target.schema[name].dataType)
        return (F.when(F.col("_new._in").isNull(), before).when(F.col("_old._in").isNull(), after)
                .otherwise(both).alias(name))

    joined = old.join(new, keys, "full_outer").select(*keys, *[merged(c) for c in others])
    return joined.select(*target.columns)


def _first(name: str, seq: str) -> Column:
    """Earliest value that is neither null nor empty."""
    value = blank_to_null(name)
    return F.min_by(value, F.when(value.isNotNull(), F.col(seq))).alias(name)


def upsert_brands(brands: DataFrame, obs: DataFrame) -> DataFrame:
    names = obs.select(blank_to_null(strip("brand")).alias("name")).filter(F.col("name").isNotNull()).distinct()
    fresh = names.join(brands.select("name"), "name", "left_anti")
    return brands.unionByName(fresh.select(stable_id("b-", "name").alias("brand_id"), "name"))


def attach_category(obs: DataFrame, categories: DataFrame) -> DataFrame:
    known = categories.select(F.col("slug").alias("category_slug"), "category_id")
    return obs.join(known, "category_slug", "left")


def default_external_id() -> Column:
    return F.coalesce(blank_to_null("external_id"), F.concat("store_slug", F.lit(":"), slugify("url")))


def product_slugs(new_products: DataFrame, taken: DataFrame) -> DataFrame:
    """Slug per new product; a taken slug gets the store and the tail of the external id.

    The earliest row of a slug keeps it, found with an aggregate instead of
    sorting every slug group.
    """
    rows = new_products.withColumn("_slug", slugify("normalized_title"))
    first = rows.groupBy("_slug").agg(F.min("seq").alias("_first"))
    used = taken.select(F.col("slug").alias("_slug"), F.lit(True).alias("_taken")).distinct()
    long_slug = F.concat_ws("-", "_slug", slugify("store_slug"), F.right(slugify("external_id"), F.lit(24)))
    free = F.col("_taken").isNull() & (F.col("seq") == F.col("_first"))
    return (rows.join(first, "_slug").join(used, "_slug", "left")
            .withColumn("slug", F.when(free, F.col("_slug")).otherwise(long_slug)).drop("_slug", "_first", "_taken"))


PRODUCT_RULES = {
    "title": newest, "normalized_title": stored, "slug": stored, "brand": keep_first, "category_slug": keep_first,
    "ean": keep_first, "mpn": keep_first, "sku": keep_first, "image_url": keep_first, "attributes": stored,
    "data_quality": largest,
}


def product_updates(obs: DataFrame, seq: str = "seq") -> DataFrame:
    """One row per product_id: newest title, first filled fields, best quality."""
    firsts = [c for c in ("brand", "category_slug", "ean", "mpn", "sku", "image_url") if c in obs.columns]
    created = [c for c in ("normalized_title", "attributes", "slug") if c in obs.columns]
    return obs.groupBy("product_id").agg(
        F.max_by("title", seq).alias("title"),
        *[F.min_by(c, seq).alias(c) for c in created],
        *[_first(c, seq) for c in firsts],
        F.max(F.coalesce("data_quality", F.lit(0.0))).alias("data_quality"),
    )


def upsert_products(products: DataFrame, obs: DataFrame, seq: str = "seq") -> DataFrame:
    return upsert(products, product_updates(obs, seq), ["product_id"], PRODUCT_RULES)


def _history(stored_rows: DataFrame, batch: DataFrame, keys: list[str], watched: list[str], time: str) -> DataFrame:
    """Stored rows placed before all rows of the batch, each with its predecessor's watched values."""
    before = stored_rows.withColumns({
        "_time": F.lit(BEFORE_ALL).cast("timestamp_ntz"), "_seq": F.lit(-1).cast("decimal(38,0)"), "_stored": F.lit(True)})
    after = batch.withColumns({"_time": F.col(time), "_seq": F.col("seq").cast("decimal(38,0)"), "_stored": F.lit(False)}).drop("seq")
    rows = before.unionByName(after, allowMissingColumns=True)
    return lag_by_key(rows, keys, "_time", ["_seq"], watched)


def _changed(columns: list[str]) -> Column:
    same = F.lit(True)
    for name in columns:
        same = same & F.col(name).eqNullSafe(F.col(f"prev_{name}"))
    return ~(F.col("has_prev") & same)


OFFER_FIELDS = ("product_id", "title", "price", "old_price", "currency", "stock_status", "quantity", "url", "image_url")


def upsert_offers(offers: DataFrame, batch: DataFrame, keys=("store_id", "external_id"), fields=OFFER_FIELDS) -> DataFrame:
    """Newest fields per offer; the price and stock stamps move only on a change.

    Several observations of one offer may sit in one batch: each is compared with
    the row before it, the first one with the stored offer.
    """
    keys = list(keys)
    fields = [f for f in fields if f in offers.columns]
    prepared = batch.withColumn("stock_status", coerce_stock("stock_status")).select(*keys, *fields, "seen_at", "seq")
    rows = _history(offers.select(*keys, *fields, "last_seen_at", "last_price_update", "last_stock_update"),
                    prepared, keys, ["price", "stock_status", "quantity"], "seen_at")
    order = F.struct("_time", "_seq")
    seen = F.coalesce("seen_at", "last_seen_at")
    price_stamp = F.when(F.col("_stored"), F.col("last_price_update")).otherwise(F.col("seen_at"))
    stock_stamp = F.when(F.col("_stored"), F.col("last_stock_update")).otherwise(F.col("seen_at"))
    merged = rows.groupBy(*keys).agg(
        F.max_by(F.struct(*fields, seen.alias("last_seen_at")), order).alias("_v"),
        F.max_by(price_stamp, F.when(_changed(["price"]), order)).alias("last_price_update"),
        F.max_by(stock_stamp, F.when(_changed(["stock_status", "quantity"]), order)).alias("last_stock_update"))
    return merged.select(*keys, "_v.*", "last_price_update", "last_stock_update")


def append_price_history(offers: DataFrame, batch: DataFrame, keys=("store_id", "external_id")) -> DataFrame:
    """New history rows: the first price of an offer and every price that differs from the one before."""
    keys = list(keys)
    rows = _history(offers.select(*keys, "price"), batch.select(*keys, "price", "seen_at", "seq"), keys, ["price"], "seen_at")
    return rows.filter(~F.col("_stored") & _changed(["price"])).select(
        *keys, F.col("price"), F.col("seen_at").alias("recorded_at"), F.col("_seq").cast("long").alias("seq"))


def upsert_availability(availability: DataFrame, batch: DataFrame, keys=("offer_id", "location_id")) -> DataFrame:
    keys = list(keys)
    prepared = batch.withColumn("stock_status", coerce_stock("stock_status")).select(
        *keys, "stock_status", "quantity", "seen_at", "seq")
    rows = _history(availability.select(*keys, "stock_status", "quantity", "last_seen_at", "last_stock_update"),
                    prepared, keys, ["stock_status", "quantity"], "seen_at")
    order = F.struct("_time", "_seq")
    seen = F.coalesce("seen_at", "last_seen_at")
    stamp = F.when(F.col("_stored"), F.col("last_stock_update")).otherwise(F.col("seen_at"))
    merged = rows.groupBy(*keys).agg(
        F.max_by(F.struct("stock_status", "quantity", seen.alias("last_seen_at")), order).alias("_v"),
        F.max_by(stamp, F.when(_changed(["stock_status", "quantity"]), order)).alias("last_stock_update"))
    return merged.select(*keys, "_v.*", "last_stock_update")


# Room for the branch position behind an observation's number; wide decimals cannot run over.
_POSITIONS = Decimal(1 << 31)


def branch_rows(obs: DataFrame) -> DataFrame:
    """One row per branch of an observation, with the names a location is found by."""
    a = F.col("a")
    trimmed = lambda f: blank_to_null(strip(a[f]))
    return (
        obs.select("store_id", "external_id", "seen_at", "seq", F.posexplode("availabilities").alias("pos", "a"))
        .filter(trimmed("city").isNotNull())
        .select(
            "store_id", F.col("external_id").alias("offer_external_id"), "seen_at",
            (F.col("seq").cast("decimal(20,0)") * F.lit(_POSITIONS) + F.col("pos")).cast("decimal(38,0)").alias("seq"),
            trimmed("location_external_id").alias("external_id"), trimmed("city").alias("city"),
            F.coalesce(trimmed("location_name"), trimmed("address"), trimmed("city")).alias("name"),
            trimmed("address").alias("address"), a["latitude"].alias("latitude"), a["longitude"].alias("longitude"),
            a["opening_hours"].alias("opening_hours"), a["stock_status"].alias("stock_status"), a["quantity"].alias("quantity"))
    )


def _latest(name: str) -> Column:
    return F.max_by(name, F.when(F.col(name).isNotNull(), F.col("seq"))).alias(name)


_PLACE = ["store_id", "city", "name", "address_key"]
_LOCATION_RULES = {"latitude": fill_new, "longitude": fill_new, "opening_hours": fill_new}


def resolve_locations(locations: DataFrame, branches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new locations table, branches with location_id).

    Branches with an external id own their location; branches without one look
    for (store, city, name, address) and only update coordinates and hours.
    """
    with_key = branches.withColumn("address_key", F.coalesce("address", F.lit("\u0000")))
    # Rows that say the same of a branch become one first: the maximum of a number is kept in a hash table as
    # large as the branches, while the newest text by itself would sort all rows of a task.
    said = keep(with_key.groupBy(*_PLACE, "external_id", "address", "latitude", "longitude", "opening_hours")
                .agg(F.max("seq").alias("seq")))
    owned, loose = said.filter(F.col("external_id").isNotNull()), said.filter(F.col("external_id").isNull())

    known = locations.filter(F.col("external_id").isNotNull()).select("store_id", "external_id", "location_id")
    owned_places = owned.groupBy("store_id", "external_id").agg(
        *[F.max_by(c, "seq").alias(c) for c in ("name", "city", "address")],
        *[_latest(c) for c in ("latitude", "longitude", "opening_hours")], F.lit(True).alias("active"))
    owned_places = owned_places.join(known, ["store_id", "external_id"], "left").withColumn(
        "location_id", F.coalesce("location_id", stable_id("l-", "store_id", "external_id")))
    step = upsert(locations, owned_places, ["location_id"], _LOCATION_RULES)

    named = (step.withColumn("address_key", F.coalesce("address", F.lit("\u0000")))
             .groupBy(*_PLACE).agg(F.min("location_id").alias("location_id")))
    loose_places = loose.groupBy(*_PLACE).agg(
        F.max_by("address", "seq").alias("address"), *[_latest(c) for c in ("latitude", "longitude", "opening_hours")])
    loose_places = loose_places.join(named, _PLACE, "left").withColumns({
        "location_id": F.coalesce("location_id", stable_id("l-", "store_id", "city", "name", "address_key")),
        "external_id": F.lit(None).cast("string"), "active": F.lit(True)})
    only_details = {c: stored for c in ("store_id", "external_id", "name", "city", "address", "active")}
    table = upsert(step, loose_places, ["location_id"], {**only_details, **_LOCATION_RULES})

    ids = owned_places.select("store_id", "external_id", "location_id")
    resolved = with_key.filter(F.col("external_id").isNotNull()).join(ids, ["store_id", "external_id"]).unionByName(
        with_key.filter(F.col("external_id").isNull()).join(loose_places.select(*_PLACE, "location_id"), _PLACE))
    return table, resolved.drop("address_key")


def reconcile_missing(offers: DataFrame, store_id, started_at, grace=None, failed: int = 0, full_run: bool = True) -> DataFrame:
    """Offers of a store not seen since the run began become out of stock; branches are left alone."""
    if failed or not full_run:
        return offers.withColumn("marked", F.lit(False))
    stale = ((F.col("store_id") == store_id) & (F.col("last_seen_at") < reconcile_cutoff(started_at, grace))
             & (F.col("stock_status") != "OUT_OF_STOCK"))
    return offers.withColumn("marked", F.coalesce(stale, F.lit(False))).withColumns({
        "stock_status": F.when(F.col("marked"), "OUT_OF_STOCK").otherwise(F.col("stock_status")),
        "quantity": F.when(~F.col("marked"), F.col("quantity")),
        "last_stock_update": F.when(F.col("marked"), literal_ntz(started_at)).otherwise(F.col("last_stock_update")),
    })


def reconcile_stores(offers: DataFrame, runs: DataFrame, grace_hours: int = 0) -> DataFrame:
    """The same rule for many finished full runs at once: (store_id, started_at, failed)."""
    starts = (runs.filter(F.col("failed") == 0).groupBy("store_id").agg(F.max("started_at").alias("_started")))
    cutoff = F.col("_started") - F.make_dt_interval(F.lit(0), F.lit(grace_hours), F.lit(0), F.lit(0))
    marked = F.coalesce((F.col("last_seen_at") < cutoff) & (F.col("stock_status") != "OUT_OF_STOCK"), F.lit(False))
    return offers.join(starts, "store_id", "left").withColumn("marked", marked).withColumns({
        "stock_status": F.when(F.col("marked"), "OUT_OF_STOCK").otherwise(F.col("stock_status")),
        "quantity": F.when(~F.col("marked"), F.col("quantity")),
        "last_stock_update": F.when(F.col("marked"), F.col("_started")).otherwise(F.col("last_stock_update")),
    }).drop("_started")


def seed_locations(locations: DataFrame, seeds: DataFrame, stores: DataFrame) -> DataFrame:
    owned = seeds.join(stores.select(F.col("slug").alias("store_slug"), "store_id"), "store_slug")
    known = locations.select("store_id", "external_id", "location_id")
    updates = owned.join(known, ["store_id", "external_id"], "left").withColumns({
        "location_id": F.coalesce("location_id", stable_id("l-", "store_id", "external_id")), "active": F.lit(True)})
    return upsert(locations, updates, ["location_id"], _LOCATION_RULES)


def seed_categories(categories: DataFrame, seeds: DataFrame) -> DataFrame:
    """Seeds carry slug, names and parent_slug; parents become ids of the same table."""
    ids = (categories.select("slug", "category_id").unionByName(
        seeds.select("slug").join(categories, "slug", "left_anti").select("slug", stable_id("c-", "slug").alias("category_id"))))
    parent = ids.select(F.col("slug").alias("parent_slug"), F.col("category_id").alias("parent_id"))
    updates = seeds.join(ids, "slug").join(parent, "parent_slug", "left")
    return upsert(categories, updates, ["category_id"])


def seed_stores(stores: DataFrame, seeds: DataFrame) -> DataFrame:
    known = stores.select("slug", "store_id")
    updates = seeds.join(known, "slug", "left").withColumns({
        "store_id": F.coalesce("store_id", stable_id("s-", "slug")), "active": F.lit(True)})
    return upsert(stores, updates, ["store_id"])


def seed_sources(sources: DataFrame, seeds: DataFrame) -> DataFrame:
    """Insert (store, url) once; an existing source is left as it is."""
    fresh = seeds.join(sources, ["store_id", "url"], "left_anti").withColumns({
        "type": F.lit("HTML"), "enabled": F.lit(True), "crawl_frequency": F.lit(360)})
    return sources.unionByName(fresh.select(*sources.columns))


def sync_verification(stores: DataFrame, registry: DataFrame) -> DataFrame:
    """Verified only with a VERIFIED entry; stores without an entry lose the flag."""
    status = registry.groupBy("slug").agg(F.bool_or(F.col("status") == "VERIFIED").alias("_verified"))
    return (stores.join(status, "slug", "left")
            .withColumn("verified", F.coalesce("_verified", F.lit(False))).drop("_verified").select(*stores.columns))


def geocode_key(address="address", city="city", country: str = "Moldova") -> Column:
    return F.lower(F.concat(strip(address), F.lit("|"), strip(city), F.lit(f"|{country}")))


def apply_geocodes(locations: DataFrame, cache: DataFrame, country: str = "Moldova") -> DataFrame:
    """Cached coordinates for addressed branches without any; ``geocode`` tells hit, miss or lookup."""
    known = cache.select("key", F.lit(True).alias("_cached"), F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"))
    wanted = F.col("active") & blank_to_null(strip("address")).isNotNull() & (F.col("latitude").isNull() | F.col("longitude").isNull())
    rows = locations.withColumn("key", F.when(wanted, geocode_key(country=country))).join(known, "key", "left")
    hit = F.col("_cached").isNotNull() & accept_geocode("_lat", "_lon")
    return rows.withColumn("geocode", F.when(hit, "hit").when(F.col("_cached").isNotNull(), "miss").when(wanted, "lookup")).withColumns({
        "latitude": F.when(hit, F.col("_lat")).otherwise(F.col("latitude")),
        "longitude": F.when(hit, F.col("_lon")).otherwise(F.col("longitude")),
    }).select(*locations.columns, "geocode")


def finish_runs(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Close run rows with (run_id, status, finished_at, products_found, products_imported, errors, error_message)."""
    fields = ("status", "finished_at", "products_found", "products_imported", "errors", "error_message")
    updates = results.select("run_id", F.struct(*fields).alias("_r"))
    joined = runs.join(updates, "run_id", "left")
    return joined.withColumns({
        f: F.when(F.col("_r").isNotNull(), F.col("_r")[f]).otherwise(F.col(f)) for f in fields
    }).select(*runs.columns)


def stamp_sources(sources: DataFrame, results: DataFrame) -> DataFrame:
    """Enabled sources take the latest result of their store; success alone moves ``last_success``."""
    latest = results.groupBy("store_id").agg(F.max_by(F.struct("status", "finished_at", "error_message"), "finished_at").alias("_r"))
    hit = F.col("enabled") & F.col("_r").isNotNull()
    success = F.col("_r.status") == "SUCCESS"
    return sources.join(latest, "store_id", "left").withColumns({
        "last_crawl": F.when(hit, F.col("_r.finished_at")).otherwise(F.col("last_crawl")),
        "last_success": F.when(hit & success, F.col("_r.finished_at")).otherwise(F.col("last_success")),
        "last_error": F.when(hit, F.when(~success, F.coalesce("_r.error_message", "_r.status"))).otherwise(F.col("last_error")),
    }).select(*sources.columns)


def upsert_loyalty_programs(programs: DataFrame, stores: DataFrame) -> DataFrame:
    """One programme called "default" per active store."""
    known = programs.filter(F.col("external_program_id") == "default").select("store_id", "program_id")
    updates = (stores.filter("active").join(known, "store_id", "left")
               .select(F.coalesce("program_id", stable_id("lp-", "store_id")).alias("program_id"), "store_id",
                       F.lit("default").alias("external_program_id"), F.concat("name", F.lit(" loyalty")).alias("name"),
                       F.col("name").alias("issuer"), F.col("domain").alias("website_url"), F.lit(True).alias("active")))
    return upsert(programs, updates, ["program_id"])


CARD_LIMITS = {"label": 120, "cardholder_name": 120, "payload": 4096, "barcode_format": 32, "notes": 500, "color": 16}


def check_cards(requests: DataFrame) -> DataFrame:
    """Trim, cut the labels to length and flag requests that cannot become a card.

    A payload over its limit is refused: cut and sealed it would no longer be the card.
    """
    cut = requests.withColumns({c: blank_to_null(strip(c) if c == "payload" else F.left(strip(c), F.lit(n))) for c, n in CARD_LIMITS.items()})
    bad = F.col("label").isNull() | F.col("payload").isNull() | (F.length("payload") > CARD_LIMITS["payload"]) | ~F.coalesce(F.col("barcode_format").isin(*rules.BARCODE_FORMATS), F.lit(False))
    return cut.withColumn("reason", F.when(bad, "Invalid loyalty card data."))


def add_cards(cards: DataFrame, requests: DataFrame, key_id: str, secret: str) -> DataFrame:
    good = check_cards(requests).filter(F.col("reason").isNull())
    fresh = good.withColumns({
        "payload_last4": mask_last4("payload"), "encrypted_payload": seal("payload", key_id, secret),
        "status": F.lit("ACTIVE")})
    return cards.unionByName(fresh.select(*cards.columns))


def delete_cards(cards: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` holds (owner_id, card_id); a card of another owner is never touched."""
    return cards.join(wanted.select("owner_id", "card_id"), ["owner_id", "card_id"], "left_anti")


def merge_payload(existing: DataFrame, candidates: DataFrame, keys: list[str], replace_suspicious_image: bool = False,
                  source: str = "browser-rendered") -> DataFrame:
    """Enrichment merge: price stays, gaps are filled, better stock, image, category and quality win."""
    cols = [c for c in existing.columns if c not in keys and c != "enriched_by"]
    fields = [F.col(c) if c in candidates.columns else F.lit(None).cast(existing.schema[c].dataType).alias(c) for c in cols]
    found = candidates.select(*keys, F.struct(*fields, F.lit(1).alias("_in")).alias("_n"))
    new = lambda c: F.col("_n")[c]
    empty = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    has = lambda c: F.coalesce(new(c) != "", F.lit(False))
    takes: dict[str, Column] = {c: empty(c) & has(c) for c in ("brand", "sku", "ean", "mpn", "location_external_id") if c in cols}
    if "description" in cols:
        takes["description"] = has("description") & (F.length(new("description")) > F.length(F.coalesce("description", F.lit(""))))
    unknown = lambda v: F.coalesce(v == "UNKNOWN", F.lit(True))
    takes["stock_status"] = unknown(F.col("stock_status")) & ~unknown(new("stock_status"))
    takes["quantity"] = F.col("quantity").isNull() & new("quantity").isNotNull()
    takes["image_url"] = has("image_url") & (empty("image_url") | (F.lit(replace_suspicious_image) & (new("image_url") != F.col("image_url"))))
    confidence = lambda v: F.coalesce(v, F.lit(0.0))
    better = has("category_slug") & (empty("category_slug") | (confidence(new("category_confidence")) > confidence(F.col("category_confidence"))))
    takes["category_slug"] = takes["category_confidence"] = better
    if "category_path" in cols:
        takes["category_path"] = better & (F.coalesce(F.size(new("category_path")), F.lit(0)) > 0)
    if "availabilities" in cols:
        takes["availabilities"] = (F.coalesce(F.size(new("availabilities")), F.lit(0)) > 0) & (F.coalesce(F.size("availabilities"), F.lit(0)) <= 0)
    takes["data_quality"] = F.coalesce(new("data_quality") > F.coalesce("data_quality", F.lit(0.0)), F.lit(False))

    rows = existing.join(found, keys, "left")
    for name, test in takes.items():
        rows = rows.withColumn(f"_t_{name}", F.coalesce(F.col("_n._in").isNotNull() & test, F.lit(False)))
    changed = F.lit(False)
    for name in takes:
        changed = changed | F.col(f"_t_{name}")
    out = {name: F.when(F.col(f"_t_{name}"), new(name)).otherwise(F.col(name)) for name in takes}
    if "attributes" in cols:  # MAP<STRING, STRING>; the candidate's value wins per key
        kept = F.coalesce("attributes", F.create_map().cast("map<string,string>"))
        added = F.coalesce(new("attributes"), F.create_map().cast("map<string,string>"))
        union = F.map_concat(F.map_filter(kept, lambda k, _: ~F.coalesce(F.map_contains_key(added, k), F.lit(False))), added)
        out["attributes"] = F.when(F.size(added) > 0, union).otherwise(F.col("attributes"))
        differs = F.size(F.map_filter(added, lambda k, v: ~F.try_element_at(kept, k).eqNullSafe(v))) > 0
        changed = changed | F.coalesce(differs, F.lit(False))
    by = F.coalesce(new("source_connector"), F.lit(source)) if "source_connector" in cols else F.lit(source)
    already = F.coalesce("enriched_by", F.array().cast("array<string>")) if "enriched_by" in existing.columns else F.array().cast("array<string>")
    out["enriched_by"] = F.when(changed, F.array_union(already, F.array(by))).otherwise(already)
    out["changed"] = changed
    return rows.withColumns(out).select(*keys, *cols, "enriched_by", "changed")
