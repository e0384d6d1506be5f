"""Questions a price-comparison service asks of its catalogue.

Results are flat rows (product, offer, branch).  Nothing is nested into
per-product lists, so a product with very many offers stays distributed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions.clock import fresh_since, open_state
from shelfspark.functions.commerce import is_available
from shelfspark.functions.geo import bounding_box, haversine_km, in_box, valid_coordinates
from shelfspark.functions.text import blank_to_null
from shelfspark.operators.grouping import page_of, top_per_group

DEFAULT_PAGE_SIZE = 48


def listed_stores(stores: DataFrame) -> DataFrame:
    return stores.filter(F.col("active") & F.col("verified"))


def available_cities(locations: DataFrame, stores: DataFrame) -> DataFrame:
    return (locations.filter("active").join(listed_stores(stores), "store_id", "left_semi")
            .select("city").distinct().orderBy("city"))


def available_stores(stores: DataFrame) -> DataFrame:
    return listed_stores(stores).select("slug", "name").orderBy("name", "slug")


def fresh_offers(offers: DataFrame, stores: DataFrame, as_of, max_age=None, store: str | None = None) -> DataFrame:
    chosen = listed_stores(stores)
    if store:
        chosen = chosen.filter(F.col("slug") == store)
    return offers.filter(F.col("last_seen_at") >= fresh_since(as_of, max_age)).join(
        chosen.select("store_id"), "store_id", "left_semi")


def home_counts(products: DataFrame, offers: DataFrame, stores: DataFrame, as_of, max_age=None) -> DataFrame:
    fresh = fresh_offers(offers, stores, as_of, max_age)
    per_product = fresh.groupBy("product_id").agg(F.count("*").alias("n"))
    known = per_product.join(products.select("product_id"), "product_id", "left_semi")
    return known.agg(F.count("*").alias("products")).select(
        listed_stores(stores).agg(F.count("*")).scalar().alias("stores"),
        "products",
        F.coalesce(per_product.agg(F.sum("n")).scalar(), F.lit(0)).cast("long").alias("offers"))


def root_categories(categories: DataFrame) -> DataFrame:
    return categories.filter(F.col("parent_id").isNull()).orderBy("name_ru", "category_id")


def child_categories(categories: DataFrame) -> DataFrame:
    parents = categories.select(F.col("category_id").alias("parent_id"), F.col("slug").alias("parent_slug"))
    return categories.join(parents, "parent_id").select("parent_slug", "category_id", "slug", "name_ru")


def latest_products(products: DataFrame, offers: DataFrame, stores: DataFrame, as_of, max_age=None,
                    count: int = 12, offers_each: int = 3) -> DataFrame:
    """Newest products with a fresh offer, and their cheapest fresh offers whatever the stock."""
    fresh = fresh_offers(offers, stores, as_of, max_age)
    newest = (products.join(fresh, "product_id", "left_semi")
              .orderBy(F.col("updated_at").desc(), F.col("product_id")).limit(count))
    rows = fresh.join(newest.select("product_id", "title", "updated_at"), "product_id")
    ranked = rows.withColumn("offer_rank", F.row_number().over(
        Window.partitionBy("product_id").orderBy("price", "offer_id")))
    return ranked.filter(F.col("offer_rank") <= offers_each).select(
        "product_id", "title", "updated_at", "offer_rank", "offer_id", "price", "stock_status")


def nearby_locations(locations: DataFrame, stores: DataFrame, latitude: float, longitude: float,
                     radius: float = 10.0) -> DataFrame:
    """Box first (a range filter the scan can use), exact distance second."""
    distance = haversine_km(latitude, longitude, "latitude", "longitude")
    return (
        locations.filter(F.col("active") & in_box("latitude", "longitude", bounding_box(latitude, longitude, radius)))
        .join(listed_stores(stores), "store_id", "left_semi")
        .filter(valid_coordinates("latitude", "longitude"))
        .withColumn("distance_km", distance)
        .filter(F.col("distance_km") <= radius)
        .orderBy("distance_km", "location_id")
    )


def text_filter(q: str, *columns: str) -> Column:
    needle = (q or "").strip().lower()
    if not needle:
        return F.lit(True)
    test = F.lit(False)
    for name in columns:
        test = test | F.coalesce(F.contains(F.lower(F.col(name)), F.lit(needle)), F.lit(False))
    return test


def branches_in_scope(availability: DataFrame, locations: DataFrame, as_of, max_age=None, city: str | None = None,
                      near: tuple[float, float, float] | None = None, stores: DataFrame | None = None) -> DataFrame:
    """Fresh, available branch rows inside a city and/or a radius, with their distance."""
    places = locations.filter("active")
    if city:
        places = places.filter(F.lower("city") == city.strip().lower())
    if near:
        places = nearby_locations(places, stores, *near)
    else:
        places = places.withColumn("distance_km", F.lit(None).cast("double"))
    fresh = availability.filter((F.col("last_seen_at") >= fresh_since(as_of, max_age)) & is_available("stock_status"))
    return fresh.join(places.select("location_id", "city", "distance_km"), "location_id")


def offer_filter(offers: DataFrame, availability: DataFrame, locations: DataFrame, as_of, max_age=None,
                 city=None, near=None, stores: DataFrame | None = None) -> DataFrame:
    """With a city or a place, a branch decides and the offer's own status is ignored."""
    if not city and not near:
        return offers.filter(is_available("stock_status"))
    scope = branches_in_scope(availability, locations, as_of, max_age, city, near, stores)
    return offers.join(scope.select("offer_id"), "offer_id", "left_semi")


def nearest_branch(branches: DataFrame) -> DataFrame:
    """Closest branch of every offer; a partial aggregate, no per-offer list."""
    nearest = F.min_by(F.struct("location_id", "distance_km"), F.struct("distance_km", "location_id"))
    return (branches.filter(F.col("distance_km").isNotNull()).groupBy("offer_id").agg(nearest.alias("n"))
            .select("offer_id", F.col("n.location_id").alias("nearest_location_id"), F.col("n.distance_km").alias("distance_km")))


def offer_order(sort: str = "price-asc", has_geo: bool = False) -> list[Column]:
    if sort == "nearest" and has_geo:
        return [F.col("distance_km").asc_nulls_last(), F.col("price"), F.col("offer_id")]
    return [F.col("price").desc() if sort == "price-desc" else F.col("price"), F.col("offer_id")]


def best_offer(offers: DataFrame) -> DataFrame:
    columns = [c for c in offers.columns if c != "product_id"]
    best = F.min_by(F.struct(*columns), F.struct("price", "offer_id"))
    return offers.groupBy("product_id").agg(best.alias("best")).select("product_id", "best.*")


def _page(matching: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """One page of products with its ranks; only the sorted columns travel."""
    return page_of(matching, order, page, size, "product_rank", "total").withColumn(
        "total_pages", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long"))


def search_catalog(products: DataFrame, offers: DataFrame, stores: DataFrame, availability: DataFrame,
                   locations: DataFrame, as_of, max_age=None, q: str = "", sort: str = "price-asc", city=None,
                   store=None, near=None, page: int = 1, size: int = DEFAULT_PAGE_SIZE,
                   order_products: str = "title", text_columns=("title", "normalized_title", "brand")) -> DataFrame:
    """One page of matching products with all their matching offers.

    ``price-desc`` orders products by title downwards and ``nearest`` only moves
    offers inside a product; ``order_products="best_price"`` sorts by cheapest offer.
    """
    fresh = fresh_offers(offers, stores, as_of, max_age, store)
    wanted = offer_filter(fresh, availability, locations, as_of, max_age, city, near, stores)
    text = products.filter(text_filter(q, *[c for c in text_columns if c in products.columns]))
    if order_products == "best_price":
        cheapest = wanted.groupBy("product_id").agg(F.min("price").alias("best_price"))
        matching = text.join(cheapest, "product_id")
        key = F.col("best_price")
    else:
        matching = text.join(wanted, "product_id", "left_semi")
        key = F.col("title")
    order = [F.col("_key").desc() if sort == "price-desc" else F.col("_key"), F.col("product_id")]
    pages = _page(matching.select("product_id", "title", key.alias("_key")), order, page, size).select(
        "product_id", "title", "product_rank", "total", "total_pages")
    rows = wanted.join(pages, "product_id")
    if near:
        scope = branches_in_scope(availability, locations, as_of, max_age, city, near, stores)
        rows = rows.join(nearest_branch(scope), "offer_id", "left")
    else:
        rows = rows.withColumns({"nearest_location_id": F.lit(None).cast("long"), "distance_km": F.lit(None).cast("double")})
    return rows.select(
        "product_rank", "product_id", "title", "total", "total_pages", "offer_id", "store_id", "price",
        "stock_status", "nearest_location_id", "distance_km",
    ).orderBy("product_rank", *offer_order(sort, bool(near)))


def search_branches(found: DataFrame, availability: DataFrame, locations: DataFrame, as_of, max_age=None,
                    city=None, near=None, stores: DataFrame | None = None) -> DataFrame:
    """Branch rows of the offers on a result page."""
    scope = branches_in_scope(availability, locations, as_of, max_age, city, near, stores)
    return scope.join(found.select("offer_id", "product_id"), "offer_id")


def category_page(products: DataFrame, offers: DataFrame, stores: DataFrame, slug: str, as_of, max_age=None,
                  page: int = 1, size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """Products directly in a category that have a fresh, available offer."""
    wanted = fresh_offers(offers, stores, as_of, max_age).filter(is_available("stock_status"))
    matching = products.filter(F.col("category_slug") == slug).join(wanted, "product_id", "left_semi")
    pages = _page(matching.select("product_id", "title"), [F.col("title"), F.col("product_id")], page, size).select(
        "product_id", "title", "product_rank", "total", "total_pages")
    return wanted.join(pages, "product_id").select(
        "product_rank", "product_id", "title", "total", "total_pages", "offer_id", "price", "stock_status",
    ).orderBy("product_rank", "price", "offer_id")


def product_detail(products: DataFrame, offers: DataFrame, stores: DataFrame, availability: DataFrame,
                   locations: DataFrame, as_of, max_age=None, slug: str | None = None, city=None,
                   near: tuple[float, float, float] | None = None) -> DataFrame:
    """Offers of a product (or of all products) with the branch a buyer would be shown."""
    chosen = products if slug is None else products.filter(F.col("slug") == slug)
    fresh = fresh_offers(offers, stores, as_of, max_age).join(chosen.select("product_id"), "product_id", "left_semi")
    places = locations.filter("active")
    if city:
        places = places.filter(F.lower("city") == city.strip().lower())
    if near:
        latitude, longitude, radius = near
        places = (places.filter(valid_coordinates("latitude", "longitude")
                                & in_box("latitude", "longitude", bounding_box(latitude, longitude, radius)))
                  .withColumn("distance_km", haversine_km(latitude, longitude, "latitude", "longitude"))
                  .filter(F.col("distance_km") <= radius))
    else:
        places = places.withColumn("distance_km", F.lit(None).cast("double"))
    branches = (availability
                .filter((F.col("last_seen_at") >= fresh_since(as_of, max_age)) & is_available("stock_status"))
                .join(places.select("location_id", "distance_km"), "location_id"))
    order = F.struct(F.coalesce("distance_km", F.lit(float("inf"))), F.col("location_id"))
    shown = branches.groupBy("offer_id").agg(
        F.count("*").alias("branches"),
        F.min_by(F.struct("location_id", "distance_km", "stock_status", "quantity"), order).alias("first"))
    has_branch = F.col("branches") > 0
    rows = fresh.join(shown, "offer_id", "left").withColumn("branches", F.coalesce("branches", F.lit(0).cast("long")))
    keep = has_branch if (city or near) else (has_branch | is_available("stock_status"))
    return rows.filter(keep).select(
        "product_id", "offer_id", "store_id", "price", "stock_status", "branches",
        F.col("first.location_id").alias("first_location_id"), F.col("first.distance_km").alias("distance_km"),
    ).orderBy("product_id", *([F.col("distance_km").asc_nulls_last()] if near else []), "price", "offer_id")


def offer_summary(offers: DataFrame, availability: DataFrame) -> DataFrame:
    """Offers, offers in stock, and offers confirmed by a branch (or by themselves without branches)."""
    branch = availability.groupBy("offer_id").agg(F.bool_or(is_available("stock_status")).alias("branch_ok"))
    rows = offers.select("product_id", "offer_id", "stock_status").join(branch, "offer_id", "left")
    return rows.groupBy("product_id").agg(
        F.count("*").alias("offers"),
        F.count_if(F.col("stock_status").isin("IN_STOCK", "LOW_STOCK")).alias("in_stock"),
        F.count_if(F.coalesce(F.col("branch_ok"), is_available("stock_status"))).alias("confirmed"))


def branch_summary(availability: DataFrame) -> DataFrame:
    return availability.groupBy("offer_id").agg(
        F.count_if(is_available("stock_status")).alias("available"), F.count("*").alias("total"))


def display_branch(offers: DataFrame, branches: DataFrame) -> DataFrame:
    """Location, status and quantity to show: nearest branch, else first branch, else the offer itself."""
    order = F.struct(F.coalesce("distance_km", F.lit(float("inf"))), F.col("location_id"))
    first = branches.groupBy("offer_id").agg(
        F.min_by(F.struct("location_id", "stock_status", "quantity"), order).alias("b"))
    own = F.col("location_id") if "location_id" in offers.columns else F.lit(None).cast("long")
    return offers.join(first, "offer_id", "left").select(
        "offer_id", F.coalesce(F.col("b.location_id"), own).alias("shown_location_id"),
        F.coalesce(F.col("b.stock_status"), F.col("stock_status")).alias("shown_status"),
        F.coalesce(F.col("b.quantity"), F.col("quantity")).alias("shown_quantity"))


def discounts(offers: DataFrame) -> DataFrame:
    return offers.filter(F.col("old_price") > F.col("price"))


def product_specs(products: DataFrame, limit: int = 12) -> DataFrame:
    """First attributes of each product as rows; ``attributes`` is a VARIANT object."""
    fields = products.sparkSession.tvf.variant_explode(F.col("attributes").outer())
    return (products.select("product_id", "attributes").lateralJoin(fields).filter(F.col("pos") < limit)
            .select("product_id", F.col("pos").cast("long").alias("pos"), F.col("key").alias("name"),
                    F.try_variant_get("value", "$", "string").alias("value")))


def wallet(cards: DataFrame, programs: DataFrame, stores: DataFrame, owner: str | None = None) -> DataFrame:
    rows = cards.filter(F.col("status") != "ARCHIVED")
    if owner is not None:
        rows = rows.filter(F.col("owner_id") == owner)
    named = (rows.join(programs.select("program_id", F.col("name").alias("program"), F.col("store_id")), "program_id", "left")
             .join(stores.select("store_id", F.col("name").alias("store")), "store_id", "left"))
    return named.orderBy("owner_id", F.col("favorite").desc(), F.col("updated_at").desc(), "card_id")


def wallet_card(cards: DataFrame, owner: str, card_id) -> DataFrame:
    return cards.filter((F.col("card_id") == card_id) & (F.col("owner_id") == owner) & (F.col("status") == "ACTIVE"))


def image_of(products: DataFrame, offers: DataFrame) -> DataFrame:
    best = best_offer(offers).select("product_id", F.col("image_url").alias("_offer_image"))
    return products.join(best, "product_id", "left").select(
        "product_id", F.coalesce(blank_to_null("image_url"), blank_to_null("_offer_image")).alias("image_url"))


def open_now(branches: DataFrame, locations: DataFrame, at: Column, locale: str = "ru") -> DataFrame:
    """Opening state is computed once per location, then joined to the branches."""
    states = locations.withColumn("_state", open_state("opening_hours", at, locale)).select(
        "location_id", F.col("_state.state").alias("open_state"), F.col("_state.today").alias("today"))
    return branches.join(states, "location_id")


def shared_products(products: DataFrame, offers: DataFrame, history: DataFrame, ean: str | None = None) -> DataFrame:
    """Products with an EAN, their offers across stores, and the price history in time order."""
    chosen = products.filter(F.col("ean").isNotNull() if ean is None else F.col("ean") == ean)
    return (chosen.select("ean", "product_id").join(offers.select("product_id", "offer_id", "store_id"), "product_id")
            .join(history, "offer_id")
            .select("ean", "product_id", "offer_id", "store_id", "recorded_at", F.col("price").alias("price"))
            .orderBy("ean", "product_id", "store_id", "recorded_at"))
