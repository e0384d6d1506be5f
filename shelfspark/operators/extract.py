"""Observations from JSON objects, feed records, JSON-LD scripts and product pages."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark import rules
from shelfspark.functions import commerce as c
from shelfspark.functions.html import html_text, parse_product_page
from shelfspark.functions.text import (
    any_of, blank_to_null, category_path_from_url, city_alias, clean_address, item_url, resolve_url, strip, url_key)
from shelfspark.operators.grouping import top_per_group
from shelfspark.sources.feeds import (
    PRICE_KEYS, PRICE_PARTS, TITLE_KEYS, at, fields_of, items_of, pick, pick_text, scalar_type, text_at, text_of, unwrap)
from shelfspark.rule_tables import ImageRules
from shelfspark.session import cut_lineage

IMAGES = ImageRules()


def _path_of(category: Column) -> Column:
    return F.when(category.isNotNull(), F.array(category)).otherwise(F.array().cast("array<string>"))


def _whole(value: Column) -> Column:
    """Integer of a variant: numbers are cut, truth values are 1 and 0, text must be whole digits."""
    number = F.try_variant_get(value, "$", "double")
    cut = F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)).try_cast("int")
    return F.when(scalar_type(value) == "STRING", F.when(text_of(value).rlike(r"^\s*[+-]?\d+\s*$"), c.parse_int(text_of(value)))).otherwise(
        F.coalesce(cut, c.parse_int(text_of(value))))


def products_from_json(objects: DataFrame, keys: Sequence[str], base_url="base_url", page_url="page_url") -> DataFrame:
    """Product-like objects (``fields`` of walk_json) to observations; rows without title or price fall out."""
    n = "fields"
    # First the members, then what is derived from them: each member is looked up once per row.
    rows = objects.select(
        *keys, *[x for x in ("path",) if x in objects.columns], F.col(base_url).alias("_base"), F.col(page_url).alias("_page"),
        strip(pick_text(n, *TITLE_KEYS)).alias("title"), pick(n, *PRICE_KEYS).alias("_price"), pick(n, "price").alias("_price_box"),
        pick(n, "oldPrice", "old_price", "regularPrice", "regular_price", "compareAtPrice").alias("_old"),
        pick(n, "brand", "manufacturer", "vendor").alias("_brand"),
        pick(n, "image", "imageUrl", "image_url", "thumbnail", "picture", "images").alias("_images"),
        pick(n, "quantity", "qty", "stock", "stockQuantity", "stock_quantity", "availableQuantity").alias("_quantity"),
        pick(n, "availability", "stockStatus", "stock_status", "available", "inStock", "in_stock").alias("_stock"),
        pick(n, "category", "categoryName", "category_name").alias("_category"),
        pick_text(n, "id", "sku", "code", "ean", "gtin", "productId", "product_id").alias("_id"),
        pick_text(n, "currency", "priceCurrency", "currencyCode").alias("_currency"),
        blank_to_null(strip(pick_text(n, "description", "shortDescription", "short_description"))).alias("description"),
        pick_text(n, "sku", "code").alias("sku"), pick_text(n, "ean", "gtin", "barcode").alias("ean"),
        pick_text(n, "url", "link", "productUrl", "product_url", "slug").alias("_link"),
        pick_text(n, "id", "sku", "code", "ean", "productId", "product_id").alias("_ident"))
    image, box = F.col("_images"), F.col("_price_box")
    rows = rows.withColumns({
        "price": c.parse_money(unwrap(F.col("_price"), *PRICE_PARTS)),
        "old_price": c.parse_money(unwrap(F.col("_old"), "value", "amount", "old", "price")),
        "brand": blank_to_null(strip(unwrap(F.col("_brand"), "name", "title"))),
        "_image": F.when(items_of(image).isNotNull(), F.try_variant_get(image, "$[0]", "variant")).otherwise(image),
        "quantity": _whole(F.col("_quantity")),
        "stock_status": c.stock_from_text(unwrap(F.col("_stock"), "status", "value", "available", "inStock", "in_stock"), "json"),
        "_category": unwrap(F.col("_category"), "name", "title"),
        "currency": F.upper(F.coalesce("_currency", pick_text(fields_of(box), "currency", "currencyCode", "priceCurrency"), F.lit("MDL"))),
    }).filter(blank_to_null("title").isNotNull() & F.col("price").isNotNull())
    rows = rows.withColumn("url", item_url("_base", "_link", "_ident", "_page"))
    counted = F.coalesce(c.stock_from_quantity("quantity"), F.col("stock_status"))
    rows = rows.withColumn("_image_ref", unwrap(F.col("_image"), "url", "src", "path"))
    return rows.withColumns({
        "category_path": _path_of(F.col("_category")),
        "external_id": F.coalesce("_id", F.right("url", F.lit(160))),
        "image_url": resolve_url("_base", "_image_ref"),
        "stock_status": F.when(F.col("stock_status") == "UNKNOWN", counted).otherwise(F.col("stock_status")),
        "source": F.lit("generic-json-api"),
    }).drop(*[x for x in rows.columns if x.startswith("_")])


def _field(record: Column, *names: str) -> Column:
    """Exact key first, then the same key in any case (the last such key wins)."""
    def lower(name):
        same = F.filter(F.map_entries(record), lambda e: F.lower(e["key"]) == name.lower())
        return blank_to_null(F.try_element_at(same, F.lit(-1))["value"])
    return F.coalesce(*[x for n in names for x in (blank_to_null(F.try_element_at(record, F.lit(n))), lower(n))])


def products_from_feed(records: DataFrame, keys: Sequence[str], base_url="base_url", feed_url="feed_url") -> DataFrame:
    r = F.col("record")
    rows = records.select(
        *keys, *[x for x in ("path",) if x in records.columns], F.col(base_url).alias("_base"), F.col(feed_url).alias("_feed"),
        strip(_field(r, "name", "title", "product", "product_name")).alias("title"),
        c.parse_money(_field(r, "price", "sale_price", "salePrice", "current_price")).alias("price"),
        c.parse_money(_field(r, "old_price", "oldPrice", "regular_price", "compare_at_price")).alias("old_price"),
        c.stock_from_text(_field(r, "available", "availability", "in_stock", "stock_status"), "feed").alias("stock_status"),
        _field(r, "image", "image_url", "picture", "picture_url").alias("_image"),
        _path_of(_field(r, "category", "category_name", "categoryName")).alias("category_path"),
        _field(r, "id", "sku", "code", "ean").alias("_id"),
        blank_to_null(strip(_field(r, "brand", "vendor", "manufacturer"))).alias("brand"),
        _field(r, "sku", "code").alias("sku"), _field(r, "ean", "gtin", "barcode").alias("ean"),
        F.upper(F.coalesce(_field(r, "currency", "price_currency"), F.lit("MDL"))).alias("currency"),
        c.parse_int(_field(r, "quantity", "qty", "stock_quantity")).alias("quantity"),
        _field(r, "url", "link", "product_url", "productUrl").alias("_link"))
    rows = rows.filter(blank_to_null("title").isNotNull() & F.col("price").isNotNull())
    own = resolve_url("_base", "_link")
    return rows.withColumns({
        "url": F.coalesce(own, F.col("_base")), "external_id": F.coalesce("_id", F.right(F.coalesce(own, F.col("_feed")), F.lit(160))),
        "image_url": resolve_url("_base", "_image"), "source": F.lit("generic-feed"),
    }).drop("_base", "_feed", "_image", "_id", "_link")


_LD_SCRIPT = r"""(?is)<script\b[^>]*\btype\s*=\s*["']?application/ld\+json["']?[^>]*>(.*?)</script>"""


def _is_product(node: Column) -> Column:
    listed = F.array_contains(F.try_variant_get(node, "$['@type']", "array<string>"), "Product")
    return F.coalesce(listed, text_at(node, "@type") == "Product", F.lit(False))


def jsonld_nodes(pages: DataFrame, keys: Sequence[str], html: str = "html") -> DataFrame:
    """First schema.org Product per page.

    Scripts go in page order; inside a script the last item of a list or @graph
    is looked at first, so positions are ranked backwards.
    """
    keys = list(keys)
    scripts = pages.select(*keys, F.posexplode(F.regexp_extract_all(html, F.lit(_LD_SCRIPT), F.lit(1))).alias("script", "text"))
    node = scripts.select(*keys, "script", F.try_parse_json("text").alias("node"))
    # Scripts are a small part of the pages; the walk reads this cut, not the pages again.
    level = cut_lineage(node.filter(F.col("node").isNotNull())).withColumn("order", F.array(F.col("script")))
    level = level.drop("script")
    found = None
    while True:
        tagged = level.withColumn("_hit", fields_of("node").isNotNull() & _is_product(F.col("node")))
        hits = tagged.filter("_hit").select(*keys, "node", "order")
        found = hits if found is None else found.unionByName(hits)
        inner = F.coalesce(items_of("node"), items_of(at("node", "@graph")))
        level = (tagged.filter(~F.col("_hit")).select(*keys, "order", F.posexplode(inner).alias("pos", "node"))
                 .select(*keys, "node", F.concat("order", F.array(-F.col("pos"))).alias("order")))
        if level.isEmpty():
            break
    return top_per_group(found, keys, [F.col("order")])


def products_from_jsonld(pages: DataFrame, keys: Sequence[str], url: str = "url", html: str = "html") -> DataFrame:
    node = jsonld_nodes(pages, [*keys, url], html)
    offers = at("node", "offers")
    offer = F.when(items_of(offers).isNotNull(), F.try_variant_get(offers, "$[0]", "variant")).otherwise(offers)

    def truthy(box, *names):
        return F.coalesce(*[F.when(~((text_at(box, n) == "0") & (scalar_type(at(box, n)) != "STRING")) & (text_at(box, n) != "false"), text_at(box, n)) for n in names])

    image = at("node", "image")
    rows = node.withColumn("_offer", offer).select(
        *keys, F.col(url).alias("url"),
        strip(text_at("node", "name")).alias("title"), c.parse_money(truthy("_offer", "price", "lowPrice"), "jsonld").alias("price"),
        c.stock_from_text(text_at("_offer", "availability"), "jsonld").alias("stock_status"),
        blank_to_null(strip(unwrap(at("node", "brand"), "name"))).alias("brand"),
        F.when(items_of(image).isNotNull(), blank_to_null(F.try_variant_get(image, "$[0]", "string")))
        .otherwise(unwrap(image, "url", "contentUrl")).alias("image_url"),
        truthy("node", "sku").alias("sku"), truthy("node", "gtin13", "gtin14", "gtin12", "gtin").alias("ean"), truthy("node", "mpn").alias("mpn"),
        _path_of(text_at("node", "category")).alias("category_path"), html_text(text_at("node", "description")).alias("description"),
        F.upper(F.coalesce(text_at("_offer", "priceCurrency"), F.lit("MDL"))).alias("currency"), F.lit("json-ld").alias("source"))
    return rows.filter(blank_to_null("title").isNotNull() & F.col("price").isNotNull()).withColumn(
        "external_id", F.coalesce("sku", "ean", "mpn", url_key("url")))


def usable_image(url: Column, social: Column, images: ImageRules = IMAGES) -> Column:
    text = F.lower(strip(url))
    plain = (text != "") & ~text.startswith("data:") & ~any_of(text, images.rejected)
    return plain & ~(social & any_of(text, images.rejected_social))


def pick_image(candidates: Column, images: ImageRules = IMAGES) -> Column:
    """First usable candidate: selectors in order, lazy attributes before src, social pictures last."""
    return F.try_element_at(F.filter(candidates, lambda i: usable_image(i["url"], i["social"], images)), F.lit(1))["url"]


def products_from_html(pages: DataFrame, keys: Sequence[str], url: str = "url", html: str = "html", mode: str = "html",
                       image_rules: ImageRules = IMAGES) -> DataFrame:
    """Product pages without structured data; ``mode="rendered"`` for pages saved after rendering.

    ``page_text`` stays in the result for store-specific enrichers.
    """
    # The parsed struct feeds many columns; generating rows from it keeps the parser at one call per page.
    parsed = pages.select(*keys, F.col(url).alias("url"), F.explode(F.array(parse_product_page(F.col(html)))).alias("h"))
    h = lambda name: F.col("h")[name]
    price = F.coalesce(c.parse_money(h("price_text"), "html"), c.parse_money(h("meta_price"), "html"))
    quantity = c.quantity_from_text(h("page_text"))
    words = [h("stock_text"), h("meta_stock")] + ([h("page_text")] if mode == "html" else [])
    from_url = category_path_from_url("url")
    sku = F.coalesce(blank_to_null(h("sku")), c.sku_from_text(h("page_text")))
    if mode == "html":
        path = F.when(h("has_breadcrumb"), h("breadcrumb")).otherwise(from_url)
        marker = F.when(h("has_breadcrumb"), "breadcrumb").otherwise("url")
    else:
        path = F.when(F.size(h("breadcrumb")) > 0, h("breadcrumb")).otherwise(from_url)
        marker = F.lit(None).cast("string")
    rows = parsed.select(
        *keys, "url", h("title").alias("title"), price.alias("price"), c.parse_money(h("old_price_text"), "html").alias("old_price"),
        quantity.alias("quantity"), c.page_stock(F.lower(F.concat_ws(" ", *words)), quantity, mode).alias("stock_status"),
        strip(sku).alias("sku"), h("brand").alias("brand"), h("description").alias("description"), path.alias("category_path"),
        marker.alias("category_path_source"), c.currency(h("currency"), h("page_text")).alias("currency"),
        pick_image(h("images"), image_rules).alias("_image"), h("images").alias("images"), h("page_text").alias("page_text"),
        F.lit("html-generic" if mode == "html" else "browser-rendered").alias("source"))
    rows = rows.filter(F.col("title").isNotNull() & F.col("price").isNotNull())
    return rows.withColumns({
        "image_url": resolve_url("url", "_image"), "external_id": F.coalesce(blank_to_null("sku"), url_key("url")),
    }).drop("_image")


# -- store-specific enrichers ---------------------------------------------------

_ENRICHERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_enricher(store_slug: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    """``fn`` receives that store's rows of ``products_from_html`` and may change any column."""
    _ENRICHERS[store_slug] = fn


def enrich(products: DataFrame, store: str = "store_slug") -> DataFrame:
    """Apply every registered enricher to the rows of its store, leave the others alone."""
    if not _ENRICHERS:
        return products
    parts = [products.filter(~F.coalesce(F.col(store).isin(*_ENRICHERS), F.lit(False)))]
    parts += [products.filter(F.col(store) == slug).transform(fn) for slug, fn in _ENRICHERS.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _branch_pattern(cities) -> str:
    names = "|".join(sorted({x.replace("-", r"\-") for x in cities}, key=len, reverse=True))
    return rf"(?iud)({names})\s*-\s*(.{{2,140}}?)\s+(În stoc|In stoc|Stoc epuizat)"


def branch_stock(products: DataFrame, keys: Sequence[str], text: str = "page_text", cities=rules.BRANCH_CITIES,
                 label: str = "Darwin") -> DataFrame:
    """Distinct branches named in page text as "city - address status", one row per branch."""
    pattern = F.lit(_branch_pattern(cities))
    groups = [F.regexp_extract_all(text, pattern, F.lit(i)).alias(n) for i, n in ((1, "city"), (2, "address"), (3, "status"))]
    rows = (products.select(*keys, *groups)
            .select(*keys, F.posexplode(F.arrays_zip("city", "address", "status")).alias("pos", "b"))
            .select(*keys, "pos", city_alias(F.trim("b.city")).alias("city"), clean_address(F.col("b.address")).alias("address"),
                    F.when(F.lower("b.status").contains("epuizat"), "OUT_OF_STOCK").otherwise("IN_STOCK").alias("stock_status"))
            .filter(F.col("address") != "").withColumn("_key", F.lower(F.concat_ws("|", "city", "address"))))
    distinct = top_per_group(rows, [*keys, "_key"], [F.col("pos")])
    external = F.left(F.regexp_replace(F.regexp_replace("_key", "(?i)[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(160))
    return distinct.select(
        *keys, "pos", external.alias("location_external_id"), F.concat(F.lit(f"{label} "), "city", F.lit(" — "), "address").alias("location_name"),
        "city", "address", "stock_status")


def branch_roll_up(products: DataFrame, branches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A product is in stock when any branch is, out of stock when all named branches are."""
    per = branches.groupBy(*keys).agg(
        F.bool_or(F.col("stock_status").isin("IN_STOCK", "LOW_STOCK")).alias("_in"),
        F.bool_and(F.col("stock_status") == "OUT_OF_STOCK").alias("_out"), F.count("*").alias("branch_count"))
    return products.join(per, list(keys), "left").withColumn(
        "stock_status", F.when(F.col("_in"), "IN_STOCK").when(F.col("_out"), "OUT_OF_STOCK").otherwise(F.col("stock_status"))).drop("_in", "_out")


_STORE_SKU = r"(?:Код товара|Cod produs)\s*:?\s*([A-Za-z0-9._/-]{2,64})"
_STORE_BRAND = (r"(?:Производитель|Producător)\s*:?\s*([\w.+&' -]{2,80}?)"
                r"(?=\s+(?:Видео|Основные|Электропитание|Управление|Характеристики|$))")


def field_fallbacks(products: DataFrame) -> DataFrame:
    """Own article label, manufacturer from text, and any social picture when no other is usable."""
    sku = blank_to_null(F.regexp_extract("page_text", "(?iU)" + _STORE_SKU, 1))
    brand = blank_to_null(strip(F.regexp_extract("page_text", "(?iU)" + _STORE_BRAND, 1)))
    social = F.try_element_at(F.filter("images", lambda i: i["social"]), F.lit(1))["url"]
    from_markup = F.col("sku").isNotNull() & ~F.col("sku").eqNullSafe(c.sku_from_text("page_text"))
    new_sku = F.when(from_markup, F.col("sku")).otherwise(F.coalesce(sku, F.col("sku")))
    return products.withColumns({
        "sku": new_sku, "external_id": F.when(F.col("external_id").eqNullSafe(F.col("sku")), new_sku).otherwise(F.coalesce(sku, F.col("external_id"))),
        "brand": F.coalesce("brand", brand), "image_url": F.coalesce("image_url", resolve_url("url", social))})


def branch_enricher(products: DataFrame) -> DataFrame:
    return branch_roll_up(products, branch_stock(products, ["url"]), ["url"])


register_enricher("darwin", branch_enricher)
register_enricher("maximum", field_fallbacks)


def catalog_estimate(pages: DataFrame, patterns=rules.ESTIMATE_PATTERNS, store: str = "store_slug", text: str = "text") -> DataFrame:
    """Independent catalogue size stated by a store: value, kind and method."""
    unknown = lambda method: F.struct(F.lit(None).cast("long").alias("value"), F.lit("unknown").alias("kind"), method.alias("method"))
    answer = unknown(F.lit("no public reference-count parser"))
    for slug, pattern, kind, method in patterns:
        found = blank_to_null(F.regexp_extract(text, "(?iU)" + pattern, 1))
        number = F.regexp_replace(found, r"\D", "").try_cast("long")
        known = F.struct(number.alias("value"), F.lit(kind).alias("kind"), F.lit(method).alias("method"))
        answer = F.when(F.col(store) == slug, F.when(number.isNotNull(), known)
                        .when(found.isNotNull(), unknown(F.lit(f"{method}; invalid count")))
                        .otherwise(unknown(F.lit(f"{method}; count not found")))).otherwise(answer)
    return pages.withColumn("_e", answer).select(*pages.columns, F.col("_e.value").alias("estimate"), F.col("_e.kind").alias("estimate_kind"),
                                                 F.col("_e.method").alias("estimate_method"))
