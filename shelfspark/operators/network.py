"""Stored API responses of a rendered page: matching, merging, shape summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.text import blank_to_null, col, url_part
from shelfspark.operators.grouping import top_per_group
from shelfspark.sources.feeds import fields_of, looks_like_product, walk_json

LEAST_SCORE = 4.0
ID_KEYS = ("id", "sku", "code", "ean", "gtin", "productId", "product_id")
STOCK_KEYS = ("quantity", "qty", "stock", "stockQuantity", "stock_quantity", "availability", "available", "inStock", "in_stock")
MERGED = ("stock_status", "quantity", "image_url", "brand", "sku", "ean", "description", "category_path")


def _words(title: Column) -> Column:
    found = F.regexp_extract_all(F.lower(title), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda w: F.length(w) > 1))


def _ids(prefix: str) -> Column:
    return F.filter(F.array(*[F.lower(blank_to_null(f"{prefix}{n}")) for n in ("sku", "ean", "external_id")]), lambda x: x.isNotNull())


def candidate_score(page_url="url") -> Column:
    """Identifier 8, word overlap up to 6, equal title 4, path suffix 5; ``n_*`` is the response side."""
    left, right = _words(F.col("title")), _words(F.col("n_title"))
    both = (F.size(left) > 0) & (F.size(right) > 0)
    overlap = F.size(F.array_intersect(left, right)) / F.greatest(F.lit(1), F.size(F.array_union(left, right)))
    same_title = F.lower(F.trim("title")) == F.lower(F.trim("n_title"))
    mine = F.lower(F.regexp_replace(url_part(col(page_url), "path"), "/+$", ""))
    theirs = F.lower(F.regexp_replace(url_part("n_url", "path"), "/+$", ""))
    suffix = (mine != "") & (theirs != "") & (mine.endswith(theirs) | theirs.endswith(mine))
    return (
        F.when(F.arrays_overlap(_ids(""), _ids("n_")), 8.0).otherwise(0.0)
        + F.when(both, overlap * 6.0 + F.when(same_title, 4.0).otherwise(0.0)).otherwise(0.0)
        + F.when(suffix, 5.0).otherwise(0.0)
    )


def match_network_product(pages: DataFrame, candidates: DataFrame, key: str = "page_id", order: Sequence[str] = ("response", "path")) -> DataFrame:
    """Best response product per page, if its score reaches the threshold; earlier ones win ties."""
    renamed = candidates.select(key, *order, *[F.col(c).alias(f"n_{c}") for c in candidates.columns if c not in (key, *order)])
    scored = pages.join(renamed, key).withColumn("score", candidate_score()).filter(F.col("score") >= LEAST_SCORE)
    return top_per_group(scored, [key], [F.col("score").desc(), *[F.col(o) for o in order]])


def merge_network_product(pages: DataFrame, matches: DataFrame, responses: DataFrame, key: str = "page_id") -> DataFrame:
    """Fill unknown fields of the page product from the matched response product and keep counters."""
    n_cols = [c for c in matches.columns if c.startswith("n_")]
    counted = responses.groupBy(key).agg(F.count("*").cast("int").alias("network_json_responses"))
    rows = (pages.join(matches.select(key, F.lit(True).alias("_match"), *n_cols), key, "left").join(counted, key, "left"))
    have = F.col("_match").isNotNull()
    out = {}
    for name in MERGED:
        if name not in pages.columns or f"n_{name}" not in n_cols:
            continue
        mine, theirs = F.col(name), F.col(f"n_{name}")
        if name == "stock_status":
            take = (mine == "UNKNOWN") & (theirs != "UNKNOWN")
        elif name == "quantity":
            take = mine.isNull() & theirs.isNotNull()
        elif name == "image_url":
            take = theirs.isNotNull() & ~theirs.eqNullSafe(mine)
        elif name == "category_path":
            take = (F.coalesce(F.size(mine), F.lit(0)) <= 0) & (F.size(theirs) > 0)
        else:
            take = blank_to_null(name).isNull() & theirs.isNotNull()
        out[name] = F.when(have & F.coalesce(take, F.lit(False)), theirs).otherwise(mine)
    return rows.withColumns({**out, "network_json_responses": F.coalesce("network_json_responses", F.lit(0)),
                             "network_json_product_match": have, "network_json_enriched": have}).drop("_match", *n_cols)


def json_shapes(responses: DataFrame, key: str = "page_id", per_page: int | None = None,
                max_keys: int | None = None, path_chars: int | None = None) -> DataFrame:
    """Schema summary of the responses of a page; values and query strings are left out.

    ``per_page`` keeps the first responses, ``max_keys`` and ``path_chars`` shorten what is shown.

    ``responses`` holds (page_id, response, response_url, body).
    """
    first = responses if per_page is None else top_per_group(responses, [key], [F.col("response")], per_page)
    docs = first.select(key, "response", "response_url", F.try_parse_json("body").alias("_doc")).filter(F.col("_doc").isNotNull())
    objects = walk_json(docs, [key, "response"], "_doc")

    def has_any(names):
        return F.arrays_overlap(F.map_keys("fields"), F.array(*map(F.lit, names)))

    counts = objects.groupBy(key, "response").agg(
        F.count("*").alias("object_count"), F.count_if(looks_like_product()).alias("product_like_count"),
        F.count_if(has_any(ID_KEYS)).alias("id_like_count"), F.count_if(has_any(STOCK_KEYS)).alias("stock_like_count"))
    root_keys = F.array_sort(F.map_keys(fields_of("_doc")))
    if max_keys is not None:
        root_keys = F.slice(root_keys, 1, max_keys)
    path = url_part("response_url", "path")
    is_object = fields_of("_doc").isNotNull()
    shaped = docs.select(
        key, "response", (path if path_chars is None else F.left(path, F.lit(path_chars))).alias("path"),
        F.when(is_object, "object").otherwise("array").alias("root_type"),
        F.when(is_object, root_keys).otherwise(F.array().cast("array<string>")).alias("top_keys"))
    names = ("object_count", "product_like_count", "id_like_count", "stock_like_count")
    return shaped.join(counts, [key, "response"], "left").withColumns({n: F.coalesce(n, F.lit(0)) for n in names})
