"""Text, slug and url expressions (Column -> Column)."""

from __future__ import annotations

import unicodedata
from functools import reduce
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark import rules

SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"


def col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def any_of(text: Column, tokens) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(token) for token in tokens))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``; for values costly to repeat."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blank_to_null(value) -> Column:
    return F.when(col(value) != "", col(value))


def strip(value) -> Column:
    """Trim every Unicode blank, not only the space character."""
    return F.regexp_replace(col(value), rf"^{SPACE}+|{SPACE}+$", "")


def squeeze(value) -> Column:
    return strip(F.regexp_replace(col(value), rf"{SPACE}+", " "))


# Unicode normal forms are not built into Spark, and Arrow's own kernel does not compose.
def _normal_form(form: str):
    @F.arrow_udf(T.StringType())
    def convert(values: pa.Array) -> pa.Array:
        if pc.all(pc.string_is_ascii(values)).as_py() is not False:
            return values  # nothing to compose, and no copy of long texts
        return pa.array([v if v is None or v.isascii() else unicodedata.normalize(form, v) for v in values.to_pylist()], pa.string())
    return convert


_nfkc, _nfkd = _normal_form("NFKC"), _normal_form("NFKD")


def normalize_text(value) -> Column:
    text = F.lower(strip(_nfkc(col(value))))
    return squeeze(F.regexp_replace(text, rf"[^\p{{L}}\p{{N}}_.+/\-{SPACE[1:-1]}]", " "))


def category_text(value) -> Column:
    return squeeze(F.translate(F.lower(col(value)), "șşțţ", "sstt"))


def slugify(value) -> Column:
    text = F.regexp_replace(F.lower(_nfkd(col(value))), "[^a-z0-9]+", "-")
    text = F.left(F.regexp_replace(text, "^-+|-+$", ""), F.lit(120))
    return F.coalesce(blank_to_null(text), F.lit("product"))


def url_key(url) -> Column:
    text = F.regexp_replace(F.regexp_replace(col(url), "[^a-zA-Z0-9]+", "-"), "^-+|-+$", "")
    return F.right(text, F.lit(160))


_URL = r"^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"


def url_part(url, part: str) -> Column:
    group = {"scheme": 1, "netloc": 2, "path": 3, "query": 4, "fragment": 5}[part]
    value = F.regexp_extract(col(url), _URL, group)
    return F.lower(value) if part == "scheme" else value


def clean_url(url) -> Column:
    """Drop fragment and path parameters, keep the query, empty path becomes '/'."""
    scheme, netloc, query = url_part(url, "scheme"), url_part(url, "netloc"), url_part(url, "query")
    path = F.regexp_replace(url_part(url, "path"), ";[^/]*$", "")
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        F.when(netloc != "", F.concat(F.lit("//"), netloc)).otherwise(""),
        F.coalesce(blank_to_null(path), F.lit("/")),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
    )


def same_origin(left, right) -> Column:
    return F.lower(url_part(left, "netloc")) == F.lower(url_part(right, "netloc"))


def _join(base, reference):
    try:
        return urljoin(base, reference)
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def _resolve(base: pd.Series, reference: pd.Series) -> pd.Series:
    return pd.Series([None if b is None or r is None else _join(b, r) for b, r in zip(base, reference)])


def resolve_url(base, reference) -> Column:
    """Full relative reference resolution (dot segments included)."""
    return _resolve(col(base), col(reference))


def item_url(base, link, identifier, fallback) -> Column:
    """Own link resolved against the shop, else fallback page with a product fragment."""
    own = blank_to_null(link)
    return (
        F.when(own.isNotNull(), resolve_url(base, own))
        .when(col(identifier).isNotNull(), F.concat(col(fallback), F.lit("#product-"), col(identifier)))
        .otherwise(col(fallback))
    )


def category_path_from_url(url, ignored=rules.IGNORED_PATH_PARTS) -> Column:
    raw = url_part(url, "path")
    path = F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    cleaned = F.filter(
        F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1),
                    lambda p: F.lower(strip(F.regexp_replace(p, "[_-]+", " ")))),
        lambda p: (p != "") & ~p.isin(*ignored) & ~p.rlike(r"^\p{Nd}+$"),
    )
    last = F.slice(cleaned, F.greatest(F.size(cleaned) - 2, F.lit(1)), F.lit(3))
    return F.when(F.size(parts) < 2, F.array().cast("array<string>")).otherwise(last)


def is_service(title, patterns=rules.SERVICE_PATTERNS) -> Column:
    return normalize_text(title).rlike("(?iU)(?:" + "|".join(patterns) + ")")


def localized_name(ro, ru, locale: str) -> Column:
    return F.coalesce(blank_to_null(ro), col(ru)) if locale == "ro" else col(ru)


def mask_last4(value) -> Column:
    return F.right(strip(value), F.lit(4))


def city_alias(city, aliases=None) -> Column:
    aliases = aliases or rules.CITY_ALIASES
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(col(city))), col(city))


def clean_address(value) -> Column:
    text = F.regexp_replace(col(value), r"(?iU)\s+(?:Sună|Suna|Harta)\b.*$", "")
    text = F.regexp_replace(text, rf"{SPACE}+", " ")
    return F.left(F.btrim(text, F.lit(" ,;-")), F.lit(200))


def store_from_url(url, slug=None) -> Column:
    """Base url and a safe slug for a store that is not registered."""
    text = F.when(col(url).contains("://"), col(url)).otherwise(F.concat(F.lit("https://"), col(url)))
    netloc = url_part(text, "netloc")
    derived = F.substring_index(F.regexp_replace(F.lower(netloc), r"^www\.", ""), ".", 1)
    wanted = derived if slug is None else F.coalesce(blank_to_null(slug), derived)
    safe = F.regexp_replace(F.regexp_replace(F.lower(wanted), "[^a-z0-9-]+", "-"), "^-+|-+$", "")
    scheme = F.coalesce(blank_to_null(url_part(text, "scheme")), F.lit("https"))
    return F.when(netloc != "", F.struct(
        F.coalesce(blank_to_null(safe), F.lit("external-store")).alias("slug"),
        netloc.alias("name"),
        F.concat(scheme, F.lit("://"), netloc).alias("domain"),
        F.lit("UNREGISTERED").alias("status"),
    ))
