"""Money, stock, category and quality expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark import rules
from shelfspark.functions.text import any_of, blank_to_null, category_text, col, let

MONEY = "decimal(14,2)"
_NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"
_AMOUNT = r"(?iU)(?<!\d)(\d[\d\s.,]*?)\s*(?:MDL|LEI|RON|EUR|€|USD|\$)\b"


def _to_money(text: Column) -> Column:
    return F.when(text.rlike(_NUMBER), text).try_cast(MONEY)


def parse_money(value, style: str = "json") -> Column:
    text = col(value).cast("string")
    if style == "json":
        return _to_money(F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit(","), F.lit(".")))
    if style == "jsonld":
        return _to_money(F.replace(F.regexp_replace(text, "[^0-9,.-]", ""), F.lit(","), F.lit(".")))
    amount = F.coalesce(blank_to_null(F.regexp_extract(text, _AMOUNT, 1)), text)
    return let(F.regexp_replace(amount, "[^0-9,.-]", ""), _html_amount)


def _html_amount(digits: Column) -> Column:
    """A label printed twice counts once; one lone comma is the decimal mark."""
    half = F.substr(digits, F.lit(1), (F.length(digits) / 2).cast("int"))
    once = F.when(digits.rlike("^[0-9]+$") & (F.concat(half, half) == digits), half).otherwise(digits)
    return let(once, lambda d: _to_money(
        F.when((F.length(F.regexp_replace(d, "[^,]", "")) == 1) & ~d.contains("."), F.replace(d, F.lit(","), F.lit(".")))
        .otherwise(F.replace(d, F.lit(","), F.lit("")))))


def parse_int(value) -> Column:
    """Whole-number text, a JSON number cut towards zero, or a JSON truth value."""
    text = F.btrim(col(value).cast("string"))
    return (
        F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("int"))
        .when(text == "true", F.lit(1)).when(text == "false", F.lit(0))
    )


def currency(meta, page_text=None, default: str = "MDL") -> Column:
    given = F.upper(blank_to_null(meta))
    if page_text is None:
        return F.coalesce(given, F.lit(default))
    text = col(page_text)
    return F.coalesce(given, F.when(text.contains("€") | text.contains("EUR"), "EUR").otherwise(default))


def stock_from_text(value, style: str = "json", tokens=None) -> Column:
    text = F.lower(F.coalesce(col(value).cast("string"), F.lit("")))
    if style == "feed":
        branches = [(text.isin(*words), status) for status, words in rules.FEED_STOCK_WORDS]
    else:
        table = (tokens or rules.STOCK_TOKENS)[style]
        branches = [(any_of(text, words), status) for status, words in table]
    return F.coalesce(*[F.when(test, F.lit(status)) for test, status in branches], F.lit("UNKNOWN"))


def stock_from_quantity(quantity) -> Column:
    q = col(quantity)
    return F.when(q <= 0, "OUT_OF_STOCK").when(q <= 10, "LOW_STOCK").when(q.isNotNull(), "IN_STOCK")


def page_stock(availability_text, quantity, style: str = "html") -> Column:
    """A known quantity decides; in rendered pages negative text still wins unless it does."""
    by_text = stock_from_text(availability_text, style)
    if style == "html":
        return F.coalesce(stock_from_quantity(quantity), by_text)
    negative = any_of(F.lower(F.coalesce(col(availability_text), F.lit(""))), dict(rules.STOCK_TOKENS[style])["OUT_OF_STOCK"])
    return (F.when((col(quantity) == 0) | negative, "OUT_OF_STOCK")
            .otherwise(F.coalesce(F.when(col(quantity) <= 10, "LOW_STOCK").when(col(quantity) > 10, "IN_STOCK"), by_text)))


def coerce_stock(value) -> Column:
    return F.when(col(value).isin(*rules.STOCK_STATUSES), col(value)).otherwise("UNKNOWN")


def is_available(status) -> Column:
    return col(status).isin(*rules.AVAILABLE_STATUSES)


def quantity_from_text(text, patterns=rules.QUANTITY_PATTERNS) -> Column:
    return F.coalesce(*[blank_to_null(F.regexp_extract(col(text), "(?iU)" + p, 1)) for p in patterns]).try_cast("int")


def sku_from_text(text, pattern=rules.SKU_PATTERN) -> Column:
    return blank_to_null(F.regexp_extract(col(text), "(?iU)" + pattern, 1))


def stock_label(status, quantity, locale: str = "ru", labels=None) -> Column:
    words = (labels or rules.STOCK_LABELS)[locale]
    s, q = col(status), col(quantity)
    before, after = words["exact"].split("{quantity}")
    return (
        F.when((s == "OUT_OF_STOCK") | (q == 0), words["out"])
        .when(s == "PREORDER", words["preorder"])
        .when((q > 0) & (q <= 10), F.concat(F.lit(before), q.cast("string"), F.lit(after)))
        .when(s.isin("IN_STOCK", "LOW_STOCK") | (q > 10), words["in"])
        .otherwise(words["unknown"])
    )


def quality_score(weights=rules.QUALITY_WEIGHTS, **fields) -> Column:
    """Sum of the weights whose condition holds.

    ``fields`` maps a weight name to a boolean column; see ``observation_score``.
    """
    total = reduce(lambda a, b: a + b, [
        F.when(F.coalesce(fields[name], F.lit(False)), F.lit(weight)).otherwise(F.lit("0.00")).cast("decimal(4,2)")
        for name, weight in weights.items()
    ])
    return total.cast("double")


def filled(value) -> Column:
    return F.coalesce(col(value) != "", F.lit(False))


def observation_score() -> Column:
    """quality_score over the observation schema."""
    branches = F.coalesce(F.size("availabilities"), F.lit(0)) > 0
    branch_quantity = F.exists("availabilities", lambda a: a["quantity"].isNotNull())
    return quality_score(
        title=filled("title"), price=F.col("price") >= 0, url=filled("url"), brand=filled("brand"),
        identifier=filled("ean") | filled("mpn") | filled("sku"),
        category=F.size("category_path") > 0, image=filled("image_url"),
        stock=F.col("stock_status") != "UNKNOWN",
        quantity=F.col("quantity").isNotNull() | F.coalesce(branch_quantity, F.lit(False)),
        location=F.col("location_external_id").isNotNull() | F.coalesce(branches, F.lit(False)),
    )


def _votes(text: Column, category_rules) -> Column:
    """(hits, rank, slug) of the rule with most keyword hits; earlier rules win ties."""
    table = F.array(*[
        F.struct(F.lit(-i).alias("rank"), F.lit(slug).alias("slug"), F.array(*map(F.lit, words)).alias("words"))
        for i, (slug, words) in enumerate(category_rules)
    ])
    scored = F.transform(table, lambda r: F.struct(
        F.size(F.filter(r["words"], lambda w: F.contains(text, w))).alias("hits"), r["rank"], r["slug"]))
    return F.array_max(scored)


def map_category(path, title, is_breadcrumb, category_rules=rules.CATEGORY_RULES) -> Column:
    """Category slug and confidence from breadcrumb, title, or url path, in that order of trust."""
    breadcrumb = is_breadcrumb if isinstance(is_breadcrumb, Column) else F.lit(bool(is_breadcrumb))
    texts = F.struct(
        category_text(F.array_join(col(path), " ")).alias("path"),
        category_text(F.coalesce(col(title), F.lit(""))).alias("title"),
        category_text(F.try_element_at(col(path), F.lit(-1))).alias("leaf"), breadcrumb.alias("breadcrumb"))
    return let(texts, lambda t: let(
        F.struct(_votes(t["path"], category_rules).alias("path"), _votes(t["title"], category_rules).alias("title")),
        lambda votes: _decide(t, votes)))


def _decide(texts: Column, votes: Column) -> Column:
    by_path, by_title, breadcrumb = votes["path"], votes["title"], texts["breadcrumb"]

    def result(slug, confidence):
        return F.struct(slug.alias("slug"), F.round(confidence, 2).alias("confidence"))

    terminal = [
        F.when(texts["leaf"].isin(*leaves), result(F.lit(slug), F.lit(rules.TERMINAL_CONFIDENCE)))
        for slug, leaves in rules.TERMINAL_CATEGORIES.items()
    ]
    return F.coalesce(
        F.when(breadcrumb & (by_path["hits"] > 0),
               result(by_path["slug"], F.least(F.lit(0.99), F.lit(0.84) + F.lit(0.05) * by_path["hits"]))),
        F.when(by_title["hits"] > 0,
               result(by_title["slug"], F.least(F.lit(0.90), F.lit(0.62) + F.lit(0.07) * by_title["hits"]))),
        *[F.when(~breadcrumb, t) for t in terminal],
        F.when(~breadcrumb & (by_path["hits"] >= 2),
               result(by_path["slug"], F.least(F.lit(0.79), F.lit(0.62) + F.lit(0.07) * by_path["hits"]))),
        result(F.lit(None).cast("string"), F.lit(0.0)),
    )
