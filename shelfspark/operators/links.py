"""Links of listing pages, reachability, site profiles, robots rules and acquisition plans."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote
from urllib.robotparser import RobotFileParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark import rules
from shelfspark.functions.html import html_text, parse_anchors
from shelfspark.functions.text import any_of, clean_url, col, resolve_url, same_origin, url_part
from shelfspark.operators.grouping import top_per_group
from shelfspark.rule_tables import ApiRules, LinkRules
from shelfspark.session import cut_lineage

LINKS, APIS = LinkRules(), ApiRules()


def is_product_path(path: Column, links: LinkRules = LINKS) -> Column:
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    detail = path.endswith("-detail") | ((F.size(parts) >= 4) & F.coalesce(F.try_element_at(parts, F.lit(-1)).contains("detail"), F.lit(False)))
    return any_of(path, links.product_paths) | (path.contains("/katalog/") & detail)


def skip_href(href: Column, links: LinkRules = LINKS) -> Column:
    text = F.lower(href)
    return text.rlike("^(?:#|mailto:|tel:|javascript:)") | text.contains("novosti") | any_of(text, links.skipped)


def is_catalog_entry(url: Column, text: Column, links: LinkRules = LINKS) -> Column:
    path = F.regexp_replace(F.lower(url_part(url, "path")), "/+$", "")
    by_path = F.lit(False)
    for token in links.entry_paths:
        by_path = by_path | path.endswith(token) | path.contains(f"{token}/")
    return ~any_of(path, links.news) & (any_of(F.lower(text), links.entry_texts) | by_path)


_OTHER_PAGES = ("/ru/article/", "/ro/article/", "/ru/page/", "/ro/page/", "/ru/articles/", "/ro/articles/", "/ru/brand/", "/ro/brand/")
_OTHER_TOKENS = ("/cart", "/checkout", "/compare", "/favorites", "/login", "/search")


def _kind(store_rule: Column, href: Column, url: Column, a: Column, links: LinkRules) -> Column:
    path = url_part(url, "path")
    lower = F.lower(path)
    generic = (
        F.when(skip_href(href, links), "skip").when(is_product_path(lower, links) | a["card"] | a["near_price"], "product")
        .when(any_of(lower, links.listing_paths) | any_of(F.lower(a["text"]), links.listing_texts), "listing").otherwise("skip"))
    depth = F.size(F.filter(F.split(path, "/"), lambda s: s != ""))
    shelf = (F.when(~path.contains("/ru/catalogue/"), "skip")
             .when((depth >= 5) & (F.length(a["text"]) >= 4) & a["shelf_price"], "product").otherwise("listing"))
    numeric = (F.when(path.rlike(r"^/(?:ru|ro)/\d+/?$"), "product").when(~path.rlike("^/(?:ru|ro)/"), "skip")
               .when(path.rlike("^(?:" + "|".join(_OTHER_PAGES) + ")") | any_of(path, _OTHER_TOKENS), "skip").otherwise("listing"))
    leaf = F.when(href.endswith(".html"), "product").otherwise("skip")
    simple = F.when(any_of(href, ("/product/", "/products/", "/produs/", "/catalog/")) | a["in_card"], "product").otherwise("skip")
    return (F.when(store_rule == "cactus", shelf).when(store_rule == "maximum", numeric).when(store_rule == "darwin", leaf)
            .when(store_rule == "html-generic", simple).otherwise(generic))


def extract_links(pages: DataFrame, keys: Sequence[str], url: str = "url", html: str = "html", store_rule: Column | None = None,
                  links: LinkRules = LINKS) -> DataFrame:
    """One row per anchor: absolute url, kind (product, listing, skip), catalogue-entry flag.

    ``store_rule`` chooses a store's own link rule; null means the generic one, which takes its
    tokens from ``links``.
    """
    rule = F.lit("") if store_rule is None else F.coalesce(store_rule, F.lit(""))
    rows = pages.select(*keys, F.col(url).alias("page_url"), rule.alias("_rule"), F.posexplode(parse_anchors(F.col(html))).alias("pos", "a"))
    rows = rows.withColumn("_abs", resolve_url("page_url", F.col("a.href"))).filter(F.col("_abs").isNotNull())
    no_query = F.regexp_replace("_abs", r"[?#].*$", "")
    target = F.when(F.col("_rule").isin("cactus", "maximum"), no_query).when(F.col("_rule").isin("darwin", "html-generic"), F.col("_abs")).otherwise(clean_url("_abs"))
    rows = rows.withColumn("url", target)
    inside = same_origin("url", "page_url")
    empty = F.col("a.href") == ""
    kind = F.when(empty | ~inside, "skip").otherwise(_kind(F.col("_rule"), F.col("a.href"), F.col("url"), F.col("a"), links))
    entry = ~empty & ~F.lower("a.href").rlike("^(?:#|mailto:|tel:|javascript:)") & same_origin("_abs", "page_url") & is_catalog_entry(F.col("_abs"), F.col("a.text"), links)
    return rows.select(*keys, "page_url", "pos", F.col("a.href").alias("href"), "url", F.col("a.text").alias("text"),
                       kind.alias("kind"), F.coalesce(entry, F.lit(False)).alias("catalog_entry"))


def reachable_products(links: DataFrame, seeds: DataFrame, max_pages: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(site, product url) reachable over listing links, and (site, pages_visited, cap_reached).

    ``links`` holds (site, page_url, url, kind); ``seeds`` holds (site, url).  With ``max_pages``
    a site stops at so many listing pages, taken in (depth, url) order, and says so; all sites
    advance one depth per round.  Without it every page is visited, and a chain of n pages takes
    about log2(n) rounds.
    """
    listing = links.filter("kind = 'listing'").select("site", "page_url", "url").distinct()
    if max_pages is None:
        pages = _reached(listing, seeds.select("site", "url").distinct())
        return _products_of(links, pages), pages.groupBy("site").agg(F.count("*").alias("pages_visited")).withColumn("cap_reached", F.lit(False))
    frontier = cut_lineage(seeds.select("site", "url").distinct())
    visited, capped, depth = None, None, 0
    while not frontier.isEmpty():
        taken, over = _within_budget(frontier, visited, max_pages)
        capped = over if capped is None else capped.union(over)
        taken = taken.select("site", "url", F.lit(depth).alias("depth"))
        visited = cut_lineage(taken if visited is None else visited.unionByName(taken))
        # The pages of this round, read from the stored table rather than computed again.
        now = visited.filter(F.col("depth") == depth).select("site", F.col("url").alias("page_url"))
        frontier = cut_lineage(listing.join(now, ["site", "page_url"]).select("site", "url").distinct()
                               .join(visited.select("site", "url"), ["site", "url"], "left_anti"))
        depth += 1
    if visited is None:
        visited = frontier.withColumn("depth", F.lit(0))
    summary = visited.groupBy("site").agg(F.count("*").alias("pages_visited"))
    products = _products_of(links, visited)
    if capped is None:
        return products, summary.withColumn("cap_reached", F.lit(False))
    return products, summary.join(capped.distinct().withColumn("cap_reached", F.lit(True)), "site", "left").withColumn(
        "cap_reached", F.coalesce("cap_reached", F.lit(False)))


def _products_of(links: DataFrame, pages: DataFrame) -> DataFrame:
    pages = pages.select("site", F.col("url").alias("page_url"))
    return (links.filter("kind = 'product'").select("site", "page_url", "url").join(pages, ["site", "page_url"], "left_semi")
            .select("site", "url").distinct())


def _reached(listing: DataFrame, seeds: DataFrame) -> DataFrame:
    """(site, url) of all pages that listing links lead to from the seeds, seeds included.

    A page that one page alone links to is reached exactly when that page is.  Such pages are
    hung on the first page above them of another kind by doubling their pointers; the frontier
    then walks over the others only, from one joint of the graph to the next.
    """
    parents = listing.filter("page_url <> url").groupBy("site", "url").agg(F.count("*").alias("n"), F.min("page_url").alias("up"))
    chain = cut_lineage(parents.filter("n = 1").join(seeds, ["site", "url"], "left_anti").select("site", "url", "up"))
    length, steps = chain.count(), 1
    while steps <= 2 * length:  # a ring of such pages has no top; nothing leads into it
        above = chain.select("site", F.col("url").alias("up"), F.col("up").alias("_next"))
        moved = cut_lineage(chain.join(above, ["site", "up"], "left").select(
            "site", "url", F.coalesce("_next", "up").alias("up"), F.col("_next").isNotNull().alias("_moved")))
        chain, steps = moved.select("site", "url", "up"), 2 * steps
        if moved.filter("_moved").isEmpty():
            break
    tops = chain.select("site", F.col("url").alias("page_url"), F.col("up").alias("_top"))
    joints = cut_lineage(listing.join(chain.select("site", "url"), ["site", "url"], "left_anti").join(tops, ["site", "page_url"], "left")
                         .select("site", F.coalesce("_top", "page_url").alias("page_url"), "url").distinct())
    frontier = visited = cut_lineage(seeds)
    while not frontier.isEmpty():
        now = frontier.select("site", F.col("url").alias("page_url"))
        frontier = cut_lineage(joints.join(now, ["site", "page_url"]).select("site", "url").distinct().join(visited, ["site", "url"], "left_anti"))
        visited = cut_lineage(visited.unionByName(frontier))
    hung = chain.join(visited.select("site", F.col("url").alias("up")), ["site", "up"], "left_semi").select("site", "url")
    return visited.unionByName(hung)


def _within_budget(frontier: DataFrame, visited: DataFrame | None, max_pages: int) -> tuple[DataFrame, DataFrame]:
    """(pages that still fit, sites that had more)."""
    room = F.lit(max_pages)
    if visited is not None:
        frontier = frontier.join(visited.groupBy("site").agg(F.count("*").alias("_used")), "site", "left")
        room = room - F.coalesce("_used", F.lit(0))
    ranked = top_per_group(frontier.withColumn("_room", room), ["site"], [F.col("url")], max_pages + 1, rank="_rank")
    step = cut_lineage(ranked.select("site", "url", (F.col("_rank") <= F.col("_room")).alias("_in")))
    return step.filter("_in").select("site", "url"), step.filter("not _in").select("site").distinct()


def initial_listing_urls(seeds: DataFrame, links: LinkRules = LINKS) -> DataFrame:
    """Start pages per site (site, base_url, seed): same host, no product pages, home page included."""
    named = seeds.select("site", "base_url", resolve_url("base_url", F.coalesce("seed", F.col("base_url"))).alias("u"))
    both = named.unionByName(seeds.select("site", "base_url", F.col("base_url").alias("u")))
    cleaned = both.withColumn("url", clean_url("u")).filter(same_origin("url", "base_url") & ~is_product_path(F.lower(url_part("url", "path")), links))
    return cleaned.select("site", "url").distinct()


def api_candidates(pages: DataFrame, keys: Sequence[str], url: str = "url", text: str = "html", apis: ApiRules = APIS) -> DataFrame:
    """Distinct same-origin endpoint addresses named in page or script text."""
    lists = [F.regexp_extract_all(text, F.lit("(?i)" + p), F.lit(1)) for p in apis.patterns]
    found = F.transform(F.flatten(F.array(*lists)), lambda m: F.struct(m.alias("m"), F.lit(False).alias("f")))
    fetches = F.array(*[F.regexp_extract_all(text, F.lit("(?i)" + p), F.lit(1)) for p in apis.fetches])
    fetched = F.transform(F.flatten(fetches), lambda m: F.struct(m.alias("m"), F.lit(True).alias("f")))
    rows = pages.select(*keys, F.col(url).alias("page_url"), F.explode(F.array_distinct(F.concat(found, fetched))).alias("c"))
    rows = rows.withColumn("api_url", resolve_url("page_url", F.col("c.m")))
    lower = F.lower("api_url")
    looks = lower.contains("/api/") | lower.contains("/graphql") | F.substring_index(lower, "?", 1).endswith(".json")
    templated = F.col("api_url").rlike(r"[{}]")
    keep = same_origin("api_url", "page_url") & F.when(F.col("c.f"), looks).otherwise(~templated)
    return rows.filter(keep).select(*keys, "api_url").distinct()


_TAG_LINK = r"""(?is)<(?:a|link|script)\b[^>]*?\b(?:href|src)\s*=\s*["']([^"']+)["']"""


def page_flags(html="html") -> dict[str, Column]:
    """Page-level hints as column expressions."""
    text = col(html)
    product = r"""(?is)<script\b[^>]*application/ld\+json[^>]*>(?:(?!</script>).)*?["']Product["']"""
    embedded = r"""(?s)<script\b[^>]*\bid\s*=\s*["']?__NEXT_DATA__|<script\b[^>]*\btype\s*=\s*["']?application/json["'\s>]|window\.__[A-Z0-9_]+__\s*="""
    card = r"""(?s)<[^>]+\bitemtype\s*=\s*["'][^"']*schema\.org/Product|<[^>]+\bdata-product-id\b|<[^>]+\bclass\s*=\s*["'](?:[^"']*\s)?(?:product-card|product-item|product)(?:\s[^"']*)?["']"""
    return {"product_jsonld": text.rlike(product), "embedded_json": text.rlike(embedded), "html_product_hints": text.rlike(card)}


def _rank_list(rows: DataFrame, value: str, order: list[Column], name: str, limit: int | None) -> DataFrame:
    best = rows.select("site", value).distinct()
    if limit is not None:
        best = top_per_group(best, ["site"], order, limit)
    packed = F.sort_array(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col(value).alias("v"))))
    return best.groupBy("site").agg(F.transform(packed, lambda s: s["v"]).alias(name))


def source_profile(pages: DataFrame, site: Column, limit: int | None = None, context_table=rules.CONTEXT_PATTERNS,
                   links: LinkRules = LINKS, apis: ApiRules = APIS) -> DataFrame:
    """Per site: page hints, context hints, and the best catalogue, feed and API addresses."""
    rows = pages.select(site.alias("site"), "url", "html")
    flags = page_flags()
    contexts = [F.when(F.lower(html_text("html")).rlike("(?iU)" + p), F.lit(n)) for n, p in context_table]
    seen = rows.select("site", *[v.alias(k) for k, v in flags.items()], F.filter(F.array(*contexts), lambda x: x.isNotNull()).alias("ctx"))
    labels = [n for n, _ in context_table]
    base = seen.groupBy("site").agg(
        F.count("*").alias("pages"), *[F.bool_or(k).alias(k) for k in flags],
        *[F.bool_or(F.array_contains("ctx", n)).alias(f"_c{i}") for i, n in enumerate(labels)])
    hints = F.filter(F.array(*[F.when(F.col(f"_c{i}"), n) for i, n in enumerate(labels)]), lambda x: x.isNotNull())
    base = base.withColumn("context_hints", hints).drop(*[f"_c{i}" for i in range(len(labels))])

    path = F.regexp_replace(url_part("url", "path"), "/+$", "")
    depth = F.length(F.regexp_replace(path, "[^/]", ""))
    entries = extract_links(rows, ["site"], links=links).filter("catalog_entry").select("site", resolve_url("page_url", "href").alias("url"))
    catalogs = _rank_list(entries, "url", [depth, F.length(url_part("url", "path")), F.col("url")], "catalog_urls", limit)

    tags = rows.select("site", F.col("url").alias("page_url"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(_TAG_LINK), F.lit(1)))).alias("ref"))
    tags = tags.withColumn("link", resolve_url("page_url", "ref")).filter(F.col("link").isNotNull())
    plain = F.lower(F.substring_index("link", "?", 1))
    is_feed = plain.rlike("(?:" + "|".join(e.replace(".", r"\.") for e in apis.feed_endings) + ")$")
    feeds = _rank_list(tags.filter(is_feed), "link", [F.col("link")], "feed_urls", limit)
    from_tags = tags.filter((plain.contains("/api/") | plain.contains("/graphql")) & same_origin("link", "page_url")).select("site", F.col("link").alias("api_url"))
    endpoints = _rank_list(api_candidates(rows, ["site"], apis=apis).unionByName(from_tags), "api_url", [F.col("api_url")], "api_urls", limit)
    nothing = F.array().cast("array<string>")
    out = base.join(catalogs, "site", "left").join(feeds, "site", "left").join(endpoints, "site", "left")
    return out.withColumns({n: F.coalesce(n, nothing) for n in ("catalog_urls", "feed_urls", "api_urls")})


# -- robots ---------------------------------------------------------------------

_RULES = pa.list_(pa.struct([("entry", pa.int32()), ("agent", pa.string()), ("seq", pa.int32()), ("allow", pa.bool_()), ("path", pa.string())]))


def _robots_rules(text):
    parser = RobotFileParser()
    parser.parse(text.splitlines())
    groups = [(i, e) for i, e in enumerate(parser.entries)]
    if parser.default_entry is not None:
        groups.append((len(parser.entries), parser.default_entry))
    out = []
    for i, group in groups:
        for agent in group.useragents:
            out.append({"entry": i, "agent": agent.lower(), "seq": -1, "allow": True, "path": None})
            out += [{"entry": i, "agent": agent.lower(), "seq": n, "allow": rule.allowance, "path": unquote(rule.path)} for n, rule in enumerate(group.rulelines)]
    return out


@F.arrow_udf(T.ArrayType(T.StructType([
    T.StructField("entry", T.IntegerType()), T.StructField("agent", T.StringType()), T.StructField("seq", T.IntegerType()),
    T.StructField("allow", T.BooleanType()), T.StructField("path", T.StringType())])))
def parse_robots(bodies: pa.Array) -> pa.Array:
    return pa.array([None if b is None else _robots_rules(b) for b in bodies.to_pylist()], type=_RULES)


def robots_rules(robots: DataFrame, agent: str) -> DataFrame:
    """(site, seq, allow, path) of the group that applies to an agent: the first naming it, else '*'."""
    name = agent.split("/")[0].lower()
    rows = robots.select("site", F.explode(parse_robots("body")).alias("r")).select("site", "r.*")
    named = (F.col("agent") != "*") & F.lit(name).contains(F.col("agent"))
    mine = rows.filter(named | (F.col("agent") == "*")).withColumn("_rank", F.struct((~named).alias("other"), F.col("entry").alias("entry")))
    best = mine.groupBy("site").agg(F.min("_rank").alias("_best"))
    return mine.join(best, "site").filter(F.col("_rank") == F.col("_best")).filter(F.col("seq") >= 0).select("site", "seq", "allow", "path")


def robots_allowed(urls: DataFrame, robots: DataFrame, agent: str = "OfferBot") -> DataFrame:
    """``allowed`` per (site, url).

    ``robots`` holds (site, origin, status, body) with status AVAILABLE, MISSING
    or UNAVAILABLE.  Only same-origin http(s) urls can be allowed; a missing file
    allows, an unavailable one refuses, else the first matching rule decides.
    """
    # A site's rule list is one robots file, so it is packed into one short sorted array.
    rules_of = robots_rules(robots, agent).groupBy("site").agg(F.sort_array(F.collect_list(F.struct("seq", "allow", "path"))).alias("_rules"))
    policy = robots.select("site", "origin", "status").join(rules_of, "site", "left")
    rows = urls.join(policy, "site", "left")
    query = url_part("url", "query")
    raw = F.concat(F.coalesce(F.nullif(url_part("url", "path"), F.lit("")), F.lit("/")), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    # Both sides are compared unescaped, so %20 and non-ASCII letters meet whichever way they are written.
    path = F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)
    hit = F.try_element_at(F.filter("_rules", lambda r: (r["path"] == "*") | F.startswith(path, r["path"])), F.lit(1))
    inside = url_part("url", "scheme").isin("http", "https") & same_origin("url", "origin")
    by_rule = F.coalesce(hit["allow"], F.lit(True))
    allowed = F.coalesce(inside, F.lit(False)) & F.coalesce(
        (F.col("status") == "MISSING") | ((F.col("status") == "AVAILABLE") & by_rule), F.lit(False))
    return rows.withColumn("allowed", allowed).drop("_rules", "origin", "status")


def acquisition_plan(profiles: DataFrame) -> DataFrame:
    """Strategy rows per site in strict priority order; ``choice`` marks the first."""
    size = lambda name: F.coalesce(F.size(name), F.lit(0))
    n_text = lambda name, tail: F.concat(size(name).cast("string"), F.lit(tail))
    step = lambda name, priority, reason: F.struct(F.lit(priority).alias("priority"), F.lit(name).alias("connector"), reason.alias("reason"))
    structured = F.coalesce((size("sitemap_urls") > 0) | F.col("product_jsonld") | F.col("embedded_json"), F.lit(False))
    steps = F.array(
        F.when(size("api_urls") > 0, step("json-api", 10, n_text("api_urls", " public API/JSON endpoint hint(s) detected"))),
        F.when(size("feed_urls") > 0, step("catalog-feed", 20, n_text("feed_urls", " public JSON/XML/CSV/YML feed(s) detected"))),
        *[F.when(F.col("store_slug") == slug, step(name, 25, F.lit(reason))) for slug, name, reason in rules.STORE_STRATEGIES],
        F.when(structured, step("sitemap-jsonld", 30, F.lit("sitemap/JSON-LD/embedded structured data detected"))),
        step("catalog-generic", 34, F.concat(F.lit("generic same-origin catalog/category discovery; "), n_text("catalog_urls", " official catalog seed(s)"))),
        step("html-generic", 40, F.lit("generic HTTP/HTML product-page parser fallback")),
        step("browser-rendered", 50, F.lit("last-resort JavaScript-rendered storefront fallback")))
    present = F.filter(steps, lambda s: s.isNotNull())
    return profiles.select("store_slug", F.posexplode(present).alias("pos", "s")).select(
        "store_slug", "s.priority", "s.connector", "s.reason", (F.col("pos") == 0).alias("choice"))
