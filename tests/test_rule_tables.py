"""Rule tables passed in: each kind changes what it governs, and only that; oversized or unknown tables are refused."""

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import extract
from shelfspark.operators import links as l
from shelfspark.rule_tables import ApiRules, ImageRules, LinkRules, context_rules

PAGE = ('<html><body><a href="/ware/1">One</a><a href="/regal/a">Regal</a><a href="/product/2">Two</a><a href="/cart">Cart</a>'
        '<a href="/hub">Everything</a><script>load("/svc/items"); fetch("/api/x.json"); grab("/data/y.json")</script>'
        '<link href="/feed.rss"> pick up in store </body></html>')


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(1, "https://s.example/", PAGE)], "id long, url string, html string")


def table(spark, rows):
    return spark.createDataFrame(rows, "kind string, value string")


def kinds(pages, **more):
    return {r.href: (r.kind, r.catalog_entry) for r in l.extract_links(pages, ["id"], **more).collect()}


@pytest.mark.parametrize("kind, value, href, want", [
    ("product_paths", "/ware/", "/ware/1", ("product", False)), ("listing_paths", "/regal", "/regal/a", ("listing", False)),
    ("listing_texts", "everything", "/hub", ("listing", False)), ("entry_paths", "/hub", "/hub", ("skip", True)),
    ("entry_texts", "regal", "/regal/a", ("skip", True)), ("skipped", "/product/", "/product/2", ("skip", False))])
def test_link_rules(spark, pages, kind, value, href, want):
    before, after = kinds(pages), kinds(pages, links=LinkRules.from_table(table(spark, [(kind, value)])))
    assert after[href] == want and before[href] != want
    news = LinkRules.from_table(table(spark, [("entry_paths", "/hub"), ("news", "/hub")]))
    assert kinds(pages, links=news)["/hub"][1] is False


def test_api_rules(spark, pages):
    def found(**more):
        return {r.api_url for r in l.api_candidates(pages, ["id"], **more).collect()}

    given = ApiRules.from_table(table(spark, [("patterns", '"(/svc/[^"]+)'), ("fetches", r'grab\("([^"]+)"')]))
    assert "https://s.example/api/x.json" in found()
    assert found(apis=given) == {"https://s.example/svc/items", "https://s.example/data/y.json"}


def test_profile_takes_context_and_feed_tables(spark, pages):
    contexts = context_rules(spark.createDataFrame([("pickup", "pick up in store")], "name string, pattern string"))
    row = l.source_profile(pages, F.lit("s"), context_table=contexts, apis=ApiRules(feed_endings=(".rss",))).first()
    assert row.context_hints == ["pickup"] and row.feed_urls == ["https://s.example/feed.rss"]


def test_image_rules(spark):
    images = spark.createDataFrame([([("/a-draft.png", False), ("/b.png", False)],)], "images array<struct<url: string, social: boolean>>")

    def picked(rules):
        return images.select(extract.pick_image(F.col("images"), rules)).first()[0]

    assert picked(ImageRules()) == "/a-draft.png"
    assert picked(ImageRules.from_table(table(spark, [("rejected", "draft")]))) == "/b.png"


def test_bad_tables_are_refused(spark):
    with pytest.raises(ValueError, match="at most"):
        LinkRules.from_table(table(spark, [("news", str(i)) for i in range(30)]), most=20)
    with pytest.raises(ValueError, match="unknown"):
        LinkRules.from_table(table(spark, [("nothing", "x")]))
    assert LinkRules.from_table(table(spark, [])) == LinkRules()
