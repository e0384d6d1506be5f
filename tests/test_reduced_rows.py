"""Work that must not grow with repeated rows: branches that say the same, endpoints named twice."""

from shelfspark.operators import upsert
from shelfspark.sources import feeds


def test_equal_branches_are_one_row_in_a_hash_table(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(upsert, "keep", lambda df: seen.append(df) or df, raising=False)
    kind = "store_id long, external_id string, seq long, name string, city string, address string, latitude double, longitude double, opening_hours string"
    rows = [(1, "a" if i % 2 else None, i, "n", "c", None, 45.0, None if i > 900 else 27.0, "new" if i == 501 else None) for i in range(1000)]
    branches = spark.createDataFrame(rows, kind)
    stored = spark.createDataFrame([], "location_id string, " + kind.replace("seq long, ", "") + ", active boolean")
    table, resolved = upsert.resolve_locations(stored, branches)
    got = {r.external_id: (r.latitude, r.longitude, r.opening_hours) for r in table.collect()}
    assert got == {"a": (45.0, 27.0, "new")}  # the branches without id find its place
    assert resolved.count() == 1000
    assert seen[0].count() == 5 and "SortAggregate" not in seen[0]._jdf.queryExecution().executedPlan().toString()


def test_endpoints_named_twice_are_followed(spark):
    docs = spark.createDataFrame([("https://s.md/a", '{"links": {"next": {"href": "?page=2"}}}'), ("https://s.md/a?page=2", '{"next": 3, "meta": {"next_url": " /b "}}'),
                                  ("https://s.md/b", '{"next": "", "paging": {"nextPage": "/a"}}')], "url STRING, body STRING")
    start = spark.createDataFrame([("https://s.md/a",)] * 2, "endpoint STRING")
    # A number is no address; the third page leads back to the first.
    chain = [(1, "https://s.md/a"), (2, "https://s.md/a?page=2"), (3, "https://s.md/b")]
    assert sorted((r.depth, r.url) for r in feeds.follow_pages(docs, start).collect()) == chain
    assert sorted((r.depth, r.url) for r in feeds.follow_pages(docs, start, max_pages=2).collect()) == chain[:2]
