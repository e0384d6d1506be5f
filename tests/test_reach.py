"""Reachability by doubling: chains, rings, joints and several sites against a walk in memory."""

import random

import pytest

from shelfspark.operators import links as l

SCHEMA = "site string, page_url string, url string, kind string"


def walk(rows, seeds):
    out = {}
    for site, start in seeds:
        out.setdefault(site, set()).add(start)
    moved = True
    while moved:
        moved = False
        for site, page, url, kind in rows:
            if kind == "listing" and page in out.get(site, ()) and url not in out[site]:
                out[site].add(url)
                moved = True
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_reachable_products_against_walking(spark, seed):
    rng = random.Random(seed)
    rows = []
    for site in ("a", "b", "c"):
        rows += [(site, f"p{rng.randrange(60)}", f"p{rng.randrange(60)}", "listing") for _ in range(50)]
        rows += [(site, f"x{i}", f"x{(i + 1) % 7}", "listing") for i in range(7)]  # a ring that nothing leads into
        rows += [(site, f"y{i}", f"y{i + 1}", "listing") for i in range(30)] + [(site, "p1", "y0", "listing"), (site, "y9", "y9", "listing")]
        rows += [(site, f"{k}{rng.randrange(30)}", f"i{n}", "product") for n in range(30) for k in "pxy"]
    seeds = [("a", "p0"), ("a", "p1"), ("b", "p2"), ("b", "y5"), ("d", "p0")]
    pages = walk(rows, seeds)
    products, summary = l.reachable_products(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(seeds, "site string, url string"))
    assert {tuple(r) for r in products.collect()} == {(s, u) for s, p, u, k in rows if k == "product" and p in pages.get(s, ())}
    assert {r.site: (r.pages_visited, r.cap_reached) for r in summary.collect()} == {s: (len(p), False) for s, p in pages.items()}


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    real = l.cut_lineage
    monkeypatch.setattr(l, "cut_lineage", lambda df: rounds.append(1) or real(df))
    rows = [("a", f"p{i}", f"p{i + 1}", "listing") for i in range(10_000)] + [("a", "p9999", "i", "product")]
    products, summary = l.reachable_products(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([("a", "p0")], "site string, url string"))
    assert [tuple(r) for r in products.collect()] == [("a", "i")] and summary.first().pages_visited == 10_001
    assert len(rounds) < 25
