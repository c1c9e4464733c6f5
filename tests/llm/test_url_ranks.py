"""Ranks of hosts in the link graph go on until they stand."""

import pytest

from cairn.llm import url_filter


def test_ranks_reach_the_end_of_a_chain(spark):
    """A chain of 20 hosts that ends in a pair linked both ways, beyond 12 links from the seed."""
    e = [(f"h{i}", f"h{i + 1}") for i in range(20)] + [("h20", "h19")]
    edges = spark.createDataFrame([("allow", *x, 1) for x in e], "kind string, src string, dst string, w int")
    seeds = spark.createDataFrame([("allow", "h0", 1)], "kind string, host string, mass int")
    got = {r.host: r["rank"] for r in url_filter.propagate(edges, seeds, damping=0.5).collect()}
    want = {f"h{i}": 0.5 ** (i + 1) for i in range(19)}
    want["h19"] = 0.5 * want["h18"] / 0.75
    want["h20"] = 0.5 * want["h19"]
    assert got == pytest.approx(want, rel=1e-3)


def test_ranks_of_ties_take_few_plans(spark, monkeypatch):
    """Subdomains tied to their domain and some to one another's: the ranks are those of the linear equations, in few written tables."""
    ties = [(f"s{i}", "d") for i in range(12)] + [("d", "top"), ("t1", "top"), ("u", "s3"), ("v", "u"), ("x", "y"), ("z", "y")]
    e = sorted({(a, b) for a, b in ties} | {(b, a) for a, b in ties})
    rows, seeds = [("allow", *x, 1) for x in e], {"s1": 3.0, "t1": 1.0, "x": 4.0}
    tables, keep = [], url_filter.stored
    monkeypatch.setattr(url_filter, "stored", lambda df: tables.append(1) or keep(df))
    got = url_filter.propagate(spark.createDataFrame(rows, "kind string, src string, dst string, w int"), spark.createDataFrame([("allow", h, m) for h, m in seeds.items()], "kind string, host string, mass double"))
    out = {a: sum(x == a for x, _ in e) for a, _ in e}
    want = {h: seeds.get(h, 0) / 8 for h in out}
    for _ in range(400):
        want = {h: 0.15 * seeds.get(h, 0) / 8 + 0.85 * sum(want[a] / out[a] for a, b in e if b == h) for h in out}
    assert {r.host: r["rank"] for r in got.collect()} == pytest.approx(want, rel=1e-3)
    assert len(tables) <= 8
