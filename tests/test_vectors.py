"""Neighbours, near pairs, the vector index, means, identity claims and triangle clusters against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import graph as G
from cairn.operators import learn as L
from cairn.operators import vectors as V


# --- vectors


@pytest.fixture(scope="module")
def clustered(spark):
    """3,000 vectors in 40 narrow clusters, some copies, and rows that take no part."""
    rng = np.random.default_rng(4)
    centers = rng.standard_normal((40, 24))
    x = centers[rng.integers(40, size=3000)] + rng.standard_normal((3000, 24)) * rng.uniform(0.02, 0.3, (3000, 1))
    x[1::50] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9001, None), (9002, [1.0, None]), (9003, [float("nan")] * 24), (None, x[0].tolist()), (9004, [1.0, 2.0])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>"), x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest(x, queries, k, least):
    out = set()
    for q in queries:
        s = np.round(x @ x[q], 9)
        order = [j for j in np.lexsort((np.arange(len(x)), -s)) if j != q and s[j] >= least][:k]
        out |= {(q, int(j)) for j in order}
    return out


def test_neighbours_in_blocks_and_by_index(clustered):
    df, x = clustered
    q = df.where("vec_id % 50 = 0 or vec_id > 9000")
    queries = range(0, 3000, 50)
    want = nearest(x, queries, 10, 0.5)
    found = lambda rows: {(r.q, r.node) for r in rows.collect() if r.q < 9000}
    assert found(V.knn_blocks(df, q, 10, 0.5, queries_per_block=16, points_per_part=700)) == want
    index = V.VectorIndex.build(df, cells=48, sample=1500)
    assert sum(r["count"] for r in index.table().groupBy("cell").count().collect()) == 3000  # every row that takes part
    assert found(index.search(q, 10, 0.5)) == want
    probed = found(index.search(q, 10, 0.5, probes=6))
    assert probed <= {(a, b) for a in queries for b in range(3000)} and len(probed & want) >= 0.9 * len(want)
    # what the bound leaves out is not read
    asked = index.probed(V.whole(q, "vec_id", "embedding").withColumn("least", F.lit(0.9)), None)
    assert asked.count() < 0.5 * 60 * len(index.rings)


def test_no_query_travels_with_a_point(clustered):
    df, _ = clustered
    plan = V.knn_blocks(df, df.where("vec_id % 50 = 0"), 10, 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Join" not in plan


def test_what_queries_ask_for_is_not_broadcast(clustered):
    """A few rows for each cell are; files of queries that repeat are far smaller than what they hold."""
    df, _ = clustered
    index = V.VectorIndex.build(df, cells=16, sample=1500)
    q = V.whole(df.where("vec_id % 500 = 0"), "vec_id", "embedding").withColumn("least", F.lit(0.9))
    plan = index.met(q, 5, None, True)._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan


def test_pivots_prune_and_keep_all_pairs(clustered):
    df, x = clustered
    points = V.whole(df, "vec_id", "embedding").where(F.size("v") == 24)
    sims = np.triu(x @ x.T, 1)
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(sims >= 0.9), strict=True)}
    assert {(r.a, r.b) for r in V.pivot_pairs(points, 0.9, block=100).collect()} == want
    built = V.pivot_blocks(points, 0.9, block=100)
    n = built.blocks.count()
    assert n >= 30 and built.blocks.agg(F.max("n")).first()[0] <= 200 and built.placed.count() == 3000
    assert built.pairs.count() < 0.25 * n * (n + 1) / 2
    assert V.pivot_blocks(points.limit(0), 0.9) is None and V.pivot_pairs(points.limit(0), 0.9).count() == 0


def test_kmeans_seeds_in_few_rounds(clustered, spark):
    """Cost of about what sequential farthest points and the same rounds give, each point at its nearest centre, for many clusters."""
    df, x = clustered
    for k in (8, 200):
        got = {r.id: r.cluster for r in V.kmeans(df, k, 5).collect()}
        label = np.array([got[i] for i in range(3000)])
        mean = lambda own: np.array([x[own == c].mean(axis=0) if (own == c).any() else np.zeros(24) for c in range(k)])
        unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        start = V.farthest_first(x, k)
        for _ in range(5):
            own = (x @ start.T).argmax(axis=1)
            start = unit(mean(own))
        cost = lambda centers, own: (1 - (x * centers[own]).sum(axis=1)).sum()
        assert cost(unit(mean(label)), label) <= 1.3 * cost(start, (x @ start.T).argmax(axis=1))
    assert V.kmeans(df.limit(0), 3).count() == 0 and V.kmeans(df.where("vec_id = 9001"), 3).count() == 0


def test_merged_means(spark):
    rows = [(k, [float(k + i), float(i * i)]) for k in range(3) for i in range(10)]
    df = spark.createDataFrame(rows, "g int, embedding array<double>")
    once = L.centroids(df, "g")
    part = F.col("embedding")[1] < 20
    again = L.merged_means(L.centroids(df.where(part), "g"), L.centroids(df.where(~part), "g"), "g")
    plain = lambda d: sorted((r.g, r["size"], [round(x, 6) for x in r.centroid]) for r in d.collect())
    assert plain(once) == plain(again)


def test_conflicts(spark):
    nodes = spark.createDataFrame([(1, "must", [1.0, 0.0]), (2, "must_not", [1.0, 0.1]), (3, "should", [1.0, 0.0]), (4, "should_not", [0.0, 1.0]), (5, "must", None), (6, None, [1.0, 0.0])], "id long, kind string, embedding array<double>")
    got = lambda links, **k: [(r.a, r.b) for r in L.conflicts(nodes, spark.createDataFrame(links, "a long, b long"), 0.9, **k).orderBy("a", "b").collect()]
    assert got([]) == [(1, 2), (2, 3)] and got([(2, 1)]) == [(2, 3)] and got([(9, 9)], most=1) == [(1, 2)]


# --- identity


def claimed_in_order(old, new, least, least_cosine):
    taken, out = set(), {}
    for n, (members, centroid) in sorted(new.items()):
        free = [o for o in sorted(old) if o not in taken]
        jaccard = {o: len(members & old[o][0]) / len(members | old[o][0]) for o in free if members & old[o][0]}
        cosine = {o: float(np.dot(centroid, old[o][1]) / np.linalg.norm(centroid) / np.linalg.norm(old[o][1])) for o in free}
        best = [(-v, o) for o, v in jaccard.items() if v >= least] or [(-round(v, 9), o) for o, v in cosine.items() if v >= least_cosine]
        if best:
            out[n] = min(best)[1]
            taken.add(out[n])
    return out


@pytest.mark.parametrize("seed", range(4))
def test_identity_claims_equal_the_ordered_ones(spark, seed):
    rng = np.random.default_rng(seed)
    make = lambda n: {int(i): ({int(m) for m in rng.choice(40, rng.integers(1, 9))}, rng.standard_normal(3).tolist()) for i in range(n)}
    old, new = make(25), make(35)
    frame = lambda d: spark.createDataFrame([(i, sorted(m), c) for i, (m, c) in d.items()], "cluster long, members array<long>, centroid array<double>")
    got = {r.new: r.old for r in L.identity_matches(frame(old), frame(new), 0.15, 0.8).collect()}
    assert got == claimed_in_order(old, new, 0.15, 0.8) and len(got) > 15
    assert L.identity_matches(frame(old).limit(0), frame(new), 0.15, 0.8).count() == 0


def test_centroids_are_searched_a_few_at_a_time(spark, monkeypatch):
    """All centroids are near: pairs of all clusters are not looked at, but two old ones at a time of those that none holds earlier."""
    rng = np.random.default_rng(9)
    old = {i: ({i}, (1 + 0.01 * rng.standard_normal(3)).tolist()) for i in range(12)}
    new = {i: ({i if i % 2 else 100 + i}, (1 + 0.01 * rng.standard_normal(3)).tolist()) for i in range(12)}
    frame = lambda d: spark.createDataFrame([(i, sorted(m), c) for i, (m, c) in d.items()], "cluster long, members array<long>, centroid array<double>")
    monkeypatch.setattr(L, "cross_pairs", None)
    got = {r.new: r.old for r in L.identity_matches(frame(old), frame(new), 0.5, 0.9, k=2).collect()}
    assert got == claimed_in_order(old, new, 0.5, 0.9) and len(got) == 12


# --- triangles


def clusters_in_order(triangles):
    sets = [set(t) for t in triangles]
    merged = True
    while merged:
        merged = False
        for i in range(len(sets)):
            for j in range(i + 1, len(sets)):
                if len(sets[i] & sets[j]) >= 2:
                    sets[i] |= sets.pop(j)
                    merged = True
                    break
            if merged:
                break
    return sorted(map(sorted, sets))


@pytest.mark.parametrize("edges", [[(1, 2), (2, 3), (1, 3), (3, 4), (4, 5), (3, 5)], [(1, 2), (2, 3), (1, 3), (2, 4), (3, 4)], None, "strips"])
def test_triangle_clusters(spark, edges):
    if edges is None:  # a hub whose triangles share it alone, and random edges
        rng = np.random.default_rng(6)
        edges = [(0, x) for x in range(1, 41)] + [(x, x + 1) for x in range(1, 41, 2)] + [(int(a), int(b)) for a, b in rng.integers(50, 90, (110, 2)) if a != b]
    elif edges == "strips":  # two strips of triangles that share their ends, and no edge
        strip = lambda nodes: [e for i in range(len(nodes) - 2) for e in ((nodes[i], nodes[i + 1]), (nodes[i], nodes[i + 2]), (nodes[i + 1], nodes[i + 2]))]
        edges = strip([1, 2, 3, 4, 5, 6]) + strip([1, 12, 13, 14, 15, 6])
    df = spark.createDataFrame([(a, b, "R") for a, b in edges], "src long, dst long, rel_type string")
    rows = G.triangle_clusters(df).collect()
    by = {}
    for r in rows:
        by.setdefault(r.cluster, set()).update((r.a, r.b, r.c))
    assert sorted(map(sorted, by.values())) == clusters_in_order([(r.a, r.b, r.c) for r in rows]) and rows


# --- what travels grows with points and blocks, not with near pairs


def test_density_links_keep_no_square(spark):
    """Copies are near one another, all pairs of them: counts and a few links are kept."""
    rng = np.random.default_rng(4)
    x = np.concatenate([np.repeat(rng.standard_normal((1, 16)), 400, axis=0), rng.standard_normal((60, 16))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    near = (x @ x.T >= 0.5) & ~np.eye(len(x), dtype=bool)
    core = set(np.flatnonzero(near.sum(axis=1) >= 3).tolist())
    for block in (64, 4096):
        found, links = V.density_links(points, 0.5, 3, block)
        assert {r.id for r in found.collect()} == core
        rows = links.collect()
        assert len(rows) < 10 * len(x) and {(r.a, r.b) for r in rows if r.border} == {(a, b) for a in range(len(x)) if a not in core for b in core if near[a, b]}
        assert all(near[:, r.a].any() and {r.a, r.b} <= core for r in rows if not r.border)
    got = {r.id: r.cluster for r in L.dbscan_near(points, 0.5, 3, "id", "v").collect()}
    pairs = spark.createDataFrame([(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(near)), strict=True)], "a long, b long")
    assert got == {r.id: r.cluster for r in L.dbscan(points, pairs, 3, "id").collect()}


def test_consolidation_keeps_no_near_pairs_to_cluster(spark, monkeypatch):
    from cairn.plans import consolidate

    monkeypatch.setattr(L, "near_pairs", None)
    nodes = spark.createDataFrame([(i, 0, [1.0, i % 2 * 1.0]) for i in range(8)], "node_id long, layer int, embedding array<float>")
    out = consolidate.hidden(consolidate.Space(nodes, nodes, "2003-01-01", 0.9))
    assert {r.node_id: r.cluster for r in out.clusters.collect()} == {i: i % 2 for i in range(8)}


def test_pairs_of_one_kind(clustered):
    df, x = clustered
    points = V.whole(df, "vec_id", "embedding").where(F.size("v") == 24).withColumn("kind", F.col("id") % 3)
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(x @ x.T, 1) >= 0.9), strict=True) if a % 3 == b % 3}
    assert {(r.a, r.b) for r in V.pivot_pairs(points, 0.9, block=100, same="kind").collect()} == want


def test_vectors_travel_to_groups_of_pairs(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((90, 8))
    x[7] = 0
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    pairs = [(int(a), int(b), float(w)) for a, b, w in zip(*rng.integers(0, 100, (2, 600)), rng.integers(0, 4, 600), strict=True)] + [(k, 5, 1.0) for k in range(90)]
    df = spark.createDataFrame(pairs, "a long, b long, weight double")
    norm = np.maximum(np.linalg.norm(x, axis=1), 1e-300)
    rows = V.pair_cosines(df, points)
    assert "Join" not in rows._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.a, r.b, round(r.sim, 9)) for r in rows.collect())
    assert got == sorted((a, b, round(float(x[a] @ x[b] / norm[a] / norm[b]), 9)) for a, b, _ in pairs if a < 90 and b < 90 and 7 not in (a, b))
    means = V.sent_means(df.toDF("src", "dst", "weight"), points)
    got = {r.dst: np.array(r["mean"]) for r in means.collect()}
    sums = {}
    for a, b, w in pairs:
        if a < 90 and b < 90 and w > 0:
            total, v = sums.get(b, (0.0, 0))
            sums[b] = total + w, v + w * x[a]
    assert got.keys() == sums.keys() and all(np.allclose(got[b], v / w) for b, (w, v) in sums.items())
    dealt, _ = V.dealt_pairs(df, points, "a", "b", per_group=40)  # several groups
    assert dealt.where("side = 2").count() == sum(a < 90 and b < 90 for a, b, _ in pairs) and dealt.select("ga", "gb").distinct().count() > 30
