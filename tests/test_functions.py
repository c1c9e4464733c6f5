"""Known values of the scalar expressions and small cases of the operators."""

import pytest
from pyspark.sql import functions as F

from cairn.functions import rewards as RW
from cairn.functions import scalars as S
from cairn.operators import curate, graph, learn, metrics, rank
from cairn.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("w", "a", "b", "out"), [(0.5, 0.8, 0.6, 0.4657271175), (0.0, 0.5, 0.5, 0.0049999583), (0.3, 1.0, 1.0, 0.3067917919), (0.5, 0.0, 0.0, 0.4581758447)])
def test_hebbian(spark, w, a, b, out):
    assert one(spark, S.hebbian(F.lit(w), F.lit(a), F.lit(b))) == pytest.approx(out, abs=1e-9)


def test_hebbian_floor(spark):
    assert one(spark, S.hebbian(F.lit(0.01), F.lit(1.0), F.lit(1.0), 0.0, 0.5, 0.05)) == pytest.approx(0.05)


@pytest.mark.parametrize(("n", "out"), [(0, 2.0), (100, 1.0), (9999, 1.0), (10000, 0.5), (49999, 0.5), (50000, 0.25)])
def test_phase(spark, n, out):
    assert one(spark, S.phase_multiplier(F.lit(n))) == out


@pytest.mark.parametrize(("s", "out"), [(0, 1.0), (300, 0.925), (1800, 0.55), (3600, 0.1), (7200, 0.1)])
def test_proximity(spark, s, out):
    assert one(spark, S.session_proximity(F.lit(s))) == pytest.approx(out)


@pytest.mark.parametrize(("h", "out"), [(0, 1.0), (1, 1.0), (2, 0.5), (3, 0.25)])
def test_hops(spark, h, out):
    assert one(spark, S.hop_decay(F.lit(h))) == out


@pytest.mark.parametrize(("text", "kind", "out"), [("2026-02-09T10:30:00+05:00", "rfc3339", "2026-02-09 05:30:00"), ("1739054400", "unix", "2025-02-08 22:40:00"), ("1739054400000", "unix_ms", "2025-02-08 22:40:00"), ("2026-02-09", "date_only", "2026-02-09 00:00:00"), ("x", "unix", None)])
def test_times(spark, text, kind, out):
    assert one(spark, S.normalized_time(F.lit(text), F.lit(kind)).cast("string")) == out


def test_cosine_of_odd_vectors(spark):
    v = lambda *x: F.array(*(F.lit(float(i)) for i in x)) if x else F.array().cast("array<double>")
    assert one(spark, S.cosine(v(1, 0), v(1, 0, 0))) == 0
    assert one(spark, S.cosine(v(0, 0), v(1, 0))) == 0
    assert one(spark, S.cosine(v(), v())) == 0
    assert one(spark, S.cosine(v(3, 4), v(3, 4))) == pytest.approx(1)


def test_five_node_graph_order(spark):
    nodes = spark.createDataFrame([("A", 0.95), ("B", 0.85), ("C", 0.65), ("D", 0.45), ("E", 0.35)], "node_id string, score double")
    edges = spark.createDataFrame([("A", "C", "ASSOCIATED_WITH", 0.6), ("B", "C", "ASSOCIATED_WITH", 0.3), ("C", "D", "ASSOCIATED_WITH", 0.5), ("C", "E", "ASSOCIATED_WITH", 0.2), ("D", "E", "ASSOCIATED_WITH", 0.4), ("B", "D", "CONTRADICTS", 0.25)], "src string, dst string, rel_type string, weight double")
    act = graph.activation(nodes, edges)  # ASSOCIATED_WITH does not spread in the plain form
    score = nodes.join(act, "node_id").select("node_id", (0.55 * F.col("score") + 0.25 * F.col("activation")).alias("score"))
    assert [r.node_id for r in score.orderBy(F.desc("score")).collect()] == list("ABCDE")


def test_only_inhibited_nodes_are_not_held_down(spark):
    nodes = spark.createDataFrame([("B", 1.0), ("D", 0.4)], "node_id string, score double")
    edges = spark.createDataFrame([("B", "D", "CONTRADICTS", 0.9)], "src string, dst string, rel_type string, weight double")
    assert {r.node_id: r.activation for r in graph.activation(nodes, edges, steps=1).collect()} == {"B": 0.5, "D": 0.2}


def test_temporal_split_sizes(spark):
    df = spark.createDataFrame([(g, i) for g, n in (("a", 2), ("b", 3), ("c", 10)) for i in range(n)], "g string, i int")
    out = {(r.g, r.split): r.n for r in curate.temporal_split(df, ["g"], [F.asc("i")], 0.95).groupBy("g", "split").agg(F.count("*").alias("n")).collect()}
    assert out == {("a", "train"): 2, ("b", "train"): 2, ("b", "test"): 1, ("c", "train"): 9, ("c", "test"): 1}


def test_gate_order(spark):
    df = spark.createDataFrame([(1, "x", True), (2, "x", False), (3, "x", False)], "id int, k string, bad boolean")
    out = curate.gated(df, [("early", F.col("bad"))], F.col("k"), [F.asc("id")], [("late", F.col("id") == 2)])
    assert {r.id: r.exclude_reason for r in out.collect()} == {1: "early", 2: "late", 3: "duplicate"}


def test_import_modes(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(files.imported(new, old, ["k"], "skip")) == [(3, "d")]
    assert rows(files.imported(new, old, ["k"], "overwrite")) == [(1, "a"), (2, "c"), (3, "d")]
    with pytest.raises(ValueError, match="exists"):
        files.imported(new, old, ["k"], "error")


def test_granularity():
    assert [metrics.granularity(h) for h in (24, 25, 720, 721)] == ["raw", "hourly", "hourly", "daily"]
    assert metrics.granularity(200, "builder") == "daily"


def test_single_row_has_full_confidence(spark):
    df = spark.createDataFrame([("a", 1.0)], "node_id string, score double")
    assert rank.with_confidence(df, [], [F.desc("score")]).first().percentile == 100.0


def test_kmeans_separates(spark):
    pts = spark.createDataFrame([(i, [1.0, 0.01 * i]) for i in range(5)] + [(10 + i, [0.01 * i, 1.0]) for i in range(5)], "vec_id long, embedding array<double>")
    got = {r.id: r.cluster for r in learn.kmeans(pts, 2).collect()}
    assert len({got[i] for i in range(5)}) == 1 and len({got[10 + i] for i in range(5)}) == 1 and got[0] != got[10]


def test_lsh_pairs_are_among_the_exact_ones(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    pairs = lambda df: {(r.a, r.b) for r in df.collect()}
    exact, found = pairs(learn.near_pairs(e, 0.3)), pairs(learn.near_pairs(e, 0.3, planes=3))
    assert found <= exact and len(found) >= 0.9 * len(exact)


def test_rewards(spark):
    c = lambda f, s: one(spark, f(F.lit(s)))
    assert c(RW.coherence_score, "a a a a a") == 0.4 and c(RW.coherence_score, "") == 0 and c(RW.coherence_score, "a b c") == 0.9
    assert c(RW.json_valid, '{"a": 1}') == 1 and c(RW.json_valid, "{") == 0
    assert c(RW.format_valid, "plain") == 1 and c(RW.format_valid, "{x") == 0
    assert one(spark, RW.factuality_score(F.lit("the red cat"), F.lit("the red dog"))) == 0.5
    assert one(spark, RW.classification_accuracy(F.lit('{"type": "Bug"}'), F.lit("bug"))) == 1
