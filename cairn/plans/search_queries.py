"""Search and graph queries over embeddings, documents and the part-supplier graph."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import graph as G
from ..operators import rank as R
from ..sources.tables import EDGES_SQL, NODES_SQL, SUPPLIER_BASE, graph_edges, graph_nodes, load
from .registry import Registry

query = Registry()

VECTOR_SQL = """q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), v AS (SELECT vec_id AS node_id, label,
  list_sum(list_transform(list_zip(embedding, q), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))) / (sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) * sqrt(list_sum(list_transform(q, lambda x: CAST(x AS DOUBLE) * x)))) AS score
  FROM embeddings, q)"""


def query_vector(spark, sf_dir):
    """The vector of vec_id 0: one row."""
    return load(spark, sf_dir, "embeddings").where("vec_id = 0").first().embedding


def scored_vectors(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    q = F.array(*(F.lit(float(x)) for x in query_vector(spark, sf_dir)))
    return e.select(F.col("vec_id").alias("node_id"), "label", S.cosine(F.col("embedding"), q).alias("score"))


@query(f"WITH {VECTOR_SQL} SELECT node_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, node_id) AS rank FROM v ORDER BY v.score DESC, node_id LIMIT 20")
def k1_vector_top_k(spark, sf_dir):
    return R.vector_top_k(load(spark, sf_dir, "embeddings"), query_vector(spark, sf_dir), 20).withColumn("score", F.round("score", 6))


@query(f"WITH {VECTOR_SQL} SELECT node_id, label, round(score, 6) AS score FROM v")
def g1_cosine(spark, sf_dir):
    return scored_vectors(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(f"WITH {VECTOR_SQL} SELECT node_id, label, round(score, 6) AS score FROM (SELECT * FROM v WHERE label % 2 = 0 AND score >= 0.05 ORDER BY score DESC, node_id LIMIT 15)")
def p8_partition_recall(spark, sf_dir):
    return scored_vectors(spark, sf_dir).where("label % 2 = 0 and score >= 0.05").orderBy(F.desc("score"), "node_id").limit(15).withColumn("score", F.round("score", 6))


TERMS = ("the", "that", "from")
BM25_SQL = """t AS (SELECT doc_id AS node_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS w FROM documents),
  f AS (SELECT node_id, len(w) AS len, len(list_filter(w, lambda x: x = 'the')) AS tf0, len(list_filter(w, lambda x: x = 'that')) AS tf1, len(list_filter(w, lambda x: x = 'from')) AS tf2 FROM t),
  s AS (SELECT count(*) AS n, avg(len) AS al, count(*) FILTER (tf0 > 0) AS d0, count(*) FILTER (tf1 > 0) AS d1, count(*) FILTER (tf2 > 0) AS d2 FROM f),
  b AS (SELECT node_id, ln(1 + (n - d0 + 0.5) / (d0 + 0.5)) * tf0 * 2.2 / (tf0 + 1.2 * (0.25 + 0.75 * len / al)) + ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * tf1 * 2.2 / (tf1 + 1.2 * (0.25 + 0.75 * len / al))
    + ln(1 + (n - d2 + 0.5) / (d2 + 0.5)) * tf2 * 2.2 / (tf2 + 1.2 * (0.25 + 0.75 * len / al)) AS score FROM f, s WHERE tf0 + tf1 + tf2 > 0)"""


def lexical(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), S.words(F.col("text")).alias("tokens"))
    return R.bm25(docs, TERMS)


@query(f"WITH {BM25_SQL} SELECT node_id, round(score, 6) AS score FROM b ORDER BY round(score, 6) DESC, node_id LIMIT 50")
def k2_bm25_top_k(spark, sf_dir):
    return lexical(spark, sf_dir).withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "node_id").limit(50)


FUSED_SQL = f"""{VECTOR_SQL}, {BM25_SQL}, x AS (SELECT node_id, row_number() OVER (ORDER BY round(score, 6) DESC, node_id) AS rank_a FROM v QUALIFY rank_a <= 50), y AS (SELECT node_id, row_number() OVER (ORDER BY round(score, 6) DESC, node_id) AS rank_b FROM b QUALIFY rank_b <= 50),
  fused AS (SELECT coalesce(x.node_id, y.node_id) AS node_id, rank_a, rank_b, coalesce(0.6 / (60 + rank_a), 0) + coalesce(0.4 / (60 + rank_b), 0) AS score FROM x FULL JOIN y ON x.node_id = y.node_id)"""


def two_lists(spark, sf_dir, n=50):
    a = scored_vectors(spark, sf_dir).withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "node_id").limit(n)
    b = lexical(spark, sf_dir).withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "node_id").limit(n)
    return R.ranked(a), R.ranked(b)


@query(f"WITH {FUSED_SQL} SELECT node_id, rank_a, rank_b, round(score, 9) AS score FROM fused ORDER BY score DESC, node_id LIMIT 20")
def j1_rank_fusion(spark, sf_dir):
    return R.rank_fusion(*two_lists(spark, sf_dir)).withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "node_id").limit(20)


@query(f"""WITH {FUSED_SQL}, c AS (SELECT node_id, 0.5 AS w, rank_a AS r, (SELECT max(rank_a) FROM x) AS m FROM x UNION ALL SELECT node_id, 0.3, rank_b, (SELECT max(rank_b) FROM y) FROM y UNION ALL SELECT o_custkey, 0.2, r, 50 FROM (SELECT o_custkey, row_number() OVER (ORDER BY sum(o_totalprice) DESC, o_custkey) AS r FROM orders GROUP BY 1) WHERE r <= 50)
  SELECT node_id, round(sum(w / (60 + r)), 9) AS score, count(*) AS n_columns, round(least(1, count(*) / 4 * avg(1 - (r - 1) / m)), 6) AS strength FROM c GROUP BY node_id""")
def j2_column_consensus(spark, sf_dir):
    a, b = two_lists(spark, sf_dir)
    spend = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("node_id")).agg(F.round(F.sum("o_totalprice"), 2).alias("score"))
    c = R.ranked(spend.orderBy(F.desc("score"), "node_id").limit(50))
    out = R.consensus({"vector": a, "bm25": b, "spend": c}, {"vector": 0.5, "bm25": 0.3, "spend": 0.2}, attempted=4)
    return out.withColumns({"score": F.round("score", 9), "strength": F.round("strength", 6)})


@query("SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) AS rank FROM embeddings")
def w2_rank_in_column(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings").select("label", F.col("vec_id"), F.col("embedding")[0].alias("score"))
    return R.ranked(e, ["label"], tie="vec_id").select("label", "vec_id", "rank")


@query("""WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) - 1 AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events),
  p AS (SELECT *, CASE WHEN n = 1 THEN 100 ELSE 100.0 * (n - 1 - r) / (n - 1) END AS p FROM r) SELECT user_id, event_id, round(CAST(p AS DOUBLE), 1) AS percentile, CASE WHEN p >= 90 THEN 'HIGH' WHEN p >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM p""")
def w4_percentile_confidence(spark, sf_dir):
    return R.with_confidence(load(spark, sf_dir, "events"), ["user_id"], [F.desc("value"), F.asc("event_id")]).select("user_id", "event_id", "percentile", "level")


@query("""WITH r AS (SELECT user_id, event_id AS node_id, value AS score, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events), c AS (SELECT user_id, quantile_cont(value, 0.75) AS cut FROM events GROUP BY 1)
  SELECT user_id, node_id, rank FROM r JOIN c USING (user_id) WHERE rank <= 10 AND (score >= cut OR rank <= 3)""")
def k3_sparse_gate(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("node_id"), F.col("value").alias("score"))
    return R.sparse_gate(e, ["user_id"], 0.75, 3, 10).select("user_id", "node_id", "rank")


@query("""WITH r AS (SELECT l_suppkey AS user_id, l_returnflag AS name, l_orderkey * 10 + l_linenumber AS node_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber) AS rank FROM lineitem),
  f AS (SELECT *, row_number() OVER (PARTITION BY user_id, name ORDER BY rank) <= 3 AS ok FROM r), p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ok DESC, rank) AS place FROM f)
  SELECT user_id, node_id, place FROM p WHERE place <= 10 AND (ok OR place <= 8)""")
def k4_diversity(spark, sf_dir):
    l = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("user_id"), F.col("l_returnflag").alias("name"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("node_id"), F.col("l_extendedprice").alias("score"))  # noqa: E741
    return R.diverse(R.ranked(l, ["user_id"]), 10, 3, 8, ["user_id"]).select("user_id", "node_id", "place")


@query("""WITH r AS (SELECT user_id, event_id AS node_id, event_type = 'purchase' AS c, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events),
  n AS (SELECT *, sum(CASE WHEN c THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY rank) AS nth, sum(CASE WHEN c AND rank <= 10 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id) AS have FROM r),
  p AS (SELECT user_id, node_id, row_number() OVER (PARTITION BY user_id ORDER BY (have < 4 AND c AND nth <= 4) DESC, rank) AS place FROM n) SELECT * FROM p WHERE place <= 10""")
def k5_concrete_quota(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("node_id"), F.col("value").alias("score"), "event_type")
    return R.concrete_quota(R.ranked(e, ["user_id"]), ["user_id"], 10, 4, F.col("event_type") == "purchase").select("user_id", "node_id", "place")


@query(f"""WITH {VECTOR_SQL}, r AS (SELECT node_id, label, score, row_number() OVER (ORDER BY round(score, 6) DESC, node_id) AS rank FROM v QUALIFY rank <= 30), s AS (SELECT node_id, round(CASE WHEN rank <= 10 THEN 0.6 * round(score, 6) + 0.4 * CASE WHEN node_id % 3 = 0 THEN 0.9 ELSE 0.5 END ELSE round(score, 6) * 0.95 END, 6) AS score FROM r)
  SELECT node_id, score FROM s ORDER BY score DESC, node_id LIMIT 15""")
def k7_rerank(spark, sf_dir):
    a, _ = two_lists(spark, sf_dir, 30)
    scores = a.where("node_id % 3 = 0").select("node_id", F.lit(0.9).alias("score"))
    return R.rerank(a, scores, 10, 0.4, 15).select("node_id", F.round("score", 6).alias("score"))


@query("""WITH i AS (SELECT event_id, event_type, greatest(1 - 2 * abs(value / 100 - 0.5), abs(0.3 - value / 100)) AS s FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY round(s, 9) DESC, event_id) AS nth FROM i)
  SELECT event_id, event_type, nth FROM n ORDER BY nth, event_type LIMIT 40""")
def k8_review_sample(spark, sf_dir):
    s = F.greatest(1 - 2 * F.abs(F.col("value") / 100 - 0.5), F.abs(F.lit(0.3) - F.col("value") / 100))
    e = load(spark, sf_dir, "events").select("event_id", "event_type", F.round(s, 9).alias("s"))
    return R.round_robin(e, "event_type", [F.desc("s"), F.asc("event_id")], 40).select("event_id", "event_type", "nth")


@query("""WITH c AS (SELECT 'brand' AS kind, p_brand AS value, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'type', p_type, count(*) FROM part GROUP BY 2) SELECT kind, value, n FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, value) AS k FROM c) WHERE k <= 10""")
def k10_catalog_density(spark, sf_dir):
    p = load(spark, sf_dir, "part").select(F.explode(F.array(F.struct(F.lit("brand").alias("kind"), F.col("p_brand").alias("value")), F.struct(F.lit("type").alias("kind"), F.col("p_type").alias("value")))).alias("x")).select("x.*")
    c = p.groupBy("kind", "value").agg(F.count("*").alias("n"))
    return c.withColumn("k", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "value"))).where("k <= 10").drop("k")


@query("""WITH p AS (SELECT s.l_orderkey, a.l_partkey AS a, s.l_partkey AS b, round(a.l_discount * s.l_discount, 6) AS product FROM lineitem a JOIN lineitem s ON a.l_orderkey = s.l_orderkey AND a.l_partkey < s.l_partkey)
  SELECT a, b, round(sum(product), 6) AS product FROM p GROUP BY a, b ORDER BY 3 DESC, a, b LIMIT 100""")
def k9_learning_pairs(spark, sf_dir):
    l = load(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("a"), F.col("l_discount").alias("x"))  # noqa: E741
    p = l.join(l.toDF("l_orderkey", "b", "y"), "l_orderkey").where("a < b")
    return p.groupBy("a", "b").agg(F.round(F.sum(F.round(F.col("x") * F.col("y"), 6)), 6).alias("product")).orderBy(F.desc("product"), "a", "b").limit(100)


@query("""SELECT vec_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY embedding[2] DESC, vec_id) AS n FROM embeddings) WHERE n <= 5""")
def w5_per_source_cap(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings").withColumn("x", F.col("embedding")[1])
    return R.per_source_cap(e, "label", 5, [F.desc("x"), F.asc("vec_id")]).select("vec_id", "label")


@query("SELECT page_id, least(count(*) OVER (PARTITION BY regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) - 1, 3) AS siblings FROM pages")
def w7_sibling_count(spark, sf_dir):
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    counts = load(spark, sf_dir, "pages").groupBy(host.alias("h")).agg(F.count("*").alias("n"))
    return load(spark, sf_dir, "pages").select("page_id", host.alias("h")).join(counts, "h").select("page_id", F.least(F.col("n") - 1, F.lit(3)).alias("siblings"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' AND o_orderstatus IN ('O', 'F') AND NOT coalesce(o_totalprice < 1000, false)")
def p1_tenant_and_time_filter(spark, sf_dir):
    o = load(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("O", "F") & ~F.coalesce(F.col("o_totalprice") < 1000, F.lit(False)))
    return o.where((F.col("o_orderdate") >= F.to_timestamp(F.lit("1996-01-01"))) & (F.col("o_orderdate") < F.to_timestamp(F.lit("1997-01-01")))).select("o_orderkey", "o_custkey")


@query("SELECT page_id, url FROM pages WHERE regexp_extract(url, '\\.([a-z]+)$', 1) IN ('html', 'htm')")
def p2_extension_filter(spark, sf_dir):
    return load(spark, sf_dir, "pages").where(F.regexp_extract("url", r"\.([a-z]+)$", 1).isin("html", "htm")).select("page_id", "url")


@query(f"""WITH {VECTOR_SQL}, s AS (SELECT node_id, round(CASE WHEN label = 3 THEN round(score, 6) * 0.5 ELSE round(score, 6) END, 6) AS score FROM v) SELECT node_id, score, row_number() OVER (ORDER BY score DESC, node_id) AS rank FROM s ORDER BY score DESC, node_id LIMIT 30""")
def p9_path_suppression(spark, sf_dir):
    v = scored_vectors(spark, sf_dir).select("node_id", F.col("label").cast("string").alias("path"), F.round("score", 6).alias("score"))
    paths = spark.createDataFrame([("3",)], "path string")
    hit = R.suppress_paths(v, paths, 0.5).withColumn("score", F.round("score", 6)).drop("rank")
    return R.ranked(hit.select("node_id", "score").orderBy(F.desc("score"), "node_id").limit(30))


@query(f"WITH e AS {EDGES_SQL}, n AS {NODES_SQL} SELECT node_id FROM n WHERE node_id NOT IN (SELECT src FROM e) AND node_id NOT IN (SELECT dst FROM e)")
def p11_zero_edge_orphans(spark, sf_dir):
    e = graph_edges(spark, sf_dir)
    linked = e.select(F.col("src").alias("node_id")).union(e.select("dst"))
    return graph_nodes(spark, sf_dir).join(linked, "node_id", "left_anti").select("node_id")


@query(f"""WITH e AS {EDGES_SQL}, n AS {NODES_SQL}, o AS (SELECT src, count(*) AS k FROM e WHERE rel_type <> 'ASSOCIATED_WITH' GROUP BY 1) SELECT node_id, coalesce(k, 0) AS out_edges FROM n LEFT JOIN o ON src = node_id WHERE layer >= 3 AND coalesce(k, 0) < 15 AND node_id NOT IN (SELECT src FROM e WHERE evidence > 2)""")
def p12_graph_frontier(spark, sf_dir):
    e = graph_edges(spark, sf_dir)
    out = e.where("rel_type <> 'ASSOCIATED_WITH'").groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("k"))
    n = graph_nodes(spark, sf_dir).where("layer >= 3").join(out, "node_id", "left").select("node_id", F.coalesce("k", F.lit(0)).alias("out_edges")).where("out_edges < 15")
    return n.join(e.where("evidence > 2").select(F.col("src").alias("node_id")), "node_id", "left_anti")


@query("SELECT count(*) FILTER (o_orderpriority = '1-URGENT') AS hit, count(*) AS total, count(*) FILTER (o_orderpriority = '1-URGENT') / count(*) > 0.25 AS too_wide FROM orders")
def p16_blast_radius(spark, sf_dir):
    hit, n = F.count_if(F.col("o_orderpriority") == "1-URGENT"), F.count("*")
    return load(spark, sf_dir, "orders").agg(hit.alias("hit"), n.alias("total"), (hit / n > 0.25).alias("too_wide"))


def bfs_sql(hops: int) -> str:
    steps = "".join(f", h{h} AS (SELECT DISTINCT b AS node_id, {h} AS hops FROM h{h - 1} JOIN l ON a = node_id WHERE b NOT IN (SELECT node_id FROM s{h - 1})), s{h} AS (SELECT * FROM s{h - 1} UNION ALL SELECT * FROM h{h})" for h in range(1, hops + 1))
    return f"WITH e AS {EDGES_SQL}, l AS (SELECT src AS a, dst AS b FROM e WHERE rel_type = 'CO_ACTIVATED_WITH' AND weight > 0.8 UNION SELECT dst, src FROM e WHERE rel_type = 'CO_ACTIVATED_WITH' AND weight > 0.8), h0 AS (SELECT CAST(1 AS BIGINT) AS node_id, 0 AS hops UNION ALL SELECT 7, 0), s0 AS (SELECT * FROM h0){steps}"


def walk_inputs(spark, sf_dir):
    return graph_edges(spark, sf_dir).where("weight > 0.8"), spark.createDataFrame([(1,), (7,)], "node_id long")


@query(bfs_sql(3) + " SELECT node_id, hops FROM s3")
def j3_neighbourhood(spark, sf_dir):
    e, seeds = walk_inputs(spark, sf_dir)
    return G.neighbourhood(e, seeds, 3, ["CO_ACTIVATED_WITH"])


@query(bfs_sql(3) + " SELECT node_id, hops, CASE WHEN hops <= 1 THEN 1.0 ELSE pow(0.5, hops - 1) END AS score FROM s3 WHERE hops > 0 ORDER BY hops, node_id LIMIT 40")
def j4_structural_walk(spark, sf_dir):
    e, seeds = walk_inputs(spark, sf_dir)
    return G.structural_scores(e, seeds, 3, 40, ["CO_ACTIVATED_WITH"])


@query(bfs_sql(2) + f", n AS {NODES_SQL} SELECT node_id, round((CASE WHEN layer > 0 THEN 1 + 0.1 * layer ELSE 1 END) / (1 + hops), 6) AS score FROM s2 JOIN n USING (node_id)")
def g19_reflect(spark, sf_dir):
    e, seeds = walk_inputs(spark, sf_dir)
    found = G.neighbourhood(e, seeds, 2, ["CO_ACTIVATED_WITH"]).join(graph_nodes(spark, sf_dir), "node_id")
    return found.select("node_id", F.round((1 + 0.1 * F.col("layer")) / (1 + F.col("hops")), 6).alias("score"))


@query(f"""WITH e AS {EDGES_SQL}, n AS {NODES_SQL}, d AS (SELECT node_id, count(*) AS k FROM (SELECT src AS node_id FROM e UNION ALL SELECT dst FROM e) GROUP BY 1), q AS (SELECT layer, ceil(count(*) / (SELECT count(*) FROM n) * 100) AS quota FROM n GROUP BY 1),
  r AS (SELECT n.node_id, n.layer, coalesce(k, 0) AS degree, row_number() OVER (PARTITION BY n.layer ORDER BY coalesce(k, 0) DESC, n.node_id) AS nth FROM n LEFT JOIN d USING (node_id)) SELECT node_id, r.layer, degree FROM r JOIN q USING (layer) WHERE nth <= quota""")
def j6_topology_sample(spark, sf_dir):
    return G.quota_sample(graph_nodes(spark, sf_dir), graph_edges(spark, sf_dir), 100)


@query(bfs_sql(1) + ", e2 AS (SELECT l_orderkey, l_linenumber, l_partkey AS src, l_suppkey + 1000000000000 AS dst, l_shipdate FROM lineitem) SELECT l_orderkey, l_linenumber, src IN (SELECT node_id FROM s1) AS src_in, dst IN (SELECT node_id FROM s1) AS dst_in FROM e2 WHERE src IN (SELECT node_id FROM s1) OR dst IN (SELECT node_id FROM s1) ORDER BY l_shipdate DESC, l_orderkey, l_linenumber LIMIT 200")
def j7_event_federation(spark, sf_dir):
    e, seeds = walk_inputs(spark, sf_dir)
    near = G.neighbourhood(e, seeds, 1, ["CO_ACTIVATED_WITH"]).select("node_id")
    ev = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("src"), (F.col("l_suppkey") + SUPPLIER_BASE).alias("dst"), "l_shipdate")
    ev = ev.join(near.select(F.col("node_id").alias("src"), F.lit(True).alias("s")), "src", "left").join(near.select(F.col("node_id").alias("dst"), F.lit(True).alias("d")), "dst", "left")
    return ev.where("s or d").orderBy(F.desc("l_shipdate"), "l_orderkey", "l_linenumber").limit(200).select("l_orderkey", "l_linenumber", F.coalesce("s", F.lit(False)).alias("src_in"), F.coalesce("d", F.lit(False)).alias("dst_in"))


@query("SELECT event_id, event_type FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def j8_outcome_federation(spark, sf_dir):
    near = load(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    return load(spark, sf_dir, "events").join(near, "user_id", "left_semi").select("event_id", "event_type")


@query(f"""WITH {VECTOR_SQL} SELECT node_id, 'vector' AS origin FROM (SELECT * FROM v ORDER BY score DESC, node_id LIMIT 10) UNION ALL SELECT node_id, 'label' FROM (SELECT node_id FROM v WHERE label = 1 ORDER BY node_id LIMIT 20) WHERE node_id NOT IN (SELECT node_id FROM v ORDER BY score DESC, node_id LIMIT 10)""")
def j20_merge_candidates(spark, sf_dir):
    v = scored_vectors(spark, sf_dir)
    a = v.orderBy(F.desc("score"), "node_id").limit(10).select("node_id", F.lit("vector").alias("origin"))
    return R.merged(a, v.where("label = 1").orderBy("node_id").limit(20).select("node_id", F.lit("label").alias("origin")))


def activation_sql(attention: bool = False) -> str:
    kinds = "('CO_ACTIVATED_WITH', 'ASSOCIATED_WITH')" if attention else "('CO_ACTIVATED_WITH')"
    w = "weight * CASE rel_type WHEN 'ASSOCIATED_WITH' THEN 0.6 ELSE 0.9 END" if attention else "weight"
    step = lambda t, least: f""", up{t} AS (SELECT dst, sum(activation * w) / sqrt(any_value(n)) AS up FROM a{t} JOIN good{t} ON src = node_id JOIN (SELECT dst AS d2, count(*) AS n FROM good{t} GROUP BY 1) ON d2 = dst GROUP BY dst),
  dn{t} AS (SELECT dst, sum(activation * abs(weight)) AS down FROM a{t} JOIN e ON src = node_id WHERE rel_type = 'CONTRADICTS' GROUP BY dst),
  a{t + 1} AS (SELECT coalesce(node_id, u.dst) AS node_id, greatest(0, least(1, 0.5 * coalesce(activation, 0) + coalesce(up, 0) - CASE WHEN u.dst IS NULL THEN 0 ELSE coalesce(down, 0) END)) AS activation FROM a{t} FULL JOIN up{t} u ON u.dst = node_id LEFT JOIN dn{t} d ON d.dst = u.dst)"""  # noqa: E731
    good = lambda t, least: f", good{t} AS (SELECT src, dst, {w} AS w FROM e WHERE rel_type IN {kinds} AND {w} >= {least})"
    return f"WITH e0 AS {EDGES_SQL}, e AS (SELECT * FROM e0 UNION ALL SELECT dst, src, rel_type, weight, evidence, last_used FROM e0), a0 AS (SELECT p_partkey AS node_id, CAST(p_size AS DOUBLE) / 50 AS activation FROM part WHERE p_partkey % 10 = 3){good(0, 0.0)}{step(0, 0)}{good(1, 0.05)}{step(1, 0.05)} SELECT node_id, round(activation, 6) AS activation FROM a2"


def activation_inputs(spark, sf_dir):
    e = graph_edges(spark, sf_dir)
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "rel_type", "weight", "evidence", "last_used"))
    # every tenth part is a seed of the walk, as a query's hits would be
    seeds = load(spark, sf_dir, "part").where("p_partkey % 10 = 3").select(F.col("p_partkey").alias("node_id"), (F.col("p_size").cast("double") / 50).alias("score"))
    return seeds, both


@query(activation_sql())
def g7_spreading_activation(spark, sf_dir):
    return G.activation(*activation_inputs(spark, sf_dir)).withColumn("activation", F.round("activation", 6))


@query(activation_sql(True))
def g8_attention_activation(spark, sf_dir):
    seeds, edges = activation_inputs(spark, sf_dir)
    weights = {"CO_ACTIVATED_WITH": 0.9, "ASSOCIATED_WITH": 0.6}
    weighted = G.edge_attention(edges, weights).drop("attention").unionByName(edges.where("rel_type = 'CONTRADICTS'"))
    return G.activation(seeds, weighted, excite=tuple(weights)).withColumn("activation", F.round("activation", 6))


@query(f"SELECT src, dst, rel_type, round(least(1, weight * (0.6 * weight + 0.2 * least(1, evidence / 3) + 0.2)), 6) AS effective FROM {EDGES_SQL}")
def g10_effective_weight(spark, sf_dir):
    mix = 0.6 * F.col("weight") + 0.2 * F.least(F.lit(1.0), F.col("evidence") / 3) + 0.2
    return graph_edges(spark, sf_dir).select("src", "dst", "rel_type", F.round(F.least(F.lit(1.0), F.col("weight") * F.when(mix == 0, 1.0).otherwise(mix)), 6).alias("effective"))


@query(f"""WITH {VECTOR_SQL}, d AS (SELECT l_partkey AS node_id, count(*) AS degree, max(l_shipdate) AS last FROM lineitem GROUP BY 1) SELECT node_id, round(0.55 * score + 0.1 * round(exp(-0.01 * date_diff('day', last, TIMESTAMP '2003-01-01')), 9) - 0.03 * ln(1 + degree) - 0.02 * least(label, 3), 6) AS score FROM v JOIN d USING (node_id)""")
def g12_linear_score(spark, sf_dir):
    d = load(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("node_id")).agg(F.count("*").alias("degree"), F.max("l_shipdate").alias("last"))
    v = scored_vectors(spark, sf_dir).join(d, "node_id")
    recency = F.round(F.exp(-0.01 * F.datediff(F.to_date(F.lit("2003-01-01")), F.col("last"))), 9)
    score = R.linear_score({"vector": F.col("score"), "bm25": F.lit(0.0), "activation": F.lit(0.0), "recency": recency, "degree": F.col("degree"), "hops": F.col("label")})
    return v.select("node_id", F.round(score, 6).alias("score"))


@query("SELECT o_orderkey, round(exp(-CASE o_orderstatus WHEN 'F' THEN 0.01 WHEN 'O' THEN 0.02 ELSE 0.05 END * date_diff('day', o_orderdate, TIMESTAMP '2003-01-01')), 9) AS decay FROM orders")
def g13_recency_decay(spark, sf_dir):
    rho = F.when(F.col("o_orderstatus") == "F", 0.01).when(F.col("o_orderstatus") == "O", 0.02).otherwise(0.05)
    return load(spark, sf_dir, "orders").select("o_orderkey", F.round(F.exp(-rho * F.datediff(F.to_date(F.lit("2003-01-01")), F.col("o_orderdate"))), 9).alias("decay"))


@query(f"""SELECT src, round(max(least(0.3, 0.05 * (d - 30) / 30)), 6) AS penalty FROM (SELECT src, date_diff('day', last_used, TIMESTAMP '2003-01-01') AS d FROM {EDGES_SQL}) WHERE d > 30 GROUP BY src""")
def g17_stale_reference_penalty(spark, sf_dir):
    d = graph_edges(spark, sf_dir).select("src", F.datediff(F.to_date(F.lit("2003-01-01")), F.col("last_used")).alias("d")).where("d > 30")
    return d.groupBy("src").agg(F.round(F.max(F.least(F.lit(0.3), 0.05 * (F.col("d") - 30) / 30)), 6).alias("penalty"))


@query("""WITH f AS (SELECT l_orderkey, list_distinct(list(l_suppkey % 16)) AS f FROM lineitem GROUP BY 1) SELECT l_orderkey, round(len(list_intersect(f, [1, 3, 5, 7, 11])) / len(list_distinct(list_concat(f, [1, 3, 5, 7, 11]))), 6) AS jaccard FROM f""")
def u4_fingerprint_jaccard(spark, sf_dir):
    f = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_suppkey") % 16).alias("f"))
    return f.select("l_orderkey", F.round(S.jaccard(F.col("f"), F.array(*(F.lit(x).cast("long") for x in (1, 3, 5, 7, 11)))), 6).alias("jaccard"))


@query(f"WITH e AS {EDGES_SQL}, n AS {NODES_SQL}, k AS (SELECT node_id FROM n WHERE layer <= 2 OR confidence >= 0.8) SELECT src, dst, rel_type FROM e WHERE src IN (SELECT node_id FROM k) AND dst IN (SELECT node_id FROM k)")
def s8_filtered_export(spark, sf_dir):
    keep = graph_nodes(spark, sf_dir).where("layer <= 2 or confidence >= 0.8")
    return G.both_ends(graph_edges(spark, sf_dir), keep).select("src", "dst", "rel_type")


@query(f"SELECT src, dst, evidence FROM {EDGES_SQL} WHERE rel_type = 'CONTRADICTS' AND (src IN (SELECT p_partkey FROM part WHERE p_size = 7) OR dst % 10 = 3) ORDER BY evidence DESC, src, dst LIMIT 5")
def z1_contradictions(spark, sf_dir):
    near = load(spark, sf_dir, "part").where("p_size = 7").select(F.col("p_partkey").alias("src"))
    e = graph_edges(spark, sf_dir).where("rel_type = 'CONTRADICTS'").join(near.withColumn("hit", F.lit(True)), "src", "left")
    return e.where("hit or dst % 10 = 3").orderBy(F.desc("evidence"), "src", "dst").limit(5).select("src", "dst", "evidence")


@query(f"WITH {VECTOR_SQL} SELECT node_id, round(score, 6) AS score FROM (SELECT * FROM v ORDER BY score DESC, node_id LIMIT 60) WHERE label IN (1, 2) AND score > 0.05 ORDER BY score DESC, node_id LIMIT 3")
def z2_frontier_knn(spark, sf_dir):
    found = scored_vectors(spark, sf_dir).orderBy(F.desc("score"), "node_id").limit(60)
    return found.where("label in (1, 2) and score > 0.05").orderBy(F.desc("score"), "node_id").limit(3).select("node_id", F.round("score", 6).alias("score"))


@query(f"""WITH {VECTOR_SQL}, u AS (SELECT node_id, 0 AS p, row_number() OVER (ORDER BY score DESC, node_id) AS r FROM v WHERE score > 0.05 QUALIFY r <= 10 UNION ALL SELECT node_id, 1, row_number() OVER (ORDER BY node_id) FROM v WHERE label = 2 QUALIFY row_number() OVER (ORDER BY node_id) <= 10) SELECT node_id FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY p, r) AS k FROM u) WHERE k = 1 ORDER BY p, r LIMIT 12""")
def z3_hybrid_constraints(spark, sf_dir):
    v = scored_vectors(spark, sf_dir)
    a = R.ranked(v.where("score > 0.05").orderBy(F.desc("score"), "node_id").limit(10)).select("node_id", F.lit(0).alias("p"), F.col("rank").alias("r"))
    b = R.ranked(v.where("label = 2").orderBy("node_id").limit(10).withColumn("score", F.lit(0.0))).select("node_id", F.lit(1).alias("p"), F.col("rank").alias("r"))
    first = a.unionByName(b).groupBy("node_id").agg(F.min(F.struct("p", "r")).alias("o"))
    return first.orderBy("o.p", "o.r").limit(12).select("node_id")
