"""Learning, decay, clustering and consolidation over the part-supplier graph and the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import learn as L
from ..operators.rank import per_source_cap
from ..sources.tables import EDGES_SQL, NODES_SQL, SUPPLIER_BASE, graph_edges, graph_nodes, load
from .registry import Registry

query = Registry()


@query(f"""WITH e AS (SELECT src, dst, weight FROM {EDGES_SQL} WHERE rel_type = 'CO_ACTIVATED_WITH'), p AS (SELECT l_partkey AS src, l_suppkey + {SUPPLIER_BASE} AS dst, max(l_discount) * 8 AS a, max(l_tax) * 8 AS b FROM lineitem WHERE l_quantity > 40 GROUP BY ALL)
  SELECT coalesce(e.src, p.src) AS src, coalesce(e.dst, p.dst) AS dst, round(CASE WHEN a IS NOT NULL THEN greatest(0, tanh(0.99 * coalesce(weight, 0) + 0.02 * a * b)) ELSE coalesce(weight, 0) END, 6) AS weight, weight IS NULL AS created FROM e FULL JOIN p ON e.src = p.src AND e.dst = p.dst""")
def l1_hebbian_update(spark, sf_dir):
    e = graph_edges(spark, sf_dir).where("rel_type = 'CO_ACTIVATED_WITH'").select("src", "dst", "weight")
    p = load(spark, sf_dir, "lineitem").where("l_quantity > 40").groupBy(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + SUPPLIER_BASE).alias("dst")).agg((F.max("l_discount") * 8).alias("a"), (F.max("l_tax") * 8).alias("b"))
    return L.coactivated(e, p).withColumn("weight", F.round("weight", 6))


@query("SELECT user_id, event_id, round(greatest(0, value / 100 - 0.15), 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'error') WHERE n <= 20")
def l3_negative_feedback(spark, sf_dir):
    e = per_source_cap(load(spark, sf_dir, "events").where("event_type = 'error'"), "user_id", 20, [F.asc("ts"), F.asc("event_id")])
    return e.select("user_id", "event_id", F.round(F.greatest(F.lit(0.0), F.col("value") / 100 - 0.15), 6).alias("weight"))


@query("""WITH p AS (SELECT a.event_id AS a, b.event_id AS b, date_diff('microsecond', a.ts, b.ts) / 1000000 AS s FROM events a JOIN events b ON a.user_id = b.user_id AND date_trunc('hour', a.ts) = date_trunc('hour', b.ts) AND (a.ts, a.event_id) < (b.ts, b.event_id)) SELECT a, b, round(greatest(0.1, 1 - 0.9 * s / 3600), 6) AS proximity FROM p""")
def l4_session_proximity(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("user_id", F.date_trunc("hour", "ts").alias("h"), "ts", "event_id")
    pairs = e.alias("a").join(e.alias("b"), ["user_id", "h"]).where("struct(a.ts, a.event_id) < struct(b.ts, b.event_id)")
    s = (F.unix_micros(F.col("b.ts").cast("timestamp")) - F.unix_micros(F.col("a.ts").cast("timestamp"))) / 1e6
    return pairs.select(F.col("a.event_id").alias("a"), F.col("b.event_id").alias("b"), F.round(S.session_proximity(s), 6).alias("proximity"))


@query(f"""WITH d AS (SELECT src, dst, rel_type, weight * exp(-0.0005 * date_diff('day', last_used, TIMESTAMP '2003-01-01')) AS w, evidence FROM {EDGES_SQL}) SELECT src, dst, rel_type, round(w, 6) AS weight FROM d WHERE w > 0 AND NOT (w < 0.05 AND evidence < 2)""")
def l5_decay_and_prune(spark, sf_dir):
    return L.decayed(graph_edges(spark, sf_dir), "2003-01-01", 0.0005, 0.05, 2).select("src", "dst", "rel_type", F.round("weight", 6).alias("weight"))


@query(f"SELECT src, dst, rel_type, round(weight * pow(1 - least(1.0, 0.01 / sqrt(evidence * 0.8)), date_diff('day', last_used, TIMESTAMP '2003-01-01')), 6) AS weight FROM {EDGES_SQL}")
def l6_evidence_decay(spark, sf_dir):
    days = F.datediff(F.to_date(F.lit("2003-01-01")), F.col("last_used"))
    return graph_edges(spark, sf_dir).select("src", "dst", "rel_type", F.round(S.evidence_decay(F.col("weight"), days, F.col("evidence"), F.lit(0.8), 0.01), 6).alias("weight"))


@query("""WITH s AS (SELECT user_id, least(1.0, 0.1 * count(*)) AS base, date_diff('hour', max(ts), TIMESTAMP '2024-02-10') / 24 AS days FROM (SELECT user_id, date_trunc('hour', ts) AS ts FROM events) GROUP BY 1), d AS (SELECT user_id, base * CASE WHEN days >= 1 THEN pow(0.95, floor(days)) ELSE 1 END AS stability FROM s) SELECT user_id, round(stability, 6) AS stability, stability >= 0.5 AS graduated FROM d""")
def l7_node_stability(spark, sf_dir):
    s = load(spark, sf_dir, "events").groupBy("user_id").agg(F.least(F.lit(1.0), 0.1 * F.count("*")).alias("base"), F.max(F.date_trunc("hour", "ts")).alias("last"))
    days = F.timestamp_diff("HOUR", F.col("last"), F.to_timestamp(F.lit("2024-02-10"))) / 24
    v = F.col("base") * F.when(days >= 1, F.pow(F.lit(0.95), F.floor(days))).otherwise(1.0)
    return s.select("user_id", F.round(v, 6).alias("stability"), (v >= 0.5).alias("graduated"))


@query("""WITH s AS (SELECT user_id, count(*) AS n, date_diff('day', CAST(max(ts) AS DATE), DATE '2024-02-10') AS age, CASE WHEN count(*) < 2 THEN 0 ELSE var_samp(value / 100) END AS v FROM events GROUP BY 1) SELECT user_id, round(greatest(0.05, least(1, 1 / (1 + exp(-(0.5 * ln(1 + n) + 0.3 * exp(-age / 30) - v))))), 6) AS confidence FROM s""")
def l8_confidence(spark, sf_dir):
    s = load(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.datediff(F.to_date(F.lit("2024-02-10")), F.max("ts")).alias("age"), F.coalesce(F.var_samp(F.col("value") / 100), F.lit(0.0)).alias("v"))
    return s.select("user_id", F.round(S.confidence(F.col("n"), F.col("age"), F.col("v")), 6).alias("confidence"))


@query(f"SELECT node_id, round(CASE WHEN layer <> 0 AND role_type <> 'supplier' THEN greatest(confidence - 0.01, 0) ELSE confidence END, 6) AS confidence FROM {NODES_SQL}")
def l9_constraint_decay(spark, sf_dir):
    stale = (F.col("layer") != 0) & (F.col("role_type") != "supplier")
    return graph_nodes(spark, sf_dir).select("node_id", F.round(F.when(stale, F.greatest(F.col("confidence") - 0.01, F.lit(0.0))).otherwise(F.col("confidence")), 6).alias("confidence"))


PAIRS_SQL = """p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)"""


@query(f"WITH {PAIRS_SQL} SELECT a, b, round(sim, 6) AS sim FROM p WHERE sim >= 0.35")
def j9_near_pairs(spark, sf_dir):
    return L.near_pairs(load(spark, sf_dir, "embeddings"), 0.35).withColumn("sim", F.round("sim", 6))


KINDS = ("must", "should", "must_not", "should_not")


@query(f"""WITH {PAIRS_SQL}, k AS (SELECT vec_id, label % 4 AS kind FROM embeddings), l AS (SELECT DISTINCT user_id AS u, CAST(json_extract_string(props, '$.k') AS BIGINT) AS v FROM events)
  SELECT a, b, round(sim, 6) AS sim FROM p JOIN k x ON x.vec_id = a JOIN k y ON y.vec_id = b WHERE sim >= 0.25 AND (x.kind < 2) <> (y.kind < 2) AND NOT EXISTS (SELECT 1 FROM l WHERE (u = a AND v = b) OR (u = b AND v = a))""")
def j9_conflicts(spark, sf_dir):
    """Constraints with kinds by label; a user's events link it to the constraint in their props."""
    e, kinds = load(spark, sf_dir, "embeddings"), F.array(*map(F.lit, KINDS))
    nodes = e.select(F.col("vec_id").alias("id"), F.element_at(kinds, (F.col("label") % 4 + 1).cast("int")).alias("kind"), "embedding")
    linked = load(spark, sf_dir, "events").select(F.col("user_id").alias("a"), F.get_json_object("props", "$.k").cast("long").alias("b"))
    return L.conflicts(nodes, linked, 0.25).withColumn("sim", F.round("sim", 6))


@query(f"""WITH RECURSIVE {PAIRS_SQL}, n AS (SELECT a, b FROM p WHERE sim >= 0.3), l AS (SELECT a, b FROM n UNION ALL SELECT b, a FROM n), core AS (SELECT a AS c FROM l GROUP BY a HAVING count(*) >= 3),
  cl AS (SELECT a, b FROM l WHERE a IN (SELECT c FROM core) AND b IN (SELECT c FROM core)), r AS (SELECT c AS node, c AS root FROM core UNION SELECT cl.b, r.root FROM r JOIN cl ON cl.a = r.node), own AS (SELECT node, min(root) AS root FROM r GROUP BY 1),
  near AS (SELECT l.a AS node, min(root) AS root FROM l JOIN own ON own.node = l.b GROUP BY 1) SELECT vec_id AS id, coalesce(own.root, near.root, -1) AS cluster FROM embeddings LEFT JOIN own ON own.node = vec_id LEFT JOIN near ON near.node = vec_id""")
def l10_dbscan(spark, sf_dir):
    return L.dbscan_near(load(spark, sf_dir, "embeddings"), 0.3, 3)


@query()
def l11_kmeans(spark, sf_dir):
    return L.kmeans(load(spark, sf_dir, "embeddings"), 4, 5)


@query("SELECT label, count(*) AS size, round(avg(CAST(embedding[1] AS DOUBLE)), 6) AS first, round(avg(CAST(embedding[64] AS DOUBLE)), 6) AS last FROM embeddings GROUP BY label")
def l12_centroids(spark, sf_dir):
    c = L.centroids(load(spark, sf_dir, "embeddings"), "label")
    return c.select("label", "size", F.round(F.col("centroid")[0], 6).alias("first"), F.round(F.element_at("centroid", -1), 6).alias("last"))


@query("SELECT label, vec_id, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 20 AS part FROM embeddings")
def l13_split_clusters(spark, sf_dir):
    return L.split_oversized(load(spark, sf_dir, "embeddings").select("label", "vec_id"), "label", 20, "vec_id")


@query("""WITH RECURSIVE l AS (SELECT l_suppkey AS c, l_partkey AS m, l_linenumber AS n, [l_quantity, l_extendedprice / 1000, l_discount * 100, l_tax * 100] AS v FROM lineitem), o AS (SELECT DISTINCT c, m FROM l WHERE n <= 4), w AS (SELECT DISTINCT c, m FROM l WHERE n >= 3),
  so AS (SELECT c, count(*) AS n FROM o GROUP BY 1), sw AS (SELECT c, count(*) AS n FROM w GROUP BY 1), h AS (SELECT w.c AS new, o.c AS old, count(*) AS h FROM o JOIN w USING (m) GROUP BY ALL), j AS (SELECT new, old, h / (so.n + sw.n - h) AS score, 0 AS tier FROM h JOIN so ON so.c = old JOIN sw ON sw.c = new WHERE h / (so.n + sw.n - h) >= 0.05),
  m AS (SELECT c, n <= 4 AS is_old, n >= 3 AS is_new, i, v[i] AS x FROM l, range(1, 5) r(i)), vo AS (SELECT c, list(x ORDER BY i) AS v FROM (SELECT c, i, round(avg(x), 6) AS x FROM m WHERE is_old GROUP BY ALL) GROUP BY 1), vw AS (SELECT c, list(x ORDER BY i) AS v FROM (SELECT c, i, round(avg(x), 6) AS x FROM m WHERE is_new GROUP BY ALL) GROUP BY 1),
  f AS (SELECT vw.c AS new, vo.c AS old, round(list_cosine_similarity(vo.v, vw.v), 9) AS score, 1 AS tier FROM vo, vw WHERE round(list_cosine_similarity(vo.v, vw.v), 9) >= 0.998), e AS (SELECT * FROM j UNION ALL SELECT * FROM f),
  q AS (SELECT new, list({'old': old, 'tier': tier, 'score': score} ORDER BY tier, score DESC, old) AS prefs FROM e GROUP BY 1), t AS (SELECT *, row_number() OVER (ORDER BY new) AS t FROM q),
  r AS (SELECT CAST(0 AS BIGINT) AS t, CAST([] AS BIGINT[]) AS claimed, CAST(NULL AS BIGINT) AS new, CAST(NULL AS STRUCT("old" BIGINT, tier INTEGER, score DOUBLE)) AS best UNION ALL
    SELECT t, CASE WHEN best IS NULL THEN claimed ELSE list_append(claimed, best.old) END, new, best FROM (SELECT t.t, r.claimed, t.new, list_filter(t.prefs, lambda p: NOT list_contains(r.claimed, p.old))[1] AS best FROM r JOIN t ON t.t = r.t + 1))
  SELECT new, best.old AS old, round(best.score, 6) AS score, CASE best.tier WHEN 0 THEN 'members' ELSE 'centroid' END AS "by" FROM r WHERE best IS NOT NULL""")
def l15_identity_match(spark, sf_dir):
    """Suppliers as clusters of parts, by the first and the last lines of orders; centroids are means of four figures."""
    l = load(spark, sf_dir, "lineitem")  # noqa: E741
    figures = F.array("l_quantity", F.col("l_extendedprice") / 1000, F.col("l_discount") * 100, F.col("l_tax") * 100)

    def clusters(cond):
        rows = l.where(cond).select(F.col("l_suppkey").alias("cluster"), "l_partkey", figures.alias("v"))
        return rows.groupBy("cluster").agg(F.collect_set("l_partkey").alias("members")).join(L.vector_means(rows, ["cluster"], "v", name="centroid", digits=6).drop("size"), "cluster")

    return L.identity_matches(clusters("l_linenumber <= 4"), clusters("l_linenumber >= 3"), 0.05, 0.998).withColumn("score", F.round("score", 6))


@query("""WITH f AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, range(1, 65) t(i) GROUP BY ALL), c AS (SELECT label, list(round(m, 9) ORDER BY i) AS centroid FROM f GROUP BY 1),
  s AS (SELECT vec_id AS id, c.label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), centroid), 9) AS sim FROM embeddings, c) SELECT id, label, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, label) AS k FROM s) WHERE k = 1 AND sim >= 0.2""")
def l16_orphan_assignment(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    return L.nearest_centroid(e, L.centroids(e, "label"), "label", 0.2).withColumn("sim", F.round("sim", 6))


@query("SELECT s_suppkey AS node_id FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderdate > TIMESTAMP '2001-12-01')")
def l19_incremental_selection(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst"))
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node_id"), F.col("o_orderdate").alias("updated_at"))
    return L.changed_since(load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node_id")), lines, orders, "2001-12-01")


@query(f"WITH e AS {EDGES_SQL} SELECT src, dst, rel_type, last_used < TIMESTAMP '1997-01-01' OR src IN (SELECT src FROM e WHERE evidence > 2) AS stale, round(CASE WHEN last_used < TIMESTAMP '1997-01-01' OR src IN (SELECT src FROM e WHERE evidence > 2) THEN 1 - weight / 2 ELSE weight END, 6) AS dim_semantic FROM e")
def l23_edge_staleness(spark, sf_dir):
    e = graph_edges(spark, sf_dir)
    touched = e.where("evidence > 2").select("src", F.lit(True).alias("t")).distinct()
    stale = (F.col("last_used") < F.to_timestamp(F.lit("1997-01-01"))) | F.coalesce("t", F.lit(False))
    return e.join(touched, "src", "left").select("src", "dst", "rel_type", stale.alias("stale"), F.round(F.when(stale, 1 - F.col("weight") / 2).otherwise(F.col("weight")), 6).alias("dim_semantic"))


CATALOG_SQL = f"""n AS {NODES_SQL}, g AS (SELECT node_id, unnest(list_distinct(string_split(path, '/'))) AS segment FROM n), d AS (SELECT segment, count(*) AS df FROM g WHERE length(segment) >= 2 GROUP BY 1 HAVING count(*) <= (SELECT count(*) FROM n) / 2), c AS (SELECT row_number() OVER (ORDER BY df DESC, segment) - 1 AS bit, segment, df FROM d QUALIFY bit < 64)"""


@query(f"WITH {CATALOG_SQL} SELECT bit, segment, df FROM c")
def l24_context_catalog(spark, sf_dir):
    return L.catalog(graph_nodes(spark, sf_dir), 64)


@query(f"WITH {CATALOG_SQL} SELECT node_id, list_sort(list(DISTINCT bit)) AS fingerprint FROM g JOIN c USING (segment) GROUP BY node_id")
def l25_context_fingerprint(spark, sf_dir):
    nodes = graph_nodes(spark, sf_dir)
    return L.fingerprints(nodes, L.catalog(nodes, 64), "node_id")


@query("SELECT p_partkey, n > 5 AND k > 1 AS archived FROM (SELECT p_partkey, count(*) OVER (PARTITION BY p_name) AS n, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part)")
def l26_duplicate_names(spark, sf_dir):
    return L.keep_copies(load(spark, sf_dir, "part").select("p_partkey", "p_name"), ["p_name"], 5, [F.asc("p_partkey")]).select("p_partkey", "archived")


@query(f"SELECT node_id, confidence FROM {NODES_SQL} WHERE confidence >= 0.8 AND node_id NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50) ORDER BY confidence DESC, node_id LIMIT 20")
def l27_promotion_candidates(spark, sf_dir):
    done = load(spark, sf_dir, "lineitem").where("l_quantity >= 50").select(F.col("l_partkey").alias("node_id"))
    return graph_nodes(spark, sf_dir).where("confidence >= 0.8").join(done, "node_id", "left_anti").orderBy(F.desc("confidence"), "node_id").limit(20).select("node_id", "confidence")


@query("""SELECT coalesce(c.c_custkey, s.k) AS k, CASE WHEN s.k IS NULL OR c.v >= s.v THEN c.c_acctbal ELSE s.b END AS balance FROM (SELECT c_custkey, c_acctbal, c_nationkey AS v FROM customer) c FULL JOIN (SELECT s_suppkey AS k, s_acctbal AS b, s_nationkey AS v FROM supplier) s ON c.c_custkey = s.k""")
def l29_versioned_update(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_acctbal", F.col("c_nationkey").alias("vc"))
    s = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), "s_acctbal", F.col("s_nationkey").alias("vs"))
    return c.join(s, "k", "full").select("k", F.when(F.col("vs").isNull() | (F.col("vc") >= F.col("vs")), F.col("c_acctbal")).otherwise(F.col("s_acctbal")).alias("balance"))
