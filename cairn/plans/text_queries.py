"""Query understanding, chunking, symbols and further ranking and upkeep queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chunking as CH
from ..functions import intent as I
from ..functions import scalars as S
from ..operators import graph as G
from ..operators import rank as R
from ..plans.search_queries import BM25_SQL, VECTOR_SQL, activation_inputs, activation_sql, bfs_sql, scored_vectors, two_lists, walk_inputs
from ..sources.tables import EDGES_SQL, NODES_SQL, graph_edges, graph_nodes, load
from .registry import Registry

query = Registry()

#: Turns of conversations as search queries: part names stand in for code words.
SEARCHES_SQL = "(SELECT p_partkey AS id, CASE p_size % 6 WHEN 0 THEN 'where is ' WHEN 1 THEN 'class ' WHEN 2 THEN 'what calls ' WHEN 3 THEN 'input of ' WHEN 4 THEN 'design of ' ELSE '' END || p_name AS q FROM part)"


def searches(spark, sf_dir):
    k = F.col("p_size") % 6
    lead = F.when(k == 0, "where is ").when(k == 1, "class ").when(k == 2, "what calls ").when(k == 3, "input of ").when(k == 4, "design of ").otherwise("")
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(lead, "p_name").alias("q"), "p_size")


KIND = "CASE p_size % 6 WHEN 0 THEN 'symbol_lookup' WHEN 1 THEN 'code' WHEN 2 THEN 'relationship' WHEN 3 THEN 'data_flow' WHEN 4 THEN 'architecture' ELSE 'generic' END"


@query(f"""WITH k AS (SELECT p_partkey AS id, {KIND} AS kind FROM part) SELECT id, kind, CASE kind WHEN 'symbol_lookup' THEN 30 WHEN 'code' THEN 40 WHEN 'relationship' THEN 60 WHEN 'architecture' THEN 60 ELSE 50 END AS seeds,
  CASE kind WHEN 'symbol_lookup' THEN 0.85 WHEN 'code' THEN 0.75 WHEN 'relationship' THEN 0.6 WHEN 'data_flow' THEN 0.65 WHEN 'architecture' THEN 0.55 ELSE 0.5 END AS vector_weight, kind <> 'symbol_lookup' AS expand FROM k""")
def p6_retrieval_hints(spark, sf_dir):
    h = searches(spark, sf_dir).select("id", I.retrieval_hints(F.col("q")).alias("h"))
    return h.select("id", "h.kind", "h.seeds", "h.vector_weight", "h.expand")


@query("SELECT p_partkey AS id, CASE p_size % 6 WHEN 1 THEN 'code' WHEN 4 THEN 'architecture' ELSE 'generic' END AS kind, round(0.55 * CASE p_size % 6 WHEN 1 THEN 1.3 WHEN 4 THEN 0.85 ELSE 1 END, 6) AS vector_weight, CASE p_size % 6 WHEN 1 THEN 0.85 WHEN 4 THEN 1.25 ELSE 1.0 END AS concept_boost FROM part")
def p7_query_gates(spark, sf_dir):
    g = searches(spark, sf_dir).select("id", I.query_gates(F.col("q")).alias("g"))
    return g.select("id", "g.kind", F.round("g.vector_weight", 6).alias("vector_weight"), "g.concept_boost")


@query(f"SELECT node_id FROM {NODES_SQL} WHERE node_id NOT IN (SELECT l_partkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-06-01') AND starts_with(path, '/')")
def p10_orphans_since(spark, sf_dir):
    seen = load(spark, sf_dir, "lineitem").where(F.col("l_shipdate") >= F.to_timestamp(F.lit("2001-06-01"))).select(F.col("l_partkey").alias("node_id"))
    return graph_nodes(spark, sf_dir).where(F.col("path").startswith("/")).join(seen, "node_id", "left_anti").select("node_id")


@query(bfs_sql(2) + " SELECT e.src, e.dst, e.rel_type FROM e WHERE rel_type = 'CO_ACTIVATED_WITH' AND src IN (SELECT node_id FROM s2) AND dst IN (SELECT node_id FROM s2)")
def j5_neighbourhood_graph(spark, sf_dir):
    e, seeds = walk_inputs(spark, sf_dir)
    near = G.neighbourhood(e, seeds, 2, ["CO_ACTIVATED_WITH"])
    return G.both_ends(graph_edges(spark, sf_dir).where("rel_type = 'CO_ACTIVATED_WITH'"), near).select("src", "dst", "rel_type")


@query(f"WITH n AS {NODES_SQL} SELECT node_id, list_sort(list(DISTINCT l_suppkey)) AS symbols FROM n JOIN lineitem ON l_partkey = node_id WHERE layer = 1 GROUP BY node_id")
def j15_symbols_of_nodes(spark, sf_dir):
    s = load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("node_id"), "l_suppkey")
    return graph_nodes(spark, sf_dir).where("layer = 1").join(s, "node_id").groupBy("node_id").agg(F.sort_array(F.collect_set("l_suppkey")).alias("symbols"))


@query(f"""WITH {VECTOR_SQL}, a AS (SELECT node_id, row_number() OVER (ORDER BY round(score, 6) DESC, node_id) AS rank FROM v QUALIFY rank <= 20), x AS (SELECT node_id, 0 AS p, rank FROM a WHERE node_id % 9 = 0 AND rank > 5 UNION ALL SELECT node_id, 1, rank FROM a WHERE NOT (node_id % 9 = 0 AND rank > 5))
  SELECT node_id, row_number() OVER (ORDER BY p, rank) AS place FROM x ORDER BY place LIMIT 10""")
def k6_reference_quota(spark, sf_dir):
    """Rows of a second list beyond the first five go to the front."""
    a, _ = two_lists(spark, sf_dir, 20)
    up = (F.col("node_id") % 9 == 0) & (F.col("rank") > 5)
    o = a.select("node_id", F.struct((~up).alias("p"), "rank").alias("o"))
    from pyspark.sql import Window

    return o.withColumn("place", F.row_number().over(Window.orderBy("o"))).orderBy("place").limit(10).select("node_id", "place")


@query("""WITH f AS (SELECT l_orderkey AS node_id, list_distinct(list(l_suppkey % 16)) AS f FROM lineitem GROUP BY 1), j AS (SELECT node_id, round(len(list_intersect(f, [2, 4, 6])) / len(list_distinct(list_concat(f, [2, 4, 6]))), 9) AS score FROM f) SELECT node_id, row_number() OVER (ORDER BY score DESC, node_id) AS rank FROM j ORDER BY rank LIMIT 80""")
def g5_context_column(spark, sf_dir):
    f = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("node_id")).agg(F.collect_set(F.col("l_suppkey") % 16).alias("f"))
    j = f.select("node_id", F.round(S.jaccard(F.col("f"), F.array(*(F.lit(x).cast("long") for x in (2, 4, 6)))), 9).alias("score"))
    return R.ranked(j.orderBy(F.desc("score"), "node_id").limit(80)).select("node_id", "rank")


@query(f"WITH z AS ({activation_sql()}) SELECT node_id, row_number() OVER (ORDER BY activation DESC, node_id) AS rank FROM z ORDER BY rank LIMIT 80")
def g6_graph_column(spark, sf_dir):
    a = G.activation(*activation_inputs(spark, sf_dir)).select("node_id", F.round("activation", 6).alias("score"))
    return R.ranked(a.orderBy(F.desc("score"), "node_id").limit(80)).select("node_id", "rank")


@query(f"SELECT src, dst, rel_type, round(weight * CASE rel_type WHEN 'CO_ACTIVATED_WITH' THEN 0.9 WHEN 'ASSOCIATED_WITH' THEN 0.6 END, 6) AS weight FROM {EDGES_SQL} WHERE rel_type <> 'CONTRADICTS'")
def g9_edge_attention(spark, sf_dir):
    return G.edge_attention(graph_edges(spark, sf_dir), {"CO_ACTIVATED_WITH": 0.9, "ASSOCIATED_WITH": 0.6}).select("src", "dst", "rel_type", F.round("weight", 6).alias("weight"))


@query(f"WITH n AS {NODES_SQL} SELECT node_id, round(CASE WHEN contains(lower(path), 'supplier') THEN 0.5 + 0.5 * 8 / length(path) ELSE 0 END, 6) AS score FROM n")
def g14_path_score(spark, sf_dir):
    hints = F.array(F.lit("supplier"))
    n = graph_nodes(spark, sf_dir).withColumn("s", I.path_score(F.col("path"), hints))
    return n.select("node_id", F.round(F.when(F.lower("path").contains("supplier"), F.col("s")).otherwise(0.0), 6).alias("score"))


@query("SELECT p_partkey, CASE WHEN split_part(p_name, ' ', 1) = 'red' THEN 0.5 WHEN split_part(p_name, ' ', 2) = 'ring' THEN 0.7 ELSE 1.0 END AS boost FROM part")
def g16_code_type_boost(spark, sf_dir):
    w = F.split("p_name", " ")
    tags = F.array(F.when(w[0] == "red", "config").otherwise("x"), F.when(w[1] == "ring", "markdown").otherwise("y"))
    return load(spark, sf_dir, "part").select("p_partkey", I.code_type_boost(tags, F.lit(True)).alias("boost"))


@query("SELECT doc_id, regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g') AS text FROM documents")
def x5_control_characters(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "").alias("text"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def x13_canonical_time(spark, sf_dir):
    """Each order's date written as a changelog, version, metadata or plain line, and found again."""
    d = F.date_format("o_orderdate", "yyyy-MM-dd")
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, F.concat(F.lit("# log\n## [2.1] - "), d, F.lit("\nx"))).when(k == 1, F.concat(F.lit("Version 1.0 ("), d, F.lit(")"))).when(k == 2, F.concat(F.lit("title\nDate: "), d)).otherwise(F.concat(F.lit("on "), d, F.lit(" it was")))
    return load(spark, sf_dir, "orders").select("o_orderkey", I.canonical_date(text).alias("day"))


@query("SELECT doc_id, sum(length(replace(replace(text, chr(10), ''), ' ', ''))) AS letters FROM documents WHERE length(trim(text)) > 0 GROUP BY 1")
def x18_packed_chunks(spark, sf_dir):
    """Chunks of 256 tokens hold every letter of the text once."""
    ch = CH.packed(load(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", 256)
    return ch.groupBy("doc_id").agg(F.sum(F.length(F.replace(F.replace("content", F.lit("\n"), F.lit("")), F.lit(" "), F.lit("")))).alias("letters"))


@query("SELECT conv_id, turn, list_sort(list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: length(w) >= 4 AND w NOT IN ('that', 'with', 'from', 'this')))) AS terms FROM conversations")
def x19_key_terms(spark, sf_dir):
    stop = F.array(*map(F.lit, ("that", "with", "from", "this")))
    t = F.filter(S.words(F.col("text")), lambda w: (F.length(w) >= 4) & ~F.array_contains(stop, w))
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.sort_array(F.array_distinct(t)).alias("terms"))


@query("SELECT page_id, regexp_replace(url, '([+\\-!(){}\\[\\]^\"~*?:\\\\/&|])', '\\\\\\1', 'g') AS escaped FROM pages")
def x20_search_escaping(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", r'([+\-!(){}\[\]^"~*?:\\/&|])', r"\\$1").alias("escaped"))


@query("""SELECT p_partkey, round(least(1, 0.5 + CASE WHEN p_size % 3 = 0 THEN 0.2 + CASE WHEN p_size > 1 THEN 0.2 ELSE 0 END ELSE 0 END + CASE WHEN p_size % 2 = 0 THEN 0.15 ELSE 0 END + 0.1), 6) AS specificity FROM part""")
def x21_symbol_specificity(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    kind = F.when(F.col("p_size") % 3 == 0, "const").otherwise("func")
    name = F.when(F.col("p_size") % 2 == 0, "MAX_SIZE").otherwise("maxSize")
    return p.select("p_partkey", F.round(I.symbol_specificity(kind, name, F.col("p_size").cast("string"), F.lit(True), F.lit("")), 6).alias("specificity"))


@query("""SELECT event_id, '{"event_type":"' || event_type || '","user_id":' || user_id || '}' AS js FROM events""")
def x26_compact_json(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", F.to_json(F.struct("event_type", "user_id")).alias("js"))


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20' OR (event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-05')")
def st4_retention(spark, sf_dir):
    """Each class of rows keeps its own number of days before the newest."""
    kept = F.when(F.col("event_type") == "purchase", F.to_timestamp(F.lit("2024-01-05"))).otherwise(F.to_timestamp(F.lit("2024-01-20")))
    return load(spark, sf_dir, "events").where(F.col("ts") >= kept).select("event_id")


@query("SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 20 GROUP BY 1")
def st9_bounded_windows(spark, sf_dir):
    last = R.per_source_cap(load(spark, sf_dir, "events"), "user_id", 20, [F.desc("ts"), F.desc("event_id")])
    return last.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
