"""Query intent, observations, upkeep of the graph, exports and curation: queries that call an operator on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chunking as CH
from ..functions import intent as I
from ..functions import observations as O
from ..functions import rewards as RW
from ..functions import scalars as S
from ..operators import curate as C
from ..operators import graph as G
from ..operators import knowledge as K
from ..operators import learn as L
from ..operators import rank as R
from ..sources import files
from ..sources.scratch import fresh_path, stored
from ..sources.tables import EDGES_SQL, NODES_SQL, graph_edges, graph_nodes, load
from ..streaming import stream as ST
from . import consolidate, plugins
from .learning_queries import PAIRS_SQL
from .registry import Registry
from .search_queries import BM25_SQL, VECTOR_SQL, activation_inputs, activation_sql, scored_vectors, two_lists

query = Registry()


def contains_sql(text: str, keys) -> str:
    """SQL: the text has one of the keys."""
    return "(" + " OR ".join(f"contains({text}, '{k.replace(chr(39), chr(39) * 2)}')" for k in keys) + ")"


def list_sql(keys) -> str:
    return "(" + ", ".join("'" + k.replace("'", "''") + "'" for k in keys) + ")"


WORDS_SQL = "list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')"

# --- time and intent

#: A search query for each order, in one of nine wordings that carry its date.
ASKS_SQL = """(SELECT o_orderkey AS id, CASE o_orderkey % 9 WHEN 0 THEN 'issues in the last ' || (1 + o_orderkey % 20) || ' weeks' WHEN 1 THEN 'changes since ' || strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN 'Before ' || strftime(o_orderdate, '%B %Y') || ' all was well'
  WHEN 3 THEN 'between ' || strftime(o_orderdate, '%Y-%m-%d') || ' and 2002-01-01' WHEN 4 THEN 'what broke this week' WHEN 5 THEN 'recent updates to it' WHEN 6 THEN 'the latest order' WHEN 7 THEN 'since 2001-13-45 this month' ELSE 'order ' || o_orderkey END AS q, o_orderdate AS d FROM orders)"""


def asks(spark, sf_dir):
    o, k, day = load(spark, sf_dir, "orders"), F.col("o_orderkey") % 9, F.date_format("o_orderdate", "yyyy-MM-dd")
    q = (
        F.when(k == 0, F.concat(F.lit("issues in the last "), (1 + F.col("o_orderkey") % 20).cast("string"), F.lit(" weeks"))).when(k == 1, F.concat(F.lit("changes since "), day))
        .when(k == 2, F.concat(F.lit("Before "), F.date_format("o_orderdate", "MMMM yyyy"), F.lit(" all was well"))).when(k == 3, F.concat(F.lit("between "), day, F.lit(" and 2002-01-01"))).when(k == 4, "what broke this week")
        .when(k == 5, "recent updates to it").when(k == 6, "the latest order").when(k == 7, "since 2001-13-45 this month").otherwise(F.concat(F.lit("order "), F.col("o_orderkey").cast("string")))
    )
    return o.select(F.col("o_orderkey").alias("id"), q.alias("q"))


@query(f"""SELECT id, CASE WHEN id % 9 IN (0, 1, 2, 3, 4, 7) THEN 'hard' WHEN id % 9 IN (5, 6) THEN 'soft' ELSE 'none' END AS mode,
  CASE id % 9 WHEN 0 THEN TIMESTAMP '2003-01-15 10:30:00' - to_days(CAST(7 * (1 + id % 20) AS INT)) WHEN 1 THEN CAST(CAST(d AS DATE) AS TIMESTAMP) WHEN 3 THEN CAST(CAST(d AS DATE) AS TIMESTAMP) WHEN 4 THEN TIMESTAMP '2003-01-13' WHEN 7 THEN TIMESTAMP '2003-01-01' END AS after,
  CASE id % 9 WHEN 2 THEN CAST(date_trunc('month', d) AS TIMESTAMP) WHEN 3 THEN TIMESTAMP '2002-01-01' END AS before, CASE WHEN id % 9 IN (0, 1, 2, 3, 4, 7) THEN 0.9 WHEN id % 9 = 5 THEN 0.85 WHEN id % 9 = 6 THEN 0.7 ELSE 0.0 END AS confidence FROM {ASKS_SQL}""")
def p4_temporal_intent(spark, sf_dir):
    t = asks(spark, sf_dir).select("id", I.temporal_intent(F.col("q"), F.to_timestamp(F.lit("2003-01-15 10:30:00"))).alias("t"))
    return t.select("id", "t.mode", F.col("t.after").cast("timestamp_ntz").alias("after"), F.col("t.before").cast("timestamp_ntz").alias("before"), "t.confidence")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE coalesce(CASE WHEN l_returnflag <> 'N' THEN l_shipdate END, o_orderdate) >= TIMESTAMP '1996-01-01' AND coalesce(CASE WHEN l_returnflag <> 'N' THEN l_shipdate END, o_orderdate) < TIMESTAMP '1997-07-01'""")
def p3_time_range(spark, sf_dir):
    """A line's own time where it has one, else its order's."""
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    at = F.coalesce(F.when(F.col("l_returnflag") != "N", F.col("l_shipdate")), F.col("o_orderdate"))
    inside = I.in_range(at, F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1997-07-01").cast("timestamp_ntz"))
    return load(spark, sf_dir, "lineitem").join(o, "l_orderkey").where(inside).select("l_orderkey", "l_linenumber")


#: A search query for each part, with its name in one of nine wordings.
SEARCHES_SQL = """(SELECT p_partkey AS id, p_name, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, p_size, p_type, CASE p_size % 9 WHEN 0 THEN 'where is ' || p_name WHEN 1 THEN 'Class ' || p_name WHEN 2 THEN 'what calls ' || p_name WHEN 3 THEN 'input of ' || p_name WHEN 4 THEN 'design of ' || p_name
  WHEN 5 THEN 'difference between the ' || upper(split_part(p_name, ' ', 1)[1]) || split_part(p_name, ' ', 1)[2:] || 'Module and ' || split_part(p_name, ' ', 2) || ' parts' WHEN 6 THEN split_part(p_name, ' ', 1) || ' vs. ' || split_part(p_name, ' ', 2) WHEN 7 THEN 'compare ' || split_part(p_name, ' ', 1) || ' with ' || split_part(p_name, ' ', 2) || ', please' ELSE p_name END AS q FROM part)"""


def searches(spark, sf_dir):
    p, k, w = load(spark, sf_dir, "part"), F.col("p_size") % 9, F.split("p_name", " ")
    a, b = w[0], w[1]
    lead = lambda s: F.concat(F.lit(s), "p_name")
    q = (
        F.when(k == 0, lead("where is ")).when(k == 1, lead("Class ")).when(k == 2, lead("what calls ")).when(k == 3, lead("input of ")).when(k == 4, lead("design of "))
        .when(k == 5, F.concat(F.lit("difference between the "), F.initcap(a), F.lit("Module and "), b, F.lit(" parts"))).when(k == 6, F.concat(a, F.lit(" vs. "), b)).when(k == 7, F.concat(F.lit("compare "), a, F.lit(" with "), b, F.lit(", please"))).otherwise(F.col("p_name"))
    )
    return p.select(F.col("p_partkey").alias("id"), "p_name", "p_type", "p_size", q.alias("q"))


SYMBOL_SQL = f"({contains_sql('lower(q)', I.SYMBOL)} OR regexp_matches(q, '{I.SYMBOL_NAME}'))"
CODE_SQL = f"({contains_sql('lower(q)', I.CODE)} OR " + " OR ".join(f"ends_with(lower(q), '{k}') OR starts_with(lower(q), '{k} ')" for k in I.CODE_EDGES) + ")"


@query(f"""SELECT id, {SYMBOL_SQL} AS symbol, {CODE_SQL} AS code, {contains_sql("lower(q)", I.ARCHITECTURE)} AS architecture, {contains_sql("lower(q)", I.RELATIONSHIP)} AS relationship, {contains_sql("lower(q)", I.DATA_FLOW)} AS data_flow, p_size % 9 IN (5, 6, 7) AS comparison FROM {SEARCHES_SQL}""")
def p5_query_classifiers(spark, sf_dir):
    q, t = F.col("q"), F.lower("q")
    return searches(spark, sf_dir).select(
        "id", (I.any_of(t, I.SYMBOL) | q.rlike(I.SYMBOL_NAME)).alias("symbol"), I.is_code(q).alias("code"), I.is_architecture(q).alias("architecture"), I.any_of(t, I.RELATIONSHIP).alias("relationship"), I.any_of(t, I.DATA_FLOW).alias("data_flow"), I.is_comparison(q).alias("comparison")
    )


@query(f"""WITH s AS {SEARCHES_SQL}, t AS (SELECT *, CASE WHEN p_size % 9 IN (5, 6, 7) THEN list_sort(list_distinct(list_filter([lower(a), lower(b)], lambda x: length(x) > 2))) ELSE CAST([] AS VARCHAR[]) END AS targets FROM s)
  SELECT id, targets, CASE WHEN len(targets) = 0 THEN 0.0 WHEN p_size % 2 = 0 THEN 0.6 ELSE 0.2 END AS score FROM t""")
def g15_comparison(spark, sf_dir):
    """What each query compares, and the score of its own part: tagged comparison if its size is even."""
    s = searches(spark, sf_dir).withColumn("targets", I.comparison_targets(F.col("q")))
    tags = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("comparison"))).otherwise(F.array(F.lit("x")))
    return s.select("id", "targets", F.round(I.comparison_score(F.col("p_name"), F.col("p_type"), tags, F.col("targets")), 6).alias("score"))


# --- observations

TERM_SQL = """CASE WHEN strlen(w) < 2 THEN 0 WHEN regexp_matches(w, '\\p{Lu}') AND regexp_matches(w, '\\p{Ll}') THEN 0.3 WHEN regexp_matches(w, '^\\p{Lu}{2,}$') THEN 0.4 WHEN regexp_matches(w, '[_-]') AND strlen(w) > 5 THEN 0.2 WHEN regexp_matches(w, '(API|SDK|ORM|DB|Service|Manager|Handler)$') THEN 0.25 ELSE 0 END"""
NOVELTY_SQL = f"""(SELECT *, CASE WHEN len(s) = 0 THEN 0 ELSE least(1, list_sum(s) / len(s) * CASE WHEN len(list_filter(s, lambda x: x > 0)) > 0.3 * len(s) THEN 1.5 ELSE 1 END) END AS novelty
  FROM (SELECT *, list_transform(list_transform({WORDS_SQL}, lambda x: regexp_replace(x, '^[^\\p{{L}}\\p{{Nd}}_-]+|[^\\p{{L}}\\p{{Nd}}_-]+$', '', 'g')), lambda w: CAST({TERM_SQL} AS DOUBLE)) AS s FROM @t))"""


@query(f"SELECT conv_id, turn, round(novelty, 6) AS novelty FROM {NOVELTY_SQL.replace('@t', 'conversations')}")
def x7_term_novelty(spark, sf_dir):
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.round(O.term_novelty(F.col("text")), 6).alias("novelty"))


NEAR_SQL = "SELECT a.vec_id AS q, b.vec_id AS node, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0"
NEGATED_SQL = {m: (f"contains(lower(%s), '{m}')" if " " in m else "regexp_matches(lower(%s), '(^|[^a-z0-9_''])" + m.replace("'", "''") + "($|[^a-z0-9_''])')") for m in I.NEGATIONS}
DIFFERS_SQL = "(" + " OR ".join(f"{s % 'x.text'} <> {s % 'y.text'}" for s in NEGATED_SQL.values()) + ")"


def vectors(spark, sf_dir):
    """All vectors, and those whose id is divisible by 20 as queries."""
    e = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return e, e.where("vec_id % 20 = 0")


@query(f"""WITH n AS ({NEAR_SQL}), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, node) AS r FROM n) WHERE r <= 5 AND sim >= 0.2) SELECT q, node, round(sim, 6) AS sim FROM k JOIN documents x ON x.doc_id = q JOIN documents y ON y.doc_id = node WHERE {DIFFERS_SQL}""")
def j12_contradiction_candidates(spark, sf_dir):
    """A document's vector is that of its id."""
    texts = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    return K.contradiction_candidates(*vectors(spark, sf_dir), texts, 0.2, 5)


CORRECTS_SQL = "regexp_matches(text, '(?i)(" + "|".join(O.CORRECTIONS).replace("'", "''") + ")')"


@query(f"""WITH n AS ({NEAR_SQL}), o AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, node) AS r FROM n), k AS (SELECT q, greatest(0, least(1, 1 - avg(sim))) AS m FROM o WHERE r <= 50 AND sim >= 0.15 GROUP BY q),
  c AS (SELECT q, max(round(sim, 6)) AS c FROM o JOIN documents x ON x.doc_id = q JOIN documents y ON y.doc_id = node WHERE r <= 20 AND sim >= 0.15 AND {DIFFERS_SQL} GROUP BY q)
  SELECT doc_id, round(least(1, 0.4 * CASE WHEN {CORRECTS_SQL} THEN 0.9 ELSE 0 END + 0.25 * novelty + 0.25 * coalesce(m, 0.8) + 0.1 * coalesce(c, 0)), 5) AS surprise FROM {NOVELTY_SQL.replace("@t", "documents")} JOIN (SELECT vec_id FROM embeddings WHERE vec_id % 20 = 0) ON vec_id = doc_id LEFT JOIN k ON k.q = doc_id LEFT JOIN c ON c.q = doc_id""")
def x8_surprise(spark, sf_dir):
    e, q = vectors(spark, sf_dir)
    d = load(spark, sf_dir, "documents")
    near = K.embedding_novelty(e, q, 50, 0.15).withColumnRenamed("vec_id", "doc_id")
    against = K.contradiction_scores(K.contradiction_candidates(e, q, d.select(F.col("doc_id").alias("vec_id"), "text"), 0.15, 20)).withColumnRenamed("vec_id", "doc_id")
    text = F.col("text")
    total = O.surprise(O.correction(text), O.term_novelty(text), F.col("novelty"), F.coalesce("contradiction", F.lit(0.0)))
    return d.join(near, "doc_id").join(against, "doc_id", "left").select("doc_id", F.round(total, 5).alias("surprise"))


IDENT_SQL = """CASE WHEN strlen(i) < 2 THEN false ELSE regexp_matches(i, '\\p{Ll}\\p{Lu}|^.+\\p{Lu}\\p{Ll}') OR (contains(i, '_') AND regexp_matches(i, '\\p{Lu}|\\p{Ll}')) OR (contains(i, '.') AND regexp_matches(i, '\\p{Ll}') AND strlen(i) > 5) END"""
KIND_SQL = "CASE role WHEN 'user' THEN 'task' WHEN 'assistant' THEN 'decision' ELSE 'constraint' END"


@query(f"""WITH w AS (SELECT *, {WORDS_SQL} AS w, lower(text) AS t, {KIND_SQL} AS kind FROM conversations), c AS (SELECT *, len(w) AS n, len(list_filter(list_transform(w, lambda x: regexp_replace(x, '[.,;:!?()\\[\\]{{}}"''`]+$', '')), lambda i: {IDENT_SQL})) / nullif(len(w), 0) AS ident,
  len(list_filter(w, lambda x: regexp_replace(lower(x), '[.,;:!?]+$', '') IN {list_sql(O.VAGUE)})) / nullif(len(w), 0) AS vague FROM w),
  p AS (SELECT conv_id, turn, greatest(0, least(1, CASE WHEN n >= 30 THEN 0.3 WHEN n >= 15 THEN 0.2 WHEN n >= 5 THEN 0.1 ELSE 0 END + CASE WHEN ident >= 0.15 THEN 0.3 WHEN ident >= 0.08 THEN 0.2 WHEN ident >= 0.03 THEN 0.1 ELSE 0 END - CASE WHEN vague > 0.3 THEN 0.15 ELSE 0 END
    + CASE WHEN regexp_matches(text, '\\p{{Nd}}') THEN 0.1 ELSE 0 END + CASE WHEN contains(text, '/') AND ({contains_sql("text", O.PATHS)} OR starts_with(text, '/')) THEN 0.15 ELSE 0 END + CASE WHEN regexp_matches(text, '["''`]') THEN 0.1 ELSE 0 END)) AS specificity,
  least(1, CASE kind WHEN 'task' THEN 0.35 WHEN 'decision' THEN 0.4 ELSE 0.5 END + CASE WHEN {contains_sql("t", O.VERBS)} THEN 0.1 ELSE 0 END + CASE WHEN regexp_matches(t, '^({"|".join(O.IMPERATIVES)})') THEN 0.15 ELSE 0 END + CASE WHEN contains(t, 'because') OR contains(t, 'reason') THEN 0.1 ELSE 0 END) AS actionability,
  least(1, CASE WHEN turn % 4 >= 3 THEN 0.3 WHEN turn % 4 >= 1 THEN 0.15 ELSE 0 END + CASE WHEN conv_id % 4 >= 3 THEN 0.25 WHEN conv_id % 4 >= 1 THEN 0.1 ELSE 0 END + CASE WHEN contains(text, chr(10)) THEN 0.1 ELSE 0 END + CASE WHEN {contains_sql("text", (": ", " -> ", " → "))} THEN 0.1 ELSE 0 END
    + CASE WHEN {contains_sql("t", O.REFERENCES)} THEN 0.1 ELSE 0 END + CASE WHEN strlen(text) >= 200 THEN 0.15 WHEN strlen(text) >= 100 THEN 0.1 ELSE 0 END) AS context FROM c)
  SELECT conv_id, turn, round(specificity, 6) AS specificity, round(actionability, 6) AS actionability, round(context, 6) AS context, round(least(1, 0.4 * specificity + 0.35 * actionability + 0.25 * context), 6) AS overall FROM p""")
def x9_observation_quality(spark, sf_dir):
    """Turns with a kind by role, and numbers of tags and fields by turn and conversation."""
    kind = F.when(F.col("role") == "user", "task").when(F.col("role") == "assistant", "decision").otherwise("constraint")
    q = load(spark, sf_dir, "conversations").select("conv_id", "turn", O.observation_quality(F.col("text"), kind, F.col("turn") % 4, F.col("conv_id") % 4).alias("q"))
    return q.select("conv_id", "turn", *(F.round(f"q.{c}", 6).alias(c) for c in ("specificity", "actionability", "context", "overall")))


@query(f"""SELECT doc_id, array_to_string(list_filter({WORDS_SQL}, lambda w: regexp_replace(lower(w), '^[.,;:!?"'']+|[.,;:!?"'']+$', '', 'g') NOT IN {list_sql(O.FILLERS)}), ' ') AS compact, left(sha256(text), 8) AS short_id FROM documents""")
def x3_compact_text(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", O.telegraphic(F.col("text")).alias("compact"), O.abbreviated(F.sha2("text", 256), 8).alias("short_id"))


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), k AS (SELECT *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS t FROM l WHERE NOT ({contains_sql("lower(line)", O.INJECTIONS)} OR regexp_matches(line, '(?i)^\\s*(human|assistant|system|user)\\s*:') OR regexp_matches(line, '^\\s*`{{3,}}'))),
  g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - row_number() OVER (PARTITION BY doc_id, t ORDER BY i) AS g FROM k), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, t, g ORDER BY i) AS n FROM g), s AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS clean FROM r WHERE n <= 5 OR t = '' GROUP BY 1)
  SELECT d.doc_id, coalesce(clean, '') AS clean FROM documents d LEFT JOIN s USING (doc_id)""")
def x4_sanitise(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", O.sanitised(F.col("text")).alias("clean"))


# --- graph upkeep


@query(f"""WITH n AS (SELECT *, path || CASE layer WHEN 0 THEN '.go' WHEN 1 THEN '.tsx' WHEN 2 THEN '.md' WHEN 3 THEN '.sql' ELSE '' END AS p FROM {NODES_SQL}) SELECT split_part(p, '/', 2) AS prefix, CASE layer WHEN 0 THEN 'go' WHEN 1 THEN 'typescript' WHEN 2 THEN 'markdown' WHEN 3 THEN 'query' ELSE 'other' END AS class, count(*) AS n FROM n GROUP BY ALL""")
def l14_path_groups(spark, sf_dir):
    ending = F.when(F.col("layer") == 0, ".go").when(F.col("layer") == 1, ".tsx").when(F.col("layer") == 2, ".md").when(F.col("layer") == 3, ".sql").otherwise("")
    n = graph_nodes(spark, sf_dir).withColumn("p", F.concat("path", ending))
    return n.groupBy(O.path_prefix(F.col("p"), 1).alias("prefix"), O.extension_class(F.col("p")).alias("class")).agg(F.count("*").alias("n"))


TOGETHER_SQL = "(SELECT l_suppkey AS a, l_partkey AS b, round(avg(l_discount) * 10, 6) AS strength FROM lineitem WHERE l_suppkey < l_partkey GROUP BY ALL)"


def together(spark, sf_dir):
    """Pairs of ids that stand in one line, the smaller first."""
    return load(spark, sf_dir, "lineitem").where("l_suppkey < l_partkey").groupBy(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")).agg(F.round(F.avg("l_discount") * 10, 6).alias("strength"))


@query(f"""WITH {PAIRS_SQL}, t AS {TOGETHER_SQL}, s AS (SELECT t.a, t.b, round(list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), 9) AS sim FROM t JOIN embeddings x ON x.vec_id = t.a JOIN embeddings y ON y.vec_id = t.b)
  SELECT a, b, 'ANALOGOUS_TO' AS rel_type FROM p WHERE sim >= 0.35 AND a % 4 = b % 4 UNION ALL SELECT a, b, 'CONTRASTS_WITH' FROM s WHERE sim <= -0.1 UNION ALL SELECT a, b, 'COMPOSES_WITH' FROM t WHERE strength >= 0.9""")
def l21_dynamic_edges(spark, sf_dir):
    """The layer of a vector is its id modulo 4; thresholds fit vectors of which few are near."""
    t = K.Thresholds(analogous=0.35, contrasts=-0.1, composes=0.9)
    e = load(spark, sf_dir, "embeddings")
    nodes = e.select(F.col("vec_id").alias("id"), (F.col("vec_id") % 4).alias("layer"), "embedding")
    return K.dynamic_edges(nodes, L.near_pairs(nodes, t.analogous, "id", same="layer"), together(spark, sf_dir), t)


@query(f"""WITH t AS {TOGETHER_SQL}, l AS (SELECT a, b FROM t UNION SELECT b, a FROM t) SELECT a AS id, count(*) AS degree, count(DISTINCT p_brand) AS n_domains, count(*) >= 10 AS hub, count(DISTINCT p_brand) >= 3 AS bridge FROM l JOIN part ON p_partkey = b GROUP BY a""")
def l21_node_kinds(spark, sf_dir):
    domains = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("domain"))
    return K.node_kinds(together(spark, sf_dir).select("a", "b"), domains)


@query("""WITH o AS (SELECT vec_id AS id, unnest(list_distinct(CASE WHEN vec_id % 3 = 0 THEN ['c' || label] WHEN vec_id % 7 = 0 THEN ['c' || label, 'all'] ELSE CAST([] AS VARCHAR[]) END)) AS code, embedding, CAST(vec_id % 10 AS DOUBLE) / 10 AS confidence FROM embeddings)
  SELECT code, count(*) AS n, min(id) AS first, max(confidence) AS confidence, round(avg(CAST(embedding[1] AS DOUBLE)), 6) AS left, round(avg(CAST(embedding[64] AS DOUBLE)), 6) AS right FROM o GROUP BY code""")
def l22_constraint_nodes(spark, sf_dir):
    """Vectors as observations with tags by id and label."""
    label = F.concat(F.lit("constraint:c"), F.col("label").cast("string"))
    tags = F.when(F.col("vec_id") % 3 == 0, F.array(label, F.lit("x"), label)).when(F.col("vec_id") % 7 == 0, F.array(label, F.lit("constraint:all"))).otherwise(F.array(F.lit("x")))
    o = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), tags.alias("tags"), ((F.col("vec_id") % 10) / 10).alias("confidence"), "embedding")
    return K.tagged_nodes(o).select("code", "n", "first", "confidence", F.round(F.col("centroid")[0], 6).alias("left"), F.round(F.element_at("centroid", -1), 6).alias("right"))


CATEGORY_SQL = "(SELECT CASE WHEN layer = 0 THEN role_type || '-a-b-c' WHEN layer = 1 THEN role_type || '-a' ELSE role_type END AS category FROM " + NODES_SQL + ")"


@query(f"SELECT category, n, round(n / t, 6) AS share FROM (SELECT category, count(*) AS n, sum(count(*)) OVER () AS t FROM {CATEGORY_SQL} GROUP BY 1) WHERE n / t >= 0.05 AND len(string_split(category, '-')) < 4")
def l28_oversized_categories(spark, sf_dir):
    role = F.col("role_type")
    n = graph_nodes(spark, sf_dir).withColumn("category", F.when(F.col("layer") == 0, F.concat(role, F.lit("-a-b-c"))).when(F.col("layer") == 1, F.concat(role, F.lit("-a"))).otherwise(role))
    return K.oversized(n, "category", 0.05).withColumn("share", F.round("share", 6))


@query("SELECT user_id, count(*) AS edges, CASE WHEN count(*) <= 0 THEN 2.0 WHEN count(*) < 10000 THEN 1.0 WHEN count(*) < 50000 THEN 0.5 ELSE 0.25 END * CASE user_id % 4 WHEN 0 THEN 2.0 WHEN 1 THEN 1.5 WHEN 2 THEN 1.2 ELSE 1.0 END AS eta_multiplier FROM events GROUP BY user_id")
def l2_learning_rate(spark, sf_dir):
    e = load(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("edges"))
    kind = F.element_at(F.array(*map(F.lit, ("conversation", "config", "same_directory", "other"))), (F.col("user_id") % 4 + 1).cast("int"))
    return e.select("user_id", "edges", (S.phase_multiplier(F.col("edges")) * S.kind_multiplier(kind)).alias("eta_multiplier"))


@query(f"""WITH e AS {EDGES_SQL}, n AS {NODES_SQL}, l AS (SELECT src AS node_id FROM e UNION SELECT dst FROM e), c AS (SELECT least(9, CAST(floor(weight * 10) AS INT)) AS c, count(*) AS k FROM e GROUP BY 1)
  SELECT round((SELECT avg(CASE WHEN l.node_id IS NULL THEN 1.0 ELSE 0 END) FROM n LEFT JOIN l USING (node_id)), 6) AS orphan_ratio, round((SELECT avg(CASE WHEN role_type = 'supplier' THEN 1.0 ELSE 0 END) FROM n), 6) AS correction_rate, (SELECT date_diff('second', max(last_used), TIMESTAMP '2003-01-01') FROM e) AS consolidation_age,
  (SELECT count(*) FROM e) AS edge_count, round((SELECT avg(weight) FROM e), 6) AS mean_weight, round((SELECT avg(CASE WHEN weight < 0.3 THEN 1.0 ELSE 0 END) FROM e), 6) AS weak_ratio, round((SELECT -sum(k / t * log2(k / t)) FROM (SELECT k, sum(k) OVER () AS t FROM c)), 6) AS edge_entropy""")
def z7_self_assessment(spark, sf_dir):
    r = K.report_of(graph_nodes(spark, sf_dir), graph_edges(spark, sf_dir), F.col("role_type") == "supplier", F.to_timestamp(F.lit("2003-01-01")))
    return r.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in r.dtypes))


@query(f"""WITH e AS {EDGES_SQL}, n AS {NODES_SQL}, l AS (SELECT src AS node_id FROM e UNION SELECT dst FROM e), r AS (SELECT (SELECT avg(CASE WHEN l.node_id IS NULL THEN 1.0 ELSE 0 END) FROM n LEFT JOIN l USING (node_id)) AS o, (SELECT avg(CASE WHEN layer >= 2 THEN 1.0 ELSE 0 END) FROM n) AS c, (SELECT count(*) FROM e) AS n, (SELECT avg(CASE WHEN weight < 0.6 THEN 1.0 ELSE 0 END) FROM e) AS w, (SELECT avg(weight) FROM e) AS m)
  SELECT pattern FROM (SELECT unnest([CASE WHEN n >= 50000 THEN 'learning_saturation' END, CASE WHEN o > 0.2 THEN 'high_orphan_ratio' END, CASE WHEN c > 0.15 THEN 'high_correction_rate' END, 'stale_consolidation', CASE WHEN w > 0.3 THEN 'many_weak_edges' END, CASE WHEN n > 100 AND m < 0.2 THEN 'stale_edges' END]) AS pattern FROM r) WHERE pattern IS NOT NULL""")
def z8_reflection_rules(spark, sf_dir):
    return K.reflect(K.report_of(graph_nodes(spark, sf_dir), graph_edges(spark, sf_dir), F.col("layer") >= 2, F.to_timestamp(F.lit("2003-01-01")), weak=0.6)).select("pattern")


# --- curation


@query("""WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 8), q AS (SELECT source, n, greatest(1, CAST(round_even(90 * n / sum(n) OVER (), 0) AS INT)) AS q, row_number() OVER (ORDER BY n DESC, source) AS r FROM s), a AS (SELECT source, CASE WHEN r = 1 THEN greatest(1, q + 90 - (SELECT sum(q) FROM q)) ELSE q END AS q FROM q)
  SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256(CAST(doc_id AS VARCHAR))) AS k FROM documents) JOIN a USING (source) WHERE k <= q""")
def c16_golden_holdout(spark, sf_dir):
    return C.golden_rows(load(spark, sf_dir, "documents"), "source", "doc_id", 90, 8).select("doc_id", "source")


@query("""SELECT event_id, round(CASE event_type WHEN 'click' THEN CASE user_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.3 END WHEN 'view' THEN greatest(0, least(1, value / 20)) WHEN 'error' THEN CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) >= 70 OR event_id % 3 = 1 THEN 1.0 ELSE 0.0 END END WHEN 'purchase' THEN greatest(0, least(1, value / 10 - 0.5)) END, 6) AS quality FROM events""")
def c17_quality_annotation(spark, sf_dir):
    """Events as records of four tasks; an error's outcome is broken JSON, JSON without, or with, a confidence."""
    t = F.col("event_type")
    task = F.when(t == "click", "synthesize").when(t == "view", "evaluate").when(t == "error", "classify").when(t == "purchase", "rerank").otherwise("pending")
    k = F.get_json_object("props", "$.k")
    parsed = F.when(F.col("event_id") % 3 == 0, "{broken").when(F.col("event_id") % 3 == 1, '{"a": 1}').otherwise(F.concat(F.lit('{"confidence": '), (k.cast("int") / 100).cast("string"), F.lit("}")))
    outcome = F.when(t == "click", F.when(F.col("user_id") % 3 == 0, "followed").when(F.col("user_id") % 3 == 1, "ignored").otherwise("unknown")).otherwise(parsed)
    return load(spark, sf_dir, "events").select("event_id", F.round(C.task_quality(task, outcome, F.col("value") / 20, F.col("value") / 10 - 0.5), 6).alias("quality"))


@query("""WITH o AS (SELECT user_id AS g FROM events GROUP BY 1 HAVING bool_or(event_type = 'click') AND bool_or(event_type IN ('error', 'view'))), i AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey, c_name) AS k FROM customer)
  SELECT g AS guidance_id, min(c_name) FILTER (k = 1) AS chosen, min(c_name) FILTER (k = 2) AS rejected FROM o JOIN i ON c_nationkey = g GROUP BY g HAVING count(*) FILTER (k <= 2) = 2 AND NOT bool_or(k = 1 AND c_acctbal < 0)""")
def j16_outcome_pairs(spark, sf_dir):
    """Guidance is a number that events (outcomes) and customers (interactions) share; one whose balance is negative is private."""
    t = F.col("event_type")
    kind = F.when(t == "click", "followed").when(t == "error", "contradicted").when(t == "view", "ignored").otherwise("other")
    outcomes = load(spark, sf_dir, "events").select(F.col("user_id").alias("guidance_id"), kind.alias("outcome_type"))
    rows = load(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("guidance_id"), F.col("c_custkey").alias("time"), F.col("c_name").alias("response"), (F.col("c_acctbal") < 0).alias("private"))
    return C.outcome_pairs(outcomes, rows)


@query("""WITH s AS (SELECT n_nationkey AS spec, n_name AS task, md5(r_name) AS h, n_nationkey % 2 = 0 AS dynamic FROM nation JOIN region ON r_regionkey = n_regionkey), r AS (SELECT c_custkey AS row_id, CASE WHEN c_custkey % 3 > 0 THEN n_name END AS task, md5(r_name) AS h FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)
  SELECT spec, row_id FROM s JOIN r ON s.task = r.task UNION ALL SELECT spec, row_id FROM s JOIN r ON s.h = r.h WHERE r.task IS NULL AND NOT dynamic""")
def j17_spec_match(spark, sf_dir):
    """Nations as specs and customers as rows; every third row has no task, but its region's prompt."""
    r, n, c = (load(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    n = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))  # a row a nation
    specs = n.select(F.col("n_nationkey").alias("spec"), F.col("n_name").alias("task_name"), F.md5("r_name").alias("prompt_hash"), (F.col("n_nationkey") % 2 == 0).alias("dynamic"))
    rows = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("row_id"), F.when(F.col("c_custkey") % 3 > 0, F.col("n_name")).alias("task_name"), F.md5("r_name").alias("prompt_hash"))
    return C.rows_of_specs(specs, rows)


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE false END AS valid FROM events""")
def p14_schema_validation(spark, sf_dir):
    """Objects against required keys that they have, or lack; a text and white space against a schema of text."""
    k = F.col("event_id") % 4
    has = lambda keys: F.coalesce(RW.schema_match(F.col("props"), keys), F.lit(0.0)) == 1
    text = lambda c: F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))
    return load(spark, sf_dir, "events").select("event_id", F.when(k == 0, has(["k"])).when(k == 1, has(["k", "missing"])).when(k == 2, text(F.col("event_type"))).otherwise(text(F.lit("   "))).alias("valid"))


@query("""WITH s AS (SELECT p_name AS name, p_brand AS file, p_type AS package, p_partkey AS id FROM part), r AS (SELECT l_orderkey, l_linenumber, x.p_name AS name, y.p_brand AS file, y.p_type AS package, z.p_brand AS import FROM lineitem JOIN part x ON x.p_partkey = l_partkey JOIN part y ON y.p_partkey = l_suppkey JOIN part z ON z.p_partkey = l_linenumber),
  f AS (SELECT name, file, min(id) AS id FROM s GROUP BY ALL), k AS (SELECT name, package, min(id) AS id FROM s GROUP BY ALL), g AS (SELECT name, min(id) AS id FROM s GROUP BY 1 HAVING count(*) = 1), m AS (SELECT file AS import, min(id) AS id FROM s GROUP BY 1)
  SELECT l_orderkey, l_linenumber, coalesce(f.id, k.id, g.id, m.id) AS target, CASE WHEN f.id IS NOT NULL THEN 1.0 WHEN k.id IS NOT NULL THEN 0.9 WHEN g.id IS NOT NULL THEN 0.5 WHEN m.id IS NOT NULL THEN 0.7 END AS confidence FROM r LEFT JOIN f USING (name, file) LEFT JOIN k USING (name, package) LEFT JOIN g USING (name) LEFT JOIN m USING (import)""")
def j14_symbol_resolution(spark, sf_dir):
    """Each line refers to its part's name, from the place of the part with its supplier's number, and imports ./ the brand of the part with its line's number."""
    p = load(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("file"), F.col("p_type").alias("package"), F.col("p_partkey").alias("id"))
    refs = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(p.select(F.col("id").alias("l_partkey"), "name"), "l_partkey").join(p.select(F.col("id").alias("l_suppkey"), "file", "package"), "l_suppkey")
    refs = refs.join(p.select(F.col("id").alias("l_linenumber"), F.concat(F.lit("./"), "file").alias("import_path")), "l_linenumber")
    return files.resolved(refs, p).select("l_orderkey", "l_linenumber", "target", "confidence")


@query("""WITH w AS (SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS n, sum(o_totalprice) OVER (ORDER BY o_orderdate DESC, o_orderkey) AS s FROM orders WHERE o_orderstatus <> 'P' AND o_orderdate >= TIMESTAMP '1995-06-01') SELECT o_orderkey FROM w WHERE n <= 2000 AND s <= 300000000 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'""")
def s15_retention(spark, sf_dir):
    """Orders as backups with a size: the newest 2,000 of an age, as far as their sizes fit; pinned ones besides."""
    fresh = F.col("o_orderdate") >= F.lit("1995-06-01").cast("timestamp_ntz")
    return files.retained(load(spark, sf_dir, "orders"), [F.desc("o_orderdate"), F.asc("o_orderkey")], "o_totalprice", 2000, 300_000_000, fresh, F.col("o_orderstatus") == "P").select("o_orderkey")


# --- exports and loads


@query("SELECT event_type AS task, count(*) AS n, count(*) FILTER (user_id % 10 = 0) AS n_private, true AS verified, count(*) AS n_read FROM events WHERE event_type <> 'error' GROUP BY 1")
def s4_table_export(spark, sf_dir):
    """Events without errors exported as JSON lines with counts and hashes, the hashes verified, and the rows read again."""
    e = load(spark, sf_dir, "events").where("event_type <> 'error'")
    path = fresh_path(spark)
    counts, manifest = files.export_table(e, path, ["ts", "event_type", "value"], "event_type", F.col("user_id") % 10 == 0)
    ok = files.verified(spark, path, manifest).agg(F.bool_and("ok").alias("verified"))
    again = files.read_jsonl(spark, path, e.select("ts", "event_type", "value").schema, None).groupBy(F.col("event_type").alias("task")).agg(F.count("*").alias("n_read"))
    return counts.join(again, "task").crossJoin(ok)  # one row


@query("SELECT role, count(*) AS n, sum(length(text)) AS chars FROM conversations GROUP BY 1")
def s5_load_tagged(spark, sf_dir):
    """Conversations written as a folder of JSON lines a role beside files that don't parse; a row's role is read from its file's path."""
    c, path = load(spark, sf_dir, "conversations"), fresh_path(spark)
    files.write_jsonl(c.select("conv_id", "turn", "text", "role"), path, ["role"])
    c.select(F.concat(F.lit('{"conv_id": '), F.col("conv_id").cast("string"), F.lit(', "text": "')).alias("value")).write.mode("append").text(f"{path}/role=broken")
    rows = files.read_jsonl(spark, f"{path}/*", c.select("conv_id", "turn", "text").schema)
    return rows.groupBy(F.regexp_extract("source_file", "role=([^/]*)", 1).alias("role")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def s2_batch_append(spark, sf_dir):
    """Events appended in two batches to a table by day, and read back."""
    e, path = load(spark, sf_dir, "events").withColumnRenamed("ts", "time"), fresh_path(spark)
    for part in (0, 1):
        files.write_batch(e.where(F.col("event_id") % 2 == part), path)
    return spark.read.parquet(path).groupBy("day").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"SELECT layer, count(*) AS n, count(DISTINCT role_type) AS roles, coalesce(count(DISTINCT rel_type), 0) AS edge_types, max(last_used) AS updated FROM {NODES_SQL} LEFT JOIN (SELECT src, rel_type, last_used FROM {EDGES_SQL}) ON src = node_id GROUP BY layer".replace("count(*) AS n", "count(DISTINCT node_id) AS n"))
def s10_space_inventory(spark, sf_dir):
    e = graph_edges(spark, sf_dir).groupBy(F.col("src").alias("node_id")).agg(F.collect_set("rel_type").alias("types"), F.max("last_used").alias("last"))  # three types at most
    n = graph_nodes(spark, sf_dir).join(e, "node_id", "left")
    counts = n.groupBy("layer").agg(F.count("*").alias("n"), F.countDistinct("role_type").alias("roles"), F.max("last").alias("updated"))
    types = n.select("layer", F.explode_outer("types").alias("t")).groupBy("layer").agg(F.countDistinct("t").alias("edge_types"))
    return counts.join(types, "layer")


@query("""SELECT conv_id, turn AS section, 2 AS level, CASE WHEN conv_id % 2 = 0 THEN 'Guide' ELSE 'Conversation ' || conv_id END AS title, CASE role WHEN 'user' THEN 'What does ''user'' mean in ' || CASE WHEN conv_id % 2 = 0 THEN 'Guide' ELSE 'Conversation ' || conv_id END || '?' WHEN 'assistant' THEN 'using assistant, according to ' || CASE WHEN conv_id % 2 = 0 THEN 'Guide' ELSE 'Conversation ' || conv_id END || '?'
  ELSE 'What are the options of ' || CASE WHEN conv_id % 2 = 0 THEN 'Guide' ELSE 'Conversation ' || conv_id END || '?' END AS prompt, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS words FROM conversations WHERE len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) >= 20""")
def s14_markdown_questions(spark, sf_dir):
    """Conversations as markdown pages, half of them with a title at the top, cut into questions and answers."""
    heading = F.when(F.col("role") == "user", "user").when(F.col("role") == "assistant", "Using assistant").otherwise("Options")
    part = F.struct("turn", F.concat(F.lit("## "), heading, F.lit("\n"), "text").alias("p"))
    pages = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(part)).alias("ps"))
    body = F.array_join(F.transform("ps", lambda x: x["p"]), "\n")
    text = F.concat(F.when(F.col("conv_id") % 2 == 0, '---\ntitle: "Guide"\nlang: en\n---\n').otherwise("Lead.\n"), body)
    rows = CH.question_rows(pages.select("conv_id", text.alias("text")), "conv_id", "text", F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")), 20)
    return rows.select("conv_id", F.col("section").cast("long").alias("section"), "level", "title", "prompt", F.col("words").cast("long").alias("words"))


# --- whole tables, and large keys in several tasks


@query("SELECT source, sum(k) AS n, sha256(string_agg(d, '' ORDER BY b)) AS digest FROM (SELECT source, doc_id // 10000 AS b, sha256(string_agg(sha256(text), '' ORDER BY doc_id)) AS d, count(*) AS k FROM documents GROUP BY ALL) GROUP BY 1")
def s7_export_digest(spark, sf_dir):
    """A digest of each source's rows in order of id, over digests of ranges of 10,000 ids: compared with the exporter's to verify a copy."""
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(c, "d"))), lambda x: x["d"]), "")
    d = load(spark, sf_dir, "documents").select("source", "doc_id", F.floor(F.col("doc_id") / 10_000).alias("b"), F.sha2("text", 256).alias("d"))
    ranges = d.groupBy("source", "b").agg(F.sha2(joined("doc_id"), 256).alias("d"), F.count("*").alias("k"))
    return ranges.groupBy("source").agg(F.sum("k").alias("n"), F.sha2(joined("b"), 256).alias("digest"))


@query("""WITH e AS (SELECT user_id, CASE event_type WHEN 'click' THEN 1.0 WHEN 'error' THEN 0.0 ELSE 0.5 END AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS k FROM events) SELECT user_id, round(0.5 * pow(0.9, count(*)) + 0.1 * sum(x * pow(0.9, k)), 6) AS trust FROM e GROUP BY user_id""")
def x24_trust(spark, sf_dir):
    """Trust moves a tenth of the way to each outcome, so that an outcome k steps back counts 0.1 * 0.9^k: a sum, and no list of a user's history."""
    x = F.when(F.col("event_type") == "click", 1.0).when(F.col("event_type") == "error", 0.0).otherwise(0.5)
    rows = load(spark, sf_dir, "events").withColumn("x", x)
    return C.decayed_trust(rows, ["user_id"], "x", [F.desc("ts"), F.desc("event_id")]).withColumn("trust", F.round("trust", 6))


@query("""SELECT doc_id, sum(1) OVER (PARTITION BY source) AS peers, CAST(sum(t) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS used FROM (SELECT doc_id, source, CAST(floor(length(text) / 4 + 0.5) AS BIGINT) AS t FROM documents) QUALIFY used <= 5000""")
def w6_token_budget(spark, sf_dir):
    t = load(spark, sf_dir, "documents").select("doc_id", "source", S.token_estimate(F.col("text")).alias("t"))
    return R.running_sum(t, ["source"], "doc_id", "t").where("running <= 5000").select("doc_id", "peers", F.col("running").cast("long").alias("used"))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR))) AS k, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE k <= greatest(1, CAST(floor(n * 0.05) AS INT))")
def c11_golden_carve(spark, sf_dir):
    d = R.nth_by_hash(load(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], F.md5(F.col("doc_id").cast("string")))
    return d.where(F.col("nth") <= F.greatest(F.lit(1), F.floor(F.col("peers") * 0.05))).select("doc_id")


@query("""SELECT round((count(*) FILTER (event_type <> 'view') / count(*)) * (count(*) FILTER (event_type = 'click') / nullif(count(*) FILTER (event_type IN ('click', 'view', 'error')), 0)) * ((SELECT count(DISTINCT user_id) FROM events SEMI JOIN customer ON c_custkey = user_id) / (SELECT count(*) FROM customer)), 6) AS score FROM events""")
def a14_determinism_score(spark, sf_dir):
    """Informed share, times followed share, times the share of all customers that take part."""
    t = F.col("event_type")
    customers = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    taking = load(spark, sf_dir, "events").join(customers, "user_id", "left_semi").agg(F.countDistinct("user_id").alias("k"))
    informed, followed = F.count_if(t != "view") / F.count("*"), F.count_if(t == "click") / F.nullif(F.count_if(t.isin("click", "view", "error")), F.lit(0))
    e = load(spark, sf_dir, "events").agg((informed * followed).alias("x"))
    return e.crossJoin(taking).crossJoin(customers.agg(F.count("*").alias("n"))).select(F.round(F.col("x") * F.col("k") / F.col("n"), 6).alias("score"))  # one row each


PASS_EDGES = "SELECT l_suppkey AS src, l_partkey AS dst, round(avg(l_discount) * 10, 6) + 0.1 AS weight FROM lineitem GROUP BY ALL"


def pass_inputs(spark, sf_dir):
    nodes = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), "embedding")
    edges = load(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).agg((F.round(F.avg("l_discount") * 10, 6) + 0.1).alias("weight"))
    return nodes, edges


@query(f"WITH e AS ({PASS_EDGES}), m AS (SELECT dst, sum(weight * embedding[1]) / sum(weight) AS a, sum(weight * embedding[64]) / sum(weight) AS z FROM e JOIN embeddings ON vec_id = src GROUP BY 1) SELECT vec_id AS node_id, round(CASE WHEN a IS NULL THEN CAST(embedding[1] AS DOUBLE) ELSE 0.6 * CAST(embedding[1] AS DOUBLE) + 0.4 * a END, 6) AS first, round(CASE WHEN a IS NULL THEN CAST(embedding[64] AS DOUBLE) ELSE 0.6 * CAST(embedding[64] AS DOUBLE) + 0.4 * z END, 6) AS last FROM embeddings LEFT JOIN m ON dst = vec_id")
def l17_forward_pass(spark, sf_dir):
    """Suppliers' and parts' numbers name vectors; ids without one send and take nothing."""
    out = L.message_pass(*pass_inputs(spark, sf_dir), 0.6, 0.4, digits=12)
    return out.select("node_id", F.round(F.col("embedding")[0], 6).alias("first"), F.round(F.element_at("embedding", -1), 6).alias("last"))


@query(f"WITH e AS ({PASS_EDGES}), m AS (SELECT src, sum(weight * embedding[1]) / sum(weight) AS a FROM e JOIN embeddings ON vec_id = dst GROUP BY 1) SELECT vec_id AS node_id, round(CASE WHEN a IS NULL THEN CAST(embedding[1] AS DOUBLE) ELSE 0.8 * CAST(embedding[1] AS DOUBLE) + 0.2 * a END, 6) AS first FROM embeddings LEFT JOIN m ON src = vec_id")
def l18_backward_pass(spark, sf_dir):
    nodes, edges = pass_inputs(spark, sf_dir)
    out = L.message_pass(nodes, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"), 0.8, 0.2, digits=12)
    return out.select("node_id", F.round(F.col("embedding")[0], 6).alias("first"))


@query(f"WITH {VECTOR_SQL}, e AS (SELECT l_suppkey AS src, l_partkey AS dst, round(avg(l_discount) * 10, 6) AS weight FROM lineitem GROUP BY ALL), r AS (SELECT src, dst, round(0.5 * score + 0.5 * (0.4 * weight + 0.3), 6) AS attention FROM e JOIN v ON node_id = dst) SELECT src, dst, greatest(0, least(1, attention)) AS attention FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY attention DESC, dst) AS n FROM r) WHERE n <= 10")
def g11_query_attention(spark, sf_dir):
    e = load(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).agg(F.round(F.avg("l_discount") * 10, 6).alias("weight"))
    r = e.join(scored_vectors(spark, sf_dir).withColumnRenamed("node_id", "dst"), "dst").select("src", "dst", F.round(0.5 * F.col("score") + 0.5 * (0.4 * F.col("weight") + 0.3), 6).alias("attention"))
    return R.per_source_cap(r, "src", 10, [F.desc("attention"), F.asc("dst")]).withColumn("attention", S.clamp(F.col("attention")))


#: Triangles that share an edge, then clusters that share two nodes, twice: no cluster of these tables merges a third time.
MERGED_SQL = """s{n} AS (SELECT x.k AS x, y.k AS y FROM (SELECT DISTINCT k, unnest([a, b, c]) AS node FROM c{m}) x JOIN (SELECT DISTINCT k, unnest([a, b, c]) AS node FROM c{m}) y USING (node) WHERE x.k <> y.k GROUP BY ALL HAVING count(*) >= 2),
  r{n} AS (SELECT DISTINCT k AS node, k AS root FROM c{m} UNION SELECT s{n}.y, r{n}.root FROM r{n} JOIN s{n} ON s{n}.x = r{n}.node), c{n} AS (SELECT a, b, c, root AS k FROM c{m} JOIN (SELECT node, min(root) AS root FROM r{n} GROUP BY 1) ON node = k)"""


@query(f"""WITH RECURSIVE {PAIRS_SQL}, l AS (SELECT a, b FROM p WHERE sim >= 0.35), t AS (SELECT x.a, x.b, y.b AS c FROM l x JOIN l y ON x.b = y.a JOIN l z ON z.a = x.a AND z.b = y.b), c0 AS (SELECT a, b, c, {{'a': a, 'b': b, 'c': c}} AS k FROM t), {MERGED_SQL.format(n=1, m=0)}, {MERGED_SQL.format(n=2, m=1)}, {MERGED_SQL.format(n=3, m=2)}
  SELECT a, b, c, k.a || '-' || k.b || '-' || k.c AS cluster FROM c3""")
def g20_triangles(spark, sf_dir):
    """Triangles of vectors that are near one another, and their clusters."""
    e = L.near_pairs(load(spark, sf_dir, "embeddings"), 0.35).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("NEAR").alias("rel_type"))
    return G.triangle_clusters(e)


@query(f"""WITH {VECTOR_SQL}, d AS (SELECT l_partkey AS node_id, count(*) AS degree FROM lineitem GROUP BY 1), x AS (SELECT node_id, round(greatest(0, score), 9) AS s, label / 10.0 AS act, CASE WHEN degree > 30 THEN -0.2 ELSE 0.0 END AS hub, CASE WHEN label % 2 = 0 THEN 0.05 ELSE 0.0 END AS learned FROM v JOIN d USING (node_id))
  SELECT node_id, CASE WHEN s >= 0.2 THEN 'Strong' WHEN s >= 0.1 THEN 'Moderate' ELSE 'Weak' END AS strength, round(greatest(0, least(1, s + CASE WHEN act > 0.1 THEN 0.1 ELSE 0 END + CASE WHEN learned > 0.01 THEN 0.05 ELSE 0 END - CASE WHEN hub < -0.1 THEN 0.1 ELSE 0 END)), 6) AS confidence,
  list_filter(['vector_recall', CASE WHEN act > 0.01 THEN 'spreading_activation' END, CASE WHEN learned > 0.01 THEN 'learning_edge' END], lambda p: p IS NOT NULL) AS path FROM x""")
def g18_score_explanation(spark, sf_dir):
    d = load(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("node_id")).agg(F.count("*").alias("degree"))
    v = scored_vectors(spark, sf_dir).join(d, "node_id")
    parts = {"vector": F.round(F.greatest(F.lit(0.0), F.col("score")), 9), "activation": F.col("label") / 10, "hub": F.when(F.col("degree") > 30, -0.2).otherwise(0.0), "learning": F.when(F.col("label") % 2 == 0, 0.05).otherwise(0.0)}
    x = v.select("node_id", O.explained(parts, medium=0.1, strong=0.2).alias("x"))
    return x.select("node_id", "x.strength", F.round("x.confidence", 6).alias("confidence"), "x.path")


@query(f"""WITH {VECTOR_SQL}, {BM25_SQL}, z AS ({activation_sql()}), fp AS (SELECT l_partkey AS node_id, list_distinct(list(l_suppkey % 16)) AS f FROM lineitem GROUP BY 1), vc AS (SELECT node_id, 0.5 AS w, row_number() OVER (ORDER BY round(score, 6) DESC, node_id) AS r FROM v QUALIFY r <= 80 UNION ALL SELECT node_id, 0.2, row_number() OVER (ORDER BY round(score, 6) DESC, node_id) AS r FROM b QUALIFY r <= 80
  UNION ALL SELECT node_id, 0.15, row_number() OVER (ORDER BY activation DESC, node_id) AS r FROM z QUALIFY r <= 80 UNION ALL SELECT node_id, 0.15, row_number() OVER (ORDER BY round(len(list_intersect(f, [2, 4, 6])) / len(list_distinct(list_concat(f, [2, 4, 6]))), 9) DESC, node_id) AS r FROM fp QUALIFY r <= 80) SELECT node_id, round(sum(w / (60 + r)), 9) AS score FROM vc GROUP BY node_id ORDER BY 2 DESC, 1 LIMIT 20""")
def g4_virtual_columns(spark, sf_dir):
    """Vector, BM25, graph and context columns fused, each with four times the final number of rows."""
    a, b = two_lists(spark, sf_dir, 80)
    g = G.activation(*activation_inputs(spark, sf_dir)).select("node_id", F.round("activation", 6).alias("score"))
    f = load(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("node_id")).agg(F.collect_set(F.col("l_suppkey") % 16).alias("f"))
    c = f.select("node_id", F.round(S.jaccard(F.col("f"), F.array(*(F.lit(x).cast("long") for x in (2, 4, 6)))), 9).alias("score"))
    top = lambda df: R.ranked(df.orderBy(F.desc("score"), "node_id").limit(80))
    out = R.consensus({"vector": a, "bm25": b, "graph": top(g), "context": top(c)}, {"vector": 0.5, "bm25": 0.2, "graph": 0.15, "context": 0.15})
    return out.select("node_id", F.round("score", 9).alias("score")).orderBy(F.desc("score"), "node_id").limit(20)


@query(activation_sql(True))
def g21_seed_expansion(spark, sf_dir):
    seeds, edges = activation_inputs(spark, sf_dir)
    return K.expanded_seeds(seeds, edges, {"CO_ACTIVATED_WITH": 0.9, "ASSOCIATED_WITH": 0.6}).withColumn("activation", F.round("activation", 6))


@query("SELECT outcome, count(*) AS n, round(avg(strength), 6) AS mean FROM (SELECT event_type AS outcome, value AS strength FROM events WHERE event_type IN ('click', 'error') UNION ALL SELECT o_orderstatus, o_totalprice FROM orders UNION ALL SELECT l_returnflag, l_extendedprice FROM lineitem) GROUP BY 1")
def u1_outcome_union(spark, sf_dir):
    """Three tables of outcomes under one name and measure."""
    e, o, l = (load(spark, sf_dir, t) for t in ("events", "orders", "lineitem"))  # noqa: E741
    rows = e.where("event_type in ('click', 'error')").select(F.col("event_type").alias("outcome"), F.col("value").alias("strength"))
    rows = rows.unionByName(o.select(F.col("o_orderstatus").alias("outcome"), F.col("o_totalprice").alias("strength"))).unionByName(l.select(F.col("l_returnflag").alias("outcome"), F.col("l_extendedprice").alias("strength")))
    return rows.groupBy("outcome").agg(F.count("*").alias("n"), F.round(F.avg("strength"), 6).alias("mean"))


@query(f"""WITH e AS {EDGES_SQL}, h AS (SELECT src, dst, rel_type, CASE WHEN date_diff('day', CAST(last_used AS DATE), DATE '2003-01-01') > 365 THEN weight / 2 ELSE weight END AS w, evidence, last_used FROM e), d AS (SELECT rel_type, w * exp(-0.0003 * date_diff('day', CAST(last_used AS DATE), DATE '2003-01-01')) AS w, evidence FROM h),
  {PAIRS_SQL}, n AS (SELECT 'ANALOGOUS_TO' AS rel_type, 0.5 AS w FROM p WHERE sim >= 0.35), k AS (SELECT rel_type, w FROM d WHERE w > 0 AND NOT (w < 0.05 AND evidence < 2) UNION ALL SELECT rel_type, w FROM n) SELECT rel_type, count(*) AS edges, round(avg(w), 6) AS mean FROM k GROUP BY 1""")
def l20_consolidation(spark, sf_dir):
    """Phases in order, without emergence, over the graph's edges and the vectors as base nodes."""
    nodes = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), F.lit(0).alias("layer"), "embedding")
    out = consolidate.run(consolidate.Space(nodes, graph_edges(spark, sf_dir), "2003-01-01", 0.35), skip={"emergence"})
    return out.edges.groupBy("rel_type").agg(F.count("*").alias("edges"), F.round(F.avg("weight"), 6).alias("mean"))


@query(f"""WITH RECURSIVE {PAIRS_SQL}, n AS (SELECT a, b FROM p WHERE sim >= 0.35), l AS (SELECT a, b FROM n UNION ALL SELECT b, a FROM n), core AS (SELECT a AS c FROM l GROUP BY a HAVING count(*) >= 2), cl AS (SELECT a, b FROM l WHERE a IN (SELECT c FROM core) AND b IN (SELECT c FROM core)), r AS (SELECT c AS node, c AS root FROM core UNION SELECT cl.b, r.root FROM r JOIN cl ON cl.a = r.node),
  own AS (SELECT node, min(root) AS root FROM r GROUP BY 1), near AS (SELECT l.a AS node, min(root) AS root FROM l JOIN own ON own.node = l.b GROUP BY 1), k AS (SELECT vec_id AS node_id, coalesce(own.root, near.root) AS cluster, embedding FROM embeddings LEFT JOIN own ON own.node = vec_id LEFT JOIN near ON near.node = vec_id)
  SELECT -cluster - 1 AS node_id, count(*) AS size, round(avg(CAST(embedding[1] AS DOUBLE)), 5) AS first FROM k WHERE cluster IS NOT NULL GROUP BY cluster""")
def l20_emergent_nodes(spark, sf_dir):
    """The nodes that clusters of near vectors become, and how many members are linked to each."""
    nodes = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), F.lit(0).alias("layer"), "embedding")
    out = consolidate.run(consolidate.Space(nodes, graph_edges(spark, sf_dir), "2003-01-01", 0.35), skip={"refresh", "dynamic_edges", "summary"}, last=22)
    sizes = out.edges.where("rel_type = 'MEMBER_OF'").groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("size"))
    return out.nodes.where("layer = 1").join(sizes, "node_id").select("node_id", "size", F.round(F.col("embedding")[0].cast("double"), 5).alias("first"))


@query("SELECT event_type AS task, count(*) AS n, min(ts) AS first, max(ts) AS last, true AS written FROM events GROUP BY 1")
def s6_split_statistics(spark, sf_dir):
    """Events written as JSON lines, and the statistics of what was written."""
    e, path = load(spark, sf_dir, "events").select("ts", "event_type", "value"), fresh_path(spark)
    files.write_jsonl(e, path)
    again = files.read_jsonl(spark, path, e.schema, None)
    hashed = files.file_hashes(spark, path).agg((F.count("*") > 0).alias("written"))
    return again.groupBy(F.col("event_type").alias("task")).agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last")).crossJoin(hashed)  # one row


@query("SELECT DISTINCT user_id, event_type FROM events")
def st2_micro_batches(spark, sf_dir):
    """The events read as a stream of the folder's files of one ending, appended in micro-batches, and read back."""
    schema = load(spark, sf_dir, "events").schema
    out = fresh_path(spark)
    source = ST.file_stream(spark, f"{sf_dir}/events.*", schema, endings=("parquet",))
    ST.append_batches(source, f"{out}/data", f"{out}/checkpoint").awaitTermination()
    return spark.read.schema(schema).parquet(f"{out}/data").select("user_id", "event_type").distinct()


# --- plug-ins


@query("SELECT label, count(*) AS n, round(avg(CAST(embedding[1] AS DOUBLE) * 1.1 * pow(0.5, (vec_id % 90) / 30) + 0.2 * CASE WHEN label % 2 = 0 THEN 1 ELSE 0.5 END), 6) AS mean FROM embeddings GROUP BY 1")
def ud2_reasoning_module(spark, sf_dir):
    """Registered modules rescore candidates one after another."""
    name = F.when(F.col("label") % 2 == 0, "red ring").otherwise("red bolt")
    e = load(spark, sf_dir, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("score"), name.alias("name"), (F.col("vec_id") % 90).alias("days"))
    out = plugins.REASONING["keyword_booster"](plugins.REASONING["cooler"](plugins.REASONING["booster"](e, factor=1.1)), words=("red", "ring"))
    return out.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"))


@query("SELECT module, count(*) AS n, sum(length(text)) AS chars FROM (SELECT 'json_lines' AS module, text FROM conversations WHERE role = 'user' UNION ALL SELECT 'paragraphs', text FROM conversations WHERE role = 'assistant') WHERE length(text) > 0 GROUP BY 1")
def ud1_ingestion_modules(spark, sf_dir):
    """Turns written as files of two endings, each read by the module that takes it; a file of no module's ending is left."""
    c, path = load(spark, sf_dir, "conversations"), fresh_path(spark)
    c.where("role = 'user'").select("text").write.json(f"{path}/turns.jsonl")
    rows = c.where("role = 'assistant'").select(F.concat(F.lit("\n"), "text", F.lit("\n")).alias("value"))
    rows.write.text(f"{path}/turns.md")
    c.where("role = 'system'").select("text").write.text(f"{path}/turns.csv")
    out = plugins.ingested(spark, [f"{path}/turns.jsonl", f"{path}/turns.md", f"{path}/turns.csv"]).withColumn("text", F.regexp_replace("text", "^\n+|\n+$", ""))
    return out.groupBy("module").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query(f"""WITH {VECTOR_SQL}, d AS (SELECT l_partkey AS node_id, max(l_shipdate) AS last FROM lineitem GROUP BY 1), x AS (SELECT node_id, round(score, 6) AS a, round(exp(-0.001 * date_diff('day', last, TIMESTAMP '2003-01-01')), 6) AS b FROM v JOIN d USING (node_id)), c AS (SELECT node_id, 0.7 AS w, row_number() OVER (ORDER BY a DESC, node_id) AS r FROM x QUALIFY r <= 80 UNION ALL SELECT node_id, 0.3, row_number() OVER (ORDER BY b DESC, node_id) AS r FROM x QUALIFY r <= 80)
  SELECT node_id, round(sum(w / (60 + r)), 9) AS score FROM c GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def ud6_column_registry(spark, sf_dir):
    d = load(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("node_id")).agg(F.max("l_shipdate").alias("last"))
    days = F.datediff(F.to_date(F.lit("2003-01-01")), F.col("last"))
    c = scored_vectors(spark, sf_dir).join(d, "node_id").select("node_id", F.col("score").alias("vector"), F.exp(-0.001 * days).alias("recency"))
    return plugins.voted(stored(c), {"vector": 0.7, "recency": 0.3}, 20).select("node_id", F.round("score", 9).alias("score"))


@query("SELECT 'labels' AS dataset, doc_id AS id FROM labels WHERE toxic = 1 AND quality = 1 UNION ALL SELECT 'errors', event_id FROM events WHERE event_type = 'error' AND value > 30")
def ud9_review_queue(spark, sf_dir):
    return plugins.review_queue(spark, sf_dir)
