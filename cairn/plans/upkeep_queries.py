"""Expert routing, page sections, corrections, versioned updates, exports scrubbed again, held-out splits and reflection over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chunking as CH
from ..functions import pages as PG
from ..functions import scalars as S
from ..operators import curate as C
from ..operators import knowledge as K
from ..operators import sets
from ..sources import files
from ..sources.scratch import fresh_path, stored
from ..sources.tables import EDGES_SQL, SUPPLIER_BASE, graph_edges, graph_nodes, load
from . import plugins
from .registry import Registry

query = Registry()

# --- expert routing


@query("""WITH s AS (SELECT DISTINCT l_suppkey AS e, l_partkey AS i FROM lineitem), z AS (SELECT e, count(*) AS n FROM s GROUP BY 1), h AS (SELECT x.e AS a, y.e AS b, count(*) AS h FROM s x JOIN s y USING (i) WHERE x.e < y.e GROUP BY ALL)
  SELECT a, b, round(h / (p.n + q.n - h), 6) AS jaccard FROM h JOIN z p ON p.e = a JOIN z q ON q.e = b WHERE h / (p.n + q.n - h) >= 0.15""")
def c19_expert_overlap(spark, sf_dir):
    """Experts and the items routed to them: pairs of experts whose items are alike to 0.15 or more."""
    s = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("e"), F.col("l_partkey").alias("i")).distinct()
    return sets.similar_sets(s, "e", "i", 0.15).withColumn("jaccard", F.round("jaccard", 6))


TOP_SQL = """t AS (SELECT task, layer, expert FROM (SELECT 't' || l_suppkey % 9 AS task, l_linenumber AS layer, l_partkey % 64 AS expert, count(*) AS n FROM lineitem GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY task, layer ORDER BY n DESC, expert) <= 64 * 20 // 100)"""
OVERLAP_SQL = """z AS (SELECT task, layer, count(*) AS n FROM t GROUP BY ALL), h AS (SELECT x.task AS a, y.task AS b, layer, count(*) AS h FROM t x JOIN t y USING (layer, expert) WHERE x.task < y.task GROUP BY ALL), k AS (SELECT DISTINCT task FROM t), l AS (SELECT DISTINCT layer FROM t),
  c AS (SELECT x.task AS a, y.task AS b, l.layer AS layer FROM k x, k y, l WHERE x.task < y.task), o AS (SELECT c.a, c.b, avg(CASE WHEN coalesce(p.n, 0) + coalesce(q.n, 0) > 0 THEN coalesce(h, 0) / (coalesce(p.n, 0) + coalesce(q.n, 0) - coalesce(h, 0)) ELSE 0 END) AS jaccard
  FROM c LEFT JOIN h ON h.a = c.a AND h.b = c.b AND h.layer = c.layer LEFT JOIN z p ON p.task = c.a AND p.layer = c.layer LEFT JOIN z q ON q.task = c.b AND q.layer = c.layer GROUP BY ALL)"""


def routed(spark, sf_dir):
    """Lines as tokens of one of nine tasks by supplier, routed in a layer, the line's number, to one of 64 experts."""
    tokens = load(spark, sf_dir, "lineitem").select(F.concat(F.lit("t"), (F.col("l_suppkey") % 9).cast("string")).alias("task"), F.col("l_linenumber").alias("layer"), (F.col("l_partkey") % 64).alias("expert"))
    return sets.top_experts(tokens.groupBy("task", "layer", "expert").agg(F.count("*").alias("n")), 20, 64)


@query(f"WITH {TOP_SQL} SELECT task, layer, expert FROM t")
def c19_top_experts(spark, sf_dir):
    return routed(spark, sf_dir)


@query(f"WITH {TOP_SQL}, {OVERLAP_SQL}, m AS (SELECT avg(jaccard) AS m FROM o) SELECT a, b, round(jaccard, 6) AS jaccard, CASE WHEN m >= 0.7 THEN 'cohesive' WHEN m >= 0.4 THEN 'ambiguous' ELSE 'split-candidate' END AS verdict FROM o, m")
def c19_task_overlap(spark, sf_dir):
    o = stored(sets.task_overlap(routed(spark, sf_dir)))
    mean = o.agg(F.avg("jaccard").alias("m"))
    return o.join(F.broadcast(mean)).select("a", "b", F.round("jaccard", 6).alias("jaccard"), sets.verdict(F.col("m")).alias("verdict"))  # one row


@query(f"""WITH RECURSIVE {TOP_SQL}, {OVERLAP_SQL}, d AS (SELECT a, b, round(1 - jaccard, 9) AS d FROM o UNION ALL SELECT b, a, round(1 - jaccard, 9) FROM o), v AS (SELECT DISTINCT d AS t FROM d), r AS (SELECT t, (SELECT min(task) FROM k) AS task FROM v UNION SELECT r.t, d.b FROM r JOIN d ON d.a = r.task AND d.d <= r.t),
  w AS (SELECT min(t) AS t FROM (SELECT t, count(DISTINCT task) AS n FROM r GROUP BY 1) WHERE n = (SELECT count(*) FROM k)), u AS (SELECT max(t) AS t FROM v WHERE t < (SELECT t FROM w)), g AS (SELECT task, task IN (SELECT task FROM r WHERE t = (SELECT t FROM u)) AS s FROM k),
  n AS (SELECT s, count(*) AS n, min(task) AS first FROM g GROUP BY 1) SELECT g.task, p.side FROM g JOIN (SELECT s, CAST(row_number() OVER (ORDER BY n, first) AS INT) AS side FROM n) p USING (s)""")
def c19_boundary(spark, sf_dir):
    """The two groups of tasks that single linkage joins last."""
    o = sets.task_overlap(routed(spark, sf_dir)).collect()  # a row for each pair of tasks
    sides = sets.boundary([(r.a, r.b, round(1 - r.jaccard, 9)) for r in o])
    return spark.createDataFrame([(t, i + 1) for i, g in enumerate(sides) for t in g], "task string, side int")


# --- sections

WORDS_OF = "len(list_filter(string_split_regex({}, '\\s+'), lambda w: w <> ''))"
TRIMMED = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
FOLDED_SQL = f"""(SELECT conv_id, list_reduce(list({{'done': CAST([] AS STRUCT(h VARCHAR, c VARCHAR)[]), 'h': role, 'c': {TRIMMED.format("text")}}} ORDER BY turn), lambda x, y: CASE WHEN {WORDS_OF.format("x.c")} < 15 THEN {{'done': x.done, 'h': x.h || ' / ' || y.h, 'c': CASE WHEN x.c = '' THEN y.c WHEN y.c = '' THEN x.c ELSE x.c || chr(10) || chr(10) || y.c END}}
  ELSE {{'done': list_append(x.done, {{'h': x.h, 'c': x.c}}), 'h': y.h, 'c': y.c}} END) AS f FROM conversations GROUP BY 1)"""


@query(f"""WITH s AS (SELECT conv_id, list_append(f.done, {{'h': f.h, 'c': f.c}}) AS s FROM {FOLDED_SQL}) SELECT conv_id, unnest(range(len(s))) AS section, unnest(list_transform(s, lambda x: x.h)) AS heading, unnest(list_transform(s, lambda x: md5(x.c))) AS digest,
  unnest(list_transform(s, lambda x: list_sort(list_distinct(list_concat(['domain:chat'], list_transform(list_filter(string_split(x.h, ' / '), lambda w: w <> ''), lambda w: 'topic:' || w)))))) AS tags FROM s""")
def x17_heading_sections(spark, sf_dir):
    """Conversations written as pages with a section for each turn; sections of under 15 words join the next one, and tags say what they are about."""
    part = F.struct("turn", F.concat(F.lit("## "), "role", F.lit("\n"), "text").alias("p"))
    pages = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(part)).alias("ps"))
    text = F.concat(F.lit("\n"), F.array_join(F.transform("ps", lambda x: x["p"]), "\n"))
    s = CH.heading_sections(pages.select("conv_id", text.alias("text")), "conv_id", "text", least_words=15)
    tags = F.array_sort(PG.section_tags(F.lit(""), F.col("heading"), F.lit("chat")))
    return s.select("conv_id", F.col("section").cast("long").alias("section"), "heading", F.md5("content").alias("digest"), tags.alias("tags"))


LEFT_SQL = "regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<(?:" + "|".join(f"{t}\\b.*?</{t}\\s*" for t in PG.LEFT_OUT) + ")>', '', 'gis')"
BLOCKS_SQL = f"regexp_replace(regexp_replace(regexp_replace({LEFT_SQL}, '(?i)<li\\b[^<>]*>', chr(10) || '- ', 'g'), '(?i)<h1\\b[^<>]*>', chr(10) || '# ', 'g'), '(?i)</?({PG.BLOCKS})\\b[^<>]*>|</h1\\s*>', chr(10), 'g')"
PLAIN_SQL = f"replace(replace(replace(replace(replace(replace(regexp_replace({BLOCKS_SQL}, '</?[a-zA-Z][^<>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&amp;', '&')"
PAGE_SQL = TRIMMED.format(f"regexp_replace(regexp_replace(regexp_replace({PLAIN_SQL}, '[ \\t\\r]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")


@query(f"""WITH p AS (SELECT page_id, trim(regexp_extract(html, '(?i)<title[^<>]*>([^<]*)', 1)) AS title, regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#:]') AS named, {PAGE_SQL} AS t FROM pages), c AS (SELECT *, {WORDS_OF.format("t")} >= 100 AS chunked, chr(10) || t AS u FROM p),
  s AS (SELECT page_id, named, chunked, unnest(CASE WHEN chunked THEN list_filter(list_transform(string_split(u, chr(10) || '# '), lambda x, i: CASE WHEN i = 1 THEN {{'h': '', 'c': {TRIMMED.format("x")}}} ELSE {{'h': trim(string_split(x, chr(10))[1]), 'c': CASE WHEN contains(x, chr(10)) THEN {TRIMMED.format("substr(x, instr(x, chr(10)) + 1)")} ELSE '' END}} END), lambda x: x.h <> '' OR x.c <> '') ELSE [{{'h': title, 'c': t}}] END) AS s FROM c)
  SELECT page_id, s.h AS title, md5(s.c) AS digest, {WORDS_OF.format("s.c")} AS words, chunked, named FROM s""")
def s11_page_sections(spark, sf_dir):
    """Pages as text with marked headings, the longer ones cut at headings of any level."""
    s = PG.page_sections(load(spark, sf_dir, "pages"), "page_id", "url", "html", least_page=100, least_words=0, level=1)
    named = F.exists("tags", lambda t: t.startswith("domain:"))
    return s.select("page_id", "title", F.md5("content").alias("digest"), F.col("words").cast("long").alias("words"), "chunked", named.alias("named"))


# --- corrections, versions

LABEL_SQL = "trim(substr(regexp_extract(content, '(?s)^(.[^.\\n]*)', 1), 1, 120))"


@query(f"""WITH o AS (SELECT turn + 100 * conv_id AS id, text AS content, embedding FROM conversations JOIN embeddings ON vec_id = conv_id WHERE role = 'user'), l AS (SELECT *, CASE WHEN {LABEL_SQL} <> '' THEN {LABEL_SQL} ELSE 'correction' END AS label FROM o WHERE id % 11 <> 0),
  r AS (SELECT id, max(round(list_cosine_similarity(CAST(l.embedding AS DOUBLE[]), CAST(n.embedding AS DOUBLE[])), 9)) >= 0.3 AS near FROM l, embeddings n WHERE n.vec_id % 3 = 0 GROUP BY 1), g AS (SELECT l.id, label, length(content) < 40 AS rejected, coalesce(near, false) AS near FROM l LEFT JOIN r USING (id)),
  m AS (SELECT label, min(id) AS maker FROM g WHERE NOT rejected AND NOT near GROUP BY 1) SELECT id, label, CASE WHEN rejected THEN 'rejected' WHEN maker IS NULL OR id < maker THEN 'skipped' WHEN id = maker THEN 'created' ELSE 'updated' END AS outcome, CASE WHEN NOT rejected AND id >= maker THEN maker END AS node FROM g LEFT JOIN m USING (label)""")
def l22_correction_nodes(spark, sf_dir):
    """User turns as corrections with their conversation's vector; every third vector is a constraint; short ones don't pass the gate."""
    e, c = load(spark, sf_dir, "embeddings"), load(spark, sf_dir, "conversations").where("role = 'user'")
    o = c.join(e, F.col("vec_id") == F.col("conv_id")).select((F.col("turn") + 100 * F.col("conv_id")).alias("id"), F.lit(None).cast("string").alias("name"), F.col("text").alias("content"), "embedding")
    nodes = e.where("vec_id % 3 = 0").select((F.col("vec_id") + 10**9).alias("id"), F.lit("c").alias("name"), F.lit("constraint").alias("role_type"), "embedding")
    done, _ = K.correction_nodes(o, nodes, o.where("id % 11 = 0").select("id"), F.length("content") < 40, 0.3)
    return done


@query("""WITH c AS (SELECT c_custkey AS k, c_nationkey AS version FROM customer), u AS (SELECT o_custkey AS k, o_orderkey % 25 AS expected, o_orderkey AS turn, c.version AS now FROM orders JOIN c ON c.k = o_custkey), f AS (SELECT k, min(turn) FILTER (expected = now) AS first FROM u GROUP BY 1),
  s AS (SELECT u.*, row_number() OVER (PARTITION BY u.k ORDER BY coalesce(turn = first, false) DESC, turn) AS n, CASE WHEN first IS NULL THEN 1 ELSE 0 END AS lost, count(*) OVER (PARTITION BY u.k) AS every FROM u JOIN f USING (k))
  SELECT k, turn, CASE WHEN n + lost <= 4 THEN 'applied' ELSE 'conflict' END AS outcome, CAST(least(n + lost, 4) AS INT) AS attempts, expected, CASE WHEN n + lost <= 4 THEN now + n ELSE now + least(4 - lost, every) END AS version FROM s""")
def l29_update_report(spark, sf_dir):
    """Orders as updates of a customer's balance, each with the version it expects; three retries."""
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("long").alias("version"), F.col("c_acctbal").alias("balance"))
    u = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 25).alias("expected"), F.col("o_orderkey").alias("turn"), F.col("o_totalprice").alias("balance"))
    _, report = K.versioned_update(c, u, "k", ["balance"])
    return report.where("outcome <> 'missing'").withColumn("attempts", F.col("attempts").cast("int"))


# --- exports and splits

SCRUBBED_SQL = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '[EMAIL]', 'g'), 'AKIA[0-9A-Z]{16}', '[KEY]', 'g'), '\\b[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\b', '[IP]', 'g'), '\\+?[0-9]{1,3}[ -]?\\(?[0-9]{3}\\)?[ -]?[0-9]{3}[ -]?[0-9]{4}', '[PHONE]', 'g')"


@query(f"SELECT count(*) AS n_rows, count(*) FILTER ({SCRUBBED_SQL} <> text) AS violations, 0 AS remaining FROM documents")
def s7_rescrub(spark, sf_dir):
    """Documents exported as JSON lines with a manifest, the export scrubbed again, and what was written anew scrubbed once more."""
    d, path, out = load(spark, sf_dir, "documents").select("doc_id", "text"), fresh_path(spark), fresh_path(spark)
    files.export_with_manifest(d.withColumn("source", F.lit("documents")), path, ["doc_id", "text"], "source", F.lit(False))
    report = files.rescrubbed(spark, f"{path}/data", out, d.schema, {"text": S.scrubbed})
    again = files.rescrubbed(spark, f"{out}/data", fresh_path(spark), d.schema, {"text": S.scrubbed})
    left = again.agg(F.coalesce(F.sum("violations"), F.lit(0)).alias("remaining"))
    return report.agg(F.sum("n_rows").alias("n_rows"), F.sum("violations").alias("violations")).join(left)  # one row each


@query("""WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 8), q AS (SELECT source, n, greatest(1, CAST(round_even(90 * n / sum(n) OVER (), 0) AS INT)) AS q, row_number() OVER (ORDER BY n DESC, source) AS r FROM s), a AS (SELECT source, CASE WHEN r = 1 THEN greatest(1, q + 90 - (SELECT sum(q) FROM q)) ELSE q END AS q FROM q),
  g AS (SELECT doc_id FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256(CAST(doc_id AS VARCHAR))) AS k FROM documents) JOIN a USING (source) WHERE k <= q), p AS (SELECT doc_id, source, substr(text, 1, 40) AS prompt, doc_id IN (SELECT doc_id FROM g) AS gold FROM documents)
  SELECT doc_id, CASE WHEN gold THEN 'Of ' || source || ': ' || prompt ELSE prompt END AS prompt, CASE WHEN gold THEN 'golden' ELSE 'train' END AS split FROM p WHERE gold OR prompt NOT IN (SELECT prompt FROM p WHERE gold)""")
def c16_golden_split(spark, sf_dir):
    """A document's prompt is its beginning; golden ones are rephrased, and no training row has a golden row's prompt."""
    d = load(spark, sf_dir, "documents").select("doc_id", "source", F.substring("text", 1, 40).alias("prompt"))
    out = C.golden_split(d, "source", "doc_id", "prompt", F.concat(F.lit("Of "), "source", F.lit(": "), "prompt"), 90, 8)
    return out.select("doc_id", "prompt", "split")


# --- reflection


@query(f"""WITH n AS (SELECT p_partkey AS node_id, round(p_retailprice / 2000, 6) AS score FROM part UNION ALL SELECT s_suppkey + {SUPPLIER_BASE}, round((s_acctbal + 1000) / 11000, 6) FROM supplier), e AS {EDGES_SQL}, l AS (SELECT src, dst, weight FROM e WHERE rel_type = 'CO_ACTIVATED_WITH' UNION ALL SELECT dst, src, weight FROM e WHERE rel_type = 'CO_ACTIVATED_WITH'),
  s AS (SELECT * FROM n WHERE score >= 0.5 ORDER BY score DESC, node_id LIMIT 500), a AS (SELECT dst AS node_id, max(0.3 * score * weight) AS more FROM l JOIN s ON s.node_id = src GROUP BY 1) SELECT node_id, round(score + coalesce(more, 0), 6) AS score FROM n LEFT JOIN a USING (node_id)""")
def ud10_reflection_module(spark, sf_dir):
    """The registered reflection module over all nodes and their co-activation."""
    n = graph_nodes(spark, sf_dir).select("node_id", F.col("confidence").alias("score"))
    edges = graph_edges(spark, sf_dir).where("rel_type = 'CO_ACTIVATED_WITH'")
    return plugins.REASONING["reflection"](n, edges=edges, most=500).withColumn("score", F.round("score", 6))
