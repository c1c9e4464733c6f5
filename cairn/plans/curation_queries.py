"""Curation, text, rewards, transfer and streaming over documents, benchmark, pages, conversations and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rewards as RW
from ..functions import scalars as S
from ..operators import curate as C
from ..operators import vectors as V
from ..sources import files
from ..sources.tables import load
from ..streaming import state
from ..streaming import stream as ST
from .registry import Registry

query = Registry()
D = "documents"
WORDS_SQL = "list_filter(string_split_regex(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
PII_SQL = "(regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}') OR regexp_matches(text, '\\+?[0-9]{1,3}[ -]?\\(?[0-9]{3}\\)?[ -]?[0-9]{3}[ -]?[0-9]{4}') OR regexp_matches(text, '\\b[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\b') OR regexp_matches(text, 'AKIA[0-9A-Z]{16}'))"


@query(f"""WITH e AS (SELECT *, CASE WHEN {PII_SQL} THEN 'privacy' WHEN length(trim(text)) <= 10 THEN 'too_short' WHEN coalesce(lang, '') = '' THEN 'no_language' END AS early FROM documents),
  d AS (SELECT *, row_number() OVER (PARTITION BY sha256(text), early IS NULL ORDER BY doc_id) AS nth FROM e)
  SELECT doc_id, coalesce(early, CASE WHEN nth > 1 THEN 'duplicate' WHEN length(text) > 20000 THEN 'too_long' END) AS exclude_reason FROM d""")
def c1_quality_gates(spark, sf_dir):
    return C.quality_gates(load(spark, sf_dir, D)).select("doc_id", "exclude_reason")


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def c2_exact_dedup(spark, sf_dir):
    return C.keep_first(load(spark, sf_dir, D), [F.sha2("text", 256)], [F.asc("doc_id")]).select("doc_id")


@query("""WITH r AS (SELECT event_id, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) SELECT event_id, CASE WHEN n < 3 OR k <= least(greatest(CAST(floor(n * 0.8) AS INT), 1), n - 1) THEN 'train' ELSE 'test' END AS split FROM r""")
def c3_temporal_split(spark, sf_dir):
    return C.temporal_split(load(spark, sf_dir, "events"), ["user_id"], [F.asc("ts"), F.asc("event_id")], 0.8).select("event_id", "split")


@query("""WITH r AS (SELECT user_id, ts, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), s AS (SELECT user_id, ts, n < 3 OR k <= least(greatest(CAST(floor(n * 0.8) AS INT), 1), n - 1) AS train FROM r)
  SELECT user_id, coalesce(max(ts) FILTER (train) <= min(ts) FILTER (NOT train), true) AS clean FROM s GROUP BY user_id""")
def c4_leakage_check(spark, sf_dir):
    s = C.temporal_split(load(spark, sf_dir, "events"), ["user_id"], [F.asc("ts"), F.asc("event_id")], 0.8)
    train = F.col("split") == "train"
    return s.groupBy("user_id").agg(F.coalesce(F.max(F.when(train, F.col("ts"))) <= F.min(F.when(~train, F.col("ts"))), F.lit(True)).alias("clean"))


@query("""WITH r AS (SELECT doc_id, source, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR))) AS k FROM documents) SELECT doc_id, CASE WHEN k <= CASE WHEN n = 1 THEN 0 WHEN n < 20 THEN greatest(1, CAST(round_even(n * 0.1, 0) AS INT)) ELSE greatest(2, CAST(round_even(n * 0.1, 0) AS INT)) END THEN 'valid' ELSE 'train' END AS split FROM r""")
def c5_stratified_split(spark, sf_dir):
    return C.stratified_split(load(spark, sf_dir, D), "source", F.md5(F.col("doc_id").cast("string"))).select("doc_id", "split")


@query("""WITH r AS (SELECT doc_id, lang, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR))) AS k FROM documents), t AS (SELECT *, 300 // n + CASE WHEN k <= 300 % n THEN 1 ELSE 0 END AS t FROM r) SELECT doc_id, lang, unnest(range(0, t)) AS copy FROM t WHERE t > 0""")
def c6_balanced_sample(spark, sf_dir):
    return C.balanced(load(spark, sf_dir, D), "lang", 300, F.md5(F.col("doc_id").cast("string"))).select("doc_id", "lang", "copy")


@query("""WITH r AS (SELECT user_id, event_id, value / 100 AS v, row_number() OVER (PARTITION BY user_id ORDER BY value / 100 DESC, event_id) AS i FROM events), p AS (SELECT a.user_id, a.event_id AS chosen, b.event_id AS rejected, a.v - b.v AS d, a.i, b.i AS j FROM r a JOIN r b ON a.user_id = b.user_id AND a.i < b.i WHERE round(a.v - b.v, 9) >= 0.1)
  SELECT user_id, chosen, rejected, round(d, 6) AS delta FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i, j) AS n FROM p) WHERE n <= 4""")
def c7_preference_pairs(spark, sf_dir):
    e = load(spark, sf_dir, "events").withColumn("reward", F.col("value") / 100)
    return C.preference_pairs(e, ["user_id"], "reward", "event_id", 0.1, 4)


@query("""SELECT o.o_orderkey, min(CASE WHEN l_returnflag = 'A' THEN l_partkey END) AS chosen, min(CASE WHEN l_returnflag = 'R' THEN l_partkey END) AS rejected FROM orders o JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 HAVING count(*) FILTER (l_returnflag = 'A') > 0 AND count(*) FILTER (l_returnflag = 'R') > 0""")
def c8_outcome_pairs(spark, sf_dir):
    l = load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))  # noqa: E741
    side = lambda x: F.min(F.when(F.col("l_returnflag") == x, F.col("l_partkey")))
    return l.groupBy("o_orderkey").agg(side("A").alias("chosen"), side("R").alias("rejected")).where("chosen is not null and rejected is not null")


@query(f"""WITH b AS (SELECT item_id, {WORDS_SQL.format("text")} AS w FROM benchmark), bs AS (SELECT DISTINCT item_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM b, range(1, 100000) t(i) WHERE i + 2 <= len(w)), z AS (SELECT item_id, count(*) AS n FROM bs GROUP BY 1),
  d AS (SELECT doc_id, {WORDS_SQL.format("text")} AS w FROM documents), ds AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM d WHERE len(w) >= 3) WHERE s IN (SELECT s FROM bs))
  SELECT doc_id, round(max(h / n), 6) AS containment FROM (SELECT doc_id, item_id, count(*) AS h FROM ds JOIN bs USING (s) GROUP BY ALL) JOIN z USING (item_id) GROUP BY doc_id""")
def c9_leak_audit(spark, sf_dir):
    return C.leak_scores(load(spark, sf_dir, D), load(spark, sf_dir, "benchmark")).withColumn("containment", F.round("containment", 6))


@query("""WITH t AS (SELECT d.doc_id, text FROM documents d LEFT JOIN labels USING (doc_id) ORDER BY coalesce(quality, 0) DESC, doc_id DESC LIMIT 400), k AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM t WHERE doc_id % 7 <> 0) SELECT doc_id FROM k WHERE n = 1 ORDER BY doc_id LIMIT 120""")
def c10_clean_eval(spark, sf_dir):
    """The best 400 less the known prompts, one of each text, the first 120: the limits are the operator's."""
    d = load(spark, sf_dir, D).join(load(spark, sf_dir, "labels"), "doc_id", "left").orderBy(F.desc(F.coalesce("quality", F.lit(0))), F.desc("doc_id")).limit(400)
    known = load(spark, sf_dir, D).where("doc_id % 7 = 0").select("doc_id")
    return C.keep_first(d.join(known, "doc_id", "left_anti"), [F.col("text")], [F.asc("doc_id")]).select("doc_id").orderBy("doc_id").limit(120)


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS chat, count(*) AS n_turns, bool_or(role = 'user') AND bool_or(role = 'assistant') AS valid FROM conversations GROUP BY conv_id")
def c12_chat_records(spark, sf_dir):
    m = F.struct("turn", F.concat("role", F.lit(": "), "text").alias("m"))
    g = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(m)).alias("ms"), F.count("*").alias("n_turns"), (F.bool_or(F.col("role") == "user") & F.bool_or(F.col("role") == "assistant")).alias("valid"))
    return g.select("conv_id", F.array_join(F.transform("ms", lambda x: x["m"]), "\n").alias("chat"), "n_turns", "valid")


SCORES_SQL = "SELECT event_type AS task, avg(value) FILTER (user_id % 2 = 0) AS c, avg(value) FILTER (user_id % 2 = 1) AS b FROM events GROUP BY 1"


@query(f"SELECT task, round((c - b) / b, 6) AS delta, CASE WHEN (c - b) / b < -0.05 THEN 'regressed' WHEN (c - b) / b > 0.02 THEN 'improved' ELSE 'same' END AS verdict FROM ({SCORES_SQL})")
def c13_regression_gate(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    of = lambda r: e.where(f"user_id % 2 = {r}").groupBy(F.col("event_type").alias("task")).agg(F.avg("value").alias("score"))
    return C.regressions(of(0), of(1)).withColumn("delta", F.round("delta", 6))


@query("""WITH h AS (SELECT event_type AS task, date_trunc('day', ts) AS day, round(avg(value), 9) AS score FROM events GROUP BY ALL), d AS (SELECT *, score - lag(score) OVER (PARTITION BY task ORDER BY day) AS x, row_number() OVER (PARTITION BY task ORDER BY day DESC) AS r FROM h) SELECT task, bool_and(coalesce(x < 2, false)) AND count(x) >= 3 AS stagnant FROM d WHERE r <= 3 GROUP BY task""")
def c14_stagnation(spark, sf_dir):
    h = load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("task"), F.date_trunc("day", "ts").alias("day")).agg(F.round(F.avg("value"), 9).alias("score"))
    return C.stagnant(h, "task", "day", 3, 2.0)


@query("""WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), q AS (SELECT source, n * 137 / sum(n) OVER () AS exact FROM s), r AS (SELECT source, CAST(floor(exact) AS INT) AS q, row_number() OVER (ORDER BY round(exact - floor(exact), 9) DESC, source) AS nth FROM q),
  u AS (SELECT source, q + CASE WHEN nth <= 137 - (SELECT sum(q) FROM r) THEN 1 ELSE 0 END AS quota FROM r) SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR))) AS k FROM documents) JOIN u USING (source) WHERE k <= quota""")
def c15_proportional_sample(spark, sf_dir):
    return C.proportional(load(spark, sf_dir, D), "source", 137, F.md5(F.col("doc_id").cast("string"))).select("doc_id", "source")


@query("SELECT event_id, round(CASE WHEN stddev_pop(value) OVER w < 1e-6 THEN 0 ELSE greatest(-5, least(5, (value - avg(value) OVER w) / stddev_pop(value) OVER w)) END, 6) AS advantage FROM events WINDOW w AS (PARTITION BY event_type)")
def c18_advantages(spark, sf_dir):
    return C.advantages(load(spark, sf_dir, "events"), "event_type", "value").select("event_id", F.round("advantage", 6).alias("advantage"))


@query(f"SELECT doc_id FROM documents WHERE {PII_SQL}")
def p13_privacy_predicate(spark, sf_dir):
    return load(spark, sf_dir, D).where(S.has_personal_data(F.col("text"))).select("doc_id")


@query("SELECT conv_id, turn FROM conversations WHERE NOT (role = 'system' OR regexp_matches(lower(text), '\\b(error|failed)\\b'))")
def p15_promotion_gate(spark, sf_dir):
    return load(spark, sf_dir, "conversations").where(~((F.col("role") == "system") | F.lower("text").rlike(r"\b(error|failed)\b"))).select("conv_id", "turn")


@query("SELECT doc_id, sha256(coalesce(source, '') || coalesce(text, '')) AS key FROM documents")
def x1_dedup_key(spark, sf_dir):
    return load(spark, sf_dir, D).select("doc_id", F.sha2(F.concat(F.coalesce("source", F.lit("")), F.coalesce("text", F.lit(""))), 256).alias("key"))


@query("SELECT doc_id, CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967295.0 < 0.3 AS included FROM documents")
def x2_deterministic_inclusion(spark, sf_dir):
    return load(spark, sf_dir, D).select("doc_id", (F.conv(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 8), 16, 10).cast("double") / 4294967295.0 < 0.3).alias("included"))


@query("SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '[EMAIL]', 'g'), 'AKIA[0-9A-Z]{16}', '[KEY]', 'g'), '\\b[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\b', '[IP]', 'g'), '\\+?[0-9]{1,3}[ -]?\\(?[0-9]{3}\\)?[ -]?[0-9]{3}[ -]?[0-9]{4}', '[PHONE]', 'g') AS text FROM documents")
def x6_scrub(spark, sf_dir):
    return load(spark, sf_dir, D).select("doc_id", S.scrubbed(F.col("text")).alias("text"))


@query("""WITH r AS (SELECT event_id, 0.3 * pow(0.5, date_diff('minute', ts, TIMESTAMP '2024-02-01') / 1440) + 0.4 * least(1, value / 100) + 0.3 * CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS s FROM (SELECT event_id, date_trunc('minute', ts) AS ts, value, event_type FROM events)) SELECT event_id, round(s, 6) AS relevance, CASE WHEN s >= 0.8 THEN 'critical' WHEN s >= 0.5 THEN 'important' ELSE 'background' END AS tier FROM r""")
def x10_relevance_tier(spark, sf_dir):
    age = F.timestamp_diff("MINUTE", F.date_trunc("minute", "ts"), F.to_timestamp(F.lit("2024-02-01"))) / 1440
    s = 0.3 * F.pow(F.lit(0.5), age) + 0.4 * F.least(F.lit(1.0), F.col("value") / 100) + 0.3 * F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0)
    return load(spark, sf_dir, "events").select("event_id", F.round(s, 6).alias("relevance"), F.when(s >= 0.8, "critical").when(s >= 0.5, "important").otherwise("background").alias("tier"))


@query("SELECT doc_id, CAST(floor(length(text) / 4 + 0.5) AS BIGINT) AS tokens FROM documents")
def x11_token_estimate(spark, sf_dir):
    return load(spark, sf_dir, D).select("doc_id", S.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT event_id, round(1 / (1 + exp(-(value / 50 - 1))), 6) AS sigmoid, greatest(0, least(1, value / 60)) AS clamped FROM events".replace("greatest(0, least(1, value / 60)) AS clamped", "round(greatest(0, least(1, value / 60)), 6) AS clamped"))
def x12_sigmoid_clamp(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", F.round(S.sigmoid(F.col("value") / 50 - 1), 6).alias("sigmoid"), F.round(S.clamp(F.col("value") / 60), 6).alias("clamped"))


@query("SELECT o_orderkey, o_orderdate AS t FROM orders")
def x14_timestamp_normalise(spark, sf_dir):
    """Each order's date written in one of four forms and read back."""
    o, d = load(spark, sf_dir, "orders"), F.col("o_orderdate").cast("timestamp")
    kind = F.element_at(F.array(*map(F.lit, ("rfc3339", "unix", "unix_ms", "date_only"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    text = F.when(F.col("kind") == "rfc3339", F.date_format(d, "yyyy-MM-dd'T'HH:mm:ssXXX")).when(F.col("kind") == "unix", F.unix_seconds(d).cast("string")).when(F.col("kind") == "unix_ms", F.unix_millis(d).cast("string")).otherwise(F.date_format(d, "yyyy-MM-dd"))
    return o.withColumn("kind", kind).select("o_orderkey", S.normalized_time(text, F.col("kind")).cast("timestamp_ntz").alias("t"))


@query(f"""WITH t AS (SELECT conv_id, turn, list_distinct({WORDS_SQL.format("text")}) AS w FROM conversations), p AS (SELECT a.conv_id, a.turn, a.w AS x, b.w AS y FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
  SELECT conv_id, turn, round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END, 6) AS jaccard, round(CASE WHEN len(x) = 0 THEN 0 ELSE len(list_intersect(x, y)) / len(x) END, 6) AS recall FROM p""")
def x15_overlap(spark, sf_dir):
    t = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_distinct(S.words(F.col("text"))).alias("x"))
    p = t.join(t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("x").alias("y")), ["conv_id", "turn"])
    recall = F.when(F.size("x") == 0, 0.0).otherwise(F.size(F.array_intersect("x", "y")) / F.size("x"))
    return p.select("conv_id", "turn", F.round(S.jaccard(F.col("x"), F.col("y")), 6).alias("jaccard"), F.round(recall, 6).alias("recall"))


@query(f"WITH w AS (SELECT doc_id, unnest(list_distinct({WORDS_SQL.format('text')})) AS term FROM documents) SELECT term, count(*) AS df, round(ln((SELECT count(*) FROM documents) / count(*)) + 1, 6) AS idf FROM w GROUP BY term HAVING count(*) >= 3")
def x16_idf(spark, sf_dir):
    d = load(spark, sf_dir, D)
    df = d.select(F.explode(F.array_distinct(S.words(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df")).where("df >= 3")
    return df.join(F.broadcast(d.agg(F.count("*").alias("n"))), F.lit(True)).select("term", "df", F.round(F.log(F.col("n") / F.col("df")) + 1, 6).alias("idf"))


@query("SELECT page_id, lower(regexp_extract(url, '://([^/?#]+)', 1)) AS domain, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/$', '') AS normalised FROM pages")
def x25_url_normalise(spark, sf_dir):
    u = F.col("url")
    return load(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract(u, "://([^/?#]+)", 1)).alias("domain"), F.regexp_replace(F.regexp_replace(u, "[?#].*$", ""), "/$", "").alias("normalised"))


@query("SELECT user_id, count(*) AS n, round(avg(CASE event_type WHEN 'click' THEN 1.0 WHEN 'error' THEN 0.0 ELSE 0.5 END), 6) AS mean FROM events GROUP BY 1")
def x22_reward_mean(spark, sf_dir):
    r = F.when(F.col("event_type") == "click", 1.0).when(F.col("event_type") == "error", 0.0).otherwise(0.5)
    return load(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg(r), 6).alias("mean"))


TOK = "list_filter(string_split_regex(lower(trim(text)), '\\s+'), lambda w: w <> '')"


@query(f"""WITH t AS (SELECT doc_id, text, {TOK} AS t FROM documents), r AS (SELECT doc_id, text, len(t) AS n, CASE WHEN len(t) > 0 THEN len(list_distinct(t)) / len(t) ELSE 0 END AS r FROM t)
  SELECT doc_id, CASE WHEN n = 0 THEN 0.0 WHEN r < 0.3 THEN 0.4 ELSE 0.9 END AS coherence, CASE WHEN n = 0 THEN 0.0 WHEN r < 0.3 THEN 0.3 WHEN n < 3 THEN 0.4 ELSE 0.9 END AS coverage, CASE WHEN n = 0 THEN 0.0 WHEN r > 0.7 THEN 1.0 WHEN r > 0.5 THEN 0.7 WHEN r > 0.3 THEN 0.4 ELSE 0.1 END AS uniqueness,
  round(CASE WHEN n = 0 THEN 0.0 WHEN n > 3 THEN least(1.0, 0.5 + 0.05 * n) ELSE 0.3 END, 6) AS recall FROM r""")
def x23_rewards(spark, sf_dir):
    t = F.col("text")
    return load(spark, sf_dir, D).select("doc_id", RW.coherence_score(t).alias("coherence"), RW.coverage_score(t).alias("coverage"), RW.uniqueness_check(t).alias("uniqueness"), F.round(RW.recall_improvement(t), 6).alias("recall"))


@query("SELECT event_id, round(1 / (1 + exp(5 * (value / 40 - 1))), 6) AS latency FROM events")
def x23_latency_reward(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", F.round(RW.latency_reward(F.col("value"), 40.0), 6).alias("latency"))


@query("""SELECT e.user_id, count(*) AS n FROM events e WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = e.user_id AND c_mktsegment = 'MACHINERY') GROUP BY 1""")
def s9_import_skip(spark, sf_dir):
    known = load(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("user_id"))
    return files.imported(load(spark, sf_dir, "events"), known, ["user_id"], "skip").groupBy("user_id").agg(F.count("*").alias("n"))


@query("""SELECT k, v FROM (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY p DESC) AS n FROM (SELECT c_custkey AS k, c_name AS v, 0 AS p FROM customer UNION ALL SELECT s_suppkey, s_name, 1 FROM supplier)) WHERE n = 1""")
def s9_import_overwrite(spark, sf_dir):
    old = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    new = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v"))
    return files.imported(new, old, ["k"], "overwrite")


@query("SELECT c.conv_id, c.turn, b.item_id FROM conversations c JOIN benchmark b ON c.text = b.text")
def u5_prompt_leakage(spark, sf_dir):
    return load(spark, sf_dir, "conversations").join(load(spark, sf_dir, "benchmark"), "text").select("conv_id", "turn", "item_id")


@query(f"""WITH q AS (SELECT item_id, list_filter(list_distinct({WORDS_SQL.format("text")}), lambda w: length(w) >= 8) AS s FROM benchmark), s AS (SELECT item_id, unnest(s) AS symbol FROM q), d AS (SELECT DISTINCT doc_id, unnest({WORDS_SQL.format("text")}) AS symbol FROM documents)
  SELECT doc_id, count(DISTINCT symbol) AS hits FROM d JOIN s USING (symbol) GROUP BY doc_id""")
def j19_reverse_references(spark, sf_dir):
    s = load(spark, sf_dir, "benchmark").select(F.explode(F.filter(F.array_distinct(S.words(F.col("text"))), lambda w: F.length(w) >= 8)).alias("symbol")).distinct()
    d = load(spark, sf_dir, D).select("doc_id", F.explode(F.array_distinct(S.words(F.col("text")))).alias("symbol"))
    return d.join(s, "symbol").groupBy("doc_id").agg(F.count("*").alias("hits"))


@query("""WITH e AS (SELECT vec_id, label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS n FROM embeddings), q AS (SELECT * FROM e WHERE n = 1), c AS (SELECT * FROM e WHERE n BETWEEN 2 AND 51)
  SELECT q.vec_id, arg_max(c.vec_id, (round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 9), c.vec_id)) AS nearest, round(max(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[]))), 6) AS sim FROM q JOIN c USING (label) GROUP BY 1""")
def j11_recent_duplicates(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("vec_id")))
    e = load(spark, sf_dir, "embeddings").withColumn("n", n).where("n <= 51")
    q, c = e.where("n = 1").select("label", "vec_id", F.col("embedding").alias("q")), e.where("n > 1").select("label", F.col("vec_id").alias("other"), "embedding")
    s = q.join(c, "label").select("vec_id", "other", F.round(S.cosine(F.col("q"), F.col("embedding")), 9).alias("sim"))
    return s.groupBy("vec_id").agg(F.max_by("other", F.struct("sim", "other")).alias("nearest"), F.round(F.max("sim"), 6).alias("sim"))


@query("""WITH p AS (SELECT a.vec_id AS q, b.vec_id AS node, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
  SELECT q, node, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(sim, 9) DESC, node) AS k FROM p) WHERE k <= 5 AND sim >= 0.2""")
def j10_nearest_existing(spark, sf_dir):
    """Queries are the rows whose id is divisible by 20, against all rows."""
    e = load(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 20 = 0")
    return V.knn_blocks(e, q, 5, 0.2)


@query("""WITH p AS (SELECT a.vec_id AS q, b.vec_id AS node, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
  SELECT q, node, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(sim, 9) DESC, node) AS k FROM p) WHERE k <= 10""")
def k1_index_search(spark, sf_dir):
    """The ten nearest of each query by the inverted file, in its exact form; queries as in j10."""
    e = load(spark, sf_dir, "embeddings")
    return V.VectorIndex.build(e).search(e.where("vec_id % 20 = 0"), 10)


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS bucket, event_type, round(avg(value), 6) AS avg_value, min(value) AS min_value, max(value) AS max_value, count(*) AS n FROM events GROUP BY ALL")
def st3_continuous_rollup(spark, sf_dir):
    out = ST.continuous_rollup(load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), ["event_type"])
    return out.withColumns({"avg_value": F.round("avg_value", 6), "bucket": F.col("bucket").cast("timestamp_ntz")})


SESSION_SQL = """WITH e AS (SELECT {key} AS k, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY {key} ORDER BY ts, event_id) < INTERVAL '{gap}' THEN 0 ELSE 1 END AS s FROM events), g AS (SELECT *, sum(s) OVER (PARTITION BY k ORDER BY ts, event_id) AS g FROM e)"""


@query(SESSION_SQL.format(key="event_type", gap="10 minutes") + " SELECT k AS event_type, min(ts) AS first, max(ts) + INTERVAL '10 minutes' AS closed, count(*) AS n FROM g GROUP BY k, g")
def st1_debounce(spark, sf_dir):
    out = ST.debounced(load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "event_type", "10 minutes")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first", "closed")})


@query(SESSION_SQL.format(key="user_id", gap="6 hours") + " SELECT k AS user_id, min(ts) AS first, max(ts) AS last, count(*) AS n, CASE WHEN count(*) >= 10 THEN 0.4 WHEN count(*) >= 5 THEN 0.3 WHEN count(*) >= 3 THEN 0.2 ELSE 0.1 END AS health FROM g GROUP BY k, g")
def st5_sessions(spark, sf_dir):
    out = ST.sessions(load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "6 hours")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first", "last")})


@query("SELECT user_id, event_id, seq FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE seq > 10 AND seq > n - 40")
def st6_replay(spark, sf_dir):
    return ST.replay(load(spark, sf_dir, "events"), 10, 40, "user_id", "event_id").select("user_id", "event_id", "seq")


@query("""WITH o AS (SELECT *, value > 15 AS o FROM events), e AS (SELECT *, sum(CASE WHEN o AND coalesce(lo, false) THEN 0 ELSE 1 END) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS run FROM (SELECT *, lag(o) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS lo FROM o)),
  r AS (SELECT *, min(ts) OVER (PARTITION BY event_type, run) AS since FROM e WHERE o), f AS (SELECT event_type, min(ts) AS "at" FROM r WHERE ts - since >= INTERVAL '1200 seconds' GROUP BY event_type, run),
  s AS (SELECT event_type, list_reduce(list_concat([{'at': CAST(NULL AS TIMESTAMP), 'sent': CAST([] AS TIMESTAMP[])}], list({'at': "at", 'sent': CAST([] AS TIMESTAMP[])} ORDER BY "at")), lambda x, y: CASE WHEN x.at IS NULL OR y.at - x.at > INTERVAL '3600 seconds' THEN {'at': y.at, 'sent': list_append(x.sent, y.at)} ELSE x END) AS s FROM f GROUP BY 1)
  SELECT event_type, unnest(s.sent) AS "at" FROM s""")
def st7_alerts(spark, sf_dir):
    return ST.breaches(load(spark, sf_dir, "events"), "event_type", 15.0, 1200, 3600)


@query("""WITH o AS (SELECT *, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events), m AS (SELECT *, max(g) OVER (PARTITION BY user_id) AS last FROM o), n AS (SELECT user_id, count(*) FILTER (event_type IN ('error', 'view') AND g = last) AS n_bad FROM m GROUP BY 1)
  SELECT user_id, n_bad, CASE WHEN n_bad >= 6 THEN 'blocked' WHEN n_bad >= 4 THEN 'escalated' WHEN n_bad >= 2 THEN 'warned' ELSE 'none' END AS level FROM n""")
def st8_escalation(spark, sf_dir):
    return ST.escalation(load(spark, sf_dir, "events"), ["user_id"], "click", ["error", "view"], ["ts", "event_id"])


#: Outcomes of a user, from events.
OUTCOME_SQL = "CASE event_type WHEN 'click' THEN 'followed' WHEN 'error' THEN 'ignored' WHEN 'view' THEN 'contradicted' ELSE 'surface' END"


def outcomes(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "followed").when(F.col("event_type") == "error", "ignored").when(F.col("event_type") == "view", "contradicted").otherwise("surface")
    return load(spark, sf_dir, "events").select("user_id", "ts", "event_id", kind.alias("kind"), "value")


@query(f"""WITH o AS (SELECT user_id, epoch_us(ts) / 1e6 AS ts, event_id, {OUTCOME_SQL} AS kind FROM events), s AS (SELECT user_id, list_reduce(list_concat([{{'t': 0.0::DOUBLE, 'kind': '', 'level': '', 'n': 0, 'at': 0.0::DOUBLE}}], list({{'t': ts, 'kind': kind, 'level': '', 'n': 0, 'at': 0.0::DOUBLE}} ORDER BY ts, event_id)),
  lambda x, y: {{'t': y.t, 'kind': y.kind, 'n': CASE WHEN y.kind = 'followed' THEN 0 WHEN y.kind = 'surface' THEN x.n ELSE x.n + 1 END, 'at': CASE WHEN x.level = '' OR y.kind = 'surface' THEN y.t ELSE x.at END, 'level': CASE WHEN y.kind = 'followed' THEN 'resolved' WHEN y.kind = 'surface' THEN CASE WHEN x.level = '' OR y.t - x.at > 86400 THEN 'surfaced' ELSE x.level END
    WHEN x.n + 1 >= 6 THEN 'blocked' WHEN x.n + 1 >= 4 THEN 'escalated' WHEN x.n + 1 >= 2 THEN 'warned' WHEN x.level = '' THEN 'surfaced' ELSE x.level END}}) AS s FROM o GROUP BY 1) SELECT user_id, s.level AS level, s.n AS ignored FROM s""")
def st8_levels(spark, sf_dir):
    """The level of each user after all outcomes, with decay after a day, by the machine that streams run."""
    rows = state.tracked(outcomes(spark, sf_dir), state.Escalation(decay=86400), ["user_id"])
    return rows.groupBy("user_id").agg(F.max_by(F.struct("level", "ignored"), "at").alias("s")).select("user_id", "s.level", "s.ignored")


@query("""WITH e AS (SELECT *, epoch_us(ts) / 1e6 AS t FROM events), g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 21600 THEN 0 ELSE 1 END AS n FROM e)),
  o AS (SELECT user_id, s, count(*) FILTER (event_type IN ('error', 'view', 'click')) AS observed, bool_or(event_type = 'purchase') AS resumed, count(*) AS n, round(max(t) - min(t), 3) AS seconds FROM g GROUP BY ALL)
  SELECT user_id, s AS nth, observed, resumed, seconds, round(least(1, 0.2 + CASE WHEN resumed THEN 0.4 ELSE 0 END + CASE WHEN observed >= 10 THEN 0.4 WHEN observed >= 5 THEN 0.3 WHEN observed >= 3 THEN 0.2 WHEN observed >= 1 THEN 0.1 ELSE 0 END), 6) AS health FROM o""")
def st5_session_health(spark, sf_dir):
    """Sessions of a user, ended six hours after the last event; a purchase resumes, clicks, views and errors are observations."""
    kind = F.when(F.col("event_type") == "purchase", "resume").when(F.col("event_type").isin("error", "view", "click"), "observe").otherwise("activity")
    rows = state.tracked(load(spark, sf_dir, "events").withColumn("kind", kind), state.Sessions(21600), ["user_id"])
    last = rows.groupBy("user_id", "first").agg(F.max_by(F.struct("observed", "resumed", "health"), F.struct("at", "observed")).alias("s"), F.round(F.max("at") - F.col("first"), 3).alias("seconds"))
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("first"))
    return last.select("user_id", nth.alias("nth"), "s.observed", "s.resumed", "seconds", F.round("s.health", 6).alias("health"))


@query("""WITH e AS (SELECT user_id, ts, event_id, value / 20 AS score, CAST(json_extract_string(props, '$.k') AS INT) / 100.0 AS heuristic FROM events WHERE event_type <> 'error'), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM e WHERE score IS NOT NULL AND heuristic IS NOT NULL)
  SELECT user_id, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(heuristic), 6) AS mean_heuristic, round(stddev_pop(score), 6) AS spread, CASE WHEN count(*) < 10 THEN 0 ELSE round(avg(score) - avg(heuristic), 6) END AS bias, count(*) >= 10 AND abs(avg(score) - avg(heuristic)) > 0.2 AS alert, count(*) < 10 AS insufficient FROM k WHERE k <= 20 GROUP BY 1""")
def st9_calibration(spark, sf_dir):
    """Each user's last 20 pairs of a score and a heuristic; errors are ignored outcomes."""
    e = load(spark, sf_dir, "events").select("user_id", "ts", "event_id", (F.col("value") / 20).alias("score"), (F.get_json_object("props", "$.k").cast("int") / 100).alias("heuristic"), F.when(F.col("event_type") == "error", "ignored").otherwise("").alias("outcome"))
    rows = state.tracked(e, state.Calibration(20, 10, 0.2), ["user_id"])
    cols = ["n", "mean_score", "mean_heuristic", "spread", "bias", "alert", "insufficient"]
    last = rows.groupBy("user_id").agg(F.max_by(F.struct(*cols), "at").alias("s")).select("user_id", "s.*")
    return last.withColumns({c: F.round(c, 6) for c in cols[1:5]})
