"""Event analytics over events and the star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..sources.tables import CALLS_SQL, EDGES_SQL, NODES_SQL, graph_edges, graph_nodes, interactions, load
from .registry import Registry

query = Registry()


def rounded(df, *cols, digits: int = 6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def points(spark, sf_dir):
    return load(spark, sf_dir, "events").withColumnRenamed("ts", "time")


@query("SELECT ts AS bucket, event_type, value AS avg_value FROM events WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-02 18:00:00'")
def s1_range_scan_raw(spark, sf_dir):
    return M.range_scan(points(spark, sf_dir), "2024-01-02", "2024-01-02 18:00:00", ["event_type"])


@query("SELECT date_trunc('day', ts) AS bucket, event_type, round(avg(value), 6) AS avg_value FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-20' GROUP BY ALL")
def s1_range_scan_builder(spark, sf_dir):
    return rounded(M.range_scan(points(spark, sf_dir), "2024-01-01", "2024-01-20", ["event_type"], "builder").withColumn("bucket", F.col("bucket").cast("timestamp_ntz")), "avg_value")


@query("SELECT date_trunc('hour', ts) AS bucket, event_type, round(avg(value), 6) AS avg_value, min(value) AS min_value, max(value) AS max_value, count(*) AS n FROM events GROUP BY ALL")
def a1_hourly_rollup(spark, sf_dir):
    return rounded(M.rollup(points(spark, sf_dir), "hour", ["event_type"]), "avg_value")


@query("SELECT date_trunc('day', ts) AS bucket, event_type, round(avg(value), 6) AS avg_value, min(value) AS min_value, max(value) AS max_value, count(*) AS n FROM events GROUP BY ALL")
def a1_daily_rollup(spark, sf_dir):
    return rounded(M.rollup(points(spark, sf_dir), "day", ["event_type"]), "avg_value")


@query(f"""SELECT task, count(*) AS n, count(*) FILTER (error <> '') AS errors, round(count(*) FILTER (error <> '') / count(*), 6) AS error_rate,
  round(quantile_cont(latency_ms, 0.5) FILTER (error = ''), 6) AS p50, round(quantile_cont(latency_ms, 0.95) FILTER (error = ''), 6) AS p95,
  round(avg(tokens), 6) AS avg_tokens, count(DISTINCT session_id) AS sessions, max(time) FILTER (error = '') AS last_good FROM {CALLS_SQL} GROUP BY task""")
def a2_call_performance(spark, sf_dir):
    return rounded(M.call_performance(interactions(spark, sf_dir)), "error_rate", "p50", "p95", "avg_tokens")


@query("SELECT round(sum(CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'click' THEN 0.5 ELSE 0 END) / count(*), 6) AS rate, count(*) AS n FROM events")
def a3_effectiveness(spark, sf_dir):
    credit = F.when(F.col("event_type") == "purchase", 1.0).when(F.col("event_type") == "click", 0.5).otherwise(0.0)
    return load(spark, sf_dir, "events").agg(F.round(F.sum(credit) / F.count("*"), 6).alias("rate"), F.count("*").alias("n"))


@query("""WITH u AS (SELECT l_returnflag AS class, CASE WHEN l_discount < 0.05 THEN 1.0 WHEN l_discount < 0.08 THEN 0.5 ELSE 0 END AS credit FROM lineitem
  UNION ALL SELECT CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'N' ELSE 'R' END, CASE WHEN o_totalprice > 200000 THEN 1.0 ELSE 0 END FROM orders)
  SELECT class, round(sum(credit) / nullif(count(*), 0), 6) AS rate, count(*) AS n FROM u GROUP BY class""")
def a4_effectiveness_by_class(spark, sf_dir):
    line, orders = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "orders")
    a = line.select(F.col("l_returnflag").alias("class"), F.when(F.col("l_discount") < 0.05, 1.0).when(F.col("l_discount") < 0.08, 0.5).otherwise(0.0).alias("credit"))
    alias = F.when(F.col("o_orderstatus") == "F", "A").when(F.col("o_orderstatus") == "O", "N").otherwise("R")
    b = orders.select(alias.alias("class"), F.when(F.col("o_totalprice") > 200000, 1.0).otherwise(0.0).alias("credit"))
    return a.unionByName(b).groupBy("class").agg(F.round(F.sum("credit") / F.nullif(F.count("*"), F.lit(0)), 6).alias("rate"), F.count("*").alias("n"))


@query("SELECT user_id, count(*) FILTER (event_type = 'click') AS followed, count(*) FILTER (event_type = 'view') AS ignored, count(*) FILTER (event_type = 'error') AS contradicted FROM events GROUP BY user_id")
def a5_outcome_pivot(spark, sf_dir):
    kinds = {"click": "followed", "view": "ignored", "error": "contradicted"}
    return load(spark, sf_dir, "events").groupBy("user_id").agg(*(F.count_if(F.col("event_type") == k).alias(v) for k, v in kinds.items()))


@query("""WITH r AS (SELECT o_orderkey AS id, o_totalprice AS latency, count(l_orderkey) AS k, count(l_orderkey) FILTER (l_returnflag = 'R') AS bad FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
  SELECT count(*) AS n, round(avg(CASE WHEN k > 0 THEN 1.0 ELSE 0 END), 6) AS non_empty_rate, round(avg(k), 6) AS avg_k, round(quantile_cont(latency, 0.5), 6) AS p50, round(quantile_cont(latency, 0.95), 6) AS p95,
  round(quantile_cont(latency, 0.99), 6) AS p99, count(*) FILTER (k > 0 AND bad = k) AS hard_negatives FROM r""")
def a6_retrieval_quality(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("k"), F.count_if(F.col("l_returnflag") == "R").alias("bad"))
    r = load(spark, sf_dir, "orders").join(lines, "o_orderkey", "left").fillna(0, ["k", "bad"])
    p = lambda q: F.round(F.percentile("o_totalprice", F.lit(q)), 6)
    return r.agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("k") > 0, 1.0).otherwise(0.0)), 6).alias("non_empty_rate"), F.round(F.avg("k"), 6).alias("avg_k"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.count_if((F.col("k") > 0) & (F.col("bad") == F.col("k"))).alias("hard_negatives"))


@query("""SELECT count(*) AS total, count(DISTINCT sha256(text)) AS distinct_hashes, round(avg(CASE WHEN n_chars > 2000 THEN 1.0 ELSE 0 END), 6) AS cache_hit_rate,
  count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'es') AS es FROM documents""")
def a7_embedding_coverage(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    return d.agg(F.count("*").alias("total"), F.countDistinct(F.sha2("text", 256)).alias("distinct_hashes"), F.round(F.avg(F.when(F.col("n_chars") > 2000, 1.0).otherwise(0.0)), 6).alias("cache_hit_rate"), *(F.count_if(F.col("lang") == x).alias(x) for x in ("en", "fr", "de", "es")))


@query("""WITH h AS (SELECT date_trunc('hour', ts) AS time, event_type, avg(value) AS v FROM events GROUP BY ALL), x AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY time) - 1 AS x FROM h)
  SELECT event_type, round(regr_slope(v, x), 6) AS slope, round(avg(v), 6) AS avg_value, round(min(v), 6) AS min_value, round(max(v), 6) AS max_value, round(stddev_pop(v) / abs(avg(v)), 6) AS volatility FROM x GROUP BY event_type""")
def a8_metric_trend(spark, sf_dir):
    hourly = M.rollup(points(spark, sf_dir), "hour", ["event_type"])
    return rounded(M.trend(hourly, ["event_type"], "bucket", "avg_value"), "slope", "avg_value", "min_value", "max_value", "volatility")


@query(f"""SELECT task, count(*) AS n, count(*) FILTER (error <> '') AS errors, round(count(*) / 30.0, 6) AS daily, round(greatest(0, 5000 - count(*)) / (count(*) / 30.0), 6) AS days_left,
  CASE WHEN count(*) < 1000 THEN 'too_few' WHEN count(*) FILTER (error <> '') > 0.1 * count(*) THEN 'errors' ELSE 'ready' END AS gate FROM {CALLS_SQL} GROUP BY task""")
def a9_training_readiness(spark, sf_dir):
    n, bad = F.count("*"), F.count_if(F.col("error") != "")
    gate = F.when(n < 1000, "too_few").when(bad > 0.1 * n, "errors").otherwise("ready")
    return interactions(spark, sf_dir).groupBy("task").agg(n.alias("n"), bad.alias("errors"), F.round(n / 30.0, 6).alias("daily"), F.round(F.greatest(F.lit(0), 5000 - n) / (n / 30.0), 6).alias("days_left"), gate.alias("gate"))


@query("SELECT greatest(0, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') - (SELECT count(*) FROM orders WHERE o_orderstatus = 'F')) AS drift")
def a10_production_drift(spark, sf_dir):
    o = F.col("o_orderstatus")
    return load(spark, sf_dir, "orders").agg(F.greatest(F.lit(0), F.count_if(o == "O") - F.count_if(o == "F")).alias("drift"))


@query("SELECT round(coalesce(avg(CASE WHEN ts >= TIMESTAMP '2024-01-15' THEN 1.0 ELSE 0 END), 1.0), 6) AS fresh FROM events")
def a11_fresh_fraction(spark, sf_dir):
    fresh = F.avg(F.when(F.col("ts") >= F.to_timestamp(F.lit("2024-01-15")), 1.0).otherwise(0.0))
    return load(spark, sf_dir, "events").agg(F.round(F.coalesce(fresh, F.lit(1.0)), 6).alias("fresh"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1 AND event_type <> 'error'")
def a12_latest_open_state(spark, sf_dir):
    return M.latest(load(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).where("event_type <> 'error'").select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type <> 'error') WHERE n = 1")
def a13_latest_valid_grade(spark, sf_dir):
    return M.latest(load(spark, sf_dir, "events").where("event_type <> 'error'"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "value")


BOUNDS = (5.0, 10.0, 20.0, 40.0, 80.0)


@query("""WITH b AS (SELECT event_type, unnest([5.0, 10.0, 20.0, 40.0, 80.0]) AS bound, unnest([0, 1, 2, 3, 4]) AS i FROM (SELECT DISTINCT event_type FROM events)),
  c AS (SELECT b.event_type, i, bound, count(*) FILTER (value <= bound) AS cumulative, count(*) AS total FROM b JOIN events e ON e.event_type = b.event_type GROUP BY ALL),
  d AS (SELECT *, coalesce(lag(cumulative) OVER (PARTITION BY event_type ORDER BY i), 0) AS below, coalesce(lag(bound) OVER (PARTITION BY event_type ORDER BY i), 0.0) AS low FROM c)
  SELECT event_type, round(coalesce(arg_min(CAST(low AS DOUBLE) + (bound - low) * (0.9 * total - below) / (cumulative - below), i) FILTER (cumulative >= 0.9 * total AND cumulative > below), max(bound)), 6) AS quantile FROM d GROUP BY event_type""")
def a15_histogram_quantile(spark, sf_dir):
    return rounded(M.histogram_quantile(M.histogram(load(spark, sf_dir, "events"), "value", BOUNDS, ["event_type"]), 0.9, ["event_type"]), "quantile")


@query("""SELECT event_type, CAST(bound AS DOUBLE) AS bound, count(*) FILTER (value <= bound) AS cumulative, count(*) AS total FROM events, (SELECT unnest([5.0, 10.0, 20.0, 40.0, 80.0]) AS bound) GROUP BY ALL""")
def a16_histogram_buckets(spark, sf_dir):
    return M.histogram(load(spark, sf_dir, "events"), "value", BOUNDS, ["event_type"]).select("event_type", "bound", "cumulative", "total")


@query("""SELECT *, high - low AS "range", n > 5 AND std < 0.05 AS flat, n > 5 AND mean < 0.3 AS low_mean, n > 5 AND high - low < 0.1 AS narrow FROM (
  SELECT user_id, count(*) AS n, round(avg(value / 100), 6) AS mean, round(stddev_pop(value / 100), 6) AS std, round(min(value / 100), 6) AS low, round(max(value / 100), 6) AS high, round(quantile_cont(value / 100, 0.1), 6) AS p10,
  round(quantile_cont(value / 100, 0.25), 6) AS p25, round(quantile_cont(value / 100, 0.5), 6) AS p50, round(quantile_cont(value / 100, 0.75), 6) AS p75, round(quantile_cont(value / 100, 0.9), 6) AS p90 FROM events GROUP BY user_id)""".replace('high - low AS "range"', 'round(high - low, 6) AS "range"'))
def a17_score_distribution(spark, sf_dir):
    e = load(spark, sf_dir, "events").withColumn("score", F.col("value") / 100)
    return rounded(M.distribution(e, ["user_id"]), "mean", "std", "low", "high", "p10", "p25", "p50", "p75", "p90", "range")


@query(f"SELECT count(*) AS edges, CASE WHEN count(*) <= 0 THEN 'cold' WHEN count(*) < 10000 THEN 'learning' WHEN count(*) < 50000 THEN 'warm' ELSE 'saturated' END AS phase FROM {EDGES_SQL}")
def a18_learning_phase(spark, sf_dir):
    from ..functions.scalars import learning_phase

    return graph_edges(spark, sf_dir).agg(F.count("*").alias("edges")).select("edges", learning_phase(F.col("edges")).alias("phase"))


@query("SELECT user_id, round(sum((value / 100) * CAST(json_extract_string(props, '$.k') AS INT) * 0.5) / sum(CAST(json_extract_string(props, '$.k') AS INT) * 0.5), 6) AS health FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) > 0 GROUP BY user_id")
def a19_weighted_health(spark, sf_dir):
    parts = load(spark, sf_dir, "events").select("user_id", F.get_json_object("props", "$.k").cast("int").alias("weight"), F.lit(0.5).alias("confidence"), (F.col("value") / 100).alias("score"))
    return rounded(M.weighted_health(parts, ["user_id"]), "health")


@query(f"WITH c AS (SELECT rel_type, count(*) AS n FROM {EDGES_SQL} GROUP BY 1) SELECT rel_type, n, round(n / sum(n) OVER (), 6) AS share, n / sum(n) OVER () > 0.5 AS dominant FROM c")
def a20_relation_distribution(spark, sf_dir):
    return M.share_of_total(graph_edges(spark, sf_dir), "rel_type").withColumn("dominant", F.col("share") > 0.5).withColumn("share", F.round("share", 6))


@query(f"""WITH e AS {EDGES_SQL}, n AS {NODES_SQL}, i AS (SELECT node_id FROM n WHERE node_id NOT IN (SELECT src FROM e WHERE weight > 0.9) AND node_id NOT IN (SELECT dst FROM e WHERE weight > 0.9))
  SELECT node_id FROM i WHERE (SELECT count(*) FROM i) < (SELECT count(*) FROM n)""")
def a21_isolated_nodes(spark, sf_dir):
    from ..operators.graph import isolated

    return isolated(graph_nodes(spark, sf_dir), graph_edges(spark, sf_dir).where("weight > 0.9"))


@query("""SELECT tag, count(*) AS n, round(avg(p_retailprice / 2000), 6) AS score FROM (SELECT unnest(string_split(p_name, ' ')) AS tag, p_retailprice FROM part) GROUP BY tag HAVING count(*) >= 5 AND avg(p_retailprice / 2000) < 0.8 ORDER BY score, tag LIMIT 10""")
def a22_low_scoring_domains(spark, sf_dir):
    tags = load(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("tag"), (F.col("p_retailprice") / 2000).alias("score"))
    out = tags.groupBy("tag").agg(F.count("*").alias("n"), F.avg("score").alias("raw")).where("n >= 5 and raw < 0.8")
    return out.select("tag", "n", F.round("raw", 6).alias("score")).orderBy("score", "tag").limit(10)


@query("""WITH t AS (SELECT DISTINCT conv_id, unnest(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+')) AS term FROM conversations WHERE role = 'user')
  SELECT term, count(*) AS n, list_slice(list_sort(list(conv_id)), 1, 5) AS examples FROM t WHERE length(term) >= 4 GROUP BY term HAVING count(*) >= 5""")
def a23_recurring_terms(spark, sf_dir):
    from ..functions.scalars import words

    t = load(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", F.explode(F.array_distinct(words(F.col("text")))).alias("term")).where("length(term) >= 4").distinct()
    first = t.withColumn("k", F.row_number().over(Window.partitionBy("term").orderBy("conv_id")))
    return first.groupBy("term").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.when(F.col("k") <= 5, F.col("conv_id")))).alias("examples")).where("n >= 5")


@query(f"""SELECT count(DISTINCT src) FILTER (last_used < TIMESTAMP '1996-01-01') AS stale_sources, count(DISTINCT dst) FILTER (last_used < TIMESTAMP '1996-01-01') AS stale_targets,
  count(*) FILTER (last_used < TIMESTAMP '1996-01-01') AS stale_edges, count(*) FILTER (evidence > 1) AS repeated FROM {EDGES_SQL}""")
def a24_stale_edge_stats(spark, sf_dir):
    stale = F.col("last_used") < F.to_timestamp(F.lit("1996-01-01"))
    return graph_edges(spark, sf_dir).agg(F.countDistinct(F.when(stale, F.col("src"))).alias("stale_sources"), F.countDistinct(F.when(stale, F.col("dst"))).alias("stale_targets"), F.count_if(stale).alias("stale_edges"), F.count_if(F.col("evidence") > 1).alias("repeated"))


@query("""WITH m AS (SELECT event_type AS task, 'value' AS metric, value AS x FROM events UNION ALL SELECT event_type, 'k', CAST(json_extract_string(props, '$.k') AS DOUBLE) FROM events)
  SELECT task, metric, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, min(x) AS low, max(x) AS high FROM m WHERE NOT isnan(x) GROUP BY ALL""")
def a25_multi_run_aggregate(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(F.col("event_type").alias("task"), F.explode(F.create_map(F.lit("value"), F.col("value"), F.lit("k"), F.get_json_object("props", "$.k").cast("double"))).alias("metric", "x"))
    out = e.where(~F.isnan("x")).groupBy("task", "metric").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("low"), F.max("x").alias("high"))
    return rounded(out, "mean", "std")


@query("""WITH p AS (SELECT l_returnflag AS category, l_quantity / 50 AS x, (l_quantity * (1 - l_discount)) / 50 AS y FROM lineitem)
  SELECT category, count(*) AS n, round(avg(x - y), 6) AS mean_delta, round(avg(x - y) / (stddev_samp(x - y) / sqrt(count(*))), 4) AS t, round(avg(x - y) / sqrt((var_samp(x) + var_samp(y)) / 2), 6) AS cohens_d,
  round(avg(x - y) - 1.96 * stddev_samp(x - y) / sqrt(count(*)), 6) AS low, round(avg(x - y) + 1.96 * stddev_samp(x - y) / sqrt(count(*)), 6) AS high, round(stddev_samp(x) / avg(x), 6) AS cv FROM p GROUP BY category""")
def a26_paired_statistics(spark, sf_dir):
    p = load(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("category"), (F.col("l_quantity") / 50).alias("x"), (F.col("l_quantity") * (1 - F.col("l_discount")) / 50).alias("y")).withColumn("d", F.expr("x - y"))
    se = F.stddev_samp("d") / F.sqrt(F.count("*"))
    return p.groupBy("category").agg(
        F.count("*").alias("n"), F.round(F.avg("d"), 6).alias("mean_delta"), F.round(F.avg("d") / se, 4).alias("t"), F.round(F.avg("d") / F.sqrt((F.var_samp("x") + F.var_samp("y")) / 2), 6).alias("cohens_d"),
        F.round(F.avg("d") - 1.96 * se, 6).alias("low"), F.round(F.avg("d") + 1.96 * se, 6).alias("high"), F.round(F.stddev_samp("x") / F.avg("x"), 6).alias("cv"),
    )


@query(f"SELECT role_type, layer, count(*) AS n FROM {NODES_SQL} GROUP BY ALL")
def a27_node_stats(spark, sf_dir):
    return graph_nodes(spark, sf_dir).groupBy("role_type", "layer").agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id, ts FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 100)")
def a28_clean_newest(spark, sf_dir):
    """All but the newest 100 of a category: the deletion's limit is the feature."""
    e = load(spark, sf_dir, "events")
    gone = e.where("event_type = 'error'").orderBy(F.desc("ts"), F.desc("event_id")).limit(100)
    return e.join(F.broadcast(gone.select("event_id")), "event_id", "left_anti").select("event_id", "user_id", "ts")


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL")
def a29_source_distribution(spark, sf_dir):
    return load(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("SELECT event_type, round(avg(n), 6) AS avg_n, max(n) AS max_n FROM (SELECT event_type, date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY ALL) GROUP BY event_type")
def a30_nested_bucket_counts(spark, sf_dir):
    per = load(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("h")).agg(F.count("*").alias("n"))
    return per.groupBy("event_type").agg(F.round(F.avg("n"), 6).alias("avg_n"), F.max("n").alias("max_n"))


@query("""WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) - 1 AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events),
  p AS (SELECT CASE WHEN n = 1 THEN 100 ELSE 100.0 * (n - 1 - r) / (n - 1) END AS p FROM r) SELECT CASE WHEN p >= 90 THEN 'HIGH' WHEN p >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS level, count(*) AS n FROM p GROUP BY ALL""")
def a31_confidence_levels(spark, sf_dir):
    from ..operators.rank import with_confidence

    return with_confidence(load(spark, sf_dir, "events"), ["user_id"], [F.desc("value"), F.asc("event_id")]).groupBy("level").agg(F.count("*").alias("n"))


@query("""SELECT o_custkey, o_orderkey, ev FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) o
  LEFT JOIN (SELECT user_id, max(event_id) AS ev FROM events GROUP BY 1) e ON e.user_id = o.o_custkey WHERE n = 1""")
def j13_lateral_latest(spark, sf_dir):
    last = M.latest(load(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey")
    events = load(spark, sf_dir, "events").groupBy(F.col("user_id").alias("o_custkey")).agg(F.max("event_id").alias("ev"))
    return last.join(events, "o_custkey", "left")


@query("SELECT event_id, ts FROM (SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) AS rn, count(*) OVER () AS n FROM events) WHERE (rn - 1) % greatest(n // 120, 1) = 0")
def w1_systematic_sample(spark, sf_dir):
    return M.running_count_quota(load(spark, sf_dir, "events").select("event_id", "ts"), [F.asc("ts"), F.asc("event_id")], 120)


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 100")
def w9_history_ring(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return load(spark, sf_dir, "events").withColumn("n", n).where("n <= 100").select("user_id", "event_id", "value")


@query("""SELECT DISTINCT key FROM (SELECT user_id AS key FROM events UNION ALL SELECT c_custkey FROM customer)""")
def u2_union_distinct(spark, sf_dir):
    return load(spark, sf_dir, "events").select(F.col("user_id").alias("key")).union(load(spark, sf_dir, "customer").select("c_custkey")).distinct()


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def u3_set_difference(spark, sf_dir):
    return load(spark, sf_dir, "customer").join(load(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("""WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), p AS (SELECT n / sum(n) OVER () AS p FROM c) SELECT round(CASE WHEN count(*) > 1 THEN -sum(p * ln(p)) / ln(count(*)) ELSE 0 END, 6) AS entropy, count(*) AS n_keys FROM p""")
def z4_source_diversity(spark, sf_dir):
    return rounded(M.entropy(load(spark, sf_dir, "documents"), "source"), "entropy")


@query(f"""WITH c AS (SELECT CAST(floor(weight * 10) AS INT) AS b, count(*) AS n FROM {EDGES_SQL} GROUP BY 1), p AS (SELECT n / sum(n) OVER () AS p FROM c) SELECT round(CASE WHEN count(*) > 1 THEN -sum(p * ln(p)) / ln(count(*)) ELSE 0 END, 6) AS entropy, count(*) AS n_keys FROM p""")
def z5_edge_weight_entropy(spark, sf_dir):
    return rounded(M.entropy(graph_edges(spark, sf_dir).withColumn("b", F.floor(F.col("weight") * 10).cast("int")), "b"), "entropy")


@query("""SELECT c_custkey, count(event_id) AS surfaced, count(*) FILTER (event_type = 'click') AS followed, count(*) FILTER (event_type = 'view') AS ignored, count(*) FILTER (event_type = 'error') AS contradicted FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY c_custkey""")
def z6_constraint_effectiveness(spark, sf_dir):
    t = F.col("event_type")
    out = load(spark, sf_dir, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count("*").alias("surfaced"), F.count_if(t == "click").alias("followed"), F.count_if(t == "view").alias("ignored"), F.count_if(t == "error").alias("contradicted"))
    return load(spark, sf_dir, "customer").select("c_custkey").join(out, "c_custkey", "left").fillna(0)


@query("""SELECT code, arg_max(tier, (rate, tier)) AS best, arg_min(tier, (rate, tier)) AS worst, count(*) AS tiers FROM (SELECT user_id AS code, CAST(json_extract_string(props, '$.k') AS INT) % 3 AS tier, count(*) AS n, avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0 END) AS rate FROM events GROUP BY ALL HAVING count(*) >= 3) GROUP BY code HAVING count(*) >= 2""")
def z9_tier_effectiveness(spark, sf_dir):
    tiers = load(spark, sf_dir, "events").groupBy(F.col("user_id").alias("code"), (F.get_json_object("props", "$.k").cast("int") % 3).alias("tier")).agg(F.count("*").alias("n"), F.avg(F.when(F.col("event_type") == "click", 1.0).otherwise(0.0)).alias("rate")).where("n >= 3")
    order = F.struct("rate", "tier")
    return tiers.groupBy("code").agg(F.max_by("tier", order).alias("best"), F.min_by("tier", order).alias("worst"), F.count("*").alias("tiers")).where("tiers >= 2")


@query("SELECT user_id, CAST(floor(date_diff('second', max(ts), TIMESTAMP '2024-01-31') / 3600) AS BIGINT) AS hours, date_diff('second', max(ts), TIMESTAMP '2024-01-31') / 3600 >= 24 AS stale FROM events GROUP BY user_id")
def z10_freshness(spark, sf_dir):
    hours = F.timestamp_diff("SECOND", F.date_trunc("second", F.max("ts")), F.to_timestamp(F.lit("2024-01-31"))) / 3600
    return load(spark, sf_dir, "events").groupBy("user_id").agg(F.floor(hours).alias("hours"), (hours >= 24).alias("stale"))


@query("""SELECT o_orderkey, round(d / (d + 30.0), 6) AS confidence, CASE WHEN d > 90 THEN 'warning' ELSE 'info' END AS severity FROM (SELECT o_orderkey, date_diff('day', o_orderdate, TIMESTAMP '2001-01-01') AS d FROM orders) WHERE d > 30""")
def z11_stale_update(spark, sf_dir):
    d = load(spark, sf_dir, "orders").select("o_orderkey", F.datediff(F.to_date(F.lit("2001-01-01")), F.col("o_orderdate")).alias("d")).where("d > 30")
    return d.select("o_orderkey", F.round(F.col("d") / (F.col("d") + 30.0), 6).alias("confidence"), F.when(F.col("d") > 90, "warning").otherwise("info").alias("severity"))
