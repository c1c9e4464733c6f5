"""Ranking: lists, fusion, gates, quotas and scores. A ranked frame has node_id, score and, once ranked, rank from 1."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import cosine
from ..sources.scratch import stored


def ranked(df: DataFrame, keys: Sequence[str] = (), score: str = "score", tie: str = "node_id") -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), F.asc(tie))))


def vector_top_k(vectors: DataFrame, query: Sequence[float], k: int, id_col: str = "vec_id", vector: str = "embedding", floor: float | None = None) -> DataFrame:
    """The k nearest by cosine: scored in one scan, kept by a heap in each task, with rank."""
    q = F.array(*(F.lit(float(x)) for x in query))
    scored = vectors.select(F.col(id_col).alias("node_id"), cosine(F.col(vector), q).alias("score"))
    if floor is not None:
        scored = scored.where(F.col("score") >= floor)
    return ranked(scored.orderBy(F.desc("score"), "node_id").limit(k))


def bm25(docs: DataFrame, terms: Sequence[str], k1: float = 1.2, b: float = 0.75, id_col: str = "node_id", tokens: str = "tokens") -> DataFrame:
    """BM25 of each document with one of the terms. Lengths and document frequencies are taken over all documents."""
    terms = list(dict.fromkeys(terms))
    tf = [_count(tokens, t) for t in terms]
    per = stored(docs.select(F.col(id_col).alias("node_id"), F.size(tokens).alias("len"), *(c.alias(f"tf{i}") for i, c in enumerate(tf))))  # texts are cut once, for statistics and scores
    stats = per.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    part = lambda i: F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)) * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    total = sum((part(i) for i in range(len(terms))), F.lit(0.0))
    return per.crossJoin(F.broadcast(stats)).where(sum((F.col(f"tf{i}") for i in range(len(terms))), F.lit(0)) > 0).select("node_id", total.alias("score"))


def _count(tokens: str, term: str) -> Column:
    return F.size(F.filter(F.col(tokens), lambda w: w == term))


def rank_fusion(a: DataFrame, b: DataFrame, weight_a: float = 0.6, weight_b: float = 0.4, k: int = 60) -> DataFrame:
    """Full outer join of two ranked lists on node_id; w / (k + rank) from each list that has the node."""
    x, y = a.select("node_id", F.col("rank").alias("rank_a")), b.select("node_id", F.col("rank").alias("rank_b"))
    score = F.coalesce(weight_a / (k + F.col("rank_a")), F.lit(0.0)) + F.coalesce(weight_b / (k + F.col("rank_b")), F.lit(0.0))
    return x.join(y, "node_id", "full").select("node_id", "rank_a", "rank_b", score.alias("score"))


def consensus(columns: dict[str, DataFrame], weights: dict[str, float], k: int = 60, attempted: int | None = None) -> DataFrame:
    """Fusion of any number of ranked lists: score, columns that have the node, and strength = coverage * mean of 1 - (rank - 1) / list length. Columns that were tried and failed stay in the denominator."""
    n = attempted or len(columns)
    union = None
    for name, df in columns.items():
        own = df.select(F.lit(name).alias("column"), F.lit(max(0.0, weights.get(name, 1.0))).alias("w"), "node_id", "rank")
        own = own.join(F.broadcast(own.agg(F.max("rank").alias("max_rank"))), F.lit(True))
        union = own if union is None else union.unionByName(own)
    near = 1 - (F.col("rank") - 1) / F.col("max_rank")
    return union.groupBy("node_id").agg(F.sum(F.col("w") / (k + F.col("rank"))).alias("score"), F.count("*").alias("n_columns"), F.least(F.lit(1.0), F.count("*") / F.lit(n) * F.avg(near)).alias("strength"))


def with_confidence(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """percentile = round(100 (n - 1 - r) / (n - 1), 1), 100 for a single row; level HIGH from 90, MEDIUM from 40, else LOW."""
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    n = F.count("*").over(Window.partitionBy(*keys))
    out = df.withColumns({"_r": r, "_n": n})
    raw = F.when(F.col("_n") == 1, 100.0).otherwise(100.0 * (F.col("_n") - 1 - F.col("_r")) / (F.col("_n") - 1))
    return out.withColumns({"percentile": F.round(raw, 1), "level": F.when(raw >= 90, "HIGH").when(raw >= 40, "MEDIUM").otherwise("LOW")}).drop("_r", "_n")


def sparse_gate(df: DataFrame, keys: Sequence[str], q: float, least: int, most: int, score: str = "score", tie: str = "node_id") -> DataFrame:
    """Of each key: rows at or above the q-th percentile of its scores, at least `least` and at most `most` of them."""
    cut = df.groupBy(*keys).agg(F.percentile(score, F.lit(q)).alias("_cut"))
    out = ranked(df, keys, score, tie).join(cut, list(keys))
    return out.where((F.col("rank") <= most) & ((F.col(score) >= F.col("_cut")) | (F.col("rank") <= least))).drop("_cut")


def diverse(df: DataFrame, top_k: int, per_name: int, least: int, keys: Sequence[str], name: str = "name") -> DataFrame:
    """In rank order at most per_name rows a name (an empty one is exempt), up to top_k; then the best of the rest up to `least`."""
    nth = F.row_number().over(Window.partitionBy(*keys, name).orderBy("rank"))
    flagged = df.withColumn("_ok", (F.coalesce(F.col(name), F.lit("")) == "") | (nth <= per_name))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_ok"), "rank"))
    n_ok = F.sum(F.col("_ok").cast("int")).over(Window.partitionBy(*keys))
    return flagged.withColumns({"_place": place, "_n": n_ok}).where((F.col("_place") <= top_k) & (F.col("_ok") | (F.col("_place") <= least))).drop("_ok", "_n").withColumnRenamed("_place", "place")


def concrete_quota(df: DataFrame, keys: Sequence[str], top_k: int, slots: int, concrete: Column) -> DataFrame:
    """If fewer than min(slots, top_k) of the top_k are concrete, the best `slots` concrete rows go to the front; then top_k."""
    w = Window.partitionBy(*keys)
    out = df.withColumn("_c", concrete.cast("int")).withColumn("_nth", F.sum("_c").over(w.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
    have = F.sum(F.when(F.col("rank") <= top_k, F.col("_c")).otherwise(0)).over(w)
    up = (have < min(slots, top_k)) & (F.col("_c") == 1) & (F.col("_nth") <= slots)
    out = out.withColumn("_up", up).withColumn("place", F.row_number().over(w.orderBy(F.desc("_up"), "rank")))
    return out.where(F.col("place") <= top_k).drop("_c", "_nth", "_up")


def suppress_paths(df: DataFrame, paths: DataFrame, factor: float, keys: Sequence[str] = ()) -> DataFrame:
    """Scores of rows whose path is in paths(path) are multiplied by factor; ranks are taken anew."""
    hit = paths.select(F.col("path").alias("_p")).distinct()
    out = df.join(hit, F.col("path") == F.col("_p"), "left")
    return ranked(out.withColumn("score", F.when(F.col("_p").isNotNull(), F.col("score") * factor).otherwise(F.col("score"))).drop("_p"), keys)


def rerank(df: DataFrame, scores: DataFrame, n: int, weight: float, return_k: int) -> DataFrame:
    """(1 - w) score + w rerank over the first n (a missing rerank is 0.5), score * 0.95 beyond; the best return_k."""
    out = df.join(scores.select("node_id", F.col("score").alias("_r")), "node_id", "left")
    blended = F.when(F.col("rank") <= n, (1 - weight) * F.col("score") + weight * F.coalesce("_r", F.lit(0.5))).otherwise(F.col("score") * 0.95)
    return out.withColumn("score", blended).drop("_r", "rank").orderBy(F.desc("score"), "node_id").limit(return_k)


def merged(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """primary, then the rows of secondary whose node it lacks."""
    return primary.unionByName(secondary.join(primary.select("node_id"), "node_id", "left_anti"))


def per_source_cap(df: DataFrame, source: str, n: int, order: Sequence[Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(source).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def linear_score(c: dict[str, Column], alpha: float = 0.55, gamma: float = 0.1, beta: float = 0.25, delta: float = 0.1, phi: float = 0.03, kappa: float = 0.02) -> Column:
    """alpha V + gamma BM25 + beta A + delta R - phi ln(1 + degree) - kappa min(hops, 3), over named columns."""
    return alpha * c["vector"] + gamma * c["bm25"] + beta * F.greatest(c["activation"], F.lit(0.0)) + delta * c["recency"] - phi * F.log1p(c["degree"]) - kappa * F.least(c["hops"], F.lit(3))


def round_robin(df: DataFrame, stratum: str, order: Sequence[Column], n: int) -> DataFrame:
    """The first of each stratum, then the second of each, and so on, until n."""
    nth = F.row_number().over(Window.partitionBy(stratum).orderBy(*order))
    return df.withColumn("nth", nth).where(F.col("nth") <= n).orderBy("nth", stratum).limit(n)


def bucketed(df: DataFrame, keys: Sequence[str], bucket: Column, value: Column) -> DataFrame:
    """df with _bucket, _before (sum of value over the key's earlier buckets) and _all (over all): what a window over a whole key would need, without one task for each key. bucket: a whole number, in the order wanted."""
    rows = df.withColumn("_bucket", bucket)
    sums = rows.groupBy(*keys, "_bucket").agg(F.sum(value).alias("_v")).withColumn("_super", F.floor(F.col("_bucket") / 1000))
    ahead = lambda *by: F.coalesce(F.sum("_v").over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tops = sums.groupBy(*keys, "_super").agg(F.sum("_v").alias("_v"))
    tops = tops.select(*keys, "_super", ahead(*keys, "_super").alias("_top"), F.sum("_v").over(Window.partitionBy(*keys)).alias("_all"))
    before = sums.withColumn("_in", ahead(*keys, "_super", "_bucket")).join(tops, [*keys, "_super"]).select(*keys, "_bucket", (F.col("_in") + F.col("_top")).alias("_before"), "_all")
    return rows.join(before, [*keys, "_bucket"])


def running_sum(df: DataFrame, keys: Sequence[str], order: str, value: str, width: int = 1000) -> DataFrame:
    """df with running (sum of value up to the row in the order of a whole-numbered column) and total rows of its key as `peers`."""
    out = bucketed(df, keys, F.floor(F.col(order) / width), F.col(value))
    w = Window.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    peers = df.groupBy(*keys).agg(F.count("*").alias("peers"))
    return out.withColumn("running", F.col("_before") + F.sum(value).over(w)).drop("_bucket", "_before", "_all").join(peers, list(keys))


def nth_by_hash(df: DataFrame, keys: Sequence[str], hexadecimal: Column, digits: int = 3) -> DataFrame:
    """df with nth (from 1, in the order of a hexadecimal hash) and peers, within each key; 16^digits buckets a key."""
    rows = df.withColumn("_h", hexadecimal)
    out = bucketed(rows, keys, F.conv(F.substring("_h", 1, digits), 16, 10).cast("long"), F.lit(1))
    nth = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy("_h"))
    return out.withColumn("nth", F.col("_before") + nth).withColumnRenamed("_all", "peers").drop("_bucket", "_before", "_h")
