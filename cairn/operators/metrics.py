"""Event analytics: rollups, trends, filtered summaries, latest states, histograms, health."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def granularity(hours: float, preset: str = "reader") -> str:
    """raw, hourly or daily by the length of the range; the two presets differ in where daily begins."""
    days = {"reader": 30, "builder": 7}[preset]
    return "raw" if hours <= 24 else "hourly" if hours <= 24 * days else "daily"


def rollup(events: DataFrame, unit: str, keys: Sequence[str], time: str = "time", value: str = "value") -> DataFrame:
    """avg, min, max and count of value for each bucket and key. unit: hour, day, ..."""
    return events.groupBy(F.date_trunc(unit, F.col(time)).alias("bucket"), *keys).agg(
        F.avg(value).alias("avg_value"), F.min(value).alias("min_value"), F.max(value).alias("max_value"), F.count("*").alias("n")
    )


def range_scan(events: DataFrame, begin: str, end: str, keys: Sequence[str], preset: str = "reader", time: str = "time", value: str = "value") -> DataFrame:
    """Points of [begin, end): raw rows for a short range, else the rollup that the range's length asks for."""
    rows = events.where((F.col(time) >= F.to_timestamp(F.lit(begin))) & (F.col(time) < F.to_timestamp(F.lit(end))))
    import datetime as dt

    hours = (dt.datetime.fromisoformat(end) - dt.datetime.fromisoformat(begin)).total_seconds() / 3600
    kind = granularity(hours, preset)
    if kind == "raw":
        return rows.select(F.col(time).alias("bucket"), *keys, F.col(value).cast("double").alias("avg_value"))
    return rollup(rows, {"hourly": "hour", "daily": "day"}[kind], keys, time, value).select("bucket", *keys, "avg_value")


def trend(points: DataFrame, keys: Sequence[str], time: str = "time", value: str = "value") -> DataFrame:
    """slope over the row's number, avg, min, max, and volatility: population deviation over the mean's size."""
    x = F.row_number().over(Window.partitionBy(*keys).orderBy(time)) - 1
    stats = points.withColumn("_x", x.cast("double")).groupBy(*keys)
    return stats.agg(
        F.coalesce(F.regr_slope(F.col(value), F.col("_x")), F.lit(0.0)).alias("slope"), F.avg(value).alias("avg_value"), F.min(value).alias("min_value"), F.max(value).alias("max_value"),
        F.when(F.avg(value) != 0, F.stddev_pop(value) / F.abs(F.avg(value))).otherwise(0.0).alias("volatility"),
    )


def call_performance(calls: DataFrame) -> DataFrame:
    """For each task: calls, errors, their rate, p50 and p95 latency of calls without error, tokens, sessions, last error-free time."""
    good = F.coalesce("error", F.lit("")) == ""
    return calls.groupBy("task").agg(
        F.count("*").alias("n"), F.count_if(~good).alias("errors"), (F.count_if(~good) / F.count("*")).alias("error_rate"),
        F.percentile(F.when(good, F.col("latency_ms")), F.lit(0.5)).alias("p50"), F.percentile(F.when(good, F.col("latency_ms")), F.lit(0.95)).alias("p95"),
        F.avg("tokens").alias("avg_tokens"), F.countDistinct("session_id").alias("sessions"), F.max(F.when(good, F.col("time"))).alias("last_good"),
    )


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the order given."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def share_of_total(df: DataFrame, key: str) -> DataFrame:
    """Rows of each key and their share of all; the total is one row joined beside them."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).select(key, "n", (F.col("n") / F.col("total")).alias("share"))


def entropy(df: DataFrame, key: str) -> DataFrame:
    """Normalised Shannon entropy of the key's shares; 0 with one key or none."""
    p = share_of_total(df, key)
    return p.agg(F.when(F.count("*") > 1, -F.sum(F.col("share") * F.log("share")) / F.log(F.count("*"))).otherwise(0.0).alias("entropy"), F.count("*").alias("n_keys"))


def histogram(df: DataFrame, value: str, bounds: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Cumulative counts at each bound, as (keys, bound, cumulative, total)."""
    counts = [F.count_if(F.col(value) <= b).alias(f"_{i}") for i, b in enumerate(bounds)]
    wide = df.groupBy(*keys).agg(F.count("*").alias("total"), *counts)
    pairs = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(b)).alias("bound"), F.col(f"_{i}").alias("cumulative")) for i, b in enumerate(bounds)))
    return wide.select(*keys, "total", F.explode(pairs).alias("b")).select(*keys, "total", "b.*")


def histogram_quantile(buckets: DataFrame, q: float, keys: Sequence[str] = ()) -> DataFrame:
    """Interpolated within the bucket that holds rank q * total; above the last bound, that bound."""
    w = Window.partitionBy(*keys).orderBy("i")
    b = buckets.withColumns({"below": F.coalesce(F.lag("cumulative").over(w), F.lit(0)), "low": F.coalesce(F.lag("bound").over(w), F.lit(0.0))})
    rank = F.lit(q) * F.col("total")
    hit = (F.col("cumulative") >= rank) & (F.col("cumulative") > F.col("below"))
    value = F.col("low") + (F.col("bound") - F.col("low")) * (rank - F.col("below")) / (F.col("cumulative") - F.col("below"))
    return b.groupBy(*keys).agg(F.coalesce(F.min_by(F.when(hit, value), F.when(hit, F.col("i"))), F.max("bound")).alias("quantile"))


def distribution(scores: DataFrame, keys: Sequence[str], score: str = "score") -> DataFrame:
    """mean, population deviation, extremes, p10 to p90 by linear interpolation, and three alerts for groups of over five."""
    at = [0.1, 0.25, 0.5, 0.75, 0.9]
    out = scores.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), F.min(score).alias("low"), F.max(score).alias("high"), *(F.percentile(score, F.lit(p)).alias(f"p{int(p * 100)}") for p in at)
    )
    many = F.col("n") > 5
    return out.withColumns({"range": F.col("high") - F.col("low"), "flat": many & (F.col("std") < 0.05), "low_mean": many & (F.col("mean") < 0.3), "narrow": many & (F.col("high") - F.col("low") < 0.1)})


def weighted_health(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """sum(w c s) / sum(w c) over parts(weight, confidence, score) with weight and confidence above 0; 0 if none."""
    good = parts.where("weight > 0 and confidence > 0")
    return good.groupBy(*keys).agg((F.sum(F.col("weight") * F.col("confidence") * F.col("score")) / F.sum(F.col("weight") * F.col("confidence"))).alias("health"))


def running_count_quota(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """Every k-th row, k so that about n remain: (row - 1) % greatest(rows / n, 1) = 0, over ranges that are numbered without one global window."""
    total = df.count()
    step = max(total // n, 1)
    ranged = df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    ranged = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_k"))
    base = sizes.withColumn("_b", F.coalesce(F.sum("_k").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_k")
    return ranged.join(F.broadcast(base), "_p").where((F.col("_b") + F.col("_n") - 1) % step == 0).drop("_p", "_n", "_b")
