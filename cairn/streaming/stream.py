"""Structured Streaming forms of the event operators; each has a batch twin that gives the same rows for a finished input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def file_stream(spark: SparkSession, path: str, schema, files: int = 1, fmt: str = "parquet", endings: Sequence[str] = ()) -> DataFrame:
    """New files of a folder with one of the endings, `files` to a batch: the bound that keeps a slow reader from falling over."""
    stream = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files)
    return (stream.option("pathGlobFilter", "*.{" + ",".join(endings) + "}") if endings else stream).load(path)


def continuous_rollup(events: DataFrame, keys: Sequence[str], width: str = "1 hour", late: str = "3 hours", time: str = "ts", value: str = "value") -> DataFrame:
    """avg, min, max, count by tumbling window; rows later than the watermark are dropped when streaming."""
    e = events.withWatermark(time, late) if events.isStreaming else events
    out = e.groupBy(F.window(time, width), *keys).agg(F.avg(value).alias("avg_value"), F.min(value).alias("min_value"), F.max(value).alias("max_value"), F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("bucket"), *keys, "avg_value", "min_value", "max_value", "n")


def debounced(events: DataFrame, key: str, gap: str, late: str = "1 hour", time: str = "ts") -> DataFrame:
    """One row for each burst of a key: bursts end after `gap` without an event."""
    e = events.withWatermark(time, late) if events.isStreaming else events
    out = e.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("first"), F.col("w.end").alias("closed"), "n")


def append_batches(events: DataFrame, path: str, checkpoint: str, partition: str | None = None) -> StreamingQuery:
    """Micro-batches appended as Parquet; the checkpoint makes a restart go on where it stopped."""
    w = events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
    return (w.partitionBy(partition) if partition else w).start()


def breaches(events: DataFrame, key: str, threshold: float, hold: int, cooldown: int, time: str = "ts", value: str = "value", bucket: int = 3600, id_col: str = "event_id") -> DataFrame:
    """(key, at): alerts of a key, as state.Alerts sends them for one rule: the first row after `hold` seconds above the threshold on end, once for each run of such rows, and none up to `cooldown` seconds after the last that was sent.

    A run begins after the last row that is not above: found within buckets of `bucket` seconds, and before them in the
    buckets' last ones, so that no task has all rows of a key. Of a run one row is left, and these alone meet by key.
    """
    at = F.struct(F.col(time).alias("t"), F.col(id_col).alias("i"))
    e = events.where(F.col(time).isNotNull()).select(key, time, id_col, (F.col(value) > threshold).alias("over"), F.floor(F.unix_timestamp(F.col(time).cast("timestamp")) / bucket).alias("bucket"))
    e = e.withColumn("over", F.coalesce("over", F.lit(False)))
    low = F.when(~F.col("over"), at)
    ends = e.groupBy(key, "bucket").agg(F.max(low).alias("low"))
    before = F.max("low").over(Window.partitionBy(key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.select(key, "bucket", before.alias("carried"))
    inner = F.max(low).over(Window.partitionBy(key, "bucket").orderBy(time, id_col))
    over = e.withColumn("inner", inner).where("over").join(carried, [key, "bucket"]).withColumn("cleared", F.coalesce("inner", "carried")).select(key, time, "cleared")
    runs = over.groupBy(key, "cleared").agg(F.min(time).alias("since")).select(F.col(key).alias("k"), F.col("cleared").alias("c"), "since")
    held = over.join(runs, F.col(key).eqNullSafe(F.col("k")) & F.col("cleared").eqNullSafe(F.col("c"))).where(F.timestamp_diff("MICROSECOND", F.col("since"), F.col(time)) >= hold * 1_000_000)
    fired = held.groupBy(key, "cleared").agg(F.min(time).alias("at")).select(key, "at")
    return spaced(fired, key, cooldown)


def spaced(rows: DataFrame, key: str, least: int) -> DataFrame:
    """rows(key, at) → those that are taken in order of time, each more than `least` seconds after the one taken before it."""
    import numpy as np
    import pyarrow as pa

    def take(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        seconds, keep, last = table.column("at").cast(pa.timestamp("us")).to_numpy().astype("datetime64[us]").astype(np.int64), [], None
        for i, t in enumerate(seconds.tolist()):
            if last is None or t - last > least * 1_000_000:
                keep.append(i)
                last = t
        return table.take(keep)

    return rows.groupBy(key).applyInArrow(take, rows.schema)


def sessions(events: DataFrame, key: str, gap: str, time: str = "ts") -> DataFrame:
    """Sessions of a key with count, length in seconds and health: 0.1 / 0.2 / 0.3 / 0.4 at 1 / 3 / 5 / 10 events, and 0.4 if resumed after another."""
    e = events.withWatermark(time, gap) if events.isStreaming else events
    out = e.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"), F.min(time).alias("first"), F.max(time).alias("last"))
    n = F.col("n")
    return out.select(key, "first", "last", "n", F.when(n >= 10, 0.4).when(n >= 5, 0.3).when(n >= 3, 0.2).otherwise(0.1).alias("health"))


def escalation(outcomes: DataFrame, key: Sequence[str], good: str, bad: Sequence[str], order: Sequence[str], levels: Sequence[int] = (2, 4, 6)) -> DataFrame:
    """Level of each key after its outcomes in order: bad ones since the last good one, as none, warned, escalated, blocked."""
    w = Window.partitionBy(*key).orderBy(*order)
    o = outcomes.withColumn("g", F.sum(F.when(F.col("event_type") == good, 1).otherwise(0)).over(w))
    last = F.max("g").over(Window.partitionBy(*key))
    n = F.count_if(F.col("event_type").isin(*bad) & (F.col("g") == F.col("last")))
    out = o.withColumn("last", last).groupBy(*key).agg(n.alias("n_bad"))
    k = F.col("n_bad")
    return out.withColumn("level", F.when(k >= levels[2], "blocked").when(k >= levels[1], "escalated").when(k >= levels[0], "warned").otherwise("none"))


def replay(events: DataFrame, since: int, ring: int, key: str, order: str) -> DataFrame:
    """Of each key the rows after number `since` that its ring of the last `ring` still holds, numbered from 1."""
    w = Window.partitionBy(key)
    out = events.withColumns({"seq": F.row_number().over(w.orderBy(order)), "_n": F.count("*").over(w)})
    return out.where((F.col("seq") > since) & (F.col("seq") > F.col("_n") - ring)).drop("_n")
