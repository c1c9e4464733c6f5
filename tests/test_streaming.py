"""Streams over finished files give the rows of their batch twins."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cairn.streaming import state, stream


def test_rollup_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    source, future = str(tmp_path / "in"), events.orderBy("ts").limit(1).withColumn("ts", F.to_timestamp(F.lit("2030-01-01")))
    events.coalesce(1).write.parquet(source)
    live = stream.file_stream(spark, source, events.schema)
    q = stream.continuous_rollup(live, ["event_type"]).writeStream.format("memory").queryName("rolled").outputMode("append").start()
    q.processAllAvailable()
    future.write.mode("append").parquet(source)  # moves the watermark past all windows
    q.processAllAvailable()
    q.stop()
    rows = lambda df: sorted((str(r.bucket), r.event_type, round(r.avg_value, 6), r.n) for r in df.collect())
    assert rows(spark.table("rolled")) == rows(stream.continuous_rollup(events, ["event_type"]))


def test_append_restarts_without_repeats(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    events.repartition(3).write.parquet(source)
    for _ in range(2):
        stream.append_batches(stream.file_stream(spark, source, events.schema), out, mark).awaitTermination()
    assert spark.read.parquet(out).count() == events.count()


# --- keyed state

BASE = 1_700_000_000


def alert_events(spark, rows):
    """rows: (seconds, rule, value)."""
    df = spark.createDataFrame([(i, float(BASE + t), rule, "svc", "high", v) for i, (t, rule, v) in enumerate(rows)], "event_id long, t double, rule string, service string, severity string, value double")
    return df.withColumn("ts", F.timestamp_seconds("t")).withColumn("scope", F.lit("all"))


def sent(rows):
    return [(r.at - BASE, r.service, r.kind) for r in rows.orderBy("at", "service").collect()]


def test_cooldown_counts_from_what_was_sent(spark):
    over = [(t, "r", v) for x in (0, 3000, 6000) for t, v in ((x, 9.0), (x + 1, 0.0))]
    e = alert_events(spark, over)
    assert sent(state.tracked(e, state.Alerts(5, 0, 3600), ["scope"])) == [(0, "svc", "breach"), (6000, "svc", "breach")]
    assert [r["at"].timestamp() - BASE for r in stream.breaches(e, "rule", 5, 0, 3600).orderBy("at").collect()] == [0, 6000]
    # exactly at the end of the cooldown it still holds
    e = alert_events(spark, [(0, "r", 9.0), (1, "r", 0.0), (3600, "r", 9.0), (3601, "r", 0.0), (3602, "r", 9.0)])
    assert sent(state.tracked(e, state.Alerts(5, 0, 3600), ["scope"])) == [(0, "svc", "breach"), (3602, "svc", "breach")]


def test_hold_and_shared_cooldown(spark):
    e = alert_events(spark, [(0, "a", 9.0), (50, "a", 9.0), (60, "a", 9.0), (70, "a", 9.0), (80, "b", 9.0), (200, "b", 9.0), (300, "a", 1.0), (400, "a", 9.0), (460, "a", 9.0)])
    assert sent(state.tracked(e, state.Alerts(5, 60, 100), ["scope"])) == [(60, "svc", "breach"), (200, "svc", "breach"), (460, "svc", "breach")]
    assert sent(state.tracked(e, state.Alerts(5, 60, 1000), ["scope"])) == [(60, "svc", "breach")]


def test_failed_rules_are_reported_once(spark):
    fails = [(t, "bad", None) for t in range(0, 60, 10)]
    alone = alert_events(spark, [(t, r, None) for t in range(0, 60, 10) for r in ("bad", "worse")])
    assert sent(state.tracked(alone, state.Alerts(5), ["scope"])) == [(20, "evaluator-degraded", "health")]
    beside = alert_events(spark, [*fails, (15, "good", 1.0)])
    assert sent(state.tracked(beside, state.Alerts(5), ["scope"])) == [(20, "rule-health-bad", "health")]
    again = alert_events(spark, [*fails, (15, "good", 1.0), (100, "bad", 1.0), *[(t, "bad", None) for t in (110, 120, 130)], (125, "good", 1.0)])
    assert sent(state.tracked(again, state.Alerts(5), ["scope"])) == [(20, "rule-health-bad", "health"), (130, "rule-health-bad", "health")]
    # a failure ends what was true
    reset = alert_events(spark, [(0, "a", 9.0), (30, "a", None), (60, "a", 9.0), (119, "a", 9.0)])
    assert sent(state.tracked(reset, state.Alerts(5, 60), ["scope"])) == []


def test_runs_across_buckets(spark):
    """The batch form in buckets of any width equals the machine, key by key."""
    rng = random.Random(3)
    rows, t = [], 0
    for _ in range(1500):
        t += rng.choice([0, 1, 20, 300])
        rows.append((t, rng.choice("ab"), rng.choice([9.0, 9.0, 9.0, 9.0, 1.0, None])))
    e = alert_events(spark, rows).withColumn("service", F.col("rule"))
    want = sorted((r.service, r.at) for r in state.tracked(e, state.Alerts(5, 240, 2000, failures=10**6), ["rule"]).collect())
    assert len(want) > 10
    for bucket in (60, 3600, 10**7):
        assert sorted((r.rule, r["at"].timestamp()) for r in stream.breaches(e, "rule", 5, 240, 2000, bucket=bucket).collect()) == want


def test_escalation_decays_the_level_and_keeps_the_count(spark):
    kinds = ["surface", "ignored", "contradicted", "ignored", "ignored", "surface", "ignored", "followed", "ignored"]
    times = [0, 1, 2, 3, 4, 4000, 4001, 4002, 4003]
    df = spark.createDataFrame([(i, float(t), k, "s") for i, (t, k) in enumerate(zip(times, kinds, strict=True))], "event_id long, t double, kind string, node string").withColumn("ts", F.timestamp_seconds("t"))
    got = [(r.level, r.ignored) for r in state.tracked(df, state.Escalation(), ["node"]).orderBy("at").collect()]
    assert got == [("surfaced", 0), ("surfaced", 1), ("warned", 2), ("warned", 3), ("escalated", 4), ("surfaced", 4), ("escalated", 5), ("resolved", 0), ("resolved", 1)]


MACHINES = {
    "alerts": (state.Alerts(12, 600, 7200, failures=2), ["scope"]),
    "escalation": (state.Escalation(decay=7200), ["user_id"]),
    "sessions": (state.Sessions(7200), ["user_id"]),
    "calibration": (state.Calibration(15, 5, 0.1), ["user_id"]),
}


@pytest.mark.parametrize("name", MACHINES)
def test_stream_equals_batch_across_a_restart(spark, sf, tmp_path, name):
    """Rows within an hour of one another arrive in any order, in several batches, and the query is stopped and started between them."""
    machine, key = MACHINES[name]
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).where("user_id < 6 or event_type = 'error'")
    kind = F.element_at(F.array(*map(F.lit, ("surface", "followed", "ignored", "resume", "observe"))), (F.col("event_id") % 5 + 1).cast("int"))
    e = e.select("event_id", "ts", "user_id", F.lit("all").alias("scope"), F.col("event_type").alias("rule"), F.col("event_type").alias("service"), F.lit("high").alias("severity"), F.when(F.col("event_id") % 9 > 0, F.col("value")).alias("value"), kind.alias("kind"), (F.col("value") / 20).alias("score"), (F.col("event_id") % 10 / 10).alias("heuristic"), kind.alias("outcome"))
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    parts = 3
    rows = e.orderBy("ts").collect()
    end = rows[-1].asDict() | {"ts": rows[-1].ts + dt.timedelta(days=400), "user_id": 10**6, "event_id": 10**9}
    step = -(-len(rows) // parts)
    for n in range(parts):
        spark.createDataFrame(rows[n * step : (n + 1) * step], e.schema).orderBy(F.desc("event_id")).coalesce(1).write.mode("append").parquet(source)
        stream.append_batches(state.tracked(stream.file_stream(spark, source, e.schema), machine, key), out, mark).awaitTermination()
    for n in range(2):  # moves the watermark past all
        spark.createDataFrame([end | {"event_id": 10**9 + n}], e.schema).write.mode("append").parquet(source)
        stream.append_batches(state.tracked(stream.file_stream(spark, source, e.schema), machine, key), out, mark).awaitTermination()
    plain = lambda df: sorted(repr([round(x, 6) if isinstance(x, float) else x for x in r]) for r in df.where(F.col("at") < end["ts"].timestamp() - 10).collect())
    want = plain(state.tracked(e, machine, key))
    assert plain(spark.read.parquet(out)) == want and len(want) > (1 if name == "alerts" else 50)
