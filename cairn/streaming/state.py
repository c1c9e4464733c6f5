"""Operators that carry state from event to event of a key: alerts, escalation, sessions, calibration windows.

Each is a small machine: `start` gives a key's first state, `step` takes an event and yields rows. `tracked` runs one over a
stream, where a key's events wait in its state until the watermark has passed them and are then taken by time and id, or over
a finished table, where they are sorted; so both give the same rows for events that are not later than the watermark allows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

State = dict
Event = dict


@dataclass(frozen=True)
class Alerts:
    """Rules that hold a value against a threshold. Events: rule, service, severity, value.

    A rule is true while its value is over the threshold; once it has been true for `hold` seconds it fires, once until it
    is false again. A null value is a failed evaluation: it ends what was true, and the `failures`-th on end is reported, as
    rule-health if another rule of the key has succeeded since the first of them, else once for all as
    evaluator-degraded. A service and severity that was sent no more than `cooldown` seconds ago is not sent again; the
    cooldown counts from what was sent, not from what was held back. Events less than `interval` after a rule's last are
    not evaluated. Rows: at, service, severity, kind (breach or health).
    """

    threshold: float
    hold: float = 0
    cooldown: float = 0
    failures: int = 3
    interval: float = 0
    fields: tuple[str, ...] = ("rule", "service", "severity", "value")
    schema: str = "at double, service string, severity string, kind string"

    def start(self) -> State:
        return {"rules": {}, "sent": {}, "success": None, "degraded": False}

    def step(self, s: State, now: float, e: Event) -> Iterator[tuple]:
        r = s["rules"].setdefault(e["rule"], {"since": None, "fired": False, "failed": 0, "streak": None, "told": False, "seen": None})
        if r["seen"] is not None and now - r["seen"] < self.interval:
            return
        r["seen"] = now
        value = e["value"]
        if value is None or value != value:
            r.update(since=None, fired=False, streak=r["streak"] if r["failed"] else now, failed=r["failed"] + 1)
            if r["failed"] >= self.failures and not r["told"]:
                r["told"] = True
                if s["success"] is not None and s["success"] > r["streak"]:
                    yield from self.sent(s, now, f"rule-health-{e['rule']}", "high", "health")
                elif not s["degraded"]:
                    s["degraded"] = True
                    yield from self.sent(s, now, "evaluator-degraded", "high", "health")
            return
        r.update(failed=0, told=False)
        s.update(success=now, degraded=False)
        if value <= self.threshold:
            r.update(since=None, fired=False)
            return
        r["since"] = now if r["since"] is None else r["since"]
        if now - r["since"] >= self.hold and not r["fired"]:
            r["fired"] = True
            yield from self.sent(s, now, e["service"], e["severity"], "breach")

    def sent(self, s: State, now: float, service: str, severity: str, kind: str) -> Iterator[tuple]:
        key, last = f"{service}:{severity}", s["sent"].get(f"{service}:{severity}")
        if last is None or now - last > self.cooldown:
            s["sent"][key] = now
            yield now, service, severity, kind


@dataclass(frozen=True)
class Escalation:
    """How far a constraint is pressed. Events: kind, one of surface, followed, ignored, contradicted.

    followed resolves and forgets; ignored and contradicted count, and lift the level at `warn`, `escalate` and `block` of
    them; surfacing after `decay` seconds without it takes the level back, not the count. Rows: at, level, ignored, for each
    event.
    """

    warn: int = 2
    escalate: int = 4
    block: int | None = 6
    decay: float = 3600
    fields: tuple[str, ...] = ("kind",)
    schema: str = "at double, level string, ignored int"

    def start(self) -> State:
        return {"level": None, "ignored": 0, "surfaced": None}

    def step(self, s: State, now: float, e: Event) -> Iterator[tuple]:
        if s["level"] is None:
            s.update(level="surfaced", surfaced=now)
        elif e["kind"] == "surface":
            if now - s["surfaced"] > self.decay:
                s["level"] = "surfaced"
            s["surfaced"] = now
        if e["kind"] == "followed":
            s.update(level="resolved", ignored=0)
        elif e["kind"] in ("ignored", "contradicted"):
            s["ignored"] += 1
            for level, n in (("blocked", self.block), ("escalated", self.escalate), ("warned", self.warn)):
                if n is not None and s["ignored"] >= n:
                    s["level"] = level
                    break
        yield now, s["level"], s["ignored"]


@dataclass(frozen=True)
class Sessions:
    """Sessions that end `ttl` seconds after their last event. Events: kind, one of resume, observe, activity.

    Rows: first, at, observed, resumed, health, for each event: 0.4 if resumed, 0.1 to 0.4 from 1, 3, 5, 10 observations on,
    and 0.2 for activity in the last ten minutes, which there is at an event.
    """

    ttl: float
    fields: tuple[str, ...] = ("kind",)
    schema: str = "first double, at double, observed int, resumed boolean, health double"

    def start(self) -> State:
        return {"first": None, "last": None, "observed": 0, "resumed": False}

    def step(self, s: State, now: float, e: Event) -> Iterator[tuple]:
        if s["last"] is None or now - s["last"] > self.ttl:
            s.update(first=now, observed=0, resumed=False)
        s.update(last=now, observed=s["observed"] + (e["kind"] == "observe"), resumed=s["resumed"] or e["kind"] == "resume")
        n = s["observed"]
        score = 4 * s["resumed"] + (4 if n >= 10 else 3 if n >= 5 else 2 if n >= 3 else 1 if n >= 1 else 0) + 2
        yield s["first"], now, n, s["resumed"], min(10, score) / 10


@dataclass(frozen=True)
class Calibration:
    """The last `size` pairs of a judged and a heuristic score, without ignored ones. Events: score, heuristic, outcome.

    Rows: at, n, mean_score, mean_heuristic, spread, bias, alert, insufficient, for each event that counts; below `least` pairs there is no
    verdict: bias is 0 and alert false.
    """

    size: int = 100
    least: int = 10
    bias: float = 0.2
    fields: tuple[str, ...] = ("score", "heuristic", "outcome")
    schema: str = "at double, n int, mean_score double, mean_heuristic double, spread double, bias double, alert boolean, insufficient boolean"

    def start(self) -> State:
        return {"ring": []}

    def step(self, s: State, now: float, e: Event) -> Iterator[tuple]:
        if e["outcome"] == "ignored" or e["score"] is None or e["heuristic"] is None:
            return
        s["ring"] = [*s["ring"][-(self.size - 1) :], [e["score"], e["heuristic"]]] if self.size > 1 else [[e["score"], e["heuristic"]]]
        n = len(s["ring"])
        a, b = (sum(x[k] for x in s["ring"]) / n for k in (0, 1))
        spread = (sum((x[0] - a) ** 2 for x in s["ring"]) / n) ** 0.5
        few = n < self.least
        yield now, n, a, b, spread, 0.0 if few else a - b, not few and abs(a - b) > self.bias, few


Machine = Alerts | Escalation | Sessions | Calibration


@dataclass
class Waiting:
    """A key's state in a stream: the machine's, and the events that the watermark has not passed."""

    state: State
    events: list[list] = field(default_factory=list)

    def taken(self, machine: Machine, until: float | None) -> Iterator[tuple]:
        """Steps over the waiting events up to a time."""
        self.events.sort(key=lambda e: e[:2])
        n = len(self.events) if until is None else sum(e[0] <= until for e in self.events)
        for now, _, event in self.events[:n]:
            yield from machine.step(self.state, now, event)
        self.events = self.events[n:]


def tracked(events: DataFrame, machine: Machine, key: Sequence[str], time: str = "ts", id_col: str = "event_id", late: str = "1 hour") -> DataFrame:
    """events(key…, time, id, the machine's fields) → (key…, the machine's rows). Ids are longs and break ties of time; events without a time are left out.

    A finished table is sorted and read once by key; no task holds more than a key's state and a batch of rows.
    """
    e = events.where(F.col(time).isNotNull())
    kinds = {c: t for c, t in e.dtypes if c in key}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in key), machine.schema])
    fields = list(machine.fields)
    if not events.isStreaming:
        return finished(e, machine, list(key), time, id_col, schema)
    stamped = e.withWatermark(time, late).select(*key, time, id_col, *fields)
    names = [c.split()[0].strip("`") for c in schema.split(", ")]

    def run(k: tuple, parts: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        held = Waiting(*json.loads(group.get[0])) if group.exists else Waiting(machine.start())
        for part in parts:
            part = part.astype(object).where(part.notna(), None)
            for row in part[[time, id_col, *fields]].itertuples(index=False, name=None):
                held.events.append([pd.Timestamp(row[0]).value / 1e9, row[1], dict(zip(fields, row[2:], strict=True))])
        passed = group.getCurrentWatermarkMs()
        rows = list(held.taken(machine, passed / 1000))
        group.update((json.dumps([held.state, held.events]),))
        if held.events:
            group.setTimeoutTimestamp(max(passed + 1, int(held.events[0][0] * 1000) + 1))
        yield pd.DataFrame([(*k, *r) for r in rows], columns=names)

    return stamped.groupBy(*key).applyInPandasWithState(run, schema, "held string", "append", GroupStateTimeout.EventTimeTimeout)


def finished(events: DataFrame, machine: Machine, key: list[str], time: str, id_col: str, schema: str) -> DataFrame:
    types = to_arrow_schema(StructType.fromDDL(schema))
    width, fields = len(key), list(machine.fields)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types.types, strict=True)], schema=types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for k, own in groupby(rows_of(batches), key=lambda r: r[:width]):
            state = machine.start()
            for r in own:
                rows += [(*k, *x) for x in machine.step(state, r[width], dict(zip(fields, r[width + 2 :], strict=True)))]
                if len(rows) >= 4096:
                    yield out(rows)
                    rows = []
        if rows:
            yield out(rows)

    seconds = (F.unix_micros(F.col(time).cast("timestamp")) / 1e6).alias("_time")
    sorted_rows = events.select(*key, seconds, F.col(id_col).alias("_id"), *fields).repartition(*key).sortWithinPartitions(*key, "_time", "_id")
    return sorted_rows.mapInArrow(run, schema)
