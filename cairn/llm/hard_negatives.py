"""Hard-negative mining by threshold joins of anchors with all rows.

Anchors form blocks, rows form parts, and each block meets each part once, in a cogrouped task. There an inverted index of
the part's rows is built for the thresholds of a few anchors at a time: dimensions in descending order of their energy, and
of each row only those before the first at which its suffix norm times an anchor's can't reach the anchor's threshold; rows
that are left with none are not looked at. Partial scores are accumulated dimension after dimension over the rows that have
them, and rows that no anchor's threshold is in reach of, given the remaining norms, are pruned on the way. What is left is
scored as a whole, so that all results are exact.

A window asks for the first k rows whose score lies in a range. Its threshold begins near the top of the range and is lowered
in rounds until the window is full over all parts or the range ends, so that only anchors with open windows go on. A part
returns k rows of a window at most, and so what is shuffled and kept grows with the anchors, not with the pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Components beyond this size count as this size: sums of 8,192 products are then exact in doubles.
MOST = 2**20
LOWEST = -(2**62)


@dataclass(frozen=True)
class MinePlan:
    """positives, negatives: rows of a window; low, high: percent of a positive's score that a negative's lies between; block: anchors, part: rows that meet in a task; tile: anchors that share an index; falls: how far thresholds of a negatives' window fall in each round, as shares of its range; own_falls: those of a positives' window, as shares of the anchor's own score."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    block: int = 8192
    part: int = 16_384
    tile: int = 64
    falls: tuple[float, ...] = (0.125, 0.5)
    own_falls: tuple[float, ...] = (0.5, 0.8)


def integral(points: DataFrame, vector: str, scale: float) -> DataFrame:
    """points with `vector` as v: floor(scale * x) of each component."""
    x = F.transform(F.col(vector), lambda c: F.greatest(F.least(F.floor(c.cast("double") * scale), F.lit(MOST)), F.lit(-MOST)).cast("int"))
    return points.withColumn("v", x)


def usable(points: DataFrame, id_col: str, label_col: str, vector: str) -> DataFrame:
    """Rows with an id, a label and a vector whose components are all finite."""
    bad = F.exists(F.col(vector), lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return points.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector).isNotNull() & ~bad)


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of numbers as rows of a matrix; shorter lists end in zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width))
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def suffix_norms(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each row the norm of its components from each start on; 0 at the end."""
    squares = np.cumsum(x[:, ::-1] ** 2, axis=1)[:, ::-1]
    return np.sqrt(np.concatenate([squares, np.zeros((len(x), 1))], axis=1)[:, starts])


class Part:
    """A part's rows, with their dimensions in descending order of energy, in groups of eight."""

    def __init__(self, x: np.ndarray) -> None:
        self.order = np.argsort(-(x**2).sum(axis=0), kind="stable")
        self.x = np.ascontiguousarray(x[:, self.order])
        self.starts = np.unique(np.append(np.arange(0, x.shape[1], 8), x.shape[1]))
        self.norms = suffix_norms(self.x, self.starts)

    def reached(self, q: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of q, row of the part, score) of all pairs whose score is at least that row's threshold."""
        q = q[:, self.order]
        q_norms = suffix_norms(q, self.starts)
        slack = 1e-9 * np.abs(least) + 1e-6
        with np.errstate(divide="ignore", invalid="ignore"):
            reach = np.where(q_norms > 0, (least - slack)[:, None] / q_norms, np.where(least > slack, np.inf, -np.inf)[:, None]).min(axis=0)
        # a row's number of indexed groups: up to the first suffix that can't reach any threshold
        short = self.norms < reach
        n_groups = np.where(short.any(axis=1), short.argmax(axis=1), len(self.starts) - 1)
        rows = np.argsort(-n_groups, kind="stable")
        rows = rows[: np.searchsorted(-n_groups[rows], 0, side="left")]
        acc = np.zeros((len(q), len(rows)))
        for g, (a, b) in enumerate(zip(self.starts[:-1], self.starts[1:], strict=True)):
            n = np.searchsorted(-n_groups[rows], -g, side="left")  # the postings of this group's dimensions
            if not n:
                break
            acc[:, :n] += q[:, a:b] @ self.x[rows[:n], a:b].T
            if g % 2:
                at = np.minimum(n_groups[rows], g + 1)
                alive = (acc + q_norms[:, at] * self.norms[rows, at] >= (least - slack)[:, None]).any(axis=0)
                acc, rows = acc[:, alive], rows[alive]
        scores = q @ self.x[rows].T
        i, j = np.nonzero(scores >= least[:, None])
        return i, rows[j], scores[i, j].astype(np.int64)


def first_rows(anchor: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each anchor by score, then id."""
    order = np.lexsort((ids, -scores, anchor))
    a = anchor[order]
    nth = np.arange(len(a)) - np.searchsorted(a, a, side="left")
    return order[nth < k]


def search(asked: DataFrame, points: DataFrame, k: int, same: bool, plan: MinePlan) -> DataFrame:
    """asked: (anchor, label, v, slots) with slots of (slot, low, high, least); points: (vec_id, label, v) → the best k rows of each slot and part.

    Scores of a slot lie between least and high; rows have the anchor's label, or another if not `same`.
    """
    n_blocks, n_parts = max(1, -(-asked.count() // plan.block)), max(1, -(-points.count() // plan.part))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("*", F.pmod(F.xxhash64("anchor"), F.lit(n_blocks)).cast("int").alias("block"), spread(n_parts).alias("part"))
    right = points.select("*", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_parts)).cast("int").alias("part"), spread(n_blocks).alias("block"))

    def meet(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 4]
        if anchors.num_rows and rows.num_rows:
            width = max(1, *(int(np.diff(t.column("v").combine_chunks().offsets.to_numpy()).max()) for t in (anchors, rows)))
            part, ids, labels = Part(matrix(rows.column("v"), width)), rows.column("vec_id").to_numpy(), rows.column("label").to_numpy()
            q, own, named = matrix(anchors.column("v"), width), anchors.column("label").to_numpy(), anchors.column("anchor").to_numpy()
            slots = anchors.column("slots").combine_chunks()
            of = np.repeat(np.arange(len(q)), np.diff(slots.offsets.to_numpy()))
            slot, high, least = (slots.flatten().field(c).to_numpy() for c in ("slot", "high", "least"))
            place = np.arange(len(of)) - np.searchsorted(of, of, side="left")
            table = np.full((len(q), place.max(initial=-1) + 1), -1)  # an anchor's slots, by number
            table[of, place] = np.arange(len(of))
            lowest = np.full(len(q), np.iinfo(np.int64).max)
            np.minimum.at(lowest, of, least)
            by = np.argsort(-lowest / np.maximum(1, np.linalg.norm(q, axis=1)), kind="stable")
            for first in range(0, len(by), plan.tile):
                tile = by[first : first + plan.tile]
                i, j, s = part.reached(q[tile], lowest[tile].astype(float))
                i = tile[i]
                keep = (own[i] == labels[j]) == same
                keep &= named[i] != ids[j]
                i, j, s = i[keep], j[keep], s[keep]
                for nth in range(table.shape[1]):
                    w = table[i, nth]
                    fits = np.flatnonzero((w >= 0) & (s >= least[w]) & (s <= high[w]))
                    best = fits[first_rows(i[fits], ids[j[fits]], s[fits], k)]
                    out.append((named[i[best]], slot[w[best]], ids[j[best]], s[best]))
        return pa.table({c: pa.array(np.concatenate([o[n] for o in out]), pa.int64()) for n, c in enumerate(("anchor", "slot", "node", "score"))})

    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(meet, "anchor long, slot long, node long, score long")


def lowered(asked: DataFrame, fall: float | None) -> DataFrame:
    """Slots with their threshold `least`: `top` less that share of the way to `low`, or to 0 if low is below; `low` if fall is None."""

    def threshold(s):
        least = s["low"] if fall is None else F.greatest(s["low"], s["top"] - F.floor((s["top"] - F.greatest(s["low"], F.lit(0))) * fall))
        return s.withField("least", least)

    return asked.withColumn("slots", F.transform("slots", threshold))


def windows(asked: DataFrame, points: DataFrame, k: int, same: bool, plan: MinePlan, falls: tuple[float, ...]) -> DataFrame:
    """asked: stored (anchor, label, v, slots of (slot, low, high, top)) → (anchor, slot, node, score, rank): the first k rows of each slot.

    The threshold falls from `high` by shares of high - low, or where `high` has no end from `top`, until a slot has k rows, and then to low.
    """
    best = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "node"))
    results = None
    for fall in (*falls, None):
        found = search(lowered(asked, fall), points, k, same, plan)
        ranked = stored(found.withColumn("rank", best).where(F.col("rank") <= k))
        if fall is None:
            return ranked if results is None else results.unionByName(ranked)
        full = stored(ranked.groupBy("anchor", "slot").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("anchor", "slot"))
        done = ranked.join(full, ["anchor", "slot"], "left_semi")
        results = done if results is None else results.unionByName(done)
        shut = full.groupBy("anchor").agg(F.collect_set("slot").alias("shut"))  # a few slots
        rest = asked.join(shut, "anchor", "left").withColumn("slots", F.filter("slots", lambda s: ~F.coalesce(F.array_contains("shut", s["slot"]), F.lit(False)))).drop("shut")
        asked = stored(rest.where(F.size("slots") > 0))
        if asked.isEmpty():
            return results
    return results


def mine(points: DataFrame, anchors: DataFrame, plan: MinePlan = MinePlan()) -> DataFrame:
    """points(vec_id, label, v), anchors(vec_id) → (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Scores are inner products, higher ones come first, ties by the smaller vec_id. An anchor's positives are its first
    rows of its own label; a positive's negatives are the first rows of other labels whose score s has low * p <= 100 * s
    <= high * p, p being the positive's. Rows that share an id count as one, the least by label and vector; shorter vectors
    end in zeros. No rows, no anchors or only one label give no rows.
    """
    slot = lambda s, low, high, top: F.struct(*(x.cast("long").alias(n) for x, n in zip((s, low, high, top), ("slot", "low", "high", "top"), strict=True)))
    rows = stored(points.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", F.col("r.label").cast("long").alias("label"), "r.v"))
    own = rows.join(anchors.select("vec_id").distinct(), "vec_id", "left_semi").select(F.col("vec_id").alias("anchor"), "label", "v")
    square = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x)
    asked = stored(own.withColumn("slots", F.array(slot(F.lit(0), F.lit(LOWEST), F.lit(-LOWEST), square))))
    best = windows(asked, rows, plan.positives, True, plan, plan.own_falls)
    low, high = F.ceil(F.col("score") * plan.low / 100), F.floor(F.col("score") * plan.high / 100)
    ranges = best.select("anchor", slot(F.col("node"), low, high, high).alias("s"), F.col("score").alias("positive_score")).where("s.low <= s.high")
    ranges = stored(ranges)
    asked = stored(own.join(ranges.groupBy("anchor").agg(F.collect_list("s").alias("slots")), "anchor"))  # plan.positives a row
    negatives = windows(asked, rows, plan.negatives, False, plan, plan.falls)
    scores = ranges.select("anchor", F.col("s.slot").alias("slot"), "positive_score")
    out = negatives.join(scores, ["anchor", "slot"])
    return out.select(F.col("anchor").alias("anchor_id"), F.col("slot").alias("positive_id"), "rank", F.col("node").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def hard_negatives(embeddings: DataFrame, every: int = 100, relabel: int = 7, labels: int = 10, scale: float = 256.0, plan: MinePlan = MinePlan(), id_col: str = "vec_id", label_col: str = "label", vector: str = "embedding") -> DataFrame:
    """mine() over embeddings: anchors are the rows whose id is divisible by `every`, labels move on by one where it is by `relabel`, components are floor(scale * x).

    Rows with a null id, label or vector, or with a null or non-finite component, take no part. Other columns are ignored.
    """
    used = usable(embeddings, id_col, label_col, vector)
    i, label = F.col(id_col).cast("long"), F.col(label_col).cast("long")
    named = integral(used, vector, scale).select(i.alias("vec_id"), F.when(i % relabel == 0, (label + 1) % labels).otherwise(label).alias("label"), "v")
    return mine(named, named.where(F.col("vec_id") % every == 0), plan)
