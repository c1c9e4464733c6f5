"""Mixing sources to target weights.

Each source's words are packed, document after document in a pseudorandom order, into blocks of fixed length. Output
slots come in shards; a shard draws how many of its slots each source gets: multinomial counts, given that all shards
together meet the sources' targets. Such a draw is made by halving: of the slots of a range of shards its first half gets
a random part without replacement, and so on down to single shards, which also tells a shard how many slots of each
source lie before it. A source numbers its slots over all shards, and each pass over its blocks is a pseudorandom
permutation: slot number → block number. Blocks and slots meet by block number in an equi-join. Sources are a dimension
and reach the driver as one row each; documents, blocks and slots do not.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, large, stored


@dataclass(frozen=True)
class MixPlan:
    """weights: given to the sources in code point order, null last, repeating; block: words in a block; shard: slots in a shard; bucket: documents summed up together on the way to their places; max_sources: beyond it the mix raises an error, as sources are broadcast."""

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    most_passes: int = 3
    block: int = 128
    shard: int = 4096
    bucket: int = 2000
    seed: int = 17
    max_sources: int = 100_000


def water_fill(sizes: np.ndarray, weights: np.ndarray, most: float) -> np.ndarray:
    """Targets that share sum(sizes) by weight; none above most * size, the excess reshared by weight until that holds."""
    total, target, free = float(sizes.sum()), np.zeros(len(sizes)), np.ones(len(sizes), bool)
    while free.any():
        left = total - float(target[~free].sum())
        target[free] = left * weights[free] / weights[free].sum()
        over = free & (target > most * sizes)
        if not over.any():
            break
        target[over] = most * sizes[over]
        free &= ~over
    return target


def permuted(x: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of range(n) for each key, at x: a Feistel network on the next even power of two, walked until it is inside."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask, out, todo = (np.uint64(1) << half) - np.uint64(1), x.astype(np.uint64), np.arange(len(x))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo].astype(np.uint64)
        left, right = out[todo] >> h, out[todo] & m
        for turn in range(6):
            z = (right + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 % 2**64)) ^ k
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((z ^ (z >> np.uint64(31))) & m)
        out[todo] = left << h | right
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def without_replacement(rng: np.random.Generator, counts: np.ndarray, n: int) -> np.ndarray:
    """How many of each kind are among n drawn at random from counts."""
    out, left = np.zeros(len(counts), np.int64), int(counts.sum())
    for k in np.flatnonzero(counts):
        if not n:
            break
        c = int(counts[k])
        x = hypergeometric(rng, c, left - c, n)
        out[k], n, left = x, n - x, left - c
    return out


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int, most: int = 10**9) -> int:
    """How many of n drawn without replacement are good: numpy's draw below `most` in all, where it ends, and above it by inversion.

    Inversion takes the probabilities within 12 standard deviations of the mode, from the ratios of neighbours; what lies
    beyond is less than a double can tell from none.
    """
    total = good + bad
    if total < most:
        return int(rng.hypergeometric(good, bad, n))
    mode = (n + 1) * (good + 1) // (total + 2)
    reach = 20 + int(12 * (n / total * good / total * bad * (total - n) / total) ** 0.5)
    x = np.arange(max(0, n - bad, mode - reach), min(good, n, mode + reach) + 1)
    if len(x) == 1:
        return int(x[0])
    f = x[:-1].astype(float)
    logs = np.append(0.0, np.cumsum(np.log((good - f) * (n - f)) - np.log((f + 1) * (bad - n + f + 1))))
    chances = np.cumsum(np.exp(logs - logs.max()))
    return int(x[min(len(x) - 1, np.searchsorted(chances, rng.random() * chances[-1], side="right"))])


def draws(slots: np.ndarray, per_shard: int, first: int, last: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each shard of [first, last): (shard, slots of each source in it, slots of each source in the shards before)."""
    n_shards = -(-int(slots.sum()) // per_shard)
    todo = [(0, n_shards, slots, np.zeros_like(slots))]
    while todo:
        low, high, counts, before = todo.pop()
        if low >= min(last, high) or high <= first:
            continue
        if high - low == 1:
            yield low, counts, before
            continue
        middle = (low + high) // 2
        left = without_replacement(np.random.default_rng([seed, low, high]), counts, (middle - low) * per_shard)
        todo += [(middle, high, counts - left, before + left), (low, middle, left, before)]


@dataclass
class Mix:
    """sized: a row for each document with its place in its source's words; slots: (sid, shard, pass, block), a row for each slot; sources: one row each."""

    sized: DataFrame
    slots: DataFrame
    sources: DataFrame
    plan: MixPlan

    def fragments(self) -> DataFrame:
        """A row for each document and block that share words: the document's key and values, block, words shared, and first_word, the first of them in the document."""
        b = self.plan.block
        first = F.floor(F.col("at") / b)
        last = F.floor((F.col("at") + F.col("size") - 1) / b)
        parts = self.sized.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
        begin, end = F.greatest(F.col("at"), F.col("block") * b), F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * b)
        return parts.withColumns({"words": end - begin, "first_word": begin - F.col("at")})

    def mixed(self) -> DataFrame:
        """The mix itself: for each shard and slot the fragments of documents that it holds."""
        return self.slots.join(large(self.fragments()), ["sid", "block"]).select("shard", "slot", "pass", "source", "block", "doc_id", "first_word", "words")

    def taken(self) -> DataFrame:
        """One row for each document: doc_id, size, source_size, target, taken."""
        times = self.slots.groupBy("sid", "block").agg(F.count("*").alias("times"))
        key = ["sid", "bucket", "nth"]
        drawn = self.fragments().join(large(times), ["sid", "block"]).groupBy(*key).agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
        out = self.sized.join(large(drawn), key, "left").join(F.broadcast(self.sources.select("sid", "source_size", "target")), "sid")
        return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mix_sources(docs: DataFrame, plan: MixPlan = MixPlan(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Mix:
    """The mix of all rows of docs. A null text has size 0; a null source is a source of its own; repeated rows count each.

    Whatever the rows' order and partitions, the same rows give the same mix. An empty table gives an empty mix.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"), F.lit(plan.seed)).alias("mark")))
    found = rows.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("rows")).limit(plan.max_sources + 1).collect()
    if len(found) > plan.max_sources:
        raise ValueError(f"more than {plan.max_sources} sources")
    found.sort(key=lambda r: (r.source is None, r.source or ""))  # Python compares by code point
    sizes = np.array([r.words for r in found], float)
    weights = np.resize(np.array(plan.weights, float), len(found))
    targets = water_fill(sizes, weights, plan.most_passes)
    blocks = [-(-r.words // plan.block) for r in found]
    slots = [min(plan.most_passes * n, round(t * n / r.words)) if r.words else 0 for t, n, r in zip(targets, blocks, found, strict=True)]
    table = [(i, r.source, r.words, float(t), n, s, -(-r.rows // plan.bucket)) for i, (r, t, n, s) in enumerate(zip(found, targets, blocks, slots, strict=True))]
    sources = spark.createDataFrame(table, "sid int, source string, source_size long, target double, n_blocks long, n_slots long, n_buckets long")

    # a document's place: what its source's buckets before it hold, and the documents before it in its bucket
    placed = rows.join(F.broadcast(sources.select("sid", F.col("source").alias("_s"), "n_buckets")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    placed = placed.withColumn("h", F.shiftrightunsigned("mark", 33)).withColumn("bucket", F.shiftright(F.col("h") * F.col("n_buckets"), 31))
    # prefix sums in two steps, so that no window holds all buckets of a source
    sums = placed.groupBy("sid", "bucket").agg(F.sum("size").alias("words")).withColumn("thousand", F.floor(F.col("bucket") / 1000))
    ahead = lambda *by: F.sum("words").over(Window.partitionBy(*by[:-1]).orderBy(by[-1])) - F.col("words")
    tops = sums.groupBy("sid", "thousand").agg(F.sum("words").alias("words")).select("sid", "thousand", ahead("sid", "thousand").alias("top"))
    before = sums.withColumn("base", ahead("sid", "thousand", "bucket")).join(tops, ["sid", "thousand"]).select("sid", "bucket", (F.col("base") + F.col("top")).alias("base"))
    inner = Window.partitionBy("sid", "bucket").orderBy("mark", "doc_id", "size")
    placed = placed.withColumns({"nth": F.row_number().over(inner), "inside": F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")})
    sized = stored(placed.join(before, ["sid", "bucket"]).select("sid", "bucket", "nth", "doc_id", "source", "size", (F.col("base") + F.col("inside")).alias("at")))

    wanted, per_shard, seed = np.array(slots, np.int64), plan.shard, plan.seed
    n_shards = -(-int(wanted.sum()) // per_shard)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                for shard, n, base in draws(wanted, per_shard, int(batch["id"].min()), int(batch["id"].max()) + 1, seed):
                    yield pd.DataFrame({"shard": shard, "sid": np.arange(len(n), dtype=np.int32), "n": n, "base": base})[n > 0]

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first in range(0, len(batch), 16):
                b = batch.iloc[first : first + 16]
                n = b["n"].to_numpy()
                row = np.repeat(np.arange(len(b)), n)
                step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                number, size = b["base"].to_numpy()[row] + step, b["n_blocks"].to_numpy()[row]
                turn, sid = number // size, b["sid"].to_numpy()[row]
                out = pd.DataFrame({"sid": sid, "shard": b["shard"].to_numpy()[row], "slot": step, "pass": turn})
                out["block"] = permuted(number % size, size, (sid.astype(np.int64) * 1_000_003 + turn) * 7919 + seed)
                yield out

    drawn = stored(spark.range(0, n_shards, 1, max(1, min(n_shards // 8, 10_000))).mapInPandas(draw, "shard long, sid int, n long, base long"))
    drawn = drawn.join(F.broadcast(sources.select("sid", "n_blocks")), "sid")
    filled = drawn.select("shard", "sid", "n", "base", "n_blocks").mapInPandas(fill, "sid int, shard long, slot long, pass long, block long")
    return Mix(sized, filled, sources, plan)


def mixed_documents(docs: DataFrame, plan: MixPlan = MixPlan(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with each row as often as the mix takes it: taken / size times, the fraction rounded by a hash of its id.

    Rows that share an id share their number; rows without words are in no block and go.
    """
    ratio = mix_sources(docs, plan, id_col, text_col, source_col).taken().groupBy("doc_id").agg((F.sum("taken") / F.sum("size")).alias("ratio"))
    chance = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(plan.seed + 1)), 11) / F.lit(float(2**53))
    copies = ratio.select("doc_id", F.floor(F.col("ratio") + chance).cast("int").alias("n")).where("n > 0")
    # columns of docs travel inside one, so that no name of theirs meets one used here
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).cast("long").alias("id"))
    out = rows.join(large(copies), F.col("id").eqNullSafe(F.col("doc_id")))
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy")).select("row.*")
