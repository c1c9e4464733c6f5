"""Near copies by similarity: texts link if the Jaccard similarity of their sets of five-word runs is 0.8 or more.

Candidates come from two sides. SimHash fingerprints of the runs that differ in two bits or fewer are found by anchor
points, as everywhere in this subpackage; but texts at 0.8 differ in about ten of 64 bits, which no such threshold
reaches. So texts are candidates as well if they share a band of minimum hashes: of pairs at similarity s,
1 - (1 - s^7)^32 are expected to share one of the 32 bands, 0.9994 at s = 0.8 and more above. Pairs whose minimum hashes
agree in under 0.68 of the 224 places are left out (at 0.8, some three pairs in 10^6 agree in so few), and each other pair is
confirmed on the whole sets. A bucket's texts are first held against its least one, then those of
other components against the one that stands in the most buckets. Those that are still in different components are held
against one another at last, by their rarest runs: in one order of all runs, by their number of texts, two texts that are
alike share one among the first fifth of each, and the runs before it bound their similarity. No link is lost, and of a
large group of near copies that do not link few pairs are looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, large, stored, text_runs
from .graph import components
from .simhash import links, majority, shingle_hashes

BANDS, ROWS = 32, 7


@cache
def multipliers(seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """An odd factor and a summand for each minimum hash."""
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 2**32, (2, BANDS * ROWS, 1), np.uint32)
    return a | np.uint32(1), b


def least_hashes(h: np.ndarray) -> np.ndarray:
    """The minimum hashes of a set of distinct hashes; all ones for an empty set."""
    a, b = multipliers()
    least = np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    for first in range(0, len(h), 1024):
        part = (h[first : first + 1024] >> np.uint64(32)).astype(np.uint32)
        least = np.minimum(least, (part * a + b).min(axis=1))
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """A key for each band. Texts without words share all keys."""
    key = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T.astype(np.uint64):
        key = (key ^ row) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def alike(a: set[int], b: set[int], least: float) -> bool:
    both = len(a & b)
    return both >= least * (len(a) + len(b) - both)


def signatures(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(text_id, doc_id, n, fp, bands, sketch): SHA-256 of the text, n distinct runs, SimHash of all runs, keys of the bands, a byte of each minimum hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, texts in text_runs(batch.column(1), 4_000_000):
                n, fps, keys, sketches, names = [], [], [], [], []
                for t in texts:
                    names.append(hashlib.sha256((t or "").encode("utf-8", "surrogatepass")).digest())
                    h = np.array(shingle_hashes(t, width), "<u8")
                    fps.append(majority(h))
                    distinct = np.unique(h)
                    least = least_hashes(distinct)
                    n.append(len(distinct))
                    keys.append(bands(least))
                    sketches.append(least.astype(np.uint8).tobytes())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * BANDS, pa.int32()), pa.array(np.concatenate(keys)))
                cols = [pa.array(names, pa.binary()), batch.column(0).slice(first, last - first), pa.array(n, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64), pa.int64()), lists, pa.array(sketches, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["text_id", "doc_id", "n", "fp", "bands", "sketch"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "text_id binary, doc_id long, n long, fp long, bands array<long>, sketch binary")


def sifted(pairs: DataFrame, least: float) -> DataFrame:
    """pairs(a, b, left, right) → (a, b) of those whose sketches left and right agree in that share of places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3)) if batch.num_rows else (np.zeros((0, 1)),) * 2
            keep = (x == y).mean(axis=1) >= least
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def agreeing(pairs: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sketches agree in that share of places."""
    return sifted(pairs.join(large(sketches.toDF("a", "left")), "a").join(large(sketches.toDF("b", "right")), "b"), least)


def confirmed(pairs: DataFrame, whole: DataFrame, width: int, least: float, per_task: int = 256) -> DataFrame:
    """The pairs (a, b) whose texts are alike, on their whole sets. whole(key, text): a row a text.

    A text meets those that it is paired with in groups of about per_task, so that it travels once for each group. Only
    those with more than one group are looked up.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / per_task).alias("groups"))
    several = sizes.where("groups > 1")
    dealt = pairs.join(several, "a", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), F.col("groups")), F.lit(0)).alias("group"))
    heads = sizes.select(F.col("a").alias("key"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("group")).join(large(whole), "key").select(F.col("key").alias("a"), "group", F.lit(None).cast("long").alias("b"), "text")
    members = dealt.join(large(whole.toDF("b", "text")), "b").select("a", "group", "b", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: set[int] = set()
        for batch in batches:
            a, b, keep = batch.column(0).to_pylist(), batch.column(2).to_pylist(), []
            for first, last, texts in text_runs(batch.column(3), 4_000_000):
                for k, text in zip(range(first, last), texts, strict=True):
                    runs = set(shingle_hashes(text, width))
                    if b[k] is None:
                        own = runs
                    elif alike(own, runs, least):
                        keep.append((a[k], b[k]))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in keep], pa.int64()), pa.array([y for _, y in keep], pa.int64())], ["a", "b"])

    met = heads.unionByName(members).repartition("a", "group").sortWithinPartitions("a", "group", F.asc_nulls_first("b"))
    return met.mapInArrow(run, "a long, b long")


def copies(distinct: DataFrame, texts: DataFrame, width: int = 5, least: float = 0.8, slack: float | None = 0.12, rounds: int = 1) -> DataFrame:
    """distinct: stored signatures with a key, one a text; texts(text_id, text) → (key, root), stored: texts that link to others, and the least key that they are joined with.

    slack: how much less than `least` of the sketch may agree in a pair that is looked at; None: every candidate pair is.
    """
    sketches = distinct.select("key", "sketch")
    # by fingerprint: texts that share one, against the least of them; and the least of fingerprints that link
    heads = stored(distinct.groupBy("fp").agg(F.min("key").alias("head")))
    same = distinct.join(large(heads), "fp").where("head <> key").select(F.col("head").alias("a"), F.col("key").alias("b"))
    near_fp = links(heads.select("fp")).join(large(heads.toDF("a", "x")), "a").join(large(heads.toDF("b", "y")), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    # by band
    spread = distinct.select("key", "n", F.explode("bands").alias("bucket"))
    full = spread.groupBy("bucket").agg(F.min(F.struct("key", "n")).alias("h"), F.max("key").alias("last")).where("h.key < last")
    member = member_table = stored(spread.join(large(full), "bucket").select("bucket", "key", "n", F.col("h.key").alias("head"), F.col("h.n").alias("head_n")))
    # of sets whose sizes differ by more none are alike
    near = F.least("n", "m") >= F.lit(least) * F.greatest("n", "m") - F.lit(1e-9)
    starred = member.where("key <> head").withColumnRenamed("head_n", "m").where(near).select(F.col("head").alias("a"), F.col("key").alias("b"))
    stars = stored(starred.union(same).union(near_fp).distinct())
    # the texts of all candidates, once
    wanted = member.select("key").union(stars.select("a")).union(stars.select("b")).distinct()
    named = distinct.select("key", "text_id").join(large(wanted), "key", "left_semi")
    whole = stored(texts.join(large(named), "text_id").select("key", "text"))

    def confirm(pairs: DataFrame) -> DataFrame:
        if slack is None:
            return stored(confirmed(pairs, whole, width, least))
        alike_enough = stored(agreeing(pairs, sketches, least - slack))
        out = stored(confirmed(alike_enough, whole, width, least))
        dropped(alike_enough)
        return out

    degree = member.groupBy("key").agg(F.count("*").alias("degree"))
    member = member.select("bucket", "key", "n").join(large(degree), "key")
    tested, tables = stars, [member_table]
    roots = stored(components(confirm(stars)).toDF("key", "root"))
    for turn in range(rounds + 1):
        rooted = stored(member.join(large(roots), "key", "left").withColumn("root", F.coalesce("root", "key")))
        split = rooted.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("bucket")
        left = stored(rooted.join(large(split), "bucket"))
        dropped(rooted, *tables)
        member, tables = left.drop("root"), [left]
        if turn < rounds:
            # the first time the text that stands in the most full buckets, as the source of a group of copies does
            order = F.struct((-F.col("degree") if turn == 0 else F.lit(0)).alias("d"), F.xxhash64("key", "bucket", F.lit(turn)).alias("h"), F.col("key").alias("a"), F.col("n").alias("m"), F.col("root").alias("ra"))
            pairs = left.join(large(left.groupBy("bucket").agg(F.min(order).alias("s")).select("bucket", "s.a", "s.m", "s.ra")), "bucket").where(F.col("root") != F.col("ra")).withColumnRenamed("key", "b").where(near)
        else:
            pairs = possible(rare_runs(left, whole, width, least), least)
        fresh = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(large(tested), ["a", "b"], "left_anti"))
        found = confirm(fresh)
        tested, roots = tested.union(fresh), joined(roots, found)
    dropped(heads, whole, *tables)
    return roots


def joined(roots: DataFrame, found: DataFrame) -> DataFrame:
    """roots(key, root), stored, after links(a, b) more: their ends' roots are joined, and what had one of these has the least of them now."""
    if found.isEmpty():
        return roots
    end = lambda c: F.coalesce("root", c)
    a = found.join(large(roots.withColumnRenamed("key", "a")), "a", "left").select(end("a").alias("a"), "b")
    ends = stored(a.join(large(roots.withColumnRenamed("key", "b")), "b", "left").select("a", end("b").alias("b")))
    moved = stored(components(ends).toDF("root", "to"))
    fresh = moved.join(large(roots.select(F.col("key").alias("root"))), "root", "left_anti").select(F.col("root").alias("key"), F.col("to").alias("root"))
    after = roots.join(large(moved), "root", "left").select("key", F.coalesce("to", "root").alias("root")).unionByName(fresh)
    return stored(after)


def rare_runs(left: DataFrame, whole: DataFrame, width: int, least: float) -> DataFrame:
    """(run, key, n, root, u, main): of each text of left(key, n, root, …) its rarest runs, so many that two texts that are alike share one of these.

    u: how many runs of the text come before it, in the order of their number of texts here; main: whether the text's root
    has the most texts among those with this run. Runs that only one text or root has are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(1).to_pylist()):
                h = np.unique(np.array(shingle_hashes(text, width), np.uint64)).view(np.int64)
                for first in range(0, len(h), 10_000):
                    part = h[first : first + 10_000]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1).take(pa.array(np.zeros(len(part), np.int32))), pa.array(part)], ["key", "run"])

    keys = left.select("key", "n", "root").distinct()
    runs = stored(whole.join(large(keys), "key", "left_semi").mapInArrow(run, "key long, run long"))
    texts = runs.groupBy("run").agg(F.count("*").alias("texts"))
    placed = runs.join(large(texts), "run").withColumn("u", F.row_number().over(Window.partitionBy("key").orderBy("texts", "run")) - 1)
    rare = stored(placed.join(large(keys), "key").where((F.col("texts") > 1) & (F.col("u") <= F.col("n") - F.ceil(F.lit(least) * F.col("n") - F.lit(1e-9)))).select("run", "key", "n", "root", "u"))
    main = rare.groupBy("run", "root").agg(F.count("*").alias("many")).groupBy("run").agg(F.max_by("root", F.struct("many", "root")).alias("most"), F.count("*").alias("roots")).where("roots > 1")
    return rare.join(large(main), "run").select("run", "key", "n", "root", "u", (F.col("root") == F.col("most")).alias("main"))


def possible(rare: DataFrame, least: float, levels: int = 40) -> DataFrame:
    """rare_runs → (a, b): pairs of different roots that can be alike, given the runs before the first one that they share.

    If |A| is at most |B| and shares p and q of their runs come before, then |A and B| is at most (1 - p) |A| and |A or B| at
    least |A| + q |B|, so that they are alike only if q is at most (1 - p) / least - 1. A text meets the levels of q up to
    that bound, and of the root with the most texts of a run no two meet: nor do pairs of these, or beyond the bound, arise.
    """
    rare = stored(rare)
    share = F.col("u") / F.col("n")
    top = F.floor(((1 - share) / least - 1) * levels + F.lit(1e-9)).cast("int")
    met = F.when(F.col("main"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    a = rare.withColumn("top", top).where("top >= 0").select("run", F.col("key").alias("a"), F.col("n").alias("m"), F.col("root").alias("ra"), F.col("u").alias("ua"), F.explode(met).alias("main"), "top")
    a = a.select("run", "a", "m", "ra", "ua", "main", F.explode(F.sequence(F.lit(0), "top")).alias("level"))
    b = rare.select("run", F.floor(share * levels).cast("int").alias("level"), "main", F.col("key").alias("b"), "n", "root", F.col("u").alias("ub"))
    both, either = F.least(F.col("m") - F.col("ua"), F.col("n") - F.col("ub")), F.greatest(F.col("m") + F.col("ub"), F.col("n") + F.col("ua"))
    smaller = (F.col("m") < F.col("n")) | ((F.col("m") == F.col("n")) & ((F.col("ua") < F.col("ub")) | ((F.col("ua") == F.col("ub")) & (F.col("a") < F.col("b")))))
    return a.join(large(b), ["run", "level", "main"]).where((F.col("ra") != F.col("root")) & smaller & (both >= F.lit(least) * either - F.lit(1e-9))).select("a", "b")


def one_of_near_copies(docs: DataFrame, width: int = 5, least: float = 0.8, slack: float | None = 0.12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all columns, that stand for their group of near copies: the one with the smallest id.

    Null and empty texts are copies of one another; texts are the same if their SHA-256 is. Where texts of one id stand for
    different groups each stays; of rows with the same id and text one stays, the first by a hash of all columns. Rows
    without an id stay, as nothing tells them apart. An empty table gives no rows. slack: as in copies.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # columns of docs travel inside one, so that no name of theirs meets one used here
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("text_id"), text.alias("text"))
    signed = stored(signatures(docs, width, id_col, text_col))
    ids = stored(signed.groupBy("text_id").agg(F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in ("n", "fp", "bands", "sketch"))).withColumn("key", F.monotonically_increasing_id()))
    dropped(signed)
    least_row = F.row_number().over(Window.partitionBy("text_id").orderBy(F.asc_nulls_last("doc_id")))
    texts = rows.select("text_id", "text", "doc_id").withColumn("nth", least_row).where("nth = 1").select("text_id", "text")
    roots = copies(ids.drop("doc_id"), texts, width, least, slack)
    member = ids.where("doc_id is not null").select("key", "text_id", "doc_id").join(large(roots), "key", "left").select("text_id", "doc_id", F.coalesce("root", "key").alias("root"))
    stays = member.groupBy("root").agg(F.min(F.struct("doc_id", "text_id")).alias("s")).select("s.doc_id", "s.text_id")
    named = rows.where("doc_id is not null").drop("text")
    nth = F.row_number().over(Window.partitionBy("doc_id", "text_id").orderBy(F.xxhash64("row")))
    return named.withColumn("nth", nth).where("nth = 1").join(large(stays), ["doc_id", "text_id"]).select("row.*").unionByName(docs.where(F.col(id_col).isNull()))
