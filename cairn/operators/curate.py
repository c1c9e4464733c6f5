"""Training-data curation: gates, deduplication, splits, sampling, preference pairs, leak checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import has_personal_data, shingles, words
from ..sources.scratch import stored
from .rank import nth_by_hash


def gated(df: DataFrame, before: Sequence[tuple[str, Column]], key: Column, order: Sequence[Column], after: Sequence[tuple[str, Column]]) -> DataFrame:
    """df with exclude_reason: the first gate of `before` that is true, else duplicate for rows whose key stands earlier among those that passed, else the first gate of `after`; null for rows that stay."""
    early = F.coalesce(*(F.when(c, F.lit(n)) for n, c in before), F.lit(None).cast("string"))
    late = F.coalesce(*(F.when(c, F.lit(n)) for n, c in after), F.lit(None).cast("string"))
    out = df.select("*", early.alias("_early"), key.alias("_key"), late.alias("_late"))  # before the shuffle, so that a caller that keeps few columns shuffles those only
    nth = F.row_number().over(Window.partitionBy("_key", F.col("_early").isNull()).orderBy(*order))
    duplicate = F.when(F.col("_early").isNull() & (nth > 1), F.lit("duplicate"))
    return out.withColumn("_dup", duplicate).withColumn("exclude_reason", F.coalesce("_early", "_dup", "_late")).drop("_early", "_dup", "_key", "_late")


def keep_first(df: DataFrame, key: Sequence[Column], order: Sequence[Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def temporal_split(df: DataFrame, group: Sequence[str], order: Sequence[Column], ratio: float) -> DataFrame:
    """split: within each group the first int(n * ratio) rows train, the rest test, one at least of each; groups under three all train."""
    w = Window.partitionBy(*group)
    n, k = F.count("*").over(w), F.row_number().over(w.orderBy(*order))
    out = df.withColumns({"_n": n, "_k": k})
    cut = F.least(F.greatest(F.floor(F.col("_n") * ratio), F.lit(1)), F.col("_n") - 1)
    return out.withColumn("split", F.when((F.col("_n") < 3) | (F.col("_k") <= cut), "train").otherwise("test")).drop("_n", "_k")


def stratified_split(df: DataFrame, stratum: str, key: Column, share: float = 0.1) -> DataFrame:
    """split: of each stratum the first max(2, round(share n)) rows by key are valid (max(1, ...) under 20 rows, none of one); rounding is half to even."""
    w = Window.partitionBy(stratum)
    out = df.withColumns({"_n": F.count("*").over(w), "_k": F.row_number().over(w.orderBy(key))})
    raw = F.bround(F.col("_n") * F.lit(share)).cast("int")
    n_valid = F.when(F.col("_n") == 1, 0).when(F.col("_n") < 20, F.greatest(F.lit(1), raw)).otherwise(F.greatest(F.lit(2), raw))
    return out.withColumn("split", F.when(F.col("_k") <= n_valid, "valid").otherwise("train")).drop("_n", "_k")


def balanced(df: DataFrame, group: str, target: int, key: Column) -> DataFrame:
    """Each group brought to `target` rows: the first by key, or every row target // n times and the first target % n once more; copy from 0."""
    w = Window.partitionBy(group)
    out = df.withColumns({"_n": F.count("*").over(w), "_k": F.row_number().over(w.orderBy(key))})
    times = F.floor(F.lit(target) / F.col("_n")) + F.when(F.col("_k") <= F.lit(target) % F.col("_n"), 1).otherwise(0)
    return out.withColumn("_t", times).where("_t > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("_t") - 1).cast("int")))).drop("_n", "_k", "_t")


def proportional(df: DataFrame, group: str, total: int, key: Column) -> DataFrame:
    """`total` rows: floor quotas by share, the remainder to the largest fractions (ties by name); of each group the first by key."""
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    every = sizes.agg(F.sum("n").alias("all"))
    q = sizes.join(F.broadcast(every), F.lit(True)).withColumn("exact", F.col("n") * total / F.col("all")).withColumn("q", F.floor("exact"))
    left = q.agg((F.lit(total) - F.sum("q")).alias("left"))
    nth = F.row_number().over(Window.orderBy(F.desc(F.round(F.col("exact") - F.col("q"), 9)), group))  # one row a group
    q = q.withColumn("nth", nth).join(F.broadcast(left), F.lit(True)).select(group, (F.col("q") + F.when(F.col("nth") <= F.col("left"), 1).otherwise(0)).alias("quota"))
    k = F.row_number().over(Window.partitionBy(group).orderBy(key))
    return df.withColumn("_k", k).join(q, group).where("_k <= quota").drop("_k", "quota")


def preference_pairs(df: DataFrame, bucket: Sequence[str], reward: str, id_col: str, least: float, most: int) -> DataFrame:
    """(bucket, chosen, rejected, delta): within a bucket, by falling reward, pairs whose rewards differ by `least` or more, the first `most` in order.

    A row is joined only with the `most` rows before it that could make a kept pair, so that a large bucket gives
    rows times `most` candidates and not its square.
    """
    w = Window.partitionBy(*bucket).orderBy(F.desc(reward), id_col)
    r = df.withColumn("_i", F.row_number().over(w))
    a = r.select(*bucket, F.col("_i").alias("i"), F.col(id_col).alias("chosen"), F.col(reward).alias("ra")).where(F.col("i") <= most)
    b = r.select(*bucket, F.col("_i").alias("j"), F.col(id_col).alias("rejected"), F.col(reward).alias("rb"))
    pairs = a.join(b, list(bucket)).where((F.col("i") < F.col("j")) & (F.round(F.col("ra") - F.col("rb"), 9) >= least))
    n = F.row_number().over(Window.partitionBy(*bucket).orderBy("i", "j"))
    return pairs.withColumn("_n", n).where(F.col("_n") <= most).select(*bucket, "chosen", "rejected", F.round(F.col("ra") - F.col("rb"), 6).alias("delta"))


def leak_scores(docs: DataFrame, evals: DataFrame, n: int = 3, id_col: str = "doc_id", eval_id: str = "item_id", most_broadcast: int = 2_000_000) -> DataFrame:
    """(doc_id, containment): the largest share of an eval text's distinct n-word runs that stand in the document.

    Both meet by the run's XXH64; only pairs that share one arise. Runs of the eval texts are broadcast if there are
    `most_broadcast` at most, so that the documents' other runs end where they begin; else they are joined by shuffle.
    """
    of = lambda df, key: df.select(key, F.explode(F.transform(shingles(words(F.col("text")), n), lambda s: F.xxhash64(s))).alias("s"))
    items = stored(of(evals, eval_id))
    if items.count() <= most_broadcast:
        items = F.broadcast(items)
    sizes = items.groupBy(eval_id).agg(F.count("*").alias("size"))
    hits = of(docs, id_col).join(items, "s").groupBy(id_col, eval_id).agg(F.count("*").alias("hits")).join(sizes, eval_id)
    return hits.groupBy(id_col).agg(F.max(F.col("hits") / F.col("size")).alias("containment"))


def regressions(candidate: DataFrame, baseline: DataFrame, drop: float = 0.05, rise: float = 0.02) -> DataFrame:
    """(task, delta, verdict) for tasks of both: regressed below -drop, improved above +rise, relative to the baseline."""
    j = candidate.select("task", F.col("score").alias("c")).join(baseline.select("task", F.col("score").alias("b")), "task")
    delta = F.when(F.col("b") != 0, (F.col("c") - F.col("b")) / F.col("b")).otherwise(0.0)
    return j.select("task", delta.alias("delta"), F.when(delta < -drop, "regressed").when(delta > rise, "improved").otherwise("same").alias("verdict"))


def stagnant(history: DataFrame, key: str, order: str, last: int, least: float) -> DataFrame:
    """(key, stagnant): all of the last `last` steps of score are under `least`; false with a shorter history."""
    w = Window.partitionBy(key).orderBy(order)
    d = history.withColumn("delta", F.col("score") - F.lag("score").over(w)).withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order))))
    tail = d.where(F.col("_r") <= last).groupBy(key).agg(F.bool_and(F.coalesce(F.col("delta") < least, F.lit(False))).alias("flat"), F.count("delta").alias("n"))
    return tail.select(key, (F.col("flat") & (F.col("n") >= last)).alias("stagnant"))


def advantages(df: DataFrame, group: str, reward: str, floor: float = 1e-6, clip: float = 5.0) -> DataFrame:
    """(reward - mean) / deviation within the group, clipped; 0 where the group's deviation is below the floor. Groups are summed first, so that a large one isn't one task."""
    stats = df.groupBy(group).agg(F.avg(reward).alias("_mean"), F.stddev_pop(reward).alias("_std"))
    z = F.when(F.col("_std") < floor, 0.0).otherwise((F.col(reward) - F.col("_mean")) / F.col("_std"))
    return df.join(stats, group).withColumn("advantage", F.greatest(F.lit(-clip), F.least(F.lit(clip), z))).drop("_mean", "_std")


def golden_rows(df: DataFrame, source: str, row_id: str, size: int, top: int) -> DataFrame:
    """A holdout of about `size` rows: of each of the `top` largest sources its share of them, one at least (rounded half to even; the largest takes what is over or missing), the first by SHA-256 of the row's id."""
    sizes = df.groupBy(source).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), source).limit(top)
    every = sizes.agg(F.sum("_n").alias("_all"))
    q = sizes.crossJoin(F.broadcast(every)).withColumn("_q", F.greatest(F.lit(1), F.bround(F.lit(size) * F.col("_n") / F.col("_all")).cast("int")))  # `top` rows
    order = Window.orderBy(F.desc("_n"), source)
    over = F.lit(size) - F.sum("_q").over(Window.partitionBy())
    q = q.select(source, F.when(F.row_number().over(order) == 1, F.greatest(F.lit(1), F.col("_q") + over)).otherwise(F.col("_q")).alias("_q"))
    return nth_by_hash(df.join(F.broadcast(q), source), [source], F.sha2(F.col(row_id).cast("string"), 256)).where(F.col("nth") <= F.col("_q")).drop("nth", "peers", "_q")


def golden_split(df: DataFrame, source: str, row_id: str, prompt: str, rephrased: Column, size: int, top: int) -> DataFrame:
    """df with `split`, golden or train, and the prompt of golden rows rephrased. A golden row's former prompt is in no training row: rows with it are dropped from training, as the holdout would leak."""
    gold = golden_rows(df, source, row_id, size, top).select(row_id).withColumn("_gold", F.lit(True))
    marked = df.join(gold, row_id, "left").withColumn("_gold", F.coalesce("_gold", F.lit(False)))
    held = marked.where("_gold").select(prompt).distinct()
    train = marked.where("not _gold").join(held, prompt, "left_anti").select(*df.columns, F.lit("train").alias("split"))
    golden = marked.where("_gold").withColumn(prompt, rephrased).select(*df.columns, F.lit("golden").alias("split"))
    return train.unionByName(golden)


# Outcome of a guidance → its quality.
OUTCOMES = {"followed": 1.0, "partially_followed": 0.7, "ignored": 0.3, "contradicted": 0.0}


def task_quality(task: Column, outcome: Column, comprehension: Column, applicability: Column, outcomes: dict[str, float] | None = None, least_confidence: float = 0.7) -> Column:
    """Quality of a record by its task: synthesis by the outcome's value, evaluation by comprehension, classification 1 for a JSON object whose confidence, if it has one, reaches the least, reranking by applicability; both cut to 0..1. Null for other tasks and outcomes."""
    table = F.create_map(*(F.lit(x) for kv in (outcomes or OUTCOMES).items() for x in kv))
    cut = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    parsed = F.try_parse_json(outcome)
    is_object = F.schema_of_variant(parsed).startswith("OBJECT")
    given = F.try_variant_get(parsed, "$.confidence", "string")
    classified = F.when(F.coalesce(is_object, F.lit(False)) & (F.array_contains(F.coalesce(F.json_object_keys(outcome), F.array().cast("array<string>")), "confidence")), _bit(given.try_cast("double") >= least_confidence)).otherwise(_bit(is_object))
    return F.when(task == "synthesize", F.try_element_at(table, outcome)).when(task == "evaluate", cut(comprehension)).when(task == "classify", classified).when(task == "rerank", cut(applicability))


def _bit(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit(False)), 1.0).otherwise(0.0)


def outcome_pairs(outcomes: DataFrame, interactions: DataFrame, chosen: Sequence[str] = ("followed",), rejected: Sequence[str] = ("contradicted", "ignored"), least_difference: int = 10) -> DataFrame:
    """outcomes(guidance_id, outcome_type), interactions(guidance_id, time, response, private) → (guidance_id, chosen, rejected).

    A guidance with outcomes of both kinds and two interactions gives one pair: the responses of its first two by time.
    None if the first is private or both responses are equal. Outcomes are summed up before the join, and of interactions
    two a guidance reach it.
    """
    kinds = outcomes.where("guidance_id is not null").groupBy("guidance_id").agg(F.bool_or(F.col("outcome_type").isin(*chosen)).alias("good"), F.bool_or(F.col("outcome_type").isin(*rejected)).alias("bad")).where("good and bad")
    nth = F.row_number().over(Window.partitionBy("guidance_id").orderBy("time", "response"))
    first = interactions.withColumn("_k", nth).where("_k <= 2").groupBy("guidance_id").agg(
        F.count("*").alias("_n"), F.min_by("response", "_k").alias("chosen"), F.max_by("response", "_k").alias("rejected"), F.min_by("private", "_k").alias("_private")
    )
    same = (F.abs(F.length("chosen") - F.length("rejected")) < least_difference) & (F.col("chosen") == F.col("rejected"))
    return kinds.join(first, "guidance_id").where((F.col("_n") == 2) & ~F.col("_private") & ~same).select("guidance_id", "chosen", "rejected")


def rows_of_specs(specs: DataFrame, rows: DataFrame) -> DataFrame:
    """specs(spec, task_name, prompt_hash, dynamic), rows(row_id, task_name, prompt_hash) → (spec, row_id): by the row's task; for rows without one by the hash of their system prompt, unless the spec's prompt is dynamic."""
    named = specs.select("spec", "task_name").join(rows.where("task_name is not null").select("row_id", "task_name"), "task_name")
    hashed = specs.where("not dynamic and prompt_hash is not null").select("spec", "prompt_hash").join(rows.where("task_name is null").select("row_id", "prompt_hash"), "prompt_hash")
    return named.select("spec", "row_id").unionAll(hashed.select("spec", "row_id"))


def decayed_trust(outcomes: DataFrame, key: Sequence[str], value: str, newest_first: Sequence[Column], start: float = 0.5, step: float = 0.1) -> DataFrame:
    """(key, trust): from `start`, each outcome in turn moves trust by `step` of the way to its value. The newest but k counts step * (1 - step)^k."""
    k = F.row_number().over(Window.partitionBy(*key).orderBy(*newest_first)) - 1
    rows = outcomes.select(*key, F.col(value).alias("_x"), k.alias("_k"))
    left = F.lit(1 - step)
    return rows.groupBy(*key).agg((start * F.pow(left, F.count("*")) + step * F.sum(F.col("_x") * F.pow(left, F.col("_k")))).alias("trust"))


def quality_gates(docs: DataFrame) -> DataFrame:
    """Curation of documents: privacy, length and language before, duplicate text, then length again after."""
    before = [("privacy", has_personal_data(F.col("text"))), ("too_short", F.length(F.trim("text")) <= 10), ("no_language", F.coalesce(F.col("lang"), F.lit("")) == "")]
    return gated(docs, before, F.sha2("text", 256), [F.asc("doc_id")], [("too_long", F.length("text") > 20000)])
