"""Sets of items: similarity joins by prefixes, top experts of tasks, and where tasks fall apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import large, stored


def set_prefixes(members: DataFrame, group: str, item: str, least: float) -> DataFrame:
    """(g, i, n, place): of each set the items that one of its similar sets must share: all but the last ceil(least n) - 1 in an order of items by how many sets have them.

    Frequent items come last, so that they are left out but for sets that have few others.
    """
    df = members.groupBy(item).agg(F.count("*").alias("df"))
    nth = F.row_number().over(Window.partitionBy(group).orderBy("df", item))
    sizes = members.groupBy(group).agg(F.count("*").alias("n"))
    placed = members.join(large(df), item).withColumn("place", nth).join(large(sizes), group)
    return placed.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).select(F.col(group).alias("g"), F.col(item).alias("i"), "n", "place")


def similar_sets(members: DataFrame, group: str, item: str, least: float) -> DataFrame:
    """members(group, item), distinct → (a, b, jaccard), a < b, of all pairs of sets with a Jaccard similarity of at least `least` > 0.

    Sets meet by an item of both their prefixes if their sizes allow it, and what is left of both after that item can still
    reach the overlap that is asked for. Of a pair the items that its prefixes share are counted: beyond them it has at most
    those that stand after the one prefix that ends first. Only pairs that can still reach the overlap are counted item by item.
    """
    met = met_sets(stored(set_prefixes(members, group, item, least)), least)
    x, y = members.select(F.col(group).alias("a"), F.col(item).alias("i")), members.select(F.col(group).alias("b"), F.col(item).alias("i"))
    hits = met.join(large(x), "a").join(large(y), ["b", "i"]).groupBy("a", "b", "n", "m").agg(F.count("*").alias("h"))
    return hits.select("a", "b", (F.col("h") / (F.col("n") + F.col("m") - F.col("h"))).alias("jaccard")).where(F.col("jaccard") >= least)


def met_sets(prefixes: DataFrame, least: float) -> DataFrame:
    """set_prefixes, stored → (a, b, n, m): the pairs of sets that are looked at. An item's sets travel to each of them as lists, and are counted where the set's other items are."""
    overlap = lambda n, m: F.ceil((n + m) * (least / (1 + least)) - 1e-9)
    after = lambda n: F.ceil(n * least - 1e-9) - 1
    held = prefixes.groupBy("i").agg(F.collect_list(F.struct(F.col("g").alias("b"), F.col("n").alias("m"), F.col("place").alias("q"))).alias("held")).where(F.size("held") > 1)
    n, p = F.col("n"), F.col("place")

    def fits(s):
        # place p of n and q of m: at most as many before this item as either has, and at most what either has from it on
        most = F.least(p, s["q"]) - 1 + F.least(n - p, s["m"] - s["q"]) + 1
        return (s["b"] > F.col("g")) & (F.least(n, s["m"]) >= least * F.greatest(n, s["m"]) - 1e-9) & (most >= overlap(n, s["m"]))

    lists = prefixes.join(large(held), "i").select(F.col("g").alias("a"), "n", F.filter("held", fits).alias("f")).where(F.size("f") > 0)
    rows = lists.select("a", "n", F.col("f.b").alias("bs"), F.col("f.m").alias("ms")).repartition("a")
    pairs = rows.select("a", "n", F.explode(F.arrays_zip("bs", "ms")).alias("f")).groupBy("a", "n", F.col("f.bs").alias("b"), F.col("f.ms").alias("m")).agg(F.count("*").alias("c"))
    return pairs.where(F.col("c") + F.greatest(after(n), after(F.col("m"))) >= overlap(n, F.col("m"))).select("a", "b", "n", "m")


def top_experts(routed: DataFrame, percent: int, n_experts: int) -> DataFrame:
    """routed(task, layer, expert, n) → (task, layer, expert): of each task and layer the percent of all experts with the highest counts, ties by the smaller."""
    counts = routed.groupBy("task", "layer", "expert").agg(F.sum("n").alias("n"))
    nth = F.row_number().over(Window.partitionBy("task", "layer").orderBy(F.desc("n"), "expert"))
    return counts.withColumn("nth", nth).where(F.col("nth") <= n_experts * percent // 100).select("task", "layer", "expert")


def task_overlap(top: DataFrame) -> DataFrame:
    """top(task, layer, expert) → (a, b, jaccard) for all tasks a < b: the mean over layers of the Jaccard of their sets, 0 where both have none."""
    layers = top.select("layer").distinct()
    tasks = top.select("task").distinct()
    pairs = tasks.toDF("a").join(tasks.toDF("b"), F.col("a") < F.col("b"))
    sizes = top.groupBy("task", "layer").agg(F.count("*").alias("n"))
    hits = top.toDF("a", "layer", "expert").join(top.toDF("b", "layer", "expert"), ["layer", "expert"]).where("a < b").groupBy("a", "b", "layer").agg(F.count("*").alias("h"))
    both = pairs.join(layers).join(sizes.toDF("a", "layer", "na"), ["a", "layer"], "left").join(sizes.toDF("b", "layer", "nb"), ["b", "layer"], "left").join(hits, ["a", "b", "layer"], "left").fillna(0, ["na", "nb", "h"])
    either = F.col("na") + F.col("nb") - F.col("h")
    return both.groupBy("a", "b").agg(F.avg(F.when(either > 0, F.col("h") / either).otherwise(0.0)).alias("jaccard"))


def verdict(mean_jaccard):
    """cohesive from 0.7, ambiguous from 0.4, else split-candidate."""
    return F.when(mean_jaccard >= 0.7, "cohesive").when(mean_jaccard >= 0.4, "ambiguous").otherwise("split-candidate")


def boundary(distances: Sequence[tuple[str, str, float]]) -> list[list[str]]:
    """The two groups of tasks that single linkage joins last, the smaller first; of one task there is none.

    distances: a row for each pair of tasks, which are a dimension. The nearest groups are joined, of equal ones those whose
    groups stand first, where a joined group stands last.
    """
    tasks = sorted({x for a, b, _ in distances for x in (a, b)})
    far = {frozenset((a, b)): d for a, b, d in distances}
    groups = [[t] for t in tasks]
    while len(groups) > 2:
        near = [(min(far[frozenset((x, y))] for x in groups[i] for y in groups[j]), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups))]
        _, i, j = min(near)
        joined = groups[i] + groups[j]
        groups = [g for k, g in enumerate(groups) if k not in (i, j)] + [joined]
    return sorted((sorted(g) for g in groups), key=lambda g: (len(g), g)) if len(groups) == 2 else []
