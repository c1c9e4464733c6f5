"""Upkeep of a knowledge graph: contradictions, novelty, constraints, inferred edges, categories, reflection."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intent import negation_differs
from .graph import activation, edge_attention
from .learn import centroids, of_one_length
from .vectors import knn_blocks, pair_cosines


def contradiction_candidates(points: DataFrame, queries: DataFrame, texts: DataFrame, least: float = 0.8, most: int = 5) -> DataFrame:
    """(q, node, sim) of the `most` nearest with cosine at least `least` whose text differs from the query's in a negation. points, queries: (vec_id, embedding); texts: (vec_id, text)."""
    near = knn_blocks(points, queries, most, least)
    both = near.join(texts.toDF("q", "a"), "q").join(texts.toDF("node", "b"), "node")
    return both.where(negation_differs(F.col("a"), F.col("b"))).select("q", "node", "sim")


def embedding_novelty(points: DataFrame, queries: DataFrame, k: int = 50, floor: float = 0.0, unknown: float = 0.8) -> DataFrame:
    """(vec_id, novelty): one less the mean cosine of the k nearest that reach the floor, 0 to 1; `unknown` where none does."""
    mean = knn_blocks(points, queries, k, floor).groupBy(F.col("q").alias("vec_id")).agg(F.avg("sim").alias("m"))
    return queries.select("vec_id").join(mean, "vec_id", "left").select("vec_id", F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("m"))), F.lit(unknown)).alias("novelty"))


def contradiction_scores(candidates: DataFrame) -> DataFrame:
    """contradiction_candidates → (vec_id, contradiction): the highest cosine of a contradicting node, at most 1."""
    return candidates.groupBy(F.col("q").alias("vec_id")).agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.max("sim"))).alias("contradiction"))


def correction_label(content: Column) -> Column:
    """The first sentence or line, cut to 120 characters."""
    first = F.regexp_extract(content, r"(?s)^(.[^.\n]*)", 1)
    return F.trim(F.substring(first, 1, 120))


def correction_nodes(observations: DataFrame, nodes: DataFrame, linked: DataFrame, rejected: Column, least: float = 0.92) -> tuple[DataFrame, DataFrame]:
    """Corrections made nodes of their own, in order of id: (outcome for each observation, links).

    observations(id, name, content, embedding): corrections that may be promoted; nodes(id, name, role_type, embedding): what
    is there; linked(id): observations that a correction node implements already, which are left out. `rejected` is the gate
    on the content. A correction that has the name of a correction node, or of an earlier one of these, reinforces it. Else
    it is skipped if a constraint or correction with cosine of at least `least` is there; else it makes a node. Outcomes:
    (id, label, outcome, node): rejected, updated, skipped, created; node is the id of the correction, its first observation's
    for a created one; links(id, node) of all updated and created.
    """
    fresh = observations.join(linked.select("id").distinct(), "id", "left_anti")
    label = F.coalesce(F.when(F.trim("name") != "", F.col("name")), F.when(correction_label(F.col("content")) != "", correction_label(F.col("content"))), F.lit("correction"))
    o = fresh.withColumns({"label": label, "rejected": F.coalesce(rejected, F.lit(False))})
    there = nodes.where("role_type = 'correction'").groupBy(F.col("name").alias("label")).agg(F.min("id").alias("known"))
    side = lambda df: df.select(F.col("id").alias("vec_id"), "embedding")
    near = knn_blocks(side(nodes.where("role_type in ('constraint', 'correction')")), side(o.where("not rejected")), 1, least, apart=False).select(F.col("q").alias("id"), F.lit(True).alias("near"))
    o = o.join(there, "label", "left").join(near, "id", "left").withColumn("near", F.coalesce("near", F.lit(False)))
    # the first of a label that is neither rejected nor near makes its node; those before it with that label are skipped, those after it reinforce it
    makes = o.where("not rejected and known is null and not near").groupBy("label").agg(F.min("id").alias("maker"))
    o = o.join(makes, "label", "left")
    outcome = F.when(F.col("rejected"), "rejected").when(F.col("known").isNotNull(), "updated").when(F.col("maker").isNull() | (F.col("id") < F.col("maker")), "skipped").when(F.col("id") == F.col("maker"), "created").otherwise("updated")
    done = o.select("id", "label", outcome.alias("outcome"), F.coalesce("known", "maker").alias("node"))
    done = done.withColumn("node", F.when(F.col("outcome").isin("created", "updated"), F.col("node")))
    return done, done.where("node is not null").select("id", "node")


def versioned_update(current: DataFrame, updates: DataFrame, key: str, values: list[str], retries: int = 3) -> tuple[DataFrame, DataFrame]:
    """current(key, version, values…), updates(key, expected, turn, values…) → (table after, report).

    An update takes effect if the row still has the version that it expects, and adds 1 to it; of several the first by turn.
    All others are conflicts: they read the version anew and try again, one of a key taking effect in each attempt, by turn,
    until `retries` are used up. Turns differ within a key. report: (key, turn, outcome, attempts, expected, version): applied
    with the new version, conflict with the version that stood at the end, missing for a key that is not there. Of a hot
    key only retries + 1 updates reach the task that has the key.
    """
    u = updates.join(current.select(key, F.col("version").alias("_version")), key, "left")
    fits = F.col("expected") == F.col("_version")
    known = u.where("_version is not null").withColumn("_fits", F.coalesce(fits, F.lit(False)))
    # turn by turn after the first that fits
    first = known.where("_fits").groupBy(key).agg(F.min("turn").alias("_first"))
    ordered = known.join(first, key, "left").withColumn("_late", F.coalesce(F.col("turn") != F.col("_first"), F.lit(True)))
    nth = F.row_number().over(Window.partitionBy(key).orderBy("_late", "turn"))
    attempt = F.col("_nth") + F.when(F.col("_first").isNull(), 1).otherwise(0)
    tried = ordered.withColumn("_nth", nth).where(F.col("_nth") <= retries + 1).withColumn("attempts", attempt).where(F.col("attempts") <= retries + 1)
    applied = tried.select(key, "turn", F.lit("applied").alias("outcome"), "attempts", "expected", (F.col("_version") + F.col("_nth")).alias("version"), *values)
    last = applied.groupBy(key).agg(F.max("version").alias("_now"), F.max_by(F.struct(*values), "version").alias("_new"))
    after = current.join(last, key, "left").select(key, F.coalesce("_now", "version").alias("version"), *(F.when(F.col("_now").isNull(), F.col(v)).otherwise(F.col(f"_new.{v}")).alias(v) for v in values))
    rest = u.join(applied.select(key, "turn"), [key, "turn"], "left_anti").join(last.select(key, "_now"), key, "left")
    missed = rest.select(key, "turn", F.when(F.col("_version").isNull(), "missing").otherwise("conflict").alias("outcome"), F.when(F.col("_version").isNull(), 1).otherwise(retries + 1).alias("attempts"), "expected", F.coalesce("_now", "_version").alias("version"))
    return after, applied.drop(*values).unionByName(missed)


def tagged_nodes(observations: DataFrame, prefix: str = "constraint:") -> DataFrame:
    """observations(id, tags, confidence, embedding) → a node for each tag of the prefix: (code, n, first, confidence, centroid). An observation counts once for each such tag that it has."""
    tag = F.explode(F.array_distinct(F.filter("tags", lambda t: t.startswith(prefix))))
    rows = observations.select("id", "confidence", "embedding", tag.alias("tag")).withColumn("code", F.expr(f"substring(tag, {len(prefix) + 1})"))
    summary = rows.groupBy("code").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("confidence").alias("confidence"))
    return summary.join(centroids(rows, "code").select("code", "centroid"), "code")


@dataclass(frozen=True)
class Thresholds:
    """When edges and node types are inferred."""

    analogous: float = 0.7
    contrasts: float = 0.3
    composes: float = 0.5
    bridges: int = 3
    hub: int = 10


def dynamic_edges(nodes: DataFrame, near: DataFrame, together: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """(a, b, rel_type). nodes(id, layer, embedding), ids distinct; near(a, b, sim): pairs of nodes of one layer and of cosine t.analogous or more (near_pairs with same="layer"); together(a, b, strength): co-activation.

    ANALOGOUS_TO: near and on one layer. CONTRASTS_WITH: co-activated though their cosine is t.contrasts at most.
    COMPOSES_WITH: co-activation of t.composes or more.
    """
    same = near.where(F.col("sim") >= t.analogous)
    apart = pair_cosines(together, of_one_length(nodes, "id", "embedding")).where(F.round("sim", 9) <= t.contrasts)
    edge = lambda df, kind: df.select("a", "b", F.lit(kind).alias("rel_type"))
    return edge(same, "ANALOGOUS_TO").unionAll(edge(apart, "CONTRASTS_WITH")).unionAll(edge(together.where(F.col("strength") >= t.composes), "COMPOSES_WITH"))


def node_kinds(links: DataFrame, domains: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """(id, degree, n_domains, hub, bridge). links(a, b); domains(id, domain): a bridge links to t.bridges domains or more, a hub has t.hub links or more."""
    both = links.select("a", "b").union(links.select("b", "a")).distinct()
    found = both.join(domains.toDF("b", "domain"), "b").groupBy(F.col("a").alias("id")).agg(F.count("*").alias("degree"), F.countDistinct("domain").alias("n_domains"))
    return found.select("*", (F.col("degree") >= t.hub).alias("hub"), (F.col("n_domains") >= t.bridges).alias("bridge"))


def oversized(nodes: DataFrame, category: str, least_share: float, max_depth: int = 4, separator: str = "-") -> DataFrame:
    """(category, n, share) of categories with that share of all nodes or more, but for those as deep as max_depth."""
    every = nodes.agg(F.count("*").alias("_all"))
    sizes = nodes.groupBy(category).agg(F.count("*").alias("n")).crossJoin(F.broadcast(every))  # one row
    depth = F.size(F.split(category, separator))
    return sizes.where(depth < max_depth).select(category, "n", (F.col("n") / F.col("_all")).alias("share")).where(F.col("share") >= least_share)


def expanded_seeds(seeds: DataFrame, edges: DataFrame, attention: Mapping[str, float], steps: int = 2, decay: float = 0.5) -> DataFrame:
    """seeds(node_id, score) → (node_id, activation): scores cut to 0..1 and spread along edges weighted by attention."""
    weighted = edge_attention(edges, dict(attention)).drop("attention").unionByName(edges.where("rel_type = 'CONTRADICTS'"))
    cut = seeds.where("node_id is not null").select("node_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))).alias("score"))
    return activation(cut, weighted, steps, decay if 0 <= decay <= 0.9 else 0.5, excite=tuple(attention))


#: (pattern, severity, action, metric, condition) of a one-row report.
RULES: tuple[tuple[str, str, str, str, str], ...] = (
    ("learning_saturation", "high", "prune_decayed_edges", "edge_count", "edge_count >= 50000"),
    ("high_orphan_ratio", "medium", "trigger_consolidation", "orphan_ratio", "orphan_ratio > 0.2"),
    ("high_correction_rate", "medium", "tombstone_stale", "correction_rate", "correction_rate > 0.15"),
    ("stale_consolidation", "low", "trigger_consolidation", "consolidation_age", "consolidation_age > 86400"),
    ("low_edge_entropy", "medium", "prune_excess_edges", "edge_entropy", "edge_entropy < 0.5 and edge_count > 0"),
    ("volatile_backlog", "medium", "graduate_volatile", "volatile_count", "volatile_count > 100"),
    ("many_weak_edges", "medium", "prune_decayed_edges", "weak_ratio", "edge_count > 0 and weak_ratio > 0.3"),
    ("stale_edges", "low", "refresh_stale_edges", "mean_weight", "edge_count > 100 and mean_weight < 0.2"),
    ("low_follow_rate", "medium", "review_guidance", "follow_rate", "follow_rate > 0 and follow_rate < 0.2"),
)


def reflect(report: DataFrame, rules: tuple = RULES) -> DataFrame:
    """(pattern, severity, action, value): the rules that a report of one row meets. Columns that the report lacks meet none."""
    out = []
    for pattern, severity, action, metric, condition in rules:
        if metric in report.columns:
            out.append(F.when(F.expr(condition), F.struct(F.lit(pattern).alias("pattern"), F.lit(severity).alias("severity"), F.lit(action).alias("action"), F.col(metric).cast("double").alias("value"))))
    return report.select(F.explode(F.array_compact(F.array(*out))).alias("r")).select("r.*")


def report_of(nodes: DataFrame, edges: DataFrame, correction: Column, as_of: Column, weak: float = 0.3) -> DataFrame:
    """One row on nodes(node_id) and edges(src, dst, weight, last_used): orphan_ratio, correction_rate, consolidation_age (seconds since the last edge was touched), edge_count, mean_weight, weak_ratio, edge_entropy (bits over ten classes of weight)."""
    linked = edges.select(F.col("src").alias("node_id")).union(edges.select("dst")).distinct().withColumn("_l", F.lit(1))
    n = nodes.join(linked, "node_id", "left").agg(F.avg(F.when(F.col("_l").isNull(), 1.0).otherwise(0.0)).alias("orphan_ratio"), F.avg(F.when(correction, 1.0).otherwise(0.0)).alias("correction_rate"))
    e = edges.agg(F.count("*").alias("edge_count"), F.avg("weight").alias("mean_weight"), F.avg(F.when(F.col("weight") < weak, 1.0).otherwise(0.0)).alias("weak_ratio"), F.max("last_used").alias("_last"))
    classes = edges.groupBy(F.least(F.lit(9), F.floor(F.col("weight") * 10)).alias("c")).agg(F.count("*").alias("k"))  # ten rows at most
    share = F.col("k") / F.col("all")
    entropy = classes.crossJoin(F.broadcast(classes.agg(F.sum("k").alias("all")))).agg(F.coalesce(-F.sum(share * F.log2(share)), F.lit(0.0)).alias("edge_entropy"))
    age = (F.unix_timestamp(as_of) - F.unix_timestamp(F.col("_last").cast("timestamp"))).alias("consolidation_age")
    return n.crossJoin(e).crossJoin(entropy).select("orphan_ratio", "correction_rate", age, "edge_count", "mean_weight", "weak_ratio", "edge_entropy")  # one row each
