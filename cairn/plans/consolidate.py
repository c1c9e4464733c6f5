"""Consolidation as ordered phases over nodes and edges."""

from __future__ import annotations

from collections.abc import Callable, Collection
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import knowledge, learn
from ..sources.scratch import stored


@dataclass(frozen=True)
class Space:
    """nodes(node_id, layer, embedding), edges(src, dst, rel_type, weight, evidence, last_used), clusters(node_id, cluster), summaries(cluster, size, centroid), as_of: a date; least: the cosine from which nodes are near."""

    nodes: DataFrame
    edges: DataFrame
    as_of: str
    least: float = 0.7
    clusters: DataFrame | None = None
    summaries: DataFrame | None = None


Phase = Callable[[Space], Space]


def hidden(s: Space) -> Space:
    """Base nodes are clustered by density."""
    base = s.nodes.where("layer = 0").select(F.col("node_id").alias("vec_id"), "embedding")
    found = learn.dbscan_near(base, s.least, 2)
    return replace(s, clusters=stored(found.where("cluster >= 0").toDF("node_id", "cluster")))


def refresh(s: Space) -> Space:
    """Edges unused for a year lose half of their weight."""
    stale = F.datediff(F.to_date(F.lit(s.as_of)), F.col("last_used")) > 365
    return replace(s, edges=s.edges.withColumn("weight", F.when(stale, F.col("weight") / 2).otherwise(F.col("weight"))))


def emergence(s: Space) -> Space:
    """Clusters become nodes of the next layer, linked to their members; their ids are negative."""
    if s.clusters is None:
        return s
    members = s.nodes.join(s.clusters, "node_id")
    centers = stored(learn.centroids(members, "cluster"))
    name = -F.col("cluster") - 1
    nodes = s.nodes.unionByName(centers.select(name.alias("node_id"), F.lit(1).alias("layer"), F.col("centroid").cast("array<float>").alias("embedding")))
    kinds = dict(s.edges.dtypes)
    fresh = s.clusters.select(F.col("node_id").alias("src"), name.alias("dst"), F.lit("MEMBER_OF").alias("rel_type"), F.lit(1.0).alias("weight"), F.lit(1).alias("evidence"), F.to_date(F.lit(s.as_of)).alias("last_used"))
    edges = s.edges.unionByName(fresh.select(*(F.col(c).cast(kinds[c]).alias(c) for c in s.edges.columns)))
    return replace(s, nodes=nodes, edges=edges, summaries=centers)


def dynamic_edges(s: Space) -> Space:
    """Nodes of one layer that are near are analogous."""
    nodes = s.nodes.select(F.col("node_id").alias("id"), "layer", "embedding")
    none = s.edges.where("false").select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").alias("strength"))
    found = knowledge.dynamic_edges(nodes, learn.near_pairs(nodes, s.least, "id", same="layer"), none, knowledge.Thresholds(analogous=s.least))
    kinds = dict(s.edges.dtypes)
    fresh = found.select(F.col("a").alias("src"), F.col("b").alias("dst"), "rel_type", F.lit(0.5).alias("weight"), F.lit(1).alias("evidence"), F.to_date(F.lit(s.as_of)).alias("last_used"))
    return replace(s, edges=s.edges.unionByName(fresh.select(*(F.col(c).cast(kinds[c]).alias(c) for c in s.edges.columns))))


def summary(s: Space) -> Space:
    """Sizes of clusters, where emergence has not left them."""
    if s.summaries is None and s.clusters is not None:
        return replace(s, summaries=learn.centroids(s.nodes.join(s.clusters, "node_id"), "cluster"))
    return s


def decay(s: Space) -> Space:
    """Weights decay, and weak edges of little evidence go."""
    return replace(s, edges=learn.decayed(s.edges, s.as_of, 0.0003, 0.05, 2))


#: (order, name, required, phase)
PHASES: list[tuple[int, str, bool, Phase]] = [(10, "hidden", True, hidden), (20, "refresh", False, refresh), (22, "emergence", False, emergence), (25, "dynamic_edges", False, dynamic_edges), (28, "summary", False, summary), (30, "decay", True, decay)]


def register(order: int, name: str, phase: Phase, required: bool = False) -> None:
    """Adds a phase; phases of one order run in the order of registration."""
    if any(n == name for _, n, _, _ in PHASES):
        raise ValueError(f"{name} is registered")
    PHASES.append((order, name, required, phase))


def run(space: Space, skip: Collection[str] = (), first: int = 0, last: int = 99) -> Space:
    """All phases from `first` to `last` in order; a phase of `skip` is left out unless it is required."""
    for order, name, required, phase in sorted(PHASES, key=lambda p: p[0]):
        if first <= order <= last and (required or name not in skip):
            space = phase(space)
    return space
