"""Learning and consolidation: edge updates, decay, message passing, clustering, identity, catalogs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import cosine, edge_decay, hebbian
from ..sources.scratch import large, stored
from .vectors import cross_pairs, density_links, kmeans, knn_below, knn_blocks, pivot_pairs, sent_means, vector_means, whole

__all__ = ["kmeans", "knn_blocks", "vector_means"]


def coactivated(edges: DataFrame, pairs: DataFrame, eta: float = 0.02, mu: float = 0.01) -> DataFrame:
    """edges(src, dst, weight) merged with pairs(src, dst, a, b): the Hebbian rule for pairs, from weight 0 for new ones; other edges stay."""
    both = edges.join(pairs, ["src", "dst"], "full")
    w = F.coalesce("weight", F.lit(0.0))
    return both.select("src", "dst", F.when(F.col("a").isNotNull(), hebbian(w, F.col("a"), F.col("b"), eta, mu)).otherwise(w).alias("weight"), F.col("weight").isNull().alias("created"))


def decayed(edges: DataFrame, as_of: str, rate: float, least: float, evidence: int) -> DataFrame:
    """Weights after w exp(-rate days) since last_used. Edges at or below 0 go, and those under `least` with less evidence unless pinned."""
    days = F.datediff(F.to_date(F.lit(as_of)), F.col("last_used"))
    out = edges.withColumn("weight", edge_decay(F.col("weight"), days, rate))
    pinned = F.coalesce(F.col("pinned"), F.lit(False)) if "pinned" in edges.columns else F.lit(False)
    return out.where((F.col("weight") > 0) & ~((F.col("weight") < least) & (F.col("evidence") < evidence) & ~pinned))


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) → (node, root): the least node reachable, by repeated minima over neighbours and their roots until none changes."""
    links = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    label = links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    last = None
    while True:
        near = links.join(label, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("m"))
        low = label.join(near, F.col("node") == F.col("a")).select("node", F.least("root", "m").alias("root"))
        jump = low.join(low.toDF("n2", "r2"), F.col("root") == F.col("n2")).select("node", F.col("r2").alias("root"))
        label = stored(jump)
        now = label.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]
        if now == last:
            break
        last = now
    return label


def of_one_length(points: DataFrame, id_col: str, vector: str, *more: str | None) -> DataFrame:
    """(id, v, more…) of the rows whose vector is as long as the first; floats stay such."""
    width = len((points.select(vector).where(F.col(vector).isNotNull()).first() or [[]])[0])
    kind = "array<float>" if dict(points.dtypes)[vector] == "array<float>" else "array<double>"
    return points.select(F.col(id_col).alias("id"), F.col(vector).cast(kind).alias("v"), *(c for c in more if c)).where(F.size("v") == width)


def near_pairs(points: DataFrame, least: float, id_col: str = "vec_id", vector: str = "embedding", planes: int = 0, recall: float = 0.95, block: int = 4096, seed: int = 3, same: str | None = None) -> DataFrame:
    """(a, b, sim) with a < b and cosine at least `least`. Vectors of another length than the first are near none. same: a column that both must share, in the exact form.

    planes = 0 is exact: blocks of about `block` points that lie near the same pivots meet, but for those that the pivots
    tell apart (vectors.pivot_pairs). planes > 0 compares points that share a side of `planes` random planes in one of as many tables as give that recall at `least`,
    more above it; each pair is then checked. Points of one key are compared in blocks of about `block`, whatever their number.
    """
    import math

    import numpy as np
    import pyarrow as pa

    if not planes:
        return pivot_pairs(of_one_length(points, id_col, vector, same), least, block, same=same)
    p = of_one_length(points, id_col, vector).withColumn("v", F.col("v").cast("array<double>"))
    width = len((p.select("v").first() or [[]])[0])
    share = (1 - math.acos(max(-1.0, min(1.0, least))) / math.pi) ** planes
    tables = max(1, math.ceil(math.log(1 - recall) / math.log(max(1e-12, 1 - share)))) if share < 1 else 1
    sides = np.random.default_rng(seed).standard_normal((width, tables * planes))

    def keys(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy().reshape(-1, width)
                bits = (x @ sides > 0).reshape(len(x), tables, planes) @ (1 << np.arange(planes, dtype=np.int64))
                key = bits + (np.arange(tables, dtype=np.int64) << planes)
                at = np.repeat(np.arange(len(x)), tables)
                for i in range(0, len(at), 10_000):
                    part = pa.array(at[i : i + 10_000])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(part), batch.column(1).take(part), pa.array(key.ravel()[i : i + 10_000])], ["id", "v", "key"])

    keyed = p.mapInArrow(keys, f"id {dict(p.dtypes)['id']}, v array<double>, key long")
    sizes = keyed.groupBy("key").agg(F.ceil(F.count("*") / block).alias("n"))
    placed = keyed.join(sizes, "key").withColumn("k", F.pmod(F.xxhash64("id"), F.col("n")))
    cells = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda j: F.struct(F.least(F.col("k"), j).alias("i"), F.greatest(F.col("k"), j).alias("j"))))
    placed = placed.withColumn("cell", cells).select("key", F.col("cell.i").alias("i"), F.col("cell.j").alias("j"), "k", "id", "v")

    def compare(table: pa.Table) -> pa.Table:
        ids, k, i, j = (table.column(c).to_numpy() for c in ("id", "k", "i", "j"))
        x = table.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), width)
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        left, right = np.flatnonzero(k == i[0]), np.flatnonzero(k == j[0])
        sims = x[left] @ x[right].T
        u, w = np.nonzero(sims >= least - 1e-12)
        a, b, s = ids[left[u]], ids[right[w]], sims[u, w]
        keep = a < b if i[0] == j[0] else a != b
        a, b, s = a[keep], b[keep], s[keep]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "sim": s})

    kind = dict(p.dtypes)["id"]
    found = placed.groupBy("key", "i", "j").applyInArrow(compare, f"a {kind}, b {kind}, sim double")
    return found.groupBy("a", "b").agg(F.max("sim").alias("sim")).where(F.col("sim") >= least)


def conflicts(nodes: DataFrame, linked: DataFrame, least: float, most: int | None = None) -> DataFrame:
    """nodes(id, kind, embedding), linked(a, b) → (a, b, sim), a < b: nodes of opposing kinds with cosine at least `least` that no link joins yet, in either direction; the `most` nearest if given."""
    for_it, against = nodes.where(F.col("kind").isin("must", "should")), nodes.where(F.col("kind").isin("must_not", "should_not"))
    side = lambda df: df.select(F.col("id").alias("vec_id"), "embedding")
    met = cross_pairs(side(for_it), side(against), least)
    pairs = met.select(F.least("q", "node").alias("a"), F.greatest("q", "node").alias("b"), "sim")
    known = linked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    fresh = pairs.join(known, ["a", "b"], "left_anti")
    return fresh.orderBy(F.desc("sim"), "a", "b").limit(most) if most is not None else fresh


def dbscan(points: DataFrame, pairs: DataFrame, least_neighbours: int, id_col: str = "vec_id") -> DataFrame:
    """points(id) and their near pairs(a, b) → (id, cluster): the least core id of its component; a border point takes its least neighbouring core's; -1 for noise."""
    both = pairs.select("a", "b").union(pairs.select("b", "a"))
    core = both.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= least_neighbours).select(F.col("a").alias("core"))
    linked = pairs.select("a", "b").join(core.toDF("a"), "a", "left_semi").join(core.toDF("b"), "b", "left_semi")
    roots = components(linked.union(core.select("core", "core")))
    border = both.join(roots, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
    out = points.select(F.col(id_col).alias("id")).join(roots.toDF("id", "own"), "id", "left").join(border.toDF("id", "near"), "id", "left")
    return out.select("id", F.coalesce("own", "near", F.lit(-1)).alias("cluster"))


def dbscan_near(points: DataFrame, least: float, least_neighbours: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """dbscan of points(id, vector), whose pairs are those of near_pairs; they are never kept, and what is grows with the points and their blocks."""
    core, links = density_links(of_one_length(points, id_col, vector), least, least_neighbours)
    roots = components(links.where("not border").select("a", "b").union(core.select("id", "id")))
    border = links.where("border").join(large(roots), F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
    out = points.select(F.col(id_col).alias("id")).join(large(roots.toDF("id", "own")), "id", "left").join(large(border.toDF("id", "near")), "id", "left")
    return out.select("id", F.coalesce("own", "near", F.lit(-1)).alias("cluster"))


def centroids(points: DataFrame, group: str, vector: str = "embedding", digits: int = 9) -> DataFrame:
    """(group, size, centroid): the mean vector of each group."""
    return vector_means(points, [group], vector, name="centroid", digits=digits)


def merged_means(old: DataFrame, new: DataFrame, key: str, digits: int = 9) -> DataFrame:
    """old(key, size, centroid) after the rows that new(key, size, centroid) is the mean of: (size c + size' c') / (size + size')."""
    both = old.select(key, "size", "centroid").unionByName(new.select(key, "size", "centroid"))
    mean = vector_means(both, [key], "centroid", weight="size", digits=digits).drop("size")
    return both.groupBy(key).agg(F.sum("size").alias("size")).join(mean, key).withColumnRenamed("mean", "centroid")


def nearest_centroid(points: DataFrame, centers: DataFrame, group: str, least: float, id_col: str = "vec_id", vector: str = "embedding", most_broadcast: int = 2000) -> DataFrame:
    """(id, group, sim) of the nearest centre with cosine at least `least`. Up to most_broadcast centres are broadcast; more are searched in blocks."""
    if centers.count() > most_broadcast:
        known = centers.select(F.col(group).cast("long").alias("vec_id"), F.col("centroid").alias("embedding"))
        near = knn_blocks(known, points.select(F.col(id_col).alias("vec_id"), F.col(vector).alias("embedding")), 1, least, digits=9, apart=False)
        return near.select(F.col("q").alias("id"), F.col("node").alias(group), "sim")
    scored = points.select(F.col(id_col).alias("id"), F.col(vector).alias("v")).join(F.broadcast(centers.select(group, "centroid")), F.lit(True))
    scored = scored.select("id", group, F.round(cosine(F.col("v").cast("array<double>"), F.col("centroid")), 9).alias("sim"))
    best = scored.groupBy("id").agg(F.max(F.struct("sim", (-F.col(group)).alias("neg"))).alias("b"))
    return best.select("id", (-F.col("b.neg")).alias(group), F.col("b.sim").alias("sim")).where(F.col("sim") >= least)


def message_pass(nodes: DataFrame, edges: DataFrame, alpha: float, beta: float, vector: str = "embedding", digits: int = 9) -> DataFrame:
    """nodes(node_id, vector), edges(src, dst, weight), weights of at least 0 → (node_id, vector): alpha own + beta * weighted mean of what points at it; own where nothing does."""
    mean = sent_means(edges, of_one_length(nodes, "node_id", vector)).withColumnRenamed("dst", "node_id")
    own = F.col(vector).cast("array<double>")
    moved = F.zip_with(own, "mean", lambda x, m: F.round(alpha * x + beta * m, digits))
    kept = F.transform(own, lambda x: F.round(x, digits))
    return nodes.join(large(mean), "node_id", "left").select("node_id", F.when(F.col("mean").isNull(), kept).otherwise(moved).alias(vector))


def claims(edges: DataFrame) -> DataFrame:
    """edges(new, old, turn, preference) → (new, old): each `new`, in the order of `turn`, claims its most preferred `old` that is still free.

    Turns differ between the new, preferences between the edges of a new; lower ones come first. In each round every new that
    holds none asks its next old, and an old keeps the earliest of those that ask and goes back to none of the others: as all
    old prefer the earlier, what is kept when no one has anyone left to ask is what the claims in order give.
    """
    left, held = stored(edges.select("new", "old", "turn", "preference")), None
    while True:
        free = left if held is None else left.join(held.select("new"), "new", "left_anti")
        asks = free.groupBy("new").agg(F.min(F.struct("preference", "old", "turn")).alias("a")).select("new", "a.old", "a.turn")
        both = asks.withColumn("fresh", F.lit(True)) if held is None else asks.withColumn("fresh", F.lit(True)).unionByName(held.withColumn("fresh", F.lit(False)))
        kept = stored(both.groupBy("old").agg(F.min(F.struct("turn", "new")).alias("k"), F.max("fresh").alias("fresh")).select("old", "k.turn", "k.new", "fresh"))
        if not kept.agg(F.max("fresh")).first()[0]:
            return kept.select("new", "old")
        # an old never takes a later one than it holds
        bar = kept.select("old", F.col("turn").alias("bar"))
        held = kept.select("new", "old", "turn")
        left = stored(left.join(bar, "old", "left").where(F.col("bar").isNull() | (F.col("turn") <= F.col("bar"))).drop("bar"))


def identity_matches(old: DataFrame, new: DataFrame, least: float, least_cosine: float | None = None, order: str = "cluster", k: int = 64) -> DataFrame:
    """old(cluster, members[, centroid]), new(cluster, members[, centroid]) → (new, old, score, by): the old cluster that each new one goes on from.

    The new ones claim in turn, by `order` and cluster: of the old that are still free the one with the highest Jaccard of
    members, of at least `least`, and if there is none the one with the highest cosine of centroids, of at least
    `least_cosine`, to nine digits. Ties go to the smaller old id. `by` is members or centroid. Only clusters that share a
    member are compared by members; a member's new clusters travel to each of its old ones as a list and are counted there.
    By centroid only new ones that get none by members search, k old at a time, among those that no earlier one holds: an
    old never goes back to a later one, so that the others would refuse. Clusters are longs.
    """
    x = old.select(F.col("cluster").alias("old"), F.explode(F.array_distinct("members")).alias("m"), F.size(F.array_distinct("members")).alias("size_old"))
    y = new.select(F.col("cluster").alias("new"), F.explode(F.array_distinct("members")).alias("m")).groupBy("m").agg(F.collect_list("new").alias("news"))
    rows = x.join(large(y), "m").select("old", "size_old", "news").repartition("old").select("old", "size_old", F.explode("news").alias("new"))
    hits = rows.groupBy("old", "size_old", "new").agg(F.count("*").alias("h")).where(F.col("h") >= least * F.col("size_old") - 1e-9)
    score = F.col("h") / (F.col("size_old") + F.col("size_new") - F.col("h"))
    sized = hits.join(large(new.select(F.col("cluster").alias("new"), F.size(F.array_distinct("members")).alias("size_new"))), "new")
    pairs = stored(sized.select("new", "old", score.alias("score"), F.lit("members").alias("by")).where(F.col("score") >= least))
    turns = stored(new.select(F.col("cluster").alias("new"), F.col(order).alias("o")).orderBy("o", "new").select("new", F.monotonically_increasing_id().alias("turn")))
    ranked = lambda p: p.select("new", "old", F.struct(F.col("by") == "centroid", -F.col("score"), F.col("old")).alias("preference")).join(large(turns), "new")
    claimed = stored(claims(ranked(pairs)))
    if least_cosine is not None:
        side = lambda df: stored(whole(df.select(F.col("cluster").cast("long").alias("id"), "centroid"), "id", "centroid"))
        points, queries = side(old), side(new).join(large(turns.toDF("id", "bar")), "id")
        while True:
            held = claimed.join(large(turns), "new").select(F.col("old").alias("id"), F.col("turn").alias("bar"))
            barred = points.join(large(held), "id", "left").select("id", "v", F.coalesce("bar", F.lit(2**63 - 1)).alias("bar"))
            left = queries.join(large(claimed.select(F.col("new").alias("id"))), "id", "left_anti")
            near = stored(knn_below(stored(barred), stored(left), k, least_cosine).select(F.col("q").alias("new"), F.col("node").alias("old"), F.col("sim").alias("score"), F.lit("centroid").alias("by")))
            if near.isEmpty():
                break
            pairs = stored(pairs.unionByName(near))
            claimed = stored(claims(ranked(pairs)))
    out = claimed.join(large(pairs), ["new", "old"])
    return out.groupBy("new", "old").agg(F.max(F.struct(F.col("by") == "members", "score", "by")).alias("s")).select("new", "old", "s.score", "s.by")


def split_oversized(members: DataFrame, group: str, most: int, order: str) -> DataFrame:
    """Members with part: runs of `most` in order within each group."""
    nth = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    return members.withColumn("part", F.floor(nth / most))


def catalog(paths: DataFrame, n_bits: int, path: str = "path") -> DataFrame:
    """(bit, segment, df): the path segments of length 2 or more that stand in at most half of the paths, most frequent first, one bit each."""
    total = paths.agg(F.count("*").alias("total"))
    seg = paths.select(F.explode(F.array_distinct(F.split(path, "/"))).alias("segment")).where("length(segment) >= 2")
    df = seg.groupBy("segment").agg(F.count("*").alias("df")).join(F.broadcast(total), F.lit(True)).where("df <= total / 2")
    top = df.orderBy(F.desc("df"), "segment").limit(n_bits)
    return top.select((F.row_number().over(Window.orderBy(F.desc("df"), "segment")) - 1).alias("bit"), "segment", "df")


def fingerprints(items: DataFrame, bits: DataFrame, id_col: str, path: str = "path") -> DataFrame:
    """(id, fingerprint): the sorted bits of an item's segments. bits: the catalog, a fixed number of rows."""
    seg = items.select(id_col, F.explode(F.array_distinct(F.split(path, "/"))).alias("segment"))
    return seg.join(F.broadcast(bits.select("bit", "segment")), "segment").groupBy(id_col).agg(F.sort_array(F.collect_set("bit")).alias("fingerprint"))


def changed_since(nodes: DataFrame, edges: DataFrame, inputs: DataFrame, stamp: str) -> DataFrame:
    """Nodes with an in-edge from an input whose updated_at is later than the stamp."""
    fresh = inputs.where(F.col("updated_at") > F.to_timestamp(F.lit(stamp))).select(F.col("node_id").alias("src"))
    moved = edges.join(fresh, "src", "left_semi").select(F.col("dst").alias("node_id"))
    return nodes.join(moved, "node_id", "left_semi")


def keep_copies(df: DataFrame, key: Sequence[str], most: int, order: Sequence) -> DataFrame:
    """Rows flagged `archived` beyond the first of each key that has more than `most`."""
    w = Window.partitionBy(*key)
    return df.withColumns({"_n": F.count("*").over(w), "_k": F.row_number().over(w.orderBy(*order))}).withColumn("archived", (F.col("_n") > most) & (F.col("_k") > 1)).drop("_n", "_k")
