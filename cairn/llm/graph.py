"""Connected components as Spark joins: large-star and small-star steps until the edges no longer change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, large, stored


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of longs → (node, root), for every node with an edge; root is the smallest node reachable.

    Each round replaces edges by at most as many edges to nearer roots, until none changes and stars remain; a chain
    takes about as many rounds as the logarithm of its length. The work of a round is two shuffles of the edges, its
    result is written to the shared folder, and only two sums reach the driver.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges, last = stored(edges), None  # a round's table goes when the next is there
    while True:
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == last or not seen[0]:
            break
        last = seen
        both = edges.union(edges.select(F.col("v"), F.col("u"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        far = both.join(large(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = far.groupBy("u").agg(F.min("v").alias("m"))
        small = far.join(large(least), "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        done, edges = edges, stored(small.where("u <> v").distinct())
        dropped(done)
    return edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").union(edges.select(F.col("v"), F.col("v")).distinct())
