"""Connected components of a link table, by alternating star contraction in the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def connected_components(links: DataFrame, tag: str = "components") -> DataFrame:
    """links: columns a, b (bigint). Returns node, component: every node that has a link to another
    node, and the smallest node reachable from it.

    Each round points nodes at the smallest neighbour (large star, then small star) and is written
    to the shared folder, so that lineage stays short and a lost executor costs one round at most.
    The rounds grow with the logarithm of the longest path. Minima are pre-aggregated before the
    shuffle and joined back, so a node with very many links is split by the skew join. Null or
    self links are ignored; no links give no rows."""
    spark = links.sparkSession
    edges, path = materialize(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), tag
    )
    before = _digest(edges)
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
            .select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        after, new_path = materialize(small, tag)
        now = _digest(after)
        changed, before = now != before, now
        discard(spark, path)
        edges, path = after, new_path
        if not changed:
            break
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _digest(edges: DataFrame) -> tuple:
    """Count and sums of two hashes: equal for equal sets of edges."""
    sums = (F.sum(F.xxhash64(F.lit(i), "u", "v").cast("decimal(38,0)")) for i in range(2))
    return tuple(edges.agg(F.count("*"), *sums).first())
