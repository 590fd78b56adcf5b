"""Connected components of a link table that stays distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STAGING, settings, stage, unstage


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """From links (a, b): one row (node, root) per node, root the least node of its component.

    Alternates two steps until nothing changes: every node links its larger neighbours, then
    its smaller ones, to the least of them. Both are an aggregation with partial sums and a
    join, so a node with very many links is split; every round is written to the shared folder.
    """
    seen, most = None, links.count()
    edges = stage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links", most)
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large, "links", most)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        after = stage(small, "links", most)
        unstage(edges, large)
        edges = after
        with settings(edges.sparkSession, STAGING):
            now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
