"""Bounded reachability over call edges.

Each layer is written below one folder, as the partition of its depth, and what was found so far
is one scan of that folder: the plan of a layer does not hold the plans of the layers before it,
whatever the depth, and a lost executor costs one layer. A layer without rows ends the walk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from ..sources import scratch


class Layers:
    """Rows by depth, layer after layer."""

    def __init__(self, like: DataFrame, name: str):
        self.spark = like.sparkSession
        self.path = scratch.scratch_path(self.spark, name)
        self.columns = like.schema
        self.found: DataFrame = self.spark.createDataFrame([], StructType([*like.schema.fields]).add("depth", IntegerType()))

    def add(self, layer: DataFrame, depth: int) -> DataFrame:
        """Write a layer; its rows as written."""
        layer.select(*self.columns.names).write.parquet(f"{self.path}/depth={depth}")
        schema = self.found.schema
        self.found = self.spark.read.schema(schema).parquet(self.path)
        return self.found.where(F.col("depth") == depth).drop("depth")


def reachable_callers(calls: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """(node, depth): callers of the seeds at their least distance of 1 to ``depth``.

    Each layer is a join with the frontier, distinct, less what was seen: a node is
    expanded once. A seed that another seed calls is a caller like any other.
    """
    step = scratch.staged(calls.select(F.col("src").alias("caller"), F.col("dst").alias("node")).distinct(), "steps")
    frontier = seeds.select(F.col("id").alias("node")).distinct()
    layers = Layers(step.select(F.col("caller").alias("node")), "reached")
    for d in range(1, depth + 1):
        layer = step.join(frontier, "node").select(F.col("caller").alias("node")).distinct()
        frontier = layers.add(layer.join(layers.found.select("node"), "node", "left_anti"), d)
        if frontier.isEmpty():
            break
    return layers.found


def transitive_tests(calls: DataFrame, tests: DataFrame, seeds: DataFrame, depth: int = 3, decay: float = 0.7) -> DataFrame:
    """(test, depth, confidence): tests of reached callers, link confidence times a flat decay."""
    reached = reachable_callers(calls, seeds, depth)
    hits = tests.join(reached, tests["dst"] == reached["node"])
    return hits.groupBy(F.col("src").alias("test_id")).agg(F.min("depth").alias("depth"), F.max(F.col("link_confidence") * decay).alias("confidence"))


def best_paths(calls: DataFrame, seeds: DataFrame, depth: int = 3, default: float = 0.7, with_path: bool = True) -> DataFrame:
    """(start, seed, depth, confidence, path): least depth, then greatest product, then greatest path.

    Without the path the layers are plain hash aggregations.

    Layer by layer only the best row per (start, seed) goes on, so the work stays within
    nodes x seeds; a path of least depth never repeats an edge. A seed that reaches itself
    by a cycle is a hit.
    """
    step = calls.select(F.col("src").alias("caller"), F.col("dst").alias("start"), F.coalesce("resolution_confidence", F.lit(default)).alias("edge"))
    step = scratch.staged(step.groupBy("caller", "start").agg(F.max("edge").alias("edge")), "steps")
    layer = seeds.select(F.col("id").alias("start"), F.col("id").alias("seed"), F.lit(1.0).alias("confidence"), *([F.array("id").alias("path")] if with_path else []))
    layers = Layers(layer, "paths")
    for d in range(1, depth + 1):
        grown = layer.join(step, "start").select(F.col("caller").alias("start"), "seed", (F.col("confidence") * F.col("edge")).alias("confidence"), *([F.concat(F.array("caller"), F.col("path")).alias("path")] if with_path else []))
        grown = grown.join(layers.found.select("start", "seed"), ["start", "seed"], "left_anti")
        if with_path:
            grown = grown.groupBy("start", "seed").agg(F.max(F.struct("confidence", "path")).alias("b")).select("start", "seed", "b.confidence", "b.path")
        else:
            grown = grown.groupBy("start", "seed").agg(F.max("confidence").alias("confidence"))
        layer = layers.add(grown, d)
        if layer.isEmpty():
            break
    return layers.found


def best_path_tests(calls: DataFrame, tests: DataFrame, seeds: DataFrame, depth: int = 3, with_path: bool = True) -> DataFrame:
    """(test, start, seed, depth, confidence, path): link confidence times the path's, divided by its depth."""
    paths = best_paths(calls, seeds, depth, with_path=with_path)
    hits = tests.join(paths, tests["dst"] == paths["start"])
    return hits.select(F.col("src").alias("test_id"), "start", "seed", "depth", (F.coalesce("link_confidence", F.lit(0.6)) * F.col("confidence") / F.col("depth")).alias("confidence"), *(["path"] if with_path else []))
