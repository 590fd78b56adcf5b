"""Upserts, snapshot comparison and subgraph deletion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert_nodes(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Last write wins per key, the greatest row hash of several; columns that only one side has stay."""
    both = old.withColumn("_seq", F.lit(0)).unionByName(new.withColumn("_seq", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (key, "_seq")]
    latest = both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("_seq", F.xxhash64(*rest))).alias("row"))
    return latest.select(key, *(F.col(f"row.{c}").alias(c) for c in rest))


def upsert_edges(old: DataFrame, new: DataFrame, confidence: str = "link_confidence", label: str | None = "link_source", maxima: tuple[str, ...] = ()) -> DataFrame:
    """One row per (src, dst): greatest confidence; the label of that row, the new one's at a tie; other maxima alone."""
    both = old.withColumn("_seq", F.lit(0)).unionByName(new.withColumn("_seq", F.lit(1)), allowMissingColumns=True)
    rank = F.struct(F.coalesce(confidence, F.lit(-1.0)), F.col("_seq"))
    aggs = [F.max(confidence).alias(confidence)]
    if label:
        rank = F.struct(F.coalesce(confidence, F.lit(-1.0)), F.col("_seq"), F.col(label))
        aggs.append(F.max_by(label, rank).alias(label))
    return both.groupBy("src", "dst").agg(*aggs, *(F.max(c).alias(c) for c in maxima))


def existing_endpoints(edges: DataFrame, sources: DataFrame, targets: DataFrame, key: str = "id") -> DataFrame:
    """Edges whose ends both exist."""
    s, t = sources.select(F.col(key).alias("src")), targets.select(F.col(key).alias("dst"))
    return edges.join(s, "src", "left_semi").join(t, "dst", "left_semi")


def edges_by_key(rows: DataFrame, sources: DataFrame, targets: DataFrame, source_key: str, target_key: str) -> DataFrame:
    """Edges (src, dst) from rows of natural keys (src_key, dst_key)."""
    s = sources.select(F.col("id").alias("src"), F.col(source_key).alias("src_key"))
    t = targets.select(F.col("id").alias("dst"), F.col(target_key).alias("dst_key"))
    return rows.join(s, "src_key").join(t, "dst_key").select("src", "dst")


def contains_edges(rows: DataFrame, parents: tuple[str, ...] = ("File", "Class")) -> DataFrame:
    """Containment rows (parent_type, parent_id, node_type, node_id) as edges; other parent types are skipped."""
    return rows.where(F.col("parent_type").isin(*parents)).select(F.col("parent_id").alias("src"), F.col("node_id").alias("dst"), F.col("parent_type").alias("src_label"), F.col("node_type").alias("dst_label")).distinct()


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, status) with status new, changed, unchanged or deleted, from (path, content_hash)."""
    o = old.select("path", F.col("content_hash").alias("before"), F.lit(True).alias("in_old"))
    n = new.select("path", F.col("content_hash").alias("after"), F.lit(True).alias("in_new"))
    status = F.when(F.col("in_new").isNull(), "deleted").when(F.col("in_old").isNull(), "new").when(F.col("before").eqNullSafe(F.col("after")), "unchanged").otherwise("changed")
    return o.join(n, "path", "full_outer").select("path", status.alias("status"))


def delete_files(nodes: dict[str, DataFrame], edges: dict[str, DataFrame], paths: DataFrame) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Nodes and edges without the given files, what they hold and every edge that touches either."""
    gone = paths.select("path").distinct()
    by_path = gone.withColumnRenamed("path", "file_path")
    kept = {k: df.join(gone, "path", "left_anti") if k == "file" else df.join(by_path, "file_path", "left_anti") for k, df in nodes.items()}
    dead = [df.join(gone, "path", "left_semi").select(F.col("path").alias("id")) if k == "file" else df.join(by_path, "file_path", "left_semi").select("id") for k, df in nodes.items()]
    dead_ids = reduce(DataFrame.union, dead).distinct()
    return kept, {k: without_nodes(df, dead_ids) for k, df in edges.items()}


def without_nodes(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_anti").join(ids.select(F.col("id").alias("dst")), "dst", "left_anti")


def update_suffix_matches(log: DataFrame, updates: DataFrame, order: str, name: str = "prediction_file") -> DataFrame:
    """Log rows whose file name equals an update's by its last part take the update's last non-null values.

    An update's columns are the log's by name, besides ``name`` and ``order``, by which the
    last one of a file counts; of equal ones the greatest value.
    """
    last: Column = F.element_at(F.split(F.col(name), "/"), -1)
    cols = [c for c in updates.columns if c not in (name, order)]
    u = updates.withColumn("_last", last).groupBy("_last").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(order, c))).alias(f"_{c}") for c in cols))
    joined = log.withColumn("_last", last).join(u, "_last", "left")
    return joined.select(*(F.coalesce(f"_{c}", c).alias(c) if c in cols else F.col(c) for c in log.columns))
