"""Building, refreshing and querying the graph of a source tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import normalise_paths
from ..operators import impact, link, merge
from ..schema import METADATA
from ..sources import code, scratch, store
from . import delta

Graph = tuple[dict[str, DataFrame], dict[str, DataFrame]]


def build_graph(spark: SparkSession, root: str) -> Graph:
    """Scan, parse, resolve and link a source tree. The parse result is staged, since several tables come from it."""
    files = code.scan_tree(spark, root)
    parsed = scratch.staged(code.parse_files(files), "parsed")
    nodes, edges = code.graph_tables(files, parsed, root)
    edges |= delta.resolve_edges(nodes)
    edges["tests"] = delta.link_tests(nodes, edges)
    edges["depends_on"] = spark.createDataFrame([], "src string, dst string, coverage_pct double, link_source string, link_confidence double")
    return nodes, edges


def update_graph(graph: Graph, files: DataFrame, root: str = "") -> Graph:
    """The graph after a new scan: only new and changed files are parsed, deleted ones go, and edges are renewed by ``delta``.

    The result is that of a full build, but for coverage edges, which no scan gives.
    """
    nodes, edges = graph
    diff = merge.snapshot_diff(nodes["file"], files.select("path", "content_hash"))
    diff = scratch.staged(diff.where("status <> 'unchanged'"), "diff")
    stale = diff.where("status in ('changed', 'deleted')").select("path")
    fresh = files.join(diff.where("status in ('changed', 'new')").select("path"), "path", "left_semi")
    kept_nodes, kept_edges = merge.delete_files(nodes, {k: edges[k] for k in ("contains", "depends_on") if k in edges}, stale)
    parsed = scratch.staged(code.parse_files(fresh), "parsed")
    new_nodes, new_edges = code.graph_tables(fresh, parsed, root)
    all_nodes = {k: kept_nodes[k].unionByName(new_nodes[k], allowMissingColumns=True) for k in nodes}
    out = delta.renew_edges(delta.Change(nodes, all_nodes, diff), edges)
    out["contains"] = kept_edges["contains"].unionByName(new_edges["contains"])
    out["depends_on"] = kept_edges.get("depends_on", edges["depends_on"])
    return all_nodes, out


def impacted_tests(graph: Graph, paths: list[str], root: str = "", strategy: str = "balanced", most: int = 50, changed_lines: DataFrame | None = None) -> DataFrame:
    """The ranked tests for changed paths.

    ``strategy`` is a profile of weights, ``coverage_diff`` (tests whose covered files meet the
    changed ones, the first 200) or ``hybrid`` (the balanced profile merged with it, the first
    300); other names raise.
    """
    nodes, edges = graph
    spark = nodes["file"].sparkSession
    given = spark.createDataFrame([(p,) for p in dict.fromkeys(paths)], "given string")
    changed = given.select(normalise_paths(F.col("given"), root).alias("path")).where("path is not null").distinct()
    if strategy in ("coverage_diff", "hybrid"):
        coverage = edges["depends_on"].select(F.col("src").alias("test"), F.col("dst").alias("file_path"), F.col("coverage_pct").alias("ratio"))
        names = nodes["test"].select(F.col("id").alias("test_id"), F.col("name").alias("test_name"), F.col("file_path").alias("test_file"))
        covered = impact.coverage_diff_top(impact.coverage_diff(coverage, changed)).join(names, "test_id", "left")
        if strategy == "coverage_diff":
            return impact.coverage_diff_top(covered)
    g = {"function": nodes["function"], "test": nodes["test"], "tests": edges["tests"], "calls": edges["calls"], "imports": edges["imports"], "depends_on": edges["depends_on"]}
    if strategy == "hybrid":
        found = impact.impacted_tests(g, changed, "balanced", changed_lines).join(names, "test_id", "left").withColumn("path", F.array("source"))
        as_text = lambda df: df.withColumn("test_id", F.col("test_id").cast("string"))
        return impact.hybrid_top(impact.hybrid_merge(as_text(found), as_text(covered)))
    return impact.tiered_top(impact.impacted_tests(g, changed, strategy, changed_lines), most)


def metadata(spark: SparkSession, root: str, files: DataFrame, commit: str | None = None) -> DataFrame:
    """The one metadata row of a tree: its fingerprint is over all paths and hashes."""
    digest = files.agg(F.sum(F.xxhash64("path", "content_hash").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n"))
    print_ = F.sha1(F.concat_ws(":", F.coalesce(F.col("s").cast("string"), F.lit("")), F.col("n").cast("string")))
    row = digest.select(F.lit("graph").alias("id"), F.lit(root).alias("last_indexed_repo"), F.lit("relative").alias("path_format"), F.lit(commit).alias("last_indexed_commit"), print_.alias("repo_fingerprint"), F.current_timestamp().alias("updated_at"))
    return spark.createDataFrame([], METADATA).unionByName(row, allowMissingColumns=True)


def open_graph(spark: SparkSession, root: str, path: str, commit: str | None = None, tries: int = 5) -> tuple[Graph, str]:
    """The graph of a tree as it is now, kept in the store at ``path``, and what was found there: missing, stale or fresh.

    A fresh graph is read. Where only the commit is another, the metadata alone are renewed;
    where files differ, the graph is updated by what changed; a missing one, or another tree's,
    is built. A new version is in place at once or not at all, and the one before it stays, so a
    failure at any point leaves a graph that can be read. If another opener was faster, this one
    looks again at what is there, ``tries`` times in all.
    """
    kept = store.GraphStore(spark, path)
    files = scratch.staged(code.scan_tree(spark, root), "files")
    now = metadata(spark, root, files, commit).first().asDict()
    now["updated_at"] = now["updated_at"].isoformat()
    first = None
    for last in range(tries - 1, -1, -1):
        base = kept.manifest()
        old = (base or {}).get("metadata", {})
        seen = spark.createDataFrame([("graph", old.get("last_indexed_repo"), old.get("last_indexed_commit"), old.get("repo_fingerprint"))], "id string, last_indexed_repo string, last_indexed_commit string, repo_fingerprint string")
        found = impact.freshness(seen, root, commit, now["repo_fingerprint"]).first()
        first = first or found["state"]
        if found["state"] == "fresh":
            return kept.load(base["version"]), first
        try:
            if old.get("last_indexed_repo") == root and old.get("repo_fingerprint") == now["repo_fingerprint"]:
                made = kept.set_metadata(now, base)
            elif found["state"] == "missing" or found["reason"] == "repo_mismatch":
                made = kept.save(*build_graph(spark, root), now, base)
            else:
                made = kept.save(*update_graph(kept.load(base["version"]), files, root), now, base)
            return kept.load(made["version"]), first
        except store.Conflict:
            if not last:
                raise
    raise ValueError("tries must be 1 or more")


def graph_statistics(spark: SparkSession, path: str, most_age: float | None = None) -> DataFrame:
    """Row counts of a kept graph beside its metadata; they are read from the newest version, or counted again beyond ``most_age`` seconds."""
    kept = store.GraphStore(spark, path)
    old = (kept.manifest() or {}).get("metadata", {})
    counts = kept.statistics(most_age)
    return counts.select("*", *(F.lit(old.get(c)).cast("string").alias(c) for c in ("last_indexed_repo", "last_indexed_commit", "repo_fingerprint", "updated_at")))


def refresh_coverage(spark: SparkSession, path: str, tests: list[str], coverage: DataFrame, per_test: int = 12, least: float = 0.1, most: int | None = 2000) -> DataFrame:
    """Puts the coverage links of chosen tests into the graph kept at ``path`` and gives a report of one row.

    tests: files or node ids as a tool was given them; coverage: (test, file_path, ratio), as
    ``link.coverage_by_test`` has it. Only the buckets that hold these links are written; an edge
    keeps its greatest confidence and coverage. ``metadata`` stay as they are.
    """
    asked = spark.createDataFrame(list(enumerate(tests)), "place int, ref string")
    chosen = link.chosen_tests(asked)
    links = scratch.staged(link.chosen_coverage(chosen, coverage, per_test, least, most), "chosen-coverage")
    merged = lambda old, new: merge.upsert_edges(old, new, maxima=("coverage_pct",))
    store.GraphStore(spark, path).change("edges", "depends_on", links, merged)
    return link.chosen_report(asked, chosen, links, most)
