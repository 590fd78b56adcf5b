"""Impacted tests: strategies, scores, deduplication, tiers and the hybrid merge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import CONSENSUS, DEFAULT_CONFIDENCE, boosted_score, clamp, dedupe_key, impact_score, normalise_node_id, profile, pytest_node_id, tier, tier_rank
from ..sources import scratch
from .intervals import points_in_intervals
from .select import cap_per_group
from .traverse import best_paths, transitive_tests

# Order of the strategies and what they say.
SOURCES = ("direct", "transitive", "coverage", "imports")
#: Two products of three factors that differ by more than this before rounding do not meet after it.
ROUNDING = 1 - 1e-12
REASONS = {
    "direct": "Directly tests changed code",
    "transitive": "Transitive call dependency from changed code",
    "coverage": "Coverage dependency on changed file",
    "imports": "Imports changed file",
}


def changed_symbols(symbols: DataFrame, changed_lines: DataFrame) -> DataFrame:
    """Symbols (id, file_path, start_line, end_line) whose interval holds a changed line (file_path, line).

    A line meets the symbols of its own block of lines, one block of each size (``intervals``).
    """
    low = F.coalesce("start_line", "end_line", F.lit(0))
    high = F.coalesce("end_line", "start_line", F.lit(0))
    lines = changed_lines.select("file_path", "line").distinct()
    spans = symbols.select("id", "file_path", low.alias("low"), high.alias("high"))
    return points_in_intervals(lines, spans, "file_path", "line", "low", "high").select("id", "file_path").distinct()


def overlapping(symbols: DataFrame, low: Column | int, high: Column | int) -> DataFrame:
    low, high = (F.lit(x) if isinstance(x, int) else x for x in (low, high))
    return symbols.where((F.col("start_line") <= high) & (F.col("end_line") >= low))


def direct_tests(tests: DataFrame, symbols: DataFrame, changed: DataFrame) -> DataFrame:
    """(test_id, target_file, confidence): tests linked to a symbol of a changed file; changed: (path). Links may repeat."""
    hit = symbols.join(changed.select(F.col("path").alias("file_path")), "file_path", "left_semi").select(F.col("id").alias("dst"), F.col("file_path").alias("target_file"))
    # links to other symbols go first: Spark moves this to the side of a join that dst comes from
    links = tests.join(hit.select("dst"), "dst", "left_semi")
    return links.join(hit, "dst").groupBy(F.col("src").alias("test_id"), "target_file").agg(F.max("link_confidence").alias("confidence"))


def import_tests(test_nodes: DataFrame, imports: DataFrame, changed: DataFrame, confidence: float = 0.45) -> DataFrame:
    hit = imports.join(changed.select(F.col("path").alias("dst")), "dst", "left_semi")
    rows = test_nodes.join(hit.select(F.col("src").alias("file_path"), F.col("dst").alias("target_file")), "file_path")
    return rows.select(F.col("id").alias("test_id"), "target_file").distinct().withColumn("confidence", F.lit(confidence))


def import_files(imports: DataFrame, changed: DataFrame, confidence: float = 0.45) -> DataFrame:
    """(test_file, target_file, confidence): what ``import_tests`` gives each test of a file, once a file."""
    hit = imports.join(changed.select(F.col("path").alias("dst")), "dst", "left_semi")
    return hit.select(F.col("src").alias("test_file"), F.col("dst").alias("target_file")).distinct().withColumn("confidence", F.lit(confidence))


def coverage_tests(depends_on: DataFrame, changed: DataFrame) -> DataFrame:
    hit = depends_on.join(changed.select(F.col("path").alias("dst")), "dst", "left_semi")
    return hit.groupBy(F.col("src").alias("test_id"), F.col("dst").alias("target_file")).agg(F.max(F.coalesce("link_confidence", "coverage_pct")).alias("confidence"))


def transitive_candidates(calls: DataFrame, tests: DataFrame, symbols: DataFrame, seeds: DataFrame, flat: bool = False) -> DataFrame:
    """(test_id, target_file, confidence) by a flat decay, or by best paths."""
    if flat:
        return transitive_tests(calls, tests, seeds).select("test_id", F.lit(None).cast("string").alias("target_file"), "confidence")
    at = symbols.select(F.col("id").alias("seed"), F.col("file_path").alias("target_file"))
    # one path per start and file goes on to the tests: the best one does not depend on the test
    paths = best_paths(calls, seeds, with_path=False).join(at, "seed")
    ratio = F.col("confidence") / F.col("depth")
    best = paths.groupBy(F.col("start").alias("dst"), "target_file").agg(F.max(F.struct(ratio.alias("r"), "confidence", "depth")).alias("b"))
    score = F.coalesce("link_confidence", F.lit(DEFAULT_CONFIDENCE)) * F.col("b.confidence") / F.col("b.depth")
    return tests.join(best, "dst").groupBy(F.col("src").alias("test_id"), "target_file").agg(F.max(score).alias("confidence"))


def transitive_best(calls: DataFrame, tests: DataFrame, symbols: DataFrame, seeds: DataFrame, few: bool = False) -> DataFrame:
    """Of ``transitive_candidates`` by best paths, the rows that can be a test's best one; no more are formed.

    Confidences lie between 0 and 1. A start hands on, of each confidence and depth whose ratio is
    the greatest but for rounding, the last file, and its last file of all for links of confidence
    0, where all tie. What lies further below the greatest ratio stays below it for every test.
    ``few`` tells that few starts reach the seeds: links to others then go before anything is dealt out.
    """
    at = symbols.select(F.col("id").alias("seed"), F.col("file_path").alias("target_file"))
    kinds = best_paths(calls, seeds, with_path=False).join(at, "seed").groupBy(F.col("start").alias("dst"), "confidence", "depth").agg(F.max("target_file").alias("target_file"))
    ratio = F.col("confidence") / F.col("depth")
    top = kinds.groupBy("dst").agg(F.max(ratio).alias("most"), F.max("target_file").alias("last"))
    best = kinds.join(top, "dst").where((ratio >= F.col("most") * ROUNDING) | (F.col("target_file") == F.col("last"))).drop("most", "last")
    if few:
        best = scratch.staged(best, "best")
        tests = tests.join(best.select("dst").distinct(), "dst", "left_semi")
    score = F.coalesce("link_confidence", F.lit(DEFAULT_CONFIDENCE)) * F.col("confidence") / F.col("depth")
    return tests.join(best, "dst").select(F.col("src").alias("test_id"), "target_file", score.alias("confidence"))


def score_candidates(candidates: dict[str, DataFrame], strategy: str = "balanced", line_counts: DataFrame | None = None, places: int | None = None) -> DataFrame:
    """All candidates with their score; line_counts (target_file, lines) adds the boost."""
    w = profile(strategy)

    def one(source: str, df: DataFrame) -> DataFrame:
        df = df.select("test_id", "target_file", clamp(F.coalesce("confidence", F.lit(DEFAULT_CONFIDENCE))).alias("confidence"))
        lines: Column = F.lit(0)
        if line_counts is not None:
            df, lines = df.join(line_counts, "target_file", "left"), F.coalesce("lines", F.lit(0))
            score = boosted_score(w[source], F.col("confidence"), w["confidence_weight"], lines, w["line_boost_max"])
        else:
            score = impact_score(w[source], F.col("confidence"), w["confidence_weight"], places)
        return df.select("test_id", "target_file", "confidence", score.alias("score"), lines.cast("long").alias("line_count"), F.lit(source).alias("source"), F.lit(SOURCES.index(source)).alias("source_rank"))

    return reduce(DataFrame.unionByName, (one(s, df) for s, df in candidates.items()))


def best_per_test(scored: DataFrame, threshold: float = 0.0) -> DataFrame:
    """The best row of each test: score, then confidence, then the order of the strategies, then file.

    max_by is a partial aggregation, so a test with very many candidates is reduced before the shuffle.
    """
    rest = [c for c in scored.columns if c != "test_id"]
    order = F.struct("score", "confidence", (-F.col("source_rank")).alias("r"), F.coalesce("target_file", F.lit("")))
    best = scored.where(F.col("score") >= threshold).groupBy("test_id").agg(F.max_by(F.struct(*rest), order).alias("b"))
    return best.select("test_id", "b.*")


def best_of_files(files: DataFrame, test_nodes: DataFrame, strategy: str = "balanced", line_counts: DataFrame | None = None, threshold: float = 0.0) -> DataFrame:
    """Scored rows of ``import_files``, the best one for each test.

    A file's candidates are the same for all of its tests, so the best is chosen by file and goes
    on to the tests: tests x changed files are never formed.
    """
    best = best_per_test(score_candidates({"imports": files.withColumnRenamed("test_file", "test_id")}, strategy, line_counts), threshold)
    nodes = test_nodes.select("id", "file_path").distinct()
    return best.join(nodes, F.col("test_id") == F.col("file_path")).select(F.col("id").alias("test_id"), *best.columns[1:])


def best_of_all(found: dict[str, DataFrame], test_nodes: DataFrame, strategy: str = "balanced", line_counts: DataFrame | None = None, threshold: float = 0.0) -> DataFrame:
    """The best row of each test among candidates of all strategies; those of ``imports`` come from ``import_files``."""
    rest = {s: df for s, df in found.items() if s != "imports"}
    parts = [score_candidates(rest, strategy, line_counts)] if rest else []
    if "imports" in found:
        parts.append(best_of_files(found["imports"], test_nodes, strategy, line_counts, threshold))
    return best_per_test(reduce(DataFrame.unionByName, parts), threshold)


def ranked(impacted: DataFrame) -> DataFrame:
    """By score, confidence, changed lines, then id."""
    return impacted.orderBy(F.col("score").desc(), F.col("confidence").desc(), F.col("line_count").desc(), "test_id")


def tiered_top(impacted: DataFrame, k: int, descending_id: bool = False, runnable_first: bool = False) -> DataFrame:
    """The first k rows, high tier first, then medium, then low; one row per test."""
    order = [tier_rank(F.col("score")), F.col("score").desc()]
    if runnable_first and "runnable" in impacted.columns:
        order.insert(1, F.col("runnable").desc())
    if "line_count" in impacted.columns:
        order.append(F.col("line_count").desc())
    order.append(F.col("test_id").desc() if descending_id else F.col("test_id").asc())
    once = cap_per_group(impacted, "test_id", [*order, *(F.col(c) for c in impacted.columns if c not in ("test_id", "path", "matched_files"))], 1).drop("n")
    return once.withColumn("tier", tier(F.col("score"))).orderBy(*order).limit(k)


def tier_counts(impacted: DataFrame) -> DataFrame:
    t = tier(F.col("score"))
    return impacted.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(t == x).alias(x) for x in ("high", "medium", "low")), F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 6).alias("average"))


def coverage_diff(coverage: DataFrame, changed: DataFrame, threshold: float = 0.05, files: int = 5) -> DataFrame:
    """(test_id, score, coverage_hits, matched_files): tests whose coverage (test, file_path, ratio) meets changed files."""
    hit = coverage.join(changed.select(F.col("path").alias("file_path")), "file_path", "left_semi").select(F.col("test").alias("test_id"), "file_path", "ratio")
    # both uses below read what was found; coverage may be long to work out
    hit = scratch.staged(hit, "covered")
    totals = hit.groupBy("test_id").agg(F.max("ratio").alias("score"), F.count(F.lit(1)).alias("coverage_hits")).where(F.col("score") >= threshold)
    # only the first files of a test are gathered; Spark cuts each partition's before the shuffle
    first = cap_per_group(hit, "test_id", [F.col("ratio").desc(), F.col("file_path")], files)
    listed = F.array_sort(F.collect_list(F.struct((-F.col("ratio")).alias("r"), "file_path")))
    names = first.groupBy("test_id").agg(F.transform(listed, lambda x: x["file_path"]).alias("matched_files"))
    return totals.join(names, "test_id").select("test_id", "score", "coverage_hits", "matched_files")


def coverage_diff_top(found: DataFrame, k: int = 200) -> DataFrame:
    """The first k rows of coverage_diff by score, hits, then id."""
    return found.orderBy(F.col("score").desc(), F.col("coverage_hits").desc(), "test_id").limit(k)


def hybrid_merge(graph: DataFrame, coverage: DataFrame) -> DataFrame:
    """Union of both by dedupe key with maxima kept and a bonus for tests that both found.

    Both sides: test_id, test_name, test_file, score; graph also confidence, line_count and
    path (array); coverage also coverage_hits and matched_files.
    """
    key = dedupe_key(F.col("test_id"), F.col("test_file"), F.col("test_name"))

    def side(df: DataFrame, p: str, own: dict[str, Column]) -> DataFrame:
        base = {x: F.max_by(x, F.struct(F.col("score"), F.col(x))).alias(f"{p}_{x}") for x in ("test_id", "test_name", "test_file")}
        df = df.withColumn("key", key).where("key is not null").withColumn("score", F.coalesce("score", F.lit(0.0)))
        return df.groupBy("key").agg(*base.values(), F.max("score").alias(f"{p}_score"), *(c.alias(n) for n, c in own.items()))

    g = side(graph, "g", {"confidence": F.max("confidence"), "line_count": F.max("line_count"), "path": F.max_by("path", F.struct("score", "path"))})
    c = side(coverage, "c", {"coverage_hits": F.max("coverage_hits"), "matched_files": F.array_sort(F.array_distinct(F.flatten(F.collect_list("matched_files"))))})
    both = g.join(c, "key", "full_outer")
    gs, cs = F.coalesce("g_score", F.lit(0.0)), F.coalesce("c_score", F.lit(0.0))
    corroborated = (gs > 0) & (cs > 0)
    score = F.least(F.lit(1.0), F.greatest(gs, cs) + F.when(corroborated, CONSENSUS).otherwise(0.0))
    return both.select(
        "key",
        *(F.coalesce(f"g_{x}", f"c_{x}").alias(x) for x in ("test_id", "test_name", "test_file")),
        score.alias("score"),
        gs.alias("graph_score"),
        cs.alias("coverage_score"),
        F.when(corroborated, "graph+coverage").when(cs > 0, "coverage").otherwise("graph").alias("source"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("line_count", F.lit(0)).cast("long").alias("line_count"),
        F.coalesce("coverage_hits", F.lit(0)).cast("long").alias("coverage_hits"),
        "path",
        "matched_files",
    )


def hybrid_top(merged: DataFrame, k: int = 300) -> DataFrame:
    return merged.orderBy(F.col("score").desc(), F.col("graph_score").desc(), F.col("coverage_score").desc(), "test_id", "test_name").limit(k)


def impacted_tests(graph: dict[str, DataFrame], changed: DataFrame, strategy: str = "balanced", changed_lines: DataFrame | None = None, threshold: float = 0.1, flat: bool = False) -> DataFrame:
    """Every impacted test once, by all four strategies; graph holds function, test, tests, calls, imports, depends_on.

    With changed_lines the seeds are the symbols that hold them; files without any keep all of theirs.
    """
    symbols = graph["function"].select("id", "file_path", "start_line", "end_line")
    in_files = symbols.join(changed.select(F.col("path").alias("file_path")), "file_path", "left_semi")
    seeds, counts = in_files.select("id", "file_path"), None
    if changed_lines is not None:
        lines = changed_lines.join(changed.select(F.col("path").alias("file_path")), "file_path", "left_semi")
        exact = changed_symbols(in_files, lines)
        seeds = exact.union(seeds.join(exact.select("file_path").distinct(), "file_path", "left_anti").select("id", "file_path"))
        counts = lines.groupBy(F.col("file_path").alias("target_file")).agg(F.count_distinct("line").alias("lines"))
    hit = seeds.select(F.col("id").alias("dst"), F.col("file_path").alias("target_file"))
    direct = graph["tests"].join(hit.select("dst"), "dst", "left_semi").join(hit, "dst").groupBy(F.col("src").alias("test_id"), "target_file").agg(F.max("link_confidence").alias("confidence"))
    found = {
        "direct": direct,
        # changed lines add to the score of a file, so all files stay then
        "transitive": transitive_best(graph["calls"], graph["tests"], symbols, seeds, few=True) if counts is None and not flat else transitive_candidates(graph["calls"], graph["tests"], symbols, seeds, flat),
        "coverage": coverage_tests(graph["depends_on"], changed),
        "imports": import_files(graph["imports"], changed),
    }
    return best_of_all(found, graph["test"], strategy, counts, threshold)


def enrich_failures(failed: DataFrame, impacted: DataFrame) -> DataFrame:
    """Failed node ids (node_id) with their impact row, by id as it is, normalised, then by its last part; nulls where none."""
    i = impacted.select(pytest_node_id(F.col("test_file"), F.col("test_name"), F.lit(None).cast("string"), F.col("test_id")).alias("key"), "test_id", "score")
    by = i.groupBy("key").agg(F.max_by(F.struct("test_id", "score"), F.struct("score", "test_id")).alias("row"))
    last = by.select(F.element_at(F.split("key", "::"), -1).alias("key"), "row").groupBy("key").agg(F.max_by("row", F.struct("row.score", "row.test_id")).alias("row"))
    f = failed.select("node_id", normalise_node_id(F.col("node_id")).alias("plain")).withColumn("tail", F.element_at(F.split("plain", "::"), -1))
    out = f.join(by.toDF("node_id", "r1"), "node_id", "left").join(by.toDF("plain", "r2"), "plain", "left").join(last.toDF("tail", "r3"), "tail", "left")
    row = F.coalesce("r1", "r2", "r3")
    return out.select("node_id", row["test_id"].alias("test_id"), row["score"].alias("score"))


def test_map(tests: DataFrame, symbols: DataFrame, test_nodes: DataFrame) -> DataFrame:
    """(source, tests): each source file with its test files, sorted and joined by blanks."""
    t = tests.join(symbols.select(F.col("id").alias("dst"), F.col("file_path").alias("source")), "dst")
    t = t.join(test_nodes.select(F.col("id").alias("src"), F.col("file_path").alias("test_file")), "src").where("source <> test_file")
    return t.groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("test_file")), " ").alias("tests"))


def graph_stats(nodes: dict[str, DataFrame], edges: dict[str, DataFrame]) -> DataFrame:
    """(kind, label, n) for every node and edge table; edges count once."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), F.lit(label).alias("label"), "n") for kind, group in (("node", nodes), ("edge", edges)) for label, df in group.items()]
    return reduce(DataFrame.union, parts)


def freshness(metadata: DataFrame, repo: str, commit: str, fingerprint: str) -> DataFrame:
    """missing, stale or fresh, with the reason, for the one metadata row."""
    reason = (
        F.when(F.col("last_indexed_repo").isNull(), "missing_metadata")
        .when(F.col("last_indexed_repo") != repo, "repo_mismatch")
        .when(~F.col("last_indexed_commit").eqNullSafe(F.lit(commit)), "commit_changed")
        .when(~F.col("repo_fingerprint").eqNullSafe(F.lit(fingerprint)), "fingerprint_changed")
        .otherwise("")
    )
    state = F.when(F.col("last_indexed_repo").isNull(), "missing").when(reason == "", "fresh").otherwise("stale")
    return metadata.select("id", state.alias("state"), reason.alias("reason"))
