"""Analytics over runs, predictions and their evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import error_category, file_stamp, floor_percent, is_blank
from .select import median_of

COMPLETED = "completed"


def expected_membership(expected: DataFrame, results: DataFrame) -> DataFrame:
    """Per instance counts of expected tests by outcome.

    expected: (instance_id, kind F2P or P2P, test); results: (instance_id, test, status).
    issue_fixed holds when no expected F2P test failed, seen or not; f2p_observed says
    whether any was seen.
    """
    r = results.groupBy("instance_id", "test").agg(F.bool_or(F.col("status") == "PASSED").alias("passed"), F.bool_or(F.col("status") == "FAILED").alias("failed"))
    j = expected.join(r, ["instance_id", "test"], "left")

    def count(kind: str, c: str | None = None) -> Column:
        hit = F.col("kind") == kind
        return F.count_if(hit & F.coalesce(c, F.lit(False)) if c else hit)

    out = j.groupBy("instance_id").agg(
        count("F2P").alias("f2p_total"), count("F2P", "passed").alias("f2p_passed"), count("F2P", "failed").alias("f2p_failed"),
        count("P2P").alias("p2p_total"), count("P2P", "passed").alias("p2p_passed"), count("P2P", "failed").alias("p2p_failed"),
    )
    fixed = (F.col("f2p_total") > 0) & (F.col("f2p_failed") == 0)
    return out.withColumns({"issue_fixed": fixed, "has_regressions": F.col("p2p_failed") > 0, "clean_resolution": fixed & (F.col("p2p_failed") == 0), "f2p_observed": F.col("f2p_passed") + F.col("f2p_failed") > 0})


def regression_summary(instances: DataFrame) -> DataFrame:
    """One row of counts and rates; denominators are named: all instances, generated patches, P2P tests.

    instances: issue_fixed, has_regressions, clean_resolution, resolved (three-valued), generated, p2p_failed, p2p_total.
    """
    n = F.count(F.lit(1))
    counts = {c: F.count_if(F.coalesce(c, F.lit(False))) for c in ("resolved", "issue_fixed", "has_regressions", "clean_resolution", "generated")}
    return instances.agg(
        n.alias("instances"),
        *(v.alias(k) for k, v in counts.items()),
        (counts["resolved"] / n).alias("resolved_per_instance"),
        F.try_divide(counts["has_regressions"], n).alias("regressed_per_instance"),
        F.try_divide(F.count_if(F.coalesce("has_regressions", F.lit(False)) & F.coalesce("generated", F.lit(False))), counts["generated"]).alias("regressed_per_generated"),
        F.sum("p2p_failed").alias("p2p_failed"),
        F.sum("p2p_total").alias("p2p_total"),
        F.try_divide(F.sum("p2p_failed"), F.sum("p2p_total")).alias("test_regression_rate"),
    )


def generation_stats(predictions: DataFrame) -> DataFrame:
    """Rows, generated patches and lengths (mean, median, greatest; whole numbers) of (prediction); the median by distributed selection."""
    lengths = predictions.select(F.when(~is_blank(F.col("prediction")), F.length("prediction")).alias("size"))
    middle = median_of(lengths, "size")
    size = F.col("size")
    return lengths.agg(F.count(F.lit(1)).alias("total"), F.count(size).alias("generated"), F.floor(F.avg(size)).alias("mean_length"), F.lit(None if middle is None else int(middle)).cast("long").alias("median_length"), F.max(size).cast("long").alias("max_length"))


def error_counts(predictions: DataFrame, error: str = "error") -> DataFrame:
    return predictions.select(error_category(F.col(error)).alias("category")).where("category is not null").groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def metadata_averages(predictions: DataFrame) -> DataFrame:
    """Averages over rows whose graph was built; graph_metadata is a struct."""
    m = lambda c: F.when(F.col("graph_metadata.graph_built"), F.col(f"graph_metadata.{c}"))
    return predictions.agg(
        F.count_if(F.coalesce("graph_metadata.graph_built", F.lit(False))).alias("graphs_built"),
        F.avg(m("graph_build_time")).alias("avg_build_time"),
        F.avg(m("impacted_tests_found")).alias("avg_impacted"),
        F.min(m("impacted_tests_found")).alias("min_impacted"),
        F.max(m("impacted_tests_found")).alias("max_impacted"),
        F.avg(m("impact_analysis_time")).alias("avg_analysis_time"),
    )


def variant_rollup(runs: DataFrame) -> DataFrame:
    """Per variant: counts of true flags, whole percents and averages over what is known.

    runs: variant, generated, resolved, clean, seconds, patch_size.
    """
    n = F.count(F.lit(1))
    flags = {c: F.count_if(F.coalesce(c, F.lit(False))) for c in ("generated", "resolved", "clean")}
    return runs.groupBy("variant").agg(n.alias("n"), *(v.alias(k) for k, v in flags.items()), *(floor_percent(v, n).alias(f"{k}_pct") for k, v in flags.items()), F.avg("seconds").alias("avg_seconds"), F.avg("patch_size").alias("avg_patch_size"), F.sum("seconds").alias("total_seconds"))


def reconstruct_rollup(instances: DataFrame) -> DataFrame:
    """Three-valued resolved: counts and the rate over all; incomplete_instances has the ids."""
    r = F.col("resolved")
    return instances.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce(r, F.lit(False))).alias("resolved"), F.count_if(F.coalesce(~r, F.lit(False))).alias("unresolved"), F.count_if(r.isNull()).alias("incomplete"), F.try_divide(F.count_if(F.coalesce(r, F.lit(False))), F.count(F.lit(1))).alias("resolved_rate"))


def incomplete_instances(instances: DataFrame) -> DataFrame:
    """Ids without an outcome, a row each."""
    return instances.where("resolved is null").select("instance_id").distinct()


def score_stats(log: DataFrame) -> DataFrame:
    """Averages, extremes, drop and success ratio over completed rows; time totals."""
    done = F.col("evaluation_status").eqNullSafe(COMPLETED)
    gen, ev = F.when(done, F.coalesce("generation_score", F.lit(0.0))), F.when(done, F.col("evaluation_score"))
    return log.agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(done).alias("evaluated"),
        F.count_if(~done).alias("pending"),
        *(f(c).alias(f"{n}_{p}") for p, c in (("generation", gen), ("evaluation", ev)) for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max))),
        (F.avg(gen) - F.avg(ev)).alias("drop"),
        F.when(F.avg(gen) > 0, F.avg(ev) / F.avg(gen)).alias("success_ratio"),
        F.sum(F.when(F.col("generation_time") != 0, F.col("generation_time"))).alias("generation_seconds"),
        F.sum(F.when(done & (F.col("evaluation_time") != 0), F.col("evaluation_time"))).alias("evaluation_seconds"),
    )


def score_trend(log: DataFrame, group: str, order: list[str], score: str = "evaluation_score") -> DataFrame:
    """Per group: averages of the first half (n // 2 rows by order) and of the rest, and their difference; three rows at least."""
    w = Window.partitionBy(group)
    rows = log.withColumn("_rn", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count(F.lit(1)).over(w)).where("_n >= 3")
    first = F.col("_rn") <= F.floor(F.col("_n") / 2)
    out = rows.groupBy(group).agg(F.first("_n").alias("n"), F.avg(F.when(first, F.col(score))).alias("first_avg"), F.avg(F.when(~first, F.col(score))).alias("second_avg"))
    return out.withColumn("trend", F.col("second_avg") - F.col("first_avg"))


def two_mode_delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """Instances (instance_id, resolved, generated) of two modes side by side, and what changed."""
    x = a.select("instance_id", F.col("resolved").alias("a_resolved"), F.col("generated").alias("a_generated"), F.lit(True).alias("in_a"))
    y = b.select("instance_id", F.col("resolved").alias("b_resolved"), F.col("generated").alias("b_generated"), F.lit(True).alias("in_b"))
    change = (
        F.when(F.col("in_a").isNull(), "only_b").when(F.col("in_b").isNull(), "only_a")
        .when(~F.coalesce("a_resolved", F.lit(False)) & F.coalesce("b_resolved", F.lit(False)), "gained")
        .when(F.coalesce("a_resolved", F.lit(False)) & ~F.coalesce("b_resolved", F.lit(False)), "lost").otherwise("same")
    )
    return x.join(y, "instance_id", "full_outer").withColumn("change", change).drop("in_a", "in_b")


def mode_rates(instances: DataFrame) -> DataFrame:
    """Per mode: n, generated and resolved percent with two places."""
    n = F.count(F.lit(1))
    return instances.groupBy("mode").agg(n.alias("n"), *(F.round(100.0 * F.count_if(F.coalesce(c, F.lit(False))) / n, 2).alias(f"{c}_pct") for c in ("generated", "resolved")))


def best_experiments(experiments: DataFrame) -> DataFrame:
    """The best of (name, generation_rate, avg_seconds, avg_size) by rate, time and size, and the pick: the fastest within five percent of the best rate."""
    best = experiments.agg(F.max("generation_rate").alias("best_rate"), F.max_by("name", F.struct("generation_rate", "name")).alias("by_generation"), F.min_by("name", F.struct("avg_seconds", "name")).alias("by_time"), F.min_by("name", F.struct("avg_size", "name")).alias("by_size"))
    near = experiments.join(F.broadcast(best.select("best_rate"))).where(F.col("generation_rate") >= F.col("best_rate") * 0.95)  # best is one row
    pick = near.agg(F.min_by("name", F.struct("avg_seconds", "name")).alias("pick"))
    return best.join(F.broadcast(pick))


def catalogue(files: DataFrame) -> DataFrame:
    """Prediction files (path, instance_id): rows per file and its stamp, evaluations left out, newest first."""
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.withColumn("name", name).where(~F.col("name").contains("_eval")).groupBy("path", "name").agg(F.count("instance_id").alias("n"))
    return rows.withColumn("stamp", file_stamp(F.col("name"))).orderBy(F.col("stamp").desc_nulls_last(), "path")


def enrich_runs(runs: DataFrame, evaluated: DataFrame) -> DataFrame:
    """Run rows with the evaluation's resolved flag; clean = resolved without P2P failures."""
    j = runs.join(evaluated.select("instance_id", F.col("resolved").alias("eval_resolved")), "instance_id", "left")
    return j.withColumn("resolved", F.coalesce("eval_resolved", "resolved") if "resolved" in runs.columns else F.col("eval_resolved")).drop("eval_resolved").withColumn("clean", F.col("resolved") & (F.coalesce("p2p_failed", F.lit(0)) == 0))
