"""Pure data rules of the repair loop: candidate order, progress, patch metrics, guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import jaccard

# Thresholds of a useful selection, limits of a patch, placeholder marks.
LEAST_SELECTED, LEAST_RUNNABLE, LEAST_PRECISION, SURE = 3, 0.35, 0.45, 0.8
MOST_FILES, DELETION_FLOOR, DELETION_RATIO, MOST_REPEATS, MOST_SHOWN = 3, 50, 5, 4, 3
PLACEHOLDERS = ("TODO", "FIXME", "Placeholder", "NotImplementedError")
UNRELIABLE = 0.35


def _flag(name: str, default: bool = False) -> Column:
    return F.coalesce(name, F.lit(default)).cast("int")


def _num(name: str, default: int = 0) -> Column:
    return F.coalesce(name, F.lit(default))


def test_signal(mode: str = "hard") -> tuple[Column, Column]:
    """Weighted (F2P, P2P penalty): off gives none, soft a quarter; an unreliable signal counts at most 0.35."""
    if mode == "off":
        return F.lit(0.0), F.lit(0)
    c = F.coalesce(F.nullif("test_signal_confidence", F.lit(0.0)), F.lit(1.0))
    c = F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    c = F.when(~F.coalesce("test_signal_reliable", F.lit(True)), F.least(c, F.lit(UNRELIABLE))).otherwise(c)
    f2p, p2p = F.coalesce("f2p_pass_rate", F.lit(0.0)) * c, F.bround(_num("p2p_smoke_failures") * c)
    return (f2p * 0.25, F.bround(p2p * 0.25).cast("int")) if mode == "soft" else (f2p, p2p.cast("int"))


def candidate_order(mode: str = "hard") -> Column:
    """The keys of a candidate, greatest first, as a struct that compares in order."""
    f2p, p2p = test_signal(mode)
    lines = F.when(_num("changed_lines_total") > 0, F.col("changed_lines_total")).otherwise(10**6)
    chars = F.coalesce(F.length("prediction"), F.lit(0))
    # The keys and their order.
    keys = [
        _flag("clean_resolution"), _flag("verify_pass_after_edit"), _flag("smoke_pass_after_edit"), _flag("tdd_gate_passed", True),
        _flag("regression_gate_passed", True), _flag("progress_gate_passed", True), _flag("patch_gate_valid"),
        F.when(F.col("patch_gate_severity") == "info", 2).when(F.col("patch_gate_severity") == "warn", 1).otherwise(0),
        F.coalesce((F.col("status") == "Submitted").cast("int"), F.lit(0)),
        -F.coalesce(F.col("patch_gate_reason").contains("potential_signature_change").cast("int"), F.lit(0)),
        f2p, -p2p, -_num("graph_penalty"), _flag("tdd_evidence_complete", True) - 1, -_flag("tdd_fail_open_applied"),
        _flag("required_test_added", True) - 1, -F.when(_flag("indexed_search_attempted") == 1, 1 - _flag("indexed_query_success")).otherwise(0),
        -F.when(F.length("loop_abort_reason") > 0, 1).otherwise(0), -lines, -_num("format_errors"), -_num("timeouts"), -_num("steps"),
        -F.coalesce(F.nullif("attempt", F.lit(0)), F.lit(99)), (chars > 0).cast("int"), -chars,
    ]
    return F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys)))


def verification_progress() -> Column:
    keys = (_flag("patch_gate_valid"), _flag("clean_resolution"), _flag("verify_pass_after_edit"), _flag("smoke_pass_after_edit"), F.coalesce("f2p_pass_rate", F.lit(0.0)), -_num("p2p_smoke_failures"))
    return F.struct(*(k.alias(f"p{i}") for i, k in enumerate(keys)))


def best_candidate(candidates: DataFrame, group: str, mode: str = "hard") -> DataFrame:
    """The best row per group: verification progress first, then the candidate order, then the earliest attempt."""
    order = F.struct(verification_progress().alias("p"), candidate_order(mode).alias("k"), (-_num("attempt", 99)).alias("a"))
    rest = [c for c in candidates.columns if c != group]
    return candidates.groupBy(group).agg(F.max_by(F.struct(*rest), order).alias("b")).select(group, "b.*")


def attempt_similarity(a_files: Column, b_files: Column, a_size: Column, b_size: Column, a_hash: Column, b_hash: Column) -> Column:
    """1 for equal hashes, else 0.65 * Jaccard of changed files + 0.35 * ratio of sizes."""
    ratio = F.when((a_size > 0) & (b_size > 0), F.least(a_size, b_size) / F.greatest(a_size, b_size)).otherwise(0.0)
    mixed = F.lit(0.65) * jaccard(a_files, b_files) + F.lit(0.35) * ratio
    return F.when((F.length(a_hash) > 0) & (a_hash == b_hash), 1.0).otherwise(mixed)


def rejection_reason() -> Column:
    def text(c: str) -> Column:
        return F.when(F.length(F.trim(c)) > 0, F.trim(c))

    return F.coalesce(
        F.when(_flag("clean_resolution") == 1, "clean_resolution"),
        F.when(_flag("patch_gate_valid") == 0, text("patch_gate_reason")),
        F.when(_flag("progress_gate_passed", True) == 0, text("progress_gate_reason")),
        text("loop_abort_reason"),
        F.when(_flag("tdd_gate_passed", True) == 0, "issue_tests_not_green"),
        F.when(_flag("regression_gate_passed", True) == 0, "regression_gate_failed"),
        F.lit("candidate_unresolved"),
    )


def progress_gate(attempts: DataFrame, group: str, order: list[str], limit: int = 2) -> DataFrame:
    """Attempts with reason, pass flag and stagnation count.

    An attempt is stagnant when nothing improved on the one before and its failure
    signature is the same; the count runs over consecutive stagnant attempts (islands of a
    running count of the others).
    """
    w = Window.partitionBy(group).orderBy(*order)
    before = {c: F.lag(c).over(w) for c in ("failure_signature", "f2p_passed", "regression_failed", "clean_resolution")}
    first = F.row_number().over(w) == 1
    reason = (
        F.when(first, "first_attempt")
        .when(F.col("f2p_passed") > before["f2p_passed"], "new_issue_tests_green")
        .when(F.col("regression_failed") < before["regression_failed"], "regression_failures_reduced")
        .when((_flag("clean_resolution") == 1) & ~F.coalesce(before["clean_resolution"], F.lit(False)), "clean_resolution_improved")
        .when(~F.col("failure_signature").eqNullSafe(before["failure_signature"]), "failure_signature_changed")
        .otherwise("stagnant_failure_signature")
    )
    out = attempts.withColumn("reason", reason).withColumn("passed", F.col("reason") != "stagnant_failure_signature")
    out = out.withColumn("_island", F.sum(F.col("passed").cast("int")).over(w))
    inside = Window.partitionBy(group, "_island").orderBy(*order)
    out = out.withColumn("stagnation", F.row_number().over(inside) - 1).drop("_island")
    return out.withColumn("relocalize", F.col("stagnation") >= limit)


def patch_metrics(patches: DataFrame, diff: str = "diff", most_lines: int = 200) -> DataFrame:
    """Counts and gates of a unified diff, with its severity, the reasons of a failure and those of a warning."""
    lines = F.split(F.coalesce(diff, F.lit("")), "\n")
    df = patches.withColumn("_lines", lines)
    df = df.withColumn("_added", F.transform(F.filter("_lines", lambda x: F.rlike(x, F.lit(r"^\+(?!\+\+\s)"))), lambda x: F.substr(x, F.lit(2))))
    df = df.withColumn("_removed", F.transform(F.filter("_lines", lambda x: F.rlike(x, F.lit(r"^-(?!--\s)"))), lambda x: F.substr(x, F.lit(2))))
    trimmed = F.filter(F.transform("_added", lambda x: F.trim(x)), lambda x: x != "")
    # equal lines are neighbours once sorted, so one scan counts them
    start = F.struct(F.lit(None).cast("string").alias("line"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def count(acc: Column, x: Column) -> Column:
        run = F.when(acc["line"] == x, acc["run"] + 1).otherwise(1)
        return F.struct(x.alias("line"), run.alias("run"), F.greatest(acc["most"], run).alias("most"))

    repeats = F.aggregate(F.array_sort("_t"), start, count, lambda acc: acc["most"])
    define = r"^([+-])def\s+([A-Za-z_]\w*)\s*\((.*)\)\s*:"

    def defs(sign: str) -> Column:
        own = F.filter("_lines", lambda x: F.rlike(x, F.lit(define.replace("[+-]", "\\" + sign))))
        return F.transform(own, lambda x: F.struct(F.regexp_extract(x, define, 2).alias("name"), F.regexp_replace(F.regexp_extract(x, define, 3), r"\s+", "").alias("params")))

    code = lambda col: F.exists(col, lambda x: F.rlike(x, F.lit(r"^\s*[^#\s]")))
    df = df.withColumn("_t", trimmed).withColumn("_dd", defs("-")).withColumn("_ad", defs("+"))
    changed = F.exists("_ad", lambda a: F.exists("_dd", lambda d: d["name"] == a["name"]) & ~F.exists("_dd", lambda d: d == a))
    one_sided = (F.size("_dd") > 0) != (F.size("_ad") > 0)
    df = df.withColumns(
        {
            "files_changed": F.size(F.filter("_lines", lambda x: x.startswith("diff --git "))),
            "added_lines": F.size("_added"),
            "removed_lines": F.size("_removed"),
            "duplicate_line_max": repeats,
            "removed_functions": removed_functions(F.coalesce(diff, F.lit(""))),
            "signature_change": changed | one_sided,
            "placeholder": F.exists("_added", lambda x: F.rlike(x, F.lit("|".join(PLACEHOLDERS)))),
            "comment_only": ~(code("_added") | code("_removed")),
        }
    )
    total = F.col("added_lines") + F.col("removed_lines")
    fails = F.array(
        F.when(~F.rlike(F.coalesce(diff, F.lit("")), F.lit(r"\S")), "empty_diff"),
        F.when(F.col("files_changed") > MOST_FILES, F.concat(F.lit("too_many_files:"), F.col("files_changed").cast("string"))),
        F.when((total > most_lines) & F.lit(most_lines > 0), F.concat(F.lit("too_many_changed_lines:"), total.cast("string"), F.lit(f"_limit_{most_lines}"))),
        F.when((F.col("removed_lines") > DELETION_FLOOR) & (F.col("added_lines") > 0) & (F.col("removed_lines") > DELETION_RATIO * F.col("added_lines")), F.concat(F.lit("catastrophic_deletion:"), F.col("removed_lines").cast("string"), F.lit("_removed_vs_"), F.col("added_lines").cast("string"), F.lit("_added"))),
        F.when((total > 0) & F.col("comment_only"), "comment_only_diff"),
        F.when(F.col("duplicate_line_max") >= MOST_REPEATS, F.concat(F.lit("repetitive_code:max_repeat="), F.col("duplicate_line_max").cast("string"))),
        F.when(F.col("placeholder"), "placeholder_code"),
        F.when(F.size("removed_functions") > 0, F.concat(F.lit("removed_function_without_replacement:"), F.array_join(F.slice("removed_functions", 1, MOST_SHOWN), "|"))),
    )
    df = df.withColumn("fail_reasons", F.array_join(F.filter(fails, lambda x: x.isNotNull()), ","))
    df = df.withColumn("warn_reasons", F.when(F.col("signature_change"), "potential_signature_change").otherwise(""))
    severity = F.when(F.col("fail_reasons") != "", "fail").when(F.col("signature_change"), "warn").otherwise("info")
    return df.withColumn("severity", severity).withColumn("valid", F.col("severity") != "fail").drop("_lines", "_added", "_removed", "_t", "_dd", "_ad")


def removed_functions(diff: Column) -> Column:
    """``path:name`` of each function, at any indent, that a file's section removes and doesn't add again; only of Python files that are no tests."""
    # a section runs from its header to the next; text before the first belongs to no file
    sections = F.slice(F.split(F.concat(F.lit("\n"), diff), r"\ndiff --git "), 2, 1 << 30)

    def names(section: Column, sign: str) -> Column:
        return F.regexp_extract_all(section, F.lit(rf"(?m)^\{sign}\s*def\s+([A-Za-z_][A-Za-z0-9_]*)\s*\("), F.lit(1))

    def removed(section: Column) -> Column:
        path = F.trim(F.regexp_extract(section, r"^a/(.*?) b/", 1))
        added = names(section, "+")
        gone = F.filter(names(section, "-"), lambda n: ~F.array_contains(added, n))
        return F.when(path.endswith(".py") & ~is_test_like(path), F.transform(gone, lambda n: F.concat(path, F.lit(":"), n))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(sections, removed))


def is_test_like(path: Column) -> Column:
    """A test by its lower-case path: below tests, testing or a nested test folder, or named test_x or x_test."""
    p = F.lower(F.trim(path))
    return F.rlike(p, F.lit(r"(^|/)(tests|testing)(/|$)|/test/|(^|/)test_[^/]*$|_test\.py$"))


def precision_floor(selected: DataFrame, group: str) -> DataFrame:
    """Per group of selected tests (confidence, score, runnable): whether the selection is useful, else why not."""
    c = F.least(F.greatest(F.coalesce("confidence", "score", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    run = F.coalesce("runnable", F.lit(False))
    out = selected.groupBy(group).agg(F.count(F.lit(1)).alias("selected"), F.count_if(run).alias("runnable"), F.avg(c).alias("precision"), F.bool_or(c >= SURE).alias("sure"))
    ratio = F.col("runnable") / F.col("selected")
    reason = F.when(
        F.col("selected") >= LEAST_SELECTED,
        F.when(ratio < LEAST_RUNNABLE, "low_runnable_ratio").when(F.col("precision") < LEAST_PRECISION, "low_confidence").otherwise(""),
    ).otherwise(F.when((F.col("runnable") > 0) & F.col("sure"), "").when(F.col("runnable") <= 0, "no_runnable_nodeids").otherwise("low_confidence"))
    return out.withColumn("ratio", ratio).withColumn("reason", reason).withColumn("passed", F.col("reason") == "").drop("sure")


def reliability(rows: DataFrame, group: str) -> DataFrame:
    """Least confidence and whether all flags hold."""
    return rows.groupBy(group).agg(F.min("confidence").alias("confidence"), F.bool_and("reliable").alias("reliable"))


def graph_guard(mode: str, indexed: Column, test_changed: Column) -> Column:
    """Empty where an attempt may go on, else why not, by mode: either, both or indexed_only."""
    mode = mode if mode in ("either", "both", "indexed_only") else "either"
    missing = F.array_join(F.filter(F.array(F.when(~indexed, "indexed_search_missing"), F.when(~test_changed, "unit_test_change_missing")), lambda x: x.isNotNull()), ",")
    if mode == "indexed_only":
        return F.when(indexed, "").otherwise("graph_guard_indexed_only_failed:indexed_search_missing")
    passed = indexed & test_changed if mode == "both" else indexed | test_changed
    return F.when(passed, "").otherwise(F.concat(F.lit(f"graph_guard_{mode}_failed:"), missing))


def guard_shape(indexed: Column, test_changed: Column) -> Column:
    return F.when(indexed & test_changed, "both").when(indexed, "either_indexed").when(test_changed, "either_test_change").otherwise("none")


def evidence_missing(checks: dict[str, Column]) -> Column:
    """Names of the checks that don't hold, in order."""
    return F.filter(F.array(*(F.when(~F.coalesce(c, F.lit(False)), name) for name, c in checks.items())), lambda x: x.isNotNull())


def hybrid_fallback(hybrid_selected: Column, hybrid_runnable: Column, coverage_selected: Column) -> Column:
    """Which selection to run: the hybrid one while any of it can run, else coverage if it selected something."""
    return F.when((hybrid_selected > 0) & (hybrid_runnable > 0), "hybrid").when(coverage_selected > 0, "coverage").otherwise("none")
