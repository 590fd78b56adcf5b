"""Run logs, test output and report files as rows, by built-in text functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import base_name, file_stamp, is_blank, json_list
from ..schema import REPORT

# Words of test output.
STATUSES = "PASSED|FAILED|ERROR|SKIPPED|XFAIL|XPASS"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, value) of text files, blank lines left out."""
    lines = spark.read.text(path).withColumn("path", F.input_file_name())
    return lines.where(~is_blank(F.col("value"))).select("path", "value")


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines; strict fails at a malformed one, else it is kept in _corrupt_record."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Per-instance report files: (path, status ok or invalid, report fields); a file holds one object by instance id."""
    inner = f"struct<{REPORT.removeprefix('instance_id string, ')}>"
    whole = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    parsed = whole.withColumn("m", F.from_json("value", f"map<string,{inner}>"))
    ok = F.col("m").isNotNull() & (F.size("m") > 0)
    return parsed.select("path", F.when(ok, "ok").otherwise("invalid").alias("status"), F.explode_outer(F.when(ok, F.map_entries("m"))).alias("e")).select("path", "status", F.col("e.key").alias("instance_id"), "e.value.*")


def _last(text: Column, pattern: str) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), 1), F.lit(-1))


def _flag(text: Column) -> Column:
    return F.when(F.lower(text) == "true", True).when(F.lower(text) == "false", False)


def run_log(logs: DataFrame, text: str = "text") -> DataFrame:
    """Three-valued flags from a run log; of several matches the last counts."""
    t = F.col(text)
    return logs.withColumns(
        {
            "instance_id": _last(t, r"Result for (\S+?):"),
            "resolved": _flag(_last(t, r"resolved['\"]?: (True|False|true|false)")),
            "patch_exists": _flag(_last(t, r"patch_exists['\"]?: (True|False|true|false)")),
            "patch_applied": _flag(_last(t, r"patch_successfully_applied['\"]?: (True|False|true|false)")),
        }
    )


def pytest_results(outputs: DataFrame, text: str = "text") -> DataFrame:
    """One row per line ``file::test STATUS``: the other columns, node_id and status."""
    rest = [c for c in outputs.columns if c != text]
    lines = outputs.select(*rest, F.explode(F.split(text, "\n")).alias("line"))
    pattern = rf"^\s*(\S+::.+?)\s+({STATUSES})\b"
    return lines.where(F.rlike("line", F.lit(pattern))).select(*rest, F.regexp_extract("line", pattern, 1).alias("node_id"), F.regexp_extract("line", pattern, 2).alias("status"))


def pytest_summary(outputs: DataFrame, text: str = "text", first: bool = False) -> DataFrame:
    """passed, failed and errors of the last summary line (of the first match each, with ``first``)."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"\d+ (passed|failed|errors?)")))
    source = F.col(text) if first else F.try_element_at(lines, F.lit(-1))

    def count(word: str) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(source, rf"(\d+) {word}", 1), F.lit("")).cast("int"), F.lit(0))

    return outputs.withColumns({"passed": count("passed"), "failed": count("failed"), "errors": count("errors?")})


def prediction_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Prediction files below a path: rows and stamp, evaluations left out, newest first."""
    name = base_name(F.col("path"))
    rows = read_lines(spark, path).withColumn("name", name).where(~F.col("name").contains("_eval"))
    return rows.groupBy("path", "name").agg(F.count(F.lit(1)).alias("n")).withColumn("stamp", file_stamp(F.col("name"))).orderBy(F.col("stamp").desc_nulls_last(), "path")


def instances(rows: DataFrame, ids: DataFrame | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Dataset rows with their test lists as arrays, cut to ids and a limit; also the ids that are missing."""
    out = rows.withColumns({c: json_list(F.col(c)) for c in ("FAIL_TO_PASS", "PASS_TO_PASS")})
    missing = None
    if ids is not None:
        missing = ids.join(out.select("instance_id"), "instance_id", "left_anti")
        out = out.join(ids.select("instance_id").distinct(), "instance_id", "left_semi")
    return (out.orderBy("instance_id").limit(limit) if limit else out), missing


def unified_diff(diffs: DataFrame, text: str = "diff") -> DataFrame:
    """(other columns, file_path, line): added lines of a diff without context, by their new number; where a hunk only removes, its old numbers.

    Each hunk's header gives its numbers, so lines need no running state.
    """
    rest = [c for c in diffs.columns if c != text]
    files = diffs.select(*rest, F.explode(F.split(text, r"(?m)^diff --git ")).alias("part")).where(F.length("part") > 0)
    path = F.regexp_extract("part", r"(?m)^\+\+\+ (?:b/)?([^\t\n]+)", 1)
    old = F.regexp_extract("part", r"(?m)^--- (?:a/)?([^\t\n]+)", 1)
    named = files.withColumn("file_path", F.when((path == "") | (path == "/dev/null"), old).otherwise(path))
    head = r"(?m)^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"

    def group(i: int, default: str) -> Column:
        return F.transform(F.regexp_extract_all("part", F.lit(head), i), lambda x: F.when(x == "", default).otherwise(x).cast("int"))

    hunks = F.arrays_zip(group(1, "0").alias("o"), group(2, "1").alias("on"), group(3, "0").alias("n"), group(4, "1").alias("nn"))
    rows = named.where(F.col("file_path") != "").select(*rest, "file_path", F.explode(hunks).alias("h"))
    lines = F.when(F.col("h.nn") > 0, F.sequence(F.col("h.n"), F.col("h.n") + F.col("h.nn") - 1)).when(F.col("h.on") > 0, F.sequence(F.col("h.o"), F.col("h.o") + F.col("h.on") - 1))
    return rows.select(*rest, "file_path", F.explode(lines).alias("line")).distinct()


def changed_files(tracked: DataFrame, untracked: DataFrame) -> DataFrame:
    """Python files of both lists, each once."""
    return tracked.select("path").union(untracked.select("path")).where(F.col("path").endswith(".py")).distinct()
