"""Coverage data files: SQLite databases of executed lines by context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import is_test_path, normalise_paths
from . import formats


def read_coverage(spark: SparkSession, path: str, root: str = "") -> DataFrame:
    """(context, file_path, line) of the data files below a path; files outside root and test files are left out.

    A file that is no such database gives no rows; names that begin with a dot are read too.
    """
    formats.register(spark)
    found = spark.read.format("coverage_lines").load(path)
    rows = found.select("context", normalise_paths(F.col("file"), root).alias("file_path"), "line")
    return rows.where(F.col("file_path").isNotNull() & ~is_test_path(F.col("file_path"))).distinct()
