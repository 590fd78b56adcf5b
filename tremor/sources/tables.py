"""Graph tables and reports at rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..schema import EDGES, NODES


def save_graph(path: str, nodes: dict[str, DataFrame], edges: dict[str, DataFrame], mode: str = "overwrite") -> None:
    for kind, tables in (("nodes", nodes), ("edges", edges)):
        for name, df in tables.items():
            df.write.mode(mode).parquet(f"{path}/{kind}/{name}")


def load_graph(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Saved tables; an empty one with the table's schema where none was saved."""
    return tuple({n: read_or_empty(spark, f"{path}/{kind}/{n}", s) for n, s in schemas.items()} for kind, schemas in (("nodes", NODES), ("edges", EDGES)))


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def clear_graph(spark: SparkSession, path: str) -> None:
    save_graph(path, {n: spark.createDataFrame([], s) for n, s in NODES.items()}, {n: spark.createDataFrame([], s) for n, s in EDGES.items()})


def find_nodes(nodes: DataFrame, **equal: object) -> DataFrame:
    """Rows whose columns have the given values; a list means any of them."""
    for c, v in equal.items():
        nodes = nodes.where(F.col(c).isin(v) if isinstance(v, (list, tuple, set)) else F.col(c).eqNullSafe(F.lit(v)))
    return nodes


def write_test_map(mapping: DataFrame, path: str) -> None:
    """Lines ``source: tests`` in order; one line that says so where there are none."""
    lines = mapping.select(F.concat_ws(": ", "source", "tests").alias("value"))
    if lines.isEmpty():
        lines = mapping.sparkSession.createDataFrame([("# no tests mapped",)], "value string")
    lines.orderBy("value").write.mode("overwrite").text(path)


def write_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """The columns in the given order, missing ones and nulls empty."""
    out = rows.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in columns))
    out.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def markdown(rows: DataFrame, limit: int = 100) -> str:
    """A table of the first rows, for reports; says how many more there are."""
    head = rows.limit(limit + 1).collect()
    cols = rows.columns
    lines = ["| " + " | ".join(cols) + " |", "|" + "---|" * len(cols)]
    lines += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in head[:limit]]
    if len(head) > limit:
        lines.append(f"\n{rows.count() - limit} more")
    return "\n".join(lines)
