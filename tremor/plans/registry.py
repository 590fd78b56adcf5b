"""Names of the queries, their DataFrame plans and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("impact_queries", "link_queries", "evaluation_queries", "rule_queries")


def _merged(what: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(import_module(f"{__package__}.{name}"), what)
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("ORACLE_SQL")
