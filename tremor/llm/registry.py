"""The queries of this package and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = (
    "bpe_codec",
    "filter_audit",
    "language_id",
    "mixing",
    "ngram_jaccard",
    "prefix_fingerprint",
    "quote_linking",
    "repeat_spans",
    "secret_scan",
    "sequence_packing",
    "tokenizer_alignment",
    "topk_index",
    "toxicity",
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict = {}
    for name in MODULES:
        found |= import_module(f"{__package__}.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict = {}
    for name in MODULES:
        found |= getattr(import_module(f"{__package__}.{name}"), "ORACLE_SQL", {})
    return found
