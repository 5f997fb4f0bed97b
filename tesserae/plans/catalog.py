"""All named queries of the engine and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import q_graph_web, q_joins, q_lexicon, q_more, q_records, q_reports, q_retrieval, q_rules, q_sources, q_state, q_telemetry, q_text  # noqa: F401
from .registry import REGISTRY


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q.run for name, q in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in REGISTRY.items() if q.sql}
