"""All queries of the engine by name, with the DuckDB SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import composition_queries, detector_queries, entailment_queries, rule_queries, signal_queries, stream_queries, structure_queries

Query = Callable[[SparkSession, str], DataFrame]
_PARTS = (detector_queries, rule_queries, entailment_queries, structure_queries, signal_queries, stream_queries, composition_queries)


def queries() -> dict[str, Query]:
    return {name: q for part in _PARTS for name, q in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
