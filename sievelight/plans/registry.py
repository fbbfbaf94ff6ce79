"""All queries over the engine's own operators, by name, with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import images, inspection, rules, study, telemetry, thresholds, words

Query = Callable[[SparkSession, str], DataFrame]
PARTS = (inspection, telemetry, words, rules, study, images, thresholds)


def queries() -> dict[str, Query]:
    return {k: f for part in PARTS for k, f in part.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for part in PARTS for k, s in part.SQL.items()}
