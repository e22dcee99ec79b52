"""All registered queries of the scene analytics and of its sources, captures and streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenscape.plans.analytics import ANALYTICS, Query
from lumenscape.plans.capture_queries import CAPTURE
from lumenscape.plans.dense_queries import DENSE
from lumenscape.plans.read_queries import READ_QUERIES
from lumenscape.plans.source_queries import SOURCES

CATALOGUE: dict[str, Query] = ANALYTICS | SOURCES | CAPTURE | DENSE | READ_QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q.spark for name, q in CATALOGUE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.duckdb() for name, q in CATALOGUE.items() if q.sql}
