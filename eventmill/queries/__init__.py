"""The registered queries of the reference's operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from eventmill.queries import acquisition, cohorts, comparison, core, estimation, gating, grids, learning, plates, sources, tables
from eventmill.queries.core import population_counts
from eventmill.queries.registry import QUERIES, SQL

__all__ = ["acquisition", "cohorts", "comparison", "core", "estimation", "gating", "grids", "learning", "oracle_sql", "plates", "population_counts", "queries", "sources", "tables"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
