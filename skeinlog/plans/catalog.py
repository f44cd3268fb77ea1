"""All queries that have a DuckDB counterpart: name to (function of (spark, sf_dir)), and name to SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skeinlog.plans import checks, evidence, lines, scoring, sessions, state, synthesis

MODULES = (sessions, evidence, state, scoring, lines, checks, synthesis)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
