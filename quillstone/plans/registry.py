"""All registered queries of the engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import events, reads, reports, resolve, scalars, tables, vectors

_ALL = scalars.QUERIES | reads.QUERIES | tables.QUERIES | vectors.QUERIES | resolve.QUERIES | reports.QUERIES | events.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
