"""Named queries over the driver's tables, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from citeloom.plans import domain, records, star


def core_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return records.QUERIES | star.QUERIES | domain.QUERIES


def core_sql() -> dict[str, str]:
    return records.SQL | star.SQL | domain.SQL
