"""The corpus queries by name and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from isobarn.llm import queries as own


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(own.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(own.ORACLE)
