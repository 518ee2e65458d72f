"""All queries of the library by name, each with the SQL it is checked against where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skyframe.plans import instrument_queries
from skyframe.plans import queries as plain

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return plain.QUERIES | instrument_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return plain.SQL | instrument_queries.SQL
