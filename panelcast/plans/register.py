"""Where queries and their SQL are kept by operator id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
PLACES = 8


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, places: int = PLACES) -> DataFrame:
    """Doubles to a fixed number of places, so that the order of sums does not show; minus zero as zero."""
    return df.withColumns({c: F.round(F.col(c), places) + F.lit(0.0) for c in columns})


def r(c: str | Column, name: str, places: int = PLACES) -> Column:
    return (F.round(F.col(c) if isinstance(c, str) else c, places) + F.lit(0.0)).alias(name)


def binary_round(c: Column, places: int) -> Column:
    """As SQL rounds a double: the scaled double is rounded to a whole number, half away from zero, and scaled back. F.round
    rounds the shortest decimal form instead, which differs where a double prints as half-way."""
    return F.round(c * F.lit(10.0**places), 0) / F.lit(10.0**places)
