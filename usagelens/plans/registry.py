"""Names of queries, what computes them, and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL where plain SQL can say it."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return register


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison; the nudge keeps ties from depending on the last bit of a sum."""
    return F.round((F.col(c) if isinstance(c, str) else c) + F.lit(1e-9), digits)


def sql_round(c: str, digits: int = 6) -> str:
    return f"round(({c}) + 1e-9, {digits})"
