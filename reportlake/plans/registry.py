"""Registration of queries with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .inputs import frame, with_sql

Get = Callable[[str], DataFrame]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, inputs: tuple[str, ...] = ()):
    """Register a function of a table getter under its name; ``inputs`` are the derived tables that its SQL reads."""

    def add(f: Callable[[Get], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: frame(spark, sf_dir, name))
        if sql:
            ORACLE[f.__name__] = with_sql(inputs, sql)
        return f

    return add
