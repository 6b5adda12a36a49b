"""Queries by name, with equivalent SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (tables) -> DataFrame under its own name."""

    def add(f):
        from .sources.tables import Tables

        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def text_list(values) -> str:
    """A list of texts as SQL."""
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"
