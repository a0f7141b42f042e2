"""The registered queries and the SQL that says the same over the same projection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .project import Graph, load, oracle_prefix

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def graph_query(sql: str | None, ctes: str = "", edges: bool = True) -> Callable:
    """``edges``: whether the query looks at any; its SQL is over the same tables either way."""

    def add(f: Callable[[Graph], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(load(spark, sf_dir, edges))
        if sql:
            SQL[f.__name__] = f"{oracle_prefix()}{', ' + ctes if ctes else ''} {sql}"
        return f

    return add


def table_query(sql: str | None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add
