"""Queries by name: each takes the relations of a scale factor; its SQL is the same over the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.bindings import Tables, with_relations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, relations: str = "", sql: str | None = None) -> Callable:
    """Register a query; ``sql`` follows the relations' common table expressions (a leading + continues their list)."""

    def keep(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            SQL[name] = with_relations(relations, sql) if relations else sql
        return f

    return keep
