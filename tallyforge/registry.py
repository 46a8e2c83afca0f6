"""Registered queries and the independent SQL statement that checks each of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` with its checking statement."""

    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return keep


def on_tables(name: str, oracle: str | None = None):
    """Register ``fn(t)``, where ``t`` opens the given tables by attribute."""
    from .sources.tables import Tables

    def keep(fn):
        query(name, oracle)(lambda spark, sf_dir: fn(Tables(spark, sf_dir)))
        return fn

    return keep
