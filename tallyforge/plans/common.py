"""Short helpers shared by the retail reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import query
from .mart import open_mart
from .mart_oracle import MART_SQL

c = F.col


def tpcds(name: str, sql: str):
    """Register a report over the star schema; ``sql`` follows the CTEs of the mart."""

    def keep(fn):
        query(name, MART_SQL + sql)(lambda spark, sf_dir: fn(open_mart(spark, sf_dir)))
        return fn

    return keep


def _col(x) -> Column:
    return c(x) if isinstance(x, str) else x


def total(x, alias: str | None = None) -> Column:
    """Exact decimal sum, given out as double."""
    return F.sum(_col(x)).cast("double").alias(alias or x)


def mean(x, alias: str | None = None) -> Column:
    """Exact sum over count: the same double in every engine and for every row order."""
    return (F.sum(_col(x)).cast("double") / F.count(_col(x))).alias(alias or x)


#: Rows that a report shows.
TOP = 100


def top(frame: DataFrame, *order: str, n: int = TOP) -> DataFrame:
    """First n rows; ``-name`` sorts downwards."""
    keys = [c(o[1:]).desc() if o.startswith("-") else c(o).asc() for o in order]
    return frame.orderBy(*keys).limit(n)


def with_group(frame: DataFrame, keys: list[str], *aggs: Column) -> DataFrame:
    """Add aggregates of each row's group by a join back.

    Unlike a window, the rows of a hot group are never sorted in one task: the totals
    are combined map-side and joined back by hash or broadcast.
    """
    totals = frame.groupBy(*keys).agg(*aggs)
    names = [n for n in totals.columns if n not in keys]
    totals = totals.select(*[c(k).alias(f"_{k}") for k in keys], *names)
    same = reduce(lambda a, b: a & b, [c(k).eqNullSafe(c(f"_{k}")) for k in keys])  # as a window does with null keys
    return frame.join(totals, same).select(*frame.columns, *names)
