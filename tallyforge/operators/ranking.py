"""Ranks that do not need all rows of a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import match

c = F.col


def rank_by_value(frame: DataFrame, group: list[str], value: str, alias: str) -> DataFrame:
    """SQL ``rank()`` of ``value`` (ascending) inside ``group`` without sorting the rows.

    Equal values share a rank, so rows are first counted per value and only those counts
    are put in order. Null is a group, and a value that stands before all others. Use it for values with a bounded domain, such as rounded ratios:
    the ordered table has one row per distinct value.
    """
    counts = frame.groupBy(*group, value).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select(*group, value, (F.coalesce(F.sum("_n").over(before), F.lit(0)) + 1).alias(alias))
    return match(frame, ranks, [*group, value])
