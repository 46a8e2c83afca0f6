"""Order-based operators that never put a hot group, or the whole table, in one task.

The rows are range-partitioned and sorted once and written to the shared folder, so that
partition numbers stay the same when an executor is lost and a task is run again. What
a partition needs to know of the ones before it is one small row per partition.

Null is a group like any other, as in SQL windows, and a null value of an ordering column stands before
all others (ascending, nulls first). Sums, maxima and medians leave null values out; a group of
nothing but null values has a null sum, maximum and median.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept, scratch

c = F.col
_ROW_BITS = 1 << 33  # monotonically_increasing_id counts rows below, partitions above this bit


def match(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys``, each column once, in which null equals null; still a hash or merge join."""
    if not keys:  # the whole table is one group, so ``right`` is one row
        return left.join(F.broadcast(right), how=how)
    own = {k: f"_match_{i}" for i, k in enumerate(keys)}
    on = [left[k].eqNullSafe(c(own[k])) for k in keys]
    return left.join(right.withColumnsRenamed(own), on, how).drop(*own.values())


def ranged(frame: DataFrame, order: list[str]) -> DataFrame:
    """Sorted rows with ``_part`` (increasing with the order) and ``_row`` inside it."""
    path = scratch(frame.sparkSession, "ranged")
    (frame.repartitionByRange(*order).sortWithinPartitions(*order)
     .withColumn("_id", F.monotonically_increasing_id())
     .withColumn("_part", F.floor(c("_id") / F.lit(_ROW_BITS))).withColumn("_row", c("_id") % _ROW_BITS).drop("_id")
     .write.parquet(path))
    return frame.sparkSession.read.parquet(path)


def with_position(frame: DataFrame, order: list[str], alias: str = "position") -> DataFrame:
    """Add the 1-based place of each row in the whole order."""
    rows = ranged(frame, order)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_part").agg(F.count("*").alias("_n")).select(  # one row per partition
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return rows.join(F.broadcast(starts), "_part").withColumn(alias, c("_start") + c("_row") + 1).drop("_part", "_row", "_start")


def with_group_position(frame: DataFrame, group: list[str], order: list[str], alias: str = "position") -> DataFrame:
    """``row_number`` inside each group, safe for a group that holds most of the rows."""
    rows = with_position(frame, group + order, "_place")
    starts = rows.groupBy(*group).agg((F.min("_place") - 1).alias("_start"))
    return match(rows, starts, group).withColumn(alias, c("_place") - c("_start")).drop("_place", "_start")


def running(frame: DataFrame, group: list[str], order: list[str], value: str, alias: str, how: str = "sum") -> DataFrame:
    """Running sum or max per group over a total order, with hot groups cut into ranges."""
    fold = {"sum": F.sum, "max": F.max}[how]
    rows = ranged(frame, group + order)
    inside = Window.partitionBy("_part", *group).orderBy("_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("_part", *group).agg(fold(value).alias("_total"))
    carried = parts.select("_part", *group, fold("_total").over(before).alias("_carried"))
    local = match(rows.withColumn("_local", fold(value).over(inside)), carried, ["_part", *group])
    if how == "sum":
        both = F.when(c("_carried").isNull(), c("_local")).otherwise(F.coalesce(c("_local") + c("_carried"), c("_carried")))
    else:
        both = F.greatest("_local", "_carried")
    return local.withColumn(alias, both).drop("_part", "_row", "_local", "_carried")


def medians(frame: DataFrame, group: list[str], value: str, alias: str = "median") -> DataFrame:
    """Exact median per group (mean of the middle two for even counts), nulls left out.

    Equal values of a group are counted before anything is sorted, so a value that most rows
    share is one row; places are running sums of the counts over the distinct values.
    """
    counts = kept(frame.where(c(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_n")), "counts")
    placed = running(counts, group, [value], "_n", "_upto")
    totals = counts.groupBy(*group).agg(F.sum("_n").alias("_total"))
    low, high = F.floor((c("_total") + 1) / 2), F.floor(c("_total") / 2) + 1
    before = c("_upto") - c("_n")
    middle = match(placed, totals, group).where((c("_upto") >= low) & (before < high))
    return middle.groupBy(*group).agg(((F.min(value) + F.max(value)).cast("double") / 2).alias(alias))


def distribution(frame: DataFrame, group: list[str], value: str) -> DataFrame:
    """count, total, max and exact median of ``value`` per group."""
    totals = frame.groupBy(*group).agg(F.count(value).alias("count"), F.sum(value).alias("total"), F.max(value).alias("max"))
    return match(totals, medians(frame, group, value), group, "left")
