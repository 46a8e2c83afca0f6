"""Run a set of queries in name order, time each, keep errors, report and sum the medians."""

from __future__ import annotations

import time
from collections.abc import Callable
from statistics import median

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import QUERIES, on_tables

c = F.col


def run_suite(spark: SparkSession, queries: dict[str, Callable[[], DataFrame]], iterations: int = 1) -> list[tuple[str, int, int, str]]:
    """(name, iteration, durationMs, error); -1 ms marks a failure and the next query still runs.

    Every result is computed in full and thrown away, so the time is that of the whole query.
    """
    report = []
    for name in sorted(queries):
        for iteration in range(1, iterations + 1):
            spark.sparkContext.setJobGroup(f"{name}-{iteration}", name)
            start = time.perf_counter()
            try:
                queries[name]().write.format("noop").mode("overwrite").save()
                report.append((name, iteration, int((time.perf_counter() - start) * 1000), ""))
            except Exception as error:  # the suite goes on
                report.append((name, iteration, -1, str(error)))
    return report


def total_of_medians(report: list[tuple[str, int, int, str]]) -> float | None:
    """Seconds over all queries, or nothing if one of them failed."""
    if any(ms < 0 for _, _, ms, _ in report):
        return None
    names = {name for name, *_ in report}
    return sum(median([ms for n, _, ms, _ in report if n == name]) for name in names) / 1000


@on_tables("job_15_suite_report", """SELECT unnest(['broken', 'tpcds_003_brand_revenue_by_year', 'tpcds_045_category_revenue']) AS name, 2::BIGINT AS runs, unnest([true, false, false]) AS failed,
    unnest([true, false, false]) AS error_told, unnest([false, true, true]) AS in_total""")
def suite_report(t):
    """Two reports and one query that fails, twice each; the CSV report is read back."""
    from ..session import scratch

    chosen = {n: (lambda n=n: QUERIES[n](t.spark, t.sf_dir)) for n in ("tpcds_003_brand_revenue_by_year", "tpcds_045_category_revenue")}
    chosen["broken"] = lambda: t.nation.select(F.raise_error(F.lit("no such thing")).alias("x"))
    path = scratch(t.spark, "report")
    rows = run_suite(t.spark, chosen, 2)
    t.spark.createDataFrame(rows, "name string, iteration int, durationMs long, error string").write.json(path)
    report = t.spark.read.schema("name string, iteration int, durationMs long, error string").json(path)
    whole = total_of_medians([r for r in rows if r[0] != "broken"]) is not None and total_of_medians(rows) is None
    told = F.max(F.coalesce("error", F.lit("")).contains("no such thing"))
    return report.groupBy("name").agg(F.count("*").alias("runs"), (F.min("durationMs") < 0).alias("failed"), told.alias("error_told"), ((F.min("durationMs") >= 0) & F.lit(whole)).alias("in_total"))
