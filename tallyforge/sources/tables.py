"""The given Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_OPEN: dict[tuple[int, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Open a table once per session, so that its files are listed once."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    return cached_read(spark, path)


def cached_read(spark: SparkSession, path: str) -> DataFrame:
    key = (id(spark), path)
    if key not in _OPEN or _OPEN[key].sparkSession is not spark:
        _OPEN[key] = spark.read.parquet(path)
    return _OPEN[key]


class Tables:
    """The given tables as attributes: ``t.orders``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return table(self.spark, self.sf_dir, name)

