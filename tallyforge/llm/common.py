"""Helpers of the training-data operators: tables, Arrow batches, words, shared folder."""

from __future__ import annotations

import hashlib
import io
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch

__all__ = ["batches", "documents", "kept", "own_columns", "sha256", "shipped", "table", "texts"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, read by Spark whatever the store behind the path is."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(frame: DataFrame, label: str) -> DataFrame:
    """The same rows as a table in the shared folder; the shuffle files that made it go once it is written."""
    spark = frame.sparkSession
    path, before = scratch(spark, label), spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        frame.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(frame.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def own_columns(frame: DataFrame, *names: str) -> DataFrame:
    """Only the columns an operator reads, so that other columns can't clash with its own."""
    return frame.select(*names)


def texts(column: pa.Array) -> Iterator[bytes | None]:
    """The UTF-8 bytes of a string column, one value at a time."""
    for value in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()):
        yield value.as_py()


def shipped(spark: SparkSession) -> None:
    """Let Python workers import this package: Spark serves it as a zip file, as with ``--py-files``.

    Nothing is done where the package is on the workers' path already.
    """
    root = Path(__file__).resolve().parents[2]
    context = spark.sparkContext
    on_path = [Path(p or ".").resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)] + [Path.cwd()]
    if root in on_path or root.suffix == ".zip" or context.applicationId in _SHIPPED:
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as out:
        for name in sorted((root / "tallyforge").rglob("*.py")):
            out.write(name, name.relative_to(root))
    target = Path(tempfile.mkdtemp(prefix="tallyforge-py-")) / "tallyforge.zip"  # read by the driver's file server only
    target.write_bytes(data.getvalue())
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)


_SHIPPED: set[str] = set()


def batches(frame: DataFrame, per_batch: Callable[[pa.RecordBatch], Iterable[dict]], schema: str, arrow: pa.Schema) -> DataFrame:
    """``per_batch`` turns each Arrow batch into dictionaries of columns; Spark bounds a batch in rows and bytes."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for columns in per_batch(batch):
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)

    shipped(frame.sparkSession)
    return frame.mapInArrow(run, schema)


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))
