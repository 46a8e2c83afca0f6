"""Plain jobs over Parquet rows that carry the version and the slice that added them.

A dataset is a folder with ``rows``, partitioned by ``version``, further columns if wanted (the same ones for all versions) and
``slice``, one file each; ``slices``, one small row for each slice that a version adds or removes, with bytes, records
and the least and greatest value of each column; and ``versions``, one row per version with its schema. Which slices
make up a state is a DataFrame over these tables; the rows are filtered by them through a partition column, so only their files
are read, and a read with a range leaves out the files that can't hold it. The statistics are those
of the Parquet footers, read by aggregate push-down; no row is read for them.
One writer at a time is taken for granted; there is no commit protocol. A version counts once its row
in ``versions`` is written, which is done last; what a broken write has left is overwritten by the next one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordered import running
from ..session import kept

c = F.col
_VERSION = "version int, operation string, committed timestamp, snapshot_id long, records long, files long, schema string"
_SLICE = "version int, kind string, slice string, bytes long, records long, part string, least map<string,string>, greatest map<string,string>"
#: The slice that stands for a folder taken over as it is.
CONVERTED = "converted"
#: Up to so many slices are named in the filter of a read; up to the second number they are broadcast; beyond it, joined by a shuffle.
MAX_NAMED_SLICES, MAX_BROADCAST_SLICES = 10_000, 1_000_000
#: Files that a task writes side by side; rows are put in order of their slice only where a task has more of them.
OPEN_FILES = 8
#: Types whose least and greatest value the footers hold in full.
_WITH_RANGE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DateType, T.BooleanType)


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def history(spark: SparkSession, path: str) -> DataFrame:
    """One row per version; none where nothing was written yet."""
    return _table(spark, f"{path}/versions", _VERSION)


def _log(spark: SparkSession, path: str) -> list[Row]:
    """The versions that count, in their order: one small row for each commit."""
    return sorted(history(spark, path).select("version", "operation", "schema").collect(), key=lambda r: r.version)


def _next(spark: SparkSession, path: str) -> int:
    return max([r.version for r in _log(spark, path)], default=-1) + 1


def footers(spark: SparkSession, push_down: bool = True):
    """Parquet is read by the reader that answers counts, minima and maxima from footers."""
    return _set(spark, {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": str(push_down).lower()})


@contextmanager
def _set(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def file_statistics(spark: SparkSession, folder: str, schema: T.StructType, keys: list[str]) -> DataFrame:
    """count, and min and max of each column that has a range, for each folder of the partition columns ``keys`` (all of them)."""
    ranged = [f.name for f in schema if isinstance(f.dataType, _WITH_RANGE) and f.name not in keys]
    spread = [e for n in ranged for e in (F.min(c(f"`{n}`")).alias(f"least {n}"), F.max(c(f"`{n}`")).alias(f"greatest {n}"))]
    rows = spark.read.schema(schema).parquet(folder)
    return (rows.groupBy(*keys) if keys else rows).agg(F.count("*").alias("records"), *spread)


def _maps(stats: DataFrame) -> DataFrame:
    """The minima and maxima as maps of texts by column."""
    of = lambda kind: [n for n in stats.columns if n.startswith(f"{kind} ")]
    both = lambda kind: F.map_from_arrays(F.array(*[F.lit(n.split(" ", 1)[1]) for n in of(kind)]).cast("array<string>"),
                                          F.array(*[c(f"`{n}`").cast("string") for n in of(kind)]).cast("array<string>")).alias(kind)
    return stats.select(*[n for n in stats.columns if " " not in n], both("least"), both("greatest"))


def _add_slices(spark: SparkSession, path: str, version: int, folder: str, schema: T.StructType, keys: list[str], sizes: DataFrame | None) -> None:
    """Note what a version adds: sizes from the listing, records and ranges from the footers."""

    def write(stats: DataFrame) -> None:
        rows = _maps(stats)
        part = F.to_json(F.struct(*[k for k in keys if k != "slice"])) if len(keys) > 1 else F.lit("{}")
        rows = rows.withColumn("part", part)
        rows = rows.withColumn("slice", F.lit(CONVERTED)).withColumn("bytes", F.lit(None)) if sizes is None else rows.join(sizes, "slice")
        rows = rows.select("slice", c("bytes").cast("long"), "records", "part", "least", "greatest")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/slices/version={version}/kind=added")

    try:
        with footers(spark):
            write(file_statistics(spark, folder, schema, keys))
    except (PySparkException, Py4JJavaError) as error:
        if "No min/max found" not in str(error):
            raise
        # a footer without a range, as for a column of nulls or one that holds NaN: the rows are read instead
        write(file_statistics(spark, folder, schema, keys))


def _note(spark: SparkSession, path: str, version: int, operation: str, committed: datetime, schema: T.StructType) -> int:
    """The row that makes a version count."""
    added = _table(spark, f"{path}/slices", _SLICE).where((c("version") == version) & (c("kind") == "added"))
    row = added.agg(F.coalesce(F.sum("records"), F.lit(0)).alias("records"), F.count("*").alias("files")).select(
        F.lit(operation).alias("operation"), F.lit(committed).cast("timestamp").alias("committed"),
        F.xxhash64(F.lit(path), F.lit(version)).alias("snapshot_id"), "records", "files", F.lit(schema.json()).alias("schema"))
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}/versions/version={version}")
    return version


def _write_rows(frame: DataFrame, path: str, version: int, name: Column, partition_by: tuple[str, ...], *leave_out: str) -> None:
    """Write rows below ``version``; ``name`` tells the slice, and each (slice, partition values) is one file.

    A task streams its rows into a few open files, so it doesn't hold a whole file's rows in memory to sort them by slice.
    """
    inside = F.concat(F.lit("h"), F.hex(F.xxhash64(*partition_by))) if partition_by else F.lit("")
    marked = frame.withColumn("slice", F.concat(F.lit(f"v{version}"), name, inside)).drop(*leave_out)
    with _set(frame.sparkSession, {"spark.sql.maxConcurrentOutputFileWriters": str(OPEN_FILES)}):
        marked.write.mode("overwrite").partitionBy(*partition_by, "slice").parquet(f"{path}/rows/version={version}")


def _publish(spark: SparkSession, path: str, version: int, operation: str, committed: datetime, schema: T.StructType, partition_by: tuple[str, ...]) -> int:
    folder = f"{path}/rows/version={version}"
    try:
        sizes = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder)
    except AnalysisException as error:  # a version without rows
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return _note(spark, path, version, operation, committed, schema)
    if "slice" in sizes.columns:
        own = T.StructType([f for f in schema if f.name not in partition_by] + [schema[k] for k in partition_by] + [T.StructField("slice", T.StringType())])
        _add_slices(spark, path, version, folder, own, [*partition_by, "slice"], sizes.groupBy("slice").agg(F.sum("length").alias("bytes")))
    return _note(spark, path, version, operation, committed, schema)


def write_version(frame: DataFrame, path: str, committed: datetime, operation: str = "append", partition_by: tuple[str, ...] = ()) -> int:
    """Add the rows as the next version: ``append``, or ``overwrite`` (earlier rows no longer count)."""
    spark = frame.sparkSession
    _merged(spark, path, frame.schema)
    version = _next(spark, path)
    _write_rows(frame, path, version, F.concat(F.lit("p"), F.spark_partition_id().cast("string")), partition_by)
    return _publish(spark, path, version, operation, committed, frame.schema, partition_by)


def convert(spark: SparkSession, parquet_path: str, path: str, committed: datetime) -> int:
    """Register an existing Parquet folder as the first version, without copying it."""
    schema = spark.read.parquet(parquet_path).schema
    _add_slices(spark, path, 0, parquet_path, schema, [], None)
    return _note(spark, path, 0, "convert", committed, schema)


def _merged(spark: SparkSession, path: str, more: T.StructType = T.StructType(), converted: bool = False, log: list[Row] | None = None) -> T.StructType:
    """One schema for the rows of all versions, from the schemas kept with them; no footer is read."""
    known = dict.fromkeys(r.schema for r in (_log(spark, path) if log is None else log) if converted or r.operation != "convert")
    fields: dict[str, T.StructField] = {}
    for schema in [*(T.StructType.fromJson(json.loads(x)) for x in known), more]:
        for field in schema:
            own = fields.setdefault(field.name, T.StructField(field.name, field.dataType))
            if own.dataType != field.dataType:
                raise ValueError(f"column {field.name} was {own.dataType.simpleString()} and can't be {field.dataType.simpleString()}")
    return T.StructType([*fields.values()])


def _live(spark: SparkSession, path: str, version: int | None = None, log: list[Row] | None = None) -> DataFrame:
    """The slices whose rows make up the dataset at ``version`` (default: the latest), with their statistics."""
    log = [r for r in (_log(spark, path) if log is None else log) if version is None or r.version <= version]
    begin = max([r.version for r in log if r.operation in ("overwrite", "convert")], default=0)
    events = _table(spark, f"{path}/slices", _SLICE).where(c("version").isin([r.version for r in log if r.version >= begin]))
    added = events.where(c("kind") == "added")
    if not any(r.operation == "compact" for r in log):
        return added
    return added.join(events.where(c("kind") == "removed").select("slice"), "slice", "left_anti")


def state(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The versions some of whose rows make up the dataset at ``version`` (default: the latest)."""
    return _live(spark, path, version).select("version").distinct()


def rows(spark: SparkSession, path: str, converted: str | None = None, log: list[Row] | None = None) -> DataFrame:
    """All rows ever added with ``version`` and ``slice``; columns added later are null before. ``converted`` is version 0."""
    schema = T.StructType([*_merged(spark, path, log=log), T.StructField("version", T.IntegerType()), T.StructField("slice", T.StringType())])
    if converted is None:
        return spark.read.schema(schema).parquet(f"{path}/rows")
    taken = spark.read.parquet(converted).withColumn("version", F.lit(0)).withColumn("slice", F.lit(CONVERTED))
    try:
        return taken.unionByName(spark.read.schema(schema).parquet(f"{path}/rows"), allowMissingColumns=True)
    except AnalysisException as error:  # nothing added yet
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return taken


def _of(found: DataFrame, slices: DataFrame) -> DataFrame:
    """The rows of the slices; their files alone are read, by the partition column."""
    names = slices.select("slice")
    first = names.limit(MAX_NAMED_SLICES + 1).collect()
    if len(first) <= MAX_NAMED_SLICES:
        return found.where(c("slice").isin([r.slice for r in first]))
    names = kept(names, "live").where(c("slice") > "")  # a filter, so that Spark prunes the files by the broadcast names
    return found.join(F.broadcast(names) if names.limit(MAX_BROADCAST_SLICES + 1).count() <= MAX_BROADCAST_SLICES else names, "slice", "left_semi")


def read(spark: SparkSession, path: str, version: int | None = None, converted: str | None = None) -> DataFrame:
    """The rows of the dataset as it was at ``version``."""
    log = _log(spark, path)
    return _of(rows(spark, path, converted, log), _live(spark, path, version, log)).drop("version", "slice")


def may_hold(spark: SparkSession, path: str, column: str, low, high, version: int | None = None) -> DataFrame:
    """Live slices that can hold a value of ``column`` from ``low`` to ``high``; those without statistics of it are among them."""
    log = _log(spark, path)
    kind = _merged(spark, path, converted=True, log=log)[column].dataType
    least, greatest = c("least")[column].cast(kind), c("greatest")[column].cast(kind)
    known = F.map_contains_key("least", column)  # a known range of nothing but nulls holds no value
    return _live(spark, path, version, log).where(~known | ((least <= F.lit(high)) & (greatest >= F.lit(low))))


def read_between(spark: SparkSession, path: str, column: str, low, high, version: int | None = None) -> DataFrame:
    """The rows with ``column`` from ``low`` to ``high``; files whose range doesn't touch it are not read."""
    found = _of(rows(spark, path), may_hold(spark, path, column, low, high, version))
    return found.where(c(column).between(low, high)).drop("version", "slice")


def version_at(spark: SparkSession, path: str, moment: datetime) -> int:
    """The last version committed up to a moment."""
    found = history(spark, path).where(c("committed") <= F.lit(moment)).agg(F.max("version")).first()[0]
    if found is None:
        raise ValueError(f"no version at {moment}")
    return found


def version_of_snapshot(spark: SparkSession, path: str, snapshot_id: int) -> int:
    return history(spark, path).where(c("snapshot_id") == snapshot_id).first()["version"]


def between(spark: SparkSession, path: str, start: int, end: int) -> DataFrame:
    """Rows appended after version ``start`` up to ``end``."""
    added = history(spark, path).where((c("version") > start) & (c("version") <= end) & (c("operation") == "append")).select("version")
    return rows(spark, path).join(F.broadcast(added), "version", "left_semi").drop("version", "slice")


def compact(spark: SparkSession, path: str, committed: datetime, condition: Column | None = None, partition_by: tuple[str, ...] = (),
            target_bytes: int = 512 << 20) -> int | None:
    """Rewrite small files that hold matching rows as files of about ``target_bytes``; all other files stay as they are.

    Files under three quarters of the target are taken, put side by side within their partition in the order of
    their size, and cut into bins of the target size; a bin of one file is left alone. Gives the new version, None if there is nothing to do.
    """
    live = kept(_live(spark, path).where((c("bytes") < 0.75 * target_bytes) & (c("records") > 0)).select("slice", "part", "bytes"), "small")
    found = rows(spark, path)
    if condition is not None:
        live = kept(live.join(_of(found, live).where(condition).select("slice").distinct(), "slice", "left_semi"), "touched")
    placed = running(live, ["part"], ["bytes", "slice"], "bytes", "_upto").withColumn("_bin", F.floor((c("_upto") - 1) / target_bytes))
    sizes = placed.groupBy("part", "_bin").agg(F.count("*").alias("_n")).where(c("_n") > 1)
    packed = kept(placed.join(sizes, ["part", "_bin"], "left_semi").select("slice", F.concat(c("_bin").cast("string"), F.lit("t"), F.hex(F.xxhash64("part"))).alias("_bin")), "bins")
    if packed.isEmpty():
        return None
    version = _next(spark, path)
    few = packed.limit(MAX_BROADCAST_SLICES + 1).count() <= MAX_BROADCAST_SLICES
    together = found.join(F.broadcast(packed) if few else packed, "slice").drop("slice", "version").repartition("_bin")
    # a bin is rows of one partition in one task, so it becomes one file
    _write_rows(together, path, version, F.concat(F.lit("b"), c("_bin")), partition_by, "_bin")
    return _replaced(spark, path, version, committed, packed, partition_by)


def _replaced(spark: SparkSession, path: str, version: int, committed: datetime, packed: DataFrame, partition_by: tuple[str, ...]) -> int:
    packed.select("slice").coalesce(1).write.mode("overwrite").parquet(f"{path}/slices/version={version}/kind=removed")
    return _publish(spark, path, version, "compact", committed, _merged(spark, path), partition_by)


def files(spark: SparkSession, path: str) -> DataFrame:
    """Live files (slices) with the version that added them, their partition, size and number of rows."""
    return _live(spark, path).select("slice", "version", "part", "bytes", "records")


def statistics(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Per live file the number of rows and the least and greatest value of each column, as kept with the commit."""
    schema = _merged(spark, path, converted=True)
    spread = [c(kind)[n].cast(schema[n].dataType).alias(f"{name}_{n}") for n in columns for kind, name in (("least", "min"), ("greatest", "max"))]
    return _live(spark, path).select("slice", "records", *spread)


def unreferenced(spark: SparkSession, path: str, older_than: datetime) -> DataFrame:
    """Versions none of whose rows are part of the state and that were committed before ``older_than``; deleting is the caller's choice."""
    old = history(spark, path).where(c("committed") < F.lit(older_than))
    return old.join(state(spark, path), "version", "left_anti").select("version", "operation", "records")
