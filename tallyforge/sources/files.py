"""File, table and database endpoints the jobs share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

c = F.col


def read_csv(spark: SparkSession, path: str, header: bool = True, sep: str = ",", schema: StructType | str | None = None,
             infer: bool = False) -> DataFrame:
    """CSV as text columns; an explicit schema wins over inference, which costs a second pass."""
    reader = spark.read.option("header", header).option("sep", sep)
    if schema is not None:
        reader = reader.schema(schema)
    elif infer:
        reader = reader.option("inferSchema", True)
    return reader.csv(path)


def read_whole_texts(spark: SparkSession, path: str, min_splits: int = 100, max_split_bytes: int = 128 << 20, max_files: int = 50_000) -> DataFrame:
    """One row (path, text) per file, for many small documents, in ``min_splits`` splits or more if there are as many files.

    The driver holds the listing of what a read opens. Where the folders of ``path`` have more than ``max_files`` files
    together, they are read one group of folders after the other, each with ``max_files`` files at most or one folder, and
    the texts stored, so that only the listing of one group is held at a time.
    """
    groups = _folder_groups(spark, path, max_files)
    if len(groups) < 2:
        return _whole_texts(spark, [path], min_splits, max_split_bytes)
    from ..session import scratch

    out = scratch(spark, "whole-texts")
    stored = [f"{out}/{i}" for i in range(len(groups))]
    for folders, target in zip(groups, stored):
        _whole_texts(spark, folders, min_splits, max_split_bytes).write.option("compression", "zstd").parquet(target)
    return spark.read.parquet(*stored)


def _folder_groups(spark: SparkSession, path: str, max_files: int) -> list[list[str]]:
    """The folders of ``path`` in groups of ``max_files`` files at most, a larger folder by itself; none if files lie beside
    folders or a folder holds folders. Files are listed one folder at a time."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    groups, held, folders = [], 0, []
    listed = fs.listStatusIterator(at) if fs.exists(at) else None
    while listed is not None and listed.hasNext():
        status = listed.next()
        if status.getPath().getName()[0] in "_.":
            continue
        if not status.isDirectory():
            return []
        folders.append(status.getPath())
    for folder in sorted(folders, key=lambda f: f.toString()):
        inside = fs.getContentSummary(folder)
        if inside.getDirectoryCount() > 1:
            return []
        if not groups or held + inside.getFileCount() > max_files:
            groups, held = [*groups, []], 0
        groups[-1].append(folder.toString())
        held += inside.getFileCount()
    return groups


def _whole_texts(spark: SparkSession, paths: list[str], min_splits: int, max_split_bytes: int) -> DataFrame:
    """The texts of one read.

    The reader packs files into splits of a size that follows from the listing (number and bytes of the files), so
    no text is shuffled for it. The size is a setting of a session, so the read has a session of its own with
    the other settings of ``spark``; an empty file counts as one byte.
    """
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.hive.filesourcePartitionFileCacheSize", 0)  # else the driver keeps listings that nothing reads again
    listed = own.read.format("binaryFile").load(paths).agg(F.count("*").alias("files"), F.coalesce(F.sum(F.greatest("length", F.lit(1))), F.lit(0)).alias("bytes")).first()
    each = max(1, listed.bytes // max(1, listed.files) // 16)  # the cost of opening a file: little beside its bytes
    size = max(1, (listed.bytes + each * listed.files) // max(1, min_splits))
    own.conf.set("spark.sql.files.maxPartitionBytes", min(size, max_split_bytes))
    own.conf.set("spark.sql.files.openCostInBytes", each)
    own.conf.set("spark.sql.files.minPartitionNum", min_splits)
    return own.read.text(paths, wholetext=True).select(c("_metadata.file_path").alias("path"), c("value").alias("text"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Log lines, plain or gzip, keyed by the folder (``app_key``) and file they come from.

    ``line_id`` grows with the line order of a file: the id counts up inside a split, and
    splits are ordered by where they start.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    return lines.select(
        F.element_at(F.split("_metadata.file_path", "/"), -2).alias("app_key"), c("_metadata.file_name").alias("file"),
        F.struct(c("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("n")).alias("line_id"), "value")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): lines of text files, counted from 1 through the files in the order of their paths.

    The text is not shuffled: a line's number is its place inside its split, plus the lines of all
    splits before it, which is one small row for each split.
    """
    lines = spark.read.text(path).select(c("_metadata.file_path").alias("_file"), c("_metadata.file_block_start").alias("_split"),
                                         F.monotonically_increasing_id().alias("_n"), "value")
    splits = lines.groupBy("_file", "_split").agg(F.min("_n").alias("_first"), F.count("*").alias("_lines"))
    before = Window.orderBy("_file", "_split").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("_file", "_split", "_first", F.coalesce(F.sum("_lines").over(before), F.lit(0)).alias("_start"))
    return lines.join(F.broadcast(starts), ["_file", "_split"]).select((c("_start") + c("_n") - c("_first") + 1).alias("line"), "value")


def write_checked(frame: DataFrame, path: str, mode: str = "errorifexists", partition_by: tuple[str, ...] = ()) -> int:
    """Write Parquet and count what can be read back."""
    writer = frame.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return frame.sparkSession.read.parquet(path).count()


def jdbc_options(url: str, user: str | None = None, password: str | None = None, driver: str | None = None, **more: str) -> dict[str, str]:
    options = {"url": url, "user": user, "password": password, "driver": driver, **more}
    return {k: str(v) for k, v in options.items() if v is not None}


def read_database(spark: SparkSession, table: str, options: dict[str, str], split_on: str | None = None,
                  bounds: tuple[int, int] | None = None, parts: int = 32) -> DataFrame:
    """Read a relational table; with a numeric key and its bounds the read runs in parallel."""
    reader = spark.read.format("jdbc").options(**options).option("dbtable", table)
    if split_on is not None and bounds is not None:
        reader = (reader.option("partitionColumn", split_on).option("lowerBound", bounds[0])
                  .option("upperBound", bounds[1]).option("numPartitions", parts))
    return reader.load()


def write_database(frame: DataFrame, table: str, options: dict[str, str], mode: str = "append", connections: int = 16) -> None:
    """Write to a relational table over a bounded number of connections."""
    frame.write.format("jdbc").options(**options).option("dbtable", table).option("numPartitions", connections).mode(mode).save()


def as_messages(frame: DataFrame, key) -> DataFrame:
    """Rows of a message sink: a text key and the whole row as JSON."""
    return frame.select(key.cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))


def work_database(spark: SparkSession) -> str:
    """A database whose tables live in the shared folder."""
    from ..session import scratch

    name = "tallyforge_work"
    if not spark.catalog.databaseExists(name):
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {name} LOCATION '{scratch(spark, 'database')}'")
    return name
