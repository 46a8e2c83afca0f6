"""Session helpers: one place for session settings and for the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


def local_session(name: str = "tallyforge", cores: str = "8", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local master, where all tasks share the driver's disk, may leave it unset (tests do).
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    checkpoint = spark.sparkContext.getCheckpointDir()
    if checkpoint:
        return checkpoint.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="tallyforge-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def work_dir(spark: SparkSession) -> str:
    """The folder of all intermediate tables of this application, below the shared folder."""
    return os.path.join(shared_dir(spark), f"work-{spark.sparkContext.applicationId}")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the application's folder; nothing is ever written to it twice."""
    return os.path.join(work_dir(spark), f"{label}-{uuid.uuid4().hex}")


def remove_work(spark: SparkSession) -> bool:
    """Delete all intermediate tables of this application, once no result that reads them is needed any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(work_dir(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def kept(frame, label: str = "kept", **options: str):
    """The same rows as a table in the shared folder: computed once, safe when executors are lost."""
    path = scratch(frame.sparkSession, label)
    frame.write.options(**options).parquet(path)
    return frame.sparkSession.read.parquet(path)


@contextmanager
def open_writers(spark: SparkSession, files: int = 64):
    """Partitioned writes inside the block keep up to ``files`` files open in a task, so that long rows are not sorted, and
    spilled, by partition first; a task with more partitions sorts the rest of its rows as usual."""
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    spark.conf.set(key, files)
    try:
        yield
    finally:
        spark.conf.set(key, before)
