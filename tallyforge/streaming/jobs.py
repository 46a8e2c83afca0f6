"""Streaming jobs. Each takes a stream as a DataFrame, so the connector is the caller's."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.ordered import match

c = F.col
MESSAGE = "key string, value binary, timestamp timestamp"


def message_stream(spark: SparkSession, source: str, options: dict[str, str], schema: str | None = None) -> DataFrame:
    """A stream of (key, value, timestamp) from any connector, such as a message broker or files."""
    reader = spark.readStream.format(source).options(**options)
    return (reader.schema(schema) if schema else reader).load()


def parse_words(messages: DataFrame, fraction: bool = True) -> DataFrame:
    """``"<iso time> w1 w2"`` to one row (timestamp, word) per word; ``fraction=False`` keeps whole seconds.

    The text is cut at the first blank. A fixed width of 25 characters, as some producers
    assume, would leave the last digit of a longer time stamp as a word.
    """
    text = c("value").cast("string")
    stamp = F.try_to_timestamp(F.substring_index(text, " ", 1))
    line = messages.select((stamp if fraction else F.date_trunc("second", stamp)).alias("timestamp"),
                           F.regexp_replace(text, r"^\S*\s?", "").alias("words"))
    return line.select("timestamp", F.explode(F.split("words", " ")).alias("word")).where(c("word") != "")


def windowed_counts(words: DataFrame, window: str = "1 minute", watermark: str = "1 minute") -> DataFrame:
    """Tumbling event-time counts per word; rows later than the watermark are dropped."""
    counts = words.withWatermark("timestamp", watermark).groupBy("word", F.window("timestamp", window)).count()
    return counts.selectExpr("window.start AS START_TIME", "window.end AS END_TIME", "word AS WORD", "count AS COUNT")


def to_files(frame: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", every: str | None = None,
             partition_by: tuple[str, ...] = ()) -> StreamingQuery:
    """Append to files. Without ``every`` the query stops once all present input is read."""
    writer = frame.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint).option("path", path)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def to_batches(frame: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append",
               every: str | None = None) -> StreamingQuery:
    writer = frame.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


#: State stores by name. Fixed values.
STATE_STORES = {"hdfs": "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider",
                "rocksdb": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


@contextmanager
def state_settings(spark: SparkSession, provider: str | None = None, versions: int | None = None, partitions: int | None = None,
                   maintenance: str | None = None) -> Iterator[None]:
    """Settings that stateful queries started inside take over: state store, kept versions, state partitions, and how often old state is tidied up."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": STATE_STORES.get(provider), "spark.sql.streaming.minBatchesToRetain": versions,
              "spark.sql.shuffle.partitions": partitions, "spark.sql.streaming.stateStore.maintenanceInterval": maintenance}
    before = {k: spark.conf.get(k, None) for k, v in wanted.items() if v is not None}
    try:
        for k in before:
            spark.conf.set(k, str(wanted[k]))
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def state_of(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """The rows (key, value, partition_id) that a stateful query keeps, as of a batch (default: the last one)."""
    reader = spark.read.format("statestore")
    return (reader if batch is None else reader.option("batchId", batch)).load(checkpoint)


def state_layout(spark: SparkSession, checkpoint: str) -> DataFrame:
    """One row for each store: operatorName, numPartitions, and the first and last batch of the checkpoint's log.

    The log goes back as many batches as are retained before the last one; the store itself keeps the state of as many in all.
    """
    return spark.read.format("state-metadata").load(checkpoint)


def replace_with_latest(path: str) -> Callable[[DataFrame, int], None]:
    """Complete mode: batches write the whole result into two folders in turn, so one of them is whole at any time."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/turn={batch_id % 2}")

    return handle


def latest_result(spark: SparkSession, path: str) -> DataFrame:
    results = spark.read.parquet(path)
    return results.where(c("_batch") == results.agg(F.max("_batch")).scalar()).drop("_batch", "turn")


def stamped_copy(source: DataFrame) -> DataFrame:
    """A stateless copy with the load time added."""
    return source.withColumn("time_stamp", F.current_timestamp())


def fan_out(branches: list[tuple[bool, Callable[[DataFrame, int], None]]], score: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """Score a batch once and hand it to every branch that is switched on.

    Writes name their folder by batch number and overwrite it, so a batch that is run again
    after a failure leaves no second copy.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        scored = score(batch).persist()
        try:
            for enabled, branch in branches:
                if enabled:
                    branch(scored, batch_id)
        finally:
            scored.unpersist()

    return handle


def two_pass_scan(path: str, keys: list[str], suspect: Column, parse: Callable[[DataFrame], DataFrame], buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """Parse all lines of the keys that any line marks, as lines arrive; every line is parsed once at most.

    Batches hold the key columns, cut from the text without parsing it, and the line. The first pass keeps the lines, by
    batch and bucket of the key, and notes the keys that become suspect in this batch. The second pass parses the batch's own lines of
    all suspect keys, and from earlier batches only lines of the new ones, for which only their buckets are read. All that a batch
    writes is named by its number and read by later batches only, so a batch can be run again.
    """
    known = {"batch": "int", "bucket": "int"}

    def earlier(spark: SparkSession, name: str, schema: T.StructType, batch_id: int) -> DataFrame:
        for column, kind in known.items():
            schema = schema if column in schema.names else T.StructType([*schema, T.StructField(column, T.IntegerType())])
        try:
            return spark.read.schema(schema).parquet(f"{path}/{name}").where(c("batch") < batch_id)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], schema)

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        lines = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        lines.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/lines/batch={batch_id}")
        own = spark.read.schema(lines.schema).parquet(f"{path}/lines/batch={batch_id}")
        old = earlier(spark, "keys", own.select(*keys, "bucket").schema, batch_id)
        marked = own.where(suspect).select(*keys, "bucket").distinct()
        match(marked, old.select(*keys), keys, "left_anti").write.mode("overwrite").parquet(f"{path}/keys/batch={batch_id}")
        new = spark.read.schema(marked.schema).parquet(f"{path}/keys/batch={batch_id}")
        wanted = match(own, old.select(*keys, "bucket").unionByName(new).select(*keys), keys, "left_semi")
        of_new = [r.bucket for r in new.select("bucket").distinct().collect()]  # as many as there are buckets, at most
        if of_new:
            before = earlier(spark, "lines", lines.schema, batch_id).where(c("bucket").isin(of_new))
            wanted = wanted.unionByName(match(before, new.select(*keys), keys, "left_semi").drop("batch"))
        parse(wanted.drop("bucket")).write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")

    return handle


def scanned(spark: SparkSession, path: str) -> DataFrame:
    """The rows that ``two_pass_scan`` has parsed so far."""
    return spark.read.parquet(f"{path}/rows").drop("batch")


def batch_folder(path: str, *partition_by: str, keep=None) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch if keep is None else batch.where(keep)
        writer = kept.write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path}/batch={batch_id}")

    return write
