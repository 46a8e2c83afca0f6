"""Streaming jobs run over all rows of a table until the input is used up, then read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.projection import level_of
from ..registry import on_tables
from ..session import scratch
from ..sources.files import as_messages
from . import jobs

c = F.col


def _new(t, label: str) -> str:
    return scratch(t.spark, label)


def _messages(t) -> DataFrame:
    """Events as messages "<iso time> <type> user<n>", written as files and opened as a stream."""
    path = _new(t, "messages")
    text = F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), "event_type", F.concat(F.lit("user"), c("user_id").cast("string")))
    t.events.select(c("event_id").cast("string").alias("key"), text.cast("binary").alias("value"), c("ts").cast("timestamp").alias("timestamp")).write.parquet(path)
    return jobs.message_stream(t.spark, "parquet", {"path": path}, jobs.MESSAGE)


_WORDS_SQL = "(SELECT ts, event_type AS word FROM events UNION ALL SELECT ts, 'user' || user_id FROM events)"
_STAMP = "'%Y-%m-%d %H:%M:%S'"


def _text_times(frame: DataFrame) -> DataFrame:
    return frame.select(F.date_format("START_TIME", "yyyy-MM-dd HH:mm:ss").alias("START_TIME"),
                        F.date_format("END_TIME", "yyyy-MM-dd HH:mm:ss").alias("END_TIME"), "WORD", "COUNT")


@on_tables("stm_01_parse_messages", f"SELECT epoch_us(ts) AS micros, word FROM {_WORDS_SQL}")
def parse_messages(t):
    path = _new(t, "words")
    jobs.to_files(jobs.parse_words(_messages(t)), path, _new(t, "state")).awaitTermination()
    return t.spark.read.parquet(path).select(F.unix_micros("timestamp").alias("micros"), "word")


@on_tables("stm_04_window_counts_append", f"""SELECT strftime(date_trunc('hour', ts), {_STAMP}) AS START_TIME, strftime(date_trunc('hour', ts) + INTERVAL 1 HOUR, {_STAMP}) AS END_TIME,
    word AS WORD, count(*) AS COUNT FROM {_WORDS_SQL}
    WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 MINUTE GROUP BY ALL""")
def window_counts_append(t):
    """Append mode gives the windows that end at or before the final watermark."""
    path = _new(t, "counts")
    counts = jobs.windowed_counts(jobs.parse_words(_messages(t)), "1 hour", "1 minute")
    jobs.to_files(counts, path, _new(t, "state")).awaitTermination()
    return _text_times(t.spark.read.parquet(path))


@on_tables("stm_06_window_counts_complete", f"""SELECT strftime(date_trunc('minute', ts), {_STAMP}) AS START_TIME, strftime(date_trunc('minute', ts) + INTERVAL 1 MINUTE, {_STAMP}) AS END_TIME,
    word AS WORD, count(*) AS COUNT FROM {_WORDS_SQL} GROUP BY ALL""")
def window_counts_complete(t):
    path = _new(t, "counts")
    counts = jobs.windowed_counts(jobs.parse_words(_messages(t)))
    jobs.to_batches(counts, jobs.replace_with_latest(path), _new(t, "state"), mode="complete").awaitTermination()
    return _text_times(jobs.latest_result(t.spark, path))


@on_tables("job_11_word_count_csv", f"""SELECT strftime(date_trunc('minute', ts), {_STAMP}) AS START_TIME, strftime(date_trunc('minute', ts) + INTERVAL 1 MINUTE, {_STAMP}) AS END_TIME,
    word AS WORD, count(*) AS COUNT FROM {_WORDS_SQL}
    WHERE date_trunc('minute', ts) + INTERVAL 1 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 MINUTE GROUP BY ALL""")
def word_count_csv(t):
    """The whole job: messages, words, minute windows, appended CSV files (SNK-11)."""
    path = _new(t, "counts")
    counts = jobs.windowed_counts(jobs.parse_words(_messages(t)))
    jobs.to_files(counts, path, _new(t, "state"), fmt="csv").awaitTermination()
    schema = "START_TIME timestamp, END_TIME timestamp, WORD string, COUNT long"
    return _text_times(t.spark.read.schema(schema).csv(path))


@on_tables("src_13_message_stream", "SELECT event_id::VARCHAR AS key, event_type FROM events")
def read_messages(t):
    path = _new(t, "copied")
    stream = _messages(t).select("key", F.element_at(F.split(c("value").cast("string"), " "), 2).alias("event_type"))
    jobs.to_files(stream, path, _new(t, "state")).awaitTermination()
    return t.spark.read.parquet(path)


@on_tables("src_14_dataset_as_stream", "SELECT o_orderkey, o_orderstatus FROM orders")
def dataset_as_stream(t):
    """Two appended versions of a dataset, each read once by the stream."""
    path, out, state = _new(t, "dataset"), _new(t, "copied"), _new(t, "state")
    rows = t.orders.select("o_orderkey", "o_orderstatus")
    for half in (0, 1):
        rows.where(c("o_orderkey") % 2 == half).write.mode("append").parquet(path)
        jobs.to_files(t.spark.readStream.schema(rows.schema).parquet(path), out, state).awaitTermination()
    return t.spark.read.parquet(out)


@on_tables("stm_11_partitioned_copy", "SELECT event_id, event_type, true AS stamped FROM events")
def partitioned_copy(t):
    """Stateless copy with a time stamp into a partitioned table (SNK-13)."""
    source, out = _new(t, "events"), _new(t, "copied")
    rows = t.events.select("event_id", "event_type")
    rows.write.parquet(source)
    stream = jobs.stamped_copy(t.spark.readStream.schema(rows.schema).parquet(source))
    jobs.to_files(stream, out, _new(t, "state"), partition_by=("event_type",)).awaitTermination()
    return t.spark.read.parquet(out).select("event_id", "event_type", c("time_stamp").isNotNull().alias("stamped"))


@on_tables("stm_12_repeated_append", "SELECT event_type, 3 * count(*) AS n FROM events GROUP BY 1")
def repeated_append(t):
    """The same load three times: every run appends, and the stream state reads each file once."""
    source, out, state = _new(t, "events"), _new(t, "copied"), _new(t, "state")
    rows = t.events.select("event_id", "event_type")
    for _ in range(3):
        rows.write.mode("append").parquet(source)
        jobs.to_files(t.spark.readStream.schema(rows.schema).parquet(source), out, state).awaitTermination()
    return t.spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"))


@on_tables("snk_14_fan_out", """SELECT 'alerts' AS sink, CASE WHEN value BETWEEN 10 AND 30 THEN 'RED' END AS level, count(*) AS n FROM events WHERE value BETWEEN 10 AND 30 GROUP BY ALL
    UNION ALL SELECT 'alerts', 'YELLOW', count(*) FROM events WHERE value BETWEEN 30 AND 60
    UNION ALL SELECT 'messages', 'GREEN', count(*) FROM events WHERE value > 60
    UNION ALL SELECT 'table', 'all', count(*) FROM events WHERE user_id <= 20""")
def fanned_out(t):
    """One scored batch to three sinks by switch; a fourth one is off."""
    source, base = _new(t, "events"), _new(t, "sinks")
    rows = t.events.select("event_id", "user_id", "value")
    rows.write.parquet(source)
    leveled = lambda batch, *names: batch.select("event_id", F.explode(F.array_compact(F.array(*[
        F.when(level_of(c("value"))[n], F.lit(n)) for n in names]))).alias("level"))

    def alerts(batch, batch_id):
        jobs.batch_folder(f"{base}/alerts")(leveled(batch, "RED", "YELLOW"), batch_id)

    def messages(batch, batch_id):
        jobs.batch_folder(f"{base}/messages")(as_messages(leveled(batch, "GREEN"), F.lit(batch_id)), batch_id)

    handle = jobs.fan_out([(True, alerts), (True, messages), (True, jobs.batch_folder(f"{base}/table", keep=c("user_id") <= 20)),
                           (False, jobs.batch_folder(f"{base}/never"))], score=lambda batch: batch)
    jobs.to_batches(t.spark.readStream.schema(rows.schema).parquet(source), handle, _new(t, "state")).awaitTermination()
    read = lambda name: t.spark.read.parquet(f"{base}/{name}")
    tagged = lambda frame, sink, level: frame.select(F.lit(sink).alias("sink"), level.alias("level"))
    both = (tagged(read("alerts"), "alerts", c("level")).unionByName(tagged(read("table"), "table", F.lit("all")))
            .unionByName(tagged(read("messages"), "messages", F.get_json_object("value", "$.level"))))
    return both.groupBy("sink", "level").agg(F.count("*").alias("n"))


@on_tables("stm_13_incremental_scan", "SELECT event_type, count(*) AS lines FROM events WHERE value > 90 GROUP BY 1")
def incremental_scan(t):
    """Log lines scanned as they arrive: a substring test first, JSON is parsed only for hits."""
    source, out = _new(t, "lines"), _new(t, "hits")
    marked = F.when(c("value") > 90, F.lit("HIGH")).otherwise(F.lit("low"))
    t.events.select(F.to_json(F.struct("event_type", marked.alias("mark"))).alias("value")).write.text(source)
    schema = T.StructType([T.StructField("event_type", T.StringType()), T.StructField("mark", T.StringType())])

    def scan(batch, batch_id):
        hits = batch.where(c("value").contains("HIGH")).select(F.from_json("value", schema).alias("e")).select("e.event_type")
        jobs.batch_folder(out)(hits.groupBy("event_type").agg(F.count("*").alias("lines")), batch_id)

    jobs.to_batches(t.spark.readStream.text(source), scan, _new(t, "state")).awaitTermination()
    return t.spark.read.parquet(out).groupBy("event_type").agg(F.sum("lines").alias("lines"))


@on_tables("stm_13_two_pass_arrivals", """WITH marked AS (SELECT user_id FROM events GROUP BY 1 HAVING max(value) > 98)
    SELECT user_id, count(*) AS lines, sum((value * 100)::BIGINT)::BIGINT AS cents, 1::BIGINT AS most_parsed FROM events WHERE user_id IN (FROM marked) GROUP BY 1""")
def two_pass_arrivals(t):
    """Log lines of all users with a line marked HIGH. A running query polls for new files; the lines arrive in three parts,
    and a user's mark may come after most of the user's lines."""
    source, out = _new(t, "lines"), _new(t, "two-pass")
    mark = F.when(c("value") > 98, F.lit("HIGH")).otherwise(F.lit("low"))
    text = F.to_json(F.struct("event_id", "user_id", F.round(c("value") * 100).cast("long").alias("cents"), mark.alias("mark"))).alias("value")
    part = lambda k: t.events.where(c("event_id") % 3 == k).select(text).write.mode("append").text(source)
    part(0)
    cut = F.regexp_extract("value", '"user_id":([0-9]+)', 1).cast("long").alias("user_id")
    stream = t.spark.readStream.option("maxFilesPerTrigger", 2).text(source).select(cut, "value")
    fields = F.from_json("value", "event_id long, cents long")
    handle = jobs.two_pass_scan(out, ["user_id"], c("value").contains('"mark":"HIGH"'), lambda lines: lines.select("user_id", fields.alias("e")).select("user_id", "e.*"))
    running = jobs.to_batches(stream, handle, _new(t, "state"), every="1 second")
    try:
        running.processAllAvailable()
        for k in (1, 2):
            part(k)
            running.processAllAvailable()
    finally:
        running.stop()
    parsed = jobs.scanned(t.spark, out).groupBy("user_id", "event_id").agg(F.count("*").alias("times"), F.max("cents").alias("cents"))
    return parsed.groupBy("user_id").agg(F.count("*").alias("lines"), F.sum("cents").alias("cents"), F.max("times").alias("most_parsed"))


@on_tables("stm_02_parse_whole_seconds", f"SELECT epoch(date_trunc('second', ts))::BIGINT AS seconds, word, count(*) AS n FROM {_WORDS_SQL} GROUP BY ALL")
def parse_whole_seconds(t):
    path = _new(t, "words")
    jobs.to_files(jobs.parse_words(_messages(t), fraction=False), path, _new(t, "state")).awaitTermination()
    return t.spark.read.parquet(path).groupBy(F.unix_timestamp("timestamp").alias("seconds"), "word").agg(F.count("*").alias("n"))


@on_tables("stm_05_late_rows_dropped", """WITH e AS (SELECT *, (SELECT max(ts) FROM events) - INTERVAL 1 MINUTE AS mark FROM events WHERE day(ts) > 15)
    SELECT event_type, count(*) AS n FROM e WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= mark GROUP BY 1""")
def late_rows_dropped(t):
    """Watermark of one minute (STM-03): the first half of the month comes after the second and is too late.
    The state of the first run carries over to the second one through the checkpoint (STM-08)."""
    source, path, state = _new(t, "events"), _new(t, "counts"), _new(t, "state")
    rows = t.events.select(c("ts").cast("timestamp").alias("timestamp"), c("event_type").alias("word"))
    for late in (False, True):
        day = F.dayofmonth("timestamp")
        rows.where(day <= 15 if late else day > 15).write.mode("append").parquet(source)
        stream = t.spark.readStream.schema(rows.schema).parquet(source)
        jobs.to_files(jobs.windowed_counts(stream, "1 hour", "1 minute"), path, state).awaitTermination()
    return t.spark.read.parquet(path).groupBy(c("WORD").alias("event_type")).agg(F.sum("COUNT").alias("n"))


@on_tables("snk_11_streaming_csv", "SELECT o_orderkey, o_orderpriority FROM orders")
def streaming_csv(t):
    source, path = _new(t, "orders"), _new(t, "csv")
    rows = t.orders.select("o_orderkey", "o_orderpriority")
    rows.write.parquet(source)
    jobs.to_files(t.spark.readStream.schema(rows.schema).parquet(source), path, _new(t, "state"), fmt="csv").awaitTermination()
    return t.spark.read.schema(rows.schema).csv(path)


@on_tables("snk_12_complete_mode", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def complete_mode(t):
    source, path = _new(t, "orders"), _new(t, "counts")
    rows = t.orders.select("o_orderkey", "o_orderpriority")
    rows.write.parquet(source)
    counts = t.spark.readStream.schema(rows.schema).parquet(source).groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    jobs.to_batches(counts, jobs.replace_with_latest(path), _new(t, "state"), mode="complete").awaitTermination()
    return jobs.latest_result(t.spark, path)


@on_tables("snk_13_streaming_partitions", "SELECT l_orderkey, l_partkey, l_linenumber, l_returnflag FROM lineitem")
def streaming_partitions(t):
    source, path = _new(t, "lines"), _new(t, "lines")
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")
    rows.write.parquet(source)
    jobs.to_files(t.spark.readStream.schema(rows.schema).parquet(source), path, _new(t, "state"), partition_by=("l_returnflag",)).awaitTermination()
    return t.spark.read.parquet(path)


@on_tables("stm_07_timed_trigger", "SELECT event_id, event_type FROM events")
def timed_trigger(t):
    """A query that looks for new input every second; stopped once all present input is processed."""
    source, path = _new(t, "events"), _new(t, "copies")
    rows = t.events.select("event_id", "event_type")
    rows.write.parquet(source)
    running = jobs.to_files(t.spark.readStream.schema(rows.schema).parquet(source), path, _new(t, "state"), every="1 second")
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    return t.spark.read.parquet(path)


@on_tables("stm_09_state_settings", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def state_settings(t):
    """Running counts with the state kept in RocksDB and few old versions of it; settings hold for this query only."""
    source, path = _new(t, "events"), _new(t, "counts")
    rows = t.events.select("event_id", "event_type")
    rows.write.parquet(source)
    with jobs.state_settings(t.spark, provider="rocksdb", versions=5):
        counts = t.spark.readStream.schema(rows.schema).parquet(source).groupBy("event_type").agg(F.count("*").alias("n"))
        jobs.to_batches(counts, jobs.replace_with_latest(path), _new(t, "state"), mode="complete").awaitTermination()
    return jobs.latest_result(t.spark, path)


@on_tables("stm_09_state_read_back", """SELECT event_type, count(*) AS n, 1::BIGINT AS partitions, 5::BIGINT AS batches_back, true AS oldest_is_smaller FROM events GROUP BY 1""")
def state_read_back(t):
    """Running counts read from the state store itself, of a query with one state partition that keeps the state of five batches."""
    source, state, versions = _new(t, "events"), _new(t, "state"), 5
    rows = t.events.select("event_id", "event_type")
    rows.repartitionByRange(9, "event_id").write.parquet(source)
    with jobs.state_settings(t.spark, provider="rocksdb", versions=versions, partitions=1, maintenance="5s"):
        stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
        jobs.to_batches(stream.groupBy("event_type").agg(F.count("*").alias("n")), jobs.replace_with_latest(_new(t, "counts")), state, mode="complete").awaitTermination()
    layout = jobs.state_layout(t.spark, state).first()  # one row: the query has one store
    total = lambda batch: jobs.state_of(t.spark, state, batch).agg(F.sum("value.count")).first()[0]
    counts = jobs.state_of(t.spark, state).select("key.event_type", c("value.count").alias("n"))
    return counts.select("event_type", "n", F.lit(layout.numPartitions).cast("long").alias("partitions"), F.lit(layout.maxBatchId - layout.minBatchId).cast("long").alias("batches_back"),
                         F.lit(total(layout.maxBatchId - versions + 1) < total(layout.maxBatchId)).alias("oldest_is_smaller"))


@on_tables("udf_05_batch_function", "SELECT event_type, sum((value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY 1")
def batch_function(t):
    """A function per micro-batch: each batch adds its sums, the sums are added at the end."""
    source, path = _new(t, "events"), _new(t, "sums")
    rows = t.events.select("event_type", F.round(c("value") * 100).cast("long").alias("cents"))
    rows.write.parquet(source)

    def add(batch, batch_id):
        jobs.batch_folder(path)(batch.groupBy("event_type").agg(F.sum("cents").alias("cents")), batch_id)

    jobs.to_batches(t.spark.readStream.schema(rows.schema).parquet(source), add, _new(t, "state")).awaitTermination()
    return t.spark.read.parquet(path).groupBy("event_type").agg(F.sum("cents").alias("cents"))
