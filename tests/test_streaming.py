"""Streaming semantics a SQL statement cannot state."""

from datetime import datetime

from pyspark.sql import functions as F

from tallyforge.session import scratch
from tallyforge.streaming import jobs

c = F.col


def _write(spark, path, lines):
    rows = [("k", bytearray(text, "utf-8"), datetime(2024, 1, 1)) for text in lines]
    spark.createDataFrame(rows, jobs.MESSAGE).coalesce(1).write.mode("append").parquet(path)


def _run(spark, source, out, state):
    stream = jobs.message_stream(spark, "parquet", {"path": source}, jobs.MESSAGE)
    jobs.to_files(jobs.windowed_counts(jobs.parse_words(stream)), out, state).awaitTermination()
    return {(r.START_TIME.strftime("%H:%M"), r.WORD): r.COUNT for r in spark.read.parquet(out).collect()}


def test_late_rows_are_dropped_and_windows_close_once(spark):
    source, out, state = (scratch(spark, n) for n in ("messages", "out", "state"))
    _write(spark, source, ["2024-01-01T10:00:05.000000 a b", "2024-01-01T10:05:00.000000 c"])
    first = _run(spark, source, out, state)
    assert first == {("10:00", "a"): 1, ("10:00", "b"): 1}
    _write(spark, source, ["2024-01-01T10:00:30.000000 a", "2024-01-01T10:09:00.000000 d"])  # the first one is late now
    assert _run(spark, source, out, state) == {**first, ("10:05", "c"): 1}


def test_words_are_cut_at_the_first_blank_and_bad_times_give_null(spark):
    frame = spark.createDataFrame([(bytearray(b"2024-01-01T10:00:05.123456 one two  three"),), (bytearray(b"never x"),)], "value binary")
    got = [(r.timestamp, r.word) for r in jobs.parse_words(frame).collect()]
    assert [w for _, w in got] == ["one", "two", "three", "x"]
    assert got[0][0] == datetime(2024, 1, 1, 10, 0, 5, 123456) and got[3][0] is None


def test_a_batch_run_again_leaves_no_second_copy(spark):
    base = scratch(spark, "sink")
    rows = spark.range(10)
    handle = jobs.fan_out([(True, jobs.batch_folder(f"{base}/on")), (False, jobs.batch_folder(f"{base}/off"))], score=lambda b: b)
    handle(rows, 3)
    handle(rows, 3)
    assert spark.read.parquet(f"{base}/on").count() == 10
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/off")
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def test_scores_come_from_one_persisted_frame(spark):
    seen = []

    def score(batch):
        seen.append(1)
        return batch.withColumn("s", F.lit(1))

    jobs.fan_out([(True, lambda b, i: b.count()), (True, lambda b, i: b.count())], score)(spark.range(3), 0)
    assert seen == [1]


def test_two_pass_scan_parses_each_line_once(spark):
    """A key becomes suspect in the second arrival: its earlier line is parsed then, its later ones as they come; a batch run again changes nothing."""
    source, out, state = (scratch(spark, n) for n in ("lines", "two-pass", "state"))
    handle = jobs.two_pass_scan(out, ["k"], c("value").contains("BAD"), lambda lines: lines.selectExpr("k", "split(value, ' ')[1] AS id"))
    stream = lambda: spark.readStream.text(source).selectExpr("split(value, ' ')[0] AS k", "value")

    def arrive(*lines):
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(source)
        jobs.to_batches(stream(), handle, state).awaitTermination()
        return sorted(r.id for r in jobs.scanned(spark, out).collect())

    assert arrive("a 1 ok", "b 2 ok", "c 3 BAD", "c 4 ok", " 9 ok") == ["3", "4"]
    assert arrive("a 5 BAD", "c 6 ok", "b 7 ok") == ["1", "3", "4", "5", "6"]
    assert arrive("a 8 BAD", "b 10 ok") == ["1", "3", "4", "5", "6", "8"]
    again = spark.createDataFrame([("a", "a 5 BAD"), ("c", "c 6 ok"), ("b", "b 7 ok")], "k string, value string")
    handle(again, 1)
    assert sorted(r.id for r in jobs.scanned(spark, out).collect()) == ["1", "3", "4", "5", "6", "8"]


def test_state_can_be_read_back(spark):
    source, state = scratch(spark, "rows"), scratch(spark, "state")
    spark.range(40).selectExpr("id", "id % 4 AS k").repartitionByRange(8, "id").write.parquet(source)
    with jobs.state_settings(spark, provider="rocksdb", versions=2, partitions=1, maintenance="1s"):
        stream = spark.readStream.schema("id long, k long").option("maxFilesPerTrigger", 1).parquet(source)
        jobs.to_batches(stream.groupBy("k").agg(F.count("*").alias("n")), jobs.replace_with_latest(scratch(spark, "out")), state, mode="complete").awaitTermination()
    layout = jobs.state_layout(spark, state).first()
    assert (layout.numPartitions, layout.maxBatchId - layout.minBatchId) == (1, 2)
    assert {r.key.k: r.value["count"] for r in jobs.state_of(spark, state).collect()} == dict.fromkeys(range(4), 10)
    assert sum(r.value["count"] for r in jobs.state_of(spark, state, layout.maxBatchId - 1).collect()) == 35
    assert spark.conf.get("spark.sql.shuffle.partitions") == "8"
