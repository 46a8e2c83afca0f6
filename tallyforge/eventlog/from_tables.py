"""Event lines derived from the given tables, so that diagnosis runs on data that grows with them.

Each line item is a task of stage ``part % 80`` of application ``supplier % 4``; one more file of app-1 is cut off in its first line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.mart import _fingerprint
from ..session import open_writers, scratch, shared_dir
from ..sources.files import read_lines
from .events import SQL_END, SQL_START, EventLog

c = F.col
T0 = 1_700_000_000_000
FILE_LINES = 50_000  # gzip files can't be split, so a task that reads some of them gets a bounded number of lines
_LOGS: dict[tuple[int, str], EventLog] = {}


def _event(name: str, **fields):
    """JSON text that starts with the event name, fields in the given order."""
    columns = [F.lit(name).alias("Event")] + [v.alias(k.replace("_", " ")) for k, v in fields.items()]
    return F.to_json(F.struct(*columns))


def tasks(lineitem: DataFrame) -> DataFrame:
    stage, qty, hot = c("l_partkey") % 80, c("l_quantity").cast("long"), F.when(c("l_partkey") % 100 == 0, 50).otherwise(1)
    rows = lineitem.select(
        F.concat(F.lit("app-"), (c("l_suppkey") % 4).cast("string")).alias("app"), stage.alias("stage"), "l_linenumber", "l_returnflag", "l_linestatus", qty.alias("qty"),
        F.when((stage == 7) & (c("l_linenumber") >= 6), 1).otherwise(0).alias("attempt"), (c("l_orderkey") * 8 + c("l_linenumber")).alias("task"),
        (F.lit(T0) + c("l_orderkey") * 10).alias("launch"), (qty * 1000 * hot).alias("run"), (qty * 1_000_000 * hot).alias("input"))
    return rows


def _task_lines(t) -> DataFrame:
    rows = tasks(t.lineitem)
    s, run, qty, n = c("stage"), c("run"), c("qty"), c("l_linenumber")
    start = _event("SparkListenerTaskStart", Stage_ID=s, Stage_Attempt_ID=c("attempt"), Task_Info=F.struct(
        c("task").alias("Task ID"), c("launch").alias("Launch Time"), (c("task") % 10).cast("string").alias("Executor ID"), F.lit("host").alias("Host")))
    reason = lambda kind, **more: F.struct(F.lit(kind).alias("Reason"), *[F.lit(more.get(k)).alias(k.replace("_", " ")) for k in ("Class_Name", "Description", "Message", "Full_Stack_Trace", "Loss_Reason")])
    ended = (F.when((s == 5) & (n == 1) & (c("l_returnflag") == "R"), reason("FetchFailed", Message="FetchFailedException: missing an output location for shuffle 3"))
             .when(((s == 11) | (s >= 20)) & (n == 2) & (c("l_returnflag") == "A"),
                   reason("ExceptionFailure", Class_Name="org.apache.spark.SparkException", Description="task failed", Full_Stack_Trace="Caused by: java.lang.OutOfMemoryError: Java heap space"))
             .when((s == 12) & (n == 5) & (c("l_returnflag") == "R"), reason("ExecutorLostFailure", Loss_Reason="Container killed by YARN for exceeding memory limits"))
             .when((s == 9) & (n == 3), reason("TaskCommitDenied")).otherwise(reason("Success")))
    total = F.when(c("l_linestatus") == "O", qty * 2_000_000)
    part = lambda factor: F.when(c("l_linestatus") != "O", qty * factor)
    metrics = F.struct(
        run.alias("Executor Run Time"), F.floor(F.when(s == 13, run * 3 / 10).otherwise(run / 50)).alias("JVM GC Time"), F.when(s == 15, qty * 10_000_000).otherwise(0).alias("Memory Bytes Spilled"),
        F.when(s == 15, qty * 5_000_000).otherwise(0).alias("Disk Bytes Spilled"), (qty * 1_000_000).alias("Peak Execution Memory"), F.struct(c("input").alias("Bytes Read")).alias("Input Metrics"),
        F.struct(total.alias("Total Bytes Read"), part(1_000_000).alias("Remote Bytes Read"), part(500_000).alias("Local Bytes Read"), part(100_000).alias("Remote Bytes Read To Disk"),
                 F.floor(F.when(s == 17, run / 3).otherwise(0)).alias("Fetch Wait Time")).alias("Shuffle Read Metrics"),
        F.struct((qty * 300_000).alias("Shuffle Bytes Written")).alias("Shuffle Write Metrics"))
    end = _event("SparkListenerTaskEnd", Stage_ID=s, Stage_Attempt_ID=c("attempt"), Task_End_Reason=ended, Task_Metrics=metrics)
    both = F.when((s == 3) & (n == 4), F.array(start)).otherwise(F.array(start, end))
    return rows.select("app", F.explode(both).alias("value"))


def _other_lines(t) -> DataFrame:
    rows = tasks(t.lineitem)
    info = lambda done, failed: F.struct(
        c("stage").alias("Stage ID"), c("attempt").alias("Stage Attempt ID"), F.concat(F.lit("stage "), c("stage").cast("string")).alias("Stage Name"), c("n").alias("Number of Tasks"),
        c("first").alias("Submission Time"), done.alias("Completion Time"), failed.alias("Failure Reason"))
    per_stage = rows.groupBy("app", "stage", "attempt").agg(F.count("*").alias("n"), F.min("launch").alias("first"), F.max("launch").alias("last"))
    nothing = F.lit(None).cast("string")
    submitted = _event("SparkListenerStageSubmitted", Stage_Info=info(nothing, nothing))
    completed = _event("SparkListenerStageCompleted", Stage_Info=info(c("last") + 60000, F.when(c("stage") == 5, F.lit("FetchFailedException: connection lost"))))
    stage_lines = per_stage.select("app", F.explode(F.when(c("stage") == 3, F.array(submitted)).otherwise(F.array(submitted, completed))).alias("value"))

    apps = rows.select("app").distinct()
    app_lines = apps.select("app", F.explode(F.array_compact(F.array(
        F.lit('{"Event":"SparkListenerLogStart","Spark Version":"4.1.2"}'),
        _event("SparkListenerApplicationStart", App_Name=F.concat(F.lit("name of "), c("app")), App_ID=F.concat(F.lit("id-"), c("app")), User=F.lit("analyst"), Timestamp=F.lit(T0)),
        F.lit('{"Event":"SparkListenerEnvironmentUpdate","Environment Details":{"Spark Properties":[["spark.executor.cores","4"],["spark.app.name","x"],["other.key","y"]]}}'),
        F.when(c("app") != "app-3", _event("SparkListenerApplicationEnd", Timestamp=F.lit(T0 + 7_200_000)))))).alias("value"))

    job = c("job")
    pairs = [("spark.sql.execution.id", F.floor(job / 2).cast("string")), ("spark.jobGroup.id", F.concat(F.lit("group-"), job.cast("string")))]
    starts = {"Job_ID": job, "Submission_Time": F.lit(T0) + job * 1000, "Stage_IDs": F.sequence(job * 4, job * 4 + 3)}
    as_map = _event("SparkListenerJobStart", **starts, Properties=F.struct(*[v.alias(k) for k, v in pairs]))
    as_list = _event("SparkListenerJobStart", **starts, Properties=F.array(*[F.array(F.lit(k), v) for k, v in pairs]))
    failed = F.struct(F.when(job == 1, "JobFailed").otherwise("JobSucceeded").alias("Result"), F.when(job == 1, F.lit("Job aborted")).alias("Exception"))
    ended = _event("SparkListenerJobEnd", Job_ID=job, Completion_Time=F.lit(T0 + 500_000) + job, Job_Result=failed)
    with_jobs = apps.select("app", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("job"))
    job_lines = with_jobs.select("app", F.explode(F.array_compact(F.array(
        F.when(job % 2 == 0, as_map).otherwise(as_list), F.when(~((job == 4) & (c("app") == "app-3")), ended)))).alias("value"))

    q = c("q")
    with_sql = apps.select("app", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("q"))
    sql_lines = with_sql.select("app", F.explode(F.array_compact(F.array(
        F.when(~((q == 1) & (c("app") == "app-2")), _event(SQL_START, executionId=q, description=F.concat(F.lit("query "), q.cast("string")), details=F.lit("at job"), physicalPlanDescription=F.when(q == 1, F.lit("Scan after OutOfMemoryError")), time=F.lit(T0 - 500) + q * 2000)),
        F.when(q != 2, _event(SQL_END, executionId=q, time=F.lit(T0 + 600_000) + q, errorMessage=F.when(q == 0, F.lit("Executor 7 lost")))))))
        .alias("value"))

    app = F.concat(F.lit("app-"), (c("s_suppkey") % 4).cast("string"))
    gone = F.when(c("s_suppkey") % 20 == 0, "Container killed by YARN for exceeding memory limits").otherwise("idle")
    executor_lines = t.supplier.select(app.alias("app"), F.explode(F.array_compact(F.array(
        _event("SparkListenerExecutorAdded", Timestamp=F.lit(T0) + c("s_suppkey"), Executor_ID=c("s_suppkey").cast("string"), Executor_Info=F.struct(c("s_name").alias("Host"))),
        F.when(c("s_suppkey") % 10 == 0, _event("SparkListenerExecutorRemoved", Timestamp=F.lit(T0 + 1000) + c("s_suppkey"), Executor_ID=c("s_suppkey").cast("string"), Removed_Reason=gone)))))
        .alias("value"))
    cut_off = t.region.where(c("r_regionkey") == 1).select(F.lit("app-1").alias("app"), F.lit('{"Event":"SparkListenerTaskEnd","Sta').alias("value"))
    out = stage_lines
    for frame in (cut_off, app_lines, job_lines, sql_lines, executor_lines):
        out = out.unionByName(frame)
    return out


def event_log(t) -> EventLog:
    """The log of the four applications: written once as folders of gzip text, read back as lines, cleaned and organised."""
    key = (id(t.spark), f"{shared_dir(t.spark)}|{_fingerprint(t.spark, t.sf_dir)}")
    if key not in _LOGS or _LOGS[key].lines.sparkSession is not t.spark:
        path = scratch(t.spark, "eventlog")
        with open_writers(t.spark):
            _task_lines(t).unionByName(_other_lines(t)).write.partitionBy("app").option("compression", "gzip").option("maxRecordsPerFile", FILE_LINES).text(path)
        lines = read_lines(t.spark, path).withColumn("app_key", F.regexp_replace("app_key", "^app=", ""))
        _LOGS[key] = EventLog.read(lines)
    return _LOGS[key]
