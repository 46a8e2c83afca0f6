"""Spark event logs as tables. Input rows: ``app_key, file, line_id, value``, one event a line.

Lines are stored by event name before any JSON is parsed, and every table parses only its own
events and only the fields it needs, with an explicit schema.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import millis_to_iso, nested_text, properties_map, ratio_or_zero, tolerant_int, unwrap_envelope
from ..operators.ordered import match, medians, with_group_position
from ..session import kept, open_writers, scratch
from . import rules

c = F.col
SQL_START = "org.apache.spark.sql.execution.ui.SparkListenerSQLExecutionStart"
SQL_END = "org.apache.spark.sql.execution.ui.SparkListenerSQLExecutionEnd"
STAGE = ["app_key", "stage_id", "attempt_id"]


# ---- cleaning ----------------------------------------------------------------------------------


def _marked(lines: DataFrame, checked: Column | None = None) -> DataFrame:
    """Each line with its event text, whether it is a candidate, and whether it is corrupt. Where ``checked`` is false
    the line is known to be whole, and its JSON is not parsed for that."""
    is_json = lambda text: F.try_parse_json(text).isNotNull()
    whole = is_json if checked is None else lambda text: F.when(checked, is_json(text)).otherwise(True)
    event = unwrap_envelope(c("value"))
    wrapped = F.trim("value").contains('"log"') & ~F.trim("value").startswith('{"Event":')
    rows = lines.withColumn("event", event).withColumn("broken", wrapped & ~whole("value"))
    candidate = ~c("broken") & c("event").startswith('{"Event":')
    return rows.withColumn("candidate", candidate).withColumn("bad", c("broken") | (candidate & ~whole("event")))


def corrupt_files(lines: DataFrame) -> DataFrame:
    """Files that hold a corrupt line, a row each."""
    return _marked(lines).where(c("bad")).select("app_key", "file").distinct()


def _stops(marked: DataFrame) -> DataFrame:
    """The first corrupt line of each corrupt file."""
    return marked.where(c("bad")).groupBy("app_key", "file").agg(F.min("line_id").alias("stop"))


def _with_stop(marked: DataFrame, stops: DataFrame | None = None) -> DataFrame:
    """Lines with the first corrupt line of their file. The stops, one small row for each corrupt file, go to the lines:
    the text of the log is not shuffled."""
    return marked.join(F.broadcast(_stops(marked) if stops is None else stops), ["app_key", "file"], "left")


def _marked_in(lines: DataFrame, corrupt: DataFrame | None) -> DataFrame:
    """Marked lines; where ``corrupt`` names the corrupt files, only the JSON of their lines is parsed."""
    if corrupt is None:
        return _marked(lines)
    named = lines.join(F.broadcast(corrupt.withColumn("_corrupt", F.lit(True))), ["app_key", "file"], "left")
    return _marked(named, c("_corrupt").isNotNull()).drop("_corrupt")


def _valid(stopped: DataFrame) -> DataFrame:
    return stopped.where(c("candidate") & ~c("bad") & (c("stop").isNull() | (c("line_id") < c("stop"))))


def _skipped() -> Column:
    return ~c("candidate") & ~c("bad") & (F.trim("value") != "")


def _report(stopped: DataFrame) -> DataFrame:
    read = stopped.where(c("stop").isNull() | (c("line_id") <= c("stop")))
    count = lambda cond, name: F.sum(F.when(cond, 1).otherwise(0)).alias(name)
    out = read.groupBy("app_key", "file").agg(
        F.count("*").alias("input_lines"), count(c("candidate"), "candidates"), count(c("candidate") & ~c("bad"), "output_events"),
        count(c("noise"), "skipped"), F.max(c("stop").isNotNull()).alias("corrupt"))
    return out.withColumn("stopped_at_line", F.when(c("corrupt"), c("input_lines")))


def clean(lines: DataFrame, corrupt: DataFrame | None = None) -> DataFrame:
    """Valid events before the first corrupt line of their file."""
    return _valid(_with_stop(_marked_in(lines, corrupt))).select("app_key", "file", "line_id", c("event").alias("value"))


def cleaning_report(lines: DataFrame, corrupt: DataFrame | None = None) -> DataFrame:
    """Per file: lines read up to the stop, candidates, events kept, lines skipped, stop line."""
    return _report(_with_stop(_marked_in(lines, corrupt)).withColumn("noise", _skipped()))


def merged_order(lines: DataFrame) -> DataFrame:
    """Lines of an application in file-name order: the file number first, then the name."""
    number = F.coalesce(F.regexp_extract("file", r"^events_(\d+)(?:_|$)", 1).try_cast("long"), F.lit(10**9))
    return lines.withColumn("merge_key", F.struct(number.alias("number"), c("file"), c("line_id")))


# ---- parsing -------------------------------------------------------------------------------------


_STORED = {}


def stored(fn):
    """A table that ``EventLog.organise`` parses once and keeps."""
    name = fn.__name__

    def read(log: EventLog) -> DataFrame:
        return log.tables[name] if name in log.tables else fn(log)

    read.__name__, read.__doc__ = name, fn.__doc__
    _STORED[name] = read
    return read


class EventLog:
    """Lines with the name of their event. ``organise`` stores them by event once, so that a table
    reads only its own events, and stores the parsed tables that most rules need."""

    def __init__(self, lines: DataFrame, tables: dict[str, DataFrame] | None = None):
        name = F.regexp_extract("value", rules.EVENT_KEY, 1)
        self.lines = lines if "event" in lines.columns else lines.withColumn("event", name)
        self.tables = tables or {}

    @classmethod
    def organise(cls, lines: DataFrame) -> EventLog:
        """Clean lines, stored by event, and the tables parsed from them."""
        return cls._parsed(cls._stored(cls(lines).lines))

    @classmethod
    def read(cls, lines: DataFrame) -> EventLog:
        """Raw lines, cleaned and organised; the table ``corrupt`` is the cleaning report of the corrupt files.

        The text is read, and the JSON of each line checked, once: lines are stored by event with what the check found, and
        those from the first corrupt line of a file on are left out when they are read.
        """
        marked = cls(_marked(lines).select("app_key", "file", "line_id", c("event").alias("value"), "candidate", "bad", _skipped().alias("noise")))
        stored = cls._stored(marked.lines)
        stops = kept(_stops(stored), "stops", compression="zstd")
        log = cls._parsed(_valid(_with_stop(stored, stops)).select("app_key", "file", "line_id", "value", "event"))
        in_corrupt = stored.join(F.broadcast(stops), ["app_key", "file"])
        log.tables["corrupt"] = kept(_report(in_corrupt), "corrupt")
        return log

    @staticmethod
    def _stored(lines: DataFrame) -> DataFrame:
        spark, path = lines.sparkSession, scratch(lines.sparkSession, "events")
        with open_writers(spark):
            lines.write.partitionBy("event").option("compression", "zstd").parquet(f"{path}/lines")
        return spark.read.parquet(f"{path}/lines")

    @classmethod
    def _parsed(cls, lines: DataFrame) -> EventLog:
        plain = cls(lines)
        return cls(lines, {name: kept(fn(plain), name, compression="zstd") for name, fn in _STORED.items()})


def of_type(log: EventLog, name: str, schema: str) -> DataFrame:
    """Fields of the events of one name. Conditions on them stay behind the explode, so that a line is not parsed again for each."""
    parsed = log.lines.where(c("event") == name).select("app_key", F.explode(F.array(F.from_json("value", schema))).alias("e"))
    return parsed.select("app_key", "e.*")


def event_counts(log: EventLog) -> DataFrame:
    return log.lines.groupBy("app_key", "event").agg(F.count("*").alias("events"))


def _number(name: str, default: int = 0) -> Column:
    return tolerant_int(c(name), default)


def applications(log: EventLog) -> DataFrame:
    start = of_type(log, "SparkListenerApplicationStart", "`App Name` string, `App ID` string, `User` string, `Timestamp` string")
    end = of_type(log, "SparkListenerApplicationEnd", "`Timestamp` string").groupBy("app_key").agg(F.max(_number("Timestamp")).alias("end_ms"))
    log = of_type(log, "SparkListenerLogStart", "`Spark Version` string").groupBy("app_key").agg(F.max("Spark Version").alias("spark_version"))
    head = start.groupBy("app_key").agg(F.max("App Name").alias("app_name"), F.max("App ID").alias("app_id"), F.max("User").alias("user"),
                                        F.max(_number("Timestamp")).alias("start_ms"))
    return head.join(end, "app_key", "left").join(log, "app_key", "left")


def spark_properties(log: EventLog, prefixes: tuple[str, ...] = rules.PROPERTY_PREFIXES) -> DataFrame:
    env = of_type(log, "SparkListenerEnvironmentUpdate", "`Environment Details` struct<`Spark Properties`: string>")
    pairs = env.select("app_key", F.explode(properties_map(c("Environment Details.Spark Properties"))))
    wanted = F.lit(False)
    for prefix in prefixes:
        wanted = wanted | c("key").startswith(prefix)
    return pairs.where(wanted).groupBy("app_key", "key").agg(F.max("value").alias("value"))


@stored
def jobs(log: EventLog) -> DataFrame:
    start = of_type(log, "SparkListenerJobStart", "`Job ID` string, `Submission Time` string, `Stage IDs` array<int>, `Properties` string")
    props = properties_map(c("Properties"))
    start = start.select("app_key", _number("Job ID", -1).alias("job_id"), _number("Submission Time").alias("submission_ms"), c("Stage IDs").alias("stage_ids"),
                         tolerant_int(props["spark.sql.execution.id"], -1).alias("execution_id"), props["spark.jobGroup.id"].alias("job_group"))
    end = of_type(log, "SparkListenerJobEnd", "`Job ID` string, `Completion Time` string, `Job Result` struct<`Result`: string, `Exception`: string>")
    end = end.select("app_key", _number("Job ID", -1).alias("job_id"), _number("Completion Time").alias("completion_ms"),
                     F.coalesce("Job Result.Result", F.lit("Unknown")).alias("result"))
    status = F.when(c("result").isNull(), "running").when(c("result") == "JobSucceeded", "succeeded").otherwise("failed")
    both = start.where(c("job_id") >= 0).join(end.where(c("job_id") >= 0), ["app_key", "job_id"], "full_outer")
    return both.withColumn("status", status).withColumn("execution_id", F.when(c("execution_id") >= 0, c("execution_id")))


@stored
def executors(log: EventLog) -> DataFrame:
    added = of_type(log, "SparkListenerExecutorAdded", "`Executor ID` string, `Timestamp` string, `Executor Info` struct<`Host`: string>")
    added = added.groupBy("app_key", F.coalesce("Executor ID", F.lit("unknown")).alias("executor_id")).agg(
        F.max(_number("Timestamp")).alias("added_ms"), F.max("Executor Info.Host").alias("host"))
    gone = of_type(log, "SparkListenerExecutorRemoved", "`Executor ID` string, `Timestamp` string, `Removed Reason` string")
    gone = gone.groupBy("app_key", F.coalesce("Executor ID", F.lit("unknown")).alias("executor_id")).agg(
        F.max(_number("Timestamp")).alias("removed_ms"), F.max(c("Removed Reason")).alias("removed_reason"))
    return added.join(gone, ["app_key", "executor_id"], "full_outer").withColumn("removed", c("removed_ms").isNotNull())


@stored
def sql_executions(log: EventLog) -> DataFrame:
    start = of_type(log, SQL_START, "`executionId` string, `description` string, `time` string")
    start = start.select("app_key", _number("executionId", -1).alias("execution_id"), F.coalesce("description", F.lit("")).alias("description"),
                         _number("time").alias("start_ms"))
    end = of_type(log, SQL_END, "`executionId` string, `time` string, `errorMessage` string")
    end = end.select("app_key", _number("executionId", -1).alias("execution_id"), _number("time").alias("end_ms"),
                     F.coalesce("errorMessage", F.lit("")).alias("error_message"))
    both = start.join(end, ["app_key", "execution_id"], "full_outer").where(c("execution_id") >= 0)
    return both.withColumn("state", F.when(c("end_ms").isNull(), "running").otherwise("ended"))


# ---- stages and tasks -----------------------------------------------------------------------------

_INFO = ("`Stage Info` struct<`Stage ID`: string, `Stage Attempt ID`: string, `Stage Name`: string, `Number of Tasks`: string, "
         "`Submission Time`: string, `Completion Time`: string, `Failure Reason`: string>")


@stored
def stage_infos(log: EventLog) -> DataFrame:
    both = of_type(log, "SparkListenerStageSubmitted", _INFO).unionByName(of_type(log, "SparkListenerStageCompleted", _INFO))
    flat = both.select("app_key", "Stage Info.*")
    return flat.groupBy("app_key", _number("Stage ID", -1).alias("stage_id"), _number("Stage Attempt ID").alias("attempt_id")).agg(
        F.max("Stage Name").alias("name"), F.max(_number("Number of Tasks")).alias("declared"), F.max(_number("Submission Time")).alias("submission_ms"),
        F.max(_number("Completion Time")).alias("completion_ms"), F.max("Failure Reason").alias("failure_reason"))


_END = ("`Stage ID` string, `Stage Attempt ID` string, `Task End Reason` string, "
        "`Task Metrics` struct<`Executor Run Time`: string, `JVM GC Time`: string, `Memory Bytes Spilled`: string, `Disk Bytes Spilled`: string, "
        "`Peak Execution Memory`: string, `Input Metrics`: struct<`Bytes Read`: string>, `Shuffle Read Metrics`: struct<`Total Bytes Read`: string, "
        "`Remote Bytes Read`: string, `Local Bytes Read`: string, `Remote Bytes Read To Disk`: string, `Fetch Wait Time`: string>, "
        "`Shuffle Write Metrics`: struct<`Shuffle Bytes Written`: string>>")
METRICS = ("run_ms", "gc_ms", "fetch_wait_ms", "spill_memory", "spill_disk", "peak_memory", "input_bytes", "shuffle_read", "shuffle_write")


def shuffle_read(total: Column, remote: Column, local: Column, to_disk: Column) -> Column:
    """The written total, or the sum of its parts where no total is given."""
    return F.when(total > 0, total).otherwise(remote + local + to_disk)


@stored
def task_ends(log: EventLog) -> DataFrame:
    tasks = of_type(log, "SparkListenerTaskEnd", _END)
    metric = lambda path: F.when(c("Task Metrics").isNotNull(), tolerant_int(c(f"Task Metrics.{path}")))
    read = lambda name: tolerant_int(c(f"Task Metrics.Shuffle Read Metrics.{name}"))
    why = c("Task End Reason")
    reason = F.coalesce(F.get_json_object(why, "$.Reason"), F.get_json_object(why, "$['Class Name']"), F.lit("Unknown"))
    return tasks.withColumn("reason", reason).select(
        "app_key", _number("Stage ID", -1).alias("stage_id"), _number("Stage Attempt ID").alias("attempt_id"), "reason",
        (~c("reason").isin(*rules.SUCCESS_REASONS)).alias("failed"),
        nested_text(why).alias("text"),
        metric("Executor Run Time").alias("run_ms"), metric("JVM GC Time").alias("gc_ms"), metric("Shuffle Read Metrics.Fetch Wait Time").alias("fetch_wait_ms"),
        metric("Memory Bytes Spilled").alias("spill_memory"), metric("Disk Bytes Spilled").alias("spill_disk"), metric("Peak Execution Memory").alias("peak_memory"),
        metric("Input Metrics.Bytes Read").alias("input_bytes"),
        F.when(c("Task Metrics").isNotNull(), shuffle_read(read("Total Bytes Read"), read("Remote Bytes Read"), read("Local Bytes Read"), read("Remote Bytes Read To Disk"))).alias("shuffle_read"),
        metric("Shuffle Write Metrics.Shuffle Bytes Written").alias("shuffle_write")).where(c("stage_id") >= 0)


@stored
def task_starts(log: EventLog) -> DataFrame:
    info = "`Task Info` struct<`Task ID`: string, `Launch Time`: string, `Executor ID`: string, `Host`: string>"
    starts = of_type(log, "SparkListenerTaskStart", f"`Stage ID` string, `Stage Attempt ID` string, {info}")
    return starts.select("app_key", _number("Stage ID", -1).alias("stage_id"), _number("Stage Attempt ID").alias("attempt_id"),
                         tolerant_int(c("Task Info.Task ID"), -1).alias("task_id"), tolerant_int(c("Task Info.Launch Time")).alias("launch_ms"),
                         c("Task Info.Executor ID").alias("executor_id")).where(c("stage_id") >= 0)


def start_samples(log: EventLog, n: int = 20) -> DataFrame:
    """The first n task starts of each stage; the rank filter cuts each task's rows before the shuffle."""
    from pyspark.sql import Window

    line = Window.partitionBy(*STAGE).orderBy("launch_ms", "task_id")
    return task_starts(log).withColumn("place", F.row_number().over(line)).where(c("place") <= n)


def stage_totals(ends: DataFrame) -> DataFrame:
    """Per stage attempt: tasks, failures, and count, sum and maximum of every metric (map-side combined)."""
    return ends.groupBy(*STAGE).agg(
        F.count("*").alias("tasks"), F.sum(c("failed").cast("long")).alias("failed_tasks"),
        *[e for m in METRICS for e in (F.count(m).alias(f"{m}_count"), F.sum(m).alias(f"{m}_total"), F.max(m).alias(f"{m}_max"))])


def stage_medians(ends: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Exact medians of all metrics in one distributed sort over (stage, metric, value)."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), c(m).alias("value")) for m in metrics])
    long = ends.select(*STAGE, F.explode(pairs).alias("p")).select(*STAGE, "p.metric", "p.value")
    out = medians(long, [*STAGE, "metric"], "value")
    return out.groupBy(*STAGE).pivot("metric", list(metrics)).agg(F.max("median")).select(
        *STAGE, *[c(m).alias(f"{m}_median") for m in metrics])


def stages(log: EventLog, with_medians: bool = True) -> DataFrame:
    """One row per stage attempt from infos, starts and ends."""
    ends = task_ends(log)
    starts = task_starts(log).groupBy(*STAGE).agg(F.count("*").alias("task_starts"), F.min("launch_ms").alias("first_launch_ms"),
                                                    F.max("launch_ms").alias("last_launch_ms"))
    out = stage_infos(log).join(starts, STAGE, "full_outer").join(stage_totals(ends), STAGE, "full_outer")
    out = out.na.fill(0, ["declared", "submission_ms", "completion_ms", "task_starts", "tasks", "failed_tasks", *[f"{m}_total" for m in METRICS]])
    if with_medians:
        out = out.join(stage_medians(ends, ("run_ms", "input_bytes", "shuffle_read")), STAGE, "left")
    unclosed = F.greatest(c("task_starts") - c("tasks"), F.lit(0))
    lasted = F.when((c("submission_ms") > 0) & (c("completion_ms") > 0), F.greatest(c("completion_ms") - c("submission_ms"), F.lit(0))).otherwise(0)
    return out.withColumn("unclosed", unclosed).withColumn("duration_ms", lasted)


# ---- signatures -------------------------------------------------------------------------------------


def _signature_codes(text: Column) -> Column:
    tests = [F.when(text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(code)) for code, (_, patterns) in rules.SIGNATURES.items()]
    return F.array_compact(F.array(*tests))


def signature_texts(log: EventLog) -> DataFrame:
    """All text of what may tell of an error, whatever field it stands in, with where it came from."""
    ends = task_ends(log).select("app_key", F.lit("task_end_reason").alias("source"), "text")
    gone = of_type(log, "SparkListenerExecutorRemoved", "`Removed Reason` string").select("app_key", F.lit("executor_removed").alias("source"), c("Removed Reason").alias("text"))
    ended = of_type(log, "SparkListenerJobEnd", "`Job Result` string").select("app_key", F.lit("job_end").alias("source"), nested_text(c("Job Result")).alias("text"))
    sql = log.lines.where(c("event").isin(SQL_START, SQL_END)).select(
        "app_key", F.when(c("event") == SQL_START, "sql_execution_start").otherwise("sql_execution_end").alias("source"), nested_text(c("value")).alias("text"))
    return ends.unionByName(gone).unionByName(ended).unionByName(sql).where(c("text").isNotNull() & (c("text") != ""))


def raw_line_texts(log: EventLog) -> DataFrame:
    """Every event line that holds a word of a signature, unparsed; the first pass over a very large log.

    Most lines hold no piece of a signature, which one pass over the line as it is tells; only the others are lower-cased and
    looked through for the words. The text comes out of an explode, so that conditions on it stay behind these two.
    """
    lines = log.lines.where(c("event") != "").select("app_key", F.explode(F.array("value")).alias("text"))
    anchored = c("text").rlike(rules.PIECE) & F.lower("text").rlike("|".join(rules.ANCHORS))
    return lines.where(anchored).select("app_key", F.lit("raw_event_line").alias("source"), "text")


def signature_hits(log: EventLog, texts: DataFrame | None = None) -> DataFrame:
    """Hits per application, code and source. Equal texts are counted before the patterns run."""
    texts = (signature_texts(log) if texts is None else texts).groupBy("app_key", "source", "text").agg(F.count("*").alias("n"))
    hits = texts.select("app_key", "source", "n", F.explode(_signature_codes(c("text"))).alias("code"))
    return hits.groupBy("app_key", "code", "source").agg(F.sum("n").alias("hits"))


def signature_examples(log: EventLog, n: int | None = None) -> DataFrame:
    """The different texts of each application and code, whole; the first n in order, or all."""
    from pyspark.sql import Window

    texts = signature_texts(log).select("app_key", c("text").alias("example")).distinct()
    texts = texts.select("app_key", "example", F.explode(_signature_codes(c("example"))).alias("code"))
    if n is None:
        return texts
    line = Window.partitionBy("app_key", "code").orderBy("example")
    return texts.withColumn("place", F.row_number().over(line)).where(c("place") <= n).drop("place")


# ---- findings ----------------------------------------------------------------------------------------


def _finding(frame: DataFrame, code: str, severity: str) -> DataFrame:
    return frame.select("app_key", F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.lit("").alias("stage"))


def stage_findings(table: DataFrame, codes: tuple[str, ...] | None = None) -> DataFrame:
    """Failure, unclosed starts, failed tasks, spill, garbage collection, skew and fetch wait, all rules in one pass."""
    open_ratio = ratio_or_zero(c("unclosed"), c("task_starts"))
    spill = c("spill_memory_total") + c("spill_disk_total")
    gc = ratio_or_zero(c("gc_ms_total"), c("run_ms_total"))
    wait = ratio_or_zero(c("fetch_wait_ms_total"), c("run_ms_total"))
    busy = c("run_ms_total") >= rules.BUSY_MS
    level = lambda high: F.when(high, "high").otherwise("medium")
    medium = F.lit("medium")
    tests = [
        ("FAILED_STAGES", c("failure_reason") != "", F.lit("high")),
        ("TASK_STARTS_WITHOUT_ENDS", (c("unclosed") > 0) & ((c("completion_ms") == 0) | (open_ratio >= 0.05)), level((c("unclosed") >= 10) | (open_ratio >= 0.25))),
        ("HIGH_FAILED_TASK_RATE", (c("failed_tasks") > 0) & ((c("failed_tasks") >= 10) | (ratio_or_zero(c("failed_tasks"), c("tasks")) >= 0.02)), medium),
        ("HIGH_STAGE_SPILL", spill >= rules.SPILL_BYTES, level(spill >= rules.SPILL_BYTES * 10)),
        ("HIGH_GC_TIME", busy & (gc >= rules.GC_WARN), level(gc >= rules.GC_HIGH)),
        ("HIGH_FETCH_WAIT", busy & (wait >= rules.FETCH_WAIT), medium),
    ]
    for code, metric, floor in (("TASK_RUNTIME_SKEW", "run_ms", rules.SKEW_MS), ("INPUT_SKEW", "input_bytes", rules.SKEW_BYTES),
                                ("SHUFFLE_READ_SKEW", "shuffle_read", rules.SKEW_BYTES)):
        if codes is not None and code not in codes:
            continue  # a table without medians has no such columns
        median, high = c(f"{metric}_median"), c(f"{metric}_max")
        tests.append((code, (median > 0) & (high >= floor) & (F.try_divide(high, median) >= rules.SKEW_RATIO), medium))
    tests = [x for x in tests if codes is None or x[0] in codes]
    found = F.array_compact(F.array(*[F.when(test, F.struct(severity.alias("severity"), F.lit(code).alias("code"))) for code, test, severity in tests]))
    key = F.concat_ws(".", c("stage_id").cast("string"), c("attempt_id").cast("string"))
    rows = table.select("app_key", key.alias("key"), F.explode(found).alias("f"))
    return rows.select("app_key", "f.severity", "f.code", F.when(c("f.code") == "FAILED_STAGES", "").otherwise(c("key")).alias("stage")).distinct()


STAGE_CODES = ("FAILED_STAGES", "TASK_STARTS_WITHOUT_ENDS", "HIGH_FAILED_TASK_RATE", "HIGH_STAGE_SPILL", "HIGH_GC_TIME", "HIGH_FETCH_WAIT",
               "TASK_RUNTIME_SKEW", "INPUT_SKEW", "SHUFFLE_READ_SKEW")
SKEW_CODES = STAGE_CODES[-3:]


def findings(log: EventLog, parse_errors: DataFrame | None = None, stage_table: DataFrame | None = None, codes: tuple[str, ...] | None = None) -> DataFrame:
    """Findings of all rules, or of the rules with the given codes only: health of the log, failed jobs and stages, signatures, stage rules."""
    wanted = lambda *some: codes is None or any(x in codes for x in some)
    parts = []
    if wanted("APPLICATION_INCOMPLETE"):
        parts.append(_finding(applications(log).where((c("start_ms") > 0) & (F.coalesce("end_ms", F.lit(0)) == 0)), "APPLICATION_INCOMPLETE", "low"))
    if wanted("FAILED_JOBS"):
        parts.append(_finding(jobs(log).where(c("status") == "failed").select("app_key").distinct(), "FAILED_JOBS", "high"))
    if wanted(*rules.SIGNATURES, "FETCH_FAILED_AFTER_EXECUTOR_LOSS"):
        hits = signature_hits(log).select("app_key", "code").distinct()
        severity = F.create_map(*[F.lit(x) for code, (level, _) in rules.SIGNATURES.items() for x in (code, level)])
        own = hits if codes is None else hits.where(c("code").isin(*codes))
        parts.append(own.select("app_key", severity[c("code")].alias("severity"), "code", F.lit("").alias("stage")))
        both = hits.where(c("code") == "FETCH_FAILED").join(hits.where(c("code") == "EXECUTOR_LOST"), "app_key", "left_semi")
        if wanted("FETCH_FAILED_AFTER_EXECUTOR_LOSS"):
            parts.append(_finding(both, "FETCH_FAILED_AFTER_EXECUTOR_LOSS", "high"))
    if wanted(*STAGE_CODES):
        table = stages(log, with_medians=wanted(*SKEW_CODES)) if stage_table is None else stage_table
        parts.append(stage_findings(table, codes))
    if parse_errors is not None and wanted("PARSE_ERRORS"):
        parts.append(_finding(parse_errors.select("app_key").distinct(), "PARSE_ERRORS", "medium"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def empty_logs(all_keys: DataFrame, log: EventLog) -> DataFrame:
    """Applications whose files hold no event at all."""
    return _finding(all_keys.select("app_key").distinct().join(log.lines.select("app_key").distinct(), "app_key", "left_anti"), "NO_SPARK_EVENTS", "high")


def remediation(found: DataFrame) -> DataFrame:
    """Plans by scope: findings joined to the rule table; the fallback only where no rule applies."""
    spark = found.sparkSession
    table = F.broadcast(spark.createDataFrame([list(r) for r in rules.REMEDIATION], "priority int, scope string, code string"))
    codes = found.select("app_key", "code").distinct()
    plans = codes.join(table, "code").select("app_key", "priority", "scope").distinct()
    priority, scope, failed = rules.FALLBACK
    rest = codes.where(c("code").isin(*failed)).select("app_key").distinct().join(plans, "app_key", "left_anti")
    return plans.unionByName(rest.select("app_key", F.lit(priority).alias("priority"), F.lit(scope).alias("scope")))


# ---- queries of an application ---------------------------------------------------------------------------


def query_breakdown(log: EventLog, stage_table: DataFrame | None = None) -> DataFrame:
    """Per SQL execution: status, duration and its source, jobs, stages, attempts, tasks, retries."""
    table = stages(log, with_medians=False) if stage_table is None else stage_table
    job, sql = jobs(log), sql_executions(log)
    key = ["app_key", "execution_id"]
    per_job = job.where(c("execution_id").isNotNull()).groupBy(*key).agg(
        F.count("*").alias("jobs"), F.sum((c("status") == "failed").cast("long")).alias("failed_jobs"),
        F.sum((c("status") == "succeeded").cast("long")).alias("succeeded_jobs"),
        F.min(F.when(c("submission_ms") > 0, c("submission_ms"))).alias("job_start_ms"), F.max(F.when(c("completion_ms") > 0, c("completion_ms"))).alias("job_end_ms"))
    owned = job.where(c("execution_id").isNotNull()).select(*key, F.explode(c("stage_ids").cast("array<bigint>")).alias("stage_id")).distinct()
    attempts = owned.join(table, ["app_key", "stage_id"])
    per_stage = attempts.groupBy(*key, "stage_id").agg(
        F.count("*").alias("attempts"), F.max("attempt_id").alias("last_attempt"), F.sum("tasks").alias("tasks"), F.sum("task_starts").alias("started"),
        F.sum("unclosed").alias("unclosed"), F.sum("failed_tasks").alias("failed_tasks"), F.sum("declared").alias("declared"),
        F.sum(F.when(c("declared") > 0, F.greatest(c("tasks") - c("declared"), F.lit(0))).otherwise(0)).alias("task_retries"),
        F.sum((F.coalesce("failure_reason", F.lit("")) != "").cast("long")).alias("failed_attempts"), F.sum("run_ms_total").alias("run_ms"))
    retried = ((c("attempts") > 1) | (c("last_attempt") > 0)).cast("long")
    per_query = per_stage.groupBy(*key).agg(
        F.count("*").alias("stages"), F.sum("attempts").alias("stage_attempts"), F.sum("failed_attempts").alias("failed_attempts"), F.sum("tasks").alias("tasks"),
        F.sum("started").alias("started"), F.sum("unclosed").alias("unclosed"), F.sum("failed_tasks").alias("failed_tasks"), F.sum("declared").alias("declared"),
        F.sum("run_ms").alias("run_ms"), F.sum(retried).alias("retried_stages"), F.sum("task_retries").alias("task_retries"))
    counts = ["jobs", "failed_jobs", "succeeded_jobs", "stages", "stage_attempts", "failed_attempts", "tasks", "started", "unclosed", "failed_tasks", "declared",
              "run_ms", "retried_stages", "task_retries"]
    out = sql.join(per_job, key, "full_outer").join(per_query, key, "left").na.fill(0, counts)
    from_sql = F.coalesce("start_ms", F.lit(0)) > 0
    begin = F.when(from_sql, c("start_ms")).otherwise(F.coalesce("job_start_ms", F.lit(0)))
    end = F.when(F.coalesce("end_ms", F.lit(0)) > 0, c("end_ms")).otherwise(F.coalesce("job_end_ms", F.lit(0)))
    source = (F.when((F.coalesce("end_ms", F.lit(0)) == 0) & (end > 0), F.when(from_sql, "sql_execution_start_and_jobs").otherwise("jobs"))
              .when(from_sql, "sql_execution").when(begin > 0, "jobs").otherwise("unknown"))
    status = (F.when((c("failed_jobs") > 0) | (F.coalesce("error_message", F.lit("")) != ""), "failed").when(c("state") == "ended", "succeeded")
              .when(c("state") == "running", "running").otherwise("unknown"))
    return out.select(*key, F.coalesce("description", F.lit("")).alias("description"), status.alias("status"), source.alias("duration_source"),
                      F.when((begin > 0) & (end > 0), F.greatest(end - begin, F.lit(0))).otherwise(0).alias("duration_ms"), *counts,
                      ((c("retried_stages") > 0) | (c("task_retries") > 0)).alias("retried"))


def _task_end_keys(lines: DataFrame) -> DataFrame:
    """Task ends with the keys of their stage, cut out of the unparsed line."""
    cut = lambda key: F.regexp_extract("value", key, 1).try_cast("long")
    ends = lines.where(c("event") == "SparkListenerTaskEnd")
    return ends.withColumn("stage_id", cut(rules.STAGE_KEY)).withColumn("attempt_id", F.coalesce(cut(rules.ATTEMPT_KEY), F.lit(0)))


def deep_stages(log: EventLog) -> DataFrame:
    """Stages worth a full parse: failed ones and those with a signature in a task end."""
    failed = stage_infos(log).where(c("failure_reason") != "").select(*STAGE)
    marked = "(?i)" + "|".join(f"(?:{p})" for _, patterns in rules.SIGNATURES.values() for p in patterns)
    raw = raw_line_texts(EventLog(log.lines.where(c("event") == "SparkListenerTaskEnd"))).select("app_key", c("text").alias("value"), F.lit("SparkListenerTaskEnd").alias("event"))
    return failed.unionByName(_task_end_keys(raw.where(c("value").rlike(marked))).select(*STAGE)).distinct()


def qualification(stages: DataFrame, execs: DataFrame) -> DataFrame:
    """Rows of a qualification run: app, stage, duration, place of the stage in its application (longest first, then by
    number; stages without a duration last) and the number of its unsupported operators, 0 for a stage without operators.

    Places come from one sorted table, so an application with most of the stages is spread over many tasks.
    """
    refused = F.lower(F.trim("Exec Is Supported")).isin("false", "no", "n", "0") | ~F.lower(F.trim(F.coalesce("Action", F.lit("")))).isin("", "none")
    bad = execs.groupBy(c("App ID").alias("app"), c("Exec Stages").cast("long").alias("stage")).agg(F.sum(F.when(refused, 1).otherwise(0)).alias("unsupported"))
    rows = stages.select(c("App ID").alias("app"), c("Stage ID").cast("long").alias("stage"), c("Stage Task Duration").try_cast("long").alias("duration"))
    ordered = rows.withColumn("_none", c("duration").isNull()).withColumn("_down", -c("duration"))
    placed = with_group_position(ordered, ["app"], ["_none", "_down", "stage"], "place").drop("_none", "_down")
    return match(placed, bad, ["app", "stage"], "left").withColumn("unsupported", F.coalesce("unsupported", F.lit(0)))


def two_pass_tasks(log: EventLog) -> DataFrame:
    """Task metrics of the chosen stages only: keys are cut out of the text and semi-joined before any JSON is parsed.

    The chosen stages are stored first, so that Spark knows their size and need not shuffle the lines for a few keys.
    """
    chosen = kept(deep_stages(log), "deep-stages")
    return task_ends(EventLog(_task_end_keys(log.lines).join(chosen, STAGE, "left_semi").drop("stage_id", "attempt_id")))


def application_summary(log: EventLog, found: DataFrame | None = None) -> DataFrame:
    """One row per application with totals and its worst severity; ``severity_rank`` sorts the index."""
    table = kept(stages(log))
    found = findings(log, stage_table=table) if found is None else found
    rank = F.create_map(*[F.lit(x) for i, s in enumerate(rules.SEVERITY_ORDER) for x in (s, i)])
    count = lambda cond, name: F.sum(F.when(cond, 1).otherwise(0)).alias(name)
    per_finding = found.groupBy("app_key").agg(F.count("*").alias("findings"), F.min(rank[c("severity")]).alias("severity_rank"),
                                               *[count(c("severity") == s, s) for s in rules.SEVERITY_ORDER])
    per_stage = table.groupBy("app_key").agg(F.count("*").alias("stage_attempts"), F.sum("tasks").alias("tasks"), F.sum("task_starts").alias("started"),
                                             F.sum("unclosed").alias("unclosed"), F.sum("failed_tasks").alias("failed_tasks"))
    per_job = jobs(log).groupBy("app_key").agg(F.count("*").alias("jobs"), count(c("status") == "failed", "failed_jobs"))
    per_executor = executors(log).groupBy("app_key").agg(F.count("*").alias("executors"), count(c("removed"), "removed_executors"))
    out = applications(log)
    for frame in (per_stage, per_job, per_executor, per_finding):
        out = out.join(frame, "app_key", "left")
    lasted = F.when(c("end_ms") > 0, F.greatest(c("end_ms") - c("start_ms"), F.lit(0))).otherwise(0)
    return out.withColumn("duration_ms", lasted).withColumn("start_time", millis_to_iso(c("start_ms")))


# ---- physical plan text -------------------------------------------------------------------------------------


def plan_triage(texts: DataFrame) -> DataFrame:
    """Memory signs in a plan or log text, one row per document."""
    from ..functions.scalar import size_to_bytes

    text = c("text")
    sizes = F.regexp_extract_all(text, F.lit(r"(?s)BroadcastQueryStage.*?Statistics\(sizeInBytes=([0-9.]+\s*[KMGT]?i?B)"), F.lit(1))
    bytes_ = F.transform(sizes, size_to_bytes)
    parts = F.transform(F.regexp_extract_all(text, F.lit(r"(?:hashpartitioning|RoundRobinPartitioning)\([^)]*?,\s*(\d+)\)"), F.lit(1)), lambda v: v.cast("int"))
    return texts.select(
        "doc", text.rlike(r"(?i)\b(exit code 137|SIGKILL|OOMKilled)\b").alias("container_oom"), text.contains("FetchFailedException").alias("fetch_failed"),
        (text.contains("FetchFailedException") & text.contains("ExecutorDeadException")).alias("dead_executor"),
        text.rlike("Java heap space|GC overhead limit exceeded").alias("heap_oom"), text.rlike("(?i)Direct buffer memory|Netty|OutOfDirectMemory").alias("direct_memory"),
        F.size(sizes).alias("broadcasts_sized"), F.coalesce(F.exists(bytes_, lambda b: b >= rules.LARGE_BROADCAST), F.lit(False)).alias("large_broadcast"),
        F.regexp_count(text, F.lit(r"\bBroadcastExchange\b")).alias("broadcast_exchanges"), F.regexp_count(text, F.lit(r"\bReusedExchange\b")).alias("reused_exchanges"),
        text.rlike(r"(?s)Generate.*explode\(arrays_zip").alias("zipped_explode"), F.array_min(parts).alias("fewest_partitions"),
        F.coalesce(F.array_min(parts) <= rules.FEW_PARTITIONS, F.lit(False)).alias("few_partitions"), text.rlike(r"AQEShuffleRead[^\n]*coalesced").alias("coalesced_reads"),
        F.nullif(F.regexp_extract(text, r"""spark\.executor\.memoryOverhead["'=:\s]+([0-9]+[gGmMkK]?)""", 1), F.lit("")).alias("memory_overhead"))
