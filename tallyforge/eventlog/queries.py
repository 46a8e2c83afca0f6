"""Event-log diagnosis over logs derived from line items; statements go to the line items directly."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import elapsed_seconds
from ..operators.ordered import with_position
from ..registry import on_tables
from ..session import scratch
from ..sources.files import read_csv
from . import events as E
from . import rules
from .from_tables import T0, event_log, tasks

c = F.col

_TASKS = f"""WITH tk AS (SELECT 'app-' || l_suppkey % 4 app_key, l_partkey % 80 stage_id, CASE WHEN l_partkey % 80 = 7 AND l_linenumber >= 6 THEN 1 ELSE 0 END::BIGINT attempt_id,
    l_orderkey * 8 + l_linenumber task, {T0} + l_orderkey * 10 launch, l_quantity::BIGINT q, l_quantity::BIGINT * 1000 * CASE WHEN l_partkey % 100 = 0 THEN 50 ELSE 1 END run,
    l_linenumber n, l_returnflag fl, l_linestatus ls, l_partkey pk FROM lineitem),
ends AS (SELECT *, run AS run_ms, CASE WHEN stage_id = 13 THEN run * 3 // 10 ELSE run // 50 END gc_ms, CASE WHEN stage_id = 17 THEN run // 3 ELSE 0 END fetch_wait_ms,
    CASE WHEN stage_id = 15 THEN q * 10000000 ELSE 0 END spill_memory, CASE WHEN stage_id = 15 THEN q * 5000000 ELSE 0 END spill_disk, q * 1000000 peak_memory,
    run * 1000 input_bytes, CASE WHEN ls = 'O' THEN q * 2000000 ELSE q * 1600000 END shuffle_read, q * 300000 shuffle_write,
    CASE WHEN stage_id = 5 AND n = 1 AND fl = 'R' THEN 'FetchFailed' WHEN (stage_id = 11 OR stage_id >= 20) AND n = 2 AND fl = 'A' THEN 'ExceptionFailure'
      WHEN stage_id = 12 AND n = 5 AND fl = 'R' THEN 'ExecutorLostFailure'
      WHEN stage_id = 9 AND n = 3 THEN 'TaskCommitDenied' ELSE 'Success' END reason
  FROM tk WHERE NOT (stage_id = 3 AND n = 4)),
st AS (SELECT app_key, stage_id, attempt_id, count(*) task_starts, min(launch) first_launch, max(launch) last_launch FROM tk GROUP BY ALL),
en AS (SELECT app_key, stage_id, attempt_id, count(*) tasks, count(*) FILTER (WHERE reason IN ('FetchFailed', 'ExceptionFailure', 'ExecutorLostFailure')) failed_tasks,
    sum(run_ms)::BIGINT run_total, sum(gc_ms)::BIGINT gc_total, sum(fetch_wait_ms)::BIGINT wait_total, sum(spill_memory + spill_disk)::BIGINT spill,
    max(run_ms) run_max, median(run_ms) run_median, max(input_bytes) input_max, median(input_bytes) input_median, max(shuffle_read) read_max, median(shuffle_read) read_median FROM ends GROUP BY ALL),
sg AS (SELECT *, task_starts - coalesce(tasks, 0) unclosed, CASE WHEN stage_id = 3 THEN 0 ELSE last_launch + 60000 END done FROM st LEFT JOIN en USING (app_key, stage_id, attempt_id)),
apps AS (SELECT DISTINCT app_key FROM tk),
job AS (SELECT app_key, j, j // 2 q, {T0} + j * 1000 submitted, CASE WHEN NOT (j = 4 AND app_key = 'app-3') THEN {T0} + 500000 + j END completed,
    CASE WHEN j = 4 AND app_key = 'app-3' THEN 'running' WHEN j = 1 THEN 'failed' ELSE 'succeeded' END status FROM apps, range(5) g(j)),
hits AS (SELECT app_key, 'FETCH_FAILED' code, 'task_end_reason' source, count(*) hits FROM ends WHERE reason = 'FetchFailed' GROUP BY ALL
  UNION ALL SELECT app_key, 'JVM_HEAP_OOM', 'task_end_reason', count(*) FROM ends WHERE reason = 'ExceptionFailure' GROUP BY ALL
  UNION ALL SELECT app_key, code, 'task_end_reason', count(*) FROM ends, (VALUES ('EXECUTOR_LOST'), ('CONTAINER_OOM_OR_137')) v(code) WHERE reason = 'ExecutorLostFailure' GROUP BY ALL
  UNION ALL SELECT app_key, 'JVM_HEAP_OOM', 'sql_execution_start', 1 FROM apps WHERE app_key <> 'app-2'
  UNION ALL SELECT 'app-' || s_suppkey % 4, 'CONTAINER_OOM_OR_137', 'executor_removed', count(*) FROM supplier WHERE s_suppkey % 20 = 0 GROUP BY ALL
  UNION ALL SELECT app_key, 'EXECUTOR_LOST', 'sql_execution_end', 1 FROM apps),
found AS (SELECT 'app-3' app_key, 'low' severity, 'APPLICATION_INCOMPLETE' code, '' stage WHERE 'app-3' IN (FROM apps)
  UNION ALL SELECT app_key, 'high', 'FAILED_JOBS', '' FROM apps
  UNION ALL SELECT DISTINCT app_key, 'high', 'FAILED_STAGES', '' FROM sg WHERE stage_id = 5
  UNION ALL SELECT DISTINCT app_key, CASE WHEN code IN ('JVM_HEAP_OOM', 'CONTAINER_OOM_OR_137') THEN 'critical' ELSE 'high' END, code, '' FROM hits
  UNION ALL SELECT DISTINCT app_key, 'high', 'FETCH_FAILED_AFTER_EXECUTOR_LOSS', '' FROM hits WHERE code = 'FETCH_FAILED'
  UNION ALL SELECT app_key, CASE WHEN unclosed >= 10 OR unclosed::DOUBLE / task_starts >= 0.25 THEN 'high' ELSE 'medium' END, 'TASK_STARTS_WITHOUT_ENDS', stage_id || '.' || attempt_id FROM sg
    WHERE unclosed > 0 AND (done = 0 OR unclosed::DOUBLE / task_starts >= 0.05)
  UNION ALL SELECT app_key, 'medium', 'HIGH_FAILED_TASK_RATE', stage_id || '.' || attempt_id FROM sg WHERE failed_tasks > 0 AND (failed_tasks >= 10 OR failed_tasks::DOUBLE / tasks >= 0.02)
  UNION ALL SELECT app_key, CASE WHEN spill >= {10 * rules.SPILL_BYTES} THEN 'high' ELSE 'medium' END, 'HIGH_STAGE_SPILL', stage_id || '.' || attempt_id FROM sg WHERE spill >= {rules.SPILL_BYTES}
  UNION ALL SELECT app_key, CASE WHEN gc_total::DOUBLE / run_total >= 0.25 THEN 'high' ELSE 'medium' END, 'HIGH_GC_TIME', stage_id || '.' || attempt_id FROM sg WHERE run_total >= 60000 AND gc_total::DOUBLE / run_total >= 0.1
  UNION ALL SELECT app_key, 'medium', 'HIGH_FETCH_WAIT', stage_id || '.' || attempt_id FROM sg WHERE run_total >= 60000 AND wait_total::DOUBLE / run_total >= 0.2
  UNION ALL SELECT app_key, 'medium', 'TASK_RUNTIME_SKEW', stage_id || '.' || attempt_id FROM sg WHERE run_max >= 60000 AND run_max / run_median >= 5
  UNION ALL SELECT app_key, 'medium', 'INPUT_SKEW', stage_id || '.' || attempt_id FROM sg WHERE input_max >= 134217728 AND input_max / input_median >= 5
  UNION ALL SELECT app_key, 'medium', 'SHUFFLE_READ_SKEW', stage_id || '.' || attempt_id FROM sg WHERE read_max >= 134217728 AND read_max / read_median >= 5)
"""


def evt(name: str, sql: str):
    return on_tables(name, _TASKS + sql)


# ---- cleaning: lines with envelopes, noise and one corrupt line per file -----------------------


def _raw_lines(t):
    """Seven files of lines in event order: plain, wrapped, noise; line 5000 of the table is cut off."""
    event = F.concat(F.lit('{"Event":"SparkListenerX","User":'), c("user_id").cast("string"), F.lit("}"))
    broken = c("event_id").isin(5000, 7001, 9003)
    value = (F.when(broken, F.lit('{"Event":"SparkListenerX","Us')).when(c("event_id") % 5 == 0, F.to_json(F.struct(event.alias("log"))))
             .when(c("event_id") % 11 == 1, F.lit("INFO started")).otherwise(event))
    return t.events.select(F.lit("app").alias("app_key"), F.concat(F.lit("events_"), (c("event_id") % 7).cast("string")).alias("file"),
                           c("event_id").alias("line_id"), value.alias("value"))


_STOPS = "WITH s AS (SELECT event_id % 7 f, min(event_id) stop FROM events WHERE event_id IN (5000, 7001, 9003) GROUP BY 1), e AS (SELECT *, event_id % 11 = 1 AND event_id % 5 <> 0 AS noise FROM events LEFT JOIN s ON f = event_id % 7)"


@on_tables("evt_01_clean_prefix", _STOPS + """ SELECT 'events_' || event_id % 7 AS file, event_id AS line_id, '{"Event":"SparkListenerX","User":' || user_id || '}' AS value
    FROM e WHERE NOT noise AND (stop IS NULL OR event_id < stop)""")
def clean_prefix(t):
    return E.clean(_raw_lines(t)).select("file", "line_id", "value")


@on_tables("evt_02_cleaning_report", _STOPS + """ SELECT 'events_' || event_id % 7 AS file, count(*) AS input_lines, count(*) FILTER (WHERE NOT noise OR event_id = stop) AS candidates,
    count(*) FILTER (WHERE NOT noise AND event_id IS DISTINCT FROM stop) AS output_events, count(*) FILTER (WHERE noise AND event_id IS DISTINCT FROM stop) AS skipped, max(stop) IS NOT NULL AS corrupt,
    CASE WHEN max(stop) IS NOT NULL THEN count(*) END AS stopped_at_line FROM e WHERE stop IS NULL OR event_id <= stop GROUP BY 1""")
def cleaning_report(t):
    return E.cleaning_report(_raw_lines(t)).drop("app_key")


@on_tables("evt_03_merged_order", "SELECT event_id AS line_id, row_number() OVER (ORDER BY event_id % 7, event_id) AS position FROM events")
def merged_order(t):
    """Files of an application follow each other by number, lines keep their order."""
    merged = E.merged_order(_raw_lines(t)).select("merge_key.number", "merge_key.file", "line_id")
    return with_position(merged, ["number", "file", "line_id"]).select("line_id", "position")


# ---- tables of an event log --------------------------------------------------------------------


@evt("evt_04_event_counts", f"""SELECT app_key, 'SparkListenerTaskStart' AS event, count(*) AS events FROM tk GROUP BY ALL UNION ALL SELECT app_key, 'SparkListenerTaskEnd', count(*) FROM ends GROUP BY ALL
  UNION ALL SELECT app_key, 'SparkListenerStageSubmitted', count(*) FROM sg GROUP BY ALL UNION ALL SELECT app_key, 'SparkListenerStageCompleted', count(*) FROM sg WHERE stage_id <> 3 GROUP BY ALL
  UNION ALL SELECT app_key, e, 1 FROM apps, (VALUES ('SparkListenerLogStart'), ('SparkListenerApplicationStart'), ('SparkListenerEnvironmentUpdate'), ('SparkListenerApplicationEnd')) v(e) WHERE NOT (app_key = 'app-3' AND e LIKE '%End')
  UNION ALL SELECT app_key, 'SparkListenerJobStart', count(*) FROM job GROUP BY ALL UNION ALL SELECT app_key, 'SparkListenerJobEnd', count(*) FROM job WHERE completed IS NOT NULL GROUP BY ALL
  UNION ALL SELECT app_key, '{E.SQL_START}', CASE app_key WHEN 'app-2' THEN 2 ELSE 3 END FROM apps UNION ALL SELECT app_key, '{E.SQL_END}', 2 FROM apps
  UNION ALL SELECT 'app-' || s_suppkey % 4, 'SparkListenerExecutorAdded', count(*) FROM supplier GROUP BY ALL
  UNION ALL SELECT 'app-' || s_suppkey % 4, 'SparkListenerExecutorRemoved', count(*) FROM supplier WHERE s_suppkey % 10 = 0 GROUP BY ALL""")
def event_counts(t):
    return E.event_counts(event_log(t))


@evt("evt_05_applications", f"""SELECT app_key, 'name of ' || app_key AS app_name, 'id-' || app_key AS app_id, 'analyst' AS user, {T0} AS start_ms, CASE WHEN app_key <> 'app-3' THEN {T0} + 7200000 END AS end_ms, '4.1.2' AS spark_version FROM apps""")
def applications(t):
    return E.applications(event_log(t))


@evt("evt_06_jobs", "SELECT app_key, j AS job_id, submitted AS submission_ms, completed AS completion_ms, 4 * j AS first_stage, 4::BIGINT AS stage_count, q AS execution_id, 'group-' || j AS job_group, status FROM job")
def jobs(t):
    return E.jobs(event_log(t)).select("app_key", "job_id", "submission_ms", "completion_ms", c("stage_ids")[0].cast("long").alias("first_stage"),
                                         F.size("stage_ids").cast("long").alias("stage_count"), "execution_id", "job_group", "status")


@evt("evt_07_stage_infos", """SELECT app_key, stage_id, attempt_id, 'stage ' || stage_id AS name, task_starts AS declared, first_launch AS submission_ms, done AS completion_ms,
    CASE WHEN stage_id = 5 THEN 'FetchFailedException: connection lost' END AS failure_reason FROM sg""")
def stage_infos(t):
    return E.stage_infos(event_log(t))


_METRIC_SQL = " UNION ALL ".join(
    f"SELECT app_key, stage_id, attempt_id, '{m}' AS metric, count({m}) AS count, sum({m})::BIGINT AS total, max({m})::BIGINT AS max, median({m}) AS median FROM ends GROUP BY ALL" for m in E.METRICS)


@evt("evt_08_task_metrics", _METRIC_SQL)
def task_metrics(t):
    ends = E.task_ends(event_log(t))
    both = E.stage_totals(ends).join(E.stage_medians(ends), E.STAGE)
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), c(f"{m}_count").alias("count"), c(f"{m}_total").alias("total"), c(f"{m}_max").alias("max"),
                              c(f"{m}_median").alias("median")) for m in E.METRICS])
    return both.select(*E.STAGE, F.explode(rows).alias("r")).select(*E.STAGE, "r.*")


@evt("evt_09_shuffle_read", "SELECT app_key, stage_id, sum(shuffle_read)::BIGINT AS shuffle_read FROM ends GROUP BY ALL")
def shuffle_read(t):
    return E.task_ends(event_log(t)).groupBy("app_key", "stage_id").agg(F.sum("shuffle_read").alias("shuffle_read"))


@evt("evt_10_failed_tasks", "SELECT app_key, stage_id, attempt_id, reason, count(*) AS tasks, (reason NOT IN ('Success', 'TaskCommitDenied')) AS failed FROM ends GROUP BY ALL")
def failed_tasks(t):
    return E.task_ends(event_log(t)).groupBy(*E.STAGE, "reason", "failed").agg(F.count("*").alias("tasks"))


@evt("evt_11_unclosed_starts", """SELECT app_key, stage_id, attempt_id, task_starts, coalesce(tasks, 0) AS tasks, unclosed, first_launch AS first_launch_ms, last_launch AS last_launch_ms,
    list_sum(list_slice(l, 1, 20))::BIGINT AS sample_sum FROM sg JOIN (SELECT app_key, stage_id, attempt_id, list(task ORDER BY launch, task) l FROM tk GROUP BY ALL) USING (app_key, stage_id, attempt_id)""")
def unclosed_starts(t):
    log = event_log(t)
    samples = E.start_samples(log).groupBy(*E.STAGE).agg(F.sum("task_id").alias("sample_sum"))
    table = E.stages(log, with_medians=False)
    return table.select(*E.STAGE, "task_starts", "tasks", "unclosed", "first_launch_ms", "last_launch_ms").join(samples, E.STAGE)


@evt("evt_12_executors", f"""SELECT 'app-' || s_suppkey % 4 AS app_key, s_suppkey::VARCHAR AS executor_id, {T0} + s_suppkey AS added_ms, s_name AS host, CASE WHEN s_suppkey % 10 = 0 THEN {T0 + 1000} + s_suppkey END AS removed_ms,
    CASE WHEN s_suppkey % 20 = 0 THEN 'Container killed by YARN for exceeding memory limits' WHEN s_suppkey % 10 = 0 THEN 'idle' END AS removed_reason, s_suppkey % 10 = 0 AS removed FROM supplier""")
def executors(t):
    return E.executors(event_log(t))


@evt("evt_13_sql_executions", f"""SELECT app_key, x AS execution_id, CASE WHEN NOT (x = 1 AND app_key = 'app-2') THEN 'query ' || x END AS description, CASE WHEN NOT (x = 1 AND app_key = 'app-2') THEN {T0 - 500} + x * 2000 END AS start_ms,
    CASE WHEN x <> 2 THEN {T0 + 600000} + x END AS end_ms, CASE x WHEN 0 THEN 'Executor 7 lost' WHEN 1 THEN '' END AS error_message, CASE WHEN x = 2 THEN 'running' ELSE 'ended' END AS state FROM apps, range(3) g(x)""")
def sql_executions(t):
    return E.sql_executions(event_log(t))


@evt("evt_14_signature_hits", "SELECT app_key, code, source, hits FROM hits")
def signature_hits(t):
    return E.signature_hits(event_log(t))


@evt("evt_14b_signature_examples", f"""SELECT DISTINCT app_key, code, CASE WHEN reason = 'FetchFailed' THEN 'FetchFailed FetchFailedException: missing an output location for shuffle 3'
    WHEN reason = 'ExceptionFailure' THEN 'ExceptionFailure org.apache.spark.SparkException task failed Caused by: java.lang.OutOfMemoryError: Java heap space'
    ELSE 'ExecutorLostFailure Container killed by YARN for exceeding memory limits' END AS example
  FROM ends JOIN (VALUES ('FetchFailed', 'FETCH_FAILED'), ('ExceptionFailure', 'JVM_HEAP_OOM'), ('ExecutorLostFailure', 'EXECUTOR_LOST'), ('ExecutorLostFailure', 'CONTAINER_OOM_OR_137')) v(reason, code) USING (reason)
  UNION ALL SELECT DISTINCT 'app-' || s_suppkey % 4, 'CONTAINER_OOM_OR_137', 'Container killed by YARN for exceeding memory limits' FROM supplier WHERE s_suppkey % 20 = 0
  UNION ALL SELECT app_key, 'EXECUTOR_LOST', '{E.SQL_END} 0 {T0 + 600_000} Executor 7 lost' FROM apps
  UNION ALL SELECT app_key, 'JVM_HEAP_OOM', '{E.SQL_START} 1 query 1 at job Scan after OutOfMemoryError {T0 + 1500}' FROM apps WHERE app_key <> 'app-2'""")
def signature_examples(t):
    return E.signature_examples(event_log(t))


@evt("evt_14c_raw_line_hits", """SELECT app_key, code, 'raw_event_line' AS source, sum(n)::BIGINT AS hits FROM (
    SELECT app_key, code, sum(hits) n FROM hits WHERE source <> 'job_end' GROUP BY ALL
    UNION ALL SELECT app_key, 'FETCH_FAILED', count(*) FROM sg WHERE stage_id = 5 GROUP BY ALL) GROUP BY ALL""")
def raw_line_hits(t):
    """Signatures in the unparsed lines: what the fields hold, and the failure reason of completed stages."""
    log = event_log(t)
    return E.signature_hits(log, E.raw_line_texts(log))


_PLAN_DOC = """'== Physical Plan ==' || chr(10) || 'BroadcastQueryStage 3, Statistics(sizeInBytes=' || (o_orderkey % 9) || '.5 ' || CASE o_orderkey % 3 WHEN 0 THEN 'GiB' WHEN 1 THEN 'MiB' ELSE 'KiB' END || ', rowCount=9)'"""


@on_tables("evt_15_plan_triage", """SELECT o_orderkey AS doc, o_orderkey % 5 = 0 AS container_oom, o_orderkey % 4 = 0 AS fetch_failed, o_orderkey % 12 = 0 AS dead_executor, o_orderkey % 6 = 1 AS heap_oom,
    o_orderkey % 8 = 3 AS direct_memory, 1::INTEGER AS broadcasts_sized, o_orderkey % 3 = 0 AND o_orderkey % 9 + 0.5 >= 0.5 AS large_broadcast, (1 + o_orderkey % 2)::INTEGER AS broadcast_exchanges,
    (o_orderkey % 3)::INTEGER AS reused_exchanges, o_orderkey % 7 = 2 AS zipped_explode, (200 + o_orderkey % 2 * 800)::INTEGER AS fewest_partitions, o_orderkey % 2 = 0 AS few_partitions,
    o_orderkey % 10 = 9 AS coalesced_reads, CASE WHEN o_orderkey % 3 = 1 THEN '4g' END AS memory_overhead FROM orders""")
def plan_triage(t):
    k = c("o_orderkey")
    unit = F.when(k % 3 == 0, "GiB").when(k % 3 == 1, "MiB").otherwise("KiB")
    on = lambda test, text: F.when(test, F.lit(text))
    text = F.concat_ws(
        "\n", F.lit("== Physical Plan =="), F.concat(F.lit("BroadcastQueryStage 3, Statistics(sizeInBytes="), (k % 9).cast("string"), F.lit(".5 "), unit, F.lit(", rowCount=9)")),
        F.lit("BroadcastExchange a"), on(k % 2 == 1, "BroadcastExchange b"), on(k % 3 >= 1, "ReusedExchange c"), on(k % 3 >= 2, "ReusedExchange d"),
        F.concat(F.lit("Exchange hashpartitioning(k#1, "), (200 + k % 2 * 800).cast("string"), F.lit(")")), F.lit("Exchange RoundRobinPartitioning(x, 1000)"),
        on(k % 5 == 0, "Exit code 137"), on(k % 4 == 0, "FetchFailedException"), on(k % 12 == 0, "ExecutorDeadException"), on(k % 6 == 1, "Java heap space"),
        on(k % 8 == 3, "io.netty.util.OutOfDirectMemoryError"), on(k % 7 == 2, "Generate\n explode(arrays_zip(a, b))"), on(k % 10 == 9, "AQEShuffleRead coalesced"),
        on(k % 3 == 1, "spark.executor.memoryOverhead=4g"))
    return E.plan_triage(t.orders.select(k.alias("doc"), text.alias("text")))


@evt("evt_16_health_findings", "SELECT * FROM found WHERE code IN ('APPLICATION_INCOMPLETE', 'FAILED_JOBS', 'FAILED_STAGES') UNION ALL SELECT 'app', 'medium', 'PARSE_ERRORS', '' WHERE EXISTS (FROM events WHERE event_id IN (5000, 7001, 9003)) UNION ALL SELECT 'empty', 'high', 'NO_SPARK_EVENTS', ''")
def health_findings(t):
    log = event_log(t)
    bad = E.cleaning_report(_raw_lines(t)).where(c("corrupt"))
    codes = ("APPLICATION_INCOMPLETE", "FAILED_JOBS", "FAILED_STAGES", "PARSE_ERRORS")
    known = log.lines.select("app_key").unionByName(t.region.select(F.concat(F.lit("empty"), F.substring("r_name", 1, 0)).alias("app_key")))
    return E.findings(log, parse_errors=bad, codes=codes).unionByName(E.empty_logs(known, log))


def _code(name: str, *codes: str):
    listed = ", ".join(f"'{x}'" for x in codes)

    @evt(name, f"SELECT * FROM found WHERE code IN ({listed})")
    def run(t):
        return E.findings(event_log(t), codes=codes)


_code("evt_17_fetch_failed_after_loss", "FETCH_FAILED_AFTER_EXECUTOR_LOSS")
_code("evt_18_starts_without_ends", "TASK_STARTS_WITHOUT_ENDS")
_code("evt_19_failed_task_rate", "HIGH_FAILED_TASK_RATE")
_code("evt_20_stage_spill", "HIGH_STAGE_SPILL")
_code("evt_21_gc_time", "HIGH_GC_TIME")
_code("evt_22_skew", "TASK_RUNTIME_SKEW", "INPUT_SKEW", "SHUFFLE_READ_SKEW")
_code("evt_23_fetch_wait", "HIGH_FETCH_WAIT")

_RULES_SQL = ", ".join(f"({p}, '{s}', '{x}')" for p, s, x in rules.REMEDIATION)


@evt("evt_24_remediation", f"""SELECT DISTINCT app_key, priority, scope FROM found JOIN (VALUES {_RULES_SQL}) r(priority, scope, code) USING (code)
  UNION ALL SELECT DISTINCT app_key, 40, 'failure-triage' FROM found WHERE code IN ('FAILED_JOBS', 'FAILED_STAGES') AND app_key NOT IN (SELECT app_key FROM found JOIN (VALUES {_RULES_SQL}) r(priority, scope, code) USING (code))""")
def remediation(t):
    return E.remediation(E.findings(event_log(t)))


@evt("joi_21_findings_to_scopes", f"SELECT app_key, scope, count(*) AS findings FROM found JOIN (VALUES {_RULES_SQL}) r(priority, scope, code) USING (code) GROUP BY ALL")
def findings_to_scopes(t):
    table = t.spark.createDataFrame([list(r) for r in rules.REMEDIATION], "priority int, scope string, code string")
    return E.findings(event_log(t)).join(F.broadcast(table), "code").groupBy("app_key", "scope").agg(F.count("*").alias("findings"))


_BREAKDOWN_SQL = f"""
, qs AS (SELECT app_key, x q, CASE WHEN NOT (x = 1 AND app_key = 'app-2') THEN {T0 - 500} + x * 2000 END s, CASE WHEN x <> 2 THEN {T0 + 600000} + x END e, x = 0 AS lost FROM apps, range(3) g(x)),
qj AS (SELECT app_key, q, count(*) jobs, count(*) FILTER (WHERE status = 'failed') failed_jobs, count(*) FILTER (WHERE status = 'succeeded') succeeded_jobs, min(submitted) js, max(completed) je FROM job GROUP BY ALL),
qg AS (SELECT app_key, (stage_id // 4) // 2 q, count(DISTINCT stage_id) stages, count(*) stage_attempts, count(*) FILTER (WHERE stage_id = 5) failed_attempts, sum(tasks)::BIGINT tasks, sum(task_starts)::BIGINT started,
    sum(unclosed)::BIGINT unclosed, sum(failed_tasks)::BIGINT failed_tasks, sum(task_starts)::BIGINT declared, sum(run_total)::BIGINT run_ms, count(DISTINCT CASE WHEN attempt_id > 0 THEN stage_id END) retried_stages FROM sg WHERE stage_id < 20 GROUP BY ALL)
SELECT app_key, q AS execution_id, CASE WHEN s IS NULL THEN '' ELSE 'query ' || q END AS description, CASE WHEN failed_jobs > 0 OR lost THEN 'failed' WHEN e IS NOT NULL THEN 'succeeded' ELSE 'running' END AS status,
  CASE WHEN e IS NULL AND je IS NOT NULL THEN CASE WHEN s IS NOT NULL THEN 'sql_execution_start_and_jobs' ELSE 'jobs' END WHEN s IS NOT NULL THEN 'sql_execution' ELSE 'jobs' END AS duration_source,
  CASE WHEN coalesce(e, je) IS NULL THEN 0 ELSE greatest(coalesce(e, je) - coalesce(s, js), 0) END AS duration_ms, jobs, failed_jobs, succeeded_jobs, stages, stage_attempts, failed_attempts, tasks, started, unclosed, failed_tasks, declared,
  run_ms, retried_stages, 0::BIGINT AS task_retries, retried_stages > 0 AS retried
FROM qs JOIN qj USING (app_key, q) LEFT JOIN qg USING (app_key, q)"""


@evt("evt_25_query_breakdown", _BREAKDOWN_SQL)
def query_breakdown(t):
    return E.query_breakdown(event_log(t))


@evt("evt_26_retries", "SELECT app_key, stage_id, count(*) AS attempts, (count(*) > 1 OR max(attempt_id) > 0) AS retried FROM sg GROUP BY ALL HAVING count(*) > 1 OR max(attempt_id) > 0")
def retries(t):
    per = E.stage_infos(event_log(t)).groupBy("app_key", "stage_id").agg(F.count("*").alias("attempts"), F.max("attempt_id").alias("last"))
    return per.withColumn("retried", (c("attempts") > 1) | (c("last") > 0)).where(c("retried")).drop("last")


@evt("evt_27_application_summary", f""", f AS (SELECT app_key, count(*) findings, min(list_position(['critical', 'high', 'medium', 'low', 'info'], severity) - 1)::INTEGER severity_rank, count(*) FILTER (WHERE severity = 'critical') critical,
    count(*) FILTER (WHERE severity = 'high') high, count(*) FILTER (WHERE severity = 'medium') medium, count(*) FILTER (WHERE severity = 'low') low FROM found GROUP BY ALL),
x AS (SELECT 'app-' || s_suppkey % 4 app_key, count(*) executors, count(*) FILTER (WHERE s_suppkey % 10 = 0) removed_executors FROM supplier GROUP BY ALL),
s AS (SELECT app_key, count(*) stage_attempts, sum(tasks)::BIGINT tasks, sum(task_starts)::BIGINT started, sum(unclosed)::BIGINT unclosed, sum(failed_tasks)::BIGINT failed_tasks FROM sg GROUP BY ALL)
SELECT app_key, CASE WHEN app_key <> 'app-3' THEN 7200000 ELSE 0 END::BIGINT AS duration_ms, stage_attempts, tasks, started, unclosed, failed_tasks, 5::BIGINT AS jobs, 1::BIGINT AS failed_jobs, executors, removed_executors,
  findings, severity_rank, critical, high, medium, low FROM s JOIN x USING (app_key) JOIN f USING (app_key)""")
def application_summary(t):
    return E.application_summary(event_log(t)).orderBy("severity_rank", "app_key").select(
        "app_key", "duration_ms", "stage_attempts", "tasks", "started", "unclosed", "failed_tasks", "jobs", "failed_jobs", "executors", "removed_executors",
        "findings", "severity_rank", "critical", "high", "medium", "low")


@evt("evt_28_two_pass_tasks", "SELECT app_key, stage_id, attempt_id, count(*) AS tasks, sum(run_ms)::BIGINT AS run_ms FROM ends WHERE stage_id = 5 OR (app_key, stage_id, attempt_id) IN (SELECT app_key, stage_id, attempt_id FROM ends WHERE reason IN ('FetchFailed', 'ExceptionFailure', 'ExecutorLostFailure')) GROUP BY ALL")
def two_pass_tasks(t):
    return E.two_pass_tasks(event_log(t)).groupBy(*E.STAGE).agg(F.count("*").alias("tasks"), F.sum("run_ms").alias("run_ms"))


@evt("evt_29_qualification_rows", """SELECT app_key AS app, stage_id::BIGINT AS stage, run_total AS duration, rank() OVER (PARTITION BY app_key ORDER BY run_total DESC, stage_id) AS place, unsupported FROM
    (SELECT app_key, stage_id, sum(run)::BIGINT run_total, count(*) FILTER (WHERE n = 1 OR n = 2) unsupported FROM tk GROUP BY ALL)""")
def qualification_rows(t):
    """Stage and operator CSV files of a qualification run: longest stages and unsupported rows per application."""
    path = scratch(t.spark, "qualification")
    rows = tasks(t.lineitem)
    rows.groupBy(c("app").alias("App ID"), c("stage").alias("Stage ID")).agg(F.sum("run").alias("Stage Task Duration")).write.option("header", True).csv(f"{path}/stages")
    supported = F.when(c("l_linenumber") == 1, "false").when(c("l_linenumber") == 2, " No ").otherwise("true")
    rows.select(c("app").alias("App ID"), c("stage").alias("Exec Stages"), supported.alias("Exec Is Supported"), F.lit("NONE").alias("Action")).write.option("header", True).csv(f"{path}/execs")
    return E.qualification(read_csv(t.spark, f"{path}/stages"), read_csv(t.spark, f"{path}/execs"))


@evt("evt_30_property_selection", "SELECT app_key, key, value FROM apps, (VALUES ('spark.executor.cores', '4'), ('spark.app.name', 'x')) v(key, value)")
def property_selection(t):
    return E.spark_properties(event_log(t))


@on_tables("evt_31_marker_seconds", "SELECT event_id, (event_id % 50)::BIGINT + 3600 * (event_id % 3) AS seconds FROM events")
def marker_seconds(t):
    """Start and end marker lines in file order; whole hours count, too."""
    stamp = lambda kind, when: F.concat(F.lit(kind), F.lit(","), F.date_format(when, "yyyy-MM-dd HH:mm:ss"))
    begin = c("ts").cast("timestamp")
    end = F.timestamp_seconds(F.unix_timestamp(begin) + c("event_id") % 50 + 3600 * (c("event_id") % 3))
    lines = t.events.select("event_id", F.posexplode(F.array(stamp("querystart", begin), stamp("queryend", end))).alias("half", "value"))
    placed = with_position(lines, ["event_id", "half"])
    part = F.split("value", ",")
    read = placed.select("position", "event_id", part[0].alias("kind"), F.to_timestamp(part[1]).alias("at"))
    starts = read.where(c("kind") == "querystart").select((c("position") + 1).alias("position"), c("at").alias("begin"))
    return read.where(c("kind") == "queryend").join(starts, "position").select("event_id", elapsed_seconds(c("begin"), c("at")).alias("seconds"))


@evt("job_16_event_log_report", f"""SELECT app_key, severity, code, count(*) AS findings, coalesce(max(scope), 'none') AS scope
    FROM (FROM found UNION ALL SELECT 'app-1', 'medium', 'PARSE_ERRORS', '') all_found
    LEFT JOIN (VALUES {_RULES_SQL}) r(priority, scope, code) USING (code) GROUP BY ALL""")
def event_log_report(t):
    """Read, clean, organise, find and remedy: findings per application, severity and code with the scope that takes them up."""
    scopes = t.spark.createDataFrame([(s, x) for _, s, x in rules.REMEDIATION], "scope string, code string")
    log = event_log(t)
    found = E.findings(log, parse_errors=log.tables["corrupt"]).groupBy("app_key", "severity", "code").agg(F.count("*").alias("findings"))
    return found.join(F.broadcast(scopes), "code", "left").withColumn("scope", F.coalesce("scope", F.lit("none")))
