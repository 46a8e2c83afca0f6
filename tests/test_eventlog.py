"""The diagnosis on small hand-written logs."""

import json

from tallyforge.eventlog import events as E
from tallyforge.eventlog import rules


def _log(spark, events, app="app"):
    lines = [e if isinstance(e, str) else json.dumps(e, separators=(",", ":")) for e in events]
    return spark.createDataFrame([(app, "events_1", i, line) for i, line in enumerate(lines, 1)], "app_key string, file string, line_id long, value string")


def _base():
    return [{"Event": "SparkListenerLogStart", "Spark Version": "3.5.0"},
            {"Event": "SparkListenerApplicationStart", "App Name": "job", "App ID": "app-1", "Timestamp": 1000, "User": "u"},
            {"Event": "SparkListenerEnvironmentUpdate", "Environment Details": {"Spark Properties": {"spark.executor.memory": "8g", "other": "x"}}}]


def _info(stage, attempt=0, tasks=2, failure=None, done=5000):
    info = {"Stage ID": stage, "Stage Attempt ID": attempt, "Stage Name": f"s{stage}", "Number of Tasks": tasks, "Submission Time": 2000, "Completion Time": done}
    return {**info, "Failure Reason": failure} if failure else info


def _task(stage, attempt=0, reason=None, run=1000, spill=0):
    return {"Event": "SparkListenerTaskEnd", "Stage ID": stage, "Stage Attempt ID": attempt, "Task End Reason": reason or {"Reason": "Success"},
            "Task Metrics": {"Executor Run Time": run, "JVM GC Time": 10, "Memory Bytes Spilled": spill, "Disk Bytes Spilled": 0, "Peak Execution Memory": 1,
                             "Input Metrics": {"Bytes Read": 10}, "Shuffle Read Metrics": {"Total Bytes Read": 0, "Remote Bytes Read": 3, "Local Bytes Read": 4, "Fetch Wait Time": 0},
                             "Shuffle Write Metrics": {"Shuffle Bytes Written": 5}}}


def _start(stage, task):
    return {"Event": "SparkListenerTaskStart", "Stage ID": stage, "Stage Attempt ID": 0, "Task Info": {"Task ID": task, "Launch Time": 3000 + task, "Executor ID": "1", "Host": "h"}}


def _oom_events():
    fetch = {"Reason": "FetchFailed", "Message": "org.apache.spark.shuffle.FetchFailedException: failed"}
    return [*_base(), {"Event": "SparkListenerJobStart", "Job ID": 7, "Submission Time": 1500, "Stage IDs": [3], "Properties": {"spark.sql.execution.id": "42"}},
            {"Event": E.SQL_START, "executionId": 42, "description": "q", "details": "", "time": 1400},
            {"Event": "SparkListenerExecutorAdded", "Executor ID": "9", "Timestamp": 1100, "Executor Info": {"Host": "h"}},
            {"Event": "SparkListenerStageCompleted", "Stage Info": _info(3, 0, 1, "FetchFailedException: gone")}, _task(3, 0, fetch, spill=2 << 30),
            {"Event": "SparkListenerExecutorRemoved", "Executor ID": "9", "Timestamp": 1200, "Removed Reason": "ExecutorDeadException: container OOMKilled, exit code 137, executor lost"},
            {"Event": "SparkListenerStageCompleted", "Stage Info": _info(3, 1, 1)}, _task(3, 1),
            {"Event": E.SQL_END, "executionId": 42, "time": 9000}, {"Event": "SparkListenerJobEnd", "Job ID": 7, "Completion Time": 8000, "Job Result": {"Result": "JobSucceeded"}},
            {"Event": "SparkListenerApplicationEnd", "Timestamp": 10000}]


def test_memory_loss_is_told_from_its_symptoms(spark):
    log = E.EventLog(_log(spark, _oom_events()))
    found = E.findings(log)
    codes = {r.code for r in found.collect()}
    assert {"FETCH_FAILED", "EXECUTOR_LOST", "FETCH_FAILED_AFTER_EXECUTOR_LOSS", "CONTAINER_OOM_OR_137", "HIGH_STAGE_SPILL", "FAILED_STAGES"} <= codes
    assert {"oom-resolution", "shuffle-recovery", "resource-pressure"} <= {r.scope for r in E.remediation(found).collect()}
    query = E.query_breakdown(log).collect()[0]
    assert (query.execution_id, query.jobs, query.stages, query.stage_attempts, query.tasks, query.retried) == (42, 1, 1, 2, 2, True)
    assert (query.status, query.duration_source, query.duration_ms) == ("succeeded", "sql_execution", 7600)


def test_starts_without_ends(spark):
    events = [*_base(), {"Event": "SparkListenerStageSubmitted", "Stage Info": _info(1, tasks=12, done=None)}, *[_start(1, i) for i in range(12)]]
    log = E.EventLog(_log(spark, events))
    stage = E.stages(log, with_medians=False).collect()[0]
    assert (stage.task_starts, stage.tasks, stage.unclosed) == (12, 0, 12)
    found = {(r.code, r.severity) for r in E.findings(log).collect()}
    assert {("TASK_STARTS_WITHOUT_ENDS", "high"), ("APPLICATION_INCOMPLETE", "low")} <= found
    assert "write-stall-triage" in {r.scope for r in E.remediation(E.findings(log)).collect()}


def test_large_logs_parse_only_suspect_stages(spark):
    oom = {"Reason": "ExceptionFailure", "Class Name": "java.lang.OutOfMemoryError", "Description": "Java heap space"}
    events = [*_base(), {"Event": "SparkListenerStageCompleted", "Stage Info": _info(1)}, {"Event": "SparkListenerStageCompleted", "Stage Info": _info(2, failure="Java heap space")},
              _task(1), _task(1), _task(2, reason=oom), _task(2)]
    log = E.EventLog(_log(spark, events))
    assert [(r.stage_id, r.attempt_id) for r in E.deep_stages(log).collect()] == [(2, 0)]
    assert {r.stage_id for r in E.two_pass_tasks(log).collect()} == {2} and E.two_pass_tasks(log).count() == 2


def test_everything_after_a_corrupt_line_is_left_out(spark):
    good = '{"Event":"SparkListenerLogStart","Spark Version":"3.5.0"}'
    lines = [good, "noise", json.dumps({"log": good}), '{"Event":"Broken', good]
    frame = _log(spark, lines)
    assert [r.line_id for r in E.clean(frame).orderBy("line_id").collect()] == [1, 3]
    report = E.cleaning_report(frame).collect()[0]
    assert (report.input_lines, report.candidates, report.output_events, report.skipped, report.stopped_at_line) == (4, 3, 2, 1, 4)
    parse = E.findings(E.EventLog(E.clean(frame)), parse_errors=E.cleaning_report(frame).where("corrupt"))
    assert {r.code for r in parse.collect()} == {"PARSE_ERRORS"}


def test_no_plan_for_plain_failures_but_the_fallback(spark):
    events = [*_base(), {"Event": "SparkListenerApplicationEnd", "Timestamp": 2000}, {"Event": "SparkListenerJobStart", "Job ID": 1, "Submission Time": 1, "Stage IDs": []},
              {"Event": "SparkListenerJobEnd", "Job ID": 1, "Completion Time": 2, "Job Result": {"Result": "JobFailed", "Exception": "division by zero"}}]
    found = E.findings(E.EventLog(_log(spark, events)))
    assert [(r.priority, r.scope) for r in E.remediation(found).collect()] == [(40, "failure-triage")]


def test_shuffle_read_falls_back_to_its_parts(spark):
    ends = E.task_ends(E.EventLog(_log(spark, [_task(1)]))).collect()[0]
    assert ends.shuffle_read == 7


def test_organised_log_gives_the_same_tables(spark):
    frame = _log(spark, _oom_events())
    plain, stored = E.EventLog(frame), E.EventLog.organise(frame)
    rows = lambda f: sorted(map(tuple, f.collect()), key=repr)
    for table in (E.findings, E.query_breakdown, E.jobs, E.executors, E.signature_hits, E.application_summary):
        assert rows(table(plain)) == rows(table(stored))


def test_every_signature_pattern_holds_an_anchor():
    for _, patterns in rules.SIGNATURES.values():
        for pattern in patterns:
            literal = pattern.replace("\\b", "").replace("(?:ed|ing)", "").lower()
            assert any(anchor in literal for anchor in rules.ANCHORS), pattern


def test_one_pass_over_a_line_tells_that_it_holds_no_signature(spark):
    """Each signature passes in either case, an ordinary task's lines don't, and no line is lower-cased before that."""
    from re import search

    for _, patterns in rules.SIGNATURES.values():
        for pattern in patterns:
            text = pattern.replace("\\b", "").replace("(?:ed|ing)", "ing").replace("(?:killed|kill)", "kill").replace(".*", " of ")
            assert search(pattern, text) and search(rules.PIECE, text) and search(rules.PIECE, f"A {text.upper()}."), pattern
    assert not any(search(rules.PIECE, line) for line in map(json.dumps, [_task(1), _start(1, 0)]))
    plan = E.raw_line_texts(E.EventLog(_log(spark, [*_base(), _task(1)])))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("RLIKE") < plan.index("lower(") < plan.index("Generate") and "Contains" not in plan


def test_signatures_are_found_in_every_field(spark):
    lost = {"Reason": "ExecutorLostFailure", "Executor ID": "4", "Loss Reason": "Container killed by YARN for exceeding memory limits"}
    deep = {"Reason": "ExceptionFailure", "Class Name": "x.Y", "Full Stack Trace": "at a\nCaused by: java.lang.OutOfMemoryError: Java heap space"}
    events = [*_base(), _task(1, reason=lost), _task(2, reason=deep),
              {"Event": E.SQL_START, "executionId": 1, "description": "q", "physicalPlanDescription": "Netty ran out of native memory", "time": 1}]
    log = E.EventLog.organise(_log(spark, events))
    hits = {(r.code, r.source) for r in E.signature_hits(log).collect()}
    assert hits == {("EXECUTOR_LOST", "task_end_reason"), ("CONTAINER_OOM_OR_137", "task_end_reason"), ("JVM_HEAP_OOM", "task_end_reason"), ("DIRECT_OR_NATIVE_MEMORY", "sql_execution_start")}
    raw = {(r.code, r.source) for r in E.signature_hits(log, E.raw_line_texts(log)).collect()}
    assert {code for code, _ in raw} >= {code for code, _ in hits} and {source for _, source in raw} == {"raw_event_line"}
    examples = {r.example for r in E.signature_examples(log).collect()}
    assert any("Loss" not in x and "exceeding memory limits" in x for x in examples) and E.signature_examples(log, 1).count() <= 4


def test_raw_lines_are_lowered_once_before_the_patterns(spark):
    events = [*_base(), _task(1), _task(2, reason={"Reason": "ExceptionFailure", "Class Name": "JAVA.LANG.OUTOFMEMORYERROR"}), {"Event": "SparkListenerX", "Text": None}]
    log = E.EventLog(_log(spark, events).unionByName(_log(spark, ["lost, but no event"], "other")))
    raw = E.raw_line_texts(log)
    assert [r.source for r in raw.collect()] == ["raw_event_line"]
    plan = raw.where("text rlike '(?i)outofmemory'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1 and plan.index("RLIKE") < plan.index("Generate")  # the pattern is a condition behind the explode
    assert "rlike" not in plan[plan.index("Generate"):].lower()
    assert [r.stage_id for r in E.deep_stages(log).collect()] == [2]


def test_long_texts_stay_whole_and_all_suspect_stages_are_parsed(spark):
    reason = "lost " + "x" * 2000
    events = [*_base(), {"Event": "SparkListenerExecutorAdded", "Executor ID": "9", "Timestamp": 1, "Executor Info": {"Host": "h"}},
              {"Event": "SparkListenerExecutorRemoved", "Executor ID": "9", "Timestamp": 2, "Removed Reason": reason}]
    for stage in range(70):
        events += [{"Event": "SparkListenerStageCompleted", "Stage Info": _info(stage, failure="y" * 900)}, _task(stage)]
    log = E.EventLog(_log(spark, events))
    assert E.executors(log).first()["removed_reason"] == reason
    assert E.deep_stages(log).count() == 70 and E.two_pass_tasks(log).count() == 70
    assert {len(r.failure_reason) for r in E.stage_infos(log).collect()} == {900}


def test_findings_by_code_are_those_of_all_rules(spark):
    log = E.EventLog(_log(spark, _oom_events()))
    whole = sorted(map(tuple, E.findings(log).collect()))
    for code in {row[2] for row in whole}:
        assert sorted(map(tuple, E.findings(log, codes=(code,)).collect())) == [row for row in whole if row[2] == code]


def test_lines_are_not_shuffled_and_the_written_log_is_short(spark, tmp_path):
    from tallyforge.eventlog import from_tables
    from tallyforge.session import work_dir
    from tallyforge.sources.tables import Tables

    frame = _log(spark, ['{"Event":"A"}', '{"Event":"B', '{"Event":"C"}'])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as with a log whose size Spark can't tell
    try:
        for table in (E.clean, E.cleaning_report):
            assert "SortMergeJoin" not in table(frame)._jdf.queryExecution().executedPlan().toString()
        assert [r.line_id for r in E.clean(frame).collect()] == [1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

    def table(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    flat = lambda prefix: f"{prefix}key long"
    for name in ("nation", "customer", "part", "orders"):
        table(name, [(1,)], flat(name[0]))
    table("region", [(1,)], "r_regionkey long")
    table("supplier", [(k, "s") for k in range(1, 5)], "s_suppkey long, s_name string")
    table("lineitem", [(o, p, p % 4, n, float(n), 1.0, "A", "O") for o in range(50) for n, p in ((1, o), (2, o + 81))],
          "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_tax double, l_returnflag string, l_linestatus string")
    before = from_tables.FILE_LINES
    from_tables.FILE_LINES = 20
    try:
        log = from_tables.event_log(Tables(spark, str(tmp_path)))
        sources = spark.read.text(f"{work_dir(spark)}/eventlog-*/app=*").selectExpr("_metadata.file_path AS file").groupBy("file").count().collect()
    finally:
        from_tables.FILE_LINES = before
    assert log.lines.where("event = 'SparkListenerTaskEnd'").count() == 100
    assert all(r.file.endswith(".gz") and r["count"] <= 20 for r in sources)
    assert all(".zstd." in f for f in log.lines.inputFiles())


def test_only_corrupt_files_are_parsed_again(spark):
    good, bad = '{"Event":"SparkListenerLogStart","Spark Version":"3.5.0"}', '{"Event":"Broken'
    texts = {"events_1": [good, json.dumps({"log": good}), "noise", good], "events_2": [good, bad, good, bad], "events_3": ['{"log" broken', good], "events_4": [good, "", good]}
    rows = [("app", file, i, text) for file, some in texts.items() for i, text in enumerate(some, 1)]
    frame = spark.createDataFrame(rows, "app_key string, file string, line_id long, value string")
    corrupt = E.corrupt_files(frame)
    assert {r.file for r in corrupt.collect()} == {"events_2", "events_3"}
    for table in (E.clean, E.cleaning_report):
        assert sorted(map(tuple, table(frame, corrupt).collect()), key=repr) == sorted(map(tuple, table(frame).collect()), key=repr)
    unchecked = frame.limit(0).select("app_key", "file")  # no file is named, so no line's JSON is checked
    assert E.clean(frame, unchecked).where("file = 'events_2'").count() == 4


def test_lines_are_not_sorted_to_be_stored_by_event(spark, monkeypatch):
    from pyspark.sql import DataFrameWriter

    key, seen, plain = "spark.sql.maxConcurrentOutputFileWriters", [], DataFrameWriter.partitionBy
    before = spark.conf.get(key)
    monkeypatch.setattr(DataFrameWriter, "partitionBy", lambda self, *names: seen.append(int(spark.conf.get(key))) or plain(self, *names))
    log = E.EventLog.organise(_log(spark, _oom_events()))
    assert seen == [64] and spark.conf.get(key) == before
    assert log.lines.count() == len(_oom_events())
    assert all(".zstd." in f for f in E.task_ends(log).inputFiles())


def test_a_raw_log_is_read_once_and_gives_the_clean_rows(spark, tmp_path):
    from tallyforge.sources.files import read_lines

    good, bad = [json.dumps(e, separators=(",", ":")) for e in _oom_events()], '{"Event":"SparkListenerTaskEnd","Sta'
    texts = {"events_1": [*good, json.dumps({"log": good[0]}), "noise", "", good[1]], "events_2": [good[0], "noise", bad, *good, bad], "events_3": ['{"log" broken', good[2]],
             "events_4": ["noise", json.dumps({"log": ""}), '{"Event":5}', json.dumps({"log": bad})], "events_5": [""]}
    for file, lines in texts.items():
        (tmp_path / "app").mkdir(exist_ok=True)
        (tmp_path / "app" / file).write_text("\n".join(lines))
    frame = read_lines(spark, str(tmp_path))
    rows = lambda f: sorted(map(tuple, f.collect()), key=repr)
    log, plain = E.EventLog.read(frame), E.EventLog(E.clean(frame))
    fields = ["app_key", "file", "line_id", "value"]
    assert rows(log.lines.select(fields)) == rows(plain.lines.select(fields)) and log.lines.count() == len(good) + 4
    assert rows(log.tables["corrupt"]) == rows(E.cleaning_report(frame).where("corrupt")) and log.tables["corrupt"].count() == 3
    assert not any("events_" in f.rsplit("/", 1)[1] for f in log.lines.inputFiles())  # the text is not read again
    for table in (E.findings, E.query_breakdown, E.application_summary):
        assert rows(table(log)) == rows(table(plain))


def test_a_line_is_parsed_once(spark):
    log = E.EventLog(_log(spark, _oom_events()).localCheckpoint())
    for table in (E.task_ends, E.task_starts):
        assert table(log)._jdf.queryExecution().executedPlan().toString().count("from_json(") == 1
