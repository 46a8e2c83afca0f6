"""Functions, sources, versioned datasets, models and plans on small inputs."""

import re
import string
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyforge.catalogue import QUERIES
from tallyforge.functions import scalar as S
from tallyforge.ml import jobs as ml
from tallyforge.operators.aggregates import sum_numeric
from tallyforge.operators.projection import level_of
from tallyforge.plans.mart import load_star_schema, open_mart
from tallyforge.session import scratch, shared_dir, work_dir
from tallyforge.sources import files
from tallyforge.sources import versioned as V

c = F.col
SF = "/root/testdata/sf0.001"


def test_punctuation_equals_its_pandas_twin(spark):
    pattern = re.compile("[" + re.escape(string.punctuation) + "0-9\\r\\t\\n]")

    @F.pandas_udf("string")
    def twin(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: pattern.sub(" ", x))

    texts = spark.read.parquet(f"{SF}/documents.parquet").select("text")
    assert texts.where(S.remove_punctuation(c("text")) != twin("text")).count() == 0


def test_small_functions(spark):
    one = spark.range(1)
    get = lambda column: one.select(column.alias("x")).first().x
    assert get(S.size_to_bytes(F.lit("read 2.5 GiB"))) == 2.5 * 2**30
    assert get(S.size_to_bytes(F.lit("nothing"))) is None
    assert [get(S.bytes_to_text(F.lit(v))) for v in (512, 1280, 3 << 30, 5 << 52)] == ["512 B", "1.2 KiB", "3.0 GiB", "20.0 PiB"]
    assert [get(S.millis_to_text(F.lit(v))) for v in (999, 1500, 119_999, 120_000, 7_200_000)] == ["999 ms", "1.5 s", "120.0 s", "2.0 min", "2.0 hr"]
    assert [get(S.tolerant_int(F.lit(v), 9)) for v in ("12", "12.9", "-3", "x")] == [12, 12, -3, 9]
    assert get(S.millis_to_iso(F.lit(0).cast("long"))) is None
    assert get(S.nested_text(F.lit('{"a":"x: y","b":{"c":[1,true,"z"]}}'))) == "x: y 1 true z"
    assert get(S.nested_text(F.lit('{"a":"abcdef"}'), 3)) == "abc"
    assert get(S.shorten(F.lit("a \n b"), 10)) == "a b" and get(S.shorten(F.lit("x" * 30), 10)) == "xxxxxxx..."


def test_levels_overlap_at_thirty_and_miss_below_ten(spark):
    rows = spark.createDataFrame([(v,) for v in (5.0, 10.0, 30.0, 60.0, 61.0)], "v double")
    tests = level_of(c("v"))
    got = {r.v: {n for n in tests if r[n]} for r in rows.select("v", *[t.alias(n) for n, t in tests.items()]).collect()}
    assert got == {5.0: set(), 10.0: {"RED"}, 30.0: {"RED", "YELLOW"}, 60.0: {"YELLOW"}, 61.0: {"GREEN"}}


def test_flatten_keeps_rows_without_elements(spark):
    rows = spark.read.json(spark.sparkContext.parallelize(['{"id":1,"a":{"b":{"c":2}},"l":[{"x":1},{"x":2}]}', '{"id":2}']))
    got = S.flatten(rows).select("id", "a_b_c", "l_x").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, 2, 1), (1, 2, 2), (2, None, None)], key=repr)


def test_sum_numeric_leaves_text_out(spark):
    rows = spark.createDataFrame([("a", "1", 2), ("a", "3", 4)], "k string, t string, n int")
    assert sum_numeric(rows, "k").columns == ["k", "n"]


def test_read_lines_gives_folder_file_and_order(spark):
    path = scratch(spark, "lines")
    spark.range(50).select(F.lit("a1").alias("app"), c("id").cast("string").alias("value")).coalesce(1).write.partitionBy("app").text(path)
    rows = files.read_lines(spark, path).orderBy("line_id").collect()
    assert [r.value for r in rows] == [str(i) for i in range(50)] and {r.app_key for r in rows} == {"app=a1"}


def test_a_cluster_needs_a_shared_folder_and_work_can_be_removed(spark):
    class Far:
        class conf:
            get = staticmethod(lambda key, default=None: None)

        class sparkContext:
            master, getCheckpointDir = "spark://far:7077", staticmethod(lambda: None)

    with pytest.raises(ValueError):
        shared_dir(Far)
    assert work_dir(spark).startswith(shared_dir(spark)) and scratch(spark, "x").startswith(work_dir(spark))


def test_database_options_leave_out_what_is_not_given():
    assert files.jdbc_options("jdbc:x", user="u", fetchsize="10") == {"url": "jdbc:x", "user": "u", "fetchsize": "10"}


def test_versions(spark):
    path, day = scratch(spark, "versions"), lambda n: datetime(2024, 1, n)
    assert V.history(spark, path).count() == 0
    part = lambda lo, hi: spark.range(lo, hi)
    done = [V.write_version(part(0, 5), path, day(1)), V.write_version(part(5, 8), path, day(2)), V.write_version(part(8, 10), path, day(3), "overwrite")]
    assert done == [0, 1, 2]
    assert V.read(spark, path).count() == 2 and V.read(spark, path, 1).count() == 8 and V.version_at(spark, path, datetime(2024, 1, 1, 12)) == 0
    with pytest.raises(ValueError):
        V.version_at(spark, path, datetime(2023, 1, 1))
    V.write_version(part(10, 20).withColumn("more", c("id") * 2), path, day(4))
    V.compact(spark, path, day(5), c("id") >= 10)
    assert sorted(r.id for r in V.read(spark, path).collect()) == list(range(8, 20))
    assert V.read(spark, path).where("more is not null").count() == 10 and V.read(spark, path, 3).count() == 12
    assert V.between(spark, path, 2, 4).count() == 10
    assert sorted(r.version for r in V.unreferenced(spark, path, datetime(2025, 1, 1)).collect()) == [0, 1, 3]


def test_compacted_partitions_take_appends(spark):
    path, day = scratch(spark, "versions"), lambda n: datetime(2024, 1, n)
    rows = spark.range(20).withColumn("k", c("id") % 3)
    for n in (1, 2):
        V.write_version(rows, path, day(n), partition_by=("k",))
    V.compact(spark, path, day(3), partition_by=("k",))
    V.write_version(rows, path, day(4), partition_by=("k",))
    assert V.read(spark, path).count() == 60 and V.files(spark, path).agg({"records": "sum"}).first()[0] == 60


def scanned_files(frame):
    """Files that the scan of versioned rows listed, from the metrics of a plan that has run."""
    frame.collect()
    text = lambda node: node.getClass().getSimpleName()
    stack, found = [frame._jdf.queryExecution().executedPlan()], []
    while stack:
        node = stack.pop()
        if text(node) == "AdaptiveSparkPlanExec":
            stack.append(node.executedPlan())
        elif text(node).endswith("QueryStageExec"):
            stack.append(node.plan())
        elif text(node) == "FileSourceScanExec" and "/rows" in node.relation().location().rootPaths().toString():
            found.append(node.metrics().apply("numFiles").value())
        children = node.children()
        stack += [children.apply(k) for k in range(children.size())]
    return sum(found)


def test_statistics_come_from_the_footers(spark):
    path, day = scratch(spark, "versions"), lambda n: datetime(2024, 1, n)
    rows = spark.range(400).select("id", (c("id") % 7).cast("double").alias("x"), F.lit("s").alias("s"), F.expr("IF(id % 2 = 0, NULL, DATE'2024-01-01' + CAST(id AS INT))").alias("d"))
    V.write_version(rows.repartitionByRange(8, "id"), path, day(1))
    folder, schema = f"{path}/rows/version=0", V._merged(spark, path).add("slice", "string")
    with V.footers(spark):
        plan = V.file_statistics(spark, folder, schema, ["slice"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*), MIN(id), MAX(id)" in plan and "PushedGroupBy: [slice]" in plan
    kept_now = {r.slice: r for r in V.statistics(spark, path, "id", "x", "d").collect()}
    plain = V.rows(spark, path).groupBy("slice").agg(F.count("*").alias("records"), *[f(n).alias(f"{m}_{n}") for n in ("id", "x", "d") for f, m in ((F.min, "min"), (F.max, "max"))])
    assert len(kept_now) == 8 and {r.slice: tuple(r) for r in plain.collect()} == {k: tuple(v) for k, v in kept_now.items()}
    assert all(r.bytes > 0 for r in V.files(spark, path).collect())
    assert scanned_files(V.read(spark, path)) == 8 and scanned_files(V.read_between(spark, path, "id", 10, 40)) == 1
    assert sorted(r.id for r in V.read_between(spark, path, "id", 45, 55).collect()) == list(range(45, 56))


def test_columns_without_ranges_are_read_instead(spark):
    """NaN has no place in a footer's range; nulls alone give none; texts have none."""
    path = scratch(spark, "versions")
    rows = spark.createDataFrame([(1, float("nan"), None, "a"), (2, 5.0, None, "b")], "id int, x double, n int, s string").coalesce(1)
    V.write_version(rows, path, datetime(2024, 1, 1))
    row = V.statistics(spark, path, "id", "x", "n").first()
    assert (row.records, row.min_id, row.max_id, row.min_x, str(row.max_x), row.min_n) == (2, 1, 2, 5.0, "nan", None)
    assert V.read_between(spark, path, "x", 4.0, 6.0).count() == 1 and V.read_between(spark, path, "s", "a", "a").count() == 1
    assert V.read_between(spark, path, "n", 0, 9).count() == 0
    V.write_version(rows.limit(0), path, datetime(2024, 1, 2))
    assert V.read(spark, path).count() == 2 and [r.records for r in V.history(spark, path).orderBy("version").collect()] == [2, 0]
    with pytest.raises(ValueError):
        V.write_version(rows.withColumn("id", F.lit("text")), path, datetime(2024, 1, 3))


def test_compaction_to_a_target_size(spark):
    path, day = scratch(spark, "versions"), lambda n: datetime(2024, 1, n)
    rows = spark.range(60_000).select("id", F.xxhash64("id").alias("x"), (c("id") % 2).cast("int").alias("k"))
    V.write_version(rows.where("id < 40000").repartition(20, "id"), path, day(1), partition_by=("k",))
    V.write_version(rows.where("id >= 40000").repartition(2, "id"), path, day(2), partition_by=("k",))
    before = {r.slice: r for r in V.files(spark, path).collect()}
    small = [r.bytes for r in before.values() if r.version == 0]
    target = 4 * max(small)
    version = V.compact(spark, path, day(3), c("id") < 40000, ("k",), target)
    after = {r.slice: r for r in V.files(spark, path).collect()}
    new = [r for r in after.values() if r.version == version]
    assert all(after[s] == before[s] for s in before if before[s].version == 1)
    for part in {r.part for r in new}:
        sizes = sorted(r.bytes for r in new if r.part == part)
        assert len(sizes) >= 4 and all(0.5 * target <= b <= 1.5 * target for b in sizes[1:])
    assert sorted(r.id for r in V.read(spark, path).collect()) == list(range(60_000)) and V.read(spark, path, 0).count() == 40_000
    assert V.compact(spark, path, day(4), c("id") < 0, ("k",), target) is None
    assert V.compact(spark, path, day(4), None, ("k",), 100) is None  # all files are over the target


def test_a_broken_write_leaves_nothing_behind(spark):
    path = scratch(spark, "versions")
    V.write_version(spark.range(5), path, datetime(2024, 1, 1))
    V._write_rows(spark.range(50), path, 1, F.lit("p0"), ())  # stopped before its version was noted
    spark.range(3).select(F.lit("v0p0").alias("slice")).coalesce(1).write.parquet(f"{path}/slices/version=1/kind=removed")
    assert V.read(spark, path).count() == 5
    V.write_version(spark.range(5, 8), path, datetime(2024, 1, 2))
    assert sorted(r.id for r in V.read(spark, path).collect()) == list(range(8))


def test_half_a_load_is_never_read(spark):
    star = open_mart(spark, SF)
    assert star.path.startswith(shared_dir(spark))
    again = open_mart(spark, SF)
    assert again.path == star.path  # published once, reused
    other = scratch(spark, "star")
    load_star_schema(spark, SF, other)
    assert spark.read.parquet(f"{other}/sales").count() == star.sales.count()


def test_document_frequencies_equal_the_fitted_model(spark):
    from pyspark.ml.feature import IDF, HashingTF

    texts = ml.clean_texts(spark.createDataFrame([("the red fox",), ("a red, red dog!",), ("Fox 7 hunts",)], "text string"))
    counts = ml.hashed_counts(texts)
    weights = IDF(inputCol="tf", outputCol="tfidf").fit(counts).idf.toArray()
    place = HashingTF(numFeatures=len(weights))
    exact = {r.word: r.idf for r in ml.document_frequencies(texts).collect() if r.word}
    assert set(exact) == {"red", "fox", "dog", "hunts"}
    assert all(abs(exact[w] - weights[place.indexOf(w)]) < 1e-12 for w in exact)


def test_term_vectors_equal_the_fitted_model(spark):
    from pyspark.ml.feature import IDF, CountVectorizer, StopWordsRemover, Tokenizer

    rows = [(1, "the red fox"), (2, "a red, red dog!"), (3, "Fox 7 hunts"), (4, None), (5, "the"), (None, "red fox fox")]
    texts = ml.clean_texts(spark.createDataFrame(rows, "id int, text string"))
    counts = ml.term_counts(texts, "id")
    words = ml.dictionary(counts, texts)
    numbers = {r.number: r.word for r in words.collect()}
    assert sorted(numbers) == list(range(len(numbers))) and [numbers[k] for k in sorted(numbers)] == sorted(numbers.values())
    got = {r.id: r for r in ml.term_vectors(texts.select("id"), counts, words, "id").collect()}
    assert set(got) == {1, 2, 3, 4, 5, None} and got[4].tf.numNonzeros() == 0 and got[4].tf.size == len(numbers)
    known = texts.where("text is not null")
    cut = StopWordsRemover(inputCol="w", outputCol="words").transform(Tokenizer(inputCol="clean", outputCol="w").transform(known))
    counter = CountVectorizer(inputCol="words", outputCol="tf").fit(cut)
    counted = counter.transform(cut)
    for r in counted.collect():
        assert {numbers[int(i)]: v for i, v in zip(got[r.id].tf.indices, got[r.id].tf.values)} == {counter.vocabulary[int(i)]: v for i, v in zip(r.tf.indices, r.tf.values)}
    weighted = IDF(inputCol="tf", outputCol="tfidf").fit(counted.select("tf")).transform(counted)
    scale = {w: r.idf for r in ml.dictionary(ml.term_counts(known, "id"), known).collect() for w in [r.word]}
    for r in weighted.collect():
        assert all(abs(v - r.tf[int(i)] * scale[counter.vocabulary[int(i)]]) < 1e-12 for i, v in zip(r.tfidf.indices, r.tfidf.values))
    entries = ml.vector_entries(ml.term_vectors(texts.select("id"), counts, words, "id"), "id", "tf", "tfidf").collect()
    assert {(r.id, numbers[r.number], r.tf) for r in entries} == {(r.id, r.word, float(r["count"])) for r in counts.collect()}


def test_stop_words_are_those_of_the_library(spark):
    from pyspark.ml.feature import StopWordsRemover

    from tallyforge.ml.queries import STOP_WORDS

    assert list(STOP_WORDS) == StopWordsRemover.loadDefaultStopWords("english")


def _plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_dates_prune_months_and_columns_are_read_by_need(spark):
    plan = _plan(QUERIES["tpcds_045_category_revenue"](spark, SF))
    assert "dynamicpruning" in plan and "net_paid" not in plan and "IsNotNull(manager_id)" in plan


@pytest.mark.parametrize("name", ["tpcds_047_best_and_worst_items", "tpcds_070_top_rows_of_eight_level_rollup", "win_09_top_per_partition"])
def test_top_ranks_are_cut_before_the_shuffle(spark, name):
    plan = _plan(QUERIES[name](spark, SF))
    assert re.search(r"WindowGroupLimit .*Partial", plan)


@pytest.mark.parametrize("name", [n for n in QUERIES if n.startswith("tpcds_")])
def test_no_report_builds_a_product(spark, name):
    plan = _plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Python" not in plan


def test_rate_stream_through_the_copy_job(spark):
    from tallyforge.streaming import jobs

    stream = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 5).load()
    out = scratch(spark, "rate")
    query = jobs.stamped_copy(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "state")).start()
    try:
        query.awaitTermination(8)
    finally:
        query.stop()
    rows = spark.read.parquet(out)
    assert rows.count() >= 5 and rows.where("time_stamp is null").count() == 0


def test_whole_texts_come_in_many_splits_without_a_shuffle(spark):
    path = scratch(spark, "texts")
    spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").write.option("maxRecordsPerFile", 1).text(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    texts = files.read_whole_texts(spark, path)
    assert texts.rdd.getNumPartitions() >= 100 and "Exchange" not in _plan(texts)
    assert files.read_whole_texts(spark, path, 7).rdd.getNumPartitions() in range(7, 15)
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    assert files.read_whole_texts(spark, path).count() == spark.read.text(path, wholetext=True).count()


def test_whole_texts_are_listed_one_group_of_folders_at_a_time(spark, monkeypatch):
    """No read opens more files than the driver may list, a folder of more is read by itself, and the rows are those of one read."""
    from tallyforge.catalogue import QUERIES
    from tallyforge.sources import queries as sources

    folder = scratch(spark, "pages")
    rows = [(None, None, None), (None, None, None), *[(i, f"u{i}", f"<p>{i}\n</p>" if i % 7 else None) for i in range(300)]]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    groups, plain = [], files._whole_texts

    def seen(spark, paths, *more):
        groups.append(plain(spark, paths, *more).count())
        return plain(spark, paths, *more)

    monkeypatch.setattr(files, "_whole_texts", seen)
    monkeypatch.setattr(sources, "FOLDER_FILES", 5)
    monkeypatch.setattr(files.read_whole_texts, "__defaults__", (*files.read_whole_texts.__defaults__[:2], 40))
    got = QUERIES["src_10_whole_texts"](spark, folder).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((None if i is None else str(i), html, True) for i, _, html in rows), key=repr)
    assert len(groups) > 7 and max(groups) <= 40 and sum(groups) == len(rows)


def test_a_page_without_html_stays_null(spark):
    from tallyforge.catalogue import QUERIES

    folder = scratch(spark, "pages")
    spark.createDataFrame([(1, "u", None), (2, "u", ""), (3, "u", "a\tb\nc\n")], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    assert sorted((r.page_id, r.html) for r in QUERIES["src_10_whole_texts"](spark, folder).collect()) == [("1", None), ("2", ""), ("3", "a\tb\nc\n")]


def test_lines_are_numbered_through_all_files(spark):
    path = scratch(spark, "lines")
    spark.range(1000).selectExpr("concat('line ', id) AS v").repartitionByRange(5, "v").sortWithinPartitions("v").write.text(path)
    numbered = files.numbered_lines(spark, path)
    want = sorted(f"line {k}" for k in range(1000))
    assert {r.line: r.value for r in numbered.collect()} == dict(enumerate(want, 1))
    small = spark.newSession()
    small.conf.set("spark.sql.files.maxPartitionBytes", "700")  # files are cut into several splits
    small.conf.set("spark.sql.files.openCostInBytes", "1")
    cut = files.numbered_lines(small, path)
    assert cut.count() == 1000 and {r.line: r.value for r in cut.collect()} == dict(enumerate(want, 1))
    assert files.numbered_lines(spark, scratch_of(spark, [])).count() == 0


def scratch_of(spark, rows):
    path = scratch(spark, "rows")
    spark.createDataFrame(rows, "value string").write.text(path)
    return path


def test_concordance_equals_counted_pairs(spark):
    import random

    draw = random.Random(2)
    rows = [(draw.choice([None, *range(12)]), draw.choice([None, 0.5, *[draw.random() for _ in range(6)]])) for _ in range(400)]
    known = [(a, b) for a, b in rows if a is not None and b is not None]
    pairs = [(x, y) for i, x in enumerate(known) for y in known[:i] if x[0] != y[0]]
    want = sum(0.5 if x[1] == y[1] else float((x[0] < y[0]) == (x[1] < y[1])) for x, y in pairs) / len(pairs)
    of = lambda rows: ml.concordance(spark.createDataFrame(rows, "a int, p double"), "a", "p")
    assert abs(of(rows) - want) < 1e-12
    assert of([(k, float(k)) for k in range(33)]) == 1.0 and of([(k, -float(k)) for k in range(33)]) == 0.0 and of([(k, 1.0) for k in range(5)]) == 0.5
    assert of([]) != of([])  # NaN


def test_stages_without_operators_stay_in_the_qualification(spark):
    from tallyforge.eventlog.events import qualification

    stages = spark.createDataFrame([("a", "1", "50"), ("a", "2", "70"), ("a", "3", "x"), (None, "1", "5"), ("b", "1", "50"), ("a", "10", "50")], "`App ID` string, `Stage ID` string, `Stage Task Duration` string")
    execs = spark.createDataFrame([("a", "1", " No ", "NONE"), ("a", "1", "true", "skip"), (None, "1", "0", None), ("b", "1", "true", None)], "`App ID` string, `Exec Stages` string, `Exec Is Supported` string, Action string")
    got = qualification(stages, execs)
    key = lambda r: (r[0] or "", r[1])
    assert sorted(map(tuple, got.collect()), key=key) == [(None, 1, 5, 1, 1), ("a", 1, 50, 2, 2), ("a", 2, 70, 1, 0), ("a", 3, None, 4, 0), ("a", 10, 50, 3, 0), ("b", 1, 50, 1, 0)]
    assert "windowspecdefinition(app" not in _plan(got)  # only one row for each range of the sorted table is in a window


def test_the_load_moves_lines_once_and_narrow(spark):
    """Line items and orders are dealt by order once; sales are laid out before the columns that follow from others."""
    from tallyforge.plans import mart

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        lines = mart.line_facts(spark.read.parquet(f"{SF}/lineitem.parquet"), spark.read.parquet(f"{SF}/orders.parquet"))
        plan = lines._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(l_orderkey") + plan.count("Exchange hashpartitioning(o_orderkey") == plan.count("Exchange ") == 2
        sales = mart.sales_fact(lines)
        top = sales._jdf.queryExecution().optimizedPlan()
        while top.nodeName() != "RebalancePartitions":
            top = top.children().head()
        assert top.output().size() <= 14 < len(sales.columns)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    stock = mart.inventory_fact(sales)._jdf.queryExecution().optimizedPlan()
    while stock.nodeName() != "RepartitionByExpression":
        stock = stock.children().head()
    assert stock.output().size() == 5


def test_single_words_are_not_shuffled(spark):
    """Texts are dealt by their key; counts need no further shuffle, and a null key is a key."""
    texts = ml.clean_texts(spark.createDataFrame([(1, "red fox red"), (1, "fox"), (None, "dog"), (None, "dog")], "id int, text string"))
    counts = ml.term_counts(texts, "id")
    assert counts._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert {tuple(r) for r in counts.collect()} == {(1, "red", 2), (1, "fox", 2), (None, "dog", 2)}
    words = ml.dictionary(counts, texts)
    got = ml.term_vectors(texts.select("id"), counts, words, "id").collect()
    assert sorted((r.id is None, sorted(r.tf.values)) for r in got) == [(False, [2.0, 2.0])] * 2 + [(True, [2.0])] * 2


def test_pages_are_written_by_many_tasks(spark):
    rows = QUERIES["src_10_whole_texts"](spark, SF)
    folder = {f.rsplit("/", 1)[0] for f in rows.inputFiles()}
    assert len(folder) == 1 and len({re.search(r"part-(\d+)", f).group(1) for f in rows.inputFiles()}) > 8
    assert rows.count() == spark.read.parquet(f"{SF}/pages.parquet").count()


def test_versions_stream_into_open_files(spark, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    seen, write, name = [], DataFrameWriter.parquet, "spark.sql.maxConcurrentOutputFileWriters"

    def parquet(self, path, *more, **named):
        if "/rows/version=" in path:
            seen.append(spark.conf.get(name))
        return write(self, path, *more, **named)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    path, before = scratch(spark, "versions"), spark.conf.get(name)
    V.write_version(spark.range(100).withColumn("k", c("id") % 20), path, datetime(2024, 1, 1), partition_by=("k",))  # more values than open files
    V.write_version(spark.range(100, 200).withColumn("k", c("id") % 20), path, datetime(2024, 1, 2), partition_by=("k",))
    V.compact(spark, path, datetime(2024, 1, 3), None, ("k",))
    assert seen == [str(V.OPEN_FILES)] * 3 and spark.conf.get(name) == before
    assert sorted(r.id for r in V.read(spark, path).collect()) == list(range(200))


def test_car_text_holds_no_keys_of_the_join(spark, tmp_path, monkeypatch):
    from tallyforge.ml import queries
    from tallyforge.sources.tables import Tables

    class Read(Exception):
        pass

    def stop(_, path):
        raise Read(path)

    spark.createDataFrame([(1, 7, 900.0)], "p_partkey long, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(5, 1, 3.0, 0.05, 0.02)], "l_orderkey long, l_partkey long, l_quantity double, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(queries, "read_csv", stop)
    with pytest.raises(Read) as path:
        queries.fuel_economy(Tables(spark, str(tmp_path)))
    assert spark.read.option("header", True).csv(str(path.value)).columns == ["l_orderkey", "cylinders", "displacement", "horsepower", "weight", "acceleration", "mpg"]
