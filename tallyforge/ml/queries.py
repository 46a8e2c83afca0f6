"""Model jobs over whole tables. What SQL can state exactly is checked exactly; of a fitted
model the query gives the facts that hold for any right fit."""

from __future__ import annotations

import os
import zipfile
from pathlib import Path

import pyspark
from pyspark.ml.feature import MinMaxScaler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import with_group_position, with_position
from ..operators.projection import level_of
from ..registry import on_tables
from ..session import kept, scratch
from ..sources.files import numbered_lines, read_csv
from ..streaming import jobs as streams
from . import jobs

c = F.col


def _one_row(t, **values) -> DataFrame:
    return t.region.agg(F.count("*").alias("_n")).select(*[F.lit(v).alias(k) for k, v in values.items()])


# ---- features -----------------------------------------------------------------------------------


@on_tables("ml_01_assembled_rows", "SELECT count(*) AS rows, sum((value * 100)::BIGINT)::BIGINT AS cents FROM events WHERE event_id % 10 <> 0")
def assembled_rows(t):
    rows = t.events.select(F.when(c("event_id") % 10 != 0, c("value")).alias("value"), "user_id")
    vectors = jobs.assembler(["value", "user_id"]).transform(rows).select(vector_to_array("features").alias("v"))
    return vectors.agg(F.count("*").alias("rows"), F.sum(F.round(c("v")[0] * 100).cast("long")).alias("cents"))


@on_tables("ml_02_min_max_scaled", """SELECT p_partkey, round((p_retailprice - (SELECT min(p_retailprice) FROM part)) / ((SELECT max(p_retailprice) FROM part) - (SELECT min(p_retailprice) FROM part)), 9) AS price,
    round((p_size - (SELECT min(p_size) FROM part))::DOUBLE / ((SELECT max(p_size) FROM part) - (SELECT min(p_size) FROM part)), 9) AS size, 0.5::DOUBLE AS same FROM part""")
def min_max_scaled(t):
    """A constant column scales to the middle of the range."""
    rows = jobs.assembler(["p_retailprice", "p_size", "one"]).transform(t.part.withColumn("one", F.lit(1.0)))
    scaled = MinMaxScaler(inputCol="features", outputCol="scaled").fit(rows).transform(rows).select("p_partkey", vector_to_array("scaled").alias("v"))
    return scaled.select("p_partkey", F.round(c("v")[0], 9).alias("price"), F.round(c("v")[1], 9).alias("size"), c("v")[2].alias("same"))


# ---- customers ------------------------------------------------------------------------------------


def _transactions(t) -> DataFrame:
    return t.orders.select(c("o_custkey").alias("cust_id"), F.to_date("o_orderdate").alias("day"), c("o_totalprice").cast("decimal(12,2)").alias("actual_price"),
                           c("o_orderkey").alias("movie_id"))


@on_tables("ml_03_clusters_do_not_overlap", "SELECT 4::BIGINT AS clusters, count(DISTINCT o_custkey) AS customers, 0::BIGINT AS overlaps FROM orders")
def clusters_do_not_overlap(t):
    """Clusters of one number are ranges: sorted by their least value, each ends before the next begins."""
    from pyspark.sql import Window

    measures = kept(jobs.rfm_measures(_transactions(t)).withColumn("monetary", c("monetary").cast("double")))
    out = jobs.rfm_clusters(measures).transform(measures)
    spans = out.groupBy("monetary_cluster").agg(F.min("monetary").alias("low"), F.max("monetary").alias("high"), F.count("*").alias("n"))
    spans = spans.withColumn("next", F.lead("low").over(Window.orderBy("low")))
    return spans.agg(F.count("*").alias("clusters"), F.sum("n").alias("customers"), F.sum(F.when(c("next") <= c("high"), 1).otherwise(0)).alias("overlaps"))


@on_tables("job_07_customer_scores", """SELECT o_custkey::VARCHAR AS cust_id, sum(o_totalprice::DECIMAL(12,2))::DOUBLE AS monetary, count(*) AS frequency, strftime(max(o_orderdate), '%Y-%m-%d') AS most_recent,
    true AS score_in_range FROM orders GROUP BY 1""")
def customer_scores(t):
    """ML-15: text CSV in, scored CSV out."""
    source, target = scratch(t.spark, "csv"), scratch(t.spark, "csv")
    _transactions(t).write.option("header", True).csv(source)
    rows = read_csv(t.spark, source).select("cust_id", c("day").cast("date").alias("day"), c("actual_price").cast("decimal(12,2)").alias("actual_price"), "movie_id")
    measures = kept(jobs.rfm_measures(rows).withColumn("monetary", c("monetary").cast("double")))
    scores = jobs.rfm_scores(measures, jobs.rfm_clusters(measures))
    scores.write.mode("overwrite").option("header", True).csv(target)
    schema = "cust_id string, monetary double, frequency long, most_recent string, recency_score int, frequency_score int, monetary_score int, score int"
    out = read_csv(t.spark, target, schema=schema)
    right = (c("score") == c("recency_score") + c("frequency_score") + c("monetary_score")) & c("score").between(3, 12)
    return out.select("cust_id", "monetary", "frequency", "most_recent", right.alias("score_in_range"))


@on_tables("ml_15_scores_follow_value", "SELECT count(DISTINCT o_custkey) AS customers, 0::BIGINT AS out_of_order FROM orders")
def scores_follow_value(t):
    """A higher monetary score means more money than any customer with a lower one."""
    measures = kept(jobs.rfm_measures(_transactions(t)).withColumn("monetary", c("monetary").cast("double")))
    scores = jobs.rfm_scores(measures, jobs.rfm_clusters(measures))
    spans = scores.groupBy("monetary_score").agg(F.min("monetary").alias("low"), F.max("monetary").alias("high"), F.count("*").alias("n"))
    below = spans.select((c("monetary_score") + 1).alias("monetary_score"), c("high").alias("below"))
    joined = spans.join(below, "monetary_score", "left")
    return joined.agg(F.sum("n").alias("customers"), F.sum(F.when(c("below") >= c("low"), 1).otherwise(0)).alias("out_of_order"))


# ---- regression -------------------------------------------------------------------------------------


def _cars(t) -> DataFrame:
    """Part and line columns in the roles of car data; the target follows from two of them."""
    parts = t.part.select("p_partkey", c("p_size").cast("double").alias("weight"), c("p_retailprice").alias("horsepower"))
    lines = t.lineitem.select("l_orderkey", "l_partkey", c("l_quantity").alias("cylinders"), (c("l_discount") * 100).alias("displacement"), (c("l_tax") * 100).alias("acceleration"))
    return lines.join(parts, c("l_partkey") == c("p_partkey")).withColumn("mpg", 60 - c("cylinders") * 0.7 - c("weight") * 0.3)


_CAR_FEATURES = ["cylinders", "displacement", "horsepower", "weight", "acceleration"]


@on_tables("job_08_fuel_economy", "SELECT count(*) AS rows, true AS split_is_whole, true AS fits FROM lineitem")
def fuel_economy(t):
    """ML-04 and ML-05: text CSV, casts, random forest of 50 trees, r2 and rmse on the held-out rows."""
    source = scratch(t.spark, "csv")
    _cars(t).select("l_orderkey", *_CAR_FEATURES, "mpg").write.option("header", True).csv(source)  # without the keys of the join
    cars = read_csv(t.spark, source).select(c("l_orderkey").try_cast("long").alias("l_orderkey"), *[c(n).try_cast("double").alias(n) for n in [*_CAR_FEATURES, "mpg"]])
    cars = kept(cars, "cars")  # the text is parsed once
    train, test = jobs.hash_split(cars, "l_orderkey", 0.7)
    scored = jobs.train_fuel_economy(train, _CAR_FEATURES).transform(test)
    mean = test.agg(F.avg("mpg"))
    square = lambda x: F.sum((c("mpg") - x) * (c("mpg") - x))
    fit = scored.agg(F.count("*").alias("n"), (1 - square(c("prediction")) / square(mean.scalar())).alias("r2"), F.sqrt(square(c("prediction")) / F.count("*")).alias("rmse"))
    sizes = cars.agg(F.count("*").alias("rows")).select("rows", train.agg(F.count("*")).scalar().alias("in_train"))
    return sizes.select("rows", (c("in_train") + fit.select("n").scalar() == c("rows")).alias("split_is_whole"), fit.select((c("r2") > 0.8) & (c("rmse") < 6)).scalar().alias("fits"))


@on_tables("ml_04_forest_regression", "SELECT count(*) AS rows, true AS beats_the_mean FROM lineitem")
def forest_regression(t):
    """Fifty trees on the training rows predict every row better than the mean does."""
    cars = _cars(t).select("l_orderkey", *_CAR_FEATURES, "mpg")
    train, _ = jobs.hash_split(cars, "l_orderkey", 0.7)
    predicted = jobs.train_fuel_economy(train, _CAR_FEATURES).transform(cars)
    mean = cars.agg(F.avg("mpg").alias("m"))
    error = lambda x: F.sum((c("mpg") - x) * (c("mpg") - x))
    return predicted.agg(F.count("*").alias("rows"), (error(c("prediction")) < error(mean.scalar()) * 0.2).alias("beats_the_mean"))


@on_tables("ml_05_evaluator", """WITH p AS (SELECT l_quantity y, l_quantity + l_discount * 10 z FROM lineitem)
    SELECT round(sqrt(sum((y - z) ** 2) / count(*)), 6) AS rmse, round(1 - sum((y - z) ** 2) / sum((y - (SELECT avg(y) FROM p)) ** 2), 6) AS r2 FROM p""")
def evaluator(t):
    rows = t.lineitem.select(c("l_quantity").alias("y"), (c("l_quantity") + c("l_discount") * 10).alias("prediction"))
    quality = jobs.regression_quality(rows, "y")
    return _one_row(t, rmse=round(quality["rmse"], 6), r2=round(quality["r2"], 6))


@on_tables("ml_10_saved_parts", """SELECT s_suppkey, round((s_acctbal - (SELECT min(s_acctbal) FROM supplier)) / ((SELECT max(s_acctbal) FROM supplier) - (SELECT min(s_acctbal) FROM supplier)), 9) AS scaled FROM supplier""")
def saved_parts(t):
    """Assembler and scaler are saved, loaded and used."""
    from pyspark.ml.feature import MinMaxScalerModel, VectorAssembler

    path, vectors = scratch(t.spark, "model"), jobs.assembler(["s_acctbal"])
    MinMaxScaler(inputCol="features", outputCol="scaled").fit(vectors.transform(t.supplier)).write().overwrite().save(f"{path}/scaler")
    vectors.write().overwrite().save(f"{path}/vectors")
    rows = MinMaxScalerModel.load(f"{path}/scaler").transform(VectorAssembler.load(f"{path}/vectors").transform(t.supplier))
    return rows.select("s_suppkey", F.round(vector_to_array("scaled")[0], 9).alias("scaled"))


@on_tables("ml_12_linear_classifier", "SELECT count(*) AS rows, true AS separates FROM lineitem")
def linear_classifier(t):
    """A linear support vector classifier finds a linear rule in the line items."""
    from pyspark.ml.classification import LinearSVC

    rows = t.lineitem.select("l_orderkey", "l_quantity", c("l_linenumber").cast("double").alias("n"), F.when(c("l_quantity") > 25, 1.0).otherwise(0.0).alias("label"))
    vectors = jobs.assembler(["l_quantity", "n"]).transform(rows)
    train, _ = jobs.hash_split(vectors, "l_orderkey", 0.8)
    score = jobs.f1(LinearSVC(maxIter=50, regParam=0.001).fit(train).transform(vectors))
    return rows.agg(F.count("*").alias("rows")).withColumn("separates", F.lit(bool(score > 0.9)))


@on_tables("ml_14_random_split", "SELECT count(*) AS rows, true AS same_again FROM orders")
def random_split(t):
    """Seeded parts are disjoint and whole, and come out the same again."""
    keys = t.orders.select("o_orderkey")
    first, second = keys.randomSplit([0.8, 0.2], seed=100)
    again, _ = keys.randomSplit([0.8, 0.2], seed=100)
    same = first.join(again, "o_orderkey", "left_anti").isEmpty()
    return first.unionByName(second).distinct().agg(F.count("*").alias("rows")).withColumn("same_again", F.lit(same))


# ---- remaining life -----------------------------------------------------------------------------------


def _cycles(t) -> DataFrame:
    """Events as sensor cycles: the user is the asset, the place of the event is its age."""
    placed = with_group_position(t.events.select(c("user_id").alias("asset_id"), "ts", "event_id", "value"), ["asset_id"], ["ts", "event_id"], "current_age")
    return placed.select("asset_id", c("current_age").cast("int").alias("current_age"), "event_id", c("value").alias("sensor1"), (c("current_age") * 0.5 + c("value") * 0.01).alias("sensor2"),
                         (c("event_id") % 3).cast("double").alias("setting1"))


_CYCLES_SQL = "(SELECT user_id AS asset_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INTEGER AS current_age, count(*) OVER (PARTITION BY user_id) AS max_age FROM events)"


@on_tables("ml_07_remaining_life_label", f"SELECT asset_id, event_id, current_age, max_age, (max_age - current_age + 1)::INTEGER AS rul, 1.0::DOUBLE AS censor FROM {_CYCLES_SQL}")
def remaining_life_label(t):
    return jobs.label_remaining_life(_cycles(t)).select("asset_id", "event_id", "current_age", "max_age", "rul", "censor")


@on_tables("ml_08_test_cycles", f"SELECT asset_id, event_id, (max_age + asset_id % 20)::BIGINT AS max_age, current_age AS rul, (max_age + asset_id % 20 - current_age)::INTEGER AS current_age FROM {_CYCLES_SQL}")
def test_cycles(t):
    """Test rows keep their remaining life; line n of the label file, which holds nothing but ages, belongs to the n-th asset."""
    rows = _cycles(t).select("asset_id", "event_id", c("current_age").alias("rul"))
    path = scratch(t.spark, "ages")
    assets = t.events.select(c("user_id").alias("asset_id")).distinct()
    assets.repartitionByRange(4, "asset_id").sortWithinPartitions("asset_id").select((c("asset_id") % 20).cast("string")).write.text(path)
    ages = numbered_lines(t.spark, path).select("line", c("value").cast("long").alias("initial_age"))
    initial = with_position(assets, ["asset_id"], "line").join(ages, "line").select("asset_id", "initial_age")
    return jobs.test_cycles(rows, initial).select("asset_id", "event_id", "max_age", "rul", "current_age")


@on_tables("ml_09_feature_columns", "SELECT unnest(['current_age', 'sensor1', 'sensor2', 'setting1']) AS name, count(*) AS rows FROM events")
def chosen_columns(t):
    cycles = _cycles(t)
    names = F.array(*[F.lit(n) for n in jobs.feature_columns(cycles)])
    return cycles.agg(F.count("*").alias("rows")).select(F.explode(names).alias("name"), "rows")


@on_tables("ml_06_survival_model", "SELECT count(*) AS rows, true AS all_positive FROM events")
def survival_model(t):
    labelled = jobs.label_remaining_life(_cycles(t))
    scored = jobs.RemainingLife.train(labelled, 10).score(labelled)
    return scored.agg(F.count("*").alias("rows"), (F.min("predicted_RUL") > 0).alias("all_positive"))


@on_tables("ml_06_concordance", "SELECT count(*) AS rows, true AS beats_a_constant, 0.5::DOUBLE AS of_a_constant FROM events")
def survival_concordance(t):
    """Of assets that the model has not seen, it puts more pairs of rows in the order of their remaining life than a constant does."""
    labelled = jobs.label_remaining_life(_cycles(t))
    train, unseen = jobs.hash_split(labelled, "asset_id", 0.8)
    scored = kept(jobs.RemainingLife.train(train, 10).score(unseen).select("rul", "predicted_RUL"), "scored")
    of = lambda frame: jobs.concordance(frame, "rul", "predicted_RUL")
    constant = of(scored.withColumn("predicted_RUL", F.lit(1.0)))
    return labelled.agg(F.count("*").alias("rows")).withColumn("beats_a_constant", F.lit(of(scored) > constant)).withColumn("of_a_constant", F.lit(constant))


@on_tables("job_09_train_and_reload", "SELECT count(*) AS rows, 0::BIGINT AS changed FROM events")
def train_and_reload(t):
    """ML-10: train, save, load; the loaded parts score every row the same."""
    path = scratch(t.spark, "model")
    labelled = jobs.label_remaining_life(_cycles(t))
    model = jobs.RemainingLife.train(labelled, 10)
    model.save(path)
    loaded = jobs.RemainingLife.load(path).score(labelled).select("event_id", c("predicted_RUL").alias("again"))
    joined = model.score(labelled).select("event_id", "predicted_RUL").join(loaded, "event_id")
    return joined.agg(F.count("*").alias("rows"), F.sum(F.when(c("predicted_RUL") != c("again"), 1).otherwise(0)).alias("changed"))


@on_tables("job_10_streaming_scores", "SELECT count(*) AS rows, 0::BIGINT AS changed, 0::BIGINT AS wrong_levels FROM events")
def streaming_scores(t):
    """JSON messages in, scored once per batch, alerts and a partitioned table out; equal to scoring in one batch."""
    path, base, source = scratch(t.spark, "model"), scratch(t.spark, "sinks"), scratch(t.spark, "messages")
    labelled = jobs.label_remaining_life(_cycles(t))
    jobs.RemainingLife.train(labelled, 10).save(path)
    model = jobs.RemainingLife.load(path)
    features = ["asset_id", "event_id", *jobs.feature_columns(labelled)]
    labelled.select(c("asset_id").cast("string").alias("key"), F.to_json(F.struct(*features)).cast("binary").alias("value"), F.current_timestamp().alias("timestamp")).write.parquet(source)
    schema = labelled.select(*features).schema
    stream = streams.message_stream(t.spark, "parquet", {"path": source}, streams.MESSAGE)
    rows = stream.select(F.from_json(c("value").cast("string"), schema).alias("data"), "timestamp").select("data.*", "timestamp")

    def alerts(scored, batch_id):
        found = F.array_compact(F.array(*[F.when(inside, F.lit(name)) for name, inside in level_of(c("predicted_RUL")).items() if name != "GREEN"]))
        streams.batch_folder(f"{base}/alerts")(scored.select("asset_id", "event_id", "predicted_RUL", F.explode(found).alias("level")), batch_id)

    handle = streams.fan_out([(True, alerts), (True, streams.batch_folder(f"{base}/scores"))], model.score)
    streams.to_batches(rows, handle, scratch(t.spark, "state")).awaitTermination()
    batch = model.score(labelled).select("event_id", c("predicted_RUL").alias("expected"))
    joined = t.spark.read.parquet(f"{base}/scores").join(batch, "event_id")
    levels = t.spark.read.parquet(f"{base}/alerts")
    outside = ~(((c("level") == "RED") & c("predicted_RUL").between(10, 30)) | ((c("level") == "YELLOW") & c("predicted_RUL").between(30, 60)))
    wrong = levels.agg(F.coalesce(F.sum(F.when(outside, 1).otherwise(0)), F.lit(0)).alias("w"))
    return joined.agg(F.count("*").alias("rows"), F.sum(F.when(F.abs(c("predicted_RUL") - c("expected")) > 1e-9, 1).otherwise(0)).alias("changed")).withColumn(
        "wrong_levels", wrong.scalar())


# ---- text -----------------------------------------------------------------------------------------------


def stop_words() -> list[str]:
    """The English stop words of the feature library, read from where it keeps them."""
    jars = Path(os.environ.get("SPARK_HOME") or pyspark.__path__[0]) / "jars"
    with zipfile.ZipFile(next(jars.glob("spark-mllib_*.jar"))) as jar:
        return jar.read("org/apache/spark/ml/feature/stopwords/english.txt").decode().split()


STOP_WORDS = stop_words()
_STOP_SQL = ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS)


@on_tables("ml_11_inverse_document_frequency", r"""WITH w AS (SELECT doc_id, unnest(string_split(lower(rtrim(regexp_replace(text, '[[:punct:]0-9\r\t\n]', ' ', 'g'))), ' ')) AS word FROM documents),
    d AS (SELECT word, count(DISTINCT doc_id) AS docs FROM w GROUP BY 1)
    SELECT word, docs, round(ln(((SELECT count(*) FROM documents) + 1)::DOUBLE / (docs + 1)), 9) AS idf FROM d WHERE word NOT IN (""" + _STOP_SQL + ")")
def inverse_document_frequency(t):
    """Document frequency and weight of every word that stop-word removal keeps."""
    table = jobs.document_frequencies(jobs.clean_texts(t.documents.select("doc_id", "text")))
    return table.select("word", "docs", F.round("idf", 9).alias("idf"))


@on_tables("ml_11_term_vectors", r"""WITH w AS (SELECT doc_id, unnest(string_split(lower(rtrim(regexp_replace(text, '[[:punct:]0-9\r\t\n]', ' ', 'g'))), ' ')) AS word FROM documents),
    k AS (SELECT doc_id, word, count(*) AS count FROM w WHERE word NOT IN (""" + _STOP_SQL + """) GROUP BY 1, 2),
    d AS (SELECT word, ln(((SELECT count(*) FROM documents) + 1)::DOUBLE / (count(*) + 1)) AS idf FROM k GROUP BY 1)
    SELECT doc_id, word, count, round(count * idf, 6) AS weight FROM k JOIN d USING (word)""")
def term_vectors(t):
    """Every entry of the sparse vectors of all documents, by its word."""
    texts = jobs.clean_texts(t.documents.select("doc_id", "text"))
    counts = kept(jobs.term_counts(texts, "doc_id"), "counts")
    words = kept(jobs.dictionary(counts, texts), "dictionary")
    vectors = jobs.term_vectors(t.documents.select("doc_id"), counts, words, "doc_id")
    entries = jobs.vector_entries(vectors, "doc_id", "tf", "tfidf").join(words, "number")
    return entries.select("doc_id", "word", c("tf").cast("long").alias("count"), F.round("tfidf", 6).alias("weight"))


@on_tables("job_17_text_quality", "SELECT count(*) AS rows, true AS beats_the_majority FROM labels JOIN documents USING (doc_id)")
def text_quality(t):
    """ML-12 and ML-13: cleaned text, weighted counts, linear classifier; its F1 on the held-out rows is over that of the majority's label."""
    rows = t.documents.select("doc_id", "text").join(t.labels, "doc_id").select("doc_id", "text", (1 - c("toxic")).cast("double").alias("label"))  # symbols are cleaned away, so words must tell
    rows = kept(jobs.hashed_counts(jobs.clean_texts(rows)).select("doc_id", "label", "tf"), "counts")  # cleaned and cut into words once
    train, test = jobs.hash_split(rows, "doc_id", 0.8)
    model = jobs.train_text_quality(train)
    scored = kept(model.transform(test).select("label", "prediction"), "scored")
    most = train.groupBy("label").count().orderBy(c("count").desc(), "label").first()["label"]
    better = jobs.f1(scored) > jobs.f1(scored.withColumn("prediction", F.lit(most)))
    return rows.agg(F.count("*").alias("rows")).withColumn("beats_the_majority", F.lit(better))


@on_tables("job_17_exact_terms", r"""WITH w AS (SELECT unnest(string_split(lower(rtrim(regexp_replace(text, '[[:punct:]0-9\r\t\n]', ' ', 'g'))), ' ')) AS word FROM documents JOIN labels USING (doc_id))
    SELECT (SELECT count(*) FROM labels JOIN documents USING (doc_id)) AS rows, count(DISTINCT word) AS words, true AS fits_its_rows FROM w WHERE word NOT IN (""" + _STOP_SQL + ")")
def exact_terms(t):
    """The same model on the exact term vectors: one weight for each word, and the rows it was fitted on are told apart better than by the majority's label."""
    rows = t.documents.select("doc_id", "text").join(t.labels, "doc_id").select("doc_id", "text", (1 - c("toxic")).cast("double").alias("label"))
    counts = kept(jobs.term_counts(jobs.clean_texts(rows), "doc_id"), "counts")
    rows = rows.select("doc_id", "label")
    words = kept(jobs.dictionary(counts, rows), "dictionary")  # of all documents; the split comes after the weighting
    vectors = jobs.term_vectors(rows, counts, words, "doc_id")
    train, _ = jobs.hash_split(vectors, "doc_id", 0.8)
    model = jobs.train_on_terms(train)
    scored = kept(model.transform(train).select("label", "prediction"), "scored")
    most = train.groupBy("label").count().orderBy(c("count").desc(), "label").first()["label"]
    better = jobs.f1(scored) > jobs.f1(scored.withColumn("prediction", F.lit(most)))
    return rows.agg(F.count("*").alias("rows")).withColumn("words", F.lit(model.numFeatures).cast("long")).withColumn("fits_its_rows", F.lit(better))


@on_tables("ml_13_f1", """WITH p AS (SELECT l_orderkey % 2 AS y, CASE WHEN l_linenumber > 5 THEN 1 ELSE l_orderkey % 2 END AS z FROM lineitem),
    k AS (SELECT c, count(*) FILTER (WHERE y = c) n, count(*) FILTER (WHERE y = c AND z = c) tp, count(*) FILTER (WHERE z = c) pred FROM p, (VALUES (0), (1)) v(c) GROUP BY 1)
    SELECT round(sum(2.0::DOUBLE * tp / (n + pred) * n) / sum(n), 9) AS f1 FROM k""")
def f1_score(t):
    rows = t.lineitem.select((c("l_orderkey") % 2).cast("double").alias("label"), F.when(c("l_linenumber") > 5, 1).otherwise(c("l_orderkey") % 2).cast("double").alias("prediction"))
    return _one_row(t, f1=round(jobs.f1(rows), 9))
