"""Model jobs with MLlib: customer scoring, fuel economy, remaining life, text quality."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LinearSVCModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import HashingTF, IDF, MinMaxScaler, MinMaxScalerModel, StopWordsRemover, Tokenizer, VectorAssembler
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.regression import AFTSurvivalRegression, AFTSurvivalRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import remove_punctuation
from ..operators.ordered import match, running, with_position
from ..session import kept, scratch

c = F.col


def hash_split(frame: DataFrame, key: str, share: float) -> tuple[DataFrame, DataFrame]:
    """A split by key: the same rows on every run and every cluster, unlike a random split."""
    bucket = F.pmod(F.xxhash64(key), F.lit(1000))
    return frame.where(bucket < int(share * 1000)), frame.where(bucket >= int(share * 1000))


def assembler(columns: list[str], out: str = "features") -> VectorAssembler:
    """Vectors from columns; rows with missing values are left out."""
    return VectorAssembler(inputCols=columns, outputCol=out, handleInvalid="skip")


# ---- customer scoring -------------------------------------------------------------------------


def rfm_measures(transactions: DataFrame, as_of: str = "2020-12-31") -> DataFrame:
    """cust_id, monetary, frequency, most_recent, recency_days from (cust_id, day, actual_price, movie_id)."""
    per = transactions.groupBy("cust_id").agg(F.sum("actual_price").alias("monetary"), F.count("movie_id").alias("frequency"), F.max("day").alias("most_recent"))
    return per.withColumn("recency_days", F.datediff(F.to_date(F.lit(as_of)), "most_recent"))


_MEASURES = (("recency", "recency_days", True), ("frequency", "frequency", False), ("monetary", "monetary", False))


def rfm_clusters(measures: DataFrame, k: int = 4, seed: int = 7) -> PipelineModel:
    """One k-means per measure in one model."""
    vectors = [assembler([column], f"{name}_feature") for name, column, _ in _MEASURES]
    means = [KMeans(featuresCol=f"{name}_feature", predictionCol=f"{name}_cluster", k=k, seed=seed) for name, _, _ in _MEASURES]
    return Pipeline(stages=vectors + means).fit(measures)


def rfm_scores(measures: DataFrame, model: PipelineModel) -> DataFrame:
    """Clusters ordered by their greatest value give 1 (worst) to k (best); few recency days are best."""
    out = model.transform(measures)
    for name, column, reverse in _MEASURES:
        greatest = out.groupBy(f"{name}_cluster").agg(F.max(column).alias("m"))  # k rows
        line = Window.orderBy(c("m").desc() if reverse else c("m").asc())
        ranks = greatest.select(f"{name}_cluster", F.row_number().over(line).alias(f"{name}_score"))
        out = out.join(F.broadcast(ranks), f"{name}_cluster")
    scores = [c(f"{name}_score") for name, _, _ in _MEASURES]
    return out.select("cust_id", "monetary", "frequency", "most_recent", *scores, reduce(lambda a, b: a + b, scores).alias("score"))


# ---- fuel economy ------------------------------------------------------------------------------


def train_fuel_economy(cars: DataFrame, features: list[str], label: str = "mpg", trees: int = 50, seed: int = 7):
    return Pipeline(stages=[assembler(features), RandomForestRegressor(numTrees=trees, featuresCol="features", labelCol=label, seed=seed)]).fit(cars)


def regression_quality(predicted: DataFrame, label: str) -> dict[str, float]:
    return {name: RegressionEvaluator(labelCol=label, predictionCol="prediction", metricName=name).evaluate(predicted) for name in ("r2", "rmse")}


# ---- remaining useful life ------------------------------------------------------------------------


def feature_columns(frame: DataFrame) -> list[str]:
    return [n for n in frame.columns if n.startswith(("sensor", "setting", "current_age"))]


def label_remaining_life(cycles: DataFrame) -> DataFrame:
    """``rul = max_age - current_age + 1`` where max_age is the number of cycles of the asset."""
    ages = cycles.groupBy("asset_id").agg(F.count("*").alias("max_age"))
    joined = match(cycles, ages, ["asset_id"])  # rows without an asset are one group of their own
    return joined.withColumn("rul", (c("max_age") - c("current_age") + 1).cast("int")).withColumn("censor", F.lit(1.0))


def test_cycles(cycles: DataFrame, initial_ages: DataFrame) -> DataFrame:
    """Test rows hold ``rul``; the age follows from the asset's cycles and its given initial age."""
    ages = cycles.groupBy("asset_id").agg(F.count("*").alias("age")).join(initial_ages, "asset_id")
    ages = ages.select("asset_id", (c("age") + c("initial_age")).alias("max_age"))
    return cycles.join(ages, "asset_id").withColumn("current_age", (c("max_age") - c("rul")).cast("int"))


class RemainingLife:
    """Assembler, scaler and survival model, saved and loaded together."""

    def __init__(self, vectors: VectorAssembler, scaler: MinMaxScalerModel, model: AFTSurvivalRegressionModel):
        self.vectors, self.scaler, self.model = vectors, scaler, model

    @classmethod
    def train(cls, labelled: DataFrame, iterations: int = 20) -> RemainingLife:
        vectors = assembler(feature_columns(labelled))
        rows = vectors.transform(labelled)
        scaler = MinMaxScaler(inputCol="features", outputCol="scaled_features").fit(rows)
        aft = AFTSurvivalRegression(featuresCol="scaled_features", labelCol="rul", censorCol="censor", maxIter=iterations)
        return cls(vectors, scaler, aft.fit(scaler.transform(rows)))

    def save(self, path: str) -> None:
        self.vectors.write().overwrite().save(f"{path}/features_model")
        self.scaler.write().overwrite().save(f"{path}/scaler_model")
        self.model.write().overwrite().save(f"{path}/survival_model")

    @classmethod
    def load(cls, path: str) -> RemainingLife:
        return cls(VectorAssembler.load(f"{path}/features_model"), MinMaxScalerModel.load(f"{path}/scaler_model"),
                   AFTSurvivalRegressionModel.load(f"{path}/survival_model"))

    def score(self, rows: DataFrame) -> DataFrame:
        scored = self.model.transform(self.scaler.transform(self.vectors.transform(rows)))
        return scored.drop("features", "scaled_features").withColumnRenamed("prediction", "predicted_RUL")


def concordance(scored: DataFrame, actual: str, predicted: str) -> float:
    """Share of the pairs of rows with unlike ``actual`` whose predictions are in the same order; equal predictions count one half.

    No pair is formed. Predictions are replaced by their places; two places differ first at one bit of their
    binary form, so each pair belongs to one bit and one prefix above it, where the rows with the bit set meet
    running counts, by ``actual``, of those without. Rows of null are left out; without any comparable pair the result is NaN.
    """
    rows = kept(scored.where(c(actual).isNotNull() & c(predicted).isNotNull()).groupBy(c(actual).alias("_y"), c(predicted).alias("_x")).agg(F.count("*").alias("_n")), "scores")
    placed = rows.join(with_position(rows.select("_x").distinct(), ["_x"], "_place"), "_x")
    top = placed.agg(F.coalesce(F.max("_place"), F.lit(0))).first()[0]
    bits = placed.select("_y", "_n", "_place", F.explode(F.sequence(F.lit(0), F.lit(max(0, int(top).bit_length() - 1)))).alias("_bit"))
    above, set_ = F.expr("shiftright(_place, _bit + 1)"), F.expr("shiftright(_place, _bit) & 1") == 1
    counts = bits.groupBy("_bit", above.alias("_above"), "_y").agg(F.sum(F.when(set_, c("_n")).otherwise(0)).alias("_high"), F.sum(F.when(set_, 0).otherwise(c("_n"))).alias("_low"))
    upto = running(counts, ["_bit", "_above"], ["_y"], "_low", "_upto")
    right = upto.agg(F.sum(c("_high") * (c("_upto") - c("_low"))).cast("double")).first()[0] or 0.0
    half = lambda keys: rows.groupBy(*keys).agg(F.sum("_n").cast("double").alias("n")).agg(F.sum(c("n") * c("n"))).first()[0] or 0.0  # pairs within a group, twice
    everything, same_actual, same_predicted, same_both = half([]), half(["_y"]), half(["_x"]), half(["_y", "_x"])
    comparable, tied = (everything - same_actual) / 2, (same_predicted - same_both) / 2
    return (right + tied / 2) / comparable if comparable else float("nan")


# ---- text quality -----------------------------------------------------------------------------------


def hashed_counts(texts: DataFrame, size: int = 1 << 18) -> DataFrame:
    """``tf``: counts of the words without stop words by their hash. No vocabulary is held, and no word is left out."""
    steps = [Tokenizer(inputCol="clean", outputCol="words"), StopWordsRemover(inputCol="words", outputCol="words_nsw"),
             HashingTF(inputCol="words_nsw", outputCol="tf", numFeatures=size)]
    return Pipeline(stages=steps).fit(texts).transform(texts)


def document_frequencies(texts: DataFrame) -> DataFrame:
    """word, docs, idf of every word left after stop-word removal, with no limit on the vocabulary."""
    steps = Pipeline(stages=[Tokenizer(inputCol="clean", outputCol="words"), StopWordsRemover(inputCol="words", outputCol="words_nsw")])
    words = steps.fit(texts).transform(texts).select(F.explode(F.array_distinct("words_nsw")).alias("word"))
    size = texts.agg(F.count("*").alias("n"))
    counts = words.groupBy("word").agg(F.count("*").alias("docs"))
    return counts.withColumn("idf", F.log((size.scalar() + 1).cast("double") / (c("docs") + 1)))


def term_counts(texts: DataFrame, key: str) -> DataFrame:
    """(key, word, count) of the words that stop-word removal keeps; a null text has none.

    The texts are dealt by their key before they are cut, so the longer rows of single words are not shuffled.
    """
    steps = Pipeline(stages=[Tokenizer(inputCol="clean", outputCol="words"), StopWordsRemover(inputCol="words", outputCol="words_nsw")])
    known = texts.where(c("clean").isNotNull()).select(key, "clean").repartition(key)
    return steps.fit(known).transform(known).select(key, F.explode("words_nsw").alias("word")).groupBy(key, "word").agg(F.count("*").alias("count"))


def dictionary(counts: DataFrame, documents: DataFrame) -> DataFrame:
    """word, number (from 0, by the order of the words), docs, idf. A distributed table: no vocabulary is held in one place."""
    words = counts.groupBy("word").agg(F.count("*").alias("docs"))
    size = documents.agg(F.count("*").alias("n"))
    weighted = words.withColumn("idf", F.log((size.scalar() + 1).cast("double") / (c("docs") + 1)))
    return with_position(weighted, ["word"]).withColumn("number", (c("position") - 1).cast("int")).drop("position")


_SPARSE = "struct<type: tinyint, size: int, indices: array<int>, values: array<double>>"


def term_vectors(documents: DataFrame, counts: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """``documents`` with the sparse vectors ``tf`` (counts) and ``tfidf`` (counts times idf) over the dictionary.

    Every word has a place of its own; words that the dictionary doesn't hold are left out. A vector
    is put together where its document's counts meet, and its document comes there; a struct holds the key, in which null equals null. Spark has no function from arrays to sparse vectors, so
    they are written in the layout of a vector and read back as one.
    """
    size = words.agg(F.coalesce(F.max("number") + 1, F.lit(0))).first()[0]
    entries = counts.join(words.select("word", "number", "idf"), "word").groupBy(F.struct(key).alias("_key")).agg(
        F.sort_array(F.collect_list(F.struct("number", "count", (c("count") * c("idf")).alias("weight")))).alias("e"))
    filled = documents.withColumn("_key", F.struct(key)).join(entries, "_key", "left").withColumn("e", F.coalesce("e", F.array().cast("array<struct<number:int,count:bigint,weight:double>>")))
    vector = lambda values: F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"), c("e.number").alias("indices"), c(values).cast("array<double>").alias("values"))
    out = filled.select(*documents.columns, vector("e.count").alias("tf"), vector("e.weight").alias("tfidf"))
    path = scratch(documents.sparkSession, "term-vectors")
    out.write.option("compression", "zstd").parquet(path)
    schema = T.StructType([T.StructField(f.name, VectorUDT() if f.name in ("tf", "tfidf") else f.dataType) for f in out.schema])
    return documents.sparkSession.read.schema(schema).parquet(path)


def vector_entries(vectors: DataFrame, key: str, *columns: str) -> DataFrame:
    """(key, number, value of each column): the entries of sparse vectors that have the same places."""
    parts = [F.from_json(F.to_json(F.struct(c(n).alias("v"))), f"v {_SPARSE}")["v"].alias(n) for n in columns]
    zipped = F.arrays_zip(c(f"{columns[0]}.indices").alias("number"), *[c(f"{n}.values").alias(n) for n in columns])
    return vectors.select(key, *parts).select(key, F.explode(zipped).alias("e")).select(key, "e.*")


def clean_texts(texts: DataFrame) -> DataFrame:
    return texts.withColumn("clean", remove_punctuation(c("text")))


def train_text_quality(train: DataFrame) -> PipelineModel:
    """Counts weighted by inverse document frequency and a linear support vector classifier, on (tf, label)."""
    return Pipeline(stages=[IDF(inputCol="tf", outputCol="tfidf"), LinearSVC(featuresCol="tfidf", labelCol="label", maxIter=50, regParam=0.3)]).fit(train)


def train_on_terms(train: DataFrame) -> LinearSVCModel:
    """The same classifier on exact term vectors (tfidf, label). The penalty is on the weights as they are, so that a word of
    one document is not raised to the weight of a common one; gradients are added up over three levels of tasks."""
    return LinearSVC(featuresCol="tfidf", labelCol="label", maxIter=50, regParam=0.3, standardization=False, aggregationDepth=3).fit(train)


def f1(predicted: DataFrame) -> float:
    return MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction", metricName="f1").evaluate(predicted)

