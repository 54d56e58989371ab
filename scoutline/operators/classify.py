"""Text classifiers: sublinear TF-IDF of one to three words with balanced logistic regression, linear SVMs or a forest."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel, ElementwiseProduct, Normalizer, SQLTransformer, StringIndexer, StringIndexerModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseVector, Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutline.functions.text import terms
from scoutline.operators.metrics import class_weights


def grams(text: Column) -> Column:
    """Words of two or more letters or digits, lower-cased, and their sequences of up to three."""
    return terms(F.coalesce(text, F.lit("")), 2, 3)


def features(rows: DataFrame, vocabulary: int = 15_000, min_df: int = 2) -> list:
    """Fitted stages from `grams` to `features`: the most frequent terms of at least min_df texts, 1 + ln(tf), idf ln((1 + N) / (1 + df)) + 1,
    length 1."""
    count: CountVectorizerModel = CountVectorizer(inputCol="grams", outputCol="tf", vocabSize=vocabulary, minDF=min_df).fit(rows)
    known = rows.select(F.explode(F.array_distinct("grams")).alias("term")).join(F.broadcast(rows.sparkSession.createDataFrame([(w, k) for k, w in enumerate(count.vocabulary)], "term string, k int")), "term")  # the vocabulary
    n = rows.count()
    df = {r["k"]: r["n"] for r in known.groupBy("k").agg(F.count("*").alias("n")).collect()}
    idf = [math.log((1 + n) / (1 + df.get(k, 0))) + 1 for k in range(len(count.vocabulary))]
    return [count, _Sublinear(), ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="log_tf", outputCol="weighed"), Normalizer(inputCol="weighed", outputCol="features", p=2.0)]


class _Sublinear(SQLTransformer):
    """log_tf: 1 + ln(tf) where a term occurs. Sparse vectors have no built-in for that and would be 15,000 numbers each as arrays."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        logs = F.udf(lambda v: SparseVector(v.size, v.indices, 1 + np.log(v.values)), VectorUDT(), useArrow=False)
        # written, since the planner can't put a Python function between those of the stages around it
        return dataset.withColumn("log_tf", logs("tf")).checkpoint()


def fit(train: DataFrame, kind: str = "logistic", vocabulary: int = 15_000, min_df: int = 2) -> Classifier:
    """A model from (text, label). logistic and forest weigh classes by N / (K n); logistic_unweighted doesn't."""
    df = train.where("label is not null").select(grams(F.col("text")).alias("grams"), F.col("label").cast("string").alias("label"))
    df = df.join(F.broadcast(class_weights(df, "label")), "label")  # a row a label
    indexer: StringIndexerModel = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc", handleInvalid="keep").fit(df)
    stages = features(df, vocabulary, min_df)
    ready = PipelineModel([indexer, *stages]).transform(df).select("y", "weight", "features").checkpoint()
    n = max(1, ready.count())
    last = {
        "logistic": LogisticRegression(labelCol="y", weightCol="weight", maxIter=100, regParam=1.0 / (5 * n), standardization=False),
        "logistic_unweighted": LogisticRegression(labelCol="y", maxIter=100, regParam=1.0 / (5 * n), standardization=False),
        "svm": OneVsRest(classifier=LinearSVC(maxIter=50, standardization=False), labelCol="y", weightCol="weight"),
        "forest": RandomForestClassifier(labelCol="y", weightCol="weight", numTrees=200, seed=42),
    }[kind]
    return Classifier(indexer, stages, Pipeline(stages=[last]).fit(ready))


class Classifier:
    """predict(): the likeliest label; ranked(): labels with their probabilities (margins of an SVM), the likeliest first."""

    def __init__(self, indexer: StringIndexerModel, stages: list, model: PipelineModel) -> None:
        self.indexer, self.stages, self.model = indexer, stages, model

    @property
    def labels(self) -> list[str]:
        return list(self.indexer.labels)

    def transform(self, docs: DataFrame) -> DataFrame:
        """(doc_id, prediction and, as the model has them, probability or rawPrediction) for (doc_id, text)."""
        ready = PipelineModel(self.stages).transform(docs.select("doc_id", "text", grams(F.col("text")).alias("grams")))
        return self.model.transform(ready)

    def ranked(self, docs: DataFrame, k: int | None = None) -> DataFrame:
        """(doc_id, ranked: array of (label, score))."""
        out = self.transform(docs)
        score = vector_to_array("probability" if "probability" in out.columns else "rawPrediction")
        names = F.array(*map(F.lit, self.labels))
        pairs = F.zip_with(names, score, lambda name, s: F.struct((-s).alias("s"), name.alias("label")))
        best = F.transform(F.array_sort(F.filter(pairs, lambda x: x["label"].isNotNull())), lambda x: F.struct(x["label"].alias("label"), (-x["s"]).alias("score")))
        return out.select("doc_id", (F.slice(best, 1, k) if k else best).alias("ranked"))

    def save(self, path: str) -> None:
        """A folder with the fitted stages; load() reads them back."""
        count, _, scale, _ = self.stages
        for name, stage in (("indexer", self.indexer), ("count", count), ("scale", scale), ("model", self.model)):
            stage.write().overwrite().save(f"{path}/{name}")

    @staticmethod
    def load(path: str) -> Classifier:
        count, scale = CountVectorizerModel.load(f"{path}/count"), ElementwiseProduct.load(f"{path}/scale")
        stages = [count, _Sublinear(), scale, Normalizer(inputCol="weighed", outputCol="features", p=2.0)]
        return Classifier(StringIndexerModel.load(f"{path}/indexer"), stages, PipelineModel.load(f"{path}/model"))


def predict(model: Classifier, docs: DataFrame) -> DataFrame:
    """(doc_id, label, predicted) for (doc_id, text, label)."""
    out = model.ranked(docs, 1).select("doc_id", F.get("ranked", F.lit(0))["label"].alias("predicted"))
    return docs.select("doc_id", F.col("label").cast("string").alias("label")).join(out, "doc_id").select("doc_id", "label", "predicted")
