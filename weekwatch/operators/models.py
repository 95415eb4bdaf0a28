"""Classifiers on Spark ML: single fits and the comparison of algorithms.

Every fit and every transform is a Spark job; the forests of whole experiments are in ``forests``. A forest cannot equal
another library's forest bit for bit, because bins and samples differ.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekwatch.functions.classify import CLASSES
from weekwatch.session import at_once


def with_label(rows: DataFrame) -> DataFrame:
    """Class index in the fixed class order."""
    chain = F.when(F.col("etiqueta") == CLASSES[0], 0.0)
    for i, name in enumerate(CLASSES[1:], start=1):
        chain = chain.when(F.col("etiqueta") == name, float(i))
    return rows.withColumn("label", chain)


def with_weights(train: DataFrame) -> DataFrame:
    """Balanced class weights of the training rows."""
    counts = train.groupBy("etiqueta").agg(F.count(F.lit(1)).alias("_n"))
    sums = counts.agg(F.sum("_n").alias("_total"), F.count(F.lit(1)).alias("_clases"))
    weights = counts.withColumns(
        {"_total": sums.select("_total").scalar(), "_clases": sums.select("_clases").scalar()}
    ).select("etiqueta", (F.col("_total") / (F.col("_clases") * F.col("_n"))).alias("peso"))
    return train.join(F.broadcast(weights), "etiqueta")


def _class_name(index: Column) -> Column:
    return F.get(F.array(*[F.lit(c) for c in CLASSES]), index.cast("int"))


def _assembler(names: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(names), outputCol="features")


def require_rows(train: DataFrame) -> None:
    """A split without training rows is an error of the request, not a model."""
    if train.isEmpty():
        raise ValueError("no training rows: check that the data cover the requested split")


def fit_forest(train: DataFrame, names: Sequence[str], trees: int = 300, depth: int = 10, seed: int = 42) -> PipelineModel:
    require_rows(train)
    forest = RandomForestClassifier(
        labelCol="label", weightCol="peso", numTrees=trees, maxDepth=depth, seed=seed
    )
    return Pipeline(stages=[_assembler(names), forest]).fit(with_weights(with_label(train)))


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Predicted class and one probability per class; a class never trained on gets 0."""
    scored = model.transform(rows)
    chances = vector_to_array("probability")
    probability = {
        f"p_{name}": F.coalesce(F.get(chances, F.lit(i)), F.lit(0.0)) for i, name in enumerate(CLASSES)
    }
    return scored.withColumns({"pred": _class_name(F.col("prediction")), **probability}).drop(
        "features", "rawPrediction", "probability", "prediction"
    )


def importances(model: PipelineModel, names: Sequence[str], top: int = 10) -> DataFrame:
    """Most important predictors of a fitted forest."""
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    values = model.stages[-1].featureImportances.toArray().tolist()
    table = spark.createDataFrame(list(zip(names, values, strict=True)), "variable string, importancia double")
    return table.orderBy(F.desc("importancia"), "variable").limit(top)


def compare_algorithms(
    train: DataFrame, test: DataFrame, names: Sequence[str], trees: int = 300, depth: int = 10, seed: int = 42,
    rounds: int = 100, iterations: int = 2000,
) -> DataFrame:
    """Predictions of forest, boosting and scaled logistic regression on one split.

    Fits are many small jobs one after another, so the algorithms and the classes of the boosting are fitted at once.
    """
    require_rows(train)
    ready = with_weights(with_label(train)).cache()
    boosting = OneVsRest(
        classifier=GBTClassifier(maxIter=rounds, maxDepth=3, seed=seed), labelCol="label", featuresCol="features",
        parallelism=len(CLASSES),
    )
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True)
    logistic = LogisticRegression(featuresCol="scaled", labelCol="label", weightCol="peso", maxIter=iterations)
    forest = RandomForestClassifier(labelCol="label", weightCol="peso", numTrees=trees, maxDepth=depth, seed=seed)
    stages = {"bosque": [forest], "refuerzo": [boosting], "logistica": [scaler, logistic]}

    def predicted(name: str) -> DataFrame:
        model = Pipeline(stages=[_assembler(names), *stages[name]]).fit(ready)
        scored = model.transform(test).withColumn("pred", _class_name(F.col("prediction")))
        return scored.select(*test.columns, "pred").withColumn("algoritmo", F.lit(name))

    parts = at_once(train.sparkSession, [partial(predicted, name) for name in stages])
    ready.unpersist()
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def score_week(path: str, rows: DataFrame, year: int | None = None, week: int | None = None) -> DataFrame:
    """Stored model applied to all rows of one week; the latest when none is asked for. Empty when absent."""
    if year is None or week is None:
        latest = rows.agg(F.max(F.struct("anio", "semana")).alias("s")).select("s.anio", "s.semana")
        chosen = rows.join(F.broadcast(latest), ["anio", "semana"]).select(*rows.columns)
    else:
        chosen = rows.filter((F.col("anio") == year) & (F.col("semana") == week))
    scored = predict(PipelineModel.load(path), chosen)
    return scored.withColumns({f"p_{c}": F.round(f"p_{c}", 4) for c in CLASSES})
