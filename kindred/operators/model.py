"""Learned scoring: grouped folds, out-of-fold scores, the mean over fold models."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators.partition import fold


def out_of_fold(pairs: DataFrame, features: list[str], label: str, folds: int = 5, rounds: int = 20, depth: int = 5) -> tuple[DataFrame, list]:
    """Pairs with `prob` from a model that saw no pair of their s1, and the fold models."""
    ready = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep").transform(pairs).withColumn("_fold", fold(F.col("s1"), folds).cast("int"))
    models, parts = [], []
    for k in range(folds):
        m = GBTClassifier(featuresCol="_x", labelCol=label, maxIter=rounds, maxDepth=depth, seed=42).fit(ready.where(F.col("_fold") != k))
        models.append(m)
        parts.append(scored(m, ready.where(F.col("_fold") == k), "prob"))
    return reduce(DataFrame.unionByName, parts).drop("_x", "_fold"), models


def scored(model, ready: DataFrame, name: str) -> DataFrame:  # noqa: ANN001
    return model.transform(ready).withColumn(name, vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def mean_of(models: list, pairs: DataFrame, features: list[str]) -> DataFrame:
    """New pairs with `prob`, the mean over the fold models."""
    out = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep").transform(pairs)
    for i, m in enumerate(models):
        out = scored(m, out, f"_p{i}")
    total = sum((F.col(f"_p{i}") for i in range(1, len(models))), F.col("_p0"))
    return out.withColumn("prob", total / len(models)).drop("_x", *[f"_p{i}" for i in range(len(models))])


def calibrated(pairs: DataFrame, prob: str, label: str) -> DataFrame:
    """Isotonic calibration of a probability, fitted on the pairs themselves."""
    model = IsotonicRegression(featuresCol=prob, labelCol=label).fit(pairs.withColumn(label, F.col(label).cast("double")))
    return model.transform(pairs).withColumnRenamed("prediction", "calibrated")


def stacker(pairs: DataFrame, features: list[str], label: str, quarters: int = 4, seeds: tuple[int, ...] = (1, 2), rounds: int = 60, depth: int = 4) -> DataFrame:
    """Pairs with `prob`, each scored by models that saw no pair of its s1's quarter.

    For every quarter left out: a slice of the other s1 records (crc32 of the id, 15 of 20) says how many rounds pay,
    then as many are fitted on all of them, and the mean over the seeds scores the quarter."""
    own = F.crc32(F.col("s1").cast("string").cast("binary"))
    ready = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep").transform(pairs)
    ready = ready.withColumn("_quarter", fold(F.reverse(F.col("s1").cast("string")), quarters).cast("int")).withColumn("_stop", own % 20 == 15)
    parts = []
    for k in range(quarters):
        seen, out = ready.where(F.col("_quarter") != k), ready.where(F.col("_quarter") == k)
        for i, seed in enumerate(seeds):
            tree = GBTClassifier(featuresCol="_x", labelCol=label, maxDepth=depth, seed=seed, stepSize=0.1)
            first = tree.copy({tree.maxIter: rounds, tree.validationIndicatorCol: "_stop"}).fit(seen)
            out = scored(tree.copy({tree.maxIter: max(1, first.getNumTrees)}).fit(seen), out, f"_p{i}")
        mean = sum((F.col(f"_p{i}") for i in range(1, len(seeds))), F.col("_p0")) / len(seeds)
        parts.append(out.withColumn("prob", mean).drop("_x", "_quarter", "_stop", *[f"_p{i}" for i in range(len(seeds))]))
    return reduce(DataFrame.unionByName, parts)
