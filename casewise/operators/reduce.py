"""Dimension reduction, kernel classification and cross-validation on vector columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewise.functions.hashing import key_hash


ITERATIONS = 30
FITS_AT_ONCE = 2


def fit_pca(df: DataFrame, array_col: str, k: int):
    """Principal components of the centred data; the covariance is summed on the executors."""
    vectors = df.select(array_to_vector(array_col).alias("_v"))
    return PCA(k=k, inputCol="_v", outputCol="_pc").fit(vectors)


def pca_variance(df: DataFrame, array_col: str, width: int) -> DataFrame:
    """Share and cumulative share of variance per component."""
    shares = fit_pca(df, array_col, width).explainedVariance.toArray()
    rows = [(i + 1, float(v), float(c)) for i, (v, c) in enumerate(zip(shares, np.cumsum(shares)))]
    return df.sparkSession.createDataFrame(rows, "component long, share double, cumulative double")


def pca_project(model, df: DataFrame, array_col: str, name: str = "projected") -> DataFrame:
    projected = model.transform(df.withColumn("_v", array_to_vector(array_col)))
    return projected.withColumn(name, vector_to_array("_pc")).drop("_v", "_pc")


def fourier_features(df: DataFrame, array_col: str, width: int, features: int, gamma: float, seed: int = 100) -> DataFrame:
    """Random Fourier features of the radial kernel exp(-gamma * |x - y|^2), one matrix product per batch."""
    rng = np.random.default_rng(seed)
    weights = rng.normal(scale=np.sqrt(2.0 * gamma), size=(width, features))
    shift = rng.uniform(0.0, 2.0 * np.pi, size=features)

    @F.pandas_udf("array<double>")
    def project(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            x = np.stack(batch.to_numpy()) if len(batch) else np.zeros((0, width))
            yield pd.Series(list(np.sqrt(2.0 / features) * np.cos(x @ weights + shift)))

    return df.withColumn("_features", array_to_vector(project(F.col(array_col))))


def kernel_classifier(train: DataFrame, label: str, n: int, cost: float = 1.0, head: str = "logistic"):
    """A linear head on the kernel features: ``logistic`` (multinomial) or ``svc`` (one against the rest)."""
    penalty = 1.0 / (cost * max(n, 1))
    if head == "logistic":
        learner = LogisticRegression(labelCol=label, featuresCol="_features", regParam=penalty, maxIter=ITERATIONS)
    elif head == "svc":
        svc = LinearSVC(regParam=penalty, maxIter=ITERATIONS, featuresCol="_features")
        learner = OneVsRest(classifier=svc, labelCol=label, featuresCol="_features")
    else:
        raise ValueError(f"unknown head {head!r}")
    return learner.fit(train)


def cross_validate_grid(df: DataFrame, key: str, label: str, costs: Sequence[float], folds: int = 5, seed: int = 100) -> DataFrame:
    """Mean accuracy per cost; folds come from the key hash.

    Every pass of every fit returns a result per task, so the cached rows lie in a partition for each core, however many there are.
    Each fit that runs caches its training rows once more, so no more than ``FITS_AT_ONCE`` run.
    """
    tasks = df.sparkSession.sparkContext.defaultParallelism
    marked = df.withColumn("_fold", (key_hash(seed, key) % folds).cast("int")).coalesce(tasks).persist()
    try:
        total = marked.count()
        n = max(total * (folds - 1) // folds, 1)
        learner = LogisticRegression(labelCol=label, featuresCol="_features", maxIter=ITERATIONS)
        grid = ParamGridBuilder().addGrid(learner.regParam, [1.0 / (c * n) for c in costs]).build()
        judge = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")
        fitted = CrossValidator(
            estimator=learner, estimatorParamMaps=grid, evaluator=judge, numFolds=folds, foldCol="_fold", parallelism=FITS_AT_ONCE
        ).fit(marked)
    finally:
        marked.unpersist()
    best = int(np.argmax(fitted.avgMetrics))
    table = [(float(c), float(a), i == best) for i, (c, a) in enumerate(zip(costs, fitted.avgMetrics))]
    return df.sparkSession.createDataFrame(table, "cost double, accuracy double, is_best boolean")
