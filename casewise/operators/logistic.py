"""Binomial regression: single fits on Spark ML; selection loops fit all models of a step in one job per Newton pass."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewise.operators.linear import aliased, complete_rows, eliminate, linear_score, moments, stepwise_search


@dataclass
class LogisticFit:
    terms: list[str]
    estimate: list[float]
    std_error: list[float]
    p_value: list[float]
    aic: float
    vif: dict[str, float] | None = None


def fit_logistic(rows: DataFrame, label: str, predictors: Sequence[str], tol: float = 1e-8) -> LogisticFit:
    """Fit on complete rows; each iteration is one distributed pass over the cached features."""
    data = complete_rows(rows, [label, *predictors])
    assembled = VectorAssembler(inputCols=list(predictors), outputCol="_features").transform(data)
    features = assembled.select(label, "_features").persist()
    try:
        model = GeneralizedLinearRegression(
            family="binomial", link="logit", labelCol=label, featuresCol="_features", tol=tol, maxIter=50
        ).fit(features)
        summary = model.summary
        # Spark lists the intercept last in the standard errors and p-values.
        errors, p, aic = list(summary.coefficientStandardErrors), list(summary.pValues), float(summary.aic)
    finally:
        features.unpersist()
    return LogisticFit(
        terms=["(Intercept)", *predictors],
        estimate=[float(model.intercept), *[float(b) for b in model.coefficients]],
        std_error=[errors[-1], *errors[:-1]],
        p_value=[p[-1], *p[:-1]],
        aic=aic,
    )


def logistic_table(spark: SparkSession, fit: LogisticFit) -> DataFrame:
    rows = [
        (t, float(b), float(s), float(b / s), float(p), fit.aic)
        for t, b, s, p in zip(fit.terms, fit.estimate, fit.std_error, fit.p_value)
    ]
    return spark.createDataFrame(rows, "term string, estimate double, std_error double, z_value double, p_value double, aic double")


def probability(terms: Sequence[str], estimate: Sequence[float]) -> Column:
    """Predicted probability; NULL where a predictor is NULL."""
    return 1 / (1 + F.exp(-linear_score(terms, estimate)))


def logistic_vif(rows: DataFrame, fit: LogisticFit) -> dict[str, float]:
    """Variance inflation from the coefficient covariance, in one weighted pass."""
    predictors = fit.terms[1:]
    if len(predictors) < 2:
        return {p: 1.0 for p in predictors}
    p = probability(fit.terms, fit.estimate)
    weighted = complete_rows(rows, predictors).withColumn("_w", p * (1 - p)).withColumn("_one", F.lit(1.0))
    names = ["_one", *predictors]
    sums = [
        F.sum(F.col("_w") * F.col(a) * F.col(b)).alias(f"s{i}_{j}")
        for i, a in enumerate(names) for j, b in enumerate(names) if i <= j
    ]
    one = weighted.agg(*sums).first()
    k = len(names)
    information = np.array([[one[f"s{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    scale = np.sqrt(np.diag(information))
    covariance = np.linalg.inv(information / np.outer(scale, scale)) / np.outer(scale, scale)
    inner = covariance[1:, 1:]
    spread = np.sqrt(np.diag(inner))
    return dict(zip(predictors, np.diag(np.linalg.inv(inner / np.outer(spread, spread))).tolist()))


def fit_many(rows: DataFrame, label: str, models: Sequence[Sequence[str]], tol: float = 1e-16, passes: int = 50) -> list[LogisticFit]:
    """Maximum likelihood fits of many models on the same complete rows, all in one job per Newton pass.

    A pass adds up, on the executors, each model's log-likelihood, gradient and weighted cross products at its current estimate: k * k + k + 1 numbers
    a model and task, whatever the number of rows. Models that have converged drop out.
    Where a step lowers the likelihood it is halved. VIFs come from the same cross products.
    """
    models = [list(m) for m in models]
    columns = list(dict.fromkeys(c for m in models for c in m))
    data = rows.select(label, *columns)
    at = [[0, *[1 + columns.index(c) for c in m]] for m in models]
    trial = [np.zeros(1 + len(m)) for m in models]
    best = [None] * len(models)  # log-likelihood, estimate, gradient, information
    active = list(range(len(models)))
    for _ in range(passes):
        if not active:
            break
        going = []
        for i, (ll, gradient, information) in zip(active, _newton_sums(data, [(at[i], trial[i]) for i in active])):
            if best[i] is not None and not ll >= best[i][0] - 1e-10 * (1 + abs(best[i][0])):
                trial[i] = (best[i][1] + trial[i]) / 2
                going.append(i)
                continue
            best[i] = (ll, trial[i], gradient, information)
            step = _solve(information, gradient)
            trial[i] = trial[i] + step
            if gradient @ step > tol * (1 + abs(ll)):  # what the step is expected to gain
                going.append(i)
        active = going
    return [_described(m, *best[i]) for i, m in enumerate(models)]


def _newton_sums(data: DataFrame, models: list[tuple[list[int], np.ndarray]]) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """Log-likelihood, gradient and information of each (columns, estimate); column 0 is the intercept."""

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = [np.zeros(1 + len(b) + len(b) ** 2) for _, b in models]
        for batch in batches:
            values = batch.to_numpy(dtype=float)
            y, x = values[:, 0], np.column_stack([np.ones(len(values)), values[:, 1:]])
            for total, (at, b) in zip(sums, models):
                own = x[:, at]
                eta = own @ b
                p = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
                total[0] += (y * eta - np.logaddexp(0, eta)).sum()
                total[1 : 1 + len(b)] += own.T @ (y - p)
                total[1 + len(b) :] += (own.T @ (own * (p * (1 - p))[:, None])).ravel()
        yield pd.DataFrame({"model": np.arange(len(models), dtype="int32"), "sums": sums})

    added = data.mapInPandas(add_up, "model int, sums array<double>").groupBy("model").agg(Summarizer.sum(array_to_vector("sums")).alias("s"))
    found = {r["model"]: r["s"].toArray() for r in added.collect()}  # k * k + k + 1 numbers a model
    out = []
    for i, (_, b) in enumerate(models):
        k, total = len(b), found.get(i, np.zeros(1 + len(b) + len(b) ** 2))
        out.append((float(total[0]), total[1 : 1 + k], total[1 + k :].reshape(k, k)))
    return out


def _solve(information: np.ndarray, gradient: np.ndarray) -> np.ndarray:
    """The Newton step, on columns brought to the same scale; directions without information are left alone."""
    scale = np.sqrt(np.maximum(np.diag(information), 0.0))
    scale[scale == 0] = 1.0
    return np.linalg.lstsq(information / np.outer(scale, scale), gradient / scale, rcond=1e-13)[0] / scale


def _described(predictors: list[str], ll: float, estimate: np.ndarray, gradient: np.ndarray, information: np.ndarray) -> LogisticFit:
    scale = np.sqrt(np.maximum(np.diag(information), 0.0))
    scale[scale == 0] = 1.0
    covariance = np.linalg.pinv(information / np.outer(scale, scale), rcond=1e-13) / np.outer(scale, scale)
    errors = np.sqrt(np.maximum(np.diag(covariance), 0.0))
    p = [math.erfc(abs(b / s) / math.sqrt(2)) if s > 0 else math.nan for b, s in zip(estimate, errors)]
    inner = covariance[1:, 1:]
    spread = np.sqrt(np.maximum(np.diag(inner), 1e-300))
    factors = np.diag(np.linalg.pinv(inner / np.outer(spread, spread))) if len(predictors) > 1 else np.ones(len(predictors))
    return LogisticFit(["(Intercept)", *predictors], estimate.tolist(), errors.tolist(), p, -2 * ll + 2 * len(estimate), dict(zip(predictors, factors.tolist())))


def stepwise_aic_logistic(rows: DataFrame, label: str, predictors: Sequence[str]):
    """Both-direction AIC search without aliased predictors; a step's candidates are fitted together. The complete rows are cached."""
    data = complete_rows(rows, [label, *predictors]).persist()
    usable = _independent(data, predictors)
    known: dict[tuple, LogisticFit] = {}

    def aics_of(models):
        new = [m for m in models if tuple(m) not in known]
        for terms, fit in zip(new, fit_many(data, label, new) if new else []):
            known[tuple(terms)] = fit
        return [known[tuple(m)].aic for m in models]

    try:
        return stepwise_search(usable, aics_of) if data.limit(1).count() else []
    finally:
        data.unpersist()


def _independent(rows: DataFrame, predictors: Sequence[str]) -> list[str]:
    """Predictors that are no linear combination of earlier ones; Spark gives no errors for aliased fits."""
    dropped = aliased(moments(rows, predictors), predictors)
    return [p for p in predictors if p not in dropped]


def backward_eliminate_logistic(rows: DataFrame, label: str, predictors: Sequence[str], **limits):
    """Backward elimination by VIF and p-value, without aliased predictors; p and VIF of a step come from one fit."""
    data = complete_rows(rows, [label, *predictors]).persist()

    def examine(terms):
        (fit,) = fit_many(data, label, [terms])
        return fit.vif, dict(zip(fit.terms[1:], fit.p_value[1:]))

    try:
        return eliminate(_independent(data, predictors), examine, **limits)
    finally:
        data.unpersist()
