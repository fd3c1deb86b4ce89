"""Linear regression and variable selection from one pass of cross products.

Spark reduces the table to a p x p matrix; every fit, elimination and selection step after that is
a small solve on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewise.functions.significance import t_two_sided

# Up to this many columns the products are built-in aggregates; beyond, one matrix per task.
AGGREGATE_LIMIT = 24
ALIAS_TOLERANCE = 1e-9
# A residual sum below this share of the response's is rounding.
PERFECT = 1e-14


@dataclass
class Moments:
    """Row count, means and centred cross products of complete rows."""

    columns: list[str]
    n: float
    mean: np.ndarray
    cross: np.ndarray

    def index(self, names: Sequence[str]) -> list[int]:
        return [self.columns.index(c) for c in names]


@dataclass
class OlsFit:
    terms: list[str]
    estimate: np.ndarray
    std_error: np.ndarray
    n: float
    rss: float
    r2: float
    adj_r2: float

    @property
    def rank(self) -> int:
        """Terms with an estimate; a predictor that earlier ones determine has none."""
        return int(np.isfinite(self.estimate).sum())

    @property
    def df(self) -> float:
        return self.n - self.rank

    @property
    def aic(self) -> float:
        """Minus infinity for a perfect fit, not a number without rows."""
        if self.n <= 0:
            return math.nan
        return self.n * math.log(self.rss / self.n) + 2 * self.rank if self.rss > 0 else -math.inf

    def t_values(self) -> list[float]:
        """Infinite where a perfect fit leaves no error, not a number where there is no estimate or no degree of freedom."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return [float(t) for t in self.estimate / self.std_error]

    def p_values(self) -> list[float]:
        return [math.nan if math.isnan(t) else 0.0 if math.isinf(t) else t_two_sided(t, self.df) for t in self.t_values()]


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    return numbers.dropna()


def moments(df: DataFrame, columns: Sequence[str]) -> Moments:
    """Count, means and centred cross products in one pass."""
    columns = list(columns)
    rows = complete_rows(df, columns)
    p = len(columns)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    cross = np.zeros((p, p))
    if p <= AGGREGATE_LIMIT:
        one = rows.agg(
            F.count(F.lit(1)).alias("n"),
            *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
            *[F.covar_pop(columns[i], columns[j]).alias(f"s{i}_{j}") for i, j in pairs],
        ).first()
        n, mean = float(one["n"]), np.array([one[f"m{i}"] or 0.0 for i in range(p)])
        for i, j in pairs:
            cross[i, j] = cross[j, i] = (one[f"s{i}_{j}"] or 0.0) * n
        return Moments(columns, n, mean, cross)

    head = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    mean = np.array([head[f"m{i}"] or 0.0 for i in range(p)])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((p, p))
        for batch in batches:
            x = batch.to_numpy(dtype=float) - mean
            total += x.T @ x
        at = np.arange(p, dtype="int32")
        yield pd.DataFrame({"i": np.repeat(at, p), "j": np.tile(at, p), "s": total.ravel()})

    summed = rows.mapInPandas(partial, "i int, j int, s double").where("i <= j").groupBy("i", "j").agg(F.sum("s").alias("s"))
    for r in summed.collect():  # p * (p + 1) / 2 numbers
        cross[r["i"], r["j"]] = cross[r["j"], r["i"]] = r["s"]
    return Moments(columns, float(head["n"]), mean, cross)


def fit_ols(m: Moments, response: str, predictors: Sequence[str]) -> OlsFit:
    """Least squares with intercept.

    Defined for every table: a predictor that is constant or a combination of earlier ones has no estimate; without degrees of freedom
    there are no errors; a fit whose residual is rounding is perfect, its residual sum is zero; of a constant response R2 is not a number.
    """
    names, y = list(predictors), m.columns.index(response)
    usable = [p for p in names if p not in aliased(m, names)]
    x, at = m.index(usable), [1 + names.index(p) for p in usable]
    terms = ["(Intercept)", *names]
    estimate, std_error = np.full(len(terms), np.nan), np.full(len(terms), np.nan)
    if m.n <= 0:
        return OlsFit(terms, estimate, std_error, 0.0, math.nan, math.nan, math.nan)
    gram, target, whole = m.cross[np.ix_(x, x)], m.cross[x, y], float(m.cross[y, y])
    inverse = np.linalg.inv(gram) if x else np.zeros((0, 0))
    slopes, centre = inverse @ target, m.mean[x]
    rss = whole - float(slopes @ target)
    rss = rss if rss > PERFECT * whole else 0.0
    df = m.n - len(x) - 1
    estimate[[0, *at]] = np.concatenate([[m.mean[y] - slopes @ centre], slopes])
    if df > 0:
        variance = np.concatenate([[1.0 / m.n + centre @ inverse @ centre], np.diag(inverse)]) * rss / df
        std_error[[0, *at]] = np.sqrt(np.maximum(variance, 0.0))
    r2 = 1.0 - rss / whole if whole > 0 else math.nan
    adjusted = 1.0 - (1.0 - r2) * (m.n - 1) / df if df > 0 else math.nan
    return OlsFit(terms, estimate, std_error, m.n, rss, r2, adjusted)


def _number(value: float) -> float | None:
    return None if math.isnan(value) else float(value)


def ols_table(spark: SparkSession, fit: OlsFit) -> DataFrame:
    """One row per term, with the fit's R2 repeated; NULL for what the fit doesn't determine, and no row at all without data."""
    rows = [
        (term, *map(_number, (b, s, t, p, fit.r2, fit.adj_r2)))
        for term, b, s, t, p in zip(fit.terms, fit.estimate, fit.std_error, fit.t_values(), fit.p_values())
    ]
    names = "term string, estimate double, std_error double, t_value double, p_value double, r2 double, adj_r2 double"
    return spark.createDataFrame(rows if fit.n > 0 else [], names)


def linear_score(terms: Sequence[str], estimate: Sequence[float]) -> Column:
    """The linear predictor as a column; NULL where a predictor is NULL."""
    total = F.lit(0.0)
    for term, b in zip(terms, estimate):
        total = total + (F.lit(float(b)) if term == "(Intercept)" else F.col(term) * F.lit(float(b)))
    return total


def aliased(m: Moments, predictors: Sequence[str]) -> list[str]:
    """Predictors that are linear combinations of earlier ones (or constant)."""
    at = m.index(predictors)
    work = m.cross[np.ix_(at, at)].copy()
    size = np.diag(work).copy()
    found = []
    for k, name in enumerate(predictors):
        if size[k] <= 0 or work[k, k] <= ALIAS_TOLERANCE * size[k]:
            found.append(name)
            continue
        work = work - np.outer(work[:, k], work[k, :]) / work[k, k]
    return found


def vif(m: Moments, predictors: Sequence[str]) -> dict[str, float]:
    """Diagonal of the inverse correlation matrix."""
    at = m.index(predictors)
    if len(at) < 2:
        return {name: 1.0 for name in predictors}
    cross = m.cross[np.ix_(at, at)]
    scale = np.sqrt(np.diag(cross))
    return dict(zip(predictors, np.diag(np.linalg.inv(cross / np.outer(scale, scale))).tolist()))


def vif_table(spark: SparkSession, factors: dict[str, float]) -> DataFrame:
    return spark.createDataFrame(sorted(factors.items(), key=lambda kv: -kv[1]), "term string, vif double")


def stepwise_search(predictors: Sequence[str], aics_of) -> list[tuple[int, str, str | None, float]]:
    """Both-direction search from the full model: rows (step, action, term, aic), until nothing lowers the AIC.

    ``aics_of`` gets all the models of a step at once and returns their AICs. Without rows there is no AIC and no trail.
    """
    current = list(predictors)
    (best,) = aics_of([current])
    if math.isnan(best):
        return []
    trail = [(0, "start", None, best)]
    while True:
        moves = [("drop", t, [c for c in current if c != t]) for t in current]
        moves += [("add", t, [c for c in predictors if c in current or c == t]) for t in predictors if t not in current]
        if not moves:
            return trail
        scored = [(aic, *move) for aic, move in zip(aics_of([terms for *_, terms in moves]), moves)]
        aic, action, term, terms = min(scored, key=lambda s: s[0])
        if aic >= best - 1e-9:
            return trail
        current, best = terms, aic
        trail.append((len(trail), action, term, aic))


def stepwise_aic(m: Moments, response: str, predictors: Sequence[str]) -> list[tuple[int, str, str | None, float]]:
    """Stepwise search for least squares; all candidates come from the same cross products."""
    dropped = aliased(m, predictors)
    usable = [p for p in predictors if p not in dropped]
    return stepwise_search(usable, lambda models: [fit_ols(m, response, terms).aic for terms in models])


def eliminate(predictors: Sequence[str], examine, max_vif: float = 5.0, max_p: float = 0.05) -> list[tuple[int, str, str, float, float]]:
    """Backward elimination: rows (step, dropped term, reason, vif, p).

    Each step drops the largest VIF above ``max_vif`` if that term is also insignificant, else the
    largest p above ``max_p``. Two terms alone share their VIF; the less significant one counts as
    larger. ``examine`` returns ({term: vif}, {term: p}).
    """
    current, trail = list(predictors), []
    while current:
        factors, p = examine(current)
        top = max(factors[c] for c in current) * (1 - 1e-9)
        widest = max((c for c in current if factors[c] >= top), key=lambda c: p[c])
        weakest = max(current, key=lambda c: p[c])
        if factors[widest] > max_vif and p[widest] > max_p:
            out, reason = widest, "vif"
        elif p[weakest] > max_p:
            out, reason = weakest, "p"
        else:
            return trail
        trail.append((len(trail) + 1, out, reason, float(factors[out]), float(p[out])))
        current.remove(out)
    return trail


def backward_eliminate(m: Moments, response: str, predictors: Sequence[str], **limits):
    dropped = aliased(m, predictors)
    usable = [p for p in predictors if p not in dropped]

    def examine(terms):
        fit = fit_ols(m, response, terms)
        # A p-value that the table doesn't determine is no reason to drop a term.
        return vif(m, terms), {t: 0.0 if math.isnan(p) else p for t, p in zip(fit.terms[1:], fit.p_values()[1:])}

    return eliminate(usable, examine, **limits)
